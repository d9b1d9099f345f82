"""Ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retain_recent(df: DataFrame, key: str, order: list, most: int = 50, keep: int = 10) -> DataFrame:
    """W06. Groups of over `most` rows keep their `keep` newest."""
    n = F.count("*").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", n).withColumn("__r", rank).where((F.col("__n") <= most) | (F.col("__r") <= keep)).drop("__n", "__r")


def valid_at(df: DataFrame, moment) -> DataFrame:
    """W10."""
    return df.where((F.col("valid_from") <= moment) & (F.col("valid_until").isNull() | (F.col("valid_until") > moment)))


def fixed_interval(df: DataFrame, key: str, at: str, step: float) -> DataFrame:
    """W12. For each step of each group the nearest time that lies at most half a step off, the earlier of two."""
    near = df.withColumn("step", F.floor(F.col(at) / step + 0.5))
    return near.groupBy(key, "step").agg(F.min(F.struct(F.abs(F.col(at) - F.col("step") * step), F.col(at)))[at].alias(at))


def version_history(df: DataFrame, key: str, order: list) -> DataFrame:
    """W13."""
    return df.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def retry_state(events: DataFrame, key: str, order: list, failed, base: float = 5.0, longest: float = 300.0, most: int = 3) -> DataFrame:
    """X02, in batch. key, attempts, status (done, pending, dead), backoff seconds after the last failure."""
    rows = events.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("__failed", failed)
    state = rows.groupBy(key).agg(F.count_if("__failed").alias("attempts"), F.max_by("__failed", "__n").alias("last_failed"))
    status = F.when(F.col("attempts") >= most, "dead").when(F.col("last_failed"), "pending").otherwise("done")
    backoff = F.when(status == "pending", F.least(F.lit(longest), base * F.pow(F.lit(2.0), F.col("attempts") - 1)))
    return state.select(key, "attempts", status.alias("status"), backoff.alias("backoff"))


def rate_limit(events: DataFrame, key: str, at: str, order: str, most: int, seconds: float) -> DataFrame:
    """X04, in batch. order, accepted: denied if `most` accepted events lie in the trailing seconds. A fold over each key's events."""
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(order).alias("o")))).alias("e"))
    start = F.expr("cast(struct(array() as recent, array() as done) as struct<recent:array<double>,done:array<struct<o:bigint,ok:boolean>>>)")

    def step(acc, e):
        recent = F.filter(acc["recent"], lambda t: t > e["t"] - seconds)
        ok = F.size(recent) < most
        return F.struct(F.when(ok, F.concat(recent, F.array(e["t"]))).otherwise(recent).alias("recent"), F.concat(acc["done"], F.array(F.struct(e["o"].alias("o"), ok.alias("ok")))).alias("done"))

    return rows.select(key, F.explode(F.aggregate("e", start, step)["done"]).alias("x")).select(key, F.col("x.o").alias(order), F.col("x.ok").alias("accepted"))

"""Tables kept in folders by bucket: by spans of time (S12) or by a hash of the key (S08). What isn't touched isn't read or written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPOCH = "1970-01-01"


def day(moment: str | Column) -> Column:
    """Days since 1970 of a date or time."""
    return F.datediff((F.lit(moment) if isinstance(moment, str) else moment).cast("date"), F.lit(EPOCH).cast("date"))


def time_bucket(at: Column, days: int = 30) -> Column:
    return F.floor(day(at) / days).cast("int")


def write_buckets(df: DataFrame, path: str) -> None:
    """df has a column bucket. Buckets that it has rows of are replaced, others stay as they are; a bucket is written by one task, or by
    several where adaptive execution splits it."""
    rows = df.hint("rebalance", "bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_by_time(df: DataFrame, path: str, at: str, days: int = 30) -> None:
    """S12. Rows by the `days`-day span of `at`; spans that df has rows of are replaced. Rows without a time go to a bucket of their own,
    which is never dropped."""
    write_buckets(df.withColumn("bucket", time_bucket(F.col(f"`{at}`"), days)), path)


def read_between(spark: SparkSession, path: str, at: str, begin: str, end: str, days: int = 30) -> DataFrame:
    """S12. Rows with begin <= at < end; only folders of spans between the two are listed for reading."""
    rows = spark.read.parquet(path)
    spans = F.col("bucket").between(time_bucket(F.lit(begin), days), time_bucket(F.lit(end), days))
    moment = F.col(f"`{at}`")
    return rows.where(spans & (moment >= F.lit(begin).cast(rows.schema[at].dataType)) & (moment < F.lit(end).cast(rows.schema[at].dataType)))


def folders(spark: SparkSession, path: str) -> dict[int, object]:
    """Folders by bucket, of which there are as many as spans; the one of rows without a time isn't among them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = {s.getPath().getName(): s.getPath() for s in files.listStatus(root) if s.isDirectory()}
    return {int(n.removeprefix("bucket=")): p for n, p in names.items() if n.removeprefix("bucket=").lstrip("-").isdigit()}


def drop_old(spark: SparkSession, path: str, as_of: str, keep_months: int = 6, days: int = 30) -> list[int]:
    """S12. Remove the folders of spans that end by keep_months x 30 days before as_of; no row is read. The buckets removed, in order."""
    from datetime import date

    cutoff = (date.fromisoformat(as_of) - date.fromisoformat(EPOCH)).days - keep_months * 30
    old = {b: p for b, p in folders(spark, path).items() if (b + 1) * days <= cutoff}
    for p in old.values():
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return sorted(old)


def upsert(path: str, updates: DataFrame, key: list[str], order: str, needed: str, materialize: Callable[[DataFrame], DataFrame], buckets: int = 64) -> None:
    """S08. Fold updates (the columns of the table) into the table at `path`, which the first call creates: of each key the row of greatest
    `order` stays. Updates without a key, or null in `needed`, are skipped; a null order is the smallest. Of rows of one key and order any
    one stays unless they are equal, so an order should tell a key's updates apart. Applying updates again changes nothing.

    A row's bucket is a hash of its key. Only buckets with updates are read and replaced. Their new content is written aside by
    `materialize` first, as a bucket can't be read and replaced in one job; should the replacing fail midway, the call can be made again
    with that table as updates."""
    spark = updates.sparkSession
    columns = [F.col(f"`{k}`") for k in key]
    rank = F.row_number().over(Window.partitionBy("bucket", *columns).orderBy(F.col(f"`{order}`").desc_nulls_last()))
    last = lambda df: df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    given = updates.where(F.col(f"`{needed}`").isNotNull())
    for k in columns:
        given = given.where(k.isNotNull())
    now = materialize(last(given.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))))
    touched = [r[0] for r in now.select("bucket").distinct().collect()]  # at most `buckets`
    if not touched:
        return
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    if there and set(folders(spark, path)) & set(touched):
        before = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        now = materialize(last(now.unionByName(before)))
    write_buckets(now, path)

"""Exact nearest neighbours through an inverted file (J03 beyond a broadcast), and exact pairs within an angle through pivots.

Base vectors are put down in lists by their nearest of a few centroids, which a bounded sample gives; lists of many vectors fall into
blocks. A query looks into its nearest lists first. The k-th best score it has found there bounds what can still matter: by the
triangle inequality on angles, a vector at angle r from its centroid is at least |d - r| from a query at angle d, so only lists whose
range of r comes within the bound are looked into then. What is skipped can't be among the k best: the result is exact, whatever
the centroids are; they only decide how much is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .resolve import elect_leaders

Materialize = Callable[[DataFrame], DataFrame]
SLACK = 1e-6  # of angles: more than doubles lose


def unit_rows(df: DataFrame, dim: int) -> DataFrame:
    """Rows whose v has `dim` finite components, not all zero; v of length 1 in double precision. Others have no cosine."""
    v = F.col("v").cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sound = df.withColumn("v", v).where(F.size("v") == dim).withColumn("n", norm)
    return sound.where((F.col("n") > 0) & (F.col("n") < float("inf"))).withColumn("v", F.transform("v", lambda x: x / F.col("n"))).drop("n")


def fit_centroids(base: DataFrame, lists: int, sample: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of at most `sample` rows, drawn by a hash of their vectors."""
    rows = base.select("v").orderBy(F.xxhash64("v")).limit(sample).collect()
    x = np.array([r[0] for r in rows])
    if not len(x):
        return np.zeros((0, 1))
    c = np.unique(x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def with_angles(df: DataFrame, centroids: np.ndarray, probes: int | None) -> DataFrame:
    """The rows with `list` and `angle` of their nearest centroid or, with probes, of all centroids and `near`, whether it is among so many nearest."""
    schema = df.select("*", F.lit(0).alias("list"), F.lit(0.0).alias("angle"), *([] if probes is None else [F.lit(True).alias("near")])).schema
    at = df.columns.index("v")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            angles = np.arccos(np.clip(v @ centroids.T, -1, 1))
            if probes is None:
                best = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(angles[np.arange(len(best)), best])], schema.names)
                continue
            k = centroids.shape[0]
            near = angles.argsort(axis=1, kind="stable").argsort(axis=1) < probes
            rows = np.repeat(np.arange(batch.num_rows), k)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(np.tile(np.arange(k, dtype=np.int32), batch.num_rows)), pa.array(angles.ravel()), pa.array(near.ravel())], schema.names)

    return df.mapInArrow(measure, schema)


def block_scores(asked: DataFrame, held: DataFrame, keys: list[str], k: int) -> DataFrame:
    """asked (keys, query_id, v, floor) and held (keys, base_id, v) -> query_id, base_id, score: for each block and query the k best scores of
    `floor` at least, a matrix product a block."""
    types = f"query_id {dict(asked.dtypes)['query_id']}, base_id {dict(held.dtypes)['base_id']}, score double"

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"query_id": [], "base_id": [], "score": []})
        b = b.sort_values("base_id", kind="stable")
        x, ids, asked_ids, floor = np.array(b["v"].tolist()), b["base_id"].to_numpy(), q["query_id"].to_numpy(), q["floor"].to_numpy()
        v, out = np.array(q["v"].tolist()), []
        for i in range(0, len(v), 256):
            scores = np.round(v[i : i + 256] @ x.T, 12)
            for j, own in enumerate(scores):
                good = np.flatnonzero(own >= floor[i + j])
                top = good[np.argsort(-own[good], kind="stable")[:k]]
                out.append(pd.DataFrame({"query_id": np.repeat(asked_ids[i + j], len(top)), "base_id": ids[top], "score": own[top]}))
        return pd.concat(out)

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(best, types)


def knn_index_join(queries: DataFrame, base: DataFrame, k: int, least: float, materialize: Materialize, dim: int, on: str | None = None, lists: int = 64, probes: int = 4, sample: int = 10_000, block: int = 4096, most: int = 16_384, looked: list[int] | None = None) -> DataFrame:
    """J03. query_id, base_id, score, rank: the k nearest base vectors of each query by cosine, of `least` at least (ties: smaller base_id),
    exactly; `on`: a column that must be equal and not null. queries: (query_id, v, ...), base: (base_id, v, ...).

    `lists` centroids come from at most `sample` rows; a list's vectors meet queries in blocks of about `block`, and at most about `most`
    queries at a time. Vectors that are null, zero, not finite or not `dim` long match nothing. looked: gets how many pairs of a query
    and a vector were compared in the nearest lists and beyond, and how many there are.
    """
    group = [on] if on else []
    sized = unit_rows(base.select("base_id", "v", *group).dropna(subset=group) if on else base.select("base_id", "v"), dim)
    centroids = fit_centroids(sized, lists, sample)
    asked = unit_rows(queries.select("query_id", "v", *group), dim)
    if not len(centroids):
        return asked.select("query_id", F.lit(None).cast(base.schema["base_id"].dataType).alias("base_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    held = materialize(with_angles(sized, centroids, None))
    stats = held.groupBy(*group, "list").agg(F.count("*").alias("n"), F.min("angle").alias("inner"), F.max("angle").alias("outer"))
    held = materialize(held.join(stats.select(*group, "list", "n"), [*group, "list"]).withColumn("block", F.pmod(F.xxhash64("base_id"), F.ceil(F.col("n") / block)).cast("int")).select(*group, "list", "block", "base_id", "v"))
    measured = materialize(with_angles(asked, centroids, probes).join(stats, [*group, "list"]))  # a query and a list: lists are few

    def score(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
        crowd = rows.groupBy(*group, "list").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
        dealt = dealt.join(crowd, [*group, "list"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        copies = held.join(crowd, [*group, "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = [*group, "list", "block", "part"]
        return block_scores(dealt.select(*keys, "query_id", "v", "floor"), copies.select(*keys, "base_id", "v"), keys, k)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id"))
    near = measured.where("near").withColumn("floor", F.lit(least))
    first = materialize(score(near).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
    bounds = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("kth"))
    far = measured.where("NOT near").join(bounds, "query_id", "left")
    far = far.withColumn("floor", F.when(F.col("found") >= k, F.greatest("kth", F.lit(least))).otherwise(F.lit(least)))
    reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("floor")))) + SLACK
    far = materialize(far.where((F.col("angle") - F.col("outer") <= reach) & (F.col("inner") - F.col("angle") <= reach)))
    if looked is not None:
        total = lambda rows: int(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        looked += [total(near), total(far), total(measured)]
    found = first.unionByName(score(far))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "base_id", "score", "rank")


def block_pairs(asked: DataFrame, held: DataFrame, keys: list[str], over: float) -> DataFrame:
    """asked and held (keys, id, v) -> a, b (a < b) of the pairs of a block whose product is over `over`."""
    kind = dict(held.dtypes)["id"]

    def near(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []})
        x, ids, v, asked_ids = np.array(b["v"].tolist()), b["id"].to_numpy(), np.array(q["v"].tolist()), q["id"].to_numpy()
        pairs = []
        for i in range(0, len(v), 256):
            r, c = np.nonzero(v[i : i + 256] @ x.T > over)
            left, right = asked_ids[i : i + 256][r], ids[c]
            pairs.append(pd.DataFrame({"a": left[left < right], "b": right[left < right]}))
        return pd.concat(pairs)

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(near, f"a {kind}, b {kind}")


def correlated_pairs(vectors: DataFrame, over: float, materialize: Materialize, dim: int, pivots: int = 64, sample: int = 10_000, block: int = 4096, most: int = 16_384, looked: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """W11. vectors (id, label, v) -> copies (id, of: the smallest id of its label with an equal vector) and a, b (a < b) of the `of`s of one label
    whose correlation is over `over`: all of them.

    Every vector lies in a ring around its nearest pivot; there are no more pivots than blocks in a label, and a pivot has
    as many rings as its vectors fill blocks. Two vectors of a small angle differ by no more than that in their angles to any pivot,
    so a vector meets only the rings that come that near, in blocks. Vectors that are null, constant, not finite or not `dim` long have
    no correlation and stand for themselves. looked: gets how many pairs were compared and how many there are."""
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    own = vectors.select("id", "label", F.col("v").cast("array<double>").alias("v"))
    own = own.withColumn("v", F.when(F.size("v") == dim, F.transform("v", lambda x: F.round(x - mean, 12))))
    first = own.groupBy("label", "v").agg(F.min("id").alias("of")).where("v IS NOT NULL")
    copies = own.join(first, ["label", "v"], "left").select("id", F.coalesce("of", "id").alias("of"))
    rows = materialize(unit_rows(first.select(F.col("of").alias("id"), "label", "v").dropna(subset=["label"]), dim))
    largest = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    centres = fit_centroids(rows, min(pivots, -(-largest // block)), sample)
    if not len(centres):
        return copies, rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    reach, keys = math.acos(max(-1.0, min(1.0, over))) + SLACK, ["label", "list", "ring"]
    held = materialize(with_angles(rows, centres, None))
    whole = held.groupBy("label", "list").agg(F.ceil(F.count("*") / block).alias("rings"), F.min("angle").alias("begin"), (F.max("angle") - F.min("angle") + SLACK).alias("width"))
    held = held.join(whole, ["label", "list"]).withColumn("ring", F.floor((F.col("angle") - F.col("begin")) / F.col("width") * F.col("rings")).cast("int")).drop("rings", "begin", "width")
    stats = held.groupBy(*keys).agg(F.count("*").alias("n"), F.min("angle").alias("inner"), F.max("angle").alias("outer"))
    met = with_angles(rows, centres, 0).drop("near").join(stats, ["label", "list"]).where((F.col("angle") - F.col("outer") <= reach) & (F.col("inner") - F.col("angle") <= reach))
    met = materialize(met.select(*keys, "n", "id", "v"))
    if looked is not None:
        looked += [int(met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), int(rows.groupBy("label").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0])]
    crowd = met.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = met.join(crowd, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    copied = held.join(stats.select(*keys, "n"), keys).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block)).cast("int")).join(crowd, keys)
    copied = copied.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = [*keys, "block", "part"]
    return copies, block_pairs(dealt.select(*keys, "id", "v"), copied.select(*keys, "id", "v"), keys, over)


def greedy_unique(vectors: DataFrame, over: float, materialize: Materialize, dim: int, **options) -> DataFrame:
    """W11. id, leader: in the order of id a vector is kept, as its own leader, unless it correlates by over `over` with one of its label that is
    kept before it; else its leader is the first such one. Copies follow the first of them."""
    copies, pairs = correlated_pairs(vectors, over, materialize, dim, **options)
    copies = materialize(copies)
    led = elect_leaders(copies.where("id = of").select("id"), pairs, materialize)
    return copies.join(led.withColumnRenamed("id", "of"), "of").select("id", "leader")

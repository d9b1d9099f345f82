"""Operator 11: exact k-means over whole numbers by Shallot search.

A vector becomes the whole numbers floor(scale * x). Every vector remembers its centroid, the second nearest one, an upper bound of
its distance to the first and a lower bound of that to all others. A round is one pass without a shuffle:

* Centroids move by known distances, which loosens the bounds. Where the upper bound stays below the lower one, or below half
  the way from the centroid to the nearest other centroid, nothing is computed.
* Else both remembered centroids are measured, and the scan starts at the closer one, through its neighbours from near to far. A
  centroid that may be nearest or second nearest lies in a ball around the start whose radius is the vector's distance to the
  start plus that to the second nearest so far: the ball shrinks with each better one, and the scan ends at the first
  neighbour outside.
* Bounds are floating point with a margin and only ever spare work; what survives them is compared in 64-bit integers, ties by number.

The vectors are written once, bucketed by row. A round joins them with the narrow table of their bounds, bucketed alike, and
writes the new bounds along with what it adds to and takes from the sums of the centroids. The driver holds k centroids.

Nulls and odd input: a vector that is null, hasn't `dim` components or has a null, infinite or NaN one is left out. Null and
repeated vec_ids are rows of their own; a null vec_id is never drawn as a centroid unless too few others are left. With fewer
than k vectors there are fewer centroids; an empty table gives no rows. Equal centroids are told apart by number. Extra columns
are ignored. Components beyond 2^27 after scaling, whose squares may not add up within 64 bits, are an error.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, remove, shared_dir, shuffle_partitions

LARGEST = 1 << 27
MARGIN = 1e-9  # of bounds, relative; far above what doubles lose in adding them up
BOUNDS = "row long, first int, second int, upper double, lower double, sums array<bigint>"


def integer_vectors(table: DataFrame, dim: int = 64, scale: float = 1024.0) -> DataFrame:
    """row, vec_id, v array<int> of the vectors that count."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    own = own.where(F.coalesce((F.size("x") == dim) & F.forall("x", finite), F.lit(False)))
    far = F.exists("x", lambda x: F.abs(x) > LARGEST / scale)
    v = F.when(far, F.raise_error(F.lit(f"a component is over {LARGEST / scale:g}"))).otherwise(F.transform("x", lambda x: F.floor(x * scale).cast("int")))
    return own.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.cast("array<int>").alias("v"))


def write_bucketed(df: DataFrame, name: str) -> DataFrame:
    """The rows in a table of the shared folder, in as many buckets by `row` as shuffles have partitions; drop_bucketed() removes it."""
    spark = df.sparkSession
    path, table = shared_dir(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), "row").sortBy("row").option("path", path).option("compression", "zstd").saveAsTable(table, format="parquet")
    out = spark.table(table)
    out._bucketed = table, path
    release(spark)
    return out


def drop_bucketed(df: DataFrame) -> None:
    table, path = df._bucketed
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    remove(df.sparkSession, path)


def squares(v: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to its centroid."""
    d = v - centroids[which]
    return np.einsum("ij,ij->i", d, d)


class Space:
    """The centroids of a round: their neighbours from near to far, half the way to the nearest, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids, k = centroids, len(centroids)
        gap = np.array([[-1.0 if i == j else math.sqrt(int(((a - b) ** 2).sum())) for j, b in enumerate(centroids)] for i, a in enumerate(centroids)]).reshape(k, k)
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.order, axis=1)
        self.half = self.gap[:, 1] / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(float))
        self.moved = moved * (1 + MARGIN)
        self.others = np.array([np.delete(self.moved, i).max(initial=0.0) for i in range(k)])

    def nearest(self, v: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """The nearest and second nearest centroid of each vector and their squared distances, given a guess of both; and how many
        distances that took."""
        d1, d2 = squares(v, self.centroids, first), squares(v, self.centroids, second)
        turn = (d2 < d1) | ((d2 == d1) & (second < first))
        first, second, d1, d2 = np.where(turn, second, first), np.where(turn, first, second), np.where(turn, d2, d1), np.where(turn, d1, d2)
        start, known, own = first.copy(), second.copy(), np.sqrt(d1.astype(float))
        live, took = np.arange(len(v)), 2 * len(v)
        for t in range(1, len(self.centroids)):
            ball = (own[live] + np.sqrt(d2[live].astype(float))) * (1 + MARGIN)
            live = live[self.gap[start[live], t] <= ball]
            if not len(live):
                break
            c = self.order[start[live], t]
            new = c != known[live]
            at, c = live[new], c[new]
            d = squares(v[at], self.centroids, c)
            took += len(at)
            best = (d < d1[at]) | ((d == d1[at]) & (c < first[at]))
            after = ~best & ((d < d2[at]) | ((d == d2[at]) & (c < second[at])))
            x, y = at[best], at[after]
            second[x], d2[x] = first[x], d1[x]
            first[x], d1[x] = c[best], d[best]
            second[y], d2[y] = c[after], d[after]
        return first, second, d1, d2, took


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(len(column), dim).astype(np.int64)


def assign(points: DataFrame, bounds: DataFrame | None, space: Space, dim: int) -> DataFrame:
    """BOUNDS of every vector, and for each centroid that gains or loses vectors a row without `row`: first (the centroid) and sums, of the
    components that come and go and, at last, of the vectors. A last such row with first -1 has how many distances the task took."""
    k, begun = len(space.centroids), bounds is not None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, took, types = np.zeros((k, dim + 1), np.int64), 0, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
        rows = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["row", "first", "second", "upper", "lower", "sums"])
        for batch in batches:
            n, v = batch.num_rows, matrix(batch.column(1), dim)
            if not begun:
                was, first, second = np.full(n, -1), np.zeros(n, np.int64), np.full(n, min(1, k - 1))
                upper, lower = np.full(n, np.inf), np.zeros(n)
            else:
                was, second, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
                first, second = was.astype(np.int64), second.astype(np.int64)
                upper, lower = upper + space.moved[first], lower - space.others[first]
            safe = lambda at: upper[at] * (1 + MARGIN) < np.maximum(lower[at], space.half[first[at]]) * (1 - MARGIN)
            at = np.flatnonzero(~safe(np.arange(n)))
            if begun:
                upper[at] = np.sqrt(squares(v[at], space.centroids, first[at]).astype(float)) * (1 + MARGIN)
                took += len(at)
                at = at[~safe(at)]
            first[at], second[at], d1, d2, more = space.nearest(v[at], first[at], second[at])
            took += more
            upper[at] = np.sqrt(d1.astype(float)) * (1 + MARGIN)
            lower[at] = np.sqrt(d2.astype(float)) * (1 - MARGIN) if k > 1 else np.inf
            yield rows(batch.column(0), first, second, upper, lower, pa.nulls(n, types[-1]))
            change = np.flatnonzero(first != was)
            counted = np.hstack((v[change], np.ones((len(change), 1), np.int64)))
            left = was[change] >= 0
            np.add.at(sums, first[change], counted)
            np.subtract.at(sums, was[change][left], counted[left])
        touched = np.flatnonzero(sums.any(axis=1)).tolist()
        blank = [None] * (len(touched) + 1)
        yield rows(blank, [*touched, -1], blank, blank, blank, [*sums[touched].tolist(), [took]])

    given = points.select("row", "v") if bounds is None else points.join(bounds.where("row IS NOT NULL"), "row").select("row", "v", "first", "second", "upper", "lower")
    return given.mapInArrow(step, BOUNDS)


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of `seed:vec_id`, in that order; of equal vec_ids the smaller vector first."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.select(drawn.alias("drawn"), "v").orderBy(F.asc_nulls_last("drawn"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, seed: int = 3, took: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that counts, after `rounds` rounds
    of assigning all vectors and moving the centroids to the floor of their means. took: gets the distances computed in each pass."""
    spark = table.sparkSession
    points = write_bucketed(integer_vectors(table, dim, scale).repartition(shuffle_partitions(spark), "row"), "points")
    centroids = first_centroids(points, k, seed)
    k = len(centroids)
    if not k:
        drop_bucketed(points)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sums, bounds, space = np.zeros((k, dim + 1), object), None, Space(centroids)
    for number in range(rounds + 1):
        now = write_bucketed(assign(points, bounds, space, dim), "bounds")
        if bounds is not None:
            drop_bucketed(bounds)
        bounds = now
        changes = now.where("row IS NULL").groupBy("first").agg(*(F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(dim + 1)))
        for c, *more in changes.collect():  # of at most k rows a task Spark makes k
            if c >= 0:
                sums[c] += [int(x) for x in more]
            elif took is not None:
                took.append(int(more[0]))
        if number == rounds:
            break
        new = np.array([[x // n for x in own] if n else old.tolist() for (*own, n), old in zip(sums, centroids)], np.int64)
        space, centroids = Space(new, centroids), new

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(2).to_numpy().astype(np.int64)
            d = squares(matrix(batch.column(1), dim), centroids, which)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], ["vec_id", "cluster", "distance"])

    ended = points.join(bounds.where("row IS NOT NULL"), "row").select("vec_id", "v", F.col("first").alias("cluster"))
    found = materialize(ended.mapInArrow(measure, "vec_id long, cluster int, distance long"), "clusters")
    drop_bucketed(points)
    drop_bucketed(bounds)
    shas = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows at most, as the digests
    total = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = spark.createDataFrame(shas, "cluster int, centroid_sha256 string").join(inertia, "cluster").join(F.broadcast(total))
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_shallot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 8 clusters by ten rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB SQL: every vector with every centroid, round after round."""
    squared = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    assigned = lambda c: f"SELECT v.i, v.vec_id, v.e, min({{'d': {squared}::BIGINT, 'c': c.c}}) AS m FROM v, {c} c GROUP BY ALL"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {k}))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS MATERIALIZED ({assigned(f'c{r}')})",
            f"s{r} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{r}) GROUP BY c, j)",
            f"m{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM s{r} GROUP BY c)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)",
        ]
    steps.append(f"a AS MATERIALIZED ({assigned(f'c{rounds}')})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c ON c.c = m.c"""

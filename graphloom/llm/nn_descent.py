"""Operator 2: near-duplicate embeddings by NN-descent on a neighbour graph.

Vectors of one label are linked if their cosine, in double precision, is at least `threshold`.

* Copies: equal vectors of a label are one node with a weight, so they don't fill each other's lists.
* Start: each of several random projections sorts all vectors by their signs; vectors a few places apart in that order are
  first neighbours. A sort has no hot buckets, and a vector gets at most a fixed number of neighbours from it.
* Descent: round by round, every vector's neighbours (both ways) are compared with each other, and each vector keeps its
  `k` best. Edges below cos(2 theta), theta being the threshold's angle, are dropped: two linked vectors' common neighbour
  within theta of one is within 2 theta of the other. It ends when a round finds nothing new.
* Saturated lists: a vector whose k best are all above the threshold gets a list `enlarged` times as long. It may have still more
  links, so in the end lists are the connected components of threshold edges: within one, links are counted exactly. A component of over `block`
  vectors uses angles to its mean: two vectors whose angles add up to less than theta are linked without a comparison, so
  only the outer vectors are compared, in blocks of `block` by `block`.
* Audit: the links of a bounded sample of vectors are counted by brute force. While the mean share that was found of a vector's
  links is below `recall`, the number of projections and the length of lists are doubled and the rounds go on; with over `most`
  projections the operator gives up with an error.

Nulls and odd input: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label,
have no links and are their own component. Vectors of different lengths aren't linked. Repeated rows are vectors of their own,
linked like any others. A null vec_id is compared like others; a component's id is the smallest id that isn't null. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, shuffle_partitions
from .graph import components

BITS = 24  # signs in a projection's sort key
EDGE = "a long, b long, cosine double"


def vectors_of(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].reshape(len(column), -1)


def pairs_above(ids: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cosine = np.triu(v @ v.T, 1)
    i, j = np.nonzero(cosine >= least)
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), cosine[i, j]


def edges_batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, c = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
    return pa.RecordBatch.from_pydict({"a": a.astype(np.int64), "b": b.astype(np.int64), "cosine": c.astype(np.float64)})


def unit_vectors(table: DataFrame) -> DataFrame:
    """node, vec_id, group (label and length), v (of length 1) of the vectors that may have links; the others have a null group."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    numbered = table.select(F.monotonically_increasing_id().alias("node"), F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).withColumn("norm", norm)
    sound = F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")) & ~F.isnan("norm") & F.col("label").isNotNull(), F.lit(False))
    group = F.when(sound, F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string")))
    return numbered.select("node", "vec_id", group.alias("group"), F.when(sound, F.transform("v", lambda x: x / F.col("norm"))).alias("v"))


def first_edges(nodes: DataFrame, projections: range, near: int, least: float) -> DataFrame:
    """Edges between vectors that are at most `near` places apart in the order of some projection."""
    count = len(projections)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(BITS, dtype=np.int64)
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            keys = np.zeros((batch.num_rows, count), np.int64)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                v = vectors_of(batch.column("v").take(pa.array(rows)))
                for p in projections:
                    if (d, p) not in planes:
                        planes[d, p] = np.random.default_rng(p).standard_normal((d, BITS))
                    keys[rows, p - projections.start] = ((v @ planes[d, p]) > 0) @ weights
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], ["node", "group", "v", "keys"])

    signed = nodes.select("node", "group", "v").mapInArrow(sign, "node long, group string, v array<double>, keys array<bigint>")
    placed = signed.select("node", "group", "v", F.posexplode("keys").alias("projection", "key"))
    placed = placed.repartitionByRange(shuffle_partitions(nodes.sparkSession), "projection", "group", "key", "node").sortWithinPartitions("projection", "group", "key", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks().to_batches()[0]
            run = np.array([f"{p}/{g}" for p, g in zip(table.column("projection").to_pylist(), table.column("group").to_pylist())])
            ids, parts = table.column("node").to_numpy(), []
            edges = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True])))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                v, own = vectors_of(table.column("v").slice(s, e - s)), ids[s:e]
                for step in range(1, min(near, e - s - 1) + 1):
                    cosine = np.einsum("ij,ij->i", v[:-step], v[step:])
                    ok = cosine >= least
                    x, y = own[:-step][ok], own[step:][ok]
                    parts.append((np.minimum(x, y), np.maximum(x, y), cosine[ok]))
            tail = table.slice(max(0, table.num_rows - near))
            yield edges_batch(parts)

    return placed.mapInArrow(link, EDGE)


def descend(nodes: DataFrame, edges: DataFrame, k: int, least: float, threshold: float, enlarged: int, rounds: int) -> DataFrame:
    """Rounds of comparing neighbours of a common neighbour, until none finds an edge."""
    edges = materialize(edges.dropDuplicates(["a", "b"]), "edges")
    size = edges.count()
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("near")
            ids, v, at = lists.values.field("id").to_numpy(), lists.values.field("v"), lists.offsets.to_numpy()
            yield edges_batch([pairs_above(ids[s:e], vectors_of(v.slice(s, e - s)), least) for s, e in zip(at[:-1].tolist(), at[1:].tolist()) if e - s > 1])

    for _ in range(rounds):
        both = edges.union(edges.select("b", "a", "cosine"))
        ranked = both.withColumn("rank", F.row_number().over(best))
        lists = ranked.where((F.col("rank") <= k) | (F.col("rank") <= k * enlarged) & (F.col("cosine") >= threshold))
        back = lists.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("cosine"), "a"))).where(F.col("rank") <= k * enlarged)
        around = lists.select("a", "b").union(back.select("b", "a")).distinct()
        near = around.join(nodes.select(F.col("node").alias("b"), "v"), "b").groupBy("a").agg(F.collect_list(F.struct(F.col("b").alias("id"), "v")).alias("near"))
        new = materialize(edges.union(near.mapInArrow(compare, EDGE)).dropDuplicates(["a", "b"]), "edges")
        discard(edges)
        edges, last, size = new, size, new.count()
        if size == last:
            break
    return edges


def count_links(nodes: DataFrame, roots: DataFrame, threshold: float, block: int) -> DataFrame:
    """node, root, n_links: the exact number of links within the component, of a node of `weight` equal vectors."""
    theta = math.acos(threshold) - 1e-6
    members = nodes.join(roots, "node").select("node", "root", "v", "weight")
    sizes = members.groupBy("root").agg(F.count("*").alias("count"), F.sum("weight").alias("all"))
    large = sizes.where(F.col("count") > block)
    mean = members.join(large, "root").select("root", F.posexplode("v").alias("i", "x")).groupBy("root", "i").agg(F.sum("x").alias("x"))
    mean = mean.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")).select("root", F.col("m.x").alias("m"))
    dot = F.aggregate(F.zip_with("v", "m", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    angled = materialize(members.join(sizes, "root").join(mean, "root", "left").withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm)))).drop("m"), "members")
    widest = angled.groupBy("root").agg(F.max("angle").alias("widest"))
    split = angled.join(widest, "root").withColumn("outer", F.col("angle").isNull() | (F.col("angle") > theta - F.col("widest")))
    outer = split.where("outer")
    n_outer = outer.groupBy("root").agg(F.count("*").alias("n_outer"), F.sum("weight").alias("all_outer"))
    chunked = outer.join(n_outer, "root").withColumn("chunks", F.ceil(F.col("n_outer") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # a vector meets each chunk of its component once: as (own, other) its links are counted for it
    dealt = chunked.select("root", "node", "v", "weight", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    rows = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "v", "weight")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            at, inner = lists.offsets.to_numpy(), lists.values
            ids, own, weight, v = inner.field("node").to_numpy(), inner.field("own").to_numpy(), inner.field("weight").to_numpy(), inner.field("v")
            out_ids, out_n = [], []
            for k, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                m = vectors_of(v.slice(s, e - s))
                linked = (m @ m.T) >= threshold
                np.fill_diagonal(linked, False)
                if batch.column("i")[k].as_py() != batch.column("j")[k].as_py():
                    linked &= own[s:e][:, None] != own[s:e][None, :]
                out_ids.append(ids[s:e])
                out_n.append(linked @ weight[s:e])
            yield pa.RecordBatch.from_pydict({"node": np.concatenate(out_ids), "n": np.concatenate(out_n).astype(np.int64)})

    blocks = rows.groupBy("root", "i", "j").agg(F.collect_list(F.struct("node", F.col("own").cast("long").alias("own"), "weight", "v")).alias("rows"))
    compared = blocks.select("i", "j", "rows").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    sums = split.join(n_outer, "root", "left").join(compared, "node", "left")
    inner = F.when(F.col("outer"), F.col("all") - F.col("all_outer") + F.coalesce("n", F.lit(0)) + F.col("weight") - 1).otherwise(F.col("all") - 1)
    return sums.select("node", "root", inner.cast("long").alias("n_links"))


def audit(nodes: DataFrame, found: DataFrame, threshold: float, sample: int) -> float:
    """Mean share that was found of the links of a sample of nodes (`sample` at most); they go to every task."""
    rows = nodes.select("node", "group", "v", "weight").orderBy(F.xxhash64("node")).limit(sample).collect()
    if not rows:
        return 1.0
    ids = np.array([r[0] for r in rows])
    by_group: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        by_group.setdefault(r[1], []).append(k)
    held = {g: (np.array(ks), np.array([rows[k][2] for k in ks])) for g, ks in by_group.items()}

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, groups = np.zeros(len(ids), np.int64), np.array(batch.column(1).to_pylist())
            for g, (ks, v) in held.items():
                at = np.flatnonzero(groups == g)
                if len(at):
                    linked = (v @ vectors_of(batch.column(2).take(pa.array(at))).T) >= threshold
                    n[ks] += (linked & (ids[ks][:, None] != batch.column(0).to_numpy()[at][None, :])) @ batch.column(3).to_numpy()[at]
            yield pa.RecordBatch.from_pydict({"node": ids, "n": n})

    true = nodes.select("node", "group", "v", "weight").mapInArrow(brute, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    others = F.greatest(F.coalesce("n_links", F.lit(0)) - F.col("weight") + 1, F.lit(0))  # but for the node's own copies
    got = true.where("n > 0").join(nodes.select("node", "weight"), "node").join(found, "node", "left").agg(F.avg(F.least(F.lit(1.0), others / F.col("n")))).first()[0]
    return 1.0 if got is None else got


def near_duplicates(table: DataFrame, threshold: float = 0.93, k: int = 8, near: int = 4, projections: int = 8, rounds: int = 6, block: int = 1024, recall: float = 0.97, sample: int = 512, enlarged: int = 4, most: int = 512) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, label, embedding)."""
    nodes = materialize(unit_vectors(table).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")), "vectors")
    copies = nodes.where("group IS NOT NULL").groupBy("group", "h1", "h2").agg(F.min("node").alias("node"), F.count("*").alias("weight"))
    sound = materialize(copies.join(nodes.select("node", "v"), "node").select("node", "group", "h1", "h2", "v", "weight"), "nodes")
    least = math.cos(min(math.pi, 2 * math.acos(threshold)))
    edges, done = None, 0
    while True:
        first = first_edges(sound, range(done, projections), near, least)
        edges = descend(sound, first if edges is None else edges.union(first), k, least, threshold, enlarged, rounds)
        roots = materialize(components(edges.where(F.col("cosine") >= threshold).select("a", "b")), "roots")
        links = materialize(count_links(sound, roots, threshold, block), "links")
        got = audit(sound, links, threshold, sample)
        if got >= recall:
            break
        if projections > most:
            raise RuntimeError(f"{projections} projections find {got:.3f} of the links, less than {recall}")
        done, projections, k = projections, 2 * projections, 2 * k
    links = links.select(F.col("node").alias("of"), F.col("root").alias("linked"), "n_links")
    whole = sound.join(links, F.col("node") == F.col("of"), "left").select("group", "h1", "h2", F.coalesce("linked", "node").alias("root"), F.coalesce("n_links", F.col("weight") - 1).alias("n_links"))
    all_nodes = nodes.select("node", "vec_id", "group", "h1", "h2").join(whole, ["group", "h1", "h2"], "left").withColumn("root", F.coalesce("root", "node"))
    names = all_nodes.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return all_nodes.join(names, "root").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked within their label at a cosine of 0.93."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

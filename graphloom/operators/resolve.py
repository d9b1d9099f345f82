"""Entity resolution and similarity joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from ..functions.text import names_align, normalize_name


KNN_ROWS = (1024, 8192)  # of a block of queries and of one of base rows


def exact_name_join(queries: DataFrame, base: DataFrame, max_broadcast_rows: int = 200_000) -> DataFrame:
    """J01. query_id, base_id with equal names, without regard to case. Base rows are dealt out by id first and up to max_broadcast_rows
    queries broadcast: a row may meet many queries, so that what a task reads says little of what it puts out."""
    deals = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select(F.col("id").alias("query_id"), F.lower("name").alias("k"))
    asked = F.broadcast(asked) if asked.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows else asked
    held = base.select(F.col("id").alias("base_id"), F.lower("name").alias("k")).repartition(deals, "base_id")
    return asked.join(held, "k").select("query_id", "base_id")


def alias_join(queries: DataFrame, base: DataFrame) -> DataFrame:
    """J02. query_id, base_id with equal normalized names."""
    own = base.select(F.col("id").alias("base_id"), normalize_name(F.col("name")).alias("k")).where("k <> ''")
    return queries.withColumn("k", normalize_name(F.col("name"))).join(own, "k").select(F.col("id").alias("query_id"), "base_id")


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def in_turn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of the rows of two matrices, summed from the first component to the last as dot() does."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * y[:, i]
    return total


def nearest_in_block(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, score of the k rows of y nearest to each row of x by cosine, `least` at least, in the order of falling score and ids.

    A product of matrices finds the candidates, with what its rounding may cost to spare; their scores are then summed in turn, so that
    equal rows have equal scores wherever they stand."""
    nx, ny = np.sqrt(in_turn(x, x)), np.sqrt(in_turn(y, y))
    rough = (x / nx[:, None]) @ (y / ny[:, None]).T
    rough[np.isnan(rough)] = np.inf  # not a number sorts before all others in Spark
    bound = np.full(len(x), least)
    if k < len(y):
        bound = np.maximum(bound, np.partition(rough, len(y) - k, axis=1)[:, len(y) - k])
    i, j = np.nonzero(rough >= bound[:, None] - 1e-9)
    score = in_turn(x[i], y[j]) / (nx[i] * ny[j])
    found = ~(score < least)
    i, j, score = i[found], j[found], score[found]
    order = np.lexsort((ids[j], -np.where(np.isnan(score), np.inf, score), i))
    order = order[np.arange(len(i)) - np.searchsorted(i, i[order]) < k]
    return i[order], j[order], score[order]


def knn_join(queries: DataFrame, base: DataFrame, k: int, least: float, on: list[str] | None = None, max_broadcast_rows: int = 50_000) -> DataFrame:
    """J03. The k nearest base vectors of each query by cosine, of `least` at least; `on`: columns that must be equal.

    queries: (query_id, v, ...), base: (base_id, v, ...), ids are whole numbers. The queries are the stated set, compared with every base row
    in blocks, of which only each query's k best leave the task; the queries' blocks are broadcast while they are at most
    max_broadcast_rows, else a base block is dealt out once for each of them. Vectors of different length have no cosine.
    """
    keys = list(on or [])
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def unit(df: DataFrame, key: str) -> DataFrame:
        sized = df.where(dot(F.col("v"), F.col("v")) > 0).select(*keys, F.col(key).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        return sized.withColumn("size", F.size("v"))

    def blocks(df: DataFrame, rows: int, n: int, fewest: int, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // rows), min(fewest, -(-n // 256)))))
        return df.withColumn(f"{name}_block", block).groupBy(*keys, "size", f"{name}_block").agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(f"{name}_v"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda ids, v: (ids.values.to_numpy(), v.values.to_numpy().reshape(len(ids.values), -1))
        for batch in batches:
            for row in zip(*batch.columns):
                (qi, x), (bi, y) = whole(*row[:2]), whole(*row[2:])
                with np.errstate(all="ignore"):
                    i, j, found = nearest_in_block(x, y, bi, k, least)
                yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(bi[j]), pa.array(found)], ["query_id", "base_id", "score"])

    q, b = unit(queries, "query_id"), unit(base, "base_id")
    n_q = q.count()
    asked, held = blocks(q, KNN_ROWS[0], n_q, 1, "q"), blocks(b, KNN_ROWS[1], b.count(), parts, "b")
    if n_q <= max_broadcast_rows:
        pairs = held.join(F.broadcast(asked), [*keys, "size"])
    else:
        numbers = asked.select(*keys, "size", "q_block")
        pairs = held.join(F.broadcast(numbers), [*keys, "size"]).join(asked, [*keys, "size", "q_block"])
    scored = pairs.select("q_ids", "q_v", "b_ids", "b_v").mapInArrow(score, "query_id long, base_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "base_id", "score", "rank")


def ngram_vector(df: DataFrame, key: str = "id", text: str = "text", sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """D13. key, gram, tf: character n-grams of the normalized text."""
    t = normalize_name(F.col(text))
    runs = lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.substr(t, i, F.lit(n))), lambda g: F.length(g) == n)
    grams = F.flatten(F.array(*map(runs, sizes)))
    return df.select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))


def sparse_cosine(left: DataFrame, right: DataFrame, least: float = 0.0) -> DataFrame:
    """left (a, gram, tf), right (b, gram, tf) -> a, b, score: an inverted-index join on the grams."""
    norm = lambda df, k: df.groupBy(k).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias(f"n_{k}"))
    dots = left.join(right.withColumnRenamed("tf", "tf_b"), "gram").groupBy("a", "b").agg(F.sum(F.col("tf") * F.col("tf_b")).alias("dot"))
    return dots.join(norm(left, "a"), "a").join(norm(right, "b"), "b").withColumn("score", F.col("dot") / (F.col("n_a") * F.col("n_b"))).where(F.col("score") >= least).select("a", "b", "score")


def likely_pairs(left: DataFrame, right: DataFrame, least: float, share: float = 0.8) -> DataFrame:
    """left (a, gram, tf), right (b, gram, tf) -> a, b of a superset of the pairs with a cosine of `least` at least.

    Of a left text's grams the most frequent ones whose squares sum to less than `share` times `least`, squared, of all are left out. The
    rest meet the right texts' grams, which gives a part of the dot product; by Cauchy and Schwarz what was left out adds at most its
    length times that of the right text without the grams that met. Pairs whose bound is below `least` are dropped: without a
    common gram among the rest the cosine is below `least` anyway."""
    df = right.groupBy("gram").agg(F.count("*").alias("df"))
    square = F.col("tf") * F.col("tf")
    frequent = Window.partitionBy("a").orderBy(F.desc("df"), "gram").rowsBetween(Window.unboundedPreceding, 0)
    ranked = left.join(df, "gram", "left").fillna(0, ["df"]).withColumn("sum", F.sum(square).over(frequent)).withColumn("all_a", F.sum(square).over(Window.partitionBy("a")))
    out = F.col("sum") < share * share * least * least * F.col("all_a") * (1 - 1e-9)
    ranked = ranked.withColumn("out", F.max(F.when(out, F.col("sum")).otherwise(F.lit(0))).over(Window.partitionBy("a"))).where(~out & (F.col("df") > 0))
    other = right.withColumn("all_b", F.sum(square).over(Window.partitionBy("b"))).select("b", "gram", F.col("tf").alias("tf_b"), "all_b")
    met = ranked.select("a", "gram", "tf", "all_a", "out").join(other, "gram").groupBy("a", "b").agg(F.sum(F.col("tf") * F.col("tf_b")).alias("part"), F.sum(F.col("tf_b") * F.col("tf_b")).alias("met"), F.first("all_a").alias("all_a"), F.first("out").alias("out"), F.first("all_b").alias("all_b"))
    bound = F.col("part") + F.sqrt(F.col("out").cast("double")) * F.sqrt((F.col("all_b") - F.col("met")).cast("double"))
    return met.where(bound >= least * (1 - 1e-9) * F.sqrt(F.col("all_a").cast("double")) * F.sqrt(F.col("all_b").cast("double"))).select("a", "b")


def cosine_of(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) -> a, b, score of those with a cosine of `least` at least; each text's grams as one map."""
    counts = lambda df, k, c: df.groupBy(k).agg(F.map_from_entries(F.collect_list(F.struct("gram", "tf"))).alias(c), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias(f"n_{c}"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes a pair, but much work: not to be joined into one task
    both = pairs.repartition(parts, "a", "b").join(counts(left, "a", "x"), "a").join(counts(right, "b", "y"), "b")
    product = F.aggregate(F.transform(F.map_entries("x"), lambda e: e["value"] * F.coalesce(F.try_element_at("y", e["key"]), F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.withColumn("score", product / (F.col("n_x") * F.col("n_y"))).where(F.col("score") >= least).select("a", "b", "score")


LEFT_ROWS, RIGHT_ROWS = 1024, 2048  # texts of a block
GRAMS = 37**3  # runs of one to three of 36 characters, as numbers to the base of 37 without the digit 0
DENSE = 2**24  # counts of a matrix


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, gram, count of the runs of one to three characters (a-z, 0-9) of each text."""
    sizes, digit = np.fromiter(map(len, texts), np.int64, len(texts)), np.zeros(128, np.int64)
    digit[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = np.arange(1, 37)
    c, row = digit[np.frombuffer("".join(texts).encode("ascii"), np.uint8)], np.repeat(np.arange(len(texts)), sizes)
    two, three = row[:-1] == row[1:], row[:-2] == row[2:]
    runs = [(row, c), (row[:-1][two], (c[:-1] * 37 + c[1:])[two]), (row[:-2][three], ((c[:-2] * 37 + c[1:-1]) * 37 + c[2:])[three])]
    flat, counts = np.unique(np.concatenate([r * GRAMS + g for r, g in runs]), return_counts=True)
    return flat // GRAMS, flat % GRAMS, counts


def similar_in_block(x: list[str], y: list[str], least: float, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, score of the texts of x and y whose gram counts have a cosine of `least` at least, with k the first k of each i by falling score and j.

    Dot products are whole numbers and exact; single precision only rules out, with what its rounding may cost to spare."""
    (rx, gx, cx), (ry, gy, cy) = gram_counts(x), gram_counts(y)
    nx, ny = np.bincount(rx, cx * cx, len(x)), np.bincount(ry, cy * cy, len(y))
    kind = np.float32 if max(nx.max(initial=0), ny.max(initial=0)) < 2**24 else np.float64
    nx[nx == 0], ny[ny == 0] = np.inf, np.inf
    used = np.unique(gx)
    places = np.full(GRAMS, -1)
    places[used] = np.arange(len(used))
    ry, gy, cy = (v[places[gy] >= 0] for v in (ry, gy, cy))

    def dense(row, gram, count, begin, end):
        at = slice(*np.searchsorted(row, (begin, end)))
        out = np.zeros((end - begin, len(used)), kind)
        out[row[at] - begin, places[gram[at]]] = count[at]
        return out

    step, found = max(1, DENSE // max(1, len(used))), []
    for m in range(0, len(x), step):
        own, part = dense(rx, gx, cx, m, min(m + step, len(x))), []
        for n in range(0, len(y), step):
            dots = own @ dense(ry, gy, cy, n, min(n + step, len(y))).T
            rough = dots * (1 / np.sqrt(nx[m : m + step])).astype(np.float32)[:, None] * (1 / np.sqrt(ny[n : n + step])).astype(np.float32)
            bound = np.full(len(own), least)
            if k is not None and k < rough.shape[1]:
                bound = np.maximum(bound, np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k])
            i, j = np.nonzero(rough >= (bound - 1e-5).astype(np.float32)[:, None])
            part.append((i + m, j + n, dots[i, j].astype(np.float64) / (np.sqrt(nx[i + m]) * np.sqrt(ny[j + n]))))
        i, j, score = map(np.concatenate, zip(*part))
        good = score >= least
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((j, -score, i))
        if k is not None:
            order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
        found.append((i[order], j[order], score[order]))
    return tuple(map(np.concatenate, zip(*found)))


def similar_texts(left: DataFrame, right: DataFrame, least: float, k: int | None = None, max_broadcast_rows: int = 200_000) -> DataFrame:
    """left (a, text), right (b, text) -> a, b, score: pairs whose character n-grams (D13) have a cosine of `least` (over 0) at least, with `k` at least
    the first k of each a in the order of falling score and b.

    Texts are compared in blocks, whose pairs Spark deals out; of a block pair's matrix of scores only such pairs leave the task. Counts
    are whole numbers, so their products are exact."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(df: DataFrame, rows: int, n: int, fewest: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // rows), min(fewest, -(-n // 64)))))
        texts = df.withColumn("text", normalize_name(F.col("text"))).withColumn("block", block).repartition(parts, "block")
        return texts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("texts")).select("texts")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = x.values, y.values
                i, j, found = similar_in_block(x.field(1).to_pylist(), y.field(1).to_pylist(), least, k)
                yield pa.RecordBatch.from_arrays([x.field(0).take(pa.array(i)), y.field(0).take(pa.array(j)), pa.array(found)], ["a", "b", "score"])

    n_left, n_right = left.count(), right.count()
    many = blocks(right.select(F.col("b").alias("id"), "text"), RIGHT_ROWS, n_right, 1).withColumnRenamed("texts", "others")
    pairs = blocks(left.select(F.col("a").alias("id"), "text"), LEFT_ROWS, n_left, 4 * parts).crossJoin(F.broadcast(many) if n_right <= max_broadcast_rows else many)
    kinds = [left.schema["a"].dataType.simpleString(), right.schema["b"].dataType.simpleString()]
    return pairs.mapInArrow(score, f"a {kinds[0]}, b {kinds[1]}, score double")


def resolve(new: DataFrame, existing: DataFrame, edges: DataFrame | None = None, merge: float = 0.92, similar: float = 0.85, candidate: float = 0.60) -> DataFrame:
    """J05. query_id, decision (MERGE, SIMILAR, NEW), base_id, score of each new entity (id, name, type, description).

    The cascade: equal name, alias among the ten best candidates, best score, names that align and, with `edges` (src, dst), a
    similar entity of the graph. All of it is joins and one case. Texts that are equal are compared once, those of entities with an equal
    name, which decides, not at all.
    """
    text = F.concat_ws(" ", "name", "type", "description")
    first_of = existing.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("exact"))
    exact = new.select(F.col("id").alias("a"), F.lower("name").alias("k")).join(first_of, "k").groupBy("a").agg(F.min("exact").alias("exact"))
    asked, held = new.join(exact.select(F.col("a").alias("id")), "id", "left_anti").select(F.col("id").alias("query"), text.alias("text")), existing.select(F.col("id").alias("b"), text.alias("text"))
    scored = similar_texts(asked.groupBy("text").agg(F.min("query").alias("a")), held.groupBy("text").agg(F.min("b").alias("b")), candidate, 10)
    best_of = lambda key, *order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    scored = scored.withColumn("rank", best_of("a", F.desc("score"), "b")).where("rank <= 10").select("a", F.col("b").alias("first"), "score")
    copies = held.withColumn("first", F.min("b").over(Window.partitionBy("text"))).withColumn("rank", best_of("text", "b")).where("rank <= 10").select("first", "b")
    askers = asked.withColumn("a", F.min("query").over(Window.partitionBy("text"))).select("query", "a")
    ten = scored.join(copies, "first").drop("first").withColumn("rank", best_of("a", F.desc("score"), "b")).where("rank <= 10")  # of a text, whoever asks
    ten = ten.join(askers, "a").drop("a").withColumnRenamed("query", "a")
    names = existing.select(F.col("id").alias("b"), F.col("name").alias("base_name"))
    ten = ten.join(names, "b").join(new.select(F.col("id").alias("a"), "name"), "a")
    alias = ten.where(normalize_name(F.col("name")) == normalize_name(F.col("base_name"))).groupBy("a").agg(F.min_by(F.struct("b", "score"), "rank").alias("alias"))
    best = ten.groupBy("a").agg(F.min_by(F.struct("b", "score", "base_name"), "rank").alias("best"))
    rows = new.select(F.col("id").alias("a"), "name").join(exact, "a", "left").join(alias, "a", "left").join(best, "a", "left")
    score = F.col("best.score")
    aligned = names_align(F.col("name"), F.col("best.base_name"))
    merged = F.col("exact").isNotNull() | F.col("alias").isNotNull() | (score >= merge) | ((score >= similar) & aligned)
    merged = F.coalesce(merged, F.lit(False))
    if edges is None:
        rows = rows.withColumn("graph", F.lit(None).cast(existing.schema["id"].dataType))
    else:
        rows = rows.join(graph_similarity(new, existing, edges).select(F.col("query_id").alias("a"), F.col("base_id").alias("graph")), "a", "left")
    by_graph = ~merged & ~F.coalesce(score >= similar, F.lit(False)) & F.col("graph").isNotNull()
    decision = F.when(merged, "MERGE").when((score >= similar) | by_graph, "SIMILAR").otherwise("NEW")
    base_id = F.coalesce("exact", "alias.b", F.when(score >= similar, F.col("best.b")), "graph")
    shown = F.when(F.col("exact").isNotNull(), 1.0).when(by_graph, 0.7).otherwise(F.coalesce("alias.score", score))
    return rows.select(F.col("a").alias("query_id"), decision.alias("decision"), base_id.alias("base_id"), F.round(shown, 4).alias("score"))


def graph_similarity(new: DataFrame, existing: DataFrame, edges: DataFrame) -> DataFrame:
    """J06. query_id, base_id, 0.7: of the five existing entities with an edge that share most words with a name, the first whose
    description holds the name, or whose beginning lies in it.

    Different names meet different texts: of a text only its first five entities can be among a name's five, and of a name's texts only
    the first five. An id that comes with several names has the first of what they find."""
    linked = existing.join(edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct(), "id", "left_semi")
    split = lambda c: F.split(F.lower(c), r"[^a-z0-9]+")
    tokens = lambda c: F.array_distinct(F.filter(split(c), lambda t: F.length(t) >= 3))
    of_text = Window.partitionBy("base_name", "description").orderBy("base_id")
    held = linked.select(F.col("id").alias("base_id"), F.col("name").alias("base_name"), "description").distinct().withColumn("nth", F.row_number().over(of_text)).where("nth <= 5")
    both = F.concat_ws(" ", "base_name", "description")
    base = held.where("nth = 1").select(F.col("base_id").alias("first_id"), "base_name", "description", tokens(both).alias("held")).withColumn("token", F.explode("held"))
    asked = new.select("name").distinct().withColumn("asked", tokens(F.col("name"))).withColumn("token", F.explode("asked"))
    pairs = asked.join(base, "token").where(F.get(F.array_intersect("asked", "held"), F.lit(0)) == F.col("token"))  # each pair in its first common token
    pairs = pairs.select("name", "first_id", "base_name", "description", F.size(F.array_intersect(split(F.col("name")), split(both))).alias("words"))
    texts = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("words"), "first_id"))).where("rank <= 5")
    low, about = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    near = F.contains(about, low) | ((about != "") & F.contains(low, F.substring(about, 1, 20)))
    copies = held.select(F.col("base_id").alias("b"), F.col("base_name").alias("n"), F.col("description").alias("d"))
    same = F.col("base_name").eqNullSafe(F.col("n")) & F.col("description").eqNullSafe(F.col("d"))
    rows = texts.join(copies, same).select("name", F.col("b").alias("base_id"), "words", near.alias("near"))
    five = rows.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("words"), "base_id"))).where("rank <= 5")
    best = new.join(five.where("near").groupBy("name").agg(F.min("base_id").alias("base_id")), "name").groupBy(F.col("id").alias("query_id")).agg(F.min("base_id").alias("base_id"))
    return best.select("query_id", "base_id", F.lit(0.7).alias("score"))


CLASSES = 8  # token classes of the suffix bound
PARITY_WORDS = 8  # words of 64 bits of a set's parities
FREQUENT = 65_536  # tokens of over one in as many occurrences are frequent, so there are fewer than that


@F.pandas_udf(ArrayType(LongType()))
def parities(places: pd.Series) -> pd.Series:
    """Of each list of numbers the parities of how often each bit below 64 * PARITY_WORDS is hit, as words."""
    bits = 64 * PARITY_WORDS
    return places.map(lambda p: np.packbits(np.bincount(np.asarray(p, np.int64) % bits, minlength=bits) & 1).view(np.int64).tolist())


LEAST_BY_PARTS = 0.85  # from here on a part holds some six tokens and more, so that few sets share one by chance
TURN_TOKENS = 1_000_000  # tokens of a task's sets that are hashed at once


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, mixed one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pairs_by_parts(sets: DataFrame, least: float) -> DataFrame:
    """sets (id, tokens) -> a, b (a < b) of a superset of the pairs with at least `least`, each once.

    Two sets of sizes up to n that are that similar differ in d = 2 n (1 - least) / (1 + least) tokens at most. So if tokens are dealt by a
    hash into d + 1 parts, the sets have one part in common, without a token or with all the same ones, and meet by the hash of such a part,
    not by single tokens. Sizes fall into classes that grow by 1 / least, whose largest size is n: a set has the parts of its own class
    and, where a larger set can be similar, those of the next."""
    most = sets.agg(F.max(F.size("tokens"))).first()[0] or 0
    lows = [1]
    while lows[-2:][0] * least <= most + 1 or len(lows) < 4:
        lows.append(max(lows[-1] + 1, int(np.ceil(lows[-1] / least - 1e-9))))
    lows = np.array(lows, np.int64)
    parts = np.floor(2 * (lows[1:] - 1) * (1 - least) / (1 + least) + 1e-6).astype(np.int64) + 1

    def deal(ids: pa.Array, n: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        size_class = np.searchsorted(lows, n, side="right") - 1
        for step in (0, 1):
            some = n >= least * lows[size_class + step] - 1e-9 if step else np.ones(len(n), bool)
            at, h = np.flatnonzero(some), mixed(hashes[np.repeat(some, n)])
            of = size_class[at] + step
            many = parts[of]
            begin, owner = np.cumsum(many) - many, np.repeat(np.arange(len(at)), n[at])
            sums = np.zeros(many.sum(), np.uint64)
            np.add.at(sums, begin[owner] + (h % many[owner].astype(np.uint64)).astype(np.int64), mixed(h + np.uint64(0x9E3779B97F4A7C15)))
            which = np.repeat(np.arange(len(at)), many)
            place = (of[which] << 32) + np.arange(len(which)) - begin[which]
            key = mixed(sums ^ mixed(place.astype(np.uint64) + np.uint64(1)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(at[which])), pa.array(n[at[which]].astype(np.int32)), pa.array(np.full(len(which), not step))], ["key", "id", "n", "own"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).value_lengths().to_numpy().astype(np.int64)
            hashes, ends = batch.column(1).flatten().to_numpy().view(np.uint64), np.cumsum(n)
            at = 0
            while at < len(n):
                begin = ends[at] - n[at]
                to = max(at + 1, int(np.searchsorted(ends, begin + TURN_TOKENS, side="right")))
                yield from deal(batch.column(0).slice(at, to - at), n[at:to], hashes[begin : ends[to - 1]])
                at = to

    hashed = sets.select("id", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes"))
    rows = hashed.mapInArrow(emit, f"key long, id {sets.schema['id'].dataType.simpleString()}, n int, own boolean")
    left, right = (rows.toDF("key", *(f"{c}_{side}" for c in ("id", "n", "own"))) for side in "ab")
    near = (F.col("id_a") < F.col("id_b")) & (F.col("own_a") | F.col("own_b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)
    return left.join(right, "key").where(near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def jaccard_pairs(sets: DataFrame, least: float) -> DataFrame:
    """sets (id, tokens) -> a, b, jaccard of pairs with at least `least` (over 0). Exact; tokens are distinct, sets without any pair with nothing.
    Candidates are found by whole parts of sets from LEAST_BY_PARTS on, by single tokens below; whole sets are compared then."""
    sound = F.col("id").isNotNull() & F.col("tokens").isNotNull() & (F.size("tokens") > 0)  # all that Spark infers for one use or another, else each has a shuffle of its own
    sets = sets.where(sound).select("id", "tokens")
    own = sets.repartition("id")  # the one shuffle of whole sets
    pairs = pairs_by_parts(sets, least) if least >= LEAST_BY_PARTS else pairs_by_tokens(sets, own, least)
    full = pairs.join(own.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return full.withColumn("jaccard", common / (F.size("x") + F.size("y") - common)).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def pairs_by_tokens(sets: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """sets (id, tokens), own: the same by id -> a, b (a < b) of a superset of the pairs with at least `least`, each once.

    Frequent tokens stand last, in order of rising frequency; their table is bounded and broadcast. Two sets of sizes x and y are that similar if they share at least least / (1 + least) *
    (x + y) tokens, which three bounds rule out before sets are compared:

    * prefix: they share one of the first |s| - ceil(least |s|) + 1 tokens of each, so frequent tokens make no candidates;
    * position: of a shared token at places i and j at most min(i, j) tokens up to it and min(x - i, y - j) after it are shared;
    * suffix: tokens fall into classes by a hash, and of a class no more are shared than either set has of it.

    A candidate then has all its shared prefix tokens together, whose count replaces min(i, j) of the last of them. Those left meet
    by bitmaps (folded to two words, already where tokens meet) before whole sets move: the bits in which the parities of two sets differ are no more than the tokens of just one of them.
    """
    exploded = own.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    total = sets.agg(F.sum(F.greatest(F.size("tokens"), F.lit(0)))).first()[0] or 0
    freq = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") * FREQUENT > total)
    by = Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "token")
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1
    ranked = exploded.join(F.broadcast(freq), "token", "left").withColumn("at", F.row_number().over(by)).where(F.col("at") <= prefix)
    of_class = lambda k: F.size(F.filter("h", lambda x: x == k))
    hashed = own.select("id", F.transform("tokens", lambda t: F.pmod(F.hash(t), F.lit(CLASSES))).alias("h"))
    classes = hashed.select("id", F.array(*[of_class(k) for k in range(CLASSES)]).alias("classes"))
    bitmaps = sets.select("id", parities(F.transform("tokens", lambda t: F.hash(t, F.lit(1)))).alias("bits"))
    fold = lambda k: reduce(lambda x, y: x.bitwiseXOR(y), [F.col("bits")[i] for i in range(k, PARITY_WORDS, 2)])
    r = ranked.join(classes, "id").join(bitmaps, "id").select("id", "n", "at", "classes", fold(0).alias("even"), fold(1).alias("odd"), "token")
    shared = least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-9
    after = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    position = F.least("at_a", "at_b") + after >= shared
    suffix = F.aggregate(F.zip_with("classes_a", "classes_b", lambda p, q: F.least(p, q)), F.lit(0), lambda s, x: s + x) >= shared
    left, right = (r.toDF(*(f"{c}_{side}" for c in r.columns[:-1]), "token") for side in "ab")
    folded = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in ("even", "odd")), F.lit(0)) <= F.col("n_a") + F.col("n_b") - 2 * shared
    met = left.join(right, "token").where(folded & (F.col("id_a") < F.col("id_b")) & (F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9) & position & suffix)
    some = met.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b").agg(F.count("*").alias("met"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    likely = some.where(F.col("met") + after >= shared).select("a", "b", "n_a", "n_b")
    differ = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(PARITY_WORDS)), F.lit(0))
    return likely.join(bitmaps.toDF("a", "bits_a"), "a").join(bitmaps.toDF("b", "bits_b"), "b").where(differ <= F.col("n_a") + F.col("n_b") - 2 * shared).select("a", "b")


def word_classes(sets: DataFrame) -> DataFrame:
    """sets (id, tokens) -> class_id (the smallest id), tokens, members: one row for each different set of words."""
    return sets.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.min("id").alias("class_id"), F.count("*").alias("members"))


NAME_IDS, TASK_PAIRS = 256, 1_000_000  # ids of a block of one name, pairs that a task puts out


def aligned_pairs(names: DataFrame, typos: int = 2, prefix: int = 3) -> DataFrame:
    """J04. names (id, name) -> a, b (a < b) of names that align: every pair, found through equal deletions and beginnings.

    Two strings at most `typos` edits apart have a common string that each gives by deleting at most `typos` characters; a name
    that begins another is one of its beginnings. Pairs of names meet the ids of both in blocks, dealt out by the number of pairs, and
    no task holds what these make: only pairs of ids that come with several names can repeat and are compared."""
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = names.select("id", normalize_name(F.col("name")).alias("k")).where("k <> '' AND id IS NOT NULL").distinct()
    distinct = keys.select("k").distinct()
    less = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("v")), lambda i: F.concat(F.substring(F.col("v"), F.lit(1), i - 1), F.substring(F.col("v"), i + 1, F.length("v")))))
    forms = distinct.withColumn("v", F.col("k"))
    for _ in range(typos):
        shorter = forms.where(F.length("v") > 0).withColumn("v", F.explode(less))
        forms = forms.union(shorter).distinct()
    near = forms.toDF("x", "v").join(forms.toDF("y", "v"), "v").where("x < y").select("x", "y").distinct().where(F.levenshtein("x", "y", typos) >= 0)
    starts = distinct.where(F.length("k") > prefix).select(F.col("k").alias("y"), F.explode(F.transform(F.sequence(F.lit(prefix), F.length("k") - 1), lambda n: F.substring(F.col("k"), F.lit(1), n))).alias("x"))
    begun = starts.join(distinct.toDF("x"), "x").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    same = distinct.select(F.col("k").alias("x"), F.col("k").alias("y"))
    numbers = keys.withColumn("several", F.count("*").over(Window.partitionBy("id")) > 1).withColumn("block", F.floor((F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1) / NAME_IDS))
    blocks = numbers.groupBy("k", "several", "block").agg(F.collect_list("id").alias("ids"))
    side = lambda name, i, at, flag, n: blocks.select(F.col("k").alias(name), F.col("ids").alias(i), F.col("block").alias(at), F.col("several").alias(flag), F.size("ids").cast("double").alias(n))
    met = near.union(begun).distinct().union(same).join(side("x", "i", "at_x", "m_x", "n_x"), "x").join(side("y", "j", "at_y", "m_y", "n_y"), "y")
    tasks = max(parts, int((met.agg(F.sum(F.col("n_x") * F.col("n_y"))).first()[0] or 0) // TASK_PAIRS) + 1)
    met = met.repartition(tasks, "x", "y", "at_x", "at_y", "m_x", "m_y")
    each = met.select("x", "y", "m_x", "m_y", F.explode("i").alias("i"), "j").select("x", "y", "m_x", "m_y", "i", F.explode("j").alias("j")).where("i < j OR (x <> y AND i > j)")
    pairs = lambda rows: rows.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    return pairs(each.where("NOT (m_x OR m_y)")).union(pairs(each.where("m_x OR m_y")).distinct())


def elect_leaders(nodes: DataFrame, pairs: DataFrame, materialize) -> DataFrame:
    """J19, W11. Greedy clusters in id order: id, leader. A node leads if no earlier neighbour leads; the rest join their earliest leader.

    Rounds decide all nodes whose earlier neighbours are decided; `materialize` cuts the lineage between them.
    """
    edges = materialize(pairs.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("before")).distinct())
    state = materialize(nodes.select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("leader")))
    while True:
        seen = edges.join(state.toDF("before", "of"), "before")
        view = seen.groupBy("id").agg(F.min(F.when(F.col("of") == F.col("before"), F.col("before"))).alias("lead"), F.max(F.col("of").isNull()).alias("open"), F.min(F.when(F.col("of").isNull(), F.col("before"))).alias("first_open"))
        joined = state.join(view, "id", "left")
        ready = F.col("leader").isNull()
        follow = F.col("lead").isNotNull() & (F.col("first_open").isNull() | (F.col("lead") < F.col("first_open")))
        decided = F.when(~ready, F.col("leader")).when(follow, F.col("lead")).when(~F.coalesce("open", F.lit(False)), F.col("id"))
        state = materialize(joined.select("id", decided.alias("leader")))
        if state.where("leader IS NULL").isEmpty():  # each round decides at least the first open node
            return state

"""Operator 1: benchmark decontamination by greedy string tiling.

Words are lower-case runs of letters, digits and underscores. A document and a benchmark item that share a run of `seed` words
are compared by greedy string tiling: the longest common runs of words that are not yet marked are marked as tiles, again and
again, down to `seed` words; Karp-Rabin hashes of all runs of one length find them. Tiles may come in any order, so a
reordered passage is caught. An item leaks into a document if its tiles cover at least `coverage` of the item's words.

The benchmark is shipped to the tasks while it has at most `max_shipped_words` words; a larger one meets the documents in a
shuffle join on the seeds. Both ways give the same rows. Tiles that cover C words of an item hold at least C / `seed` seeds of it,
so an item's most frequent seeds, less than that many, may be left out of the join: an item that leaks is found by others.

Nulls and odd input: null and empty texts have no words and leak nothing. An item with fewer words than `seed` must occur as a
whole. Null item ids and doc_ids are kept as they are; repeated rows are compared each; repeated items count once an id. Extra
columns are ignored. An empty benchmark leaves every document clean; empty documents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordCodes, materialize, shingles, sliced

WORD = re.compile(r"\w+")


def word_codes(text: str | None, words: WordCodes) -> np.ndarray:
    return words.encode(WORD.findall((text or "").lower()))


def common_runs(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(length, start in a, start in b) of the maximal common runs of unmarked words, of `size` words at least."""

    def hashed(x: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = shingles(x, size)
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[size:] == taken[:-size]) if len(x) >= size else np.zeros(0, np.int64)
        return at, h[at]

    at_a, h_a = hashed(a, free_a)
    at_b, h_b = hashed(b, free_b)
    order = np.argsort(h_b, kind="stable")
    low, high = np.searchsorted(h_b[order], h_a), np.searchsorted(h_b[order], h_a, "right")
    times = high - low
    if not times.any():
        return []
    # every pair of equal windows; on a diagonal, pairs that follow each other make a run
    i = np.repeat(at_a, times)
    j = at_b[order[np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 1) | (np.diff(j) != 1))))
    n = np.diff(np.append(starts, len(i))) + size - 1
    return list(zip(n.tolist(), i[starts].tolist(), j[starts].tolist()))


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, start in a, start in b) of tiles of `least` words at least, none overlapping another."""
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    size = max(least, min(20, len(a), len(b)))
    while True:
        runs = common_runs(a, b, free_a, free_b, size)
        longest = max((r[0] for r in runs), default=0)
        if longest > 2 * size:  # search again for runs as long as the longest
            size = longest
            continue
        heap = [(-n, i, j) for n, i, j in runs]
        heapify(heap)
        left_b = int(free_b.sum())
        while heap and left_b >= size:
            n, i, j = heappop(heap)
            n = -n
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = False
                left_b -= n
                out.append((n, i, j))
            else:  # partly marked meanwhile: what is left of it may still be a tile
                both = free_a[i : i + n] & free_b[j : j + n]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], both.view(np.int8), [0]))))
                for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if e - s >= size:
                        heappush(heap, (s - e, i + s, j + s))
        if size == least:
            return out
        size = max(least, size // 2)


def covered(doc: np.ndarray, item: np.ndarray, seed: int) -> float:
    """Share of the item's words that tiles cover."""
    if not len(item):
        return 0.0
    return sum(n for n, _, _ in tiles(doc, item, min(seed, len(item)))) / len(item)


RESULT = "row long, doc_id long, n_words long, items array<struct<item_id:bigint,coverage:double>>"


def leak_finder(items: list[tuple[int, str]], seed: int, coverage: float):
    """A function of a text: its number of words and the (item_id, coverage) that leaked into it."""
    words = WordCodes()
    bench = [(i, word_codes(t, words)) for i, t in items]
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {min(seed, len(c)) for _, c in bench if len(c)}:
        own = [(np.unique(shingles(c, size)), k) for k, (_, c) in enumerate(bench) if min(seed, len(c)) == size]
        h, k = np.concatenate([x for x, _ in own]), np.repeat([k for _, k in own], [len(x) for x, _ in own])
        order = np.argsort(h, kind="stable")
        by_size[size] = h[order], k[order]

    def find(text: str | None) -> tuple[int, list[tuple[int, float]]]:
        codes = word_codes(text, words)
        near: set[int] = set()
        for size, (h, k) in by_size.items():
            own = shingles(codes, size)
            own = np.unique(own[h[np.minimum(np.searchsorted(h, own), len(h) - 1)] == own])
            for a, b in zip(np.searchsorted(h, own), np.searchsorted(h, own, "right")):
                near.update(k[a:b].tolist())
        scored = [(bench[k][0], covered(codes, bench[k][1], seed)) for k in sorted(near)]
        return len(codes), [(i, c) for i, c in scored if c >= coverage]

    return find


def leaks_shipped(docs: DataFrame, items: list[tuple[int, str]], seed: int, coverage: float) -> DataFrame:
    """row, doc_id, n_words and the leaked items, with the benchmark in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, row = leak_finder(items, seed, coverage), TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            got = [find(t) for t in batch.column(1).to_pylist()]
            found = [[{"item_id": i, "coverage": c} for i, c in x] for _, x in got]
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(row, row + len(got)), pa.int64()), "doc_id": batch.column(0), "n_words": pa.array([n for n, _ in got], pa.int64()), "items": pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())])))})
            row += len(got)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def leaks_joined(docs: DataFrame, benchmark: DataFrame, seed: int, coverage: float) -> DataFrame:
    """The same by a shuffle join of seeds: for a benchmark too large to ship. The numbered documents are written once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.append_column("n_words", pa.array([len(WORD.findall((t or "").lower())) for t in batch.column(1).to_pylist()], pa.int64()))

    numbered = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "doc_id long, text string, n_words long")
    numbered = materialize(numbered.withColumn("row", F.monotonically_increasing_id()), "numbered")
    bench = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(counted, "item_id long, text string, n_words long")
    bench = materialize(bench.withColumn("key", F.monotonically_increasing_id()), "items")
    sizes = [r[0] for r in bench.where("n_words > 0").select(F.least(F.lit(seed), "n_words").alias("n")).distinct().collect()]  # seed numbers at most

    def seeds(batches: Iterator[pa.RecordBatch], own_size: bool) -> Iterator[pa.RecordBatch]:
        words = WordCodes()
        for batch in sliced(batches):
            keys, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = word_codes(text, words)
                for size in [min(seed, len(codes))] if own_size else sizes:
                    if size:
                        h = shingles(codes, size)
                        h = h if own_size else np.unique(h)
                        keys.append(np.full(len(h), key, np.int64))
                        hashes.append(h)
            yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys), "seed": np.concatenate(hashes).view(np.int64)})

    of_items = bench.select("key", "text").mapInArrow(lambda b: seeds(b, True), "key long, seed long").withColumnRenamed("key", "item")  # one row a place
    of_docs = numbered.select("row", "text").mapInArrow(lambda b: seeds(b, False), "key long, seed long").withColumnRenamed("key", "row")
    of_docs = materialize(of_docs.join(of_items.select("seed").distinct(), "seed", "left_semi"), "seeds")
    uses = of_docs.groupBy("seed").agg(F.count("*").alias("uses"))
    in_item = Window.partitionBy("item")
    ranked = of_items.join(uses, "seed").join(bench.select(F.col("key").alias("item"), "n_words"), "item")
    spared = F.ceil(F.lit(coverage) * F.col("n_words") / F.lit(seed)) - 1  # less than the seeds that a leaking item's tiles hold
    wanted = ranked.withColumn("rank", F.row_number().over(in_item.orderBy(F.desc("uses"), "seed"))).where((F.col("rank") > spared) | (F.col("n_words") <= seed))
    pairs = of_docs.join(wanted.select("item", "seed").distinct(), "seed").select("row", "item").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCodes()
        for batch in sliced(batches):
            score = [covered(word_codes(x, words), word_codes(y, words), seed) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            out = pa.RecordBatch.from_pydict({"row": batch.column(0), "item_id": batch.column(1), "coverage": pa.array(score, pa.float64())})
            yield out.filter(pa.array([s >= coverage for s in score], pa.bool_()))

    texts = pairs.join(numbered.select("row", "text"), "row").join(bench.select(F.col("key").alias("item"), "item_id", F.col("text").alias("item_text")), "item")
    found = texts.select("row", "item_id", "text", "item_text").mapInArrow(compare, "row long, item_id long, coverage double")
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("item_id", "coverage"))).alias("items"))
    empty = F.array().cast("array<struct<item_id:bigint,coverage:double>>")
    return numbered.join(found, "row", "left").select("row", "doc_id", "n_words", F.coalesce("items", empty).alias("items"))


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.6, max_shipped_words: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, item_ids, coverage (the largest) and contaminated of each document."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    if size <= 6 * max_shipped_words:
        items = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").collect()]
        found = leaks_shipped(docs, items, seed, coverage)
    else:
        found = leaks_joined(docs, benchmark.select("item_id", "text").distinct(), seed, coverage)
    most = F.coalesce(F.array_max("items.coverage"), F.lit(0.0))
    return found.select("doc_id", "n_words", F.array_distinct(F.col("items.item_id")).alias("item_ids"), F.round(most, 6).alias("coverage"), (F.size("items") > 0).alias("contaminated"))


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.6, max_shipped_words: int = 2_000_000) -> DataFrame:
    """The documents, as they are, into which no benchmark item leaked."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 6 * max_shipped_words:
        numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        own = numbered.select(F.col("__row").alias("doc_id"), "text")
        leaked = leaks(own, benchmark, seed, coverage, max_shipped_words).where("contaminated").select(F.col("doc_id").alias("__row"))
        return numbered.join(leaked, "__row", "left_anti").select(*docs.columns)
    items = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").collect()]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = leak_finder(items, seed, coverage)
        for batch in sliced(batches):
            yield batch.filter(pa.array([not find(t)[1] for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)

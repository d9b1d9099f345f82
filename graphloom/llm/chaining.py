"""Operator 10: fuzzy repeated passages by collinear chaining.

Words are the lower-case runs between white space. Of every document's k-word shingles, those are seeds that are the smallest
hash of some window of `width` shingles, so any common run of k + width - 1 words has a seed in both documents. Every seed is
joined with its first occurrence (the smallest doc_id, then position) in the corpus. The matches of a document with one
earlier document are merged to runs along a diagonal and chained: a chain's runs ascend in both documents, its score is the
words in its runs less a cost for the gaps, and a Fenwick tree over the positions in the earlier document finds the best
predecessor of each run. Chains are then aligned: extended at both ends, over single other words if equal ones follow, with the
edit distance of each gap.
A chain that covers at least `min_words` words of the document and agrees in at least `identity` of them is a repeated
passage; of a chain that agrees in fewer, the parts between its gaps that do are, chosen to cover the most words. The first occurrence of a passage stays, later ones are reported or cut out.

The matches of a seed are as many as its occurrences, never all pairs of them. A seed that makes up more than one in `FREQUENT`
of all repeated seeds meets its first occurrence by broadcast (of fewer than `FREQUENT` rows, therefore) and is dealt by document
from then on; a source of more than one in `FREQUENT` of all chains is copied to several join keys, between which its chains are
dealt. So neither a common passage nor its first document gathers its rows in one task.

Nulls and odd input: null, empty and short texts have no seeds and no passages. A null doc_id sorts before all others. Rows
that repeat doc_id and text are one document and get the same result. Repeats within one document aren't passages. Extra
columns are ignored (kept by cut_passages). An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .align import edit_distance
from .common import WordCodes, batch_minima, discard, materialize, sliced

WORD = re.compile(r"\S+")
LEAST = -(1 << 62)  # stands for a null doc_id
FREQUENT = 4096  # a key of more than one in as many rows is frequent, so there are fewer than as many frequent keys


def text_key(doc_id: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), doc_id & (1 << 64) - 1) - (1 << 63)


def tag_of(key: int) -> int:
    """24 bits of a text's key: they tell rows of one doc_id apart."""
    return key >> 40 & (1 << 24) - 1


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def codes_of(batch: pa.RecordBatch, words: WordCodes) -> Iterator[tuple[int, int, np.ndarray]]:
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        yield doc_id, text_key(doc_id, text), words.encode(text.lower().split())


def seed_table(docs: DataFrame, k: int, width: int) -> DataFrame:
    """seed, doc_id and place (the text's tag, then the position in words) of each seed occurrence."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCodes()
        for batch in sliced(batches):
            rows = list(codes_of(batch, words))
            text, at, h = batch_minima([r[2] for r in rows], k, width)
            ids, tags = np.array([r[0] for r in rows], np.int64), np.array([tag_of(r[1]) for r in rows], np.int64)
            yield pa.RecordBatch.from_pydict({"seed": h.view(np.int64), "doc_id": ids[text], "place": tags[text] << 39 | at})

    return keyed(docs).mapInArrow(find, "seed long, doc_id long, place long")


class Fenwick:
    """Largest value, and whose it is, among the positions up to one."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def up_to(self, i: int) -> tuple[float, int]:
        out, i = (float("-inf"), -1), i + 1
        while i > 0:
            out = max(out, self.best[i])
            i -= i & -i
        return out


def merged_runs(x: np.ndarray, y: np.ndarray, k: int, width: int) -> np.ndarray:
    """Matches (x, y) of k words each -> rows (x, y, words): neighbours on a diagonal whose words touch or lie within a window."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.concatenate(([True], (np.diff(x - y) != 0) | (np.diff(x) > width)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(x)])) - 1
    return np.stack([x[first], y[first], x[last] + k - x[first]], 1)


def chains(runs: np.ndarray, gap_cost: float) -> list[list[int]]:
    """Chains of runs (x, y, words) by descending score, each run in one chain. A gap costs gap_cost for each word in both texts."""
    n = len(runs)
    if n == 1:
        return [[0]]
    xs, ys, size = runs[:, 0], runs[:, 1], runs[:, 2]
    ends = np.unique(ys + size)
    slot = np.searchsorted(ends, ys + size)
    limit = np.searchsorted(ends, ys, side="right") - 1
    tree, score, back = Fenwick(len(ends)), [0.0] * n, [-1] * n
    waiting = np.argsort(xs + size, kind="stable")
    w = 0
    for i in np.argsort(xs, kind="stable").tolist():
        while w < n and xs[waiting[w]] + size[waiting[w]] <= xs[i]:
            j = int(waiting[w])
            tree.put(int(slot[j]), (score[j] + gap_cost * float(xs[j] + size[j] + ys[j] + size[j]), j))
            w += 1
        value, j = tree.up_to(int(limit[i])) if limit[i] >= 0 else (float("-inf"), -1)
        value -= gap_cost * float(xs[i] + ys[i])
        score[i] = float(size[i]) + max(0.0, value)
        back[i] = j if value > 0 else -1
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def edits(p: np.ndarray, q: np.ndarray, most: int) -> int:
    """Edit distance of two gaps, or most + 1 if it takes more; a band wider than the longer gap isn't filled."""
    if len(p) == len(q) and not (p != q).any():
        return 0
    return edit_distance(p, q, max(0, min(most, max(len(p), len(q)))))


def agreeing(runs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (x, y, words) of the longest stretches of equal words in a chain's runs; runs may hold a few words that differ."""
    parts = []
    for x, y, n in runs.tolist():
        equal = np.concatenate(([False], a[x : x + n] == b[y : y + n], [False]))
        turns = np.flatnonzero(equal[1:] != equal[:-1])
        parts.append(np.stack([x + turns[::2], y + turns[::2], turns[1::2] - turns[::2]], 1))
    return np.concatenate(parts)


def parts_of(runs: np.ndarray, a: np.ndarray, b: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """The parts of a chain that are passages by themselves, apart and with the most words of a in all.

    A part from stretch i to stretch j is a passage if its edits are at most a share of its length in a or in b, so if a sum
    over the stretches before i is at least one up to j: two Fenwick trees, one for either length, hold the best beginnings.
    """
    runs = agreeing(runs, a, b)
    n = len(runs)
    if not n:
        return []
    begin, end = runs[:, :2].copy(), runs[:, :2] + runs[:, 2:]
    most = int((1 - identity) * max(len(a), len(b)))
    wrong = np.zeros(n, np.int64)  # edits up to a stretch
    for i in range(1, n):
        wrong[i] = wrong[i - 1] + edits(a[end[i - 1, 0] : begin[i, 0]], b[end[i - 1, 1] : begin[i, 1]], most)
    for i in range(n):  # equal words beside a stretch, as far as its neighbours
        low, high = end[i - 1] if i else (0, 0), runs[i + 1, :2] if i + 1 < n else (len(a), len(b))
        x, y = begin[i].tolist()
        while x > low[0] and y > low[1] and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
        begin[i] = x, y
        x, y = (runs[i, :2] + runs[i, 2]).tolist()
        while x < high[0] and y < high[1] and a[x] == b[y]:
            x, y = x + 1, y + 1
        end[i] = x, y
    share = 1 - identity
    starts = [np.round(wrong - share * begin[:, c], 6) for c in (0, 1)]
    ends = [np.round(wrong - share * end[:, c], 6) for c in (0, 1)]
    orders = [np.unique(-v) for v in starts]
    slots = [np.searchsorted(o, -v) for o, v in zip(orders, starts)]
    limits = [np.searchsorted(o, -v, side="right") - 1 for o, v in zip(orders, ends)]
    trees = [Fenwick(len(o)) for o in orders]
    best, take, ready = [0] * (n + 1), [-1] * n, 0  # best[i]: words in passages of the stretches before i
    for j in range(n):
        while ready <= j and begin[ready, 0] + min_words <= end[j, 0]:
            for c in (0, 1):
                trees[c].put(int(slots[c][ready]), (best[ready] - float(begin[ready, 0]), ready))
            ready += 1
        value, i = max(trees[c].up_to(int(limits[c][j])) for c in (0, 1))
        best[j + 1] = best[j]
        if i >= 0 and value + float(end[j, 0]) > best[j]:
            best[j + 1], take[j] = value + float(end[j, 0]), i
    out, j = [], n - 1
    while j >= 0:
        i = take[j]
        if i < 0:
            j -= 1
            continue
        length = max(end[j] - begin[i])
        out.append((*(int(v) for v in (begin[i, 0], end[j, 0], begin[i, 1], end[j, 1])), float(1 - (wrong[j] - wrong[i]) / length)))
        j = i - 1
    return out[::-1]


def reach(a: np.ndarray, b: np.ndarray, x: int, y: int, step: int, run: int = 4) -> tuple[int, int]:
    """How far (x, y) can move along the diagonal over equal words and over single other words that `run` equal ones follow, and
    how many others there are."""
    n = min(x, y) if step < 0 else min(len(a) - x, len(b) - y)
    p, q = (a[x - n : x][::-1], b[y - n : y][::-1]) if step < 0 else (a[x : x + n], b[y : y + n])
    at = wrong = 0
    while at < n:
        differ = np.flatnonzero(p[at : at + 256] != q[at : at + 256])
        if not len(differ):
            at = min(n, at + 256)
            continue
        at += int(differ[0])
        if at + 1 + run > n or (p[at + 1 : at + 1 + run] != q[at + 1 : at + 1 + run]).any():
            break
        at, wrong = at + 1 + run, wrong + 1
    return at, wrong


def chain_passages(runs: np.ndarray, a: np.ndarray, b: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """Align a chain's runs: (start, end) in a, (start, end) in b and the share of agreeing words of the whole chain, if that's
    enough of both, or else of those of its parts of which it is."""
    x0, y0 = int(runs[0, 0]), int(runs[0, 1])
    before, wrong_before = reach(a, b, x0, y0, -1)
    x1, y1 = (int(runs[-1, c] + runs[-1, 2]) for c in (0, 1))
    after, wrong_after = reach(a, b, x1, y1, 1)
    at_x, at_y = x0, y0
    x0, y0, x1, y1 = x0 - before, y0 - before, x1 + after, y1 + after
    n = x1 - x0
    if n < min_words:
        return []
    wrong, most = wrong_before + wrong_after, int(round((1 - identity) * max(n, y1 - y0), 6))
    for x, y, size in runs.tolist():
        for p, q in ((a[at_x:x], b[at_y:y]), (a[x : x + size], b[y : y + size])):
            wrong += edits(p, q, most - wrong)
        if wrong > most:
            return parts_of(runs, a, b, min_words, identity)
        at_x, at_y = x + size, y + size
    return [(x0, x1, y0, y1, 1 - wrong / max(n, y1 - y0))]


def share_of(total: DataFrame) -> int:
    """How many rows make a key frequent, of a total."""
    return max(1000, (total.first()[0] or 0) // FREQUENT)


def passages(docs: DataFrame, min_words: int = 50, identity: float = 0.8, k: int = 6, width: int = 8, gap_cost: float = 0.15) -> DataFrame:
    """doc_id, text_key, start, end (words) of each repeated passage, with source_id, source_start, source_end and identity."""
    spark = docs.sparkSession
    seeds = seed_table(docs, k, width)
    first = materialize(seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    most = share_of(first.agg(F.sum("n")))
    frequent = F.broadcast(first.where(F.col("n") > most).select("seed", F.col("first").alias("known")))
    rare = first.where(F.col("n") <= most).select(F.col("seed").alias("key"), "first")
    dealt = seeds.join(frequent, "seed", "left").select("doc_id", "place", "known", F.when(F.col("known").isNull(), F.col("seed")).otherwise(F.xxhash64("doc_id", "place")).alias("key"))
    found = dealt.join(rare, "key", "left").select("doc_id", "place", F.coalesce("known", "first").alias("first")).where("first IS NOT NULL")
    tag = lambda c: F.shiftright(c, 39)
    at = lambda c: F.col(c).bitwiseAND((1 << 39) - 1).cast("int")
    matches = found.where((F.col("doc_id") != F.col("first.doc_id")) | (tag("place") != tag("first.place")))
    by_pair = matches.groupBy("doc_id", tag("place").alias("tag"), F.col("first.doc_id").alias("source_id"), tag("first.place").alias("source_tag"))
    pairs = by_pair.agg(F.collect_list(F.struct(at("place").alias("x"), at("first.place").alias("y"))).alias("matches"))  # at most a document's seeds
    least = k + min_words // 6  # a chain of fewer words isn't worth aligning

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            lists = batch.column(4)
            offsets, values = lists.offsets.to_numpy(), lists.values
            xs, ys = values.field(0).to_numpy().astype(np.int64), values.field(1).to_numpy().astype(np.int64)
            for i in range(batch.num_rows):
                x, y = xs[offsets[i] : offsets[i + 1]], ys[offsets[i] : offsets[i + 1]]
                runs = merged_runs(x, y, k, width)
                for c in chains(runs, gap_cost):
                    if runs[c, 2].sum() >= least:
                        rows.append((i, runs[c].ravel().tolist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array([r[0] for r in rows], pa.int64())) for c in range(4)), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["doc_id", "tag", "source_id", "source_tag", "runs"])

    chained = materialize(pairs.mapInArrow(chain, "doc_id long, tag long, source_id long, source_tag long, runs array<bigint>"), "chains")
    discard(first)
    involved = chained.select("doc_id", "tag").union(chained.select("source_id", "source_tag")).distinct()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCodes()
        for batch in sliced(batches):
            rows = list(codes_of(batch, words))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text_key": pa.array([r[1] for r in rows], pa.int64()), "tag": pa.array([tag_of(r[1]) for r in rows], pa.int64()), "codes": pa.array([r[2].tobytes() for r in rows], pa.binary())})

    codes = keyed(docs).mapInArrow(code, "doc_id long, text_key long, tag long, codes binary").join(involved, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    codes = materialize(codes, "codes")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc_id, key, source_id, runs, a, b in zip(*(batch.column(c).to_pylist() for c in range(6))):
                for got in chain_passages(np.array(runs).reshape(-1, 3), np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), min_words, identity):
                    rows.append((doc_id, key, got[0], got[1], source_id, got[2], got[3], round(got[4], 6)))
            names = ["doc_id", "text_key", "start", "end", "source_id", "source_start", "source_end", "identity"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "identity" else pa.int64()) for n, c in zip(names, zip(*rows) if rows else [[]] * 8)], names)

    source = ["source_id", "source_tag"]
    most = share_of(chained.agg(F.count("*")))
    copies = F.broadcast(chained.groupBy(*source).count().where(F.col("count") > most).select(*source, F.ceil(F.col("count") / most).alias("copies")))
    known = F.coalesce("copies", F.lit(1).cast("long"))
    sources = codes.select(F.col("doc_id").alias("source_id"), F.col("tag").alias("source_tag"), F.col("codes").alias("b"))
    sources = sources.join(copies, source, "left").select(*source, "b", F.explode(F.sequence(F.lit(0).cast("long"), known - 1)).alias("copy"))
    parts = chained.join(copies, source, "left").withColumn("copy", F.pmod(F.xxhash64("doc_id", "tag"), known)).drop("copies")
    both = parts.join(codes.withColumnRenamed("codes", "a"), ["doc_id", "tag"]).join(sources, [*source, "copy"]).select("doc_id", "text_key", "source_id", "runs", "a", "b")
    return both.mapInArrow(align, "doc_id long, text_key long, start long, end long, source_id long, source_start long, source_end long, identity double")


def covered_spans(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Union of spans, ascending."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeated_spans(found: DataFrame) -> DataFrame:
    """text_key, spans array<struct<start, end>> (apart, ascending), n_removed, source_ids."""
    listed = found.groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("all"), F.sort_array(F.collect_set("source_id")).alias("source_ids"))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s)))
    listed = listed.withColumn("spans", F.aggregate("all", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), step))
    return listed.select("text_key", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"), "source_ids")


def with_keys(docs: DataFrame) -> DataFrame:
    """All columns and __text_key."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = [LEAST if i is None else i for i in batch.column("doc_id").to_pylist()]
            yield batch.append_column("__text_key", pa.array([text_key(i, t or "") for i, t in zip(ids, batch.column("text").to_pylist())], pa.int64()))

    return docs.mapInArrow(add, StructType([*docs.schema]).add("__text_key", LongType()))


def cut_passages(docs: DataFrame, **options) -> DataFrame:
    """The documents without their repeated passages; documents of which nothing is left are gone. n_chars is counted anew."""
    spans = repeated_spans(passages(docs, **options)).select(F.col("text_key").alias("__text_key"), F.col("spans").alias("__spans"))
    joined = with_keys(docs).join(spans, "__text_key", "left").drop("__text_key")
    has_count = "n_chars" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, keep = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist()):
                if spans:
                    words = [m.span() for m in WORD.finditer(text)]
                    left, at = [], 0
                    for s in spans:
                        left.append(text[at : words[s["start"]][0]])
                        at = words[s["end"]][0] if s["end"] < len(words) else len(text)
                    text = "".join([*left, text[at:]]).strip()
                texts.append(text)
                keep.append(not spans or bool(text))
            columns = {c: batch.column(c) for c in batch.schema.names if c != "__spans"} | {"text": pa.array(texts, pa.string())}
            if has_count:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(keep, pa.bool_()))

    fields = [StructField(f.name, LongType()) if f.name == "n_chars" else f for f in docs.schema]
    return joined.mapInArrow(cut, StructType(fields)).select(*(f"`{c}`" for c in docs.columns))


def op10_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with how many of its words lie in passages that an earlier document has, and which documents those are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = repeated_spans(passages(docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = [LEAST if i is None else i for i in batch.column(0).to_pylist()]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_key": pa.array([text_key(i, t) for i, t in zip(ids, texts)], pa.int64()), "n_words": pa.array([len(t.split()) for t in texts], pa.int64())})

    own = docs.mapInArrow(count, "doc_id long, text_key long, n_words long").join(spans, "text_key", "left")
    none = F.expr("cast(array() as array<bigint>)")
    return own.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_passages"), F.coalesce("source_ids", none).alias("source_ids"))

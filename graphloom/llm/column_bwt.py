"""Operator 5: exact repeated byte strings, by column-wise construction of a collection Burrows-Wheeler transform.

A byte is removed if a string of `length` bytes that covers it also starts earlier in the corpus. Suffixes of a whole corpus
can't be inserted symbol by symbol in one pass over one machine's files, so Spark first deals the suffixes into collections
that are small and independent:

1. Every window of `length` bytes has an anchor, the leftmost smallest hash of its 16-byte grams. Equal windows have equal
   anchors at equal places, so a window's copies are all found among the strings around that anchor. A string is what the
   windows of one anchor cover; anchors whose gram occurs once are done with.
2. Of equal strings around equal anchors, all but the first are repeated. Each task tells those that repeat a string of its own
   rows; one shuffle by anchor ranks what is left, at most one of a kind from 500,000 strings.
3. The different strings around one anchor form a collection, aligned at the anchor. Column by column from the right, one
   symbol of each string is inserted: the order of the suffixes is updated by a stable sort on the new symbols (the column in
   the order so far is the collection's BWT) and the common prefixes of neighbours by range minima. Where the common prefix
   reaches `length`, neighbours are the same window, and all but the first are repeated.
4. An anchor with over `large` different strings isn't given to one task: its windows are hashed (128 bits) one by one and
   meet in a grouped minimum.

Texts aren't shuffled: they are written once in numbered blocks, and what a block's documents have to give or to lose comes as
files by block.

The rounds of step 3 run over the sorted shuffle files of Spark, which each task reads in sequence. The construction is thus the
positional form of the column-wise method: suffixes are ordered among those that begin in the same column, which is all that
equal windows need.

Nulls and odd input: a null text is an empty text; texts shorter than `length` bytes lose nothing. Rows with a null doc_id sort before
all others, by a hash of their text. Rows that repeat doc_id and text are one document and get the same result; rows that repeat
only doc_id are ordered by a hash of the text, of 24 bits: some thousand different texts of one doc_id would make two of them one. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, in_blocks, materialize, mix64, read_block, shuffle_partitions, sliced, write_by_block

GRAM = 16
LEAST = -(1 << 62)  # null doc_ids stand below it, told apart by 62 bits of a hash of the text


def tagged_blocks(docs: DataFrame) -> DataFrame:
    """doc_id (never null), a tag of the text (it tells rows of one doc_id apart), the text, row and block."""
    text = F.coalesce("text", F.lit(""))
    tag = F.shiftrightunsigned(F.xxhash64(text), 40)
    without = F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 2) + F.lit(-(1 << 63))  # below LEAST
    return in_blocks(docs.select(F.coalesce(F.col("doc_id").cast("long"), without).alias("doc_id"), tag.alias("tag"), "text"))


def as_bytes(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


class OfBlock:
    """The lists of a block's rows, from the files of write_by_block()."""

    def __init__(self, path: str, column: str):
        self.path, self.column, self.block, self.lists = path, column, None, {}

    def find(self, block: int, row: int) -> list | None:
        if block != self.block:
            table = read_block(self.path, block)
            self.block = block
            # each list stays an Arrow value until its row comes
            self.lists = {} if table is None else dict(zip(table["row"].to_pylist(), table[self.column]))
        found = self.lists.get(row)
        return None if found is None else found.as_py()


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last start of the windows that have it."""
    a = np.frombuffer(data, np.uint8)
    h = a.astype(np.uint64) + np.uint64(1)
    span, base = 1, 0x9E3779B97F4A7C15
    while span < GRAM:  # hashes of 1, 2, 4, 8, 16 bytes
        h = h[:-span] * np.uint64(pow(base, span, 1 << 64)) + h[span:]
        span *= 2
    h = mix64(h)
    width = length - GRAM + 1
    at, span = np.arange(len(h), dtype=np.int32), 1
    low = h
    while span * 2 <= width:  # the smallest of 1, 2, 4, ... grams, then of a window
        right = low[span:] < low[:-span]
        at, low = np.where(right, at[span:], at[:-span]), np.where(right, low[span:], low[:-span])
        span *= 2
    m = len(a) - length + 1
    shift = width - span
    at = np.where(low[shift : shift + m] < low[:m], at[shift : shift + m], at[:m])
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [m])) - 1
    return h[at[first]].view(np.int64), at[first].astype(np.int64), first, last


def strings(blocks: DataFrame, length: int, most: int = 500_000) -> DataFrame:
    """The strings of the documents: anchor, content (hash of the string and the anchor's place in it), doc_id and place (tag, first
    window, more windows). `repeated` ones equal an earlier string among up to `most` of the same task, and need no anchor."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            anchor, content, doc_id, place = (np.concatenate(c).astype(np.int64) for c in zip(*held))
            order = np.lexsort((place, doc_id, content, anchor))
            anchor, content, doc_id, place = anchor[order], content[order], doc_id[order], place[order]
            starts = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])))
            first = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
            repeated = (doc_id != doc_id[first]) | (place != place[first])
            spread = mix64(np.where(repeated, place, 0).view(np.uint64)).view(np.int64)
            columns = {"anchor": np.where(repeated, spread, anchor), "content": np.where(repeated, spread, content), "doc_id": doc_id, "place": place}
            return pa.RecordBatch.from_pydict(columns | {"repeated": repeated})

        n = 0
        for batch in sliced(batches):
            for doc_id, tag, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                if len(data) >= length:
                    h, at, first, last = anchors(data, length)
                    view = memoryview(data)
                    content = np.array([xxhash.xxh3_64_intdigest(view[s : e + length], x) for s, e, x in zip(first.tolist(), last.tolist(), (at - first).tolist())], np.uint64).view(np.int64)
                    held.append((h, content, np.full(len(h), doc_id), tag << 39 | first << 7 | (last - first)))
                    n += len(h)
            if n >= most:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return blocks.select("doc_id", "tag", "text").mapInArrow(find, "anchor long, content long, doc_id long, place long, repeated boolean")


def repeated_windows(groups: np.ndarray, columns: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Column-wise rounds over aligned strings.

    groups: a number for each string, ascending; within a group strings are in corpus order. columns[i, c]: symbol of string i
    in column c, -1 outside the string. For each column (window start) with any: (indices of repeated strings, column).
    """
    n, width = columns.shape
    order = np.arange(n)  # strings by the suffix from the current column on, group by group
    common = np.zeros(n, np.int32)  # common prefix of a string and the one before it in the order
    found = []
    for c in range(width - 1, -1, -1):
        symbol = columns[order, c]
        by = np.argsort(groups[order] * 512 + symbol, kind="stable")
        new, sym, grp = order[by], symbol[by], groups[order][by]
        same = np.zeros(n, bool)
        same[1:] = (grp[1:] == grp[:-1]) & (sym[1:] == sym[:-1]) & (sym[1:] >= 0)
        longer = np.zeros(n, np.int32)
        i = np.flatnonzero(same)
        if len(i):
            begin, end = by[i - 1] + 1, by[i] + 1
            near = end - begin == 1
            longer[i[near]] = common[begin[near]] + 1
            far = ~near
            if far.any():
                bounds = np.stack([begin[far], end[far]], 1).ravel()
                padded = np.append(common, np.int32(0))
                longer[i[far]] = np.minimum.reduceat(padded, bounds)[::2] + 1
        order, common = new, longer
        if c <= width - length:
            equal = common >= length
            if equal.any():
                start = np.maximum.accumulate(np.where(equal, 0, np.arange(n)))  # first of each run of equal windows
                least = np.full(n, n)
                np.minimum.at(least, start, order)
                member = equal.copy()
                member[:-1] |= equal[1:]
                repeated = order[member & (least[start] != order)]
                if len(repeated):
                    found.append((repeated, np.full(len(repeated), c)))
    return found


def repeated_bytes(blocks: DataFrame, length: int = 100, large: int = 2000) -> DataFrame:
    """doc_id, tag and spans (start, end in bytes) of the repeated bytes of each document that has any; spans may overlap."""
    spark = blocks.sparkSession
    partitions = shuffle_partitions(spark)
    alike = Window.partitionBy("anchor", "content").orderBy("doc_id", "place")
    ranked = strings(blocks, length).repartition(partitions, "anchor").withColumn("rank", F.rank().over(alike)).withColumn("copy", F.row_number().over(alike))
    ranked = ranked.withColumn("strings", F.count_if(F.col("copy") == 1).over(Window.partitionBy("anchor")))
    ranked = ranked.where("repeated OR rank > 1 OR copy = 1 AND strings > 1").withColumn("repeated", F.col("repeated") | (F.col("rank") > 1))
    ranked = materialize(ranked.select("anchor", "doc_id", "place", "repeated", "strings"), "ranked")
    equal = ranked.where("repeated").select("doc_id", "place")
    tag = F.shiftright("place", 39).alias("tag")
    compared = ranked.where("NOT repeated").select("doc_id", tag, F.struct("anchor", "place", (F.col("strings") > large).alias("hot")).alias("s"))
    compared = compared.groupBy("doc_id", "tag").agg(F.collect_list("s").alias("wanted"))  # at most the strings of a document
    rows = blocks.groupBy("doc_id", "tag").agg(F.min(F.struct("row", "block")).alias("at"))
    wanted_files = write_by_block(compared.join(rows, ["doc_id", "tag"]).select("at.block", "at.row", "wanted"), "wanted")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings with their bytes; of hot anchors, windows with a hash of theirs."""
        lists = OfBlock(wanted_files, "wanted")
        for batch in sliced(batches):
            out = []
            rows = [(lists.find(block, row), doc_id, i) for i, (block, row, doc_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "row", "doc_id"))))]
            rows = [x for x in rows if x[0]]
            texts = as_bytes(batch.column("text").take(pa.array([x[-1] for x in rows], pa.int64())))
            for (wanted, doc_id, _), data in zip(rows, texts):
                h, places, first, _ = anchors(data, length)
                at = dict(zip(first.tolist(), places.tolist()))
                for w in wanted:
                    lo, more = w["place"] >> 7 & (1 << 32) - 1, w["place"] & 127
                    if w["hot"]:
                        out += [(doc_id, w["place"] >> 39 << 39 | p << 7, None, None, xxhash.xxh3_128_digest(data[p : p + length])) for p in range(lo, lo + more + 1)]
                    else:
                        out.append((doc_id, w["place"], w["anchor"], at[lo] - lo, data[lo : lo + more + length]))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "place", "anchor", "before", "data"])

    taken = blocks.select("block", "row", "doc_id", "text").mapInArrow(take, "doc_id long, place long, anchor long, before long, data binary")
    taken = materialize(taken, "strings")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = length - GRAM
        width = 2 * left + GRAM
        names = ["doc_id", "place"]

        def of(table: pa.Table) -> pa.RecordBatch:
            anchor, before = table["anchor"].to_numpy(), table["before"].to_numpy()
            ids = np.cumsum(np.concatenate(([0], (anchor[1:] != anchor[:-1]).astype(np.int64))))
            columns = np.full((len(ids), width), -1, np.int16)
            for i, (b, data) in enumerate(zip(before.tolist(), table["data"].to_pylist())):
                columns[i, left - b : left - b + len(data)] = np.frombuffer(data, np.uint8)
            got = repeated_windows(ids, columns, length)
            index, column = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
            place = table["place"].to_numpy()[index]
            start = (place >> 7 & (1 << 32) - 1) + before[index] - left + column
            return pa.RecordBatch.from_arrays([pa.array(table["doc_id"].to_numpy()[index]), pa.array(place >> 39 << 39 | start << 7)], names)

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 8000:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table["anchor"].to_numpy()
                whole = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if (anchor != anchor[-1]).any() else 0  # the last group may go on
                if whole:
                    yield of(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                n -= whole
        if n:
            yield of(pa.Table.from_batches(held).combine_chunks())

    cold = taken.where("anchor IS NOT NULL").repartition(partitions, "anchor").sortWithinPartitions("anchor", "doc_id", "place")
    by_columns = cold.mapInArrow(compare, "doc_id long, place long")
    hot = taken.where("anchor IS NULL").select("doc_id", "place", "data")
    firsts = hot.groupBy("data").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    by_hash = hot.join(firsts, "data").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("place") != F.col("first.place"))).select("doc_id", "place")
    every = equal.union(by_columns).union(by_hash)
    start = F.shiftright("place", 7).bitwiseAND((1 << 32) - 1)
    spans = every.select("doc_id", F.shiftright("place", 39).alias("tag"), F.struct(start.alias("start"), (start + F.col("place").bitwiseAND(127) + length).alias("end")).alias("s"))
    return spans.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 100, large: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) of each row."""
    blocks = tagged_blocks(docs)
    spans = repeated_bytes(blocks, length, large)
    span_files = write_by_block(spans.join(blocks.select("doc_id", "tag", "block", "row"), ["doc_id", "tag"]).select("block", "row", "spans"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = OfBlock(span_files, "spans")
        for batch in sliced(batches):
            rows = []
            for block, row, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("block", "row", "doc_id")), as_bytes(batch.column("text"))):
                kept, at, n = [], 0, 0
                until = -1
                for s in lists.find(block, row) or ():
                    if s["start"] > until:
                        n += 1
                        if until >= 0:
                            at = until
                        kept.append(data[at : s["start"]])
                    until = max(until, s["end"])
                kept.append(data[max(until, 0) :])
                left = b"".join(kept)
                rows.append((None if doc_id < LEAST else doc_id, len(data), len(data) - len(left), n, left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return blocks.select("block", "row", "doc_id", "text").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat an earlier string of 100 bytes."""
    left = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

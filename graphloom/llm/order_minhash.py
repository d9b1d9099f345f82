"""Operator 8: near-duplicate documents by order MinHash and banded alignment.

Words are the lower-case runs between white space. A document's k-mers are its five-word shingles, each labelled with its
occurrence number. A sketch takes the `picked` k-mers with the smallest hashes and keeps them in text order, so two texts
share a sketch only if they share these k-mers in the same order: the chance follows edit similarity, not just the set of
k-mers. Two texts are linked if 1 - (edit distance in words) / (words of the longer) is at least `threshold`; candidates are
verified by banded alignment, which fills only the cells that such a pair can reach.

Exact copies (equal word sequences) are one text from the start. Texts that share a sketch aren't compared all with all: each
is compared with the first text of the bucket, and then, as long as buckets hold several components, with another text of the
finer buckets that 2, 4, 8 and at last all equal sketches make, three ways for each sketch to choose them. That stays linear in
the bucket; texts that are similar share about half of all sketches, so they meet in many buckets. What sketches leave out is found
through windows of words (shared_windows.py): every pair of texts in different classes that can be linked is aligned too. Classes are
the connected components of all links. A class with more than one in `FREQUENT` of all texts gets its number by broadcast (of fewer than
`FREQUENT` rows), so its texts never gather in one task.

Nulls and odd input: a null text and a text without words are alone in their class. A text with fewer words than k has one
k-mer, all its words. Rows that repeat doc_id and words are one document: all of them get the same class. A null doc_id
sorts before all others. Extra columns are ignored (drop_near_duplicates keeps them). An empty table gives no rows. Aligning two
long texts takes time in proportion to their words times the edits between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .align import edit_distance
from .common import WordCodes, discard, materialize, mix64, read_block, remove, shingles, sliced, write_by_block
from .graph import components
from .shared_windows import candidates, packed


BLOCK = 8192  # rows of which one file tells what is wanted of them
FREQUENT = 4096  # a class of more than one in as many texts is frequent, so there are fewer than as many frequent classes


def text_codes(texts: list[str | None], words: WordCodes) -> list[np.ndarray]:
    """Word codes of each text."""
    return [words.encode((t or "").lower().split()) for t in texts]


def content_id(codes: np.ndarray) -> bytes | None:
    """128 bits for a word sequence; none for no words."""
    return xxhash.xxh3_128_digest(codes.tobytes()) if len(codes) else None


def order_sketches(codes: np.ndarray, k: int, picked: int, sketches: int) -> np.ndarray:
    """One number for each sketch."""
    h = shingles(codes, min(k, len(codes)))
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    place = np.arange(len(h))
    number = np.empty(len(h), np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    labelled = h + number * np.uint64(0x9E3779B97F4A7C15)
    seeds = mix64(np.arange(1, sketches + 1, dtype=np.uint64))[:, None]
    rank = (labelled ^ seeds) * np.uint64(0xFF51AFD7ED558CCD)
    rank ^= rank >> np.uint64(32)
    rank *= np.uint64(0xC4CEB9FE1A85EC53)
    n = min(picked, len(h))
    lowest = np.sort(np.argpartition(rank, n - 1, axis=1)[:, :n] if n < len(h) else np.broadcast_to(place, (sketches, n)), axis=1)
    out = np.zeros(sketches, np.uint64)
    for j in range(n):
        out = mix64(out * np.uint64(31) + labelled[lowest[:, j]])
    return out.view(np.int64)


def count_difference(x: np.ndarray, y: np.ndarray) -> int:
    """At most the sum over all words by how much their numbers differ; an edit adds no more than two to that."""
    count = lambda c: np.bincount(c & 1023, minlength=1024)
    return int(np.abs(count(x) - count(y)).sum())


def sketched(docs: DataFrame, k: int, picked: int, sketches: int) -> DataFrame:
    """doc_id, content, n_words, sketches, a number of the row and its block, and codes (bytes; null for no words) of the documents."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCodes()
        for batch in sliced(batches):
            codes = text_codes(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "content": pa.array([content_id(c) for c in codes], pa.binary()), "n_words": pa.array([len(c) for c in codes], pa.int64()),
                "sketches": pa.array([order_sketches(c, k, picked, sketches) if len(c) else [] for c in codes], pa.list_(pa.int64())),
                "row": batch.column(2), "block": pa.array([r // BLOCK for r in batch.column(2).to_pylist()], pa.int64()),
                "codes": pa.array([c.tobytes() if len(c) else None for c in codes], pa.binary()),
            })

    numbered = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id())  # partition, then 33 bits of place in it
    return numbered.mapInArrow(sketch, "doc_id long, content binary, n_words long, sketches array<bigint>, row long, block long, codes binary")


def codes_of(base: DataFrame, path: str) -> DataFrame:
    """content, root, codes of the rows (row, root) that write_by_block() wrote; so codes are never shuffled to find them."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, wanted = None, None
        for batch in batches:
            rows = batch.column("row").to_numpy()
            blocks = batch.column("block").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)])).tolist()
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if blocks[i] != last:
                    last, wanted = blocks[i], read_block(path, int(blocks[i]))
                    wanted = {} if wanted is None else dict(zip(wanted["row"].to_pylist(), wanted["root"].to_pylist()))
                kept = [x for x in range(i, j) if int(rows[x]) in wanted]
                if kept:
                    found = batch.take(pa.array(kept))
                    roots = pa.array([wanted[int(rows[x])] for x in kept], pa.int64())
                    yield pa.RecordBatch.from_arrays([found.column("content"), roots, found.column("codes")], ["content", "root", "codes"])

    return base.select("row", "block", "content", "codes").mapInArrow(pick, "content binary, root long, codes binary")


def starred(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of one text of each bucket `value` with every other; with a column `root`, only with those of other roots."""
    if "root" in members.columns:
        lead = members.groupBy("value").agg(F.min(F.struct(F.xxhash64("content", "value"), "content", "root")).alias("lead"))
        other = F.col("root") != F.col("lead.root")
    else:
        lead = members.groupBy("value").agg(F.min(F.struct("doc_id", "content")).alias("lead"))
        other = F.col("content") != F.col("lead.content")
    return members.join(lead, "value").where(other).select(F.col("lead.content").alias("a"), F.col("content").alias("b")).distinct()


def still_mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members, with their root, of buckets that hold several components."""
    placed = members.join(roots, F.col("content") == F.col("node"), "left").withColumn("root", F.coalesce("root", "content")).drop("node")
    mixed = placed.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
    return materialize(placed.join(mixed, "value"), "mixed")


def with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots with further links, in place of the table they are in."""
    if links.isEmpty():
        return roots
    out = materialize(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)), "roots")
    discard(roots)
    return out


def numbered_classes(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """content, class_id and class_content (the class's smallest document) of each text."""
    of_text = texts.select("content", "doc_id").join(roots, F.col("content") == F.col("node"), "left").withColumn("root", F.coalesce("root", "content"))
    classes = materialize(of_text.groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("first"), F.count("*").alias("n")).where("n > 1"), "classes")
    most = max(1000, (classes.agg(F.sum("n")).first()[0] or 0) // FREQUENT)
    frequent = F.broadcast(classes.where(F.col("n") > most).select("root", F.col("first").alias("known")))
    rare = classes.where(F.col("n") <= most).select(F.col("root").alias("key"), "first")
    dealt = of_text.join(frequent, "root", "left").withColumn("key", F.when(F.col("known").isNull(), F.col("root")).otherwise(F.col("content")))
    first = F.coalesce("known", "first", F.struct("doc_id", "content"))
    out = dealt.join(rare, "key", "left").select("content", first.alias("first"))
    out = materialize(out.select("content", F.col("first.doc_id").alias("class_id"), F.col("first.content").alias("class_content")), "numbers")
    discard(classes)
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, picked: int = 3, sketches: int = 16) -> DataFrame:
    """doc_id, content, n_words, class_id (smallest doc_id of the class) and kept (it is that document) of each row."""
    base = materialize(sketched(docs, k, picked, sketches), "sketches")
    texts = base.where("content IS NOT NULL").groupBy("content")
    texts = texts.agg(F.min("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("sketches").alias("sketches"), F.min(F.struct("row", "block")).alias("at"))
    texts = materialize(texts.select("content", "doc_id", "n_words", "sketches", "at.row", "at.block"), "texts")
    members = texts.select("content", "doc_id", F.posexplode("sketches").alias("slot", "sketch")).select("content", "doc_id", "slot", F.xxhash64("slot", "sketch").alias("value"))
    crowded = members.groupBy("value").agg(F.count("*").alias("n_texts")).where("n_texts > 1").select(F.col("value").alias("shared"))
    members = materialize(members.join(crowded, F.col("value") == F.col("shared")).drop("shared"), "members")

    def codes_for(contents: DataFrame) -> DataFrame:
        rows = texts.select("content", "row", "block").join(contents.distinct(), "content", "left_semi")
        path = write_by_block(rows.select("block", "row", F.lit(0).cast("long").alias("root")), "rows")
        out = materialize(codes_of(base, path).select("content", "codes"), "codes")
        remove(base.sparkSession, path)
        return out

    codes = codes_for(members.select("content"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                most = int((1 - threshold) * max(len(x), len(y)) + 1e-9)
                found.append(count_difference(x, y) <= 2 * most and edit_distance(x, y, most) <= most)
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    def of_like_size(pairs: DataFrame) -> DataFrame:
        size = texts.select("content", "n_words")
        pairs = pairs.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b")
        return pairs.where(F.abs(F.col("n_a") - F.col("n_b")) <= (1 - threshold) * F.greatest("n_a", "n_b") + 1e-9).select("a", "b")

    def linked(pairs: DataFrame, codes: DataFrame) -> DataFrame:
        both = pairs.join(codes.toDF("a", "codes_a"), "a").join(codes.toDF("b", "codes_b"), "b").select("a", "b", "codes_a", "codes_b")
        return materialize(both.mapInArrow(verify, "a binary, b binary"), "links")

    links = linked(of_like_size(starred(members)), codes)
    roots = materialize(components(links), "roots")
    discard(links)
    mixed, equal = still_mixed(members, roots), 1  # what shares a sketch but no component yet
    discard(members)
    while equal < sketches and not mixed.isEmpty():
        equal = min(2 * equal, sketches)
        finer = mixed if equal > 2 else mixed.join(texts.select("content", "sketches"), "content").withColumn("step", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
        chosen = [F.element_at("sketches", F.pmod(F.col("slot") + i * F.col("step"), F.lit(sketches)) + 1) for i in range(equal)]
        finer = materialize(finer.withColumn("value", F.xxhash64("slot", "step", *chosen)), "finer")
        discard(mixed)
        links = linked(of_like_size(starred(finer)), codes)
        roots = with_links(roots, links)
        mixed = still_mixed(finer.drop("root"), roots)
        for table in (links, finer):
            discard(table)
    discard(mixed)
    discard(codes)
    placed = texts.join(roots, F.col("content") == F.col("node"), "left").select("block", "row", F.xxhash64(F.coalesce("root", "content")).alias("root"))
    path = write_by_block(placed, "placed")
    packs = materialize(packed(codes_of(base, path)), "packs")
    remove(base.sparkSession, path)
    pairs = candidates(packs, texts.agg(F.sum("n_words")).first()[0] or 0, threshold)
    discard(packs)
    codes = codes_for(pairs.select(F.explode(F.array("a", "b")).alias("content")))
    links = linked(pairs, codes)
    roots = with_links(roots, links)
    of_text = numbered_classes(texts, roots)
    for table in (links, pairs, codes, roots, texts):
        discard(table)
    slim = materialize(base.select("doc_id", "content", "n_words"), "documents")
    discard(base)
    own = slim.join(of_text, "content", "left")
    alone = F.col("content").isNull()
    return own.select("doc_id", "content", "n_words", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("content") == F.col("class_content")))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents, of each class only the first; rows that repeat a document go too."""
    kept = near_duplicates(docs, threshold).where("kept AND content IS NOT NULL").select(F.col("doc_id").alias("__doc"), F.col("content").alias("__content")).distinct()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCodes()
        for batch in sliced(batches):
            ids = pa.array([content_id(c) for c in text_codes(batch.column("text").to_pylist(), words)], pa.binary())
            yield batch.append_column("__content", ids)

    own = docs.mapInArrow(add, StructType([*docs.schema]).add("__content", BinaryType()))
    without_words = own.where("__content IS NULL")
    chosen = own.where("__content IS NOT NULL").join(kept, (F.col("doc_id").eqNullSafe(F.col("__doc"))) & (own["__content"] == kept["__content"]), "left_semi").dropDuplicates(["doc_id", "__content"])
    return chosen.unionByName(without_words).select(*(f"`{c}`" for c in docs.columns))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "class_id", "kept")

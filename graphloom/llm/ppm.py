"""Operator 7: scoring documents with prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to `order` bytes with the counts of the byte that followed, gathered over all training
documents. No context is left out. A byte seen c times of n in a context gets (1 - e) c / n there; the rest, e, is the escape,
shared among the bytes not seen in that context in proportion to what the context shorter by one byte gives them: symbols
already seen are excluded. Below the empty context all 256 byte values are alike. Every context's probabilities sum to 1.

The escape is estimated from all contexts of the same order and shape (n and the number d of distinct bytes, in steps of half an
octave): each occurrence in turn is left out, and e is the share of them that would be new to the context as it is without them.

Texts begin after `order` bytes 0xFE and end with 0xFF, neither of which occurs in UTF-8; the end counts.

Nothing of the trie passes through the driver or is held whole by a task. Documents are numbered in blocks; a block's distinct
grams (a byte and its context) meet the trie in joins, order by order, and each block gets the log probabilities of its own
grams as files of the shared folder. A task that scores holds those of one block.

The base score needs the count of each word. The `head` most frequent words, a fixed number, go to every task as a file; the
words beyond meet their counts in a shuffle join, once for each document and word.

Nulls and odd input: a null text is empty: one token, the end. A null doc_id is not held out. Repeated rows are scored (and
learned from) each by itself. Extra columns pass, but for those named as the result's. Without training documents V and N are 0,
base scores use (0.5 / 0.5) and the model is uniform. An empty table gives no rows.
"""

from __future__ import annotations

import io
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, held_out, in_blocks, materialize, open_shared, read_block, remove, shared_dir, sliced, write_by_block

START, END = b"\xfe", b"\xff"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z, nothing else


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def grams(texts: list[bytes], order: int) -> np.ndarray:
    """Each byte and each end with the `order` bytes before it, packed into one number, the byte last."""
    a = np.frombuffer(b"".join(START * order + t + END for t in texts), np.uint8)
    key = np.zeros(len(a), np.uint64)
    for k in range(order + 1):
        key[k:] |= a[: len(a) - k].astype(np.uint64) << np.uint64(8 * k)
    ends = np.cumsum([len(t) + order + 1 for t in texts])
    keep = np.ones(len(a), bool)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    for k in range(order):
        keep[begins + k] = False
    return key[keep]


def grams_of_blocks(docs: DataFrame, order: int, most: int = 2_000_000) -> DataFrame:
    """block, key and n of the grams of each block: n counts those of the training documents, and may be 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def out() -> pa.RecordBatch:
            keys, counts = merged()
            return pa.RecordBatch.from_pydict({"block": np.full(len(keys), block), "key": keys.view(np.int64), "n": counts})

        for batch in sliced(batches):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("block", "train", "text"))))
            for b in sorted({r[0] for r in rows}):
                if b != block:
                    if held:
                        yield out()
                    block, held, size = b, [], 0
                for train in (True, False):
                    texts = [lowered(t) for x, own, t in rows if x == b and own == train]
                    if texts:
                        keys, n = np.unique(grams(texts, order), return_counts=True)
                        held.append((keys, n if train else np.zeros(len(n), np.int64)))
                        size += len(keys)
                if size > most:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > most // 2:  # a block of unusually varied texts gives its grams in parts
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return docs.select("block", "train", "text").mapInArrow(count, "block long, key long, n long")


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), count: first within the tasks, then by a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})
        for batch in sliced(batches):
            for t in batch.column(0).to_pylist():
                counts.update(lowered(t).split())
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shape(n: Column, d: Column) -> Column:
    """The bucket of a context that n bytes followed, d of them distinct: both in steps of half an octave."""
    half_octaves = lambda x: F.length(F.bin(F.least(x, F.lit(1 << 31)) * F.least(x, F.lit(1 << 31))))
    return half_octaves(n) * 64 + half_octaves(d)


def trie_levels(of_blocks: DataFrame, order: int) -> list[DataFrame]:
    """For each order from 0: key, n of every gram, with total and d of its context and the context's escape."""
    full = materialize(of_blocks.groupBy("key").agg(F.sum("n").alias("n")), "grams")
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")) for k in range(order + 1)]))
    by_order = full.select(orders.alias("g"), "n").groupBy(F.col("g.k").alias("k"), F.col("g.key").alias("key")).agg(F.sum("n").alias("n"))
    context = Window.partitionBy("k", "context")  # at most 256 rows
    by_order = by_order.withColumn("context", F.shiftright("key", 8)).withColumn("total", F.sum("n").over(context)).withColumn("d", F.count_if(F.col("n") > 0).over(context))
    by_order = materialize(by_order, "trie")
    discard(full)
    # one occurrence left out: the context has one byte less, and one distinct byte less if it was the only one
    once = (F.col("n") == 1).cast("long")
    left_out = by_order.where("n > 0 AND total > 1").groupBy("k", shape(F.col("total") - 1, F.greatest(F.col("d") - once, F.lit(1))).alias("shape")).agg(F.sum(once).alias("new"), F.sum("n").alias("all"))
    escapes = left_out.select("k", "shape", F.least(F.greatest((F.col("new") + 0.5) / (F.col("all") + 1), F.lit(1e-6)), F.lit(0.999)).alias("escape"))
    # at most 64 x 64 shapes an order
    known = by_order.withColumn("shape", shape(F.col("total"), F.col("d"))).join(F.broadcast(escapes), ["k", "shape"], "left").withColumn("escape", F.coalesce("escape", F.lit(0.5)))
    return [known.where(F.col("k") == k).select("key", "context", "n", "total", "escape") for k in range(order + 1)]


def log_probabilities(of_blocks: DataFrame, order: int) -> DataFrame:
    """key, log_p: log10 of the probability of each gram's byte after its context."""
    below, context = None, Window.partitionBy("context")
    for k, level in enumerate(trie_levels(of_blocks, order)):
        level = level.withColumn("own", F.when(F.col("n") > 0, (1 - F.col("escape")) * F.col("n") / F.col("total")))
        if below is None:
            level = level.withColumn("shorter", F.lit(1 / 256)).withColumn("log_shorter", F.lit(math.log10(1 / 256)))
        else:
            level = level.withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * k) - 1)).join(below, "suffix")
        unseen = 1 - F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("shorter"))).over(context), F.lit(0.0))
        escaped = F.when(F.col("total") > 0, F.log10(F.col("escape") / F.col("unseen"))).otherwise(0.0)
        level = level.withColumn("unseen", unseen).select("key", "own", F.when(F.col("n") > 0, F.log10("own")).otherwise(escaped + F.col("log_shorter")).alias("log_p"))
        # a byte not seen in the suffix isn't seen in the context either, so its `own` is never asked for
        below = level.select(F.col("key").alias("suffix"), F.col("own").alias("shorter"), F.col("log_p").alias("log_shorter"))
    return level.select("key", F.col("log_p").cast("float").alias("log_p"))


def write_models(of_blocks: DataFrame, order: int) -> str:
    """A folder with, for each block, the log probabilities of its grams."""
    log_p = materialize(log_probabilities(of_blocks, order), "log_p")
    path = write_by_block(of_blocks.select("block", "key").join(log_p, "key"), "ppm")
    discard(log_p)
    return path


class BlockModel:
    """The log probabilities of one block's grams."""

    def __init__(self, path: str, block: int, order: int):
        table = read_block(path, block)
        key, log_p = table["key"].to_numpy().view(np.uint64), table["log_p"].to_numpy()
        self.key, first = np.unique(key, return_index=True)
        self.log_p, self.order = log_p[first].astype(np.float64), order

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        wanted = grams(texts, self.order)
        at = np.searchsorted(self.key, wanted)
        if len(wanted) and (at[np.argmax(at)] == len(self.key) or (self.key[at] != wanted).any()):
            raise ValueError("a text has a gram that its block's model lacks")
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        return np.add.reduceat(self.log_p[at], begins)


_loaded: dict[str, dict[bytes, float]] = {}


def read_head(uri: str) -> dict[bytes, float]:
    """word -> log10 of its count and a half, read once by each worker process."""
    if uri not in _loaded:
        _loaded.clear()
        files, path = open_shared(uri)
        with files.open_input_stream(path) as f:
            t = pq.read_table(io.BytesIO(f.read()))
        _loaded[uri] = dict(zip(t["word"].to_pylist(), np.log10(t["n"].to_numpy() + 0.5).tolist()))
    return _loaded[uri]


RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_documents(docs: DataFrame, held: Column, order: int = 5, head: int = 131_072) -> DataFrame:
    """doc_id, text -> held_out, n_tokens, n_known, train_tokens, base_score and score of each row; other columns pass.

    Rows for which `held` is true aren't learned from."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in (*RESULT, "held_out", "text")]
    docs = in_blocks(docs.select(F.struct(*keep).alias("kept"), (~held).alias("train"), "text"))
    of_blocks = materialize(grams_of_blocks(docs, order), "block_grams")
    models = write_models(of_blocks, order)
    discard(of_blocks)
    train = docs.where("train")
    words = materialize(count_words(train), "words")
    n_train = train.count()
    distinct, tokens = words.agg(F.count("*"), F.sum("n")).first()
    n_all, n_distinct = (tokens or 0) + n_train, distinct + (n_train > 0)
    below = math.log10(n_all + 0.5 * (n_distinct + 1))
    end_log = math.log10(n_train + 0.5)
    top = words.orderBy(F.desc("n"), "word").limit(head).toArrow()  # at most `head` words
    head_file = f"{shared_dir(spark, 'words')}.head"
    files, path = open_shared(head_file)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as f:
        pq.write_table(top, f)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_log = read_head(head_file)
        model, of_block = None, None
        for batch in sliced(batches):
            blocks = batch.column("block").to_numpy()
            texts = [lowered(t) for t in batch.column("text").to_pylist()]
            scores = np.zeros(len(texts))
            for b in np.unique(blocks).tolist():
                if b != of_block:
                    model = None  # the one before it goes first
                    model, of_block = BlockModel(models, b, order), b
                rows = np.flatnonzero(blocks == b)
                scores[rows] = model.score([texts[i] for i in rows.tolist()])
            n_tokens, n_known, base, beyond = [], [], [], []
            for t in texts:
                own = t.split()
                logs = list(map(known_log.get, own))
                rest = Counter([w for w, x in zip(own, logs) if x is None]) if None in logs else {}
                n = len(own) - sum(rest.values())
                n_tokens.append(len(own) + 1)
                n_known.append(n + (n_train > 0))
                base.append(math.fsum(x for x in logs if x is not None) + end_log - below * (len(own) + 1))
                beyond.append(list(rest.items()))
            new = {"row": batch.column("row"), "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": scores, "beyond": pa.array(beyond, pa.map_(pa.binary(), pa.int64()))}
            yield pa.RecordBatch.from_pydict(new)

    scored = materialize(docs.select("row", "block", "text").mapInArrow(score, "row long, n_tokens long, n_known long, base_score double, score double, beyond map<binary,bigint>"), "scored")
    remove(spark, models)
    if distinct <= head:  # every training word is in the head: all others are unknown
        rest = F.aggregate(F.map_values("beyond"), F.lit(0).cast("long"), lambda a, x: a + x)
        scored = scored.withColumn("base_score", F.col("base_score") + F.lit(math.log10(0.5)) * rest).drop("beyond")
    else:
        of_row = scored.select("row", F.explode("beyond").alias("word", "uses")).join(words.withColumnRenamed("n", "c"), "word", "left")
        of_row = of_row.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("uses")).otherwise(0)).alias("known"), F.sum(F.col("uses") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"))
        scored = scored.drop("beyond").join(of_row, "row", "left")
        scored = scored.withColumn("n_known", F.col("n_known") + F.coalesce("known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("logs", F.lit(0.0)))
    scored = scored.join(docs.select("row", "kept", (~F.col("train")).alias("held_out")), "row").withColumn("train_tokens", F.lit(n_all).cast("long"))
    return scored.select(*[F.col("kept").getField(c).alias(c) for c in keep], "held_out", *RESULT)


def op7_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; those whose crc32 leaves 1 modulo 5 are held out of the training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, held_out(F.col("doc_id"), 5, 1))

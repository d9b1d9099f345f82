"""Operator 6: token-id files with Elias-Fano coded document boundaries.

A dataset is a folder of shards, in ascending doc_id order across shards. Shard i has two files:

* ``i.ids``: the token ids of its documents one after another, little-endian, 16 bits each if the vocabulary allows, else 32;
* ``i.ef``: two Elias-Fano coded sequences, the documents' end offsets in ``i.ids`` and their doc_ids (less the smallest).

An Elias-Fano sequence of n values below u takes about n * (2 + log2(u/n)) bits: the low bits of each value are packed, the
high bits are unary in a bit vector. ``select`` finds the i-th one with one sampled position for 256 ones, so an offset is
read without a table of 64-bit offsets.

Nulls and odd input: a null text is an empty text (only the end id); an empty text likewise. Null doc_ids come first, in
text order. Repeated doc_ids are separate documents, ordered by text. Extra columns are ignored. An empty table gives no
shard and no rows. Shards are written under a temporary name and renamed, so a task that is run again is harmless.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_shared, shared_dir, shuffle_partitions, sliced
from .tokens import encoder

SAMPLE = 256  # ones between two sampled positions of select
HEAD = "<QQB"  # values, largest value, low bits


class EliasFano:
    """A sequence of ascending non-negative integers in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.add.accumulate(np.bitwise_count(high), dtype=np.int64)  # ones up to each byte
        want = np.arange(0, n, SAMPLE)
        self.samples = np.searchsorted(ones, want, side="right").astype(np.uint32)  # byte that holds the sampled one
        self.before = (ones[self.samples] - np.bitwise_count(high)[self.samples]).astype(np.uint32) if n else np.zeros(0, np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n and top // n else 0
        low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, np.packbits(low.ravel()), np.packbits(bits))

    def select(self, i: int) -> int:
        """Position of the i-th one of the high bits."""
        k = i // SAMPLE
        byte, seen = int(self.samples[k]), int(self.before[k])
        while True:
            here = int(self.high[byte]).bit_count()
            if seen + here > i:
                return byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1]))[i - seen])
            seen, byte = seen + here, byte + 1

    def __getitem__(self, i: int) -> int:
        at, low = i * self.low_bits, 0
        if self.low_bits:
            a, b = at // 8, (at + self.low_bits + 7) // 8
            bits = np.unpackbits(self.low[a:b])[at - 8 * a :][: self.low_bits]
            low = int((bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum())
        return ((self.select(i) - i) << self.low_bits) | low

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The values from start to stop (not included)."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        first, last = self.select(start), self.select(stop - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[first // 8 : last // 8 + 1])) + first // 8 * 8
        ones = ones[(ones >= first) & (ones <= last)]
        high = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        a = start * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (stop * self.low_bits + 7) // 8])[a % 8 :][: (stop - start) * self.low_bits]
        return high | (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def to_bytes(self) -> bytes:
        return struct.pack(HEAD, self.n, len(self.low), self.low_bits) + struct.pack("<Q", len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, n_low, low_bits = struct.unpack_from(HEAD, data, at)
        (n_high,) = struct.unpack_from("<Q", data, at := at + struct.calcsize(HEAD))
        at += 8
        low = np.frombuffer(data, np.uint8, n_low, at)
        return cls(n, low_bits, low, np.frombuffer(data, np.uint8, n_high, at + n_low)), at + n_low + n_high


SHARD = "<4sBQQq"  # magic, bytes of an id, documents, of these with a null doc_id, smallest doc_id


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, partitions: int | None = None) -> list[tuple[int, int, int]]:
    """Encode (doc_id, text) and write the shards below `path`; returns (shard, documents, ids) of each, a few numbers a shard."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = open_shared(path)
        files.create_dir(base, recursive=True)
        coder = encoder(tokenizer)
        width = "<u2" if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        ends, ids, total, out = [], [], 0, None
        name = f"{base}/{task.partitionId():06d}"
        part = f".{task.taskAttemptId()}.tmp"
        for batch in sliced(batches):
            out = out or files.open_output_stream(f"{name}.ids{part}")
            ids += batch.column(0).to_pylist()
            for got in coder.encode([t or "" for t in batch.column(1).to_pylist()]):
                tokens = np.append(np.frombuffer(got, "<u4"), np.uint32(end_id)).astype(width)
                out.write(tokens.tobytes())
                total += len(tokens)
                ends.append(total)
        if out is None:
            return
        out.close()
        nulls = sum(i is None for i in ids)
        known = np.array(ids[nulls:], np.int64)
        least = int(known[0]) if len(known) else 0
        with files.open_output_stream(f"{name}.ef{part}") as f:
            f.write(struct.pack(SHARD, b"GLEF", int(width[-1]), len(ids), nulls, least))
            f.write(EliasFano.encode(np.array(ends)).to_bytes())
            f.write(EliasFano.encode((known - least).astype(np.uint64)).to_bytes())
        for kind in ("ids", "ef"):
            files.move(f"{name}.{kind}{part}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "documents": [len(ids)], "ids": [total]})

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(write, "shard long, documents long, ids long").collect()
    return sorted((r.shard, r.documents, r.ids) for r in shards)


def read_token_files(spark: SparkSession, path: str, shards: list[tuple[int, int, int]], batch: int = 256) -> DataFrame:
    """Documents of the shards, from the files alone: doc_id, start (ids of all documents before), n_tokens, ids (32-bit bytes)."""
    starts = np.cumsum([0, *(s[2] for s in shards)])[:-1].tolist()
    table = spark.createDataFrame([(s[0], b) for s, b in zip(shards, starts)], "shard long, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_shared(path)
        for rows in batches:
            for shard, first in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                with files.open_input_stream(f"{base}/{shard:06d}.ef") as f:
                    data = f.read()
                magic, width, n, nulls, least = struct.unpack_from(SHARD, data)
                if magic != b"GLEF":
                    raise ValueError(f"{base}/{shard:06d}.ef is not a boundary file")
                ends, at = EliasFano.from_bytes(data, struct.calcsize(SHARD))
                keys, _ = EliasFano.from_bytes(data, at)
                with files.open_input_stream(f"{base}/{shard:06d}.ids") as f:
                    before = 0
                    for a in range(0, n, batch):
                        b = min(a + batch, n)
                        stops = ends.slice(a, b).astype(np.int64)
                        known = (keys.slice(max(a, nulls) - nulls, max(b, nulls) - nulls).astype(np.int64) + least).tolist()
                        begins = np.concatenate(([before], stops[:-1]))
                        block = np.frombuffer(f.read(int(stops[-1] - before) * width), f"<u{width}").astype("<u4")
                        got = [block[x - before : y - before].tobytes() for x, y in zip(begins, stops)]
                        before = int(stops[-1])
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None] * (b - a - len(known)) + known, pa.int64()), "start": begins + first, "n_tokens": stops - begins, "ids": pa.array(got, pa.binary())})

    tasks = max(1, min(len(shards), shuffle_partitions(spark)))
    return table.repartitionByRange(tasks, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to token files and read back."""
    import public_tokenizers

    path = shared_dir(spark, "token_files")
    shards = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

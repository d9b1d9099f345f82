"""What the operators of this package share: the shared folder, written tables, files and hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: str | None = None


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. Where that is unset, a temporary folder serves a
    local session, whose executors are this machine; on a cluster it is an error."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_root = _own_root or tempfile.mkdtemp(prefix="graphloom-")
        root = f"file://{_own_root}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs neither recompute it nor depend on an executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path  # so that discard() can remove it once nothing reads it
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that are over: it does when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() wrote."""
    remove(df.sparkSession, df._written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches of whole texts (which Spark bounds by bytes) in pieces of at most `rows` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def in_blocks(docs: DataFrame, rows: int = 8192) -> DataFrame:
    """The documents with a number of their `row` and of its `block` of at most `rows` rows, written down so that both stay.

    What a block's rows need from elsewhere can be written as files by block and be read by the task that has the block, which
    spares the texts a shuffle."""
    numbered = docs.withColumn("row", F.monotonically_increasing_id())  # partition, then 33 bits of place in it
    return materialize(numbered.withColumn("block", F.floor(F.col("row") / rows).cast("long")), "blocks")


def write_by_block(df: DataFrame, name: str) -> str:
    """A folder with the rows of each block; the block is the column `block`."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block").write.partitionBy("block").option("compression", "zstd").parquet(path)
    return path


def read_block(path: str, block: int) -> pa.Table | None:
    """What write_by_block() wrote for a block; None if that is nothing."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileType

    files, base = open_shared(f"{path}/block={block}")
    if files.get_file_info(base).type == FileType.NotFound:
        return None
    return pq.read_table(base, filesystem=files, use_threads=False, partitioning=None)


def open_shared(uri: str):
    """(file system, path) of a URI, for tasks that read or write files of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads hashes or packed symbols evenly."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordCodes(dict):
    """Word -> 32-bit code as four bytes, computed once a word; emptied when large, as it is only a memo."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> bytes:
        import xxhash

        code = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")).to_bytes(4, "little")
        return code

    def encode(self, words: list[str]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint32)


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of `size` codes (none if there are fewer)."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return mix64(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the leftmost minimum of some window of `width` values (all windows, or the whole if shorter)."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    if n <= width:
        return np.array([int(np.argmin(h))])
    # sparse-table minimum: doubling spans, then two overlapping spans make a window
    at, span = np.arange(n), 1
    while span * 2 <= width:
        left, right = at[: len(at) - span], at[span:]
        at = np.where(h[right] < h[left], right, left)
        span *= 2
    m = n - width + 1
    left, right = at[:m], at[width - span : width - span + m]
    return np.unique(np.where(h[right] < h[left], right, left))


def batch_minima(codes: list[np.ndarray], k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts at once: text, position and hash of the k-word shingles that are the leftmost minimum of a window of theirs."""
    sizes = np.array([len(c) for c in codes], np.int64)
    total = int(sizes.sum())
    if total < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begins = np.cumsum(np.concatenate(([0], sizes[:-1])))
    h = shingles(np.concatenate(codes), k)
    n = sizes - k + 1  # shingles of each text
    at, low, span = np.arange(len(h)), h, 1
    while span * 2 <= width:
        right = low[span:] < low[:-span]
        at, low = np.where(right, at[span:], at[:-span]), np.where(right, low[span:], low[:-span])
        span *= 2
    m, shift = len(h) - width + 1, width - span
    chosen = [np.array([b + int(np.argmin(h[b : b + x]))]) for b, x in zip(begins[(n > 0) & (n < width)].tolist(), n[(n > 0) & (n < width)].tolist())]
    if m > 0:
        at = np.where(low[shift : shift + m] < low[:m], at[shift : shift + m], at[:m])
        edges = np.zeros(m + 1, np.int64)
        long = n >= width
        np.add.at(edges, begins[long], 1)
        np.add.at(edges, begins[long] + n[long] - width + 1, -1)
        chosen.append(np.unique(at[np.cumsum(edges[:-1]) > 0]))
    found = np.sort(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
    text = np.searchsorted(begins, found, side="right") - 1
    return text, found - begins[text], h[found]

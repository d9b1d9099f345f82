"""Candidates for links that sketches left out: every pair of texts in different classes that may be within the edit distance.

A text a of n words and one no longer that it is linked with are at most `t` edits apart, t = (1 - threshold) * n. Of any t + 1 windows
of a that don't overlap one at least is untouched, so it stands in the other text, at most t words away from its place in a. A
window that occurs in no other class needs no look: a text with t + 1 such windows (most have them) has no such partner at all. Of the
others those t + 1 windows are looked up that the fewest texts of other classes have. That is exact: no pair is left out, whatever the
number of windows or texts that share one. Texts that share a window meet once for it, however often they repeat it, and only if
the parities of their words' numbers, folded to `PARITIES` bits (an edit turns two at most), and their lengths and places allow a link.

Windows are three words long, or shorter where n words don't hold t + 1 of three. Texts are put together in packs, whose window hashes
are dealt out by bucket, about `BUCKET` of them each, to find those in several classes. A window's place is not sent along: the answer
has the order in which the pack dealt its windows, and the task that has the pack reads it from a file. A hash that two
windows share only makes a window seem less rare. Classes are told apart by 32 bits of a hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64, read_block, remove, shingles, shuffle_partitions, write_by_block


LONGEST = 3  # words of a window
PACK, BUCKET = 1_000_000, 1_000_000  # words of a pack and windows of a bucket, about
PARITIES = 256
PACK_TYPE = "pack long, contents binary, roots binary, sizes binary, codes binary"
DEALT_TYPE = "width int, bucket int, pack long, hashes binary, roots binary, lengths binary"
SHARED_TYPE = "width int, bucket int, pack long, levels binary, hashes binary"
MET_TYPE = "width int, bucket int, pack long, hashes binary"
BITS = [f"bits{i}" for i in range(PARITIES // 64)]
WINDOW_COLUMNS = ["width", "bucket", "hash", "content", "root", "n_words", "low", "high", *BITS]
WINDOW_TYPE = "width int, bucket int, hash long, content binary, root long, n_words int, low int, high int, " + ", ".join(f"{b} long" for b in BITS)


def most_edits(n: int, threshold: float) -> int:
    return int((1 - threshold) * n + 1e-9)


def width_of(n: int, threshold: float) -> int:
    """Words of the windows that a text of n words looks up; 0 if no other text can be linked with it that isn't longer."""
    edits = most_edits(n, threshold)
    return min(LONGEST, max(1, n // (edits + 1))) if edits else 0


@lru_cache(100_000)
def widths_met(n: int, threshold: float) -> frozenset[int]:
    """Words of the windows by which texts of n words and longer ones may look for it."""
    longest = int(n / threshold + 1e-9) + 1
    return frozenset(width_of(m, threshold) for m in range(n, longest + 1)) - {0}


def rows_of(rows: list[tuple], kind: str) -> pa.RecordBatch:
    """The rows as a batch of the columns of `kind`."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in kind.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], [name for name, _ in fields])


class Pack:
    """Texts of about PACK words: their contents, classes, sizes and codes."""

    def __init__(self, contents: bytes, roots: bytes, sizes: bytes, codes: bytes):
        self.contents, self.roots = contents, np.frombuffer(roots, np.int64)
        self.sizes, self.codes = np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(codes, np.uint32)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def windows(self, width: int, buckets: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, bucket, text and place in the pack of the windows by which a text may be found, by bucket, then place."""
        has = np.array([width in widths_met(n, threshold) for n in self.sizes.tolist()])
        h = shingles(self.codes, width)
        own = self.text[: len(h)]
        places = np.flatnonzero(has[own] & (np.arange(len(h)) + width <= self.ends[own])) if len(h) else np.zeros(0, np.int64)
        h = h[places]
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        places = places[order]
        return h[order].astype(np.uint32), bucket[order], self.text[places], places

    def rows(self, width: int, found: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
        """Rows of WINDOW_TYPE for (text, bucket, hash, lowest place, highest place)."""
        texts = sorted({t for t, *_ in found})
        bits = {t: np.packbits(np.bincount(self.codes[self.starts[t] : self.ends[t]] % PARITIES, minlength=PARITIES).astype(np.uint8) & 1).view(np.int64).tolist() for t in texts}
        rows = [(width, b, h, self.contents[16 * t : 16 * t + 16], int(self.roots[t]), int(self.sizes[t]), low, high, *bits[t]) for t, b, h, low, high in found]
        return rows_of(rows, WINDOW_TYPE)


def packed(texts: DataFrame) -> DataFrame:
    """texts (content, root, codes) in rows of about PACK words."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0

        def row() -> pa.RecordBatch:
            contents, roots, codes = zip(*held)
            number = int.from_bytes(contents[0][:8], "little", signed=True)  # contents are distinct, so is the first of a pack
            return rows_of([(number, b"".join(contents), np.array(roots, np.int64).tobytes(), np.array([len(c) // 4 for c in codes], np.int32).tobytes(), b"".join(codes))], PACK_TYPE)

        for batch in batches:
            for text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append(text)
                words += len(text[2]) // 4
                if words >= PACK:
                    yield row()
                    held, words = [], 0
        if held:
            yield row()

    return texts.select("content", "root", "codes").mapInArrow(pack, PACK_TYPE)


def packs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Pack]]:
    for batch in batches:
        for number, *columns in zip(*(batch.column(i).to_pylist() for i in range(5))):
            yield number, Pack(*columns)


def dealt(packs: DataFrame, buckets: int, threshold: float) -> DataFrame:
    """The windows of each pack by bucket: hashes, and for each run of windows in one text its class and length."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, pack in packs_of(batches):
            roots = mix64(pack.roots.view(np.uint64)).astype(np.uint32)
            for width in range(1, LONGEST + 1):
                h, bucket, own, _ = pack.windows(width, buckets, threshold)
                if not len(h):
                    continue
                cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])).tolist()
                rows = []
                for i, j in zip(cuts[:-1], cuts[1:]):
                    runs = np.concatenate(([0], np.flatnonzero(own[i + 1 : j] != own[i : j - 1]) + 1))
                    lengths = np.diff(np.append(runs, j - i)).astype(np.uint32)
                    rows.append((width, int(bucket[i]), number, h[i:j].tobytes(), roots[own[i:j][runs]].tobytes(), lengths.tobytes()))
                yield rows_of(rows, DEALT_TYPE)

    return packs.mapInArrow(deal, DEALT_TYPE)


def joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows and how many each row has."""
    rows = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(rows) if rows else np.zeros(0, kind), np.array([len(x) for x in rows], np.int64)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def levels_of(h: np.ndarray, text: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of each window the logarithm, rounded up, of how many texts of other classes have it, at least 1; 0 if none has. `text` ascends."""
    level = np.zeros(len(h), np.uint8)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(changes(h[order]))
    several = np.minimum.reduceat(root[order], first) != np.maximum.reduceat(root[order], first)
    order = order[np.repeat(several, np.diff(np.append(first, len(h))))]
    if not len(order):
        return level
    group = np.cumsum(changes(h[order])) - 1
    once = changes(group, text[order])  # a text counts once for a window
    n_texts = np.bincount(group, once)
    by_class = np.lexsort((root[order], group))
    part = np.cumsum(changes(group[by_class], root[order][by_class])) - 1
    own = np.bincount(part, once[by_class])
    others = n_texts[group[by_class]] - own[part]
    level[order[by_class]] = np.maximum(np.ceil(np.log2(others)), 1).astype(np.uint8)
    return level


def shared_by_classes(table: pa.Table) -> pa.Table:
    """Of a bucket, by pack: the levels of its windows, in the pack's order, and the hashes of those that occur in several classes."""
    h, of_row = joined(table["hashes"], np.uint32)
    roots, lengths = (joined(table[c], np.uint32)[0] for c in ("roots", "lengths"))
    level = levels_of(h, np.repeat(np.arange(len(roots)), lengths), np.repeat(roots, lengths))
    rows, ends = [], np.cumsum(of_row)
    for width, bucket, pack, i, j in zip(*(table[c].to_pylist() for c in ("width", "bucket", "pack")), (ends - of_row).tolist(), ends.tolist()):
        if level[i:j].any():
            rows.append((width, bucket, pack, zlib.compress(level[i:j].tobytes(), 1), np.unique(h[i:j][level[i:j] > 0]).tobytes()))
    return pa.Table.from_batches([rows_of(rows, SHARED_TYPE)])


def rarest(levels: np.ndarray, width: int, wanted: int) -> list[int]:
    """The places of `wanted` windows that don't overlap, of the least level at which there are so many; those of level 0 are left out."""
    for level in range(int(levels.max()) + 1):
        free, chosen = 0, []
        for p in np.flatnonzero(levels <= level).tolist():
            if p >= free:
                chosen.append(p)
                free = p + width
        if len(chosen) >= wanted:
            break
    chosen.sort(key=lambda p: levels[p])
    return [p for p in chosen[:wanted] if levels[p]]


def looked_up(packs: DataFrame, level_files: str, buckets: int, threshold: float) -> DataFrame:
    """The windows that texts look up."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, pack in packs_of(batches):
            answer = read_block(level_files, number)
            if answer is None:
                continue
            levels = {(w, b): zlib.decompress(x) for w, b, x in zip(*(answer[c].to_pylist() for c in ("width", "bucket", "levels")))}
            of_text = np.array([width_of(n, threshold) for n in pack.sizes.tolist()])
            edits = np.array([most_edits(n, threshold) for n in pack.sizes.tolist()])
            for width in range(1, LONGEST + 1):
                if not any(w == width for w, _ in levels):
                    continue
                h, bucket, own, places = pack.windows(width, buckets, threshold)
                cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])).tolist()
                level = np.zeros(len(h), np.uint8)
                for i, j in zip(cuts[:-1], cuts[1:]):
                    if (width, int(bucket[i])) in levels:
                        level[i:j] = np.frombuffer(levels[width, int(bucket[i])], np.uint8)
                n_shared = np.bincount(own, level > 0, minlength=len(pack.sizes))
                # with so many windows of no other class, `wanted` of them don't overlap
                asking = np.flatnonzero((of_text == width) & (pack.sizes - width + 1 - n_shared <= width * edits))
                if not len(asking):
                    continue
                at_place, row_at = np.zeros(len(pack.codes), np.uint8), np.zeros(len(pack.codes), np.int64)
                at_place[places], row_at[places] = level, np.arange(len(places))
                found: dict[tuple[int, int, int], list[int]] = {}
                for t in asking.tolist():
                    start = int(pack.starts[t])
                    for p in rarest(at_place[start : int(pack.ends[t]) - width + 1], width, int(edits[t]) + 1):
                        row = row_at[start + p]
                        found.setdefault((t, int(bucket[row]), int(h[row])), []).append(p)
                yield pack.rows(width, [(*key, min(at), max(at)) for key, at in found.items()])

    return packs.mapInArrow(choose, WINDOW_TYPE)


def asked_for(shared: pa.Table, asked: pa.Table) -> pa.Table:
    """Of a bucket, by pack, the shared windows that some text looks up."""
    wanted, rows = np.unique(asked["hash"].to_numpy()), []
    for width, bucket, pack, hashes in zip(*(shared[c].to_pylist() for c in ("width", "bucket", "pack", "hashes"))):
        h = np.frombuffer(hashes, np.uint32)
        kept = np.isin(h.astype(np.int64), wanted)
        if kept.any():
            rows.append((width, bucket, pack, h[kept].tobytes()))
    return pa.Table.from_batches([rows_of(rows, MET_TYPE)])


def standing(packs: DataFrame, met_files: str, buckets: int, threshold: float) -> DataFrame:
    """The windows that are looked up, in every text that has them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, pack in packs_of(batches):
            asked = read_block(met_files, number)
            if asked is None:
                continue
            for width in sorted(set(asked["width"].to_pylist())):
                wanted = [(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, np.uint32) for w, b, x in zip(*(asked[c].to_pylist() for c in ("width", "bucket", "hashes"))) if w == width]
                h, bucket, own, places = pack.windows(width, buckets, threshold)
                hit = np.flatnonzero(np.isin((bucket.astype(np.uint64) << np.uint64(32)) | h, np.concatenate(wanted)))
                places = places - pack.starts[own]
                hit = hit[np.lexsort((places[hit], h[hit], own[hit], bucket[hit]))]
                first = np.flatnonzero(changes(bucket[hit], own[hit], h[hit]))
                last = np.append(first[1:], len(hit)) - 1
                low, high = hit[first], hit[last]
                yield pack.rows(width, list(zip(own[low].tolist(), bucket[low].tolist(), h[low].tolist(), places[low].tolist(), places[high].tolist())))

    return packs.mapInArrow(find, WINDOW_TYPE)


def candidates(packs: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """packs, as packed() makes them -> a, b of every pair in different classes that may be linked."""
    buckets = max(shuffle_partitions(packs.sparkSession), n_words // BUCKET + 1)
    shared = materialize(dealt(packs, buckets, threshold).groupBy("width", "bucket").applyInArrow(shared_by_classes, SHARED_TYPE), "shared")
    level_files = write_by_block(shared.select(F.col("pack").alias("block"), "width", "bucket", "levels"), "levels")
    asked = materialize(looked_up(packs, level_files, buckets, threshold), "asked")
    remove(packs.sparkSession, level_files)
    keys = asked.select("width", "bucket", "hash").distinct()
    met = shared.select("width", "bucket", "pack", "hashes").groupBy("width", "bucket").cogroup(keys.groupBy("width", "bucket")).applyInArrow(asked_for, MET_TYPE)
    met_files = write_by_block(met.withColumnRenamed("pack", "block"), "met")
    discard(shared)
    left = asked.select(*(F.col(c).alias(c if c in ("width", "bucket", "hash") else f"{c}_x") for c in WINDOW_COLUMNS))
    right = standing(packs, met_files, buckets, threshold)
    right = right.select(*(F.col(c).alias(c if c in ("width", "bucket", "hash") else f"{c}_y") for c in WINDOW_COLUMNS))
    edits = F.floor((1 - threshold) * F.col("n_words_x") + 1e-9)
    near = (F.col("root_x") != F.col("root_y")) & (F.col("n_words_y") <= F.col("n_words_x")) & (F.col("n_words_x") - F.col("n_words_y") <= edits)
    near &= (F.col("low_y") - F.col("high_x") <= edits) & (F.col("low_x") - F.col("high_y") <= edits)
    near &= sum((F.bit_count(F.col(f"{b}_x").bitwiseXOR(F.col(f"{b}_y"))) for b in BITS[1:]), F.bit_count(F.col(f"{BITS[0]}_x").bitwiseXOR(F.col(f"{BITS[0]}_y")))) <= 2 * edits
    pairs = left.join(right, ["width", "bucket", "hash"]).where(near).select(F.least("content_x", "content_y").alias("a"), F.greatest("content_x", "content_y").alias("b")).distinct()
    pairs = materialize(pairs, "candidates")
    remove(packs.sparkSession, met_files)
    discard(asked)
    return pairs

"""Operator 13: packing by non-negative least squares over combinations of lengths.

Documents longer than a window are cut into whole windows and a rest. How many rests there are of each length is a histogram of at
most `window` numbers, however large the corpus, and the driver plans on it:

* Combinations: all ways to fill a window exactly with one, two or three different lengths that occur, one or two of them
  repeated, three taken once.
* Repeat counts: x >= 0 that minimizes |A x - b|, b being the histogram and A the lengths of the combinations, by an active set
  that grows in blocks of combinations without a common length (Lawson and Hanson); its subproblems by conjugate gradients.
* Rounding: combinations of largest x first, as often as x rounds to and the histogram still allows. What is left is solved again,
  up to `repeats` times.
* Residuals: best fit on the rest of the histogram, of which exactly filled windows stay; the others go, longest first, on one line
  that is cut at window ends. So a window has at most one document cut at its end. The last, partly filled window is dealt
  out to powers of two, which take no padding: no padding is left at all.

Spark deals the pieces into the plan by their rank among the pieces of their length. Ids are kept for rests only, for the checksums of
those that are cut.

Nulls and odd input: a null text is an empty text (one piece: the end id); null and repeated doc_ids are kept, each row is its own
document; extra columns are ignored; an empty table gives no rows. Ties are broken by row.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, sliced
from .packing import GROUP, best_fit_decreasing, deal_out
from .tokens import ODD

#: What the vocabulary's own pattern makes of lower-case text within Latin-1 whose only white space is \n (fixed by the vocabulary).
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|\n|[^\n0-9a-zªµºß-öø-ÿ²³¹¼½¾]+")
END = "</w>"  # how tokens end that end a word


class WordEncoder:
    """encode(texts) gives the ids of each text as little-endian 32-bit bytes, equal to encoding it whole, for a vocabulary that drops
    white space and lowers letters. Each piece between white space is looked at once for a batch of texts, each word encoded once, many at
    a time, told apart by tokens that end a word. `limit` bounds the memo of words; when it is reached it starts anew."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END)]] = True
        self.limit, self.words = limit, {"\n": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_words(self, words: list[str], run: int = 400) -> None:
        runs = [words[i : i + run] for i in range(0, len(words), run)]
        for own, got in zip(runs, self.whole([" ".join(r) for r in runs])):
            cuts = (np.flatnonzero(self.ends[np.frombuffer(got, "<u4")]) + 1) * 4
            if len(cuts) == len(own):
                begins = [0, *cuts.tolist()]
                self.words.update((w, got[a:b]) for w, a, b in zip(own, begins, begins[1:]))
            else:
                self.words.update(zip(own, self.whole(own)))

    def piece_ids(self, pieces: list[str]) -> tuple[bytes, np.ndarray]:
        """The ids of all pieces (without white space) and how many each has. Within Latin-1 they fall into words as the pattern has it;
        other pieces are encoded whole."""
        text = "\n".join(pieces)
        try:
            text.encode("latin-1")
            words = WORD.findall(text.lower())
        except UnicodeEncodeError:
            words = ["\n"] * (2 * len(pieces) - 1)
            words[::2] = [p if max(p) >= "Ā" else WORD.findall(p.lower()) for p in pieces]
            others = list({p for p in words[::2] if isinstance(p, str)} - self.words.keys())
            self.words.update(zip(others, self.whole(others)))
            words = [w for own in words for w in ([own] if isinstance(own, str) else own)]
        self.learn_words(list(set(words) - self.words.keys()))
        ids = list(map(self.words.__getitem__, words))
        of = np.cumsum(np.fromiter(map("\n".__eq__, words), np.int64, len(words)))
        return b"".join(ids), np.bincount(of, np.fromiter(map(len, ids), np.int64, len(ids)), len(pieces)).astype(np.int64) // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.limit:
            self.words = {"\n": b""}
        cut = [[] if ODD.search(t) else t.split() for t in texts]
        pieces = pa.array(itertools.chain.from_iterable(cut), pa.large_string()).dictionary_encode()
        out = [b""] * len(texts)
        if len(pieces):
            data, n = self.piece_ids(pieces.dictionary.to_pylist())
            begins, codes = np.cumsum(n) - n, pieces.indices.to_numpy()
            each = n[codes]
            ends = np.cumsum(each)
            ids = np.frombuffer(data, "<u4")[np.repeat(begins[codes] - ends + each, each) + np.arange(int(ends[-1]))].tobytes()
            at = np.concatenate(([0], ends))[np.cumsum([0, *map(len, cut)])] * 4
            out = [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
        return [self.whole([t])[0] if ODD.search(t) else x for t, x in zip(texts, out)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder, and so one memo, for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECE = "row long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"


def cut_documents(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """PIECE rows: each document's whole windows and its rest, which has its ids too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.uint32(end_id).tobytes()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for batch in sliced(batches):
            rows = []
            for row, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), coder.encode([t or "" for t in batch.column(2).to_pylist()])):
                ids += end
                n = len(ids) // 4
                rest = n - n % window
                rows += [(row, doc_id, a, window, zlib.crc32(ids[4 * a : 4 * (a + window)]), n, None) for a in range(0, rest, window)]
                if rest < n:
                    rows.append((row, doc_id, rest, n - rest, zlib.crc32(ids[4 * rest :]), n, ids[4 * rest :]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def combinations(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths (three a combination, 0 if fewer) and their repeats in every combination that fills a window. counts: by length."""
    present = np.flatnonzero(counts)
    sizes, times = [], []

    def add(a: int, i: int, b: np.ndarray, j: np.ndarray, c: np.ndarray, k: np.ndarray) -> None:
        sizes.append(np.column_stack((np.full(len(b), a), b, c)))
        times.append(np.column_stack((np.full(len(b), i), j, k)))

    none = np.zeros(1, np.int64)
    for a in present.tolist():
        smaller = present[present < a]
        for i in range(1, min(window // a, int(counts[a])) + 1):
            room = window - a * i
            if not room:
                add(a, i, none, none, none, none)
                continue
            b = smaller[(smaller <= room) & (room % np.maximum(smaller, 1) == 0)]
            b = b[room // b <= counts[b]]
            add(a, i, b, room // b, np.zeros_like(b), np.zeros_like(b))
        b, c = smaller, window - a - smaller
        ok = (c > 0) & (c < b)
        b, c = b[ok], c[ok]
        b, c = b[counts[c] > 0], c[counts[c] > 0]
        add(a, 1, b, np.ones_like(b), c, np.ones_like(c))
    return (np.concatenate(sizes), np.concatenate(times)) if sizes else (np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64))


def product(sizes: np.ndarray, times: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """A x: how many pieces of each length x takes."""
    return sum(np.bincount(sizes[:, i], times[:, i] * x, n) for i in range(3))


def gradient(sizes: np.ndarray, times: np.ndarray, left: np.ndarray) -> np.ndarray:
    return sum(times[:, i] * left[sizes[:, i]] for i in range(3))


def least_squares(sizes: np.ndarray, times: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 200) -> np.ndarray:
    """x that minimizes |A x - b|, from a first guess, by conjugate gradients on the normal equations with columns of length 1."""
    norm = np.sqrt((times.astype(float) ** 2).sum(axis=1))
    y, left = x * norm, b - product(sizes, times, x, len(b))
    s = gradient(sizes, times, left) / norm
    p, gamma = s.copy(), float(s @ s)
    enough = 1e-16 * max(gamma, 1e-300)
    for _ in range(steps):
        if gamma <= enough:
            break
        q = product(sizes, times, p / norm, len(b))
        step = gamma / max(float(q @ q), 1e-300)
        y, left = y + step * p, left - step * q
        s = gradient(sizes, times, left) / norm
        gamma, last = float(s @ s), gamma
        p = s + gamma / last * p
    return y / norm


def disjoint(sizes: np.ndarray, score: np.ndarray, n: int, looked: int = 20_000) -> np.ndarray:
    """Of the combinations of highest positive score those without a length that a better one has."""
    best = np.flatnonzero(score > 1e-9)
    best = best[np.argsort(-score[best], kind="stable")][:looked]
    used, out = bytearray(n), []
    for c, (i, j, k) in zip(best.tolist(), sizes[best].tolist()):
        if not (used[i] or (j and used[j]) or (k and used[k])):
            used[i] = used[j] = used[k] = 1
            out.append(c)
    return np.array(out, np.int64)


def nonnegative(sizes: np.ndarray, times: np.ndarray, b: np.ndarray, passes: int = 40, least: float = 1e-4) -> np.ndarray:
    """x >= 0 that minimizes |A x - b|: the active set grows by a block a pass and loses what would turn negative, until a pass gains less
    than `least` of the squared error, or after `passes` of them."""
    x, norm = np.zeros(len(sizes)), np.sqrt((times.astype(float) ** 2).sum(axis=1))
    left = b.astype(float)
    error = float(left @ left)
    for _ in range(passes):
        new = disjoint(sizes, np.where(x > 0, 0, gradient(sizes, times, left) / norm), len(b))
        if not len(new):
            break
        active = np.union1d(np.flatnonzero(x > 0), new)
        z = least_squares(sizes[active], times[active], b, x[active])
        while len(active) and (z <= 0).any():
            active, z = active[z > 0], z[z > 0]
            z = least_squares(sizes[active], times[active], b, z)
        rest = b - product(sizes[active], times[active], z, len(b))
        now = float(rest @ rest)
        if now >= error * (1 - least):
            break
        x, left, error = np.zeros(len(sizes)), rest, now
        x[active] = z
    return x


def plan(counts: dict[int, int], window: int, repeats: int = 3) -> Counter[tuple[int, ...]]:
    """Lengths in one window, descending -> how many such windows; all of them filled exactly. What they leave is for line()."""
    left = np.zeros(window + 1, np.int64)
    left[list(counts)] = list(counts.values())
    out: Counter[tuple[int, ...]] = Counter()
    if left[window]:
        out[(window,)] = int(left[window])
    left[window] = 0

    def take(own: list[int], many: list[int], most: int) -> int:
        used = [(s, k) for s, k in zip(own, many) if k]
        n = min([most, *(int(left[s]) // k for s, k in used)])
        if n:
            for s, k in used:
                left[s] -= n * k
            out[tuple(s for s, k in used for _ in range(k))] += n
        return n

    for _ in range(repeats):
        sizes, times = combinations(left, window)
        x = nonnegative(sizes, times, left.astype(float))
        taken = 0
        for up in (0.5, 0.95):  # rounded; then, where the histogram still allows it, once more for a share of at least a twentieth
            for c in np.argsort(-x, kind="stable").tolist():
                if x[c] < 0.05:
                    break
                n = int(x[c] + up) if up == 0.5 else 1
                if n:
                    taken += take(sizes[c].tolist(), times[c].tolist(), n)
        if not taken:
            break
    for pattern, n in sorted(best_fit_decreasing({s: int(left[s]) for s in np.flatnonzero(left).tolist()}, window).items(), reverse=True):
        if sum(pattern) == window:
            many = Counter(pattern)
            take(list(many), list(many.values()), n)
    return out


def line(counts: dict[int, int], planned: Counter[tuple[int, ...]]) -> dict[int, tuple[int, int]]:
    """For each length with pieces that aren't planned: how many are, and where on the line the others begin, longest first."""
    used = Counter()
    for pattern, n in planned.items():
        for s in pattern:
            used[s] += n
    out, at = {}, 0
    for s in sorted(counts, reverse=True):
        if counts[s] > used[s]:
            out[s] = used[s], at
            at += s * (counts[s] - used[s])
    return out


def marks(total: int, window: int) -> list[int]:
    """Where the line's last sequences begin and end, from its last whole window on: powers of two, the largest first."""
    out = [total - total % window]
    for bit in reversed(range(window.bit_length())):
        if (total % window) >> bit & 1:
            out.append(out[-1] + (1 << bit))
    return out


def rank_pieces(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """The pieces with their rank among those of their length; a length is ranked in groups of about GROUP pieces."""
    salts = pieces.sparkSession.createDataFrame([(size, -(-n // GROUP)) for size, n in counts.items()], "length int, salts long")  # at most a window's rows
    pieces = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.col("salts")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = pieces.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "start")) - 1
    return pieces.withColumn("rank", rank).join(groups, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))


PLACED = "row long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def place(ranked: DataFrame, counts: dict[int, int], planned: Counter[tuple[int, ...]], window: int) -> DataFrame:
    """PLACED rows; those of pieces that are cut have no checksum yet."""
    segments = deal_out(planned).sort_values(["length", "first"], ignore_index=True)
    lined, n_planned = line(counts, planned), planned.total()
    total = sum(s * (counts[s] - used) for s, (used, _) in lined.items())
    last = np.array(marks(total, window))
    whole = int(last[0]) // window
    used, begin = np.full(window + 1, 1 << 62), np.zeros(window + 1, np.int64)
    for s, (u, at) in lined.items():
        used[s], begin[s] = u, at

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span = 1 << 44
        key = (segments["length"].astype("int64") * span + segments["first"].astype("int64")).to_numpy()
        first, bin_, each, place = (segments[c].to_numpy(np.int64) for c in ("first", "bin", "each", "offset"))
        columns = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for x in frames:
            length, rank = x["length"].to_numpy(np.int64), x["rank"].to_numpy(np.int64)
            on_line = rank >= used[length]
            own, size = x.loc[~on_line, columns], length[~on_line]
            if len(own):
                at = np.searchsorted(key, size * span + rank[~on_line], side="right") - 1
                k = rank[~on_line] - first[at]
                yield own.assign(sequence_id=bin_[at] + k // each[at], offset=place[at] + k % each[at] * size)
            own, size = x.loc[on_line, columns], length[on_line]
            if len(own):
                a = begin[size] + (rank[on_line] - used[size]) * size
                b = a + size
                parts, start = [], a.copy()
                while len(own):  # once, and again for those that are cut at the end of a sequence
                    number = np.where(start < last[0], start // window, whole + np.searchsorted(last, start, side="right") - 1)
                    opens = np.where(start < last[0], start // window * window, last[np.minimum(np.maximum(number - whole, 0), len(last) - 1)])
                    ends = np.where(start < last[0], opens + window, last[np.minimum(np.maximum(number - whole, 0) + 1, len(last) - 1)])
                    stop = np.minimum(b, ends)
                    crc = own["ids_crc32"].where((start == a) & (stop == b)).astype("Int64")
                    parts.append(own.assign(start=own["start"] + (start - a), length=stop - start, ids_crc32=crc, sequence_id=n_planned + number, offset=start - opens))
                    more = stop < b
                    own, a, b, start = own[more], a[more], b[more], stop[more]
                yield pd.concat(parts)

    return ranked.select("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInPandas(placed, PLACED)


def checksums(rests: DataFrame, cuts: DataFrame, shipped: int = 200_000) -> DataFrame:
    """The cut pieces with the checksums of their ids. Up to `shipped` of them go to the rests, else both meet by a shuffle."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, starts, lengths = (batch.column(c).to_pylist() for c in ("rest", "start", "length"))
            crc = [zlib.crc32(ids[4 * (s - r) : 4 * (s - r + n)]) for ids, r, s, n in zip(batch.column("ids").to_pylist(), begins, starts, lengths)]
            yield batch.select(["row", "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]).add_column(4, pa.field("ids_crc32", pa.int64()), pa.array(crc, pa.int64()))

    cuts = cuts.drop("ids_crc32")
    own = rests.select("row", F.col("start").alias("rest"), "ids")
    return own.join(F.broadcast(cuts) if cuts.count() <= shipped else cuts, "row").mapInArrow(sums, PLACED)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    pieces = materialize(cut_documents(docs, tokenizer, window, end_id), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most a window's rows
    planned = plan(counts, window)
    ranked = rank_pieces(pieces.drop("ids"), counts)
    placed = materialize(place(ranked, counts, planned, window), "placed")
    cut = checksums(pieces.where("ids IS NOT NULL"), placed.where("ids_crc32 IS NULL"))
    out = materialize(placed.where("ids_crc32 IS NOT NULL").unionByName(cut).drop("row"), "packed")
    discard(pieces)
    discard(placed)
    return out


def op13_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

"""Operator 4: packing tokenized documents into as few fixed-length sequences as possible (best fit, bin completion).

Piece lengths are whole numbers up to the sequence length, so all that matters for the packing is how many pieces have each
length: a histogram of at most `capacity` numbers, however large the corpus. The driver solves that histogram by bin
completion, and Spark deals the pieces into the solution by their rank among the pieces of their length.

Bin completion (branch and bound): take the largest length left, enumerate the fillings of the rest of its bin that no other
filling dominates (A dominates B if B's pieces fit into A's as into bins), branch over them from the least waste, and use
each as often as the histogram allows. A branch ends when its waste exceeds what a solution better than the incumbent may
waste. The incumbent begins as best-fit decreasing; the search ends at the lower bound or after `max_nodes` nodes with the
best solution found. Fillings are looked for within limits too (400 looks, the best 8 of a bin), so a histogram of very many
lengths whose best-fit packing is above the bound may keep a sequence more than the fewest.

Nulls and odd input: a null text is an empty text (one piece: the end id); null and repeated doc_ids are kept, each row is
its own document; extra columns are ignored; an empty table gives no rows. Ties are broken by (doc_id, piece, checksum).
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, sliced
from .tokens import encoder

Pattern = tuple[int, ...]  # lengths in one sequence, descending
GROUP = 50_000  # pieces of one length that are ranked together, about


def cut_into_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; only documents longer than capacity are cut, the first piece takes the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.uint32(end_id).tobytes()
        for batch in sliced(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: the volume bound, sharpened by the pieces over half (Martello and Toth's L2)."""
    total = sum(s * c for s, c in counts.items())
    best = -(-total // capacity)
    for k in {0, *(s for s in counts if s <= capacity // 2)}:
        large = sum(c for s, c in counts.items() if s > capacity - k)
        middle = [(s, c) for s, c in counts.items() if capacity // 2 < s <= capacity - k]
        n_middle = sum(c for _, c in middle)
        small = sum(s * c for s, c in counts.items() if k <= s <= capacity // 2)
        room = n_middle * capacity - sum(s * c for s, c in middle)
        best = max(best, large + n_middle + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing on the histogram: equal pieces move into equal open bins together."""
    open_bins: dict[int, Counter[Pattern]] = {}
    rooms: list[int] = []  # ascending

    def put(pattern: Pattern, room: int, times: int) -> None:
        if room not in open_bins:
            open_bins[room] = Counter()
            bisect.insort(rooms, room)
        open_bins[room][pattern] += times

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):  # no open bin has room: as many to a new bin as fit
                each = capacity // size
                if left >= each:
                    put((size,) * each, capacity - each * size, left // each)
                if left % each:
                    put((size,) * (left % each), capacity - left % each * size, 1)
                break
            room = rooms[i]
            pattern, times = next(iter(open_bins[room].items()))
            each = min(room // size, left)
            use = min(times, left // each)
            open_bins[room][pattern] -= use
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            put(pattern + (size,) * each, room - each * size, use)
            left -= use * each
    return sum(open_bins.values(), Counter())


def fits_into(items: Pattern, bins: Pattern) -> bool:
    """Whether the items can be dealt into bins of these sizes (a few of each)."""
    if not items:
        return True
    return any(items[0] <= b and fits_into(items[1:], (*bins[:i], b - items[0], *bins[i + 1 :])) for i, b in enumerate(bins))


def fillings(counts: dict[int, int], sizes: list[int], room: int, most: int = 8, looks: int = 400) -> list[Pattern]:
    """Undominated fillings of the room, least waste first. sizes: those with a count, ascending. Long fillings end in best fit."""
    found: dict[Pattern, int] = {}
    looked = 0

    def extend(chosen: Pattern, left: int, below: int) -> None:
        nonlocal looked
        i = bisect.bisect_right(sizes, min(left, below)) - 1
        deeper = False
        while i >= 0 and looked < looks and len(found) < 4 * most:
            s = sizes[i]
            if counts[s] > chosen.count(s):
                looked += 1
                deeper = True
                extend((*chosen, s), left - s, s)
                if left == s or len(chosen) >= 3:  # an exact fit, or far down: the largest that fits will do
                    break
            i -= 1
        if not deeper:
            found[chosen] = left

    extend((), room, room)
    ranked = sorted(found, key=lambda f: (found[f], len(f), tuple(-s for s in f)))
    kept: list[Pattern] = []
    for f in ranked:
        if not any(len(g) <= 4 and len(f) <= 6 and fits_into(f, g) for g in kept):
            kept.append(f)
    return kept[:most]


def bin_completion(counts: dict[int, int], capacity: int, max_nodes: int = 4000) -> Counter[Pattern]:
    """Patterns and how often each is used, in as few bins as the search finds."""
    counts = {s: c for s, c in counts.items() if c}
    best = best_fit_decreasing(counts, capacity)
    n_best, least, total = best.total(), lower_bound(counts, capacity), sum(s * c for s, c in counts.items())
    frames: list[tuple] = []  # the branch so far: what is left, its largest length, the fillings to try, bins, waste
    path: list[tuple[Pattern, int]] = []
    nodes = 0

    def enter(left: dict[int, int], bins: int, waste: int) -> None:
        nonlocal nodes
        nodes += 1
        largest = max(left)
        rest = left | {largest: left[largest] - 1}
        frames.append((left, largest, iter(fillings(rest, sorted(s for s, c in rest.items() if c), capacity - largest)), bins, waste))

    if n_best > least:
        enter(counts, 0, 0)
    while frames and n_best > least and nodes < max_nodes:
        left, largest, options, bins, waste = frames[-1]
        filling = next(options, None)
        if filling is None:
            frames.pop()
            if path:
                path.pop()
            continue
        pattern = (largest, *filling)
        need = Counter(pattern)
        times = min(left[s] // k for s, k in need.items())
        lost = waste + times * (capacity - sum(pattern))
        if lost > (n_best - 1) * capacity - total:  # no bin fewer than the incumbent on this branch
            continue
        path.append((pattern, times))
        rest = {s: c - times * need[s] for s, c in left.items() if c > times * need[s]}
        if rest:
            enter(rest, bins + times, lost)
            continue
        if bins + times < n_best:
            best, n_best = Counter(), bins + times
            for p, k in path:
                best[p] += k
        path.pop()
    return best


def deal_out(plan: Counter[Pattern]) -> pd.DataFrame:
    """Segments of ranks: the pieces of a length with ranks from first on go to bins from bin on, `each` to a bin from offset on."""
    rows, taken, n_bins = [], Counter(), 0
    for pattern, times in sorted(plan.items(), reverse=True):
        offset = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((size, taken[size], n_bins, each, offset))
            taken[size] += times * each
            offset += size * each
        n_bins += times
    return pd.DataFrame(rows, columns=["length", "first", "bin", "each", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, max_nodes: int = 4000) -> DataFrame:
    """Pieces with sequence_id and offset. The pieces are written once; the texts aren't shuffled."""
    pieces = materialize(cut_into_pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    salts = docs.sparkSession.createDataFrame([(size, -(-n // GROUP)) for size, n in counts.items()], "length long, salts long")
    pieces = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    groups = pieces.groupBy("length", "salt").count()
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("count").over(by_length), F.lit(0))).select("length", "salt", "before")
    segments = deal_out(bin_completion(counts, capacity, max_nodes))
    in_group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(in_group) - 1).join(groups, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span = 1 << 44
        key = (segments["length"] * span + segments["first"]).to_numpy()
        order = np.argsort(key)
        key, table = key[order], segments.iloc[order].reset_index(drop=True)
        for x in frames:
            at = table.iloc[np.searchsorted(key, x["length"].to_numpy() * span + x["rank"].to_numpy(), side="right") - 1].reset_index(drop=True)
            k = x["rank"] - at["first"]
            yield x.assign(sequence_id=at["bin"] + k // at["each"], offset=at["offset"] + k % at["each"] * x["length"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, sequence_id long, offset long").drop("rank")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

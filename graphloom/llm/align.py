"""Banded alignment of two code sequences, bit-parallel."""

from __future__ import annotations

import numpy as np


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the common beginning and the common end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    k = int(differ[0]) if len(differ) else n
    a, b, n = a[k:], b[k:], n - k
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    k = int(differ[0]) if len(differ) else n
    return a[: len(a) - k], b[: len(b) - k]


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Insertions, deletions and replacements that make a into b, or most + 1 if it takes more than `most`.

    Only cells at most `most` off the diagonal are filled: column j holds the vertical differences of rows j - most .. j + most
    as the bits of two integers, and a column costs a handful of integer operations.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    a, b = trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a  # a is the longer: rows
    m, n = len(a), len(b)
    if n == 0:
        return m if m <= most else most + 1
    k = most
    width = 2 * k + 1
    mask = (1 << width) - 1
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    # Bit t of column j is row j - k + t. Column 0: row i holds i, so the differences of rows from 1 on are +1.
    plus, minus = (mask >> (k + 1)) << (k + 1), 0
    score = k  # value of the lowest row of the band, row j + k
    for j in range(1, n + 1):
        # The window moves down a row; its new lowest row enters with +1, as cells outside the band can't be better.
        plus, minus = (plus >> 1) | (1 << (width - 1)), minus >> 1
        shift = j - k - 1
        hits = places.get(int(b[j - 1]), 0)
        hits = (hits >> shift if shift >= 0 else hits << -shift) & mask
        diagonal = ((((hits & plus) + plus) ^ plus) | hits | minus) & mask
        across_plus = (((minus | ~(diagonal | plus)) & mask) << 1 | 1) & mask
        across_minus = ((diagonal & plus) << 1) & mask
        score += 1 - (diagonal >> (width - 1))
        plus = (across_minus | ~(diagonal | across_plus)) & mask
        minus = diagonal & across_plus
    for t in range(width - 1, m - n + k, -1):  # from row n + k up to row m
        score -= ((plus >> t) & 1) - ((minus >> t) & 1)
    return min(score, most + 1)

"""Vectorised 64-bit hashes of words, lines and word shingles over byte arrays.

A span's hash is a polynomial in a random odd base over random byte values,
taken from one running sum over the whole slice, then mixed. All arithmetic
is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

from skein.llm.common import forgets

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
SEEDS = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]

_POWERS = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS[base]) < n:
        p = np.full(1 << int(n - 1).bit_length(), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base][:n]


@forgets
def _drop_powers() -> None:
    for base in _POWERS:
        _POWERS[base] = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """values: a 64-bit value for each byte."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * SEEDS[0])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes that are not white space."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (not yet distinct) and where each row's begin.

    A row of fewer words has one shingle, its whole sequence; a row without
    words has none.
    """
    starts, ends, row = words(data, offsets)
    n = len(offsets) - 1
    w = span_hashes(BYTE_LOWER[data], starts, ends)
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    full = max(0, len(w) - k + 1)
    h = np.zeros(full, np.uint64)
    for j in range(k):
        h += w[j : j + full] * SEEDS[1 + j]
    h = mix(h)
    keep = row[:full] == row[k - 1 : k - 1 + full]
    few = np.flatnonzero((count > 0) & (count < k))
    hashes, rows = h[keep], row[:full][keep]
    if len(few):
        short = mix(np.array([(int((w[first[r] : first[r + 1]] * SEEDS[1 : 1 + count[r]]).sum()) + int(SEEDS[32 + count[r] % 32])) % 2**64 for r in few], np.uint64))
        at = np.searchsorted(rows, few)
        hashes, rows = np.insert(hashes, at, short), np.insert(rows, at, few)
    return hashes, np.searchsorted(rows, np.arange(n + 1))

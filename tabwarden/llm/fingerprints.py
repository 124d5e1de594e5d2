"""Vectorised fingerprints of words, shingles and byte strings over Arrow text buffers."""

from __future__ import annotations

import numpy as np

_WORD = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPREAD = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLIERS = np.random.Generator(np.random.PCG64(21)).integers(1, 1 << 63, 64, dtype=np.uint64) | _WORD(1)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    if base not in _powers or len(_powers[base]) < n:
        factors = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        factors[0] = 1
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of sums and products."""
    h = (h ^ (h >> _WORD(32))) * _WORD(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _WORD(32))) * _WORD(0xD6E8FEB86659FD93)
    return h ^ (h >> _WORD(32))


class Prints:
    """Fingerprints of any substrings of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_SPREAD[data] * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow text or binary column; null rows are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every word (lower-cased A-Z, cut at white space), and each row's first
    place among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return Prints(_LOWER[data]).of(starts, ends), np.searchsorted(starts, offsets, side="left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct fingerprints (63 bits) of its shingles of ``width`` words.

    A row of fewer words has its whole sequence as one, a row without words none.
    """
    words, first = word_prints(data, offsets)
    whole = max(0, len(words) - width + 1)
    shingles = np.zeros(whole, dtype=np.uint64)
    for i in range(width):
        shingles += words[i : i + whole] * _MULTIPLIERS[i]
    shingles = (mix(shingles) >> _WORD(1)).astype(np.int64)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            sets.append(np.unique(shingles[a : b - width + 1]))
        elif n:
            short = (words[a:b] * _MULTIPLIERS[:n]).sum(dtype=np.uint64, keepdims=True) + _MULTIPLIERS[32 + n : 33 + n]
            sets.append((mix(short) >> _WORD(1)).astype(np.int64))
        else:
            sets.append(np.zeros(0, dtype=np.int64))
    return sets

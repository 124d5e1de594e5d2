"""One table-driven pass over UTF-8 bytes that counts and finds words, and a table of words checked byte by byte.

The transducer has two states, between words and inside a word. A byte's class and the state pick the
next state and what is emitted. The next state depends on the byte alone, so the states of all bytes of a
slice are one table lookup on the bytes before them and the whole slice is read by array code.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#$%&*|"
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"

BETWEEN, INSIDE = 0, 1
SPACE, PLAIN, CAPITAL, SYMBOL, LEAD, CONTINUATION = range(6)
WORD_BEGINS, WORD_ENDED, CODE_POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    table = np.full(256, PLAIN, np.uint8)
    table[0x80:0xC0] = CONTINUATION
    table[0xC0:] = LEAD
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[list(SYMBOLS)] = SYMBOL
    table[list(SPACE_BYTES)] = SPACE
    return table


def _emitted() -> np.ndarray:
    """What each (state, class) emits."""
    table = np.zeros((2, 6), np.uint8)
    table[:, [SPACE, PLAIN, CAPITAL, SYMBOL, LEAD]] |= CODE_POINT
    table[:, CAPITAL] |= IS_CAPITAL
    table[:, SYMBOL] |= IS_SYMBOL
    table[BETWEEN, 1:] |= WORD_BEGINS
    table[INSIDE, SPACE] |= WORD_ENDED
    return table


CLASS_OF = _classes()
NEXT_STATE = np.array([BETWEEN] + [INSIDE] * 5, np.uint8)
EMITTED = _emitted().ravel()
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, np.uint64(base))
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and owner, equal for equal ones."""
    sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data))))
    spans = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    mixed = spans ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from ``a`` and from ``b`` are the same, eight bytes at a time."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    same, left = np.ones(len(a), bool), np.arange(len(a))
    done = 0
    while len(left):
        x, y = eights[a[left] + done], eights[b[left] + done]
        same[left] = (x ^ y) & _LOW_BYTES[np.minimum(length[left] - done, 8)] == 0
        done += 8
        left = left[same[left] & (length[left] > done)]
    return same


def first_occurrences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each span is the one its owner's equal spans are represented by (one in each set of equals).

    Spans are inserted into one open-addressed table, all of a round at once. A span that meets
    another one in its slot counts as known only if owner, length and every byte agree; else it tries the next slot.
    """
    n = len(starts)
    slots = 1 << max(1, 2 * n - 1).bit_length()
    table = np.full(slots, -1, np.int64)
    hashes, length = _span_hashes(data, starts, ends, owner), ends - starts
    place = (hashes & np.uint64(slots - 1)).astype(np.int64)
    new, pending, turn = np.zeros(n, bool), np.arange(n), 0
    while len(pending):
        at = place[pending]
        free = table[at] < 0
        table[at[free]] = pending[free]
        resident = table[at]
        new[pending[resident == pending]] = True
        known = (hashes[resident] == hashes[pending]) & (length[resident] == length[pending]) & (owner[resident] == owner[pending])
        check = np.flatnonzero(known & (resident != pending))
        r, p = resident[check], pending[check]
        known[check] = _equal_spans(data, starts[r], starts[p], length[p])
        pending = pending[~known]
        turn += 1
        place[pending] = (place[pending] + turn) & (slots - 1)
    return new


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text ``n_words, n_distinct, n_capitals, n_points, n_symbols``."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    bounds = np.append(0, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
    classes = CLASS_OF[data]
    states = np.append(np.uint8(BETWEEN), NEXT_STATE[classes[:-1]])[: len(data)]
    emitted = EMITTED[states * 6 + classes]

    def per_text(bit: int) -> np.ndarray:
        counts = np.append(0, np.cumsum(emitted & bit != 0, dtype=np.int64))
        return np.diff(counts[bounds])

    starts, ends = np.flatnonzero(emitted & WORD_BEGINS), np.flatnonzero(emitted & WORD_ENDED)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    new = first_occurrences(data, starts, ends, owner)
    return {
        "n_words": np.bincount(owner, minlength=len(texts)),
        "n_distinct": np.bincount(owner[new], minlength=len(texts)),
        "n_capitals": per_text(IS_CAPITAL),
        "n_points": per_text(CODE_POINT) - 1,
        "n_symbols": per_text(IS_SYMBOL),
    }

"""Run-length grammars by recompression, and longest common extensions on them.

A grammar is a stack of strings. Each level replaces maximal blocks ``a^r`` by one symbol, or pairs
``ab`` with ``a`` in the left and ``b`` in the right half of the alphabet; the two kinds take turns.
Whether two neighbours are joined depends on the two alone, so equal stretches are parsed alike except
at their ends. An extension therefore climbs while both places start a symbol of the next level,
comparing one symbol or block where they don't, and comes down again from the first difference.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Halvings of the alphabet tried a level; the one that joins the most pairs is taken.
TRIES = 4


@dataclass
class Level:
    """A string and how it is grouped for the next: ``owner`` of each place, ``first`` place of each group."""

    symbols: np.ndarray
    blocks: bool = False
    owner: np.ndarray | None = None
    first: np.ndarray | None = None

    def mirrored(self) -> Level:
        if self.owner is None:
            return Level(self.symbols[::-1])
        n, groups = len(self.symbols), len(self.first) - 1
        return Level(self.symbols[::-1], self.blocks, (groups - 1 - self.owner)[::-1], (n - self.first)[::-1])


def _halves(symbols: int, turn: int) -> np.ndarray:
    """A fixed coin per symbol, another one each turn."""
    mixed = np.arange(symbols, dtype=np.uint64) + np.uint64(turn * 0x9E3779B9)
    mixed = (mixed ^ (mixed >> np.uint64(16))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(63)).astype(bool)


def _grouped(level: Level, begins: np.ndarray, blocks: bool) -> np.ndarray:
    level.blocks = blocks
    level.first = np.append(np.flatnonzero(begins), len(begins))
    level.owner = np.cumsum(begins) - 1
    return level.first[:-1]


def _named(symbols: np.ndarray, joined: np.ndarray, names: np.ndarray, known: int) -> tuple[np.ndarray, int]:
    """New symbols for the joined groups, equal ones for equal names."""
    kinds, which = np.unique(names, return_inverse=True)
    symbols[joined] = known + which
    return symbols, known + len(kinds)


def grammar(string: np.ndarray, rounds: int) -> list[Level]:
    """The levels of ``string`` (symbols 0, 1, ...), at most ``rounds`` of each kind.

    The string must start and end with symbols that occur nowhere else in it.
    """
    levels, known = [Level(string.astype(np.int64))], int(string.max()) + 1 if len(string) else 0
    for turn in range(rounds):
        level = levels[-1]
        s = level.symbols
        begins = np.append(True, s[1:] != s[:-1])
        if not begins.all():
            first = _grouped(level, begins, True)
            lengths = np.diff(level.first)
            joined = np.flatnonzero(lengths > 1)
            names = s[first[joined]] * (int(lengths.max()) + 1) + lengths[joined]
            above, known = _named(s[first], joined, names, known)
            level = Level(above)
            levels.append(level)
            s = above
        if len(s) < 3:
            break
        coins = [_halves(known, turn * TRIES + k) for k in range(TRIES)]
        pairs = [left[s[:-1]] & ~left[s[1:]] for left in coins]
        pairs = max(pairs, key=np.count_nonzero)
        if not pairs.any():
            continue
        first = _grouped(level, ~np.append(False, pairs), False)
        joined = np.flatnonzero(np.diff(level.first) > 1)
        names = s[first[joined]] * known + s[first[joined] + 1]
        above, known = _named(s[first], joined, names, known)
        levels.append(Level(above))
    return levels


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar of the string read backwards."""
    return [level.mirrored() for level in levels]


def extensions(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of different places the number of equal symbols from there on."""
    a, b = i.astype(np.int64), j.astype(np.int64)
    top = len(levels) - 1
    stop = np.full(len(a), top)
    alive = np.arange(len(a))
    for depth, level in enumerate(levels[:top]):
        s, first, owner = level.symbols, level.first, level.owner
        x, y = a[alive], b[alive]
        ahead = np.flatnonzero((first[owner[x]] != x) | (first[owner[y]] != y))
        u, v = x[ahead], y[ahead]
        same = s[u] == s[v]
        if level.blocks:
            rest, other = first[owner[u] + 1] - u, first[owner[v] + 1] - v
            step = np.where(same, np.minimum(rest, other), 0)
            same &= rest == other
        else:
            step = same.astype(np.int64)
        x[ahead] += step
        y[ahead] += step
        over = np.zeros(len(alive), bool)
        over[ahead[~same]] = True
        a[alive], b[alive] = np.where(over, x, owner[x]), np.where(over, y, owner[y])
        stop[alive[over]] = depth
        alive = alive[~over]
    s = levels[top].symbols
    while len(alive):
        alive = alive[s[a[alive]] == s[b[alive]]]
        a[alive] += 1
        b[alive] += 1
    for depth in range(top - 1, -1, -1):
        level = levels[depth]
        s, first, owner = level.symbols, level.first, level.owner
        down = np.flatnonzero(stop > depth)
        x, y = first[a[down]], first[b[down]]
        step = (s[x] == s[y]).astype(np.int64)
        if level.blocks:
            step *= np.minimum(first[a[down] + 1] - x, first[b[down] + 1] - y)
        a[down], b[down] = x + step, y + step
    return a - i

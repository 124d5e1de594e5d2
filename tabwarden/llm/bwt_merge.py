"""Merging of Burrows-Wheeler transforms by iterative interleave refinement.

The strings are windows of ``length`` bytes of fragments. The alphabet is blocks: a symbol is
the fingerprint of ``length / levels`` bytes, so a suffix of a window at level h has
``levels - h`` symbols left, and the symbol before it is what the transform records.

A shard holds, per level, the transform: the symbols before its suffixes, in the order of the
suffixes. Two shards are merged without looking at their suffixes again: starting from "all of
the first, then all of the second", each level reads both transforms in the interleave found so
far and deals the interleave out by the symbols read, stably. What has been dealt out alike at
every level so far has that prefix in common; after the last level those runs are the repeated
intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tabwarden.llm.fingerprints import Prints


@dataclass
class Shard:
    #: Symbols before the suffixes, per level from the empty suffixes (last) to the first.
    before: list[np.ndarray]
    #: The windows in order of their contents, and where a new content begins.
    windows: np.ndarray
    fresh: np.ndarray


def _deal(symbols: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by symbol, and for suffixes in it the number of their run: suffixes
    with equal symbols and equal runs before have one prefix in common."""
    order = np.argsort(symbols, kind="stable")
    symbols, runs = symbols[order], runs[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (symbols[1:] != symbols[:-1]) | (runs[1:] != runs[:-1])
    return order, fresh


def build(symbols: list[np.ndarray], windows: np.ndarray) -> Shard:
    """The shard of some windows; ``symbols[h]`` is each one's block number h."""
    order = np.arange(len(windows))
    fresh = np.zeros(len(windows), dtype=bool)
    before = []
    for block in reversed(symbols):
        read = block[order]
        before.append(read)
        moved, fresh = _deal(read, np.cumsum(fresh))
        order = order[moved]
    return Shard(before, windows[order], fresh)


def merge(one: Shard, two: Shard) -> Shard:
    """The shard of both, from their transforms alone."""
    n = len(one.windows) + len(two.windows)
    of_two = np.zeros(n, dtype=bool)
    of_two[len(one.windows) :] = True
    fresh = np.zeros(n, dtype=bool)
    before = []
    for a, b in zip(one.before, two.before, strict=True):
        read = np.empty(n, dtype=np.uint64)
        read[~of_two], read[of_two] = a, b
        before.append(read)
        moved, fresh = _deal(read, np.cumsum(fresh))
        of_two = of_two[moved]
    windows = np.empty(n, dtype=np.int64)
    windows[~of_two], windows[of_two] = one.windows, two.windows
    return Shard(before, windows, fresh)


def repeated_windows(
    data: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int, levels: int = 2, shard_windows: int = 200_000
) -> np.ndarray:
    """Which windows of the fragments have equal ones, as flags in the order of the windows.

    Fragment i begins at ``starts[i]`` of ``data`` and has ``counts[i]`` windows.
    """
    firsts = np.concatenate(([0], np.cumsum(counts)))
    places = np.repeat(starts - firsts[:-1], counts) + np.arange(firsts[-1])
    prints, block = Prints(data), length // levels
    symbols = [prints.of(places + h * block, places + (h + 1) * block) for h in range(levels)]
    shards = [
        build([s[at : at + shard_windows] for s in symbols], np.arange(at, min(at + shard_windows, len(places))))
        for at in range(0, len(places), shard_windows)
    ]
    while len(shards) > 1:
        pairs = [merge(*shards[i : i + 2]) for i in range(0, len(shards) - 1, 2)]
        shards = pairs + shards[2 * len(pairs) :]
    flags = np.zeros(len(places), dtype=bool)
    for shard in shards:
        alone = shard.fresh & np.append(shard.fresh[1:], True)
        flags[shard.windows] = ~alone
    return flags

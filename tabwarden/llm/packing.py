"""Best-fit packing into bins of several permitted capacities.

Documents longer than the largest capacity are cut into pieces of that size; the rest of each
is one more piece. Pieces are placed longest first into the open bin that they fill best. When
none fits, a bin is opened with the capacity of the least expected cost per token: for each permitted
capacity the room beside the piece is filled from the histogram of the lengths still to come, largest
first, and what that bin would cost once cut down is divided by what it would hold. At the end each bin
is cut down to the smallest permitted capacity that holds its contents. Opening all bins alike, with one
capacity, is tried as well, and the cheapest packing of a group stays, so a group never costs more than
with the best single capacity.

Only ids and lengths are packed. Each task packs its own rows in groups of bounded size, so
nothing is shuffled and the waste is at most a few open bins per group.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import SPACE
from tabwarden.session import persisted_copy


@dataclass(frozen=True)
class Capacities:
    #: Permitted sequence lengths, ascending.
    lengths: tuple[int, ...] = (512, 1024, 2048, 4096)
    #: What a bin costs besides its length, in tokens.
    overhead: int = 32
    #: Pieces that one group packs together.
    group: int = 100_000

    def cost(self, length: int) -> int:
        return length + self.overhead

    def smallest(self, tokens: int) -> int:
        return self.lengths[bisect.bisect_left(self.lengths, tokens)]


def least_cost_opening(size: int, kinds: list[int], counts: Mapping[int, int], rule: Capacities) -> int:
    """Capacity to open for a piece of this size, when ``counts`` pieces of each of the ascending sizes
    ``kinds`` are still to come. Of equal costs per token the smallest capacity."""
    best = None
    for capacity in rule.lengths:
        if capacity < size:
            continue
        room = capacity - size
        at = bisect.bisect_right(kinds, room)
        while at:
            kind = kinds[at - 1]
            room -= kind * min(counts[kind], room // kind)
            at = bisect.bisect_right(kinds, room, 0, at - 1)
        held = capacity - room
        cost = rule.cost(rule.smallest(held))
        if best is None or cost * best[1] < best[0] * held:
            best = cost, held, capacity
    return best[2]


def best_fit(sizes: list[int], rule: Capacities, open_as: int | None = None) -> tuple[list[int], list[int]]:
    """Bin of each piece and the contents of each bin, for pieces longest first.

    Each bin is opened with the capacity of the least expected cost; with ``open_as`` all are opened with
    that one, and a longer piece opens the smallest that holds it. Open bins are kept by what is left in
    them, the latest first.
    """
    placed, contents, capacity = [], [], []
    left: list[int] = []
    by_left: dict[int, list[int]] = defaultdict(list)
    counts = Counter(sizes)
    kinds = sorted(counts)
    for size in sizes:
        counts[size] -= 1
        if not counts[size]:
            kinds.pop()
        at = bisect.bisect_left(left, size)
        if at < len(left):
            room = left[at]
            bin_ = by_left[room].pop()
            if not by_left[room]:
                left.pop(at)
        else:
            bin_ = len(contents)
            contents.append(0)
            if open_as is None:
                capacity.append(least_cost_opening(size, kinds, counts, rule))
            else:
                capacity.append(max(open_as, rule.smallest(size)))
        contents[bin_] += size
        placed.append(bin_)
        room = capacity[bin_] - contents[bin_]
        if room:
            if not by_left[room]:
                bisect.insort(left, room)
            by_left[room].append(bin_)
    return placed, contents


def pack_group(sizes: list[int], rule: Capacities) -> tuple[list[int], list[int]]:
    """The cheapest of the packing with a capacity per opening and those with one capacity for all, bins
    already cut down to ``lengths``.

    Returns the bin of each piece (pieces in any order) and the final capacity of each bin.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    longest_first = [sizes[i] for i in order]
    best = None
    for open_as in (None, *rule.lengths):
        placed, contents = best_fit(longest_first, rule, open_as)
        final = [rule.smallest(c) for c in contents]
        cost = sum(map(rule.cost, final))
        if best is None or cost < best[0]:
            best = cost, placed, final
    _, placed, final = best
    bins = [0] * len(sizes)
    for i, bin_ in zip(order, placed, strict=True):
        bins[i] = bin_
    return bins, final


_PACKED = (
    "doc_id long, piece int, first_token long, n_tokens int, bin_id string, bin_capacity int, bin_offset int, bin_tokens int"
)


def _pack(rule: Capacities):
    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in _PACKED.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        pieces: list[tuple] = []
        group = None

        def flush():
            bins, final = pack_group([p[3] for p in pieces], rule)
            used = [0] * len(final)
            rows = []
            for piece, bin_ in zip(pieces, bins, strict=True):
                rows.append([*piece, f"{group}-{bin_}", final[bin_], used[bin_]])
                used[bin_] += piece[3]
            for row, bin_ in zip(rows, bins, strict=True):
                row.append(used[bin_])
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        top = rule.lengths[-1]
        for batch in batches:
            for row, doc, tokens in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "n_tokens")), strict=True):
                for number, first in enumerate(range(0, tokens, top)):
                    if not pieces:
                        group = f"{row:x}.{number}"
                    pieces.append((doc, number, first, min(top, tokens - first)))
                    if len(pieces) >= rule.group:
                        yield flush()
                        pieces.clear()
        if pieces:
            yield flush()

    return run


def count_words(text: Column) -> Column:
    """Runs of characters that are no white space; the length unit where no tokenizer is given."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def pack_documents(documents: DataFrame, length: Column | None = None, rule: Capacities = Capacities()) -> DataFrame:
    """One row per piece: document, piece number, first token and length, its bin with the bin's
    final capacity and contents, and the offset in the bin.

    ``length`` is the number of tokens of a row, such as ``n_tokens`` of ``token_counts.count_tokens``; if it is
    not given, words of ``text`` are counted as tokens, which model tokens exceed. Rows without
    tokens, null texts among them, take no place and have no row. Repeated rows are packed each.
    Bin ids begin with a number of the row that opened their group, so they are unique; lengths
    are written first, so a task that runs again packs the same rows under the same numbers.
    """
    counted = documents.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(length if length is not None else count_words(F.col("text")), F.lit(0)).cast("long").alias("n_tokens"),
    )
    return persisted_copy(counted, "lengths").where("n_tokens > 0").mapInArrow(_pack(rule), _PACKED)

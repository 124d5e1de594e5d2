"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are all windows of 13 consecutive words of the benchmark items (an item of
fewer words is one window). Per window length there is one Wu-Manber table: ``shift`` says for
a block of two words how far the search may jump; where it says zero, the bucket of that
suffix block holds the windows that end in it, and comparing the words themselves confirms an
occurrence.

Texts are searched where they are read, without a shuffle. The windows are a stated query set;
they are taken in blocks of bounded size, one pass over the documents per block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import only, slices
from tabwarden.session import persisted_copy

WINDOW = 13
#: Words per block of the shift tables.
BLOCK = 2
#: Bytes of item texts in one pass over the documents; a longer item is a block of its own.
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_in(raw: bytes) -> list[bytes]:
    """The contract's words of a UTF-8 text."""
    return raw.translate(_FOLD).split()


class WuManber:
    """Windows of one length: shift table and suffix buckets."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(BLOCK, length)
        self.longest = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                block = window[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.longest), length - end)
            self.buckets[window[-self.block :]][window] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of every occurrence, from left to right."""
        length, block, longest, shift, buckets = self.length, self.block, self.longest, self.shift, self.buckets
        end, n = length, len(words)
        while end <= n:
            last = tuple(words[end - block : end])
            jump = shift.get(last, longest)
            if jump:
                end += jump
                continue
            items = buckets[last].get(tuple(words[end - length : end]))
            if items is not None:
                yield end - length, items
            end += 1


def tables_of(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> list[WuManber]:
    """The search tables for (item id, text) pairs; items without words have none."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, raw in items:
        words = words_in(raw)
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if length else 0):
            by_length[length][tuple(words[start : start + length])].update([item] if item is not None else ())
    return [WuManber(length, dict(windows)) for length, windows in sorted(by_length.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of bounded size, one partition at a time in the driver."""
    block, size = [], 0
    rows = only(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    for item, raw in rows.where("text IS NOT NULL").toLocalIterator():
        block.append((item, bytes(raw)))
        size += len(raw)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


_FOUND = "hits array<struct<start:int,end:int>>, items array<string>"


def _search(shared, window: int, carry: list[str]):
    def run(batches):
        import pyarrow as pa

        tables = tables_of(shared.value, window)
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, 2 << 20, "raw"):
            counts, all_hits, all_items = [], [], []
            before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for raw, (hits, items) in zip(batch.column("raw").to_pylist(), before, strict=True):
                words = words_in(raw or b"")
                found, spotted = [(h["start"], h["end"]) for h in hits], set(items)
                for table in tables:
                    for start, of in table.search(words):
                        found.append((start, start + table.length))
                        spotted |= of
                merged: list[list[int]] = []
                for start, end in sorted(found):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                counts.append(len(words))
                all_hits.append([{"start": s, "end": e} for s, e in merged])
                all_items.append(sorted(spotted))
            arrays = {
                **{c: batch.column(c) for c in carry},
                "n_words": pa.array(counts, pa.int64()),
                "hits": pa.array(all_hits, spans),
                "items": pa.array(all_items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return run


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per document: the carried columns with ``n_words, hits, items``.

    ``hits`` are the maximal runs (start, end exclusive) of words inside occurrences, ``items``
    the ids with occurring windows, sorted as text. Null texts have no words; items with a null
    id hit but are not listed; an empty benchmark hits nothing. Columns other than ``doc_id,
    text`` and ``item_id, text`` are not looked at.
    """
    spark = documents.sparkSession
    found = documents.select(
        *(F.col(c).alias(f"own_{c}") for c in carry),
        F.col("text").cast("binary").alias("raw"),
        F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("hits"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    blocks = item_blocks(benchmark, block_bytes)
    block = next(blocks, [])
    while True:
        after = next(blocks, None)
        kinds = dict(found.dtypes)
        passed = [f"own_{c}" for c in carry] + (["raw"] if after is not None else [])
        run = _search(spark.sparkContext.broadcast(block), window, passed)
        found = found.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in passed) + f"n_words long, {_FOUND}")
        if after is None:
            return found.withColumnsRenamed({f"own_{c}": c for c in carry})
        found = persisted_copy(found, "contamination").drop("n_words")
        block = after


def judged(found: DataFrame, one_in: int = 20) -> DataFrame:
    """Add ``n_hit`` and ``contaminated``: some word is hit, and at least one word in ``one_in``."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + (h["end"] - h["start"]))
    return found.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))
    )


def contamination_digests(found: DataFrame) -> DataFrame:
    return judged(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )

"""Periodic runs of words, by extensions on a recompression grammar.

A run is a stretch of words with smallest period q that no neighbour extends, at least
``min_length`` words and ``min_exponent`` periods long. The texts of a slice of an Arrow batch are one string
of word numbers with a mark of its own before, between and after them, so no extension leaves its text.
For every period p, a stretch in which words p apart agree covers a multiple of
``max((min_exponent - 1) * p, min_length - p)``; only these places are tried (a harmonic sum of them), and
where the two words agree the grammar says how far they go on agreeing to the right and to the left.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import slices
from tabwarden.llm.recompression import extensions, grammar, mirrored

MIN_LENGTH = 6
MIN_EXPONENT = 4

#: Text of a slice. It bounds the grammar, whatever the batch size of the session; one text is never cut.
SLICE_BYTES = 4 << 20


def runs_in(string: np.ndarray, longest: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT):
    """``(start, length, period)`` arrays of all runs, by start, then period.

    ``string`` starts and ends with marks, holds one between texts, and its texts have at most ``longest`` words.
    """
    n, found_i, found_p = len(string), [], []
    for p in range(1, longest // min_exponent + 1):
        step = max((min_exponent - 1) * p, min_length - p)
        at = np.flatnonzero(string[0 : n - p : step] == string[p::step]) * step
        if len(at):
            found_i.append(at)
            found_p.append(np.full(len(at), p))
    if not found_i:
        return (np.zeros(0, np.int64),) * 3
    i, p = np.concatenate(found_i), np.concatenate(found_p)
    levels = grammar(string, 4 + 2 * int(longest).bit_length())
    right = extensions(levels, i, i + p)
    left = extensions(mirrored(levels), n - i, n - i - p)
    start, length = i - left, left + right + p
    long = length >= np.maximum(min_length, min_exponent * p)
    start, length, p = start[long], length[long], p[long]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[smallest], length[smallest], p[smallest]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


def cycled(words: list[bytes], seed: int | None) -> list[bytes]:
    """The words, in a tenth of all texts (by the seed) with a cycle from some place on."""
    n = len(words)
    if seed is None or n == 0 or seed % 10:
        return words
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _search(min_length: int, min_exponent: int, carry: list[str], slice_bytes: int):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, slice_bytes, "raw"):
            seeds = batch.column("seed").to_pylist()
            texts = [cycled((raw or b"").split(), seed) for raw, seed in zip(batch.column("raw").to_pylist(), seeds, strict=True)]
            sizes = np.array([len(t) for t in texts], np.int64)
            numbers = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
            n_kinds = len(numbers.dictionary)
            first = np.append(0, np.cumsum(sizes + 1)) + 1
            string = np.empty(first[-1], np.int64)
            string[first - 1] = n_kinds + np.arange(len(first))
            inner = np.ones(len(string), bool)
            inner[first - 1] = False
            string[inner] = numbers.indices.to_numpy(zero_copy_only=False)
            start, length, period = runs_in(string, int(sizes.max(initial=0)), min_length, min_exponent)
            of = np.searchsorted(first, start, side="right") - 1
            cover = np.zeros(len(string) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            kept = np.cumsum(cover)[:-1] == 0
            collapsed = [b" ".join(compress(t, kept[f : f + len(t)].tolist())) for t, f in zip(texts, first[:-1], strict=True)]
            fields = [pa.array(start - first[of]), pa.array(length), pa.array(period)]
            runs = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()),
                pa.StructArray.from_arrays(fields, ["start", "length", "period"]),
            )
            arrays = {c: batch.column(c) for c in carry}
            arrays |= {"n_words": pa.array(sizes), "runs": runs, "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return run


def find_runs(
    documents: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    seed: Column | None = None,
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The carried columns with ``n_words``, ``runs`` (start, length, period) and ``collapsed``.

    ``runs`` are ordered by start, then period. ``collapsed`` are the words joined by one space, without
    those that some run holds after its first period. ``seed`` cycles a tenth of the texts first (see
    ``cycled``), null leaves a text as it is. Null and empty texts have no words and no runs; repeated
    rows are rows of their own; other columns than the carried ones and ``text`` are not looked at.
    Nothing is shuffled.
    """
    if min_exponent < 2:
        raise ValueError("A run has at least two periods.")
    kinds = dict(documents.dtypes)
    rows = documents.select(
        *(F.col(c).alias(f"own_{c}") for c in carry),
        F.col("text").cast("binary").alias("raw"),
        (F.lit(None) if seed is None else seed).cast("long").alias("seed"),
    )
    schema = "".join(f"`own_{c}` {kinds[c]}, " for c in carry)
    schema += "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run = _search(min_length, min_exponent, [f"own_{c}" for c in carry], slice_bytes)
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"own_{c}": c for c in carry})


def run_digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest (ties: first start, then least period) and digests."""
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"]))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("longest", longest)
    length, start, period = F.col("longest.length"), -F.col("longest.col2"), -F.col("longest.col3")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )

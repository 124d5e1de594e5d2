"""Removal of long byte strings that occur more than once in the corpus.

A window is a string of ``length`` bytes. Windows that are equal choose the same anchor, the
least-hashed gram in them, so equal windows can be looked for anchor by anchor:

1. Each text is cut into fragments, the runs of windows with one anchor. Fragments that are
   equal as a whole are known by their fingerprints; texts that are copies never go further.
2. Where different fragments share an anchor, one of each kind is fetched. Per task their
   windows are made into shards; the shards' Burrows-Wheeler transforms are merged by
   interleave refinement, and the repeated intervals are the windows found more than once.
3. Per text the windows found are laid over its bytes, and what they cover is removed.

An anchor under which very many different fragments lie is split: its windows are dealt out by
the bytes that those of nearby places share, which equal windows share too.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwarden.llm.common import slices
from tabwarden.session import persisted_copy


@dataclass(frozen=True)
class RepeatRule:
    #: Bytes of a string whose repetition counts.
    length: int = 200
    #: Bytes of an anchor gram.
    gram: int = 64
    #: Kinds of fragment from which an anchor is split.
    crowded: int = 20_000
    #: Windows of a split anchor that stay together.
    step: int = 16
    #: Bytes of fragments that a task takes at once.
    task_bytes: int = 4 << 20


def fragments_of(data, offsets, rule: RepeatRule):
    """(anchor print, anchor place, first window, windows, row) of the fragments of a slice of
    texts. Places are in ``data``."""
    import numpy as np

    from tabwarden.llm.fingerprints import Prints

    n, width = len(data), rule.length - rule.gram + 1
    if n < rule.length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, None
    prints = Prints(data)
    at = np.arange(n - rule.gram + 1)
    grams = prints.of(at, at + rule.gram)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    places = np.arange(len(least))
    rows = np.searchsorted(offsets, places, side="right") - 1
    whole = places + rule.length <= offsets[rows + 1]
    places, rows = places[whole], rows[whole]
    anchors = (least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(places):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, prints
    new = np.ones(len(places), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(places)))
    return grams[anchors[first]], anchors[first], places[first], counts, rows[first], prints


def _anchors(rule: RepeatRule):
    """(key, text) -> (anchor, fragment, key, place). ``place`` packs the first window, the number
    of windows, and whether the fragment was met before in the slice; of those met before only
    one goes on to be counted, the others stand under a number of their own."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tabwarden.llm.fingerprints import mix, text_buffers

        for batch in slices(batches, 2 << 20):
            data, offsets = text_buffers(batch.column("text"))
            anchor, _, first, counts, rows, prints = fragments_of(data, offsets, rule)
            if not len(first):
                continue
            fragment = prints.of(first, first + counts - 1 + rule.length)
            keys = batch.column("key").to_numpy()[rows]
            place = first - offsets[rows]
            order = np.lexsort((fragment, anchor))
            equal = (anchor[order][1:] == anchor[order][:-1]) & (fragment[order][1:] == fragment[order][:-1])
            met = np.zeros(len(order), bool)
            met[order[1:]] = equal
            several = met.copy()
            several[order[:-1]] |= equal
            own = mix(keys.view(np.uint64) ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(met, own, anchor).view(np.int64)),
                    pa.array(fragment.view(np.int64)),
                    pa.array(keys),
                    pa.array((place << 16) | (counts << 1) | several),
                ],
                ["anchor", "fragment", "key", "place"],
            )

    return run


def _fetch(rule: RepeatRule):
    """(key, text, asked) -> (part, key, place, bytes): the fragments asked for, whole or, of
    crowded anchors, dealt out by the bytes that the windows of ``step`` places share."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tabwarden.llm.fingerprints import Prints, mix, text_buffers

        for batch in slices(batches, 4 << 20):
            data, offsets = text_buffers(batch.column("text"))
            out: list[tuple] = []
            for row, (key, asked) in enumerate(
                zip(batch.column("key").to_pylist(), batch.column("asked").to_pylist(), strict=True)
            ):
                text = data[offsets[row] : offsets[row + 1]]
                crowded = [a for a in asked if a["crowded"]]
                for a in asked:
                    if not a["crowded"]:
                        at, n = a["place"] >> 16, (a["place"] >> 1) & 0x7FFF
                        out.append((a["anchor"], key, a["place"], text[at : at + n - 1 + rule.length].tobytes()))
                if crowded:
                    prints = Prints(text)
                    _, anchor_at, first, _, _, _ = fragments_of(text, np.array([0, len(text)]), rule)
                    where = dict(zip(first.tolist(), anchor_at.tolist(), strict=True))
                    for a in crowded:
                        at, n = a["place"] >> 16, (a["place"] >> 1) & 0x7FFF
                        anchor = where[at]
                        while n:
                            # windows that begin ``lead`` bytes before the anchor, by multiples of step
                            chunk = (anchor - at) // rule.step
                            here = min(n, anchor - at - chunk * rule.step + 1)
                            low, high = anchor - chunk * rule.step, anchor - (chunk + 1) * rule.step + 1 + rule.length
                            core = prints.of(np.array([low]), np.array([high]))
                            part = mix(core ^ np.uint64((a["anchor"] + chunk) & (2**64 - 1)))
                            out.append((int(part.view(np.int64)[0]), key, (at << 16) | (here << 1), text[at : at + here - 1 + rule.length].tobytes()))
                            at, n = at + here, n - here
            if out:
                part, key, place, raw = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), pa.array(key, pa.int64()), pa.array(place, pa.int64()), pa.array(raw, pa.binary())],
                    ["part", "key", "place", "fragment"],
                )

    return run


def _compare(rule: RepeatRule):
    """Fragments sorted by part -> (key, place) of the runs of windows found more than once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tabwarden.llm.bwt_merge import repeated_windows

        def found(keys, places, raws):
            places = np.array(places)
            counts = (places >> 1) & 0x7FFF
            sizes = np.array([len(r) for r in raws])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            flags = repeated_windows(np.frombuffer(b"".join(raws), np.uint8), starts, counts, rule.length)
            owner = np.repeat(np.arange(len(keys)), counts)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            begins = flags.copy()
            begins[1:] &= ~flags[:-1] | (owner[1:] != owner[:-1])
            first = np.flatnonzero(begins)
            run_of = np.cumsum(begins)[flags] - 1
            lengths = np.bincount(run_of, minlength=len(first))
            at = (places[owner[first]] >> 16) + inner[first]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.int64)[owner[first]]), pa.array((at << 16) | (lengths << 1))], ["key", "place"]
            )

        part, since, size = None, 0, 0
        keys, places, raws = [], [], []
        for batch in batches:
            for p, k, w, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "place", "fragment")), strict=True):
                if p != part:
                    part = p
                    if size >= rule.task_bytes:
                        yield found(keys, places, raws)
                        keys, places, raws, size = [], [], [], 0
                keys.append(k)
                places.append(w)
                raws.append(raw)
                size += len(raw)
        if raws:
            yield found(keys, places, raws)

    return run


def _remove(rule: RepeatRule):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 8 << 20):
            columns = [[], [], [], []]
            texts, places = batch.column("text").to_pylist(), batch.column("places").to_pylist()
            for text, own in zip(texts, places, strict=True):
                raw = (text or "").encode()
                spans: list[list[int]] = []
                for place in sorted(own or ()):
                    at = place >> 16
                    end = at + ((place >> 1) & 0x7FFF) - 1 + rule.length
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([at, end])
                digest, last = hashlib.sha256(), 0
                for at, end in spans:
                    digest.update(raw[last:at])
                    last = end
                digest.update(raw[last:])
                removed = [{"start": a, "end": b} for a, b in spans]
                for column, value in zip(columns, (len(raw), sum(b - a for a, b in spans), removed, digest.hexdigest()), strict=True):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), span, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "n_bytes", "n_removed", "removed", "kept_sha256"],
            )

    return run


def repeated_places(keyed: DataFrame, rule: RepeatRule) -> DataFrame:
    """``key, place``: runs of windows found more than once, per text (``key, text`` rows)."""
    every = keyed.mapInArrow(_anchors(rule), "anchor long, fragment long, key long, place long")
    by_anchor = Window.partitionBy("anchor")
    alike = Window.partitionBy("anchor", "fragment")
    counted = every.select(
        "*",
        F.min("fragment").over(by_anchor).alias("low"),
        F.max("fragment").over(by_anchor).alias("high"),
        F.count("*").over(alike).alias("n"),
        F.max(F.col("place").bitwiseAND(F.lit(1).cast("long"))).over(alike).alias("several"),
        F.row_number().over(alike.orderBy("key", "place")).alias("number"),
    )
    loci = counted.select(
        "anchor",
        "key",
        "place",
        ((F.col("n") > 1) | (F.col("several") > 0)).alias("known"),
        ((F.col("low") != F.col("high")) & (F.col("number") == 1)).alias("asked"),
    ).where("known OR asked")
    loci = persisted_copy(loci, "loci")
    asked = loci.where("asked").select("anchor", "key", "place")
    crowds = asked.groupBy("anchor").agg((F.count("*") > rule.crowded).alias("crowded")).where("crowded")
    wanted = (
        asked.join(crowds, "anchor", "left")
        .groupBy("key")
        .agg(F.collect_list(F.struct("anchor", "place", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("asked"))
    )
    fetched = keyed.join(wanted, "key").mapInArrow(_fetch(rule), "part long, key long, place long, fragment binary")
    compared = fetched.repartition("part").sortWithinPartitions("part").mapInArrow(_compare(rule), "key long, place long")
    return loci.where("known").select("key", "place").union(compared)


def remove_repeats(documents: DataFrame, rule: RepeatRule = RepeatRule()) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, removed, kept_sha256``.

    ``removed`` are the maximal runs (start, end exclusive) of bytes covered by a string of
    ``rule.length`` bytes that starts somewhere else too, in the same text or another, counted on the
    input. Null texts are empty; texts shorter than the length keep all. Repeated rows are copies
    of each other and lose everything that is long enough. Columns other than ``doc_id, text``
    are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key"))
    places = repeated_places(keyed.select("key", "text"), rule).groupBy("key").agg(F.collect_set("place").alias("places"))
    schema = "doc_id long, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string"
    return keyed.join(places, "key", "left").drop("key").mapInArrow(_remove(rule), schema)


def repeat_digests(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256"
    )

"""What each order of a set of filters removes, and what each filter is worth on its own.

A byte transducer measures every text in one pass. A document is then its failing pattern, a bit per
filter, so every order is answered from the counts of the patterns: the audit's cost hardly depends on how
many orders are asked for. Copies are counted per cell (text digest, part, pattern, labels)
before texts are compared, so a group of copies is never brought together row by row.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.llm.byte_transducer import measure
from tabwarden.llm.common import slices, text_of

#: Text of a slice of an Arrow batch, which bounds what the transducer allocates.
SLICE_BYTES = 4 << 20

MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")

#: The condition on which each filter of one row fails it. The last filter, copies, needs the table.
ROW_FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_points",
    "D": "n_symbols > 0",
}
COPY_FILTER = "E"


def _measured(carry: list[str], slice_bytes: int):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, slice_bytes, "raw"):
            counts = measure([raw or b"" for raw in batch.column("raw").to_pylist()])
            arrays = {c: batch.column(c) for c in carry} | {m: pa.array(counts[m], pa.int64()) for m in MEASURES}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return run


def text_measures(documents: DataFrame, carry: dict[str, Column], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The carried columns with the five measures of each text. Null texts count as empty."""
    rows = documents.select(*(c.alias(f"own_{name}") for name, c in carry.items()), F.col("text").cast("binary").alias("raw"))
    kept = rows.drop("raw")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in kept.dtypes) + "".join(f", {m} long" for m in MEASURES)
    measured = rows.mapInArrow(_measured(kept.columns, slice_bytes), schema)
    return measured.withColumnsRenamed({f"own_{name}": name for name in carry})


def failing_patterns(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, pattern, n, good, toxic``: the documents of each part by the filters that they fail.

    Bit k of ``pattern`` stands for the k-th letter. A document fails the copy filter if some smaller id has the
    same text anywhere in the table; repeated rows of the least id and rows without an id don't fail it.
    A null ``lang`` is the part ''. A label counts if any row of its document says 1; documents without a label
    are neither good nor toxic.
    """
    measured = text_measures(
        documents,
        {
            "id": F.col("doc_id"),
            "part": F.coalesce(F.col("lang"), F.lit("")),
            "digest": F.unhex(F.sha2(text_of(), 256)),
        },
    )
    bits = [F.when(F.expr(condition), 1 << k).otherwise(0) for k, condition in enumerate(ROW_FILTERS.values())]
    rows = measured.select("id", "part", "digest", sum(bits[1:], bits[0]).alias("fails"))
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    cell = ["digest", "part", "fails", "good", "toxic"]
    rows = rows.join(said, "id", "left").fillna(False, ["good", "toxic"])
    by_id = rows.groupBy("id", *cell).agg(F.count("*").alias("n"))
    cells = by_id.groupBy(*cell).agg(
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("n_least"),
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_anonymous"),
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    passing = F.col("n_anonymous") + F.when(first, F.col("n_least")).otherwise(0)
    copy_bit = 1 << len(ROW_FILTERS)
    kinds = F.explode(
        F.array(
            F.struct(F.col("fails").alias("pattern"), F.col("passing").alias("n")),
            F.struct((F.col("fails") + copy_bit).alias("pattern"), (F.col("n") - F.col("passing")).alias("n")),
        )
    )
    counted = cells.withColumn("passing", passing).select("part", "good", "toxic", kinds.alias("kind"))
    return counted.groupBy("part", "kind.pattern").agg(
        F.sum("kind.n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("kind.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("kind.n")).otherwise(0)).alias("toxic"),
    )


def _steps(letters: str) -> str:
    """Every step of every order: its own filter's bit and the bits of the filters before it."""
    steps = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << letters.index(letter)
            steps.append({"filter_order": "".join(order), "step": step, "own": own, "before": before})
            before |= own
    return json.dumps(steps)


def audit_orders(patterns: DataFrame, letters: str = "".join(ROW_FILTERS) + COPY_FILTER) -> DataFrame:
    """One row per part, order and step, from the pattern counts (at most 32 a part).

    ``shapley`` is what the step's filter removes, added up over all orders: a document that fails m
    filters is removed by each of them in one m-th of the orders.
    """
    schema = "array<struct<filter_order:string,step:int,own:int,before:int>>"
    per_part = patterns.groupBy("part").agg(
        F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("patterns")
    )
    at = F.explode(F.from_json(F.lit(_steps(letters)), schema))
    rows = per_part.select("part", "patterns", at.alias("at")).select("part", "patterns", "at.*")

    def total(of, holds) -> Column:
        return F.aggregate("patterns", F.lit(0).cast("long"), lambda sum_, p: sum_ + F.when(holds(p["pattern"]), of(p)).otherwise(0))

    own, before = F.col("own"), F.col("before")

    def fails(p):
        return p.bitwiseAND(own) != 0

    def removed(p):
        return fails(p) & (p.bitwiseAND(before) == 0)

    def count(p):
        return p["n"]

    orders = factorial(len(letters))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(count, lambda p: p.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total(count, removed).alias("removed"),
        total(count, lambda p: fails(p) & (p.bitwiseAND(before) != 0)).alias("redundant"),
        total(count, lambda p: p == own).alias("unique_fails"),
        total(lambda p: p["good"], removed).alias("good_lost"),
        total(lambda p: p["toxic"], removed).alias("toxic_lost"),
        total(lambda p: p["n"] * F.floor(orders / F.bit_count(p["pattern"])), fails).alias("shapley"),
    )


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters over the documents; no rows for an empty table."""
    return audit_orders(failing_patterns(documents, labels))

"""Code lists of any length, checked without a literal or a broadcast that grows with the list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.text import nullify, typed
from tabwarden.operators.bitmap import key_bitmap, with_hits
from tabwarden.operators.row_checks import VIOLATION_COLUMNS, quoted
from tabwarden.operators.skew import spread_join
from tabwarden.session import persisted_copy


def long_enumeration_violations(
    df: DataFrame,
    codes: DataFrame,
    keys: Sequence[str],
    sql_types: dict[str, str] | None = None,
    tokens: Sequence[str] = (),
    hot_rows: int = 100_000,
) -> DataFrame:
    """``keys, column, rule, value, detail`` of the cells whose value is none of the codes of their column.

    ``codes`` has the rows ``(column, code)``, any number of them; columns of ``df`` without a row there
    have an empty list, columns not named in ``sql_types`` are compared as text. Values of int and real
    columns are compared as numbers, and one that is no number is left to the type rule. Null tokens are nulls
    and nulls are never outside. A code that is no number of its column's type stands for nothing.

    The cells are reduced to distinct (column, value) pairs on the map side, so only these meet the
    codes, each once. What is left is written, and only cells that a bitmap of it does not rule out meet it, in
    a join that cuts hot values into slots.
    """
    types = {name: "text" for name in df.columns if name not in keys} | (sql_types or {})
    checked = list(sql_types) if sql_types else [c for c in df.columns if c not in keys]

    def comparable(text, column):
        """Numbers as one text each, so that 1, 01 and 1.0 of a real column are one value."""
        kinds = {"int": typed(text, "int"), "real": typed(text, "real")}
        result = text
        for kind, number in kinds.items():
            own = [name for name in checked if types[name] == kind]
            if own:
                # Zero has one sign.
                plain = F.when(number == 0, F.lit(0)).otherwise(number) if kind == "real" else number
                result = F.when(column.isin(*own), plain.cast("string")).otherwise(result)
        return result

    row = df.select(F.struct(*[quoted(k) for k in keys]).alias("__row"), *[quoted(c) for c in checked])
    cells = row.unpivot(["__row"], [quoted(c) for c in checked], "column", "value")
    if tokens:
        cells = cells.withColumn("value", nullify(F.col("value"), tokens))
    cells = cells.where("value IS NOT NULL").withColumn("same", comparable(F.col("value"), F.col("column")))
    cells = cells.where("same IS NOT NULL")
    listed = codes.select("column", comparable(F.col("code"), F.col("column")).alias("same")).where("same IS NOT NULL")
    pairs = cells.groupBy("column", "same").agg(F.count("*").alias("copies"))
    # Spark would move an anti join below the aggregate and shuffle every cell for it.
    met = pairs.join(listed.distinct().withColumn("__listed", F.lit(True)), ["column", "same"], "left")
    unknown = persisted_copy(met.where(F.col("__listed").isNull()).drop("__listed"), "unknown-values")
    cells = with_hits(cells, key_bitmap(unknown, "column", "same"), "column", "same").where("__hit").drop("__hit")
    found = spread_join(cells, unknown, ["column", "same"], "copies", "left_semi", hot_rows)
    return found.select(
        *[F.col(f"__row.`{k}`").alias(k) for k in keys],
        "column",
        F.lit("not_in_enumeration").alias("rule"),
        "value",
        F.lit(None).cast("string").alias("detail"),
    ).select(*keys, *VIOLATION_COLUMNS)

"""Longitudinal keys: unique per file, never null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.model import SUBJECT_COLUMN, VISIT_COLUMN
from tabwarden.operators.skew import HOT_ROWS, spread_join

KEY = (VISIT_COLUMN, SUBJECT_COLUMN)


def repeated_keys(df: DataFrame, keys: Sequence[str] = KEY, scope: Sequence[str] = ("file",)) -> DataFrame:
    """Keys that occur more than once in their scope; nulls count as equal.

    Only the key columns are read and shuffled, after a count on the map side.
    """
    counted = df.groupBy(*scope, *keys).agg(F.count(F.lit(1)).alias("copies"))
    return counted.where("copies > 1")


def rows_with_repeated_key(
    df: DataFrame,
    keys: Sequence[str] = KEY,
    scope: Sequence[str] = ("file",),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every copy of a repeated key, as full rows."""
    on = [*scope, *keys]
    return spread_join(df, repeated_keys(df, keys, scope), on, "copies", "left_semi", hot_rows)


def key_violations(df: DataFrame, keys: Sequence[str] = KEY, scope: Sequence[str] = ("file",)) -> DataFrame:
    """One violation per repeated key with the number of its copies as detail."""
    return repeated_keys(df, keys, scope).select(
        *scope,
        F.array_join(F.array(*keys), ",", "null").alias("value"),
        F.lit(",".join(keys)).alias("column"),
        F.lit("duplicate_key").alias("rule"),
        F.col("copies").cast("string").alias("detail"),
    )


def null_subjects(df: DataFrame) -> DataFrame:
    return df.where(F.col(SUBJECT_COLUMN).isNull())


def null_visits(df: DataFrame) -> DataFrame:
    return df.where(F.col(VISIT_COLUMN).isNull())

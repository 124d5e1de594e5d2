"""Which datasets a file carries, and whether the dictionary allows them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.model import DATASET_COLUMN


def distinct_datasets(df: DataFrame, scope: Sequence[str] = ("file",)) -> DataFrame:
    """Distinct dataset codes per file; a null code counts as one."""
    return df.select(*scope, DATASET_COLUMN).distinct()


def unknown_datasets(datasets: DataFrame, allowed: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Datasets outside the allowed codes. A null code is never allowed."""
    return datasets.join(allowed.select(*on, DATASET_COLUMN), [*on, DATASET_COLUMN], "left_anti")


def membership_violations(unknown: DataFrame, scope: Sequence[str] = ("file",)) -> DataFrame:
    return unknown.select(
        *scope,
        F.lit(DATASET_COLUMN).alias("column"),
        F.lit("unknown_dataset").alias("rule"),
        F.col(DATASET_COLUMN).alias("value"),
        F.lit(None).cast("string").alias("detail"),
    )

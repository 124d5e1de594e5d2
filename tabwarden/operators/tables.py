"""Operators on primary tables: padding, counts, new datasets, deletion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwarden.model import DATASET_COLUMN
from tabwarden.operators.row_checks import quoted


def pad_columns(df: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns in its order; those that the frame lacks become null."""
    present = set(df.columns)
    return df.select(
        *[
            (quoted(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def new_datasets(imported: DataFrame, registered: DataFrame, on: Sequence[str]) -> DataFrame:
    """Imported datasets that are not registered yet."""
    return imported.select(*on).distinct().join(registered.select(*on), list(on), "left_anti")


def count_by_dataset(primary: DataFrame, dataset: str = DATASET_COLUMN) -> DataFrame:
    """Rows per dataset; the rows without a dataset are counted as 0."""
    return primary.groupBy(F.col(dataset).alias(DATASET_COLUMN)).agg(F.count(dataset).alias("n"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def without_dataset(primary: DataFrame, dataset: Column | str, column: str = DATASET_COLUMN) -> DataFrame:
    """Everything but the rows of one dataset; rows without a dataset stay."""
    return primary.where(~F.col(column).eqNullSafe(dataset))

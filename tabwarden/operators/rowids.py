"""Gap-free numbers without a global window.

The rows are written once; a row is then known by its file and its index in it, whatever
tasks read it and however often. What the files share is one count each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabwarden.session import persisted_copy

# So many file offsets may be broadcast; beyond, Spark joins as it sees fit.
MAX_BROADCAST_FILES = 200_000


def assign_row_ids(df: DataFrame, id_column: str = "row_id", base: Column | int = 0) -> DataFrame:
    """Add ``id_column`` with base+1 .. base+n in any order. Writes a copy of the rows."""
    return number_rows(with_places(persisted_copy(df, "row-ids")), id_column, base)


def assign_ordered_ids(
    df: DataFrame, order: Sequence[str | Column], id_column: str = "row_id", base: Column | int = 0
) -> DataFrame:
    """The same in the given order: range partitions, sorted each on its own, one file each.

    Rows that are equal in the order columns come in one partition; give columns that tell
    the rows apart.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return number_rows(with_places(persisted_copy(ordered, "ordered-ids")), id_column, base)


def with_places(stored: DataFrame) -> DataFrame:
    """Add where each row of a Parquet scan is stored."""
    return stored.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index")
    )


def number_rows(placed: DataFrame, id_column: str, base: Column | int = 0) -> DataFrame:
    """Number rows that carry their place, in the order of files and rows."""
    counts = placed.groupBy("__file").agg(F.count("*").alias("__rows"))
    # Writers name the files after their partitions.
    part = F.regexp_extract("__file", r"part-(\d+)[^/]*\z", 1).try_cast("int")
    # One row per file: this window has as many rows as the writing job had tasks.
    before = Window.orderBy(part, "__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    if len(placed.inputFiles()) <= MAX_BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    start = base if isinstance(base, Column) else F.lit(base)
    return (
        placed.join(offsets, "__file")
        .withColumn(id_column, (start + F.col("__before") + F.col("__index") + 1).cast("bigint"))
        .drop("__file", "__index", "__before")
    )

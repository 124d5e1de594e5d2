"""Primary tables: one folder per model, one sub-folder per load, partitioned by dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwarden.model import DATASET_COLUMN

LOAD = "__load"

# So many live (load, dataset) pairs may be broadcast; they are counted before.
MAX_BROADCAST_PAIRS = 500_000


def append_load(rows: DataFrame, path: str, load: int) -> str:
    """Write one load. Rows are dealt by dataset first, where Spark splits large datasets over several tasks
    and lays small ones together, so files follow from bytes and datasets and not from tasks.

    The number of the load is new, so what is in its place is left over from a load that failed before its commit.
    """
    target = f"{path}/{LOAD}={load}"
    writer = rows.hint("rebalance", DATASET_COLUMN).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(DATASET_COLUMN).parquet(target)
    return target


def read_primary(
    spark: SparkSession, path: str, schema: T.StructType, live: DataFrame, datasets: Sequence[str] | None = None
) -> DataFrame:
    """Rows of the live ``(load, dataset)`` pairs, in the order of the schema.

    Both are partition columns, so a dataset that is not wanted or was deleted is not read.
    The pairs are counted here, in the catalog: as long as there are not too many they go
    to the rows and the rows are not shuffled.
    """
    stored = T.StructType(
        [f for f in schema.fields if f.name != DATASET_COLUMN]
        + [T.StructField(LOAD, T.LongType()), T.StructField(DATASET_COLUMN, T.StringType())]
    )
    rows = spark.read.schema(stored).parquet(path)
    if datasets is not None:
        rows = rows.where(F.col(DATASET_COLUMN).isin(*datasets))
    alive = live.select(F.col("load").cast("bigint").alias(LOAD), F.col("dataset").alias(DATASET_COLUMN))
    if datasets is not None:
        alive = alive.where(F.col(DATASET_COLUMN).isin(*datasets))
    alive = alive.distinct()
    if alive.limit(MAX_BROADCAST_PAIRS + 1).count() <= MAX_BROADCAST_PAIRS:
        alive = F.broadcast(alive)
    return rows.join(alive, [LOAD, DATASET_COLUMN], "left_semi").select(*schema.names)

"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more rows than this and more than 1/HOT_FRACTION of all rows.
# So there are never more than HOT_FRACTION hot keys, whatever the data: that is the bound
# on what the broadcast below carries.
HOT_ROWS = 1_000_000
HOT_FRACTION = 10_000


def spread_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    copies: str,
    how: str = "left_semi",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Null-safe join of ``rows`` with one row per key, hot keys cut into slots.

    ``per_key`` has each key once, with the number of ``rows`` under it in the column
    ``copies``. The rows of a hot key get slots in turn and the key's single row is
    repeated once per slot, so that no task receives more than about ``hot_rows`` rows of
    one key. AQE cannot split this join itself, as ``per_key`` is mostly an aggregate.
    """
    total = per_key.agg(F.sum(copies)).scalar()
    limit = F.greatest(F.lit(hot_rows), F.coalesce(total / HOT_FRACTION, F.lit(0)).cast("bigint"))
    slots = F.ceil(F.col(copies) / limit).cast("int")
    sliced = per_key.withColumn("__slots", slots)
    hot = sliced.where("__slots > 1").select(
        *[F.col(k).alias(f"__hot_{k}") for k in keys], F.col("__slots").alias("__hot_slots")
    )
    rows = rows.join(
        F.broadcast(hot), reduce(and_, [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys]), "left"
    )
    rows = rows.withColumn(
        "__slot",
        F.when(
            F.col("__hot_slots").isNotNull(),
            F.pmod(F.monotonically_increasing_id(), F.col("__hot_slots")).cast("int"),
        ).otherwise(0),
    ).drop("__hot_slots", *[f"__hot_{k}" for k in keys])
    repeated = sliced.withColumn("__key_slot", F.explode(F.sequence(F.lit(0), F.col("__slots") - 1)))
    repeated = repeated.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys],
        "__key_slot",
        *[c for c in per_key.columns if c not in keys],
    )
    matches = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    joined = rows.join(repeated, reduce(and_, [*matches, F.col("__slot") == F.col("__key_slot")]), how)
    return joined.drop("__slot", "__key_slot", *[f"__key_{k}" for k in keys])

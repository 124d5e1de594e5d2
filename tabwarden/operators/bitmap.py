"""Which rows may meet a set of keys, told by a bitmap of fixed size.

A set of keys of any number becomes a bitmap of at most ``BITMAP_BITS`` bits, which every task gets. A
row whose bit is not set meets no key and stays where it is; only the others are joined. Two keys that
share a bit make a row join for nothing and change no result, so a plan on it is the same at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.session import persisted_copy

#: At most 8 MB are broadcast, in rows of 4 KB.
BITMAP_BITS = 1 << 26
_ROW_BITS = 1 << 15


def _position(keys: tuple[Column | str, ...], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def key_bitmap(frame: DataFrame, *keys: Column | str, bits: int = BITMAP_BITS) -> DataFrame:
    """``bucket, bitmap`` of the frame's keys, at most ``bits`` / 32768 rows, written once."""
    at = frame.select(_position(keys, bits).alias("position"))
    bitmap = at.groupBy(F.floor(F.col("position") / _ROW_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("position", F.lit(_ROW_BITS))).alias("bitmap")
    )
    return persisted_copy(bitmap, "bitmap")


def with_hits(frame: DataFrame, bitmap: DataFrame, *keys: Column | str, bits: int = BITMAP_BITS, hit: str = "__hit") -> DataFrame:
    """The frame with a column that is false where the row's key is surely not in the bitmap."""
    rows = frame.withColumn("__position", _position(keys, bits))
    shared = F.broadcast(bitmap.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap")))
    rows = rows.join(shared, F.floor(F.col("__position") / _ROW_BITS) == F.col("__bucket"), "left")
    within = F.pmod("__position", F.lit(_ROW_BITS))
    byte = F.substring(F.col("__bitmap"), F.floor(within / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("long")
    found = F.coalesce(F.getbit(value, F.pmod(within, F.lit(8)).cast("int")) == 1, F.lit(False))
    return rows.withColumn(hit, found).drop("__position", "__bucket", "__bitmap")

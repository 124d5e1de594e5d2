"""Connected components of an edge table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.session import persisted_copy


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (smaller) neighbours of each node on the least node around it."""
    around = _both_ways(edges)
    if not large:
        around = around.where("b < a")
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    hung = around.join(least, "a")
    moved = hung.where("b > a") if large else hung
    out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("least").alias("b")))
    return out.where("a != b").distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """``a, b``: every node that isn't the least of its component, with that least node.

    ``edges`` has columns ``a, b`` of one ordered type; loops and repeated edges don't matter.
    Every round is written to the shared folder; the driver sees a count and a checksum.
    """
    current = persisted_copy(edges.where("a != b").distinct(), "edges")
    seen = None
    while True:
        state = current.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))).alias("sum")
        ).first()
        if state["n"] == 0 or (seen is not None and tuple(state) == seen):
            return current
        seen = tuple(state)
        current = persisted_copy(_star(_star(current, large=True), large=False), "edges")

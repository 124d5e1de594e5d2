"""Groups of identical texts, by refinement: byte length, then a hash of the head, then a hash of all of it.

Built of DataFrame functions only. Each step groups what the one before it left in groups of two or more. The rows
that are still in a group after the heads are told to the scan by a bitmap of fixed size; a bit that two
heads share costs a hash of one text too many and changes no result, so the plan is the same at any size.
Texts themselves are never shuffled or written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.operators.bitmap import BITMAP_BITS, key_bitmap, with_hits
from tabwarden.llm.common import text_of
from tabwarden.operators.skew import spread_join
from tabwarden.session import persisted_copy

#: Characters of a text's head.
HEAD_CHARS = 256


def exact_groups(
    documents: DataFrame,
    normalised: Column | None = None,
    head_chars: int = HEAD_CHARS,
    bitmap_bits: int = BITMAP_BITS,
    digest_all: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are compared after ``normalised`` (by default as they are; null counts as empty). The row with
    the largest id of a group stays; a null id is less than any other, and of repeated rows under
    the largest id exactly one stays. ``text_sha256`` is null where no hash of the whole text was needed,
    unless ``digest_all`` asks for all. Other columns than ``doc_id`` and ``text`` are not looked at.
    """
    texts = documents.select("doc_id", (text_of() if normalised is None else normalised).alias("text"))
    texts = texts.select(
        "doc_id",
        "text",
        F.octet_length("text").alias("size"),
        F.xxhash64(F.substring("text", 1, head_chars)).alias("head"),
    )
    heads = persisted_copy(texts.select("size", "head"), "dedup-heads")
    sizes = heads.groupBy("size").agg(F.count("*").alias("rows")).where("rows > 1")
    same_size = spread_join(heads, persisted_copy(sizes, "dedup-sizes"), ["size"], "rows")
    same_head = same_size.groupBy("size", "head").agg(F.count("*").alias("rows")).where("rows > 1")
    bitmap = key_bitmap(same_head, "size", "head", bits=bitmap_bits)

    marked = with_hits(texts, bitmap, "size", "head", bits=bitmap_bits, hit="survives")
    digest = F.sha2("text", 256)
    rows = marked.select(
        "doc_id",
        "size",
        "survives",
        (digest if digest_all else F.when(F.col("survives"), digest)).alias("text_sha256"),
        F.monotonically_increasing_id().alias("mark"),
    )
    rows = persisted_copy(rows, "dedup-rows")
    groups = (
        rows.where("survives")
        .groupBy("size", "text_sha256")
        .agg(F.max(F.struct("doc_id", "mark")).alias("top"), F.count("*").alias("group_size"))
    )
    groups = persisted_copy(groups, "dedup-groups")
    grouped = spread_join(rows.where("survives"), groups, ["size", "text_sha256"], "group_size", "inner")
    alone = rows.where("NOT survives").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return grouped.select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("mark") == F.col("top.mark")).alias("kept"), "text_sha256"
    ).unionByName(alone)

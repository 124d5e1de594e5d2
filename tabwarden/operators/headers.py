"""Checks on headers, given as rows ``(file, model_key, position, column)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.model import DATASET_COLUMN, SUBJECT_COLUMN, VISIT_COLUMN


def without_dataset_column(files: DataFrame, header: DataFrame, column: str = DATASET_COLUMN) -> DataFrame:
    """Files whose header lacks the dataset column."""
    having = header.where(F.col("column") == column).select("file")
    return files.join(having, "file", "left_anti")


def unknown_columns(header: DataFrame, cdes: DataFrame) -> DataFrame:
    """Header columns that are no variable of the file's model, a row id included."""
    known = cdes.select("model_key", F.col("code").alias("column"))
    return header.join(known, ["model_key", "column"], "left_anti")


def repeated_columns(header: DataFrame) -> DataFrame:
    """Names that a header uses more than once."""
    counted = header.groupBy("file", "model_key", "column").agg(F.count(F.lit(1)).alias("copies"))
    return counted.where("copies > 1")


def header_violations(files: DataFrame, header: DataFrame, cdes: DataFrame) -> DataFrame:
    """All header rules; ``files`` has ``(file, model_key, longitudinal)``."""
    found = [
        without_dataset_column(files, header).select(
            "file", "model_key", F.lit(DATASET_COLUMN).alias("column"), F.lit("missing_dataset_column").alias("rule")
        ),
        unknown_columns(header, cdes).select("file", "model_key", "column", F.lit("unknown_column").alias("rule")),
        repeated_columns(header).select("file", "model_key", "column", F.lit("duplicate_header").alias("rule")),
    ]
    for key in (SUBJECT_COLUMN, VISIT_COLUMN):
        missing = without_dataset_column(files.where("longitudinal"), header, key)
        found.append(
            missing.select("file", "model_key", F.lit(key).alias("column"), F.lit("missing_key_column").alias("rule"))
        )
    violations = found[0]
    for more in found[1:]:
        violations = violations.unionByName(more)
    return violations

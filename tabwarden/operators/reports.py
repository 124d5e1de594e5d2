"""Samples and verdicts from violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.model import DATASET_RULE_RANK, ErrorClass
from tabwarden.operators.row_checks import rank_of_rule


def violation_sample(
    violations: DataFrame, per_group: int, order: Sequence[str], group: Sequence[str] = ("file", "column", "rule")
) -> DataFrame:
    """The first ``per_group`` violations of each group.

    Spark limits each group before the shuffle as well, so a group with a third of all
    violations sends ``per_group`` rows per task and no more.
    """
    return violations.selectExpr(
        "*",
        f"CAST(row_number() OVER (PARTITION BY {_list(group)} ORDER BY {_list(order)}) AS int) AS sample_rank",
    ).where(F.col("sample_rank") <= per_group)


def file_verdicts(files: DataFrame, violations: DataFrame, scope: Sequence[str] = ("file",)) -> DataFrame:
    """One row per file: valid or not, first failing rule, error class, number of violations."""
    ranked = violations.withColumn("rank", rank_of_rule(F.col("rule")))
    failed = ranked.groupBy(*scope).agg(
        F.min_by(F.struct("rule", "column"), F.struct("rank", "column")).alias("first"),
        F.count(F.lit(1)).alias("n_violations"),
    )
    return files.join(failed, list(scope), "left").select(
        *files.columns,
        F.col("first").isNull().alias("is_valid"),
        F.col("first.rule").alias("first_rule"),
        F.col("first.column").alias("first_column"),
        F.when(F.col("first").isNotNull(), str(ErrorClass.DATASET)).alias("error_class"),
        F.coalesce("n_violations", F.lit(0)).cast("bigint").alias("n_violations"),
    )


def violations_by_class(violations: DataFrame, scope: Sequence[str] = ("file",)) -> DataFrame:
    """Violations counted per file and error class; all dataset rules are of one class."""
    known = F.col("rule").isin(*DATASET_RULE_RANK)
    return (
        violations.withColumn(
            "error_class", F.when(known, str(ErrorClass.DATASET)).otherwise(str(ErrorClass.DATA_MODEL))
        )
        .groupBy(*scope, "error_class", "rule")
        .agg(F.count(F.lit(1)).alias("n_violations"))
    )


def _list(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)

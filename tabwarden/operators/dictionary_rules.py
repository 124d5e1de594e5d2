"""Rules on dictionaries, each over the variables of all dictionaries at once.

Violation rows: model key, code and version, the variable's ordinal and code (null for
rules on the whole dictionary), rule, detail.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.text import is_identifier, model_name
from tabwarden.model import (
    CDE_TYPES,
    DATASET_COLUMN,
    DICTIONARY_RULE_CLASS,
    DICTIONARY_RULE_RANK,
    SQL_TYPES,
    SUBJECT_COLUMN,
    VISIT_COLUMN,
    ErrorClass,
)

_MODEL = ["model_key", "model_code", "model_version"]
from tabwarden.session import persisted_copy


def _variable_conditions() -> dict[str, Column]:
    """Rule name to the condition under which a single variable breaks it."""
    code, declared, sql_type = F.col("code"), F.col("type"), F.col("sql_type")
    return {
        "missing_code": code.isNull(),
        "bad_enumeration": F.col("bad_enumeration"),
        "bad_identifier": ~is_identifier(code),
        "missing_key": F.size("missing_keys") > 0,
        "categorical_without_enumerations": F.col("is_categorical") & ~F.col("has_enumerations"),
        "bad_bound": F.col("bad_bound"),
        "min_not_below_max": F.col("min") >= F.col("max"),
        "bad_type": ~declared.isin(*CDE_TYPES),
        "bad_sql_type": ~sql_type.isin(*SQL_TYPES),
    }


def variable_rule(cdes: DataFrame, rule: str) -> DataFrame:
    """Variables that break one rule."""
    return cdes.where(_variable_conditions()[rule]).select(
        *_MODEL, "ordinal", "code", F.lit(rule).alias("rule"), _detail(rule).alias("detail")
    )


def variable_violations(cdes: DataFrame) -> DataFrame:
    """All rules on single variables in one pass."""
    conditions = _variable_conditions()
    broken = F.array_compact(
        F.array(
            *[
                F.when(
                    condition,
                    F.struct(F.lit(rule).alias("rule"), _detail(rule).alias("detail")),
                )
                for rule, condition in conditions.items()
            ]
        )
    )
    return cdes.select(*_MODEL, "ordinal", "code", F.explode(broken).alias("v")).select(
        *_MODEL, "ordinal", "code", "v.rule", "v.detail"
    )


def missing_keys(cdes: DataFrame) -> DataFrame:
    """One row per required key that a variable lacks."""
    return cdes.select(*_MODEL, "ordinal", "code", F.explode("missing_keys").alias("key"))


def duplicate_cdes(cdes: DataFrame) -> DataFrame:
    """Codes that a dictionary uses more than once."""
    return (
        cdes.where("code IS NOT NULL")
        .groupBy(*_MODEL, "code")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select(
            *_MODEL,
            F.lit(None).cast("int").alias("ordinal"),
            "code",
            F.lit("duplicate_cde").alias("rule"),
            F.col("copies").cast("string").alias("detail"),
        )
    )


def case_clashes(cdes: DataFrame) -> DataFrame:
    """Codes of a dictionary that differ only in case, each spelling once.

    Columns of a table are told apart without case, so such variables can't stand in one table.
    """
    spelled = cdes.where("code IS NOT NULL").select(*_MODEL, "code").distinct()
    return (
        spelled.groupBy(*_MODEL, F.lower("code").alias("__folded"))
        .agg(F.array_sort(F.collect_set("code")).alias("spellings"))
        .where(F.size("spellings") > 1)
        .select(*_MODEL, F.explode("spellings").alias("code"), F.array_join("spellings", ",").alias("detail"))
        .select(
            *_MODEL, F.lit(None).cast("int").alias("ordinal"), "code", F.lit("code_case_clash").alias("rule"), "detail"
        )
    )


def model_violations(models: DataFrame, cdes: DataFrame) -> DataFrame:
    """Rules on whole dictionaries: version, name, dataset variable, longitudinal variables.

    The variables are reduced to one row per dictionary before they meet the models.
    """
    special = (
        cdes.where(F.col("code").isin(DATASET_COLUMN, SUBJECT_COLUMN, VISIT_COLUMN))
        .groupBy("model_key")
        .agg(
            _first_of(DATASET_COLUMN, F.min_by).alias("dataset_cde"),
            _first_of(SUBJECT_COLUMN, F.max_by).alias("subject_cde"),
            _first_of(VISIT_COLUMN, F.max_by).alias("visit_cde"),
        )
    )
    dataset, subject, visit = F.col("dataset_cde"), F.col("subject_cde"), F.col("visit_cde")
    is_json, is_longitudinal = F.col("is_json"), F.col("longitudinal")
    conditions = {
        "invalid_json": ~is_json,
        "missing_model_code": is_json & F.col("model_code").isNull(),
        "missing_version": is_json & F.col("model_version").isNull(),
        "dataset_cde_missing": is_json & dataset.isNull(),
        "dataset_cde_not_categorical": dataset.isNotNull()
        & ~F.coalesce(dataset["is_categorical"], F.lit(False)),
        "dataset_cde_not_text": dataset.isNotNull() & ~dataset["sql_type"].eqNullSafe("text"),
        "longitudinal_not_boolean": F.col("longitudinal_kind") == "other",
        "subjectid_missing": is_longitudinal & subject.isNull(),
        "visitid_missing": is_longitudinal & visit.isNull(),
        "visitid_not_categorical": is_longitudinal
        & visit.isNotNull()
        & ~F.coalesce(visit["is_categorical"], F.lit(False)),
        "visitid_not_text": is_longitudinal
        & visit.isNotNull()
        & ~visit["sql_type"].eqNullSafe("text"),
        "visitid_without_enumerations": is_longitudinal
        & visit.isNotNull()
        & ~visit["has_enumerations"],
        "bad_model_name": model_name(F.col("model_code"), F.col("model_version")).contains('"'),
    }
    broken = F.array_compact(F.array(*[F.when(c, rule) for rule, c in conditions.items()]))
    return (
        models.drop("body", "node")
        .join(special, "model_key", "left")
        .select(*_MODEL, F.explode(broken).alias("rule"))
        .select(
            *_MODEL,
            F.lit(None).cast("int").alias("ordinal"),
            F.lit(None).cast("string").alias("code"),
            "rule",
            F.lit(None).cast("string").alias("detail"),
        )
    )


def dictionary_violations(models: DataFrame, cdes: DataFrame) -> DataFrame:
    """Every violation of every rule, with its rank and error class.

    The variables are written first: four rules read them, and flattening is recursive.
    """
    cdes = persisted_copy(cdes, "variables")
    found = (
        variable_violations(cdes)
        .unionByName(duplicate_cdes(cdes))
        .unionByName(case_clashes(cdes))
        .unionByName(model_violations(models, cdes))
    )
    return found.withColumns(
        {"rank": rule_rank(F.col("rule")), "error_class": rule_class(F.col("rule"))}
    )


def dictionary_verdict(models: DataFrame, violations: DataFrame) -> DataFrame:
    """One row per dictionary: valid or not, the first failure in rule order (of several codes the smallest), how many."""
    phase = F.when(F.col("rank").between(10, 29), F.lit(10)).otherwise(F.col("rank"))
    order = F.struct(phase, F.coalesce("ordinal", F.lit(0)), F.col("rank"), F.coalesce("code", F.lit("")))
    failed = violations.groupBy("model_key").agg(
        F.min_by(F.struct("rule", "code", "error_class"), order).alias("first"),
        F.count(F.lit(1)).alias("n_violations"),
    )
    return models.join(failed, "model_key", "left").select(
        *_MODEL,
        F.col("first").isNull().alias("is_valid"),
        F.col("first.rule").alias("first_rule"),
        F.col("first.code").alias("first_code"),
        F.col("first.error_class").alias("error_class"),
        F.coalesce("n_violations", F.lit(0)).cast("bigint").alias("n_violations"),
    )


def rule_rank(rule: Column) -> Column:
    return _lookup(rule, DICTIONARY_RULE_RANK).cast("int")


def rule_class(rule: Column) -> Column:
    named = _lookup(rule, {name: str(value) for name, value in DICTIONARY_RULE_CLASS.items()})
    return F.coalesce(named, F.lit(str(ErrorClass.DATA_MODEL)))


def _lookup(key: Column, values: dict) -> Column:
    return F.try_element_at(
        F.create_map(*[F.lit(part) for pair in values.items() for part in pair]), key
    )


def _first_of(code: str, pick: Callable) -> Column:
    described = F.struct("is_categorical", "sql_type", "has_enumerations")
    return pick(described, F.when(F.col("code") == code, F.col("ordinal")))


def _detail(rule: str) -> Column:
    if rule == "missing_key":
        return F.array_join("missing_keys", ",")
    if rule == "min_not_below_max":
        return F.concat_ws(",", F.col("min").cast("string"), F.col("max").cast("string"))
    if rule == "bad_type":
        return F.col("type")
    if rule == "bad_sql_type":
        return F.col("sql_type")
    return F.lit(None).cast("string")

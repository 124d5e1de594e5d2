"""Checks on single rows, compiled from dictionary constraints to one scan.

The rows come as text. A clean row is decided by one generated filter; only rows that
break something are taken apart into violations ``(keys..., column, rule, value, detail)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.functions.text import EMPTY_ONLY, NA_TOKENS, nullify, to_int, to_real, typed
from tabwarden.model import (
    DATASET_RULE_RANK,
    MALFORMED,
    MAX_TEXT_LENGTH,
    SUBJECT_COLUMN,
    VISIT_COLUMN,
    Cde,
    Profile,
)
from tabwarden.session import keep_methods_compilable

# Beyond this many checked columns the generated code of one filter gets too large for
# the JVM; the constraints are then joined to unpivoted cells instead, with the same results.
WIDE_COLUMNS = 100

# What the constraints of one broadcast may hold.
MAX_BROADCAST_BYTES = 32 * 1024 * 1024

VIOLATION_COLUMNS = ["column", "rule", "value", "detail"]

# Where the number of a text cell stands while rules are evaluated.
_NUMBER = "__number_"


@dataclass(frozen=True)
class RowRule:
    """A condition on the cell of a column and, for ``sql_type`` int or real, on its number."""

    column: str
    rule: str
    broken: Column
    detail: str | Column | None = None
    sql_type: str = "text"
    names_column: bool = True


def quoted(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number_of(name: str) -> Column:
    """The number of a cell, null when its text is no number of the declared type."""
    return quoted(_NUMBER + name)


def null_tokens_of(profile: Profile) -> tuple[str, ...]:
    return EMPTY_ONLY if profile is Profile.LOAD else NA_TOKENS


def type_rule(cde: Cde) -> Iterable[RowRule]:
    """A value that is no number of the declared type; text takes everything."""
    if cde.sql_type in ("int", "real"):
        broken = quoted(cde.code).isNotNull() & number_of(cde.code).isNull()
        yield RowRule(cde.code, "type", broken, cde.sql_type, cde.sql_type)


def bound_rules(cde: Cde) -> Iterable[RowRule]:
    """Inclusive bounds, each on its own; a value that is no number is left to the type rule."""
    sql_type = cde.sql_type if cde.sql_type == "int" else "real"
    number = number_of(cde.code)
    if cde.maximum is not None:
        yield RowRule(cde.code, "above_max", number > F.lit(cde.maximum), F.lit(cde.maximum).cast("string"), sql_type)
    if cde.minimum is not None:
        yield RowRule(cde.code, "below_min", number < F.lit(cde.minimum), F.lit(cde.minimum).cast("string"), sql_type)


def enumeration_rule(cde: Cde) -> Iterable[RowRule]:
    """A value of a categorical column outside its codes, compared in the declared type."""
    if not cde.is_categorical or cde.codes is None:
        return
    is_number = cde.sql_type in ("int", "real")
    value = number_of(cde.code) if is_number else quoted(cde.code)
    codes = [typed(F.lit(code), cde.sql_type) for code in cde.codes]
    # A code that is no number of the type is null and would make the membership unknown.
    known = F.coalesce(value.isin(*codes), F.lit(False)) if codes else F.lit(False)
    yield RowRule(
        cde.code, "not_in_enumeration", value.isNotNull() & ~known, sql_type=cde.sql_type if is_number else "text"
    )


def storage_rule(cde: Cde) -> Iterable[RowRule]:
    """A valid value that does not fit the typed table."""
    if cde.sql_type == "text":
        too_long = F.char_length(quoted(cde.code)) > MAX_TEXT_LENGTH
        yield RowRule(cde.code, "storage_fit", too_long, str(MAX_TEXT_LENGTH))
    if cde.sql_type == "int":
        number = number_of(cde.code)
        yield RowRule(
            cde.code, "storage_fit", number.isNotNull() & number.try_cast("int").isNull(), "int", "int"
        )


def null_key_rules(columns: Sequence[str]) -> Iterable[RowRule]:
    """Longitudinal key columns that must not be null."""
    for column in (SUBJECT_COLUMN, VISIT_COLUMN):
        if column in columns:
            yield RowRule(column, f"null_{column}", quoted(column).isNull())


def malformed_rule() -> RowRule:
    """A row with too few or too many fields, which the reader has put aside."""
    return RowRule(MALFORMED, "malformed_row", quoted(MALFORMED).isNotNull(), names_column=False)


def rules_of(
    cdes: Iterable[Cde],
    columns: Sequence[str],
    profile: Profile = Profile.FILE,
    longitudinal: bool = False,
) -> list[RowRule]:
    """All rules that apply to the given columns, in the order in which they fail."""
    rules = list(null_key_rules(columns)) if longitudinal else []
    if profile is Profile.DATASET_ONLY:
        return rules
    if MALFORMED in columns:
        rules.append(malformed_rule())
    for cde in cdes:
        if cde.code in columns:
            rules += type_rule(cde)
            if profile is Profile.LOAD:
                rules += storage_rule(cde)
            rules += bound_rules(cde)
            rules += enumeration_rule(cde)
    return rules


def apply_rules(
    df: DataFrame, rules: Sequence[RowRule], keys: Sequence[str], tokens: Sequence[str] = NA_TOKENS
) -> DataFrame:
    """Violations of the rules; one narrow stage, no shuffle.

    Null tokens and numbers are worked out once per cell and the rules look at the results.
    Spark would move the filter below that and repeat the work in every rule, were it not
    for a column that is not deterministic.
    """
    if not rules:
        return df.select(*[quoted(k) for k in keys], *[F.lit(None).cast("string").alias(c) for c in VIOLATION_COLUMNS]).where(F.lit(False))
    keep_methods_compilable(df.sparkSession)
    columns = list(dict.fromkeys(rule.column for rule in rules))
    numbers = dict.fromkeys((rule.column, rule.sql_type) for rule in rules if rule.sql_type != "text")
    cells = df.select(
        F.struct(*[quoted(k) for k in keys]).alias("__row"),
        # The text of a malformed row is no cell, even where it reads like a null token.
        *[quoted(c) if c == MALFORMED else nullify(quoted(c), tokens).alias(c) for c in columns],
        # No null token is a number, so the raw text will do.
        *[typed(quoted(c), sql_type).alias(_NUMBER + c) for c, sql_type in numbers],
        F.spark_partition_id().alias("__partition"),
    )
    broken = cells.where(reduce(or_, [rule.broken for rule in rules]) & (F.col("__partition") >= 0))
    # Nulls are dropped after the explode and not inside the array: a lambda over the array
    # would leave generated code.
    found = F.array(
        *[
            F.when(
                rule.broken,
                F.struct(
                    F.lit(rule.column if rule.names_column else None).cast("string").alias("column"),
                    F.lit(rule.rule).alias("rule"),
                    quoted(rule.column).alias("value"),
                    F.lit(rule.detail).cast("string").alias("detail"),
                ),
            )
            for rule in rules
        ]
    )
    taken_apart = broken.select("__row", F.explode(found).alias("__v")).where("__v IS NOT NULL")
    return taken_apart.select(
        *[F.col(f"__row.`{k}`").alias(k) for k in keys],
        *[F.col(f"__v.{c}").alias(c) for c in VIOLATION_COLUMNS],
    )


def row_violations(
    df: DataFrame,
    cdes: Sequence[Cde],
    keys: Sequence[str],
    profile: Profile = Profile.FILE,
    longitudinal: bool = False,
    wide_columns: int = WIDE_COLUMNS,
) -> DataFrame:
    """Violations of all row rules of one layout."""
    columns = [c for c in df.columns if c not in keys or c in {d.code for d in cdes}]
    rules = rules_of(cdes, columns, profile, longitudinal)
    if len({rule.column for rule in rules}) <= wide_columns:
        return apply_rules(df, rules, keys, null_tokens_of(profile))
    found = wide_row_violations(df, cdes, keys, profile)
    others = [r for r in rules if r.rule == "malformed_row" or r.rule.startswith("null_")]
    if others:
        found = found.unionByName(apply_rules(df, others, keys, null_tokens_of(profile)))
    return found


def constraint_rows(df: DataFrame, cdes: Iterable[Cde]) -> DataFrame:
    """The constraints as rows ``(column, sql_type, min, max, codes)``."""
    rows = [(c.code, c.sql_type, c.minimum, c.maximum, _checked_codes(c)) for c in cdes]
    return df.sparkSession.createDataFrame(
        rows, "column string, sql_type string, min double, max double, codes array<string>"
    )


def _checked_codes(cde: Cde) -> list[str] | None:
    return list(cde.codes) if cde.is_categorical and cde.codes is not None else None


def broadcast_parts(cdes: Iterable[Cde], limit: int = MAX_BROADCAST_BYTES) -> list[list[Cde]]:
    """The constraints cut into parts whose texts stay below the limit.

    A single column with more codes than that makes a part of its own.
    """
    parts: list[list[Cde]] = [[]]
    size = 0
    for cde in cdes:
        weight = 64 + len(cde.code) + sum(len(code) + 16 for code in _checked_codes(cde) or ())
        if parts[-1] and size + weight > limit:
            parts.append([])
            size = 0
        parts[-1].append(cde)
        size += weight
    return parts


def wide_row_violations(
    df: DataFrame,
    cdes: Sequence[Cde],
    keys: Sequence[str],
    profile: Profile = Profile.FILE,
    limit: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """The same violations for very wide layouts: cells unpivoted and joined to constraints.

    The constraints are broadcast; they come from a list on the driver, so their size is
    known. Beyond the limit they go in parts, each with a scan of its own columns only.
    """
    parts = broadcast_parts([c for c in cdes if c.code in df.columns], limit)
    return reduce(DataFrame.unionByName, [_unpivoted(df, part, keys, profile) for part in parts])


def _unpivoted(df: DataFrame, cdes: Sequence[Cde], keys: Sequence[str], profile: Profile) -> DataFrame:
    columns = [c.code for c in cdes]
    row = df.select(
        F.struct(*[quoted(k) for k in keys]).alias("__row"), *[quoted(c) for c in columns]
    )
    cells = row.unpivot(["__row"], [quoted(c) for c in columns], "column", "value")
    cells = cells.withColumn("value", nullify(F.col("value"), null_tokens_of(profile)))
    constraints = F.broadcast(constraint_rows(df, cdes))
    found = cell_violations(
        cells.where("value IS NOT NULL").join(constraints, "column"), ["__row"], profile
    )
    return found.select(*[F.col(f"__row.`{k}`").alias(k) for k in keys], *VIOLATION_COLUMNS)


def cell_violations(cells: DataFrame, keys: Sequence[str], profile: Profile = Profile.FILE) -> DataFrame:
    """Violations of cells ``(keys..., column, value, sql_type, min, max, codes)``.

    Here the constraints are columns of the cell, so one plan serves every layout.
    """
    keep_methods_compilable(cells.sparkSession)
    value, sql_type = F.col("value"), F.col("sql_type")
    is_int, is_real = sql_type == "int", sql_type == "real"
    cells = cells.select(
        "*",
        F.when(is_int, to_int(value)).alias("__int"),
        F.when(~is_int, to_real(value)).alias("__real"),
        F.spark_partition_id().alias("__partition"),
    )
    as_int, as_real = F.col("__int"), F.col("__real")
    number = F.coalesce(as_int.cast("double"), as_real)
    bad_type = (is_int & as_int.isNull()) | (is_real & as_real.isNull())
    known = (
        F.when(is_int, F.exists("codes", lambda c: F.coalesce(to_int(c) == as_int, F.lit(False))))
        .when(is_real, F.exists("codes", lambda c: F.coalesce(to_real(c) == as_real, F.lit(False))))
        .otherwise(F.array_contains("codes", value))
    )
    too_large = ((sql_type == "text") & (F.char_length(value) > MAX_TEXT_LENGTH)) | (
        as_int.isNotNull() & as_int.try_cast("int").isNull()
    )
    conditions = [
        ("type", bad_type, sql_type),
        ("above_max", number > F.col("max"), F.col("max").cast("string")),
        ("below_min", number < F.col("min"), F.col("min").cast("string")),
        ("not_in_enumeration", F.col("codes").isNotNull() & ~bad_type & ~known, F.lit(None)),
    ]
    if profile is Profile.LOAD:
        limit = F.when(sql_type == "text", F.lit(str(MAX_TEXT_LENGTH))).otherwise(sql_type)
        conditions.insert(1, ("storage_fit", too_large, limit))
    broken = F.array(
        *[
            F.when(c, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
            for rule, c, detail in conditions
        ]
    )
    return (
        cells.where(reduce(or_, [c for _, c, _ in conditions]) & (F.col("__partition") >= 0))
        .select(*keys, "column", "value", F.explode(broken).alias("__v"))
        .where("__v IS NOT NULL")
        .select(*keys, "column", F.col("__v.rule").alias("rule"), "value", F.col("__v.detail").alias("detail"))
    )


def range_violations(df: DataFrame, column: str, minimum: float, maximum: float, keys: Sequence[str]) -> DataFrame:
    """Both bounds in one predicate; null and non-numeric values are not flagged."""
    number = to_real(nullify(quoted(column)))
    return df.where(~number.between(minimum, maximum)).select(
        *keys, F.lit(column).alias("column"), F.lit("out_of_range").alias("rule"), quoted(column).alias("value")
    )


def rank_of_rule(rule: Column) -> Column:
    pairs = [F.lit(part) for pair in DATASET_RULE_RANK.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), rule).cast("int")

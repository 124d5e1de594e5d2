"""Expressions over text cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that the public pandas CSV reader takes as null.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
EMPTY_ONLY = ("",)

# What counts as an integer, a real number and an identifier.
INT_PATTERN = r"^\s*[+-]?\d+\s*\z"
REAL_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
IDENTIFIER_PATTERN = r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*\z"


def nullify(cell: Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """The cell, or null when its text is one of the tokens."""
    return F.when(~cell.isin(*tokens), cell)


def to_int(cell: Column) -> Column:
    """BIGINT of an integer text, null for anything else."""
    return F.when(cell.rlike(INT_PATTERN), cell.try_cast("bigint"))


def to_real(cell: Column) -> Column:
    """DOUBLE of a number text; words such as ``nan`` and suffixes such as ``1f`` give null."""
    return F.when(cell.rlike(REAL_PATTERN), cell.try_cast("double"))


def typed(cell: Column, sql_type: str) -> Column:
    """The cell in the type that the dictionary declares."""
    if sql_type == "int":
        return to_int(cell)
    if sql_type == "real":
        return to_real(cell)
    return cell


def is_identifier(cell: Column) -> Column:
    return cell.rlike(IDENTIFIER_PATTERN)


def model_name(code: Column, version: Column) -> Column:
    """Full name of a data model."""
    return F.concat_ws(":", code, version)


def split_tag(expression: Column) -> tuple[Column, Column]:
    """Key and value of ``key=value``, cut at the first ``=``; value is null for a bare tag."""
    has_value = F.instr(expression, "=") > 0
    key = F.substring_index(expression, "=", 1)
    return key, F.when(has_value, expression.substr(F.length(key) + 2, F.length(expression)))

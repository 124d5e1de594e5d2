"""Views on the variable rows that checks and loads work from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwarden.model import DATASET_COLUMN, ROW_ID_COLUMN, SPARK_TYPES, Cde

_MODEL = ["model_key", "model_code", "model_version"]


def column_types(cdes: DataFrame) -> DataFrame:
    """Column code and declared type."""
    return cdes.select(*_MODEL, "code", "sql_type")


def bounded_columns(cdes: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Columns with a lower or upper bound, zero included; only those of the header if given."""
    bounded = cdes.where(F.col("min").isNotNull() | F.col("max").isNotNull())
    return _only_in_header(bounded.select(*_MODEL, "code", "min", "max"), header)


def enumerated_columns(cdes: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Categorical columns and their allowed codes; only those of the header if given."""
    listed = cdes.where("is_categorical AND enumerations IS NOT NULL")
    return _only_in_header(
        listed.select(*_MODEL, "code", F.map_keys("enumerations").alias("codes")), header
    )


def dataset_codes(cdes: DataFrame) -> DataFrame:
    """Allowed dataset codes of each model with their labels."""
    return cdes.where(F.col("code") == DATASET_COLUMN).select(
        *_MODEL, F.explode("enumerations").alias("dataset", "label")
    )


def longitudinal_flag(models: DataFrame) -> DataFrame:
    """Models whose dictionary says that rows are visits of subjects."""
    return models.where("longitudinal").select("model_key", "model_code", "model_version")


def cdes_of(cdes: DataFrame, model_key: str) -> DataFrame:
    return cdes.where(F.col("model_key") == model_key)


def compile_cdes(cdes: DataFrame) -> dict[str, list[Cde]]:
    """Driver-side constraints per model.

    Dictionaries are documents, not data: what is collected is what the JSON files hold.
    A code that occurs twice in a dictionary keeps its last description.
    """
    models: dict[str, dict[str, Cde]] = {}
    rows = cdes.select(
        "model_key", "ordinal", "code", "sql_type", "is_categorical", "min", "max", "enumerations"
    ).orderBy("model_key", "ordinal")
    for row in rows.toLocalIterator():
        codes = tuple(row["enumerations"]) if row["enumerations"] is not None else None
        models.setdefault(row["model_key"], {})[row["code"]] = Cde(
            row["code"], row["sql_type"], bool(row["is_categorical"]), row["min"], row["max"], codes
        )
    return {key: list(by_code.values()) for key, by_code in models.items()}


def primary_schema(cdes: list[Cde]) -> T.StructType:
    """Schema of a model's primary table: the row id, then the columns in dictionary order."""
    unknown = sorted({c.sql_type for c in cdes} - set(SPARK_TYPES), key=str)
    if unknown:
        raise ValueError(f"No column type for sql_type {unknown}")
    fields = [T.StructField(ROW_ID_COLUMN, T.LongType())]
    return T.StructType(fields + [T.StructField(c.code, SPARK_TYPES[c.sql_type]) for c in cdes])


def schema_rows(cdes: DataFrame) -> DataFrame:
    """The same schemas as rows ``(model, position, name, type)``, row id at position 0."""
    row_id = cdes.select(*_MODEL).distinct().select(
        *_MODEL,
        F.lit(0).alias("position"),
        F.lit(ROW_ID_COLUMN).alias("name"),
        F.lit("bigint").alias("type"),
    )
    columns = cdes.select(
        *_MODEL,
        F.col("ordinal").alias("position"),
        F.col("code").alias("name"),
        F.when(F.col("sql_type") == "text", "string")
        .when(F.col("sql_type") == "int", "bigint")
        .when(F.col("sql_type") == "real", "double")
        .alias("type"),
    )
    return row_id.unionByName(columns)


def _only_in_header(columns: DataFrame, header: DataFrame | None) -> DataFrame:
    """Keep the columns that a header frame ``(model_key, code)`` lists."""
    if header is None:
        return columns
    return columns.join(header.select("model_key", "code"), ["model_key", "code"], "left_semi")

"""Data model shared by all modules: dictionary rows, violations, error classes."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import types as T

# Names and codes that dictionaries and datasets use.
DICTIONARY_FILE = "CDEsMetadata.json"
DATASET_COLUMN = "dataset"
SUBJECT_COLUMN = "subjectid"
VISIT_COLUMN = "visitid"
ROW_ID_COLUMN = "row_id"
LONGITUDINAL_TAG = "longitudinal"
SQL_TYPES = ("text", "int", "real")
CDE_TYPES = ("nominal", "real", "integer", "text")
REQUIRED_KEYS = ("is_categorical", "code", "sql_type", "label", "type")
ENABLED = "ENABLED"
DISABLED = "DISABLED"
MAX_TEXT_LENGTH = 255

# Where the CSV reader puts the text of a row that does not fit its header.
MALFORMED = "__malformed"

# Where a row of a CSV file carries the path of its file; no header has this name.
PATH = "__path"

SPARK_TYPES = {"text": T.StringType(), "int": T.LongType(), "real": T.DoubleType()}


class Profile(StrEnum):
    """Which set of checks a dataset goes through.

    FILE checks the text of the file, LOAD also checks that the values fit the typed
    table and reads only the empty field as null, DATASET_ONLY checks the header, the
    dataset codes and the longitudinal keys.
    """

    FILE = "file"
    LOAD = "load"
    DATASET_ONLY = "dataset_only"


class ErrorClass(StrEnum):
    """What kind of failure a violation or verdict is."""

    USER_INPUT = "user_input"
    FILE = "file"
    DATASET = "dataset"
    DATA_MODEL = "data_model"
    FOREIGN_KEY = "foreign_key"
    DATABASE = "database"
    WARNING = "warning"


@dataclass(frozen=True)
class Cde:
    """One variable of a dictionary, as the row checks need it."""

    code: str
    sql_type: str
    is_categorical: bool = False
    minimum: float | None = None
    maximum: float | None = None
    codes: tuple[str, ...] | None = None


CDE_SCHEMA = T.StructType(
    [
        T.StructField("model_key", T.StringType()),
        T.StructField("model_code", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("group_path", T.ArrayType(T.StringType())),
        T.StructField("label", T.StringType()),
        T.StructField("sql_type", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("is_categorical", T.BooleanType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("enumerations", T.MapType(T.StringType(), T.StringType())),
        T.StructField("raw", T.StringType()),
    ]
)

# Order in which the checks of one dataset fail; a verdict names the first.
DATASET_RULE_RANK = {
    "missing_dataset_column": 1,
    "missing_key_column": 2,
    "duplicate_key": 2,
    "null_subjectid": 3,
    "null_visitid": 4,
    "unknown_column": 5,
    "duplicate_header": 6,
    "foreign_header": 6,
    "malformed_row": 7,
    "type": 8,
    "storage_fit": 9,
    "above_max": 10,
    "below_min": 11,
    "not_in_enumeration": 12,
    "unknown_dataset": 13,
}

# Order in which the rules of one dictionary fail.
DICTIONARY_RULE_RANK = {
    "invalid_json": 1,
    "missing_model_code": 2,
    "missing_version": 3,
    "missing_code": 10,
    "bad_enumeration": 11,
    "bad_identifier": 12,
    "missing_key": 13,
    "categorical_without_enumerations": 14,
    "bad_bound": 15,
    "min_not_below_max": 16,
    "bad_type": 17,
    "dataset_cde_missing": 30,
    "dataset_cde_not_categorical": 31,
    "dataset_cde_not_text": 32,
    "longitudinal_not_boolean": 33,
    "subjectid_missing": 34,
    "visitid_missing": 35,
    "visitid_not_categorical": 36,
    "visitid_not_text": 37,
    "visitid_without_enumerations": 38,
    "bad_model_name": 50,
    "duplicate_cde": 51,
    "bad_sql_type": 52,
    "code_case_clash": 53,
}

# Rules whose failure is not of the "data_model" class.
DICTIONARY_RULE_CLASS = {
    "invalid_json": ErrorClass.FILE,
    "missing_model_code": ErrorClass.USER_INPUT,
    "missing_version": ErrorClass.USER_INPUT,
    "bad_identifier": ErrorClass.USER_INPUT,
    "longitudinal_not_boolean": ErrorClass.USER_INPUT,
    "bad_model_name": ErrorClass.USER_INPUT,
    "duplicate_cde": ErrorClass.DATABASE,
    "code_case_clash": ErrorClass.DATABASE,
}

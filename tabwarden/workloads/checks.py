"""Dataset checks on ``events`` as text with dirt put in by fixed expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.functions.text import NA_TOKENS, nullify, to_int, to_real
from tabwarden.model import Cde, Profile
from tabwarden.operators.long_lists import long_enumeration_violations
from tabwarden.operators import keys, membership, reports, row_checks, tables
from tabwarden.plans.validate import validate_rows
from tabwarden.sources.csv_text import scan_text, typed_columns, with_nulls, write_csv
from tabwarden.session import scratch
from tabwarden.workloads.base import Registry, derive, oracle, quote_all, table

QUERIES = Registry()

# A third of the rows and more is in one file; some cells are dirty or null tokens.
EVENTS_TEXT = """
SELECT event_id,
       CASE WHEN user_id % 3 = 0 THEN 'site_0'
            ELSE concat('site_', CAST(user_id % 7 AS string)) END AS file,
       CASE WHEN event_id % 211 = 0 THEN NULL
            ELSE concat('ds', CAST(user_id % 7 AS string)) END AS dataset,
       CASE WHEN event_id % 301 = 0 THEN 'NA'
            ELSE concat('p', CAST(user_id AS string)) END AS subjectid,
       CASE WHEN event_id % 401 = 0 THEN ''
            WHEN event_id % 5 = 0 THEN 'BL'
            ELSE concat('v', CAST(event_id % 40 AS string)) END AS visitid,
       CASE WHEN event_id % 97 = 0 THEN 'bad'
            WHEN event_id % 89 = 0 THEN 'NaN'
            WHEN event_id % 83 = 0 THEN '1.5f'
            WHEN event_id % 79 = 0 THEN ' 7'
            ELSE CAST(value AS string) END AS value,
       CASE WHEN event_id % 71 = 0 THEN concat(regexp_extract(props, '([0-9]+)', 1), '.0')
            WHEN event_id % 67 = 0 THEN '-3'
            WHEN event_id % 61 = 0 THEN '3000000000'
            WHEN event_id % 59 = 0 THEN 'null'
            ELSE regexp_extract(props, '([0-9]+)', 1) END AS k,
       CASE WHEN event_id % 53 = 0 THEN 'N/A' ELSE event_type END AS event_type,
       CAST(user_id % 4 AS string) AS level
FROM {events}
"""

DATASETS = ("ds0", "ds1", "ds2", "ds3", "ds4")
EVENT_TYPES = ("click", "view", "purchase")
VISITS = ("BL", *[f"v{i}" for i in range(36)])
LEVELS = ("1", "2", "03", "x")

EVENTS_CDES = [
    Cde("dataset", "text", True, codes=DATASETS),
    Cde("subjectid", "text"),
    Cde("visitid", "text", True, codes=VISITS),
    Cde("value", "real", minimum=0.5, maximum=200.0),
    Cde("k", "int", minimum=0.0, maximum=80.0),
    Cde("event_type", "text", True, codes=EVENT_TYPES),
    Cde("level", "int", True, codes=LEVELS),
]
_BY_CODE = {c.code: c for c in EVENTS_CDES}

_CLEAN = [c.code for c in EVENTS_CDES]
_INT = r"\s*[+-]?\d+\s*"
_REAL = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"


def _with(tokens=NA_TOKENS) -> str:
    """CTEs: ``raw`` (text), ``t`` (null tokens gone), ``n`` (numbers next to it)."""
    cleaned = ", ".join(f"CASE WHEN {c} IN ({quote_all(tokens)}) THEN NULL ELSE {c} END AS {c}" for c in _CLEAN)
    return f"""
WITH raw AS ({oracle(EVENTS_TEXT)}),
t AS (SELECT event_id, file, {cleaned} FROM raw),
n AS (SELECT *,
        CASE WHEN regexp_full_match(value, '{_REAL}') THEN TRY_CAST(trim(value) AS DOUBLE) END AS value_n,
        CASE WHEN regexp_full_match(k, '{_INT}') THEN TRY_CAST(trim(k) AS BIGINT) END AS k_n,
        CASE WHEN regexp_full_match(level, '{_INT}') THEN TRY_CAST(trim(level) AS BIGINT) END AS level_n
      FROM t)
"""


def _found(rule: str, column: str, where: str, detail: str | None = None, extra: str = "file, event_id") -> str:
    shown = f"'{detail}'" if detail is not None else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT {extra}, '{column}' AS \"column\", '{rule}' AS rule, {column} AS value, "
        f"{shown} AS detail FROM n WHERE {where}"
    )


_TYPE_SQL = [
    _found("type", "value", "value IS NOT NULL AND value_n IS NULL", "real"),
    _found("type", "k", "k IS NOT NULL AND k_n IS NULL", "int"),
    _found("type", "level", "level IS NOT NULL AND level_n IS NULL", "int"),
]
_MAX_SQL = [_found("above_max", "value", "value_n > 200", "200.0"), _found("above_max", "k", "k_n > 80", "80.0")]
_MIN_SQL = [_found("below_min", "value", "value_n < 0.5", "0.5"), _found("below_min", "k", "k_n < 0", "0.0")]
_ENUM_SQL = [
    _found("not_in_enumeration", "dataset", f"dataset NOT IN ({quote_all(DATASETS)})"),
    _found("not_in_enumeration", "visitid", f"visitid NOT IN ({quote_all(VISITS)})"),
    _found("not_in_enumeration", "event_type", f"event_type NOT IN ({quote_all(EVENT_TYPES)})"),
    _found("not_in_enumeration", "level", "level_n NOT IN (1, 2, 3)"),
]
_NULL_KEY_SQL = [
    _found("null_subjectid", "subjectid", "subjectid IS NULL"),
    _found("null_visitid", "visitid", "visitid IS NULL"),
]
_DUPLICATE_KEY_SQL = """
SELECT file, CAST(NULL AS BIGINT) AS event_id, 'visitid,subjectid' AS "column", 'duplicate_key' AS rule,
       concat(coalesce(visitid, 'null'), ',', coalesce(subjectid, 'null')) AS value,
       CAST(count(*) AS VARCHAR) AS detail
FROM t GROUP BY file, visitid, subjectid HAVING count(*) > 1
"""
_MEMBERSHIP_SQL = f"""
SELECT DISTINCT file, CAST(NULL AS BIGINT) AS event_id, 'dataset' AS "column", 'unknown_dataset' AS rule,
       dataset AS value, CAST(NULL AS VARCHAR) AS detail
FROM t WHERE dataset IS NULL OR dataset NOT IN ({quote_all(DATASETS)})
"""
_ROW_SQL = _TYPE_SQL + _MAX_SQL + _MIN_SQL + _ENUM_SQL
_ALL_SQL = _ROW_SQL + _NULL_KEY_SQL + [_DUPLICATE_KEY_SQL, _MEMBERSHIP_SQL]


def _union(parts: list[str], tokens=NA_TOKENS) -> str:
    return _with(tokens) + " UNION ALL ".join(f"({p})" for p in parts)


def events_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, EVENTS_TEXT)


def _one_kind(spark: SparkSession, sf_dir: str, kind, wanted: str | None = None) -> DataFrame:
    rules = [r for cde in EVENTS_CDES for r in kind(cde) if wanted is None or r.rule == wanted]
    return row_checks.apply_rules(events_text(spark, sf_dir), rules, ["file", "event_id"])


@QUERIES.add("check_types", _union(_TYPE_SQL))
def check_types(spark, sf_dir):
    return _one_kind(spark, sf_dir, row_checks.type_rule)


@QUERIES.add("check_max", _union(_MAX_SQL))
def check_max(spark, sf_dir):
    return _one_kind(spark, sf_dir, row_checks.bound_rules, "above_max")


@QUERIES.add("check_min", _union(_MIN_SQL))
def check_min(spark, sf_dir):
    return _one_kind(spark, sf_dir, row_checks.bound_rules, "below_min")


@QUERIES.add("check_enumerations", _union(_ENUM_SQL))
def check_enumerations(spark, sf_dir):
    return _one_kind(spark, sf_dir, row_checks.enumeration_rule)


@QUERIES.add(
    "check_enumerations_long",
    """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, 'l_partkey' AS "column",
              'not_in_enumeration' AS rule, CAST(l_partkey AS VARCHAR) AS value
       FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)
       UNION ALL
       SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), 'l_suppkey', 'not_in_enumeration', CAST(l_suppkey AS VARCHAR)
       FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
)
def check_enumerations_long(spark, sf_dir):
    """Codes that are rows of other tables: parts of more than the least size, suppliers in credit."""
    cells = derive(
        spark,
        sf_dir,
        """SELECT CAST(l_orderkey AS string) AS l_orderkey, CAST(l_linenumber AS string) AS l_linenumber,
                  CAST(l_partkey AS string) AS l_partkey, CAST(l_suppkey AS string) AS l_suppkey FROM {lineitem}""",
    )
    codes = derive(
        spark,
        sf_dir,
        """SELECT 'l_partkey' AS column, CAST(p_partkey AS string) AS code FROM {part} WHERE p_size > 1
           UNION ALL SELECT 'l_suppkey', CAST(s_suppkey AS string) FROM {supplier} WHERE s_acctbal > 0""",
    )
    keys = ["l_orderkey", "l_linenumber"]
    found = long_enumeration_violations(cells, codes, keys, {"l_partkey": "int", "l_suppkey": "int"})
    return found.drop("detail")


@QUERIES.add(
    "check_range",
    _with()
    + """SELECT event_id, 'value' AS "column", 'out_of_range' AS rule, value
         FROM n WHERE value_n NOT BETWEEN 0.5 AND 200""",
)
def check_range(spark, sf_dir):
    return row_checks.range_violations(events_text(spark, sf_dir), "value", 0.5, 200.0, ["event_id"])


@QUERIES.add(
    "check_nulls_pass",
    _with()
    + """SELECT event_id FROM t WHERE dataset IS NULL OR value IS NULL OR k IS NULL OR event_type IS NULL
         EXCEPT SELECT event_id FROM ("""
    + " UNION ALL ".join(f"({p})" for p in _ROW_SQL)
    + ")",
)
def check_nulls_pass(spark, sf_dir):
    """Rows with a null cell that no row rule objects to."""
    rows = events_text(spark, sf_dir)
    cleaned = with_nulls(rows, NA_TOKENS, _CLEAN)
    nulls = cleaned.where("dataset IS NULL OR value IS NULL OR k IS NULL OR event_type IS NULL")
    found = row_checks.row_violations(rows, EVENTS_CDES, ["event_id"])
    return nulls.select("event_id").join(found, "event_id", "left_anti")


@QUERIES.add(
    "check_storage_fit",
    """SELECT doc_id, 'text' AS "column", 'storage_fit' AS rule, text AS value, '255' AS detail
       FROM documents WHERE length(text) > 255
       UNION ALL
       SELECT doc_id, 'wide' AS "column", 'storage_fit' AS rule, CAST(n_chars * 1000000 AS VARCHAR) AS value,
              'int' AS detail
       FROM documents WHERE n_chars * 1000000 > 2147483647""",
)
def check_storage_fit(spark, sf_dir):
    documents = derive(
        spark, sf_dir, "SELECT doc_id, text, CAST(n_chars * 1000000 AS string) AS wide FROM {documents}"
    )
    rules = [r for cde in (Cde("text", "text"), Cde("wide", "int")) for r in row_checks.storage_rule(cde)]
    return row_checks.apply_rules(documents, rules, ["doc_id"], ("",))


@QUERIES.add("validate_dataset", _union(_ALL_SQL))
def validate_dataset(spark, sf_dir):
    return validate_rows(events_text(spark, sf_dir), EVENTS_CDES, row_keys=["event_id"], longitudinal=True)


_FITS_SQL = [
    _found("storage_fit", "k", "k_n > 2147483647 OR k_n < -2147483648", "int"),
]


@QUERIES.add("validate_dataset_load_profile", _union(_ROW_SQL + _FITS_SQL + [_MEMBERSHIP_SQL], ("",)))
def validate_dataset_load_profile(spark, sf_dir):
    """Only the empty cell is null, and values must fit the typed table."""
    return validate_rows(events_text(spark, sf_dir), EVENTS_CDES, row_keys=["event_id"], profile=Profile.LOAD)


@QUERIES.add("validate_dataset_only", _union(_NULL_KEY_SQL + [_DUPLICATE_KEY_SQL, _MEMBERSHIP_SQL]))
def validate_dataset_only(spark, sf_dir):
    return validate_rows(
        events_text(spark, sf_dir),
        EVENTS_CDES,
        row_keys=["event_id"],
        profile=Profile.DATASET_ONLY,
        longitudinal=True,
    )


@QUERIES.add("validate_wide_layout", _union(_ROW_SQL))
def validate_wide_layout(spark, sf_dir):
    """The plan for very wide dictionaries: cells joined to constraints."""
    return row_checks.wide_row_violations(events_text(spark, sf_dir), EVENTS_CDES, ["file", "event_id"])


@QUERIES.add(
    "violation_sample",
    _with()
    + ", v AS ("
    + " UNION ALL ".join(f"({p})" for p in _ROW_SQL)
    + """)
    SELECT file, event_id, "column", rule, value, detail, sample_rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY file, "column", rule ORDER BY event_id) AS INTEGER) AS sample_rank
      FROM v) WHERE sample_rank <= 3""",
)
def violation_sample(spark, sf_dir):
    found = row_checks.row_violations(events_text(spark, sf_dir), EVENTS_CDES, ["file", "event_id"])
    return reports.violation_sample(found, 3, ["event_id"])


_RANKS = {
    "duplicate_key": 2,
    "null_subjectid": 3,
    "null_visitid": 4,
    "type": 8,
    "above_max": 10,
    "below_min": 11,
    "not_in_enumeration": 12,
    "unknown_dataset": 13,
}
_RANK_SQL = "CASE rule " + " ".join(f"WHEN '{r}' THEN {n}" for r, n in _RANKS.items()) + " END"


@QUERIES.add(
    "verdict_summary",
    _with()
    + ", v AS ("
    + " UNION ALL ".join(f"({p})" for p in _ALL_SQL)
    + f"""), f AS (SELECT DISTINCT file FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY {_RANK_SQL}, "column") AS o,
                 count(*) OVER (PARTITION BY file) AS n_violations FROM v)
    SELECT f.file, r.file IS NULL AS is_valid, r.rule AS first_rule, r."column" AS first_column,
           CASE WHEN r.file IS NOT NULL THEN 'dataset' END AS error_class,
           coalesce(n_violations, 0) AS n_violations
    FROM f LEFT JOIN r ON f.file = r.file AND r.o = 1""",
)
def verdict_summary(spark, sf_dir):
    rows = events_text(spark, sf_dir)
    found = validate_rows(rows, EVENTS_CDES, row_keys=["event_id"], longitudinal=True)
    return reports.file_verdicts(rows.select("file").distinct(), found)


@QUERIES.add(
    "violations_by_class",
    _with()
    + ", v AS ("
    + " UNION ALL ".join(f"({p})" for p in _ALL_SQL)
    + """) SELECT file, 'dataset' AS error_class, rule, count(*) AS n_violations FROM v GROUP BY file, rule""",
)
def violations_by_class(spark, sf_dir):
    found = validate_rows(events_text(spark, sf_dir), EVENTS_CDES, row_keys=["event_id"], longitudinal=True)
    return reports.violations_by_class(found)


_VISITS_TEXT = """
SELECT concat('f', CAST(l_suppkey % 3 AS string)) AS file,
       CASE WHEN l_partkey % 3 = 0 THEN 'hot' ELSE CAST(l_orderkey AS string) END AS subjectid,
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_linenumber AS string) END AS visitid,
       l_orderkey, l_partkey, l_suppkey, l_linenumber
FROM {lineitem}
"""


@QUERIES.add(
    "longitudinal_duplicates",
    f"""WITH t AS ({oracle(_VISITS_TEXT)}),
    d AS (SELECT file, subjectid, visitid FROM t GROUP BY ALL HAVING count(*) > 1)
    SELECT t.* FROM t SEMI JOIN d ON t.file IS NOT DISTINCT FROM d.file
      AND t.subjectid IS NOT DISTINCT FROM d.subjectid AND t.visitid IS NOT DISTINCT FROM d.visitid""",
)
def longitudinal_duplicates(spark, sf_dir):
    """Every copy of a repeated key; one key with null visit has a third of all rows."""
    return keys.rows_with_repeated_key(derive(spark, sf_dir, _VISITS_TEXT))


@QUERIES.add(
    "longitudinal_repeated_keys",
    f"""WITH t AS ({oracle(_VISITS_TEXT)})
    SELECT file, visitid, subjectid, count(*) AS copies FROM t GROUP BY ALL HAVING count(*) > 1""",
)
def longitudinal_repeated_keys(spark, sf_dir):
    return keys.repeated_keys(derive(spark, sf_dir, _VISITS_TEXT))


@QUERIES.add("subjectid_not_null", _with() + "SELECT event_id, file, visitid FROM t WHERE subjectid IS NULL")
def subjectid_not_null(spark, sf_dir):
    rows = with_nulls(events_text(spark, sf_dir), NA_TOKENS, _CLEAN)
    return keys.null_subjects(rows).select("event_id", "file", "visitid")


@QUERIES.add("visitid_not_null", _with() + "SELECT event_id, file, subjectid FROM t WHERE visitid IS NULL")
def visitid_not_null(spark, sf_dir):
    rows = with_nulls(events_text(spark, sf_dir), NA_TOKENS, _CLEAN)
    return keys.null_visits(rows).select("event_id", "file", "subjectid")


@QUERIES.add("distinct_datasets", _with() + "SELECT DISTINCT file, dataset FROM t")
def distinct_datasets(spark, sf_dir):
    return membership.distinct_datasets(with_nulls(events_text(spark, sf_dir), NA_TOKENS, ["dataset"]))


# Customers' segments are the datasets, the allowed codes come from the orders' customers.
_MEMBER_TEXT = """
SELECT concat('n', CAST(c_nationkey AS string)) AS file,
       CASE WHEN c_custkey % 17 = 0 THEN NULL
            ELSE concat(c_mktsegment, CAST(c_custkey % 100 AS string)) END AS dataset
FROM {customer}
"""
_ALLOWED_TEXT = """
SELECT DISTINCT concat(c_mktsegment, CAST(c_custkey % 100 AS string)) AS dataset
FROM {customer} WHERE c_acctbal > 0
"""


@QUERIES.add(
    "check_dataset_membership",
    f"""WITH t AS ({oracle(_MEMBER_TEXT)}), a AS ({oracle(_ALLOWED_TEXT)})
    SELECT DISTINCT file, 'dataset' AS "column", 'unknown_dataset' AS rule, dataset AS value,
           CAST(NULL AS VARCHAR) AS detail
    FROM t WHERE dataset IS NULL OR dataset NOT IN (SELECT dataset FROM a)""",
)
def check_dataset_membership(spark, sf_dir):
    found = membership.distinct_datasets(derive(spark, sf_dir, _MEMBER_TEXT))
    unknown = membership.unknown_datasets(found, derive(spark, sf_dir, _ALLOWED_TEXT))
    return membership.membership_violations(unknown)


@QUERIES.add("normalise_nulls", _with() + "SELECT event_id, value, k, event_type, subjectid, visitid FROM t")
def normalise_nulls(spark, sf_dir):
    rows = events_text(spark, sf_dir).select("event_id", "value", "k", "event_type", "subjectid", "visitid")
    return with_nulls(rows, NA_TOKENS, rows.columns[1:])


_PART_TEXT = """
SELECT CAST(p_partkey AS string) AS p_partkey,
       CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, ', "', p_brand, '"') ELSE p_name END AS p_name,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS p_brand,
       CAST(p_size AS string) AS p_size, CAST(p_retailprice AS string) AS p_retailprice
FROM {part}
"""


@QUERIES.add("scan_text_typed", oracle(_PART_TEXT))
def scan_text_typed(spark, sf_dir):
    """Through CSV files with quotes, commas and nulls, and back as text."""
    rows = derive(spark, sf_dir, _PART_TEXT)
    path = scratch(spark, "scan-text")
    write_csv(rows, path)
    return scan_text(spark, path, rows.columns).drop("file")


_CUSTOMER_TEXT = """
SELECT CAST(c_custkey AS string) AS c_custkey, c_name,
       CASE WHEN c_custkey % 13 = 0 THEN concat(CAST(c_nationkey AS string), '.0')
            ELSE CAST(c_nationkey AS string) END AS c_nationkey,
       CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 23 = 0 THEN 'inf'
            ELSE CAST(c_acctbal AS string) END AS c_acctbal
FROM {customer}
"""


@QUERIES.add(
    "typed_load",
    f"""WITH t AS ({oracle(_CUSTOMER_TEXT)})
    SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name,
           CASE WHEN regexp_full_match(c_nationkey, '{_INT}') THEN TRY_CAST(c_nationkey AS BIGINT) END AS c_nationkey,
           CASE WHEN regexp_full_match(c_acctbal, '{_REAL}') THEN TRY_CAST(c_acctbal AS DOUBLE) END AS c_acctbal
    FROM t""",
)
def typed_load(spark, sf_dir):
    """Through CSV files into typed columns; the empty cell is null."""
    rows = derive(spark, sf_dir, _CUSTOMER_TEXT)
    path = scratch(spark, "typed-load")
    write_csv(rows, path)
    cdes = [Cde("c_custkey", "int"), Cde("c_name", "text"), Cde("c_nationkey", "int"), Cde("c_acctbal", "real")]
    return typed_columns(with_nulls(scan_text(spark, path, rows.columns).drop("file"), ("",)), cdes)


# Ten rules on the line items, all columns as text.
_LINE_TEXT = """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS string) AS quantity, CAST(l_discount AS string) AS discount,
       CAST(l_tax AS string) AS tax, CAST(l_partkey AS string) AS partkey,
       CASE WHEN l_suppkey % 9 = 0 THEN 'n/a' ELSE l_returnflag END AS returnflag, l_linestatus AS linestatus,
       CAST(l_extendedprice AS string) AS price
FROM {lineitem}
"""
_LINE_CDES = [
    Cde("quantity", "real", minimum=2.0, maximum=48.0),
    Cde("discount", "real", maximum=0.09),
    Cde("tax", "real"),
    Cde("partkey", "int", minimum=5.0),
    Cde("returnflag", "text", True, codes=("A", "N")),
    Cde("linestatus", "text", True, codes=("F",)),
    Cde("price", "int"),
]
_LINE_FOUND = [
    ("quantity", "above_max", "CAST(quantity AS DOUBLE) > 48", "48.0"),
    ("quantity", "below_min", "CAST(quantity AS DOUBLE) < 2", "2.0"),
    ("discount", "above_max", "CAST(discount AS DOUBLE) > 0.09", "0.09"),
    ("partkey", "below_min", "CAST(partkey AS BIGINT) < 5", "5.0"),
    ("returnflag", "not_in_enumeration", "returnflag NOT IN ('A', 'N', 'n/a')", None),
    ("linestatus", "not_in_enumeration", "linestatus <> 'F'", None),
    ("price", "type", f"NOT regexp_full_match(price, '{_INT}')", "int"),
]


@QUERIES.add(
    "validate_lineitem",
    f"WITH t AS ({oracle(_LINE_TEXT)}) "
    + " UNION ALL ".join(
        f"""SELECT l_orderkey, l_linenumber, '{column}' AS "column", '{rule}' AS rule, {column} AS value,
            {"CAST(NULL AS VARCHAR)" if detail is None else f"'{detail}'"} AS detail FROM t WHERE {where}"""
        for column, rule, where, detail in _LINE_FOUND
    ),
)
def validate_lineitem(spark, sf_dir):
    return row_checks.row_violations(derive(spark, sf_dir, _LINE_TEXT), _LINE_CDES, ["l_orderkey", "l_linenumber"])

"""Dictionary operators and rules on one nested JSON dictionary per row of ``part``.

The JSON has variables at the root, in a group and in a group of that group. Its defects
come from fixed expressions, which the SQL side evaluates without any JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.operators import dictionary, dictionary_rules
from tabwarden.session import persisted_copy
from tabwarden.sources.dictionaries import flatten_dictionaries, parse_dictionaries
from tabwarden.workloads.base import Registry, derive, oracle

QUERIES = Registry()

# One value per part for each thing a dictionary says.
_FACTS = """
SELECT CAST(p_partkey AS string) AS model_key, p_partkey, p_brand, p_type, p_size,
       CAST(p_retailprice AS string) AS price,
       p_partkey % 29 = 0 AS broken,
       CASE WHEN p_partkey % 59 <> 0 THEN concat('1.', CAST(p_partkey % 10 AS string)) END AS model_version,
       p_partkey % 31 = 0 AS quote_in_name,
       CASE WHEN p_partkey % 6 = 0 THEN 'true' WHEN p_partkey % 6 = 1 THEN '"yes"'
            WHEN p_partkey % 6 = 2 THEN 'false' END AS longitudinal,
       CASE WHEN p_partkey % 53 = 0 THEN 'data_set' ELSE 'dataset' END AS c1,
       CASE WHEN p_partkey % 37 = 0 THEN 'int' ELSE 'text' END AS c1_sql_type,
       p_partkey % 11 <> 0 AS c1_categorical,
       p_partkey % 13 = 0 AS c1_repeats,
       CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE replace(p_name, ' ', '_') END AS c2,
       p_partkey % 17 <> 0 AS c2_label,
       CASE WHEN p_partkey % 19 = 0 THEN 'decimal' ELSE 'int' END AS c2_sql_type,
       CASE WHEN p_partkey % 23 = 0 THEN 'number' ELSE 'integer' END AS c2_type,
       p_partkey % 41 = 0 AS c2_categorical,
       p_partkey % 43 = 0 AS c2_text_bound,
       CASE WHEN p_partkey % 47 = 0 THEN 'price' ELSE 'weight' END AS c4,
       p_partkey % 4 <> 0 AS has_visit,
       p_partkey % 7 <> 0 AS visit_categorical,
       CASE WHEN p_partkey % 14 = 0 THEN 'int' ELSE 'text' END AS visit_sql_type,
       p_partkey % 10 <> 0 AS visit_codes,
       p_partkey % 9 <> 0 AS has_subject
FROM {part}
"""

_BODY = """
SELECT model_key,
  CASE WHEN broken THEN left(body, length(body) - 3) ELSE body END AS body
FROM (
  SELECT model_key, broken, concat(
    '{"code":"m', CASE WHEN quote_in_name THEN concat(chr(92), '"') ELSE '' END, model_key, '"',
    CASE WHEN model_version IS NULL THEN '' ELSE concat(',"version":"', model_version, '"') END,
    CASE WHEN longitudinal IS NULL THEN '' ELSE concat(',"longitudinal":', longitudinal) END,
    ',"label":"Model ', model_key, '","variables":[',
      '{"code":"', c1, '","label":"Dataset","sql_type":"', c1_sql_type, '","type":"nominal","isCategorical":',
      CAST(c1_categorical AS string), ',"enumerations":[{"code":"', p_brand, '","label":"B"},{"code":"', p_type,
      '","label":"T"}', CASE WHEN c1_repeats THEN concat(',{"code":"', p_brand, '","label":"B2"}') ELSE '' END, ']},',
      '{"code":"', c2, '"', CASE WHEN c2_label THEN ',"label":"Size"' ELSE '' END, ',"sql_type":"', c2_sql_type,
      '","type":"', c2_type, '","isCategorical":', CAST(c2_categorical AS string), ',"minValue":',
      CASE WHEN c2_text_bound THEN '"low"' ELSE CAST(p_size AS string) END, ',"max":30}',
    '],"groups":[{"name":"', p_type, '","label":"G","variables":[',
      '{"code":"price","label":"Price","sql_type":"real","type":"real","isCategorical":false,"minValue":0,"maxValue":',
      price, ',"units":"EUR"}',
    '],"groups":[{"name":"inner","label":"I","variables":[',
      '{"code":"', c4, '","label":"Weight","sql_type":"real","type":"real","is_categorical":false}',
      CASE WHEN has_visit THEN concat(',{"code":"visitid","label":"Visit","sql_type":"', visit_sql_type,
        '","type":"nominal","isCategorical":', CAST(visit_categorical AS string),
        CASE WHEN visit_codes THEN ',"enumerations":[{"code":"BL","label":"Base"},{"code":"FL1","label":"First"}]'
             ELSE '' END, '}') ELSE '' END,
      CASE WHEN has_subject THEN
        ',{"code":"subjectid","label":"Subject","sql_type":"text","type":"text","isCategorical":false}' ELSE '' END,
    ']}]}]}') AS body
  FROM facts)
"""


def dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(model_key, body)``: one JSON text per part, written out as files would be."""
    facts = derive(spark, sf_dir, _FACTS)
    body = _BODY.replace("{", "{{").replace("}", "}}").replace("FROM facts", "FROM {facts}")
    return persisted_copy(spark.sql(body, facts=facts), "dictionaries")


def models_and_cdes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parsed = parse_dictionaries(dictionaries(spark, sf_dir))
    return parsed, flatten_dictionaries(parsed)


# SQL side: the variables of each dictionary from the same facts, in flatten order.
_CDES_SQL = f"""
WITH facts AS ({oracle(_FACTS)}),
d AS (SELECT *, 'm' || CASE WHEN quote_in_name THEN '"' ELSE '' END || model_key AS model_code FROM facts),
ok AS (SELECT * FROM d WHERE NOT broken),
cdes AS (
  SELECT model_key, model_code, model_version, 1 AS ordinal, c1 AS code, '' AS groups, 'Dataset' AS label,
         c1_sql_type AS sql_type, 'nominal' AS type, c1_categorical AS is_categorical,
         CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, true AS has_codes, false AS text_bound FROM ok
  UNION ALL
  SELECT model_key, model_code, model_version, 2, c2, '', CASE WHEN c2_label THEN 'Size' END,
         c2_sql_type, c2_type, c2_categorical,
         CASE WHEN NOT c2_text_bound THEN CAST(p_size AS DOUBLE) END, 30.0, false, c2_text_bound FROM ok
  UNION ALL
  SELECT model_key, model_code, model_version, 3, 'price', p_type, 'Price', 'real', 'real', false,
         0.0, CAST(price AS DOUBLE), false, false FROM ok
  UNION ALL
  SELECT model_key, model_code, model_version, 4, c4, p_type || '/inner', 'Weight', 'real', 'real', false,
         NULL, NULL, false, false FROM ok
  UNION ALL
  SELECT model_key, model_code, model_version, 5, 'visitid', p_type || '/inner', 'Visit', visit_sql_type, 'nominal',
         visit_categorical, NULL, NULL, visit_codes, false FROM ok WHERE has_visit
  UNION ALL
  SELECT model_key, model_code, model_version, CASE WHEN has_visit THEN 6 ELSE 5 END, 'subjectid',
         p_type || '/inner', 'Subject', 'text', 'text', false, NULL, NULL, false, false FROM ok WHERE has_subject)
"""
_ENUMS_SQL = """,
enums AS (
  SELECT model_key, model_code, model_version, c1 AS code, p_brand AS enum_code,
         CASE WHEN c1_repeats THEN 'B2' ELSE 'B' END AS enum_label, c1_categorical AS is_categorical FROM ok
  UNION ALL SELECT model_key, model_code, model_version, c1, p_type, 'T', c1_categorical FROM ok
  UNION ALL SELECT model_key, model_code, model_version, 'visitid', 'BL', 'Base', visit_categorical
            FROM ok WHERE has_visit AND visit_codes
  UNION ALL SELECT model_key, model_code, model_version, 'visitid', 'FL1', 'First', visit_categorical
            FROM ok WHERE has_visit AND visit_codes)
"""
_MODEL = "model_key, model_code, model_version"


@QUERIES.add(
    "dictionary_parse",
    f"""WITH facts AS ({oracle(_FACTS)})
    SELECT model_key, NOT broken AS is_json,
           CASE WHEN NOT broken THEN 'm' || CASE WHEN quote_in_name THEN '"' ELSE '' END || model_key END AS model_code,
           CASE WHEN NOT broken THEN model_version END AS model_version,
           CASE WHEN NOT broken THEN 'Model ' || model_key END AS model_label,
           CASE WHEN broken OR longitudinal IS NULL THEN 'absent' WHEN longitudinal = '"yes"' THEN 'other'
                ELSE 'boolean' END AS longitudinal_kind
    FROM facts""",
)
def dictionary_parse(spark, sf_dir):
    parsed = parse_dictionaries(dictionaries(spark, sf_dir))
    return parsed.select("model_key", "is_json", "model_code", "model_version", "model_label", "longitudinal_kind")


@QUERIES.add(
    "flatten_dictionary",
    _CDES_SQL
    + f"""SELECT {_MODEL}, CAST(ordinal AS INTEGER) AS ordinal, code, groups, label, sql_type, type,
          is_categorical, min, max FROM cdes""",
)
def flatten_dictionary(spark, sf_dir):
    _, cdes = models_and_cdes(spark, sf_dir)
    return cdes.select(
        "model_key",
        "model_code",
        "model_version",
        "ordinal",
        "code",
        F.array_join("group_path", "/").alias("groups"),
        "label",
        "sql_type",
        "type",
        "is_categorical",
        "min",
        "max",
    )


@QUERIES.add(
    "enumerations_map",
    _CDES_SQL + _ENUMS_SQL + f"SELECT {_MODEL}, code, enum_code, enum_label FROM enums",
)
def enumerations_map(spark, sf_dir):
    _, cdes = models_and_cdes(spark, sf_dir)
    return cdes.select(
        "model_key", "model_code", "model_version", "code", F.explode("enumerations").alias("enum_code", "enum_label")
    )


@QUERIES.add(
    "dictionary_schema",
    _CDES_SQL
    + f"""SELECT {_MODEL}, CAST(ordinal AS INTEGER) AS position, code AS name,
           CASE sql_type WHEN 'text' THEN 'string' WHEN 'int' THEN 'bigint' WHEN 'real' THEN 'double' END AS type
          FROM cdes
          UNION ALL SELECT {_MODEL}, CAST(0 AS INTEGER), 'row_id', 'bigint' FROM ok""",
)
def dictionary_schema(spark, sf_dir):
    _, cdes = models_and_cdes(spark, sf_dir)
    return dictionary.schema_rows(cdes)


@QUERIES.add("cde_types", _CDES_SQL + f"SELECT {_MODEL}, code, sql_type FROM cdes")
def cde_types(spark, sf_dir):
    return dictionary.column_types(models_and_cdes(spark, sf_dir)[1])


# A header for each part: price for all, its second variable for every third part.
_HEADER_TEXT = """
SELECT CAST(p_partkey AS string) AS model_key, 'price' AS code FROM {part}
UNION ALL
SELECT CAST(p_partkey AS string), 'dataset' FROM {part} WHERE p_size > 10
UNION ALL
SELECT CAST(p_partkey AS string), replace(p_name, ' ', '_') FROM {part} WHERE p_size > 20
"""
_IN_HEADER = f"(model_key, code) IN (SELECT (model_key, code) FROM ({oracle(_HEADER_TEXT)}))"


@QUERIES.add(
    "cde_bounds",
    _CDES_SQL
    + f"SELECT {_MODEL}, code, min, max FROM cdes WHERE (min IS NOT NULL OR max IS NOT NULL) AND {_IN_HEADER}",
)
def cde_bounds(spark, sf_dir):
    """A lower bound of 0 counts, with or without an upper one."""
    _, cdes = models_and_cdes(spark, sf_dir)
    return dictionary.bounded_columns(cdes, derive(spark, sf_dir, _HEADER_TEXT))


@QUERIES.add(
    "cde_enums",
    _CDES_SQL
    + _ENUMS_SQL
    + f"SELECT {_MODEL}, code, enum_code FROM enums WHERE is_categorical AND {_IN_HEADER}",
)
def cde_enums(spark, sf_dir):
    _, cdes = models_and_cdes(spark, sf_dir)
    found = dictionary.enumerated_columns(cdes, derive(spark, sf_dir, _HEADER_TEXT))
    return found.withColumn("enum_code", F.explode("codes")).drop("codes")


@QUERIES.add(
    "dataset_enums",
    _CDES_SQL + _ENUMS_SQL + f"SELECT {_MODEL}, enum_code AS dataset, enum_label AS label FROM enums WHERE code = 'dataset'",
)
def dataset_enums(spark, sf_dir):
    return dictionary.dataset_codes(models_and_cdes(spark, sf_dir)[1])


def _variable_rule(where: str, rule: str, detail: str = "CAST(NULL AS VARCHAR)") -> str:
    return (
        f"SELECT {_MODEL}, CAST(ordinal AS INTEGER) AS ordinal, code, '{rule}' AS rule, {detail} AS detail "
        f"FROM cdes WHERE {where}"
    )


_VARIABLE_RULES = {
    "bad_identifier": _variable_rule(r"NOT regexp_full_match(code, '[A-Za-z_][A-Za-z0-9_]*')", "bad_identifier"),
    "missing_key": _variable_rule("label IS NULL", "missing_key", "'label'"),
    "categorical_without_enumerations": _variable_rule(
        "is_categorical AND NOT has_codes", "categorical_without_enumerations"
    ),
    "bad_bound": _variable_rule("text_bound", "bad_bound"),
    "min_not_below_max": _variable_rule(
        "min >= max", "min_not_below_max", "CAST(min AS VARCHAR) || ',' || CAST(max AS VARCHAR)"
    ),
    "bad_type": _variable_rule("type NOT IN ('nominal', 'real', 'integer', 'text')", "bad_type", "type"),
    "bad_sql_type": _variable_rule("sql_type NOT IN ('text', 'int', 'real')", "bad_sql_type", "sql_type"),
}
_DUPLICATES = f"""
SELECT {_MODEL}, CAST(NULL AS INTEGER) AS ordinal, code, 'duplicate_cde' AS rule, CAST(count(*) AS VARCHAR) AS detail
FROM cdes GROUP BY {_MODEL}, code HAVING count(*) > 1
"""
_LONGITUDINAL = "longitudinal = 'true' AND NOT broken"


def _model_rule(where: str, rule: str) -> str:
    return (
        f"SELECT model_key, CASE WHEN NOT broken THEN model_code END AS model_code, "
        f"CASE WHEN NOT broken THEN model_version END AS model_version, CAST(NULL AS INTEGER) AS ordinal, "
        f"CAST(NULL AS VARCHAR) AS code, '{rule}' AS rule, CAST(NULL AS VARCHAR) AS detail FROM d WHERE {where}"
    )


_MODEL_RULES = {
    "invalid_json": _model_rule("broken", "invalid_json"),
    "missing_version": _model_rule("NOT broken AND model_version IS NULL", "missing_version"),
    "dataset_cde_missing": _model_rule("NOT broken AND c1 <> 'dataset'", "dataset_cde_missing"),
    "dataset_cde_not_categorical": _model_rule(
        "NOT broken AND c1 = 'dataset' AND NOT c1_categorical", "dataset_cde_not_categorical"
    ),
    "dataset_cde_not_text": _model_rule(
        "NOT broken AND c1 = 'dataset' AND c1_sql_type <> 'text'", "dataset_cde_not_text"
    ),
    "longitudinal_not_boolean": _model_rule("NOT broken AND longitudinal = '\"yes\"'", "longitudinal_not_boolean"),
    "subjectid_missing": _model_rule(f"{_LONGITUDINAL} AND NOT has_subject", "subjectid_missing"),
    "visitid_missing": _model_rule(f"{_LONGITUDINAL} AND NOT has_visit", "visitid_missing"),
    "visitid_not_categorical": _model_rule(
        f"{_LONGITUDINAL} AND has_visit AND NOT visit_categorical", "visitid_not_categorical"
    ),
    "visitid_not_text": _model_rule(f"{_LONGITUDINAL} AND has_visit AND visit_sql_type <> 'text'", "visitid_not_text"),
    "visitid_without_enumerations": _model_rule(
        f"{_LONGITUDINAL} AND has_visit AND NOT visit_codes", "visitid_without_enumerations"
    ),
    # Without a version the name is the code alone.
    "bad_model_name": _model_rule("NOT broken AND quote_in_name", "bad_model_name"),
}
# Query name: the rules it runs.
_RULE_QUERIES = {
    "rule_identifier": ["bad_identifier"],
    "rule_categorical_enums": ["categorical_without_enumerations"],
    "rule_min_max": ["min_not_below_max"],
    "rule_bound_type": ["bad_bound"],
    "rule_type_domain": ["bad_type"],
    "rule_sql_type_domain": ["bad_sql_type"],
}
_MODEL_RULE_QUERIES = {
    "rule_json": ["invalid_json"],
    "rule_version": ["missing_version"],
    "rule_dataset_cde": ["dataset_cde_missing", "dataset_cde_not_categorical", "dataset_cde_not_text"],
    "rule_longitudinal_flag": ["longitudinal_not_boolean"],
    "rule_longitudinal_cdes": [
        "subjectid_missing",
        "visitid_missing",
        "visitid_not_categorical",
        "visitid_not_text",
        "visitid_without_enumerations",
    ],
    "rule_model_name": ["bad_model_name"],
}


def _register_rules() -> None:
    for name, (rule,) in _RULE_QUERIES.items():

        def variable_query(spark, sf_dir, rule=rule):
            return dictionary_rules.variable_rule(models_and_cdes(spark, sf_dir)[1], rule)

        QUERIES.add(name, _CDES_SQL + _VARIABLE_RULES[rule])(variable_query)
    for name, rules in _MODEL_RULE_QUERIES.items():

        def model_query(spark, sf_dir, rules=tuple(rules)):
            models, cdes = models_and_cdes(spark, sf_dir)
            return dictionary_rules.model_violations(models, cdes).where(F.col("rule").isin(*rules))

        QUERIES.add(name, _CDES_SQL + " UNION ALL ".join(f"({_MODEL_RULES[r]})" for r in rules))(model_query)


_register_rules()


@QUERIES.add(
    "rule_required_keys",
    _CDES_SQL + f"SELECT {_MODEL}, CAST(ordinal AS INTEGER) AS ordinal, code, 'label' AS key FROM cdes WHERE label IS NULL",
)
def rule_required_keys(spark, sf_dir):
    return dictionary_rules.missing_keys(models_and_cdes(spark, sf_dir)[1])


@QUERIES.add("rule_duplicate_cde", _CDES_SQL + _DUPLICATES)
def rule_duplicate_cde(spark, sf_dir):
    return dictionary_rules.duplicate_cdes(models_and_cdes(spark, sf_dir)[1])


# Rule ranks and classes as the verdict orders them, written out for SQL.
_RANKED = {
    "invalid_json": (1, "file"),
    "missing_version": (3, "user_input"),
    "bad_identifier": (12, "user_input"),
    "missing_key": (13, "data_model"),
    "categorical_without_enumerations": (14, "data_model"),
    "bad_bound": (15, "data_model"),
    "min_not_below_max": (16, "data_model"),
    "bad_type": (17, "data_model"),
    "dataset_cde_missing": (30, "data_model"),
    "dataset_cde_not_categorical": (31, "data_model"),
    "dataset_cde_not_text": (32, "data_model"),
    "longitudinal_not_boolean": (33, "user_input"),
    "subjectid_missing": (34, "data_model"),
    "visitid_missing": (35, "data_model"),
    "visitid_not_categorical": (36, "data_model"),
    "visitid_not_text": (37, "data_model"),
    "visitid_without_enumerations": (38, "data_model"),
    "bad_model_name": (50, "user_input"),
    "duplicate_cde": (51, "database"),
    "bad_sql_type": (52, "data_model"),
}
_VIOLATIONS_SQL = (
    _CDES_SQL
    + ", found AS ("
    + " UNION ALL ".join(f"({p})" for p in [*_VARIABLE_RULES.values(), _DUPLICATES, *_MODEL_RULES.values()])
    + "), ranked AS (SELECT found.*, r.rank, r.error_class FROM found JOIN (VALUES "
    + ", ".join(f"('{rule}', {rank}, '{kind}')" for rule, (rank, kind) in _RANKED.items())
    + ") r(rule, rank, error_class) USING (rule))"
)


@QUERIES.add("dictionary_violations", _VIOLATIONS_SQL + "SELECT * FROM ranked")
def dictionary_violations(spark, sf_dir):
    return dictionary_rules.dictionary_violations(*models_and_cdes(spark, sf_dir))


@QUERIES.add(
    "dictionary_verdict",
    _VIOLATIONS_SQL
    + """, numbered AS (
      SELECT *, count(*) OVER (PARTITION BY model_key) AS n,
             row_number() OVER (PARTITION BY model_key ORDER BY
               CASE WHEN rank BETWEEN 10 AND 29 THEN 10 ELSE rank END, coalesce(ordinal, 0), rank) AS o
      FROM ranked)
    SELECT d.model_key, CASE WHEN NOT broken THEN d.model_code END AS model_code,
           CASE WHEN NOT broken THEN d.model_version END AS model_version,
           n IS NULL AS is_valid, rule AS first_rule, code AS first_code, error_class,
           coalesce(n, 0) AS n_violations
    FROM d LEFT JOIN numbered USING (model_key) WHERE o = 1 OR o IS NULL""",
)
def dictionary_verdict(spark, sf_dir):
    models, cdes = models_and_cdes(spark, sf_dir)
    return dictionary_rules.dictionary_verdict(models, dictionary_rules.dictionary_violations(models, cdes))

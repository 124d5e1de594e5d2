"""Data dictionaries: whole-file JSON scan, parsing, flattening into variable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.model import CDE_SCHEMA, DICTIONARY_FILE, REQUIRED_KEYS
from tabwarden.sources import tree

# Groups in groups. The parser takes no text with deeper nesting than this allows, so a deeper dictionary is
# a violation of its own (``invalid_json``) and the others of a batch go on.
MAX_GROUP_DEPTH = 500

# Keys of a variable that go by two names.
RENAMED_KEYS = {"isCategorical": "is_categorical", "minValue": "min", "maxValue": "max"}

_ENUMERATION_TYPE = "array<struct<code:string,label:string>>"


def read_dictionaries(spark: SparkSession, root: str, file_glob: str = DICTIONARY_FILE) -> DataFrame:
    """One row ``(model_key, body)`` per dictionary file anywhere below ``root``, also in folders whose
    names begin with ``_`` or ``.``."""
    hidden, _, _ = tree.hidden_entries(spark, root, file_glob)
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_glob)
        .option("wholetext", True)
        .text([root, *hidden])
        .select(F.col("_metadata.file_path").alias("model_key"), F.col("value").alias("body"))
    )


def parse_dictionaries(dictionaries: DataFrame) -> DataFrame:
    """Parse ``(model_key, body)``; a text that is no JSON keeps its row with a null ``node``."""
    parsed = dictionaries.withColumn("node", F.try_parse_json("body"))
    flag = F.try_variant_get("node", "$.longitudinal", "variant")
    # Only a JSON boolean is a flag; Spark would also cast texts such as "yes".
    is_flag = F.schema_of_variant(flag) == "BOOLEAN"
    return parsed.select(
        "model_key",
        F.try_variant_get("node", "$.code", "string").alias("model_code"),
        F.try_variant_get("node", "$.version", "string").alias("model_version"),
        F.try_variant_get("node", "$.label", "string").alias("model_label"),
        F.col("node").isNotNull().alias("is_json"),
        F.when(flag.isNull(), "absent")
        .when(is_flag, "boolean")
        .otherwise("other")
        .alias("longitudinal_kind"),
        F.coalesce(F.when(is_flag, flag.try_cast("boolean")), F.lit(False)).alias("longitudinal"),
        "body",
        "node",
    )


def flatten_dictionaries(parsed: DataFrame) -> DataFrame:
    """One row per variable of every dictionary.

    A node's own variables come before those of its groups, groups in their order and
    depth first: the order of (path of group positions, position in the group). Columns
    are those of ``CDE_SCHEMA`` and the defects that the dictionary rules look at.
    """
    spark = parsed.sparkSession
    # A batch of many dictionaries may have more groups than the default limit.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    variables = spark.sql(
        f"""
        WITH RECURSIVE nodes (model_key, model_code, model_version, path, group_path, node)
        MAX RECURSION LEVEL {MAX_GROUP_DEPTH} AS (
            SELECT model_key, model_code, model_version,
                   CAST(array() AS array<int>), CAST(array() AS array<string>), node
            FROM {{parsed}}
            WHERE node IS NOT NULL
            UNION ALL
            SELECT n.model_key, n.model_code, n.model_version,
                   array_append(n.path, g.pos),
                   array_append(n.group_path, try_variant_get(g.value, '$.name', 'string')),
                   g.value
            FROM nodes n, LATERAL variant_explode(try_variant_get(n.node, '$.groups', 'variant')) g
        )
        SELECT model_key, model_code, model_version, path, group_path,
               v.pos AS position, v.value AS variable
        FROM nodes, LATERAL variant_explode(try_variant_get(node, '$.variables', 'variant')) v
        """,
        parsed=parsed.select("model_key", "model_code", "model_version", "node"),
    )
    return describe_variables(variables)


def describe_variables(variables: DataFrame) -> DataFrame:
    """Typed columns of each variable, numbered within its dictionary.

    The window holds the variables of one dictionary, which is one JSON document.
    """
    lower, upper = _value("min"), _value("max")
    listed = F.try_variant_get("variable", "$.enumerations", _ENUMERATION_TYPE)
    described = variables.select(
        "*",
        _text("code").alias("code"),
        _text("label").alias("label"),
        _text("sql_type").alias("sql_type"),
        _text("type").alias("type"),
        _value("is_categorical").try_cast("boolean").alias("is_categorical"),
        _number(lower).alias("min"),
        _number(upper).alias("max"),
        (_is_odd_bound(lower) | _is_odd_bound(upper)).alias("bad_bound"),
        _present("enumerations").alias("has_enumerations"),
        listed.alias("listed"),
        F.array_compact(F.array(*[F.when(~_present(key), key) for key in REQUIRED_KEYS])).alias(
            "missing_keys"
        ),
        F.to_json("variable").alias("raw"),
    )
    numbered = described.selectExpr(
        "*",
        "CAST(row_number() OVER (PARTITION BY model_key ORDER BY path, position) AS int) AS ordinal",
    )
    return numbered.select(
        *[c for c in CDE_SCHEMA.names if c != "enumerations"],
        enumeration_map(F.col("listed")).alias("enumerations"),
        "missing_keys",
        "has_enumerations",
        "bad_bound",
        (
            F.col("has_enumerations")
            & (
                F.col("listed").isNull()
                | F.exists("listed", lambda e: e["code"].isNull() | e["label"].isNull())
            )
        ).alias("bad_enumeration"),
    )


def enumeration_map(listed: Column) -> Column:
    """Map of code to label; of entries with the same code the last one counts."""
    usable = F.filter(listed, lambda e: e["code"].isNotNull())
    codes = F.transform(usable, lambda e: e["code"])
    last_of_code = F.filter(
        usable,
        lambda e, i: ~F.array_contains(F.slice(codes, i + 2, F.size(codes)), e["code"]),
    )
    unique = F.size(F.array_distinct(codes)) == F.size(codes)
    return F.map_from_entries(F.when(unique, usable).otherwise(last_of_code))


def _names(key: str) -> list[str]:
    return [old for old, new in RENAMED_KEYS.items() if new == key] + [key]


def _value(key: str) -> Column:
    """Variant under the key, the older name first."""
    return F.coalesce(
        *[F.try_variant_get("variable", f"$.{name}", "variant") for name in _names(key)]
    )


def _text(key: str) -> Column:
    return F.try_variant_get("variable", f"$.{key}", "string")


def _present(key: str) -> Column:
    return _value(key).isNotNull()


def _is_number(bound: Column) -> Column:
    return F.schema_of_variant(bound).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def _number(bound: Column) -> Column:
    return F.when(_is_number(bound), bound.try_cast("double"))


def _is_odd_bound(bound: Column) -> Column:
    return bound.isNotNull() & ~F.is_variant_null(bound) & ~_is_number(bound)

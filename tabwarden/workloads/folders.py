"""Folder operators on trees that Spark writes from ``events`` and ``supplier``.

A tree has one folder per group with a dictionary and CSV files of one or two layouts.
Which rows share a file is up to Spark, so results are told per group, not per file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabwarden.model import PATH
from tabwarden.operators import headers
from tabwarden.plans.validate import check_folder, structure
from tabwarden.plans.warehouse import Warehouse
from tabwarden.session import scratch
from tabwarden.sources import csv_text
from tabwarden.workloads.base import Registry, derive, oracle, quote_all
from tabwarden.workloads.checks import _INT, _REAL, DATASETS, EVENT_TYPES, EVENTS_TEXT

QUERIES = Registry()

# Spark's text writer chooses the names, so dictionaries are found by their ending.
_DICTIONARIES = "*.txt"

_GROUPED = f"SELECT *, CAST(event_id % 9 AS string) AS grp FROM ({EVENTS_TEXT}) AS e"
# Layout of groups 0 to 3, layout of the others with other columns in another order.
_FIRST = f"SELECT grp, event_id, dataset, value, k FROM ({_GROUPED}) AS g WHERE grp IN ('0', '1', '2', '3')"
_SECOND = f"SELECT grp, event_type, dataset, file, event_id FROM ({_GROUPED}) AS g WHERE grp IN ('4', '5')"
_THIRD = f"SELECT grp, value, event_type FROM ({_GROUPED}) AS g WHERE grp IN ('6', '7')"
# A group has a second layout next to its first.
_MORE = f"SELECT grp, event_type, dataset FROM ({_GROUPED}) AS g WHERE grp IN ('0', '8')"
_LAYOUTS = {
    _FIRST: ["event_id", "dataset", "value", "k"],
    _SECOND: ["event_type", "dataset", "file", "event_id"],
    _THIRD: ["value", "event_type"],
    _MORE: ["event_type", "dataset"],
}


def _variable(code: str, sql_type: str, kind: str, more: str = '"isCategorical":false') -> str:
    return f'{{"code":"{code}","label":"{code}","sql_type":"{sql_type}","type":"{kind}",{more}}}'


def _codes(values) -> str:
    listed = ",".join(f'{{"code":"{v}","label":"L {v}"}}' for v in values)
    return f'"isCategorical":true,"enumerations":[{listed}]'


def _dictionary(code_sql: str) -> str:
    """SQL for a dictionary text whose model code is the value of an expression."""
    body = (
        ',"version":"1.0","label":"Events","variables":['
        + ",".join(
            [
                _variable("event_id", "int", "integer"),
                _variable("dataset", "text", "nominal", _codes(DATASETS)),
                _variable("value", "real", "real", '"isCategorical":false,"minValue":0.5,"maxValue":200'),
            ]
        )
        + '],"groups":[{"name":"more","label":"More","variables":['
        + ",".join(
            [
                _variable("k", "int", "integer", '"isCategorical":false,"minValue":0,"maxValue":80'),
                _variable("event_type", "text", "nominal", _codes(EVENT_TYPES)),
            ]
        )
        + '],"groups":[]}]}'
    )
    return f"""concat('{{"code":"', {code_sql}, '"', '{body}')"""


def _write_dictionaries(spark: SparkSession, sf_dir: str, root: str, groups: DataFrame) -> None:
    """One dictionary file in the folder of each group, which is a number.

    Every task writes the files of its own groups. Spark's writer has the rights of each file set by processes of
    their own where the client has no native library, and all groups of a small table would be in one task.
    """
    text = groups.select("grp", F.expr(_dictionary("concat('g', grp)")).alias("value"))
    dealt = text.repartition(spark.sparkContext.defaultParallelism, "grp").sortWithinPartitions("grp")
    dealt.foreachPartition(_text_writer(root))


def _text_writer(root: str) -> Callable[[Iterable[Row]], None]:
    """Write ``(grp, value)`` sorted by ``grp`` as Spark's writer lays out a text file per folder."""

    def write(rows: Iterable[Row]) -> None:
        from pyarrow import fs

        url = urlparse(root)
        if url.scheme in ("", "file"):
            store, base = fs.LocalFileSystem(), url.path
        else:
            scheme = {"s3a": "s3", "s3n": "s3"}.get(url.scheme, url.scheme)
            store, base = fs.FileSystem.from_uri(f"{scheme}://{url.netloc}{url.path}")
        for grp, own in groupby(rows, lambda row: row["grp"]):
            folder = f"{base}/grp={'__HIVE_DEFAULT_PARTITION__' if grp is None else grp}"
            store.create_dir(folder, recursive=True)
            # All rows of a group are in one task, so a task that runs again writes the same files.
            with store.open_output_stream(f"{folder}/part-00000.txt") as out:
                for row in own:
                    out.write(f"{row['value'] or ''}\n".encode())

    return write


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """The dirty tree; group 8 has no dictionary."""
    root = scratch(spark, "tree")
    for text, columns in _LAYOUTS.items():
        rows = derive(spark, sf_dir, text)
        csv_text.write_csv(rows.select("grp", *columns), root, "append", ["grp"])
    groups = derive(spark, sf_dir, f"SELECT DISTINCT grp FROM ({_GROUPED}) AS g WHERE grp <> '8'")
    _write_dictionaries(spark, sf_dir, root, groups)
    return root


def _group_of(path):
    return F.regexp_extract(path, "grp=([0-9]+)", 1)


def _header(spark: SparkSession, root: str) -> DataFrame:
    files = csv_text.list_files(spark, root)
    return csv_text.header_rows(csv_text.read_headers(files))


_POSITIONS_SQL = " UNION ".join(
    f"SELECT grp, CAST({i} AS INTEGER) AS position, '{c}' AS \"column\" FROM ({oracle(text)})"
    for text, columns in _LAYOUTS.items()
    for i, c in enumerate(columns)
)


@QUERIES.add("header_columns", _POSITIONS_SQL)
def header_columns(spark, sf_dir):
    header = _header(spark, _tree(spark, sf_dir))
    return header.select(_group_of(F.col("file")).alias("grp"), "position", "column").distinct()


def _paired(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    models, cdes = structure(spark, root, _DICTIONARIES)
    return csv_text.pair_with_dictionaries(csv_text.list_files(spark, root), models), cdes


@QUERIES.add(
    "pair_files_with_models",
    f"""SELECT DISTINCT grp, CASE WHEN grp <> '8' THEN grp END AS model_grp FROM ({oracle(_GROUPED)})""",
)
def pair_files_with_models(spark, sf_dir):
    files, _ = _paired(spark, _tree(spark, sf_dir))
    return files.select(
        _group_of(F.col("file")).alias("grp"), _group_of(F.col("model_key")).alias("model_grp")
    ).distinct()


@QUERIES.add("check_dataset_column", f"SELECT DISTINCT grp FROM ({oracle(_THIRD)})")
def check_dataset_column(spark, sf_dir):
    root = _tree(spark, sf_dir)
    lacking = headers.without_dataset_column(csv_text.list_files(spark, root), _header(spark, root))
    return lacking.select(_group_of(F.col("file")).alias("grp")).distinct()


@QUERIES.add("check_unknown_columns", f"SELECT DISTINCT grp, 'file' AS \"column\" FROM ({oracle(_SECOND)})")
def check_unknown_columns(spark, sf_dir):
    root = _tree(spark, sf_dir)
    files, cdes = _paired(spark, root)
    header = _header(spark, root).join(files.where("model_key IS NOT NULL").select("file", "model_key"), "file")
    unknown = headers.unknown_columns(header, cdes)
    return unknown.select(_group_of(F.col("file")).alias("grp"), "column").distinct()


_PER_FILE = ("unknown_dataset", "unknown_column", "missing_dataset_column")


def _cell_sql(source: str, column: str, rule: str, where: str) -> str:
    return (
        f"SELECT grp, '{column}' AS \"column\", '{rule}' AS rule, {column} AS value, count(*) AS n "
        f"FROM {source} WHERE {where} GROUP BY ALL"
    )


def _cleaned(text: str, columns: list[str]) -> str:
    from tabwarden.functions.text import NA_TOKENS

    cells = ", ".join(
        f"CASE WHEN CAST({c} AS VARCHAR) IN ({quote_all(NA_TOKENS)}) THEN NULL ELSE CAST({c} AS VARCHAR) END AS {c}"
        for c in columns
    )
    return f"SELECT grp, {cells} FROM ({oracle(text)})"


_VALUE_N = f"CASE WHEN regexp_full_match(value, '{_REAL}') THEN TRY_CAST(trim(value) AS DOUBLE) END"
_K_N = f"CASE WHEN regexp_full_match(k, '{_INT}') THEN TRY_CAST(trim(k) AS BIGINT) END"
_UNKNOWN_DATASET = f"dataset IS NULL OR dataset NOT IN ({quote_all(DATASETS)})"
_FOLDER_SQL = (
    f"WITH a AS ({_cleaned(_FIRST, _LAYOUTS[_FIRST])}), b AS (SELECT * FROM ({_cleaned(_MORE, _LAYOUTS[_MORE])}) "
    f"WHERE grp = '0') "
    + " UNION ALL ".join(
        [
            _cell_sql("a", "value", "type", f"value IS NOT NULL AND {_VALUE_N} IS NULL"),
            _cell_sql("a", "value", "above_max", f"{_VALUE_N} > 200"),
            _cell_sql("a", "value", "below_min", f"{_VALUE_N} < 0.5"),
            _cell_sql("a", "k", "type", f"k IS NOT NULL AND {_K_N} IS NULL"),
            _cell_sql("a", "k", "above_max", f"{_K_N} > 80"),
            _cell_sql("a", "k", "below_min", f"{_K_N} < 0"),
            f"""SELECT grp, 'dataset' AS "column", 'not_in_enumeration' AS rule, dataset AS value, count(*) AS n
                FROM (SELECT grp, dataset FROM a UNION ALL SELECT grp, dataset FROM b)
                WHERE dataset NOT IN ({quote_all(DATASETS)}) GROUP BY ALL""",
            _cell_sql("b", "event_type", "not_in_enumeration", f"event_type NOT IN ({quote_all(EVENT_TYPES)})"),
            f"""SELECT DISTINCT grp, 'dataset', 'unknown_dataset', dataset, CAST(1 AS BIGINT)
                FROM (SELECT grp, dataset FROM a UNION ALL SELECT grp, dataset FROM b) WHERE {_UNKNOWN_DATASET}""",
            f"SELECT DISTINCT grp, 'file', 'unknown_column', CAST(NULL AS VARCHAR), CAST(1 AS BIGINT) FROM ({oracle(_SECOND)})",
            f"SELECT DISTINCT grp, 'dataset', 'missing_dataset_column', CAST(NULL AS VARCHAR), CAST(1 AS BIGINT) FROM ({oracle(_THIRD)})",
        ]
    )
)


def _violations_by_group(spark: SparkSession, root: str, **options) -> DataFrame:
    found = check_folder(spark, root, dictionary_glob=_DICTIONARIES, **options).violations
    counted = found.groupBy(_group_of(F.col("file")).alias("grp"), "column", "rule", "value").agg(
        F.count("*").alias("n")
    )
    # These are told once per file.
    return counted.withColumn("n", F.when(F.col("rule").isin(*_PER_FILE), F.lit(1)).otherwise(F.col("n")).cast("bigint"))


@QUERIES.add("validate_folder", _FOLDER_SQL)
def validate_folder(spark, sf_dir):
    """Dictionaries, headers, rows and dataset codes of a tree, constraints compiled per layout."""
    return _violations_by_group(spark, _tree(spark, sf_dir))


@QUERIES.add("validate_folder_one_plan", _FOLDER_SQL)
def validate_folder_one_plan(spark, sf_dir):
    """The same with constraints as data: one plan for any number of layouts."""
    return _violations_by_group(spark, _tree(spark, sf_dir), compiled_layouts=0)


@QUERIES.add(
    "validate_folder_verdicts",
    f"""SELECT DISTINCT 'file' AS kind, grp, grp = '8' AS is_valid,
          CASE WHEN grp = '8' THEN 'no_dictionary' WHEN grp IN ('6', '7') THEN 'missing_dataset_column'
               WHEN grp IN ('4', '5') THEN 'unknown_column' ELSE 'row rule' END AS first_rule,
          CASE WHEN grp = '8' THEN 'warning' ELSE 'dataset' END AS error_class
        FROM ({oracle(_GROUPED)})
        UNION ALL
        SELECT DISTINCT 'dictionary', grp, true, NULL, NULL FROM ({oracle(_GROUPED)}) WHERE grp <> '8'""",
)
def validate_folder_verdicts(spark, sf_dir):
    checked = check_folder(spark, _tree(spark, sf_dir), dictionary_glob=_DICTIONARIES)
    rule = F.col("first_rule")
    known = rule.isin("no_dictionary", "missing_dataset_column", "unknown_column")
    verdicts = checked.verdicts().select(
        "kind",
        _group_of(F.col("path")).alias("grp"),
        "is_valid",
        F.when(known, rule).when(rule.isNotNull(), "row rule").alias("first_rule"),
        "error_class",
    )
    return verdicts.distinct()


_VALID = f"""
SELECT grp, event_id, dataset, value, event_type FROM ({_GROUPED}) AS g
WHERE dataset IN ({quote_all(DATASETS)}) AND event_type IN ({quote_all(EVENT_TYPES)})
  AND value NOT IN ('bad', 'NaN', '1.5f', ' 7') AND CAST(value AS double) BETWEEN 0.5 AND 200
"""


@QUERIES.add(
    "load_folder",
    f"""WITH v AS ({oracle(_VALID)})
    SELECT 'g' || grp AS code, dataset, count(*) AS n, count(k) AS with_k, CAST(sum(event_id) AS BIGINT) AS ids,
           count(DISTINCT event_type) AS types,
           (SELECT count(*) FROM v AS w WHERE w.grp = v.grp) AS last_row_id,
           'L ' || dataset AS label
    FROM (SELECT *, NULL AS k FROM v) AS v GROUP BY grp, dataset""",
)
def load_folder(spark, sf_dir):
    """Validate a clean tree, register its models and load its rows; counts from the loaded tables."""
    root = scratch(spark, "clean")
    rows = derive(spark, sf_dir, _VALID)
    csv_text.write_csv(rows, root, "append", ["grp"])
    _write_dictionaries(spark, sf_dir, root, rows.select("grp").distinct())
    house = Warehouse(spark, scratch(spark, "warehouse"))
    house.initialise()
    house.load_folder(root, dictionary_glob=_DICTIONARIES)
    labels = house.table("datasets").join(house.table("data_models").select("data_model_id", F.col("code").alias("model")), "data_model_id")
    loaded = None
    for model in (f"g{i}" for i in range(9)):
        primary = house.primary(model, "1.0")
        last = primary.agg(F.max("row_id")).scalar()
        part = primary.groupBy("dataset").agg(
            F.count("*").alias("n"),
            F.count("k").alias("with_k"),
            F.sum("event_id").alias("ids"),
            F.count_distinct("event_type").alias("types"),
        ).select(F.lit(model).alias("code"), "*", last.alias("last_row_id"))
        loaded = part if loaded is None else loaded.unionByName(part)
    named = labels.select(F.col("model").alias("code"), F.col("code").alias("dataset"), "label")
    return loaded.join(named, ["code", "dataset"])


def _rename(spark: SparkSession, folder: str, plain: str, name: str) -> None:
    """Give an entry of the written tree another name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(folder)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in store.globStatus(hadoop.Path(f"{folder}/{plain}")):
        path = entry.getPath()
        store.rename(path, hadoop.Path(path.getParent(), name.replace("*", path.getName())))


def _awkward_tree(spark: SparkSession, sf_dir: str) -> str:
    """Valid rows in folders and files whose names begin with ``_`` and ``.`` or hold blanks, percent signs and brackets."""
    root = scratch(spark, "awkward")
    rows = derive(spark, sf_dir, _VALID)
    csv_text.write_csv(rows, root, "append", ["grp"])
    _write_dictionaries(spark, sf_dir, root, rows.select("grp").distinct())
    for grp, name in ((1, "_*"), (2, ".*"), (3, "a %41 *")):
        _rename(spark, f"{root}/grp={grp}", "*.csv", name)
    _rename(spark, root, "grp=4", "_hidden *")
    _rename(spark, root, "grp=5", ".hidden *")
    return root


@QUERIES.add(
    "scan_awkward_names",
    f"""SELECT grp, count(*) AS n, CAST(sum(CAST(event_id AS BIGINT)) AS BIGINT) AS ids, true AS is_valid,
               CASE grp WHEN '1' THEN '_' WHEN '2' THEN '.' WHEN '3' THEN 'a' ELSE 'p' END AS begins
        FROM ({oracle(_VALID)}) GROUP BY grp""",
)
def scan_awkward_names(spark, sf_dir):
    """Every file of a tree is listed, judged and read, whatever it and its folder are called."""
    checked = check_folder(spark, _awkward_tree(spark, sf_dir), dictionary_glob=_DICTIONARIES, stage=True)
    rows = None
    for frame in checked.staged.values():
        own = frame.select(F.col(PATH).alias("file"), "event_id")
        rows = own if rows is None else rows.unionByName(own)
    judged = checked.verdicts().where("kind = 'file'").select(F.col("path").alias("file"), "is_valid")
    # Counted per file on the map side first: the rows of few files would meet their verdicts in as few tasks.
    read = rows.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("event_id").cast("bigint")).alias("ids"))
    told = read.join(judged, "file").withColumn("begins", F.regexp_extract("file", "/([^/])[^/]*$", 1))
    counted = told.groupBy(_group_of(F.col("file")).alias("grp"), "begins").agg(
        F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.min("is_valid").alias("is_valid")
    )
    return counted


@QUERIES.add(
    "load_awkward_names",
    f"""SELECT 'g' || grp AS code, dataset, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
        FROM ({oracle(_VALID)}) GROUP BY grp, dataset""",
)
def load_awkward_names(spark, sf_dir):
    """The same tree loaded into a warehouse; counts from the loaded tables."""
    house = Warehouse(spark, scratch(spark, "warehouse"))
    house.initialise()
    house.load_folder(_awkward_tree(spark, sf_dir), dictionary_glob=_DICTIONARIES)
    loaded = None
    for model in (f"g{i}" for i in range(9)):
        part = house.primary(model, "1.0").groupBy("dataset").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
        part = part.select(F.lit(model).alias("code"), "*")
        loaded = part if loaded is None else loaded.unionByName(part)
    return loaded


@QUERIES.add(
    "register_models",
    """SELECT 'g' || s_suppkey AS code, '1.0' AS version, 'Events' AS label, 'ENABLED' AS status,
              row_number() OVER (ORDER BY 'g' || s_suppkey) AS data_model_id, CAST(5 AS BIGINT) AS n_cdes
       FROM supplier""",
)
def register_models(spark, sf_dir):
    """One dictionary file per supplier: checked as a batch, registered with one commit."""
    root = scratch(spark, "dictionaries")
    suppliers = derive(spark, sf_dir, "SELECT CAST(s_suppkey AS string) AS grp FROM {supplier}")
    _write_dictionaries(spark, sf_dir, root, suppliers)
    house = Warehouse(spark, scratch(spark, "warehouse"))
    house.initialise()
    house.add_data_models(root, _DICTIONARIES)
    counted = house.table("cdes").groupBy(F.col("model_code").alias("code")).agg(F.count("*").alias("n_cdes"))
    models = house.table("data_models").drop("body")
    return models.join(counted, "code")

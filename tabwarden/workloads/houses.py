"""Warehouses loaded from ``orders``, ``supplier`` and ``events``: deletions read back from the disk, the
variables of registered models, codes that differ only in case, and streams that load into a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.operators import catalog
from tabwarden.plans.validate import check_folder
from tabwarden.plans.warehouse import Warehouse
from tabwarden.session import scratch
from tabwarden.sources import csv_text
from tabwarden.workloads import streams
from tabwarden.workloads.base import Registry, derive, oracle
from tabwarden.workloads.folders import _DICTIONARIES, _codes, _variable, _write_dictionaries

QUERIES = Registry()

# Two models, three datasets each.
_ORDERS = """
SELECT CAST(o_orderkey % 2 AS string) AS grp, o_orderkey AS key, o_orderstatus AS dataset, o_totalprice AS price
FROM {orders}
"""
_BODY = ",".join(
    [
        _variable("dataset", "text", "nominal", _codes("FOP")),
        _variable("key", "int", "integer"),
        _variable("price", "real", "real"),
    ]
)
_HEAD, _TAIL = '{"code":"m', f'","version":"1.0","label":"Orders","variables":[{_BODY}],"groups":[]}}'


def _house(spark: SparkSession, sf_dir: str) -> Warehouse:
    root = scratch(spark, "orders-tree")
    rows = derive(spark, sf_dir, _ORDERS)
    csv_text.write_csv(rows, root, "append", ["grp"])
    texts = rows.select("grp").distinct().select("grp", F.concat(F.lit(_HEAD), "grp", F.lit(_TAIL)).alias("value"))
    texts.write.mode("append").partitionBy("grp").text(root)
    house = Warehouse(spark, scratch(spark, "warehouse"))
    house.initialise()
    house.load_folder(root, dictionary_glob=_DICTIONARIES)
    return house


def _stored(house: Warehouse) -> DataFrame:
    """All rows that lie in the files of the primary tables, whatever the catalog says about them."""
    place = F.col("_metadata.file_path")
    files = house.spark.read.schema("key bigint").option("recursiveFileLookup", True).parquet(f"{house.root}/primary")
    return files.select(
        F.regexp_extract(place, "/primary/([0-9]+)/", 1).cast("bigint").alias("data_model_id"),
        F.regexp_extract(place, "/dataset=([^/]*)/", 1).alias("dataset"),
        "key",
    )


def _content(house: Warehouse) -> DataFrame:
    """Models, datasets and stored rows; what only one of catalog and disk has shows as a row, too."""
    stored = _stored(house).groupBy("data_model_id", "dataset").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))
    listed = house.table("datasets").select("data_model_id", F.col("code").alias("dataset"), F.lit(True).alias("listed"))
    models = house.table("data_models").select("data_model_id", F.col("code").alias("model"))
    whole = listed.join(stored, ["data_model_id", "dataset"], "full").join(models, "data_model_id", "full")
    return whole.select(
        "model",
        "dataset",
        F.coalesce("listed", F.lit(False)).alias("listed"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "keys",
    )


_CONTENT_SQL = f"""SELECT 'm' || grp AS model, dataset, true AS listed, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys
FROM ({oracle(_ORDERS)}) WHERE {{kept}} GROUP BY ALL"""


@QUERIES.add("delete_dataset_stored", _CONTENT_SQL.format(kept="NOT (grp = '0' AND dataset = 'F')"))
def delete_dataset_stored(spark, sf_dir):
    """One dataset of one model leaves the catalog and the disk; its namesake in the other model stays."""
    house = _house(spark, sf_dir)
    house.delete_dataset("F", "m0", "1.0")
    return _content(house)


@QUERIES.add("delete_model_stored", _CONTENT_SQL.format(kept="grp <> '0'"))
def delete_model_stored(spark, sf_dir):
    """A model goes with its datasets and rows."""
    house = _house(spark, sf_dir)
    house.delete_data_model("m0", "1.0", force=True)
    return _content(house)


@QUERIES.add(
    "empty_model",
    _CONTENT_SQL.format(kept="grp <> '1'")
    + f" UNION ALL SELECT DISTINCT 'm1', dataset, true, CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM ({oracle(_ORDERS)}) WHERE grp = '1'",
)
def empty_model(spark, sf_dir):
    """The rows of one model go, the model and its datasets stay listed."""
    house = _house(spark, sf_dir)
    house.empty_model("m1", "1.0")
    return _content(house)


@QUERIES.add(
    "cleanup",
    f"""WITH o AS ({oracle(_ORDERS)})
    SELECT what, CAST(n_before AS BIGINT) AS n_before, CAST(0 AS BIGINT) AS n_after FROM (
      SELECT 'data_models' AS what, count(DISTINCT grp) AS n_before FROM o
      UNION ALL SELECT 'datasets', count(DISTINCT (grp, dataset)) FROM o
      UNION ALL SELECT 'cdes', 3 * count(DISTINCT grp) FROM o
      UNION ALL SELECT 'loads', count(DISTINCT (grp, dataset)) FROM o
      UNION ALL SELECT 'rows', count(*) FROM o)""",
)
def cleanup(spark, sf_dir):
    """Rows of the catalog tables, live loads and stored rows, before and after everything is dropped."""
    house = _house(spark, sf_dir)

    def counted() -> DataFrame:
        frames = {name: house.table(name) for name in ("data_models", "datasets", "cdes")}
        frames |= {"loads": house.table("loads").where("live"), "rows": _stored(house)}
        parts = [f.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, f in frames.items()]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    # What is counted goes with the removal, so the counts are taken now: five rows.
    before = spark.createDataFrame(counted().collect(), "what string, n_before bigint")
    house.cleanup()
    return before.join(counted().withColumnRenamed("n", "n_after"), "what")


@QUERIES.add(
    "load_model_cdes",
    """SELECT 'g' || s_suppkey AS model_code, c.* FROM supplier,
         (VALUES ('event_id', 'int', false, NULL, NULL, 0), ('dataset', 'text', true, NULL, NULL, 0),
                 ('value', 'real', false, 0.5::DOUBLE, 200::DOUBLE, 0), ('k', 'int', false, 0, 80, 1),
                 ('event_type', 'text', true, NULL, NULL, 1)) AS c(code, sql_type, is_categorical, "min", "max", depth)
       WHERE s_acctbal >= 0""",
)
def load_model_cdes(spark, sf_dir):
    """Variable rows of the wanted models, out of the catalog of all suppliers' dictionaries."""
    root = scratch(spark, "dictionaries")
    suppliers = derive(spark, sf_dir, "SELECT CAST(s_suppkey AS string) AS grp FROM {supplier}")
    _write_dictionaries(spark, sf_dir, root, suppliers)
    house = Warehouse(spark, scratch(spark, "warehouse"))
    house.initialise()
    house.add_data_models(root, _DICTIONARIES)
    wanted = derive(spark, sf_dir, "SELECT concat('g', CAST(s_suppkey AS string)) AS code FROM {supplier} WHERE s_acctbal >= 0")
    models = house.table("data_models").join(wanted, "code", "left_semi")
    return catalog.cdes_of_models(house.table("cdes"), models).select(
        "model_code", "code", "sql_type", "is_categorical", "min", "max", F.size("group_path").alias("depth")
    )


_CASES = "SELECT CAST(o_orderkey % 3 AS string) AS grp, o_orderkey AS key, o_orderstatus AS dataset FROM {orders}"


@QUERIES.add(
    "check_case_codes",
    f"""WITH g AS (SELECT DISTINCT grp FROM ({oracle(_CASES)}))
    SELECT 'dictionary' AS kind, grp, grp <> '0' AS is_valid, CASE grp WHEN '0' THEN 'code_case_clash' END AS first_rule,
           CASE grp WHEN '0' THEN 'KEY' END AS first_column FROM g
    UNION ALL SELECT 'file', grp, grp = '1', CASE grp WHEN '0' THEN 'invalid_dictionary' WHEN '2' THEN 'unknown_column' END,
           CASE grp WHEN '2' THEN 'Key' END FROM g""",
)
def check_case_codes(spark, sf_dir):
    """A dictionary with codes that differ only in case is refused; a header that spells a code otherwise has a foreign column."""
    root = scratch(spark, "cases")
    rows = derive(spark, sf_dir, _CASES)
    csv_text.write_csv(rows.where("grp <> '2'"), root, "append", ["grp"])
    csv_text.write_csv(rows.where("grp = '2'").select("grp", F.col("key").alias("Key"), "dataset"), root, "append", ["grp"])
    clash = F.replace(F.lit(_TAIL), F.lit('"code":"price"'), F.lit('"code":"KEY"'))
    tail = F.when(F.col("grp") == "0", clash).otherwise(_TAIL)
    texts = rows.select("grp").distinct().select("grp", F.concat(F.lit(_HEAD), "grp", tail).alias("value"))
    texts.write.mode("append").partitionBy("grp").text(root)
    judged = check_folder(spark, root, dictionary_glob=_DICTIONARIES).verdicts()
    group = F.regexp_extract("path", "grp=([0-9]+)", 1).alias("grp")
    return judged.select("kind", group, "is_valid", "first_rule", "first_column").distinct()


def _again(spark: SparkSession, checkpoint: str) -> None:
    """Take back what the stream notes after each batch, so that it runs the last batches again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{checkpoint}/commits")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _streamed_house(spark: SparkSession, sf_dir: str) -> tuple[Warehouse, str]:
    """A model of events, loaded by a stream whose only batch is then run once more."""
    variables = ",".join(
        [
            _variable("event_id", "int", "integer"),
            _variable("dataset", "text", "nominal", _codes(f"ds{i}" for i in range(7))),
            _variable("value", "real", "real", '"isCategorical":false,"maxValue":1000000'),
            _variable("later", "int", "integer"),
        ]
    )
    root, checkpoint, quarantine = (scratch(spark, label) for label in ("model", "stream", "quarantine"))
    text = f'{{"code":"events","version":"1.0","label":"Events","variables":[{variables}],"groups":[]}}'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(root)
    house = Warehouse(spark, scratch(spark, "warehouse"))
    house.initialise()
    house.add_data_models(root, _DICTIONARIES)
    arrivals = f"{streams._tree(spark, sf_dir)}/g*"
    for _ in range(2):
        writer = house.load_stream(arrivals, "events", "1.0", quarantine).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        _again(spark, checkpoint)
    return house, quarantine


@QUERIES.add(
    "stream_load",
    f"""SELECT 'ds' || user_id % 7 AS dataset, 'loaded' AS outcome, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids,
               count(value) AS n_values,
               (SELECT count(*) FROM events WHERE event_id % 5 IN (0, 3, 4)) AS last_row_id
        FROM events WHERE event_id % 5 IN (0, 3, 4) GROUP BY ALL
        UNION ALL SELECT NULL, rule, CAST(sum(n) AS BIGINT), NULL, NULL, NULL FROM ({streams._BROKEN_SQL}) GROUP BY rule""",
)
def stream_load(spark, sf_dir):
    """Arriving files of both headers in a model's primary table, each file and each batch once; the others' broken rows."""
    house, quarantine = _streamed_house(spark, sf_dir)
    primary = house.primary("events", "1.0")
    loaded = primary.groupBy("dataset").agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count("value").alias("n_values")
    )
    last = primary.agg(F.max("row_id")).scalar()
    loaded = loaded.select("dataset", F.lit("loaded").alias("outcome"), "n", "ids", "n_values", last.alias("last_row_id"))
    # Unknown datasets are told once per file, and Spark chose the files.
    refused = spark.read.parquet(quarantine).where("rule <> 'unknown_dataset'").groupBy(F.col("rule").alias("outcome"))
    return loaded.unionByName(refused.agg(F.count("*").alias("n")), allowMissingColumns=True)

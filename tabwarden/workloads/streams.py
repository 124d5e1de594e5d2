"""Streams over CSV files that Spark writes from all of ``events``.

Five folders: rows without a fault, rows that break a rule, rows with too few or too many fields,
files with another header, and rows without a fault again. Which rows share a file is up to
Spark, so all files of a folder have the same fate and results are told per folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.model import Cde
from tabwarden.session import scratch
from tabwarden.streaming.arrivals import (
    arriving_by_header,
    arriving_rows,
    arriving_violations,
    foreign_headers,
    running_datasets,
    validate_then_commit,
)
from tabwarden.workloads.base import Registry, derive

QUERIES = Registry()

COLUMNS = ("event_id", "dataset", "value")
_DATASETS = tuple(f"ds{i}" for i in range(7))
CDES = [
    Cde("event_id", "int"),
    Cde("dataset", "text", True, codes=_DATASETS),
    Cde("value", "real", maximum=1_000_000.0),
    Cde("later", "int"),
]

_LINES = """
SELECT event_id % 5 AS grp,
       CASE event_id % 10 WHEN 2 THEN concat(id, ',', dataset, ',', value, ',x')
                          WHEN 7 THEN id
                          WHEN 1 THEN concat(id, ',', dataset, ',bad')
                          WHEN 6 THEN concat(id, ',', dataset, ',2000000')
                          WHEN 3 THEN concat(dataset, ',', id, ',', value)
                          WHEN 8 THEN concat(dataset, ',', id, ',', value)
                          ELSE concat(id, ',', dataset, ',', value) END AS line
FROM (SELECT event_id, CAST(event_id AS string) AS id, concat('ds', CAST(user_id % 7 AS string)) AS dataset,
             coalesce(CAST(value AS string), '') AS value FROM {events}) AS e
"""
_HEADERS = {3: "dataset,event_id,value"}


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Whole lines go out as one column whose name is the header, so that rows can be ragged."""
    root = scratch(spark, "arrivals")
    lines = derive(spark, sf_dir, _LINES)
    for grp in range(5):
        own = lines.where(F.col("grp") == grp).select(F.col("line").alias(_HEADERS.get(grp, ",".join(COLUMNS))))
        own.write.option("header", True).option("sep", "\t").csv(f"{root}/g{grp}")
    return root


def _finish(writer, spark: SparkSession) -> None:
    """Run a stream over what has arrived."""
    query = writer.option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def _to_table(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    path = scratch(spark, "streamed")
    _finish(stream.writeStream.format("parquet").option("path", path), spark)
    return spark.read.schema(stream.schema).parquet(path)


def _grp():
    return F.regexp_extract("file", "/g([0-9])/", 1).alias("grp")


_BROKEN_SQL = """
SELECT CAST(event_id % 5 AS VARCHAR) AS grp, CASE WHEN event_id % 5 = 1 THEN 'value' END AS "column",
       CASE event_id % 10 WHEN 1 THEN 'type' WHEN 6 THEN 'above_max' ELSE 'malformed_row' END AS rule, count(*) AS n
FROM events WHERE event_id % 5 IN (1, 2) GROUP BY ALL
"""


@QUERIES.add("stream_violations", _BROKEN_SQL)
def stream_violations(spark, sf_dir):
    """Row rules on arriving files of both headers, in one query."""
    rows = arriving_by_header(spark, f"{_tree(spark, sf_dir)}/g*", COLUMNS)
    found = _to_table(arriving_violations(rows, CDES))
    return found.groupBy(_grp(), "column", "rule").agg(F.count("*").alias("n"))


@QUERIES.add("stream_datasets", "SELECT DISTINCT 'ds' || user_id % 7 AS dataset FROM events WHERE event_id % 10 <> 7")
def stream_datasets(spark, sf_dir):
    """Each dataset code once, over all files of both headers; a row with one field has no code."""
    rows = arriving_by_header(spark, f"{_tree(spark, sf_dir)}/g*", COLUMNS)
    return _to_table(running_datasets(rows)).where("dataset IS NOT NULL")


@QUERIES.add(
    "stream_foreign_headers",
    """SELECT CAST(event_id % 5 AS VARCHAR) AS grp, 'foreign_header' AS rule,
              CASE event_id % 5 WHEN 3 THEN 'dataset,event_id,value' ELSE 'event_id,dataset,value' END AS header
       FROM events GROUP BY ALL""",
)
def stream_foreign_headers(spark, sf_dir):
    """All files of headers with a column that the model lacks, once per file, told per folder."""
    rows = arriving_by_header(spark, f"{_tree(spark, sf_dir)}/g*", ["event_id", "dataset", "other"])
    found = _to_table(foreign_headers(rows))
    return found.select(_grp(), "rule", F.col("value").alias("header")).distinct()


@QUERIES.add(
    "stream_commit",
    f"""SELECT CAST(event_id % 5 AS VARCHAR) AS grp, 'committed' AS outcome, count(*) AS n,
               CAST(sum(event_id) AS BIGINT) AS ids, count(value) AS n_values
        FROM events WHERE event_id % 5 IN (0, 4) GROUP BY ALL
        UNION ALL SELECT grp, rule, n, NULL, NULL FROM ({_BROKEN_SQL})
        UNION ALL SELECT DISTINCT '2', 'unknown_dataset', CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
                  FROM events WHERE event_id % 10 = 7
        UNION ALL SELECT DISTINCT '3', 'foreign_header', CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
                  FROM events WHERE event_id % 5 = 3""",
)
def stream_commit(spark, sf_dir):
    """Whole files that are valid are committed, the others go to quarantine with their reasons."""
    good, bad = scratch(spark, "committed"), scratch(spark, "quarantine")
    rows = arriving_rows(spark, f"{_tree(spark, sf_dir)}/g*", COLUMNS, any_header=True)
    _finish(validate_then_commit(rows, CDES, good, bad), spark)
    committed = spark.read.parquet(good).withColumnRenamed("__path", "file").groupBy(_grp()).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count("value").alias("n_values")
    )
    # Unknown codes and foreign headers are told once per file.
    per_file = F.col("rule").isin("unknown_dataset", "foreign_header")
    refused = spark.read.parquet(bad).groupBy(_grp(), F.col("rule").alias("outcome")).agg(
        F.count("*").alias("all"), F.first(per_file).alias("once")
    )
    nothing = F.lit(None).cast("bigint")
    return committed.select("grp", F.lit("committed").alias("outcome"), "n", "ids", "n_values").unionByName(
        refused.select(
            "grp", "outcome", F.when(F.col("once"), 1).otherwise(F.col("all")).cast("bigint").alias("n"), nothing.alias("ids"), nothing.alias("n_values")
        )
    )

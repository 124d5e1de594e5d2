"""Primary tables from ``orders`` and ``lineitem``: padding, row ids, counts, append, scan."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwarden.operators import tables
from tabwarden.operators.rowids import assign_ordered_ids, assign_row_ids
from tabwarden.session import scratch
from tabwarden.sources.primary import append_load, read_primary
from tabwarden.workloads.base import Registry, derive, oracle, table

QUERIES = Registry()

_ORDERS = """
SELECT o_orderkey AS subject, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS dataset,
       o_totalprice AS price, o_orderpriority AS priority
FROM {orders}
"""
_LINES = "SELECT l_orderkey AS subject, l_returnflag AS dataset, l_quantity AS quantity FROM {lineitem}"
_TARGET = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("subject", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("priority", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)
_PADDED_SQL = f"""
SELECT dataset, subject, price, CAST(NULL AS DOUBLE) AS quantity, priority, CAST(NULL AS VARCHAR) AS note
FROM ({oracle(_ORDERS)})
UNION ALL
SELECT dataset, subject, NULL, quantity, NULL, NULL FROM ({oracle(_LINES)})
"""


@QUERIES.add("pad_columns", _PADDED_SQL)
def pad_columns(spark, sf_dir):
    orders, lines = derive(spark, sf_dir, _ORDERS), derive(spark, sf_dir, _LINES)
    return tables.pad_columns(orders, _TARGET).unionByName(tables.pad_columns(lines, _TARGET))


@QUERIES.add(
    "count_by_dataset", f"SELECT dataset, count(dataset) AS n FROM ({oracle(_ORDERS)}) GROUP BY dataset"
)
def count_by_dataset(spark, sf_dir):
    return tables.count_by_dataset(derive(spark, sf_dir, _ORDERS))


@QUERIES.add("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    return tables.row_count(table(spark, sf_dir, "lineitem"))


@QUERIES.add(
    "delete_dataset", f"SELECT * FROM ({oracle(_ORDERS)}) WHERE dataset IS DISTINCT FROM 'F'"
)
def delete_dataset(spark, sf_dir):
    return tables.without_dataset(derive(spark, sf_dir, _ORDERS), F.lit("F"))


@QUERIES.add(
    "assign_row_id",
    """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id, o_orderkey, o_orderstatus FROM orders""",
)
def assign_row_id(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_orderstatus")
    numbered = assign_ordered_ids(orders, ["o_orderdate", "o_orderkey"])
    return numbered.select("row_id", "o_orderkey", "o_orderstatus")


@QUERIES.add("assign_row_id_any_order", "SELECT row_number() OVER () AS row_id FROM lineitem")
def assign_row_id_any_order(spark, sf_dir):
    """1..n over all rows with no sort; which row has which number is free."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return assign_row_ids(lines).select("row_id")


def _loaded(spark, sf_dir):
    path = scratch(spark, "primary")
    rows = derive(spark, sf_dir, _LINES)
    append_load(rows, path, 1)
    append_load(rows, path, 2)
    schema = T.StructType([_TARGET["dataset"], _TARGET["subject"], _TARGET["quantity"]])
    live = spark.createDataFrame(
        [(1, "A"), (2, "A"), (1, "N"), (2, "R")], "load bigint, dataset string"
    )
    return path, schema, live


@QUERIES.add(
    "ingest_append",
    f"""WITH l AS ({oracle(_LINES)}) SELECT * FROM l UNION ALL SELECT * FROM l WHERE dataset = 'A'""",
)
def ingest_append(spark, sf_dir):
    """Two loads, of which one dataset is live twice and the others once."""
    path, schema, live = _loaded(spark, sf_dir)
    return read_primary(spark, path, schema, live)


@QUERIES.add("primary_scan", f"SELECT * FROM ({oracle(_LINES)}) WHERE dataset = 'R'")
def primary_scan(spark, sf_dir):
    path, schema, live = _loaded(spark, sf_dir)
    return read_primary(spark, path, schema, live, ["R"])

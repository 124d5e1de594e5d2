"""Catalog operators: suppliers as data models, customers as datasets, orders as requests.

One model has a third of all datasets and one dataset a third of all requests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwarden.model import ENABLED
from tabwarden.operators import catalog, tables
from tabwarden.operators.rowids import assign_ordered_ids
from tabwarden.plans.warehouse import SCHEMAS, Warehouse
from tabwarden.session import scratch
from tabwarden.workloads.base import Registry, derive, oracle

QUERIES = Registry()

_MODELS = """
SELECT s_suppkey AS data_model_id,
       concat('m', CAST(CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 1 ELSE s_suppkey END AS string)) AS code,
       '1.0' AS version, s_name AS label,
       CASE WHEN s_suppkey % 4 = 0 THEN 'DISABLED' ELSE 'ENABLED' END AS status
FROM {supplier}
"""
_DATASETS = """
SELECT c_custkey AS dataset_id,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(7 AS bigint) ELSE c_custkey % 83 END AS data_model_id,
       concat('ds', CAST(c_custkey AS string)) AS code, c_name AS label,
       CASE WHEN c_acctbal < 0 THEN 'DISABLED' ELSE 'ENABLED' END AS status
FROM {customer}
"""
_TAGS = """
SELECT c_custkey AS entity_id, lower(c_mktsegment) AS tag, CAST(0 AS bigint) AS seq FROM {customer}
UNION ALL
SELECT c_custkey, 'longitudinal', CAST(1 AS bigint) FROM {customer} WHERE c_acctbal > 5000
"""
_PROPERTIES = """
SELECT c_custkey AS entity_id, 'nation' AS key, CAST(c_nationkey AS string) AS value FROM {customer}
UNION ALL
SELECT c_custkey, 'segment', c_mktsegment FROM {customer} WHERE c_acctbal > 0
"""
_ENTITY = """CASE WHEN o_orderkey % 3 = 0 THEN CAST(5 AS bigint)
            WHEN o_orderkey % 50 = 1 THEN -1 - o_orderkey ELSE o_custkey END"""
_STATUS_CHANGES = f"""
SELECT {_ENTITY} AS dataset_id,
       CASE WHEN o_orderstatus = 'F' THEN 'DISABLED' ELSE 'ENABLED' END AS wanted, o_orderkey AS seq
FROM {{orders}}
"""
_TAG_REQUESTS = f"""
SELECT {_ENTITY} AS entity_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'building' WHEN o_orderkey % 5 = 1 THEN 'machinery'
            WHEN o_orderkey % 5 = 2 THEN 'longitudinal' ELSE lower(o_orderpriority) END AS tag,
       o_orderkey AS seq
FROM {{orders}}
"""
_PROPERTY_REQUESTS = f"""
SELECT {_ENTITY} AS entity_id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'nation' WHEN o_orderkey % 4 = 1 THEN 'segment' ELSE 'priority' END AS key,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 25 AS string)
            WHEN o_orderkey % 4 = 1 THEN 'BUILDING' ELSE o_orderpriority END AS value,
       o_orderstatus = 'F' AS force, o_orderkey AS seq
FROM {{orders}}
"""
_EXPRESSIONS = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 7 = 0 THEN 'a=b=c' WHEN o_orderkey % 11 = 0 THEN '=x' WHEN o_orderkey % 13 = 0 THEN 'k='
            WHEN o_orderkey % 2 = 0 THEN concat(o_orderstatus, '=', o_orderpriority) ELSE o_orderpriority END AS expression,
       o_orderstatus = 'P' AS remove
FROM {orders}
"""
_NAMED = """
SELECT o_orderkey, concat('m', CAST(CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE o_custkey % 120 END AS string)) AS code,
       '1.0' AS version
FROM {orders}
"""
_TARGETS = "SELECT * FROM (" + _MODELS + ") AS m WHERE status = 'ENABLED'"


def _ctes(**texts: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({oracle(text)})" for name, text in texts.items()) + " "


@QUERIES.add(
    "list_data_models",
    _ctes(m=_MODELS, d=_DATASETS)
    + """SELECT m.*, (SELECT count(*) FROM d WHERE d.data_model_id = m.data_model_id) AS count,
                code || ':' || version AS name FROM m""",
)
def list_data_models(spark, sf_dir):
    return catalog.list_data_models(derive(spark, sf_dir, _MODELS), derive(spark, sf_dir, _DATASETS))


@QUERIES.add("list_datasets", oracle(_DATASETS))
def list_datasets(spark, sf_dir):
    return catalog.list_datasets(derive(spark, sf_dir, _DATASETS))


@QUERIES.add(
    "catalog_select",
    _ctes(d=_DATASETS) + "SELECT dataset_id, code FROM d WHERE data_model_id = 7 AND status = 'DISABLED'",
)
def catalog_select(spark, sf_dir):
    return catalog.select_where(
        derive(spark, sf_dir, _DATASETS), ["dataset_id", "code"], {"data_model_id": 7, "status": "DISABLED"}
    )


@QUERIES.add(
    "resolve_ids",
    _ctes(r=_NAMED, m=_MODELS)
    + """, k AS (SELECT code, version, min(data_model_id) AS id, count(*) AS n FROM m GROUP BY ALL)
    SELECT r.*, CASE WHEN n = 1 THEN id END AS data_model_id,
           CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS resolution
    FROM r LEFT JOIN k USING (code, version)""",
)
def resolve_ids(spark, sf_dir):
    return catalog.resolve(
        derive(spark, sf_dir, _NAMED), derive(spark, sf_dir, _MODELS), ["code", "version"], "data_model_id"
    )


@QUERIES.add(
    "longitudinal_models",
    _ctes(d=_DATASETS, t=_TAGS)
    + """SELECT dataset_id AS data_model_id, code FROM d
         WHERE dataset_id IN (SELECT entity_id FROM t WHERE tag = 'longitudinal')""",
)
def longitudinal_models(spark, sf_dir):
    models = derive(spark, sf_dir, _DATASETS).select(F.col("dataset_id").alias("data_model_id"), "code")
    return catalog.longitudinal_models(models, derive(spark, sf_dir, _TAGS))


@QUERIES.add(
    "status_outcomes",
    _ctes(d=_DATASETS, c=_STATUS_CHANGES)
    + """, w AS (SELECT dataset_id, max_by(wanted, seq) AS wanted, count(*) AS requests FROM c GROUP BY dataset_id)
    SELECT w.*, CASE WHEN status IS NULL THEN 'not_found' WHEN status = wanted THEN 'already' ELSE 'changed' END
           AS outcome FROM w LEFT JOIN d USING (dataset_id)""",
)
def status_outcomes(spark, sf_dir):
    return catalog.status_outcomes(
        derive(spark, sf_dir, _DATASETS), derive(spark, sf_dir, _STATUS_CHANGES), "dataset_id"
    )


@QUERIES.add(
    "apply_status",
    _ctes(d=_DATASETS, c=_STATUS_CHANGES)
    + """, w AS (SELECT dataset_id, max_by(wanted, seq) AS wanted FROM c GROUP BY dataset_id)
    SELECT dataset_id, data_model_id, code, label, coalesce(wanted, status) AS status
    FROM d LEFT JOIN w USING (dataset_id)""",
)
def apply_status(spark, sf_dir):
    return catalog.apply_status(
        derive(spark, sf_dir, _DATASETS), derive(spark, sf_dir, _STATUS_CHANGES), "dataset_id"
    )


_ASKED_TAGS = """, a AS (SELECT entity_id, tag, min(seq) AS seq, count(*) AS requests FROM r GROUP BY entity_id, tag),
b AS (SELECT a.*, EXISTS (SELECT 1 FROM t WHERE t.entity_id = a.entity_id AND t.tag = a.tag) AS has FROM a) """


@QUERIES.add(
    "tag_additions",
    _ctes(t=_TAGS, r=_TAG_REQUESTS)
    + _ASKED_TAGS
    + """SELECT entity_id, tag, seq, requests, CASE WHEN has THEN 'exists' ELSE 'added' END AS outcome,
                requests - CASE WHEN has THEN 0 ELSE 1 END AS rejected FROM b""",
)
def tag_additions(spark, sf_dir):
    return catalog.tag_additions(derive(spark, sf_dir, _TAGS), derive(spark, sf_dir, _TAG_REQUESTS))


@QUERIES.add(
    "add_tags",
    _ctes(t=_TAGS, r=_TAG_REQUESTS)
    + _ASKED_TAGS
    + "SELECT * FROM t UNION ALL SELECT entity_id, tag, seq FROM b WHERE NOT has",
)
def add_tags(spark, sf_dir):
    return catalog.add_tags(derive(spark, sf_dir, _TAGS), derive(spark, sf_dir, _TAG_REQUESTS))


@QUERIES.add(
    "tag_removals",
    _ctes(t=_TAGS, r=_TAG_REQUESTS)
    + _ASKED_TAGS
    + """SELECT entity_id, tag, seq, requests, CASE WHEN has THEN 'removed' ELSE 'missing' END AS outcome,
                requests - CASE WHEN has THEN 1 ELSE 0 END AS rejected FROM b""",
)
def tag_removals(spark, sf_dir):
    return catalog.tag_removals(derive(spark, sf_dir, _TAGS), derive(spark, sf_dir, _TAG_REQUESTS))


@QUERIES.add(
    "remove_tags",
    _ctes(t=_TAGS, r=_TAG_REQUESTS)
    + "SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.entity_id = t.entity_id AND r.tag = t.tag)",
)
def remove_tags(spark, sf_dir):
    return catalog.remove_tags(derive(spark, sf_dir, _TAGS), derive(spark, sf_dir, _TAG_REQUESTS))


# Request by request: the last forced value, else what was there, else the first value.
_ASKED_PROPERTIES = """, a AS (
  SELECT entity_id, key, count(*) AS requests, count(*) FILTER (WHERE force) AS forced,
         min_by(value, seq) AS first_value, min_by(force, seq) AS first_force,
         max_by(value, seq) FILTER (WHERE force) AS last_forced
  FROM r GROUP BY entity_id, key),
b AS (SELECT a.*, p.value AS old, p.entity_id IS NOT NULL AS has FROM a LEFT JOIN p USING (entity_id, key)),
o AS (SELECT entity_id, key,
         CASE WHEN forced > 0 THEN last_forced WHEN has THEN old ELSE first_value END AS value, requests,
         CASE WHEN NOT has THEN 'added' WHEN forced > 0 THEN 'overwritten' ELSE 'exists' END AS outcome,
         requests - forced - CASE WHEN NOT has AND NOT first_force THEN 1 ELSE 0 END AS rejected FROM b) """


@QUERIES.add(
    "property_additions", _ctes(p=_PROPERTIES, r=_PROPERTY_REQUESTS) + _ASKED_PROPERTIES + "SELECT * FROM o"
)
def property_additions(spark, sf_dir):
    return catalog.property_additions(derive(spark, sf_dir, _PROPERTIES), derive(spark, sf_dir, _PROPERTY_REQUESTS))


@QUERIES.add(
    "add_properties",
    _ctes(p=_PROPERTIES, r=_PROPERTY_REQUESTS)
    + _ASKED_PROPERTIES
    + """SELECT entity_id, key, value FROM o UNION ALL
         SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.entity_id = p.entity_id AND o.key = p.key)""",
)
def add_properties(spark, sf_dir):
    return catalog.add_properties(derive(spark, sf_dir, _PROPERTIES), derive(spark, sf_dir, _PROPERTY_REQUESTS))


@QUERIES.add(
    "property_removals",
    _ctes(p=_PROPERTIES, r=_PROPERTY_REQUESTS)
    + """, a AS (SELECT entity_id, key, value, count(*) AS requests FROM r GROUP BY ALL),
    b AS (SELECT a.*, EXISTS (SELECT 1 FROM p WHERE p.entity_id = a.entity_id AND p.key = a.key
                              AND p.value = a.value) AS has FROM a)
    SELECT entity_id, key, value, requests, CASE WHEN has THEN 'removed' ELSE 'missing' END AS outcome,
           requests - CASE WHEN has THEN 1 ELSE 0 END AS rejected FROM b""",
)
def property_removals(spark, sf_dir):
    return catalog.property_removals(derive(spark, sf_dir, _PROPERTIES), derive(spark, sf_dir, _PROPERTY_REQUESTS))


@QUERIES.add(
    "remove_properties",
    _ctes(p=_PROPERTIES, r=_PROPERTY_REQUESTS)
    + """SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.entity_id = p.entity_id AND r.key = p.key
                                          AND r.value = p.value)""",
)
def remove_properties(spark, sf_dir):
    return catalog.remove_properties(derive(spark, sf_dir, _PROPERTIES), derive(spark, sf_dir, _PROPERTY_REQUESTS))


@QUERIES.add(
    "parse_tag_ops",
    _ctes(r=_EXPRESSIONS)
    + """SELECT r.*, CASE WHEN remove THEN 'remove_' ELSE 'add_' END
                  || CASE WHEN contains(expression, '=') THEN 'property' ELSE 'tag' END AS operation,
           CASE WHEN NOT contains(expression, '=') THEN expression END AS tag,
           CASE WHEN contains(expression, '=') THEN substr(expression, 1, strpos(expression, '=') - 1) END AS key,
           CASE WHEN contains(expression, '=') THEN substr(expression, strpos(expression, '=') + 1) END AS value
    FROM r""",
)
def parse_tag_ops(spark, sf_dir):
    return catalog.parse_tag_requests(derive(spark, sf_dir, _EXPRESSIONS))


@QUERIES.add(
    "delete_guard",
    _ctes(m=_TARGETS, d=_DATASETS)
    + """SELECT data_model_id, m.code || ':' || version AS name, d.code AS dataset
         FROM m JOIN d USING (data_model_id)""",
)
def delete_guard(spark, sf_dir):
    return catalog.blocking_datasets(derive(spark, sf_dir, _TARGETS), derive(spark, sf_dir, _DATASETS))


@QUERIES.add(
    "deletable_models",
    _ctes(m=_TARGETS, d=_DATASETS) + "SELECT * FROM m WHERE data_model_id NOT IN (SELECT data_model_id FROM d)",
)
def deletable_models(spark, sf_dir):
    return catalog.deletable_models(derive(spark, sf_dir, _TARGETS), derive(spark, sf_dir, _DATASETS))


@QUERIES.add(
    "delete_model_cascade",
    _ctes(g=_TARGETS, m=_MODELS, d=_DATASETS, t=_TAGS)
    + """SELECT 'data_model' AS kind, data_model_id AS id, code AS name FROM m
           WHERE data_model_id NOT IN (SELECT data_model_id FROM g)
         UNION ALL SELECT 'dataset', dataset_id, code FROM d
           WHERE data_model_id NOT IN (SELECT data_model_id FROM g)
         UNION ALL SELECT 'tag', entity_id, tag FROM t WHERE entity_id NOT IN
           (SELECT dataset_id FROM d WHERE data_model_id IN (SELECT data_model_id FROM g))""",
)
def delete_model_cascade(spark, sf_dir):
    targets, datasets = derive(spark, sf_dir, _TARGETS), derive(spark, sf_dir, _DATASETS)
    orphans = datasets.join(targets, "data_model_id", "left_semi")
    kept = [
        ("data_model", "data_model_id", "code", catalog.drop_models(derive(spark, sf_dir, _MODELS), targets)),
        ("dataset", "dataset_id", "code", catalog.drop_models(datasets, targets)),
        (
            "tag",
            "entity_id",
            "tag",
            catalog.drop_models(
                derive(spark, sf_dir, _TAGS), orphans.select(F.col("dataset_id").alias("data_model_id")), "entity_id"
            ),
        ),
    ]
    frames = [
        frame.select(F.lit(kind).alias("kind"), F.col(identity).alias("id"), F.col(name).alias("name"))
        for kind, identity, name, frame in kept
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


_CANDIDATES = """
SELECT concat('m', CAST(c_custkey % 1000 AS string)) AS code,
       CASE WHEN c_custkey % 2 = 0 THEN '1.0' ELSE '2.0' END AS version
FROM {customer}
"""


@QUERIES.add(
    "registration_guard",
    _ctes(c=_CANDIDATES, m=_MODELS)
    + """, a AS (SELECT code, version, count(*) AS copies FROM c GROUP BY ALL),
    b AS (SELECT a.*, (code, version) IN (SELECT (code, version) FROM m) AS known FROM a)
    SELECT code, version, copies, CASE WHEN known THEN 'registered' ELSE 'repeated' END AS conflict
    FROM b WHERE known OR copies > 1""",
)
def registration_guard(spark, sf_dir):
    return catalog.registration_conflicts(derive(spark, sf_dir, _CANDIDATES), derive(spark, sf_dir, _MODELS))


# Imported datasets: what the line items' suppliers and ship modes of return stand for.
_IMPORTED = """
SELECT l_suppkey % 83 AS data_model_id, concat('ds', CAST(l_partkey AS string)) AS code FROM {lineitem}
"""
_LABELS = "SELECT DISTINCT concat('ds', CAST(p_partkey AS string)) AS code, p_name AS label FROM {part}"
_NEW_SQL = """, n AS (SELECT DISTINCT data_model_id, code FROM i
    WHERE (data_model_id, code) NOT IN (SELECT (data_model_id, code) FROM d)),
a AS (SELECT n.*, (SELECT max(dataset_id) FROM d)
        + row_number() OVER (ORDER BY data_model_id, code COLLATE "C") AS dataset_id FROM n) """.replace(
    ' COLLATE "C"', ""
)


def _new(spark, sf_dir):
    return tables.new_datasets(
        derive(spark, sf_dir, _IMPORTED), derive(spark, sf_dir, _DATASETS), ["data_model_id", "code"]
    )


def _allocated(spark, sf_dir):
    last = derive(spark, sf_dir, _DATASETS).agg(F.max("dataset_id")).scalar()
    return assign_ordered_ids(_new(spark, sf_dir), ["data_model_id", "code"], "dataset_id", last)


@QUERIES.add("new_datasets", _ctes(i=_IMPORTED, d=_DATASETS) + _NEW_SQL + "SELECT * FROM n")
def new_datasets(spark, sf_dir):
    return _new(spark, sf_dir)


@QUERIES.add("allocate_ids", _ctes(i=_IMPORTED, d=_DATASETS) + _NEW_SQL + "SELECT * FROM a")
def allocate_ids(spark, sf_dir):
    """Ids after the largest one, in the order of model and code, without a global window."""
    return _allocated(spark, sf_dir)


@QUERIES.add(
    "register_datasets",
    _ctes(i=_IMPORTED, d=_DATASETS, l=_LABELS)
    + _NEW_SQL
    + """SELECT dataset_id, data_model_id, code, label, 'ENABLED' AS status FROM a LEFT JOIN l USING (code)""",
)
def register_datasets(spark, sf_dir):
    labelled = catalog.dataset_rows(_allocated(spark, sf_dir), derive(spark, sf_dir, _LABELS), ["code"], ENABLED)
    return labelled.select("dataset_id", "data_model_id", "code", "label", "status")


@QUERIES.add(
    "load_cdes",
    _ctes(m=_TARGETS, d=_CANDIDATES)
    + """SELECT code AS model_code, version AS model_version FROM d
         WHERE (code, version) IN (SELECT (code, version) FROM m)""",
)
def load_cdes(spark, sf_dir):
    """Variable rows of the wanted models; the variables here are the candidates."""
    rows = derive(spark, sf_dir, _CANDIDATES).toDF("model_code", "model_version")
    return catalog.cdes_of_models(rows, derive(spark, sf_dir, _TARGETS))


_WANTED = """
SELECT c_custkey AS entity_id, array('reviewed', lower(c_mktsegment), 'reviewed') AS tags,
       map('nation', CAST(c_nationkey + 1 AS string), 'name', c_name) AS properties
FROM {customer} WHERE c_custkey % 3 = 0
"""


@QUERIES.add(
    "entity_properties",
    _ctes(d=_DATASETS, t=_TAGS, p=_PROPERTIES)
    + """SELECT dataset_id,
           coalesce((SELECT string_agg(tag, ',' ORDER BY seq) FROM t WHERE entity_id = dataset_id), '') AS tags,
           coalesce((SELECT string_agg(key || '=' || value, ',' ORDER BY key) FROM p WHERE entity_id = dataset_id), '')
             AS properties
         FROM d""",
)
def entity_properties(spark, sf_dir):
    """Tags in order and properties of each dataset; here joined to one text each."""
    read = catalog.annotations(
        derive(spark, sf_dir, _DATASETS), derive(spark, sf_dir, _TAGS), derive(spark, sf_dir, _PROPERTIES), "dataset_id"
    )
    pairs = F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read.select("dataset_id", F.array_join("tags", ",").alias("tags"), F.array_join(pairs, ",").alias("properties"))


@QUERIES.add(
    "overwrite_properties",
    _ctes(t=_TAGS, p=_PROPERTIES)
    + """SELECT entity_id, 'tag' AS kind, tag AS name, CAST(seq AS VARCHAR) AS value FROM t WHERE entity_id % 3 <> 0
         UNION ALL SELECT c_custkey, 'tag', 'reviewed', '0' FROM customer WHERE c_custkey % 3 = 0
         UNION ALL SELECT c_custkey, 'tag', lower(c_mktsegment), '1' FROM customer WHERE c_custkey % 3 = 0
         UNION ALL SELECT entity_id, 'property', key, value FROM p WHERE entity_id % 3 <> 0
         UNION ALL SELECT c_custkey, 'property', 'nation', CAST(c_nationkey + 1 AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0
         UNION ALL SELECT c_custkey, 'property', 'name', c_name FROM customer WHERE c_custkey % 3 = 0""",
)
def overwrite_properties(spark, sf_dir):
    """All tags and properties of a third of the datasets replaced."""
    wanted = derive(spark, sf_dir, _WANTED)
    tags = catalog.overwrite_tags(derive(spark, sf_dir, _TAGS), wanted)
    properties = catalog.overwrite_properties(derive(spark, sf_dir, _PROPERTIES), wanted)
    row = lambda kind, name, value: ("entity_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).cast("string").alias("value"))
    return tags.select(*row("tag", "tag", "seq")).unionByName(properties.select(*row("property", "key", "value")))


@QUERIES.add(
    "catalog_changes",
    _ctes(m=_MODELS, d=_DATASETS)
    + """SELECT data_model_id, code, version, label, status,
                (SELECT count(*) FROM d WHERE d.data_model_id = m.data_model_id AND d.status = 'ENABLED') AS count,
                code || ':' || version AS name
         FROM m""",
)
def catalog_changes(spark, sf_dir):
    """Create the catalog tables, commit models and datasets, then drop datasets again."""
    house = Warehouse(spark, scratch(spark, "warehouse"))
    house.initialise()
    full = {"data_models": derive(spark, sf_dir, _MODELS), "datasets": derive(spark, sf_dir, _DATASETS)}
    house.commit({name: _padded(spark, frame, name) for name, frame in full.items()})
    house.commit({"datasets": house.table("datasets").where("status = 'ENABLED'")})
    return house.list_data_models()


# Tags and properties added and removed in turns; one dataset has a third of all requests, a few have no row.
_MIXED = f"""
SELECT {_ENTITY} AS entity_id, o_orderkey AS seq, o_orderstatus = 'F' AS remove, o_orderpriority LIKE '1%' AS force,
       CASE turn % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'reviewed'
                     WHEN 2 THEN concat('nation=', CAST(turn % 3 AS string)) ELSE 'segment=BUILDING=x' END AS expression
FROM (SELECT *, CAST(floor(o_orderkey / 3) AS bigint) AS turn FROM {{orders}}) AS o
"""


@QUERIES.add(
    "mixed_tag_batches",
    _ctes(t=_TAGS, p=_PROPERTIES, q=_MIXED)
    + """, c AS (SELECT entity_id, 'tag' AS kind, tag AS name, CAST(seq AS VARCHAR) AS value FROM t
               UNION ALL SELECT entity_id, 'property', key, value FROM p),
    r AS (SELECT *, expression NOT LIKE '%=%' AS bare, split_part(expression, '=', 1) AS name FROM q),
    g AS (SELECT entity_id, CASE WHEN bare THEN 'tag' ELSE 'property' END AS kind, name, count(*) AS requests,
                 list({'held': true, 'value': CASE WHEN bare THEN CAST(seq + 1 AS VARCHAR)
                                                   ELSE substr(expression, length(name) + 2) END,
                       'bare': bare, 'remove': remove, 'force': force, 'n': CAST(0 AS BIGINT)}
                      ORDER BY seq) AS asked
          FROM r GROUP BY ALL),
    f AS (SELECT entity_id, kind, name, coalesce(requests, 0) AS requests,
                 list_reduce(list_prepend({'held': value IS NOT NULL, 'value': value, 'bare': false, 'remove': false,
                                           'force': false, 'n': CAST(0 AS BIGINT)}, coalesce(asked, [])),
                   lambda s, x: CASE
                     WHEN x.remove AND s.held AND (x.bare OR s.value = x.value)
                       THEN {'held': false, 'value': NULL, 'bare': false, 'remove': false, 'force': false, 'n': s.n + 1}
                     WHEN NOT x.remove AND (NOT s.held OR (x.force AND NOT x.bare))
                       THEN {'held': true, 'value': x.value, 'bare': false, 'remove': false, 'force': false, 'n': s.n + 1}
                     ELSE s END) AS s
          FROM c FULL JOIN g USING (entity_id, kind, name))
    SELECT entity_id, kind, name, s.value AS value, requests, requests - s.n AS rejected FROM f""",
)
def mixed_tag_batches(spark, sf_dir):
    """A batch of additions and removals in their order, through the warehouse: what is there at the end, for
    tags their place, and how many requests failed."""
    house = Warehouse(spark, scratch(spark, "warehouse"))
    house.initialise()
    house.commit({"dataset_tags": derive(spark, sf_dir, _TAGS), "dataset_properties": derive(spark, sf_dir, _PROPERTIES)})
    report = house.change_tags("dataset", derive(spark, sf_dir, _MIXED))
    kind = F.when(F.col("operation").endswith("_tag"), "tag").otherwise("property").alias("kind")
    counted = report.groupBy("entity_id", kind, "name").agg(F.sum("requests").alias("requests"), F.sum("rejected").alias("rejected"))
    row = lambda kind, name, value: ("entity_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).cast("string").alias("value"))
    left = house.table("dataset_tags").select(*row("tag", "tag", "seq")).unionByName(
        house.table("dataset_properties").select(*row("property", "key", "value"))
    )
    return left.join(counted, ["entity_id", "kind", "name"], "full").select(
        "entity_id", "kind", "name", "value", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("rejected", F.lit(0)).alias("rejected")
    )


def _padded(spark, frame, name):
    return tables.pad_columns(frame, spark.createDataFrame([], SCHEMAS[name]).schema)

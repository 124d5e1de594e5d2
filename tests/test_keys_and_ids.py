from pyspark.sql import functions as F

from tabwarden.operators.keys import rows_with_repeated_key
from tabwarden.operators.rowids import assign_ordered_ids, assign_row_ids
from tabwarden.operators.skew import spread_join
from tabwarden.sources.primary import append_load


def test_all_copies_are_reported(spark):
    rows = spark.createDataFrame(
        [(1, 10), (2, 20), (3, 20), (3, 30), (3, 30), (4, 40)], "visitid int, subjectid int"
    ).withColumn("file", F.lit("f"))
    out = rows_with_repeated_key(rows)
    assert [(r["visitid"], r["subjectid"]) for r in out.collect()] == [(3, 30), (3, 30)]


def test_nulls_are_equal_and_files_are_apart(spark):
    rows = spark.createDataFrame(
        [("f", None, "a"), ("f", None, "a"), ("f", "v", "b"), ("g", "v", "b")], "file string, visitid string, subjectid string"
    )
    assert [r["subjectid"] for r in rows_with_repeated_key(rows).collect()] == ["a", "a"]
    assert rows_with_repeated_key(rows.drop("file"), scope=()).count() == 4


def test_hot_key_in_slots_gives_the_same_rows(spark):
    rows = spark.range(3000).selectExpr(
        "id", "'f' AS file", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 1200 AS string) END AS subjectid", "NULL AS visitid"
    )
    plain, sliced = rows_with_repeated_key(rows), rows_with_repeated_key(rows, hot_rows=10)
    assert plain.count() == sliced.count()
    assert plain.exceptAll(sliced).isEmpty() and sliced.exceptAll(plain).isEmpty()


def test_spread_left_join_keeps_every_row_once(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 700 THEN 1 ELSE id END AS k")
    per_key = rows.where("k < 900").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = spread_join(rows, per_key, ["k"], "n", "left", hot_rows=50)
    assert out.count() == 1000
    assert out.where("top IS NULL").count() == 100
    assert out.where("k = 1 AND top = 699").count() == 700


def test_row_ids_are_gap_free(spark):
    rows = spark.range(1000).repartition(7)
    ids = assign_row_ids(rows, base=5).agg(F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")).first()
    assert tuple(ids) == (6, 1005, 1000)
    ordered = assign_ordered_ids(rows, [F.col("id").desc()])
    assert ordered.where("row_id <> 1000 - id").isEmpty()
    assert assign_row_ids(rows.where("id < 0")).count() == 0


def test_a_load_has_files_by_dataset_and_not_by_task(spark, tmp_path):
    rows = spark.range(0, 2000, 1, 40).selectExpr("id", "concat('d', id % 10) AS dataset")
    path = append_load(rows, str(tmp_path), 1)
    files = [f for f in tmp_path.rglob("*.parquet")]
    assert 10 <= len(files) <= 20
    assert spark.read.parquet(path).groupBy("dataset").count().where("count = 200").count() == 10

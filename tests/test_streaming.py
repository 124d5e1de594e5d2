from samples import csv

from tabwarden.model import Cde
from tabwarden.operators.row_checks import row_violations
from tabwarden.sources.csv_text import scan_text
from tabwarden.streaming.arrivals import arriving_rows, arriving_violations, running_datasets, validate_then_commit

COLUMNS = ["dataset", "value"]
CDES = [
    Cde("dataset", "text", True, codes=("a", "b")),
    Cde("value", "real", maximum=10.0),
    Cde("later", "int"),
]
FILES = {
    "1.csv": csv("dataset,value", "a,1", "b,2"),
    "2.csv": csv("dataset,value", "a,3", "c,4"),
    "3.csv": csv("dataset,value", "b,50", "b,x"),
    "4.csv": csv("dataset,value", "b,5"),
}
RAGGED = {
    "5.csv": csv("dataset,value", "a,1", "a"),
    "6.csv": csv("dataset,value", "a,2,3"),
    "7.csv": csv("value,dataset", "1,a"),
}


def run(writer, checkpoint):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_equals_batch(spark, trees, tmp_path):
    root = trees(FILES)
    stream = arriving_violations(arriving_rows(spark, root, COLUMNS, 1), CDES)
    run(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ckpt"))
    batch = row_violations(scan_text(spark, root, COLUMNS), CDES, ["file"])
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)
    assert batch.count() == 3
    assert batch.exceptAll(streamed).isEmpty() and streamed.exceptAll(batch).isEmpty()


def test_running_datasets(spark, trees, tmp_path):
    stream = running_datasets(arriving_rows(spark, trees(FILES), COLUMNS, 1))
    run(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "ckpt"))
    assert sorted(r["dataset"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_whole_files_or_nothing_and_replay(spark, trees, tmp_path):
    root, good, bad = trees(FILES | RAGGED), str(tmp_path / "good"), str(tmp_path / "bad")
    for checkpoint in ("one", "two"):  # the second run replays every batch from the start
        writer = validate_then_commit(arriving_rows(spark, root, COLUMNS, 1, any_header=True), CDES, good, bad)
        run(writer, str(tmp_path / checkpoint))
    rows = spark.read.parquet(good)
    assert sorted((r["dataset"], r["value"], r["later"]) for r in rows.collect()) == [
        ("a", 1.0, None), ("b", 2.0, None), ("b", 5.0, None)
    ]
    failed = {(r["file"].rsplit("/", 1)[1], r["rule"]) for r in spark.read.parquet(bad).collect()}
    assert {f for f, _ in failed} == {"2.csv", "3.csv", "5.csv", "6.csv", "7.csv"}
    assert {("5.csv", "malformed_row"), ("6.csv", "malformed_row"), ("7.csv", "foreign_header")} <= failed

import random
from collections import Counter
from pathlib import Path

import pytest
from samples import csv, model, study, text, variable, visits

from tabwarden.model import DICTIONARY_FILE, DISABLED, ENABLED, ErrorClass, Profile
from tabwarden.operators import catalog
from tabwarden.plans.warehouse import SCHEMAS, RequestError, Warehouse
from tabwarden.sources import csv_text


@pytest.fixture(scope="module")
def root(trees):
    return trees(
        {
            f"a/{DICTIONARY_FILE}": text(study(["d1", "d2", "d3"])),
            "a/one.csv": csv("subjectcode,var1,var3,dataset", "1,x,6,d1", "2,,7,d1"),
            "a/two.csv": csv("var4,dataset,subjectcode", "5,d2,1", "6,d1,2", ",d2,3"),
            f"b/{DICTIONARY_FILE}": text(visits()),
            "b/long.csv": csv("subjectid,visitid,dataset", "s1,BL,long", "s1,FL1,long"),
        }
    )


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory, root):
    made = Warehouse(spark, str(tmp_path_factory.mktemp("house")))
    with pytest.raises(RequestError):
        made.list_data_models()
    made.initialise()
    made.load_folder(root)
    return made


def refused(error_class, call, *args, **more):
    with pytest.raises(RequestError) as error:
        call(*args, **more)
    assert error.value.error_class == error_class


def test_life_of_a_catalog(spark, house, root, trees):
    models = {r["code"]: r["count"] for r in house.list_data_models().collect()}
    assert models == {"study": 2, "visits": 1}
    assert house.is_longitudinal("visits", "2.0") and not house.is_longitudinal("study", "1.0")
    rows = house.primary("study", "1.0").orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [1, 2, 3, 4, 5]
    assert rows[0].asDict().keys() == {"row_id", "var1", "subjectcode", "var2", "dataset", "var3", "var4"}
    assert {(r["dataset"], r["var3"], r["var4"]) for r in rows} == {
        ("d1", None, 6), ("d1", 6.0, None), ("d1", 7.0, None), ("d2", None, 5), ("d2", None, None)
    }
    labels = {r["code"]: r["label"] for r in house.list_datasets().collect()}
    assert labels == {"d1": "label of d1", "d2": "label of d2", "long": "label of long"}

    # A bad file changes nothing, a second load of a folder gives the same content.
    bad = trees({f"a/{DICTIONARY_FILE}": text(study(["d1"])), "a/x.csv": csv("dataset,var4", "d1,x")})
    refused(ErrorClass.DATASET, house.load_folder, bad)
    refused(ErrorClass.DATABASE, house.add_data_models, root)
    assert house.primary("study", "1.0").count() == 5

    # Loading again appends rows and registers nothing new; replacing takes their place.
    more = trees({"n.csv": csv("dataset,var4", "d1,9", "d3,8")})
    house.add_datasets(more, "study", "1.0")
    assert house.primary("study", "1.0").count() == 7
    assert {r["code"]: r["dataset_id"] for r in house.list_datasets().collect()}["d3"] == 4
    house.add_datasets(more, "study", "1.0", replace=True)
    counts = {r["dataset"]: r["n"] for r in house.primary("study", "1.0").groupBy("dataset").count().withColumnRenamed("count", "n").collect()}
    assert counts == {"d1": 1, "d2": 2, "d3": 1}

    # Status, tags and properties.
    house.set_status(DISABLED, "study", "1.0", "d1")
    refused(ErrorClass.USER_INPUT, house.set_status, DISABLED, "study", "1.0", "d1")
    refused(ErrorClass.USER_INPUT, house.set_status, ENABLED, "study", "1.0")
    house.tag("t", "study", "1.0", "d1")
    refused(ErrorClass.USER_INPUT, house.tag, "t", "study", "1.0", "d1")
    house.tag("k=v=w", "study", "1.0", "d1")
    refused(ErrorClass.USER_INPUT, house.tag, "k=z", "study", "1.0", "d1")
    house.tag("k=z", "study", "1.0", "d1", force=True)
    assert [tuple(r) for r in house.table("dataset_properties").collect()] == [(1, "k", "z")]
    refused(ErrorClass.USER_INPUT, house.tag, "k=v", "study", "1.0", "d1", remove=True)
    house.tag("k=z", "study", "1.0", "d1", remove=True)
    house.tag("t", "study", "1.0", "d1", remove=True)
    refused(ErrorClass.USER_INPUT, house.tag, "t", "study", "1.0", "d1", remove=True)

    # Deletion.
    refused(ErrorClass.DATABASE, house.delete_dataset, "nothing", "study", "1.0")
    house.delete_dataset("d2", "study", "1.0")
    assert {r["dataset"] for r in house.primary("study", "1.0").collect()} == {"d1", "d3"}
    refused(ErrorClass.FOREIGN_KEY, house.delete_data_model, "study", "1.0")
    house.delete_data_model("study", "1.0", force=True)
    assert [r["code"] for r in house.list_data_models().collect()] == ["visits"]
    house.cleanup()
    assert house.list_data_models().isEmpty() and house.list_datasets().isEmpty()


def test_a_variable_may_be_named_like_the_path(spark, tmp_path, trees):
    dictionary = model("scans", "1.0", [variable("dataset", codes=["d"]), variable("file"), variable("value", "int")])
    house = Warehouse(spark, str(tmp_path))
    house.initialise()
    house.load_folder(trees({f"s/{DICTIONARY_FILE}": text(dictionary), "s/x.csv": csv("dataset,file,value", "d,scan1,3")}))
    assert [(r["file"], r["value"]) for r in house.primary("scans", "1.0").collect()] == [("scan1", 3)]


def test_deleted_rows_leave_the_disk(spark, tmp_path, trees):
    dictionary = model("scans", "1.0", [variable("dataset", codes=["a b", "c"]), variable("value", "int")])
    house = Warehouse(spark, str(tmp_path))
    house.initialise()
    house.load_folder(trees({f"s/{DICTIONARY_FILE}": text(dictionary), "s/x.csv": csv("dataset,value", "a b,3", "c,4")}))
    house.delete_dataset("c", "scans", "1.0")
    assert [(r["dataset"], r["value"]) for r in house.primary("scans", "1.0").collect()] == [("a b", 3)]
    assert len(list(tmp_path.glob("primary/*/*/dataset=*"))) == 1
    house.cleanup()
    assert not list(tmp_path.glob("primary/*"))
    assert all(len(list(Path(tmp_path, name).iterdir())) == 1 for name in SCHEMAS)


def test_requests_for_one_name_take_effect_in_order(spark, tmp_path, trees):
    dictionary = model("scans", "1.0", [variable("dataset", codes=["a", "b"]), variable("value", "int")])
    house = Warehouse(spark, str(tmp_path))
    house.initialise()
    house.add_data_models(trees({f"s/{DICTIONARY_FILE}": text(dictionary)}))
    # Without checks of the cells datasets are registered, and no row is stored.
    house.add_datasets(trees({"x.csv": csv("dataset,value", "a,bad", "b,4")}), "scans", "1.0", Profile.DATASET_ONLY)
    assert {r["code"] for r in house.list_datasets().collect()} == {"a", "b"}
    assert house.primary("scans", "1.0").isEmpty() and house.table("loads").isEmpty()

    requests = [
        (1, "t", False, False, 1), (1, "t", True, False, 2),
        (1, "u", True, False, 3), (1, "u", False, False, 4),
        (1, "k=v", False, False, 5), (1, "k=v", True, False, 6), (1, "k=z", False, False, 7),
        (2, "w", False, False, 8), (2, "w", False, False, 9),
    ]
    frame = spark.createDataFrame(requests, "entity_id bigint, expression string, remove boolean, force boolean, seq bigint")
    report = {(r["operation"], r["entity_id"], r["name"], r["outcome"], r["rejected"]) for r in house.change_tags("dataset", frame).collect()}
    assert report == {
        ("add_tag", 1, "t", "added", 0), ("remove_tag", 1, "t", "removed", 0),
        ("remove_tag", 1, "u", "missing", 1), ("add_tag", 1, "u", "added", 0),
        ("add_property", 1, "k", "added", 0), ("remove_property", 1, "k", "removed", 0),
        ("add_tag", 2, "w", "added", 1),
    }
    read = lambda: {r["dataset_id"]: (r["tags"], r["properties"]) for r in house.annotations("dataset").collect()}
    assert read() == {1: (["u"], {"k": "z"}), 2: (["w"], {})}
    wanted = spark.createDataFrame([(2, ["y", "x", "y"], {"n": "1"})], "entity_id bigint, tags array<string>, properties map<string,string>")
    house.overwrite_annotations("dataset", wanted)
    assert read() == {1: (["u"], {"k": "z"}), 2: (["y", "x"], {"n": "1"})}


def test_a_batch_of_many_turns_is_the_same_as_one_request_after_the_other(spark):
    rng = random.Random(3)
    tags = [(e, t, i) for i, (e, t) in enumerate((e, t) for e in range(4) for t in "ab" if rng.random() < 0.5)]
    properties = [(e, "k", str(rng.randrange(3))) for e in range(4) if e % 2]
    asked = [(1, "a", i % 2 == 0, False, i) for i in range(1000)]
    asked += [
        (rng.choice([0, 1, 2, 9, None]), rng.choice(["a", "b", "c", "k=0", "k=1", "k=2", "k="]), rng.random() < 0.5, rng.random() < 0.3, 1000 + i)
        for i in range(500)
    ]
    known = {(e, True, t): (None, s) for e, t, s in tags} | {(e, False, k): (v, None) for e, k, v in properties}
    last, effects = max(s for *_, s in tags), Counter()
    for entity, expression, remove, force, seq in asked:
        name, is_property, value = expression.partition("=")
        key = (entity, not is_property, name)
        if remove:
            done = key in known and (not is_property or known[key][0] == value)
            known = {k: v for k, v in known.items() if k != key} if done else known
        else:
            done = key not in known or (bool(is_property) and force)
            if done:
                known[key] = (value, None) if is_property else (None, seq + last)
        effects[key, remove] += done

    tag_frame = spark.createDataFrame(tags, "entity_id bigint, tag string, seq bigint")
    property_frame = spark.createDataFrame(properties, "entity_id bigint, key string, value string")
    schema = "entity_id bigint, expression string, remove boolean, force boolean, seq bigint"
    frame = spark.createDataFrame(asked, schema)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        changed = catalog.ordered_changes(tag_frame, property_frame, catalog.parse_tag_requests(frame))
        left = {(r.entity_id, r.tag, r.name): (r.value, None if not r.tag else r.place) for r in changed.where("operation IS NULL").collect()}
        report = catalog.change_outcomes(changed).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert left == known
    got = Counter()
    for r in report:
        got[(r.entity_id, r.operation.endswith("tag"), r.name), r.operation.startswith("remove")] += r.requests - r.rejected
    assert got == effects and sum(r.requests for r in report) == len(asked)
    assert sum(r.outcome in ("added", "removed") and r.entity_id == 1 and r.name == "a" for r in report) >= 999

    empty = frame.where("false")
    same = catalog.ordered_changes(tag_frame, property_frame, catalog.parse_tag_requests(empty))
    assert same.where("operation IS NOT NULL").isEmpty() and same.count() == len(tags) + len(properties)


def test_a_stream_loads_each_file_once(spark, tmp_path, trees, monkeypatch):
    dictionary = model("scans", "1.0", [variable("dataset", codes=["a", "b"]), variable("value", "int")])
    house = Warehouse(spark, str(tmp_path / "house"))
    house.initialise()
    house.add_data_models(trees({f"s/{DICTIONARY_FILE}": text(dictionary)}))
    arrivals = trees(
        {
            "1.csv": csv("dataset,value", "a,1", "b,2"),
            "2.csv": csv("value,dataset", "3,a", "x,a"),
            "3.csv": csv("value,dataset", "4,b"),
            "4.csv": csv("dataset,other", "a,1"),
            "5.csv": csv("dataset,value"),
        }
    )
    checkpoint, quarantine = str(tmp_path / "checkpoint"), str(tmp_path / "quarantine")

    def arrive(files_per_batch=1):
        writer = house.load_stream(arrivals, "scans", "1.0", quarantine, files_per_batch=files_per_batch)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def loaded():
        return sorted((r["row_id"], r["dataset"], r["value"]) for r in house.primary("scans", "1.0").collect())

    # The rows are written, then the commit fails: the batch comes again and finds what was left behind.
    commit = Warehouse.commit

    def failing(self, frames, taken=None):
        raise OSError("lost")

    monkeypatch.setattr(Warehouse, "commit", failing)
    with pytest.raises(Exception, match="lost"):
        arrive()
    monkeypatch.setattr(Warehouse, "commit", commit)
    assert loaded() == []
    arrive()
    rows = loaded()
    assert [r[0] for r in rows] == [1, 2, 3] and {r[1:] for r in rows} == {("a", 1), ("b", 2), ("b", 4)}
    refused = spark.read.parquet(quarantine).collect()
    assert {(r["file"].rsplit("/", 1)[1], r["rule"]) for r in refused} == {("2.csv", "type"), ("4.csv", "unknown_column")}

    # Spark runs batches again whose end it has not noted.
    taken = []
    monkeypatch.setattr(Warehouse, "_take_batch", lambda self, batch, query, *more: taken.append(query))
    for note in Path(checkpoint, "commits").iterdir():
        if note.name.strip(".crc").strip(".") == "4":
            note.unlink()
    arrive()
    assert taken == [] and loaded() == rows
    # Another checkpoint is another stream, with batches of its own.
    checkpoint = str(tmp_path / "other")
    arrive(files_per_batch=10)
    assert len(taken) == 1


def test_emptied_models_stay_listed(spark, tmp_path, trees):
    dictionary = model("scans", "1.0", [variable("dataset", codes=["a", "b"]), variable("value", "int")])
    house = Warehouse(spark, str(tmp_path))
    house.initialise()
    house.load_folder(trees({f"s/{DICTIONARY_FILE}": text(dictionary), "s/x.csv": csv("dataset,value", "a,3", "b,4")}))
    house.empty_model("scans", "1.0")
    assert house.primary("scans", "1.0").isEmpty() and house.list_datasets().count() == 2
    assert not list(tmp_path.glob("primary/*/*/*"))
    house.add_datasets(trees({"y.csv": csv("dataset,value", "b,5")}), "scans", "1.0")
    assert [(r["row_id"], r["value"]) for r in house.primary("scans", "1.0").collect()] == [(1, 5)]


def test_registering_lists_no_data_files(spark, tmp_path, trees, monkeypatch):
    house = Warehouse(spark, str(tmp_path))
    house.initialise()
    monkeypatch.setattr(csv_text, "list_files", lambda *_: pytest.fail("listed"))
    dictionary = model("scans", "1.0", [variable("dataset", codes=["a"]), variable("value", "int")])
    house.add_data_models(trees({f"{d}/{DICTIONARY_FILE}": text({**dictionary, "code": d}) for d in ("s", ".h/_s")}))
    assert sorted(r["code"] for r in house.table("data_models").collect()) == [".h/_s", "s"]
    assert house.table("cdes").count() == 4

from urllib.parse import unquote

import pytest
from samples import csv, model, study, text, variable, visits

import __spark_entry__ as contract
from tabwarden.model import DICTIONARY_FILE, Profile
from tabwarden.plans.validate import check_folder
from tabwarden.plans.warehouse import Warehouse
from tabwarden.session import scratch
from tabwarden.workloads import folders

STUDY = text(study(["ok", "more"]))
FILES = {
    "valid.csv": csv("subjectcode,var1,var3,dataset", "1,a,5,ok", "2,,60,more", "2,b,,ok"),
    "header_only.csv": csv("dataset,var1"),
    "quoted.csv": csv("subjectcode,var1,dataset", '1,"a ""b"", c",ok', '2,"two\nlines",more'),
    "above.csv": csv("subjectcode,var2,var3,var4,dataset", "1,l1,100,1,ok"),
    "below.csv": csv("subjectcode,var2,var3,var4,dataset", "1,l1,0,1,ok"),
    "enum.csv": csv("subjectcode,var2,var3,dataset", "1,l3,6,ok"),
    "type.csv": csv("subjectcode,var1,var3,dataset", "1,a,invalid,ok"),
    "no_dataset.csv": csv("subjectcode,var1,var3", "1,a,6"),
    "unknown.csv": csv("row_id,var1,var3,dataset,extra", "1,a,6,ok,x"),
    "twice.csv": csv("var1,var1,dataset", "1,2,ok"),
    "stranger.csv": csv("dataset,var1", "ok,1", ",2"),
    "ragged.csv": csv("dataset,var1", "ok,1,2"),
    "short.csv": csv("dataset,var1", "ok,1", "ok"),
    "short_null.csv": csv("dataset,var1", "ok,1", "NA"),
}
EXPECTED = {
    "valid.csv": None,
    "header_only.csv": None,
    "quoted.csv": None,
    "above.csv": "above_max",
    "below.csv": "below_min",
    "enum.csv": "not_in_enumeration",
    "type.csv": "type",
    "no_dataset.csv": "missing_dataset_column",
    "unknown.csv": "unknown_column",
    "twice.csv": "duplicate_header",
    "stranger.csv": "unknown_dataset",
    "ragged.csv": "malformed_row",
    "short.csv": "malformed_row",
    "short_null.csv": "malformed_row",
    "CDEsMetadata.json": None,
    "repeated.csv": "duplicate_key",
    "deeper.csv": "no_dictionary",
    "unjudged.csv": "invalid_dictionary",
}


@pytest.fixture(scope="module")
def root(trees):
    files = {f"study/{name}": body for name, body in FILES.items()}
    files[f"study/{DICTIONARY_FILE}"] = STUDY
    files["study/deep/deeper.csv"] = csv("a", "1")
    files[f"nested/visits/{DICTIONARY_FILE}"] = text(visits())
    files["nested/visits/repeated.csv"] = csv(
        "subjectid,visitid,dataset", '"s1","BL","long"', '"s2","FL1","long"', '"s2","FL1","long"'
    )
    files[f"broken/{DICTIONARY_FILE}"] = "{"
    files["broken/unjudged.csv"] = csv("a", "1")
    return trees(files)


@pytest.mark.parametrize("layouts", [0, 32])
def test_verdicts_of_a_tree(spark, root, layouts):
    checked = check_folder(spark, root, compiled_layouts=layouts)
    verdicts = {}
    for row in checked.verdicts().collect():
        name = row["path"].rsplit("/", 1)[1]
        if row["first_rule"] != "invalid_json":
            verdicts[name] = row["first_rule"]
    assert verdicts == EXPECTED
    unknown = {r["column"] for r in checked.violations.where("rule = 'unknown_column'").collect()}
    assert unknown == {"row_id", "extra"}


def test_plans_give_the_same_violations(spark, trees):
    bounds = text(study(["ok"], low=0.0001, high=1e7))
    root = trees({f"s/{DICTIONARY_FILE}": bounds, "s/a.csv": csv("dataset,var3", "ok,2e7", "ok,0", "ok", "x,1,2"), "s/b.csv": csv("var3,dataset,var1", "2e7,ok")})
    one, many = (check_folder(spark, root, compiled_layouts=n).violations for n in (32, 0))
    assert one.count() > 5
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_dataset_only_profile_looks_at_no_cells(spark, root):
    checked = check_folder(spark, root, profile=Profile.DATASET_ONLY)
    rules = {r["rule"] for r in checked.violations.select("rule").distinct().collect()}
    assert rules == {
        "missing_dataset_column", "unknown_column", "duplicate_header", "unknown_dataset", "duplicate_key"
    }


def test_awkward_names_are_read(spark, trees):
    folder = "my study %41 [x]"
    root = trees({f"{folder}/{DICTIONARY_FILE}": STUDY, f"{folder}/süß #1.csv": csv("dataset,var3", "ok,5", "ok,bad")})
    found = check_folder(spark, root).violations.collect()
    assert [(r["column"], r["value"]) for r in found] == [("var3", "bad")]


def test_hidden_names_are_read(spark, trees):
    deep = {"groups": []}
    for _ in range(600):
        deep = {"groups": [deep]}
    files = {
        f"ok/{DICTIONARY_FILE}": STUDY,
        "ok/x.csv": csv("dataset,var3", "ok,5"),
        "ok/_y.csv": csv("dataset,var3", "ok,bad", '"ok",7'),
        "ok/.z 1.csv": csv("dataset,var3", "ok,500"),
        "ok/_note.txt": "no data",
        f"_hidden/.deep er/{DICTIONARY_FILE}": text(study(["ok"], code="other")),
        "_hidden/.deep er/x.csv": csv("dataset,var3", "ok,6", '"more\n",9'),
        "_hidden/.deep er/_z.csv": csv("dataset,var1", 'ok,"two\nlines"', "ok"),
        f"deep/{DICTIONARY_FILE}": text(deep),
    }
    root = trees(files)
    for layouts in (32, 0):
        checked = check_folder(spark, root, compiled_layouts=layouts)
        found = {(unquote(r["file"]).split(root, 1)[1], r["column"], r["rule"]) for r in checked.violations.collect()}
        assert found == {
            ("/ok/_y.csv", "var3", "type"),
            ("/ok/.z 1.csv", "var3", "above_max"),
            ("/_hidden/.deep er/x.csv", "dataset", "not_in_enumeration"),
            ("/_hidden/.deep er/x.csv", "dataset", "unknown_dataset"),
            ("/_hidden/.deep er/_z.csv", None, "malformed_row"),
        }
        verdicts = [(r["kind"], r["first_rule"]) for r in checked.verdicts().collect()]
        assert len(verdicts) == 8 and ("dictionary", "invalid_json") in verdicts, verdicts
    assert check_folder(spark, f"{root}/_hidden/.deep er").violations.count() == 3


def test_hidden_names_are_loaded(spark, trees):
    root = trees(
        {
            f"ok/{DICTIONARY_FILE}": STUDY,
            "ok/x.csv": csv("dataset,var3", "ok,5"),
            "ok/_y.csv": csv("dataset,var3", "more,6", "more,7"),
            f"_hidden/{DICTIONARY_FILE}": text(study(["ok"], code="other")),
            "_hidden/x.csv": csv("dataset,var3", "ok,6"),
        }
    )
    house = Warehouse(spark, scratch(spark, "warehouse"))
    house.initialise()
    house.load_folder(root)
    assert sorted(r["var3"] for r in house.primary("study", "1.0").collect()) == [5, 6, 7]
    assert house.primary("other", "1.0").count() == 1
    sources = {r["code"]: r["csv_path"] for r in house.table("datasets").collect()}
    assert sources["more"].endswith("/ok/_y.csv")
    house.add_datasets(f"{root}/ok/_y.csv", "study", "1.0")
    assert house.primary("study", "1.0").count() == 5


def test_codes_that_differ_in_case_only(spark, trees):
    root = trees(
        {
            f"a/{DICTIONARY_FILE}": text(model("m", "1.0", [variable("dataset", codes=["d"]), variable("age", "int"), variable("Age")])),
            "a/x.csv": csv("dataset,age,Age", "d,1,x"),
            f"b/{DICTIONARY_FILE}": text(model("n", "1.0", [variable("dataset", codes=["d"]), variable("age", "int")])),
            "b/y.csv": csv("dataset,Age", "d,1"),
            "b/z.csv": csv("dataset,age,AGE", "d,1,2"),
            "b/fine.csv": csv("dataset,age", "d,1"),
        }
    )
    checked = check_folder(spark, root)
    clashes = checked.dictionary_violations.where("rule = 'code_case_clash'").collect()
    assert sorted((r["code"], r["detail"]) for r in clashes) == [("Age", "Age,age"), ("age", "Age,age")]
    judged = {r["path"].rsplit("/", 1)[1]: (r["first_rule"], r["first_column"]) for r in checked.verdicts().where("kind = 'file'").collect()}
    assert judged == {
        "x.csv": ("invalid_dictionary", None),
        "y.csv": ("unknown_column", "Age"),
        "z.csv": ("unknown_column", "AGE"),
        "fine.csv": (None, None),
    }


def test_rows_of_a_tree_are_counted_before_they_meet_their_verdicts(spark, tmp_path):
    events = spark.range(2000).selectExpr(
        "id AS event_id", "id % 5 AS user_id", "timestamp '2024-01-01' AS ts", "'view' AS event_type",
        "CAST(id % 150 + 1.5 AS double) AS value", "'{\"k\": 7}' AS props",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    out = contract.queries()["scan_awkward_names"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(i for i, line in enumerate(plan) if "Join Inner" in line and "file" in line)
    sides = [line.strip(" :+-") for line in plan[join + 1 : join + 3]]
    assert any(side.startswith("Aggregate") for side in sides), plan[: join + 3]
    rows = out.collect()
    assert sorted(r["grp"] for r in rows) == [str(i) for i in range(9)] and all(r["is_valid"] for r in rows)
    assert sum(r["n"] for r in rows) == 2000 - _dirty(events)


def _dirty(events):
    broken = " OR ".join(f"event_id % {n} = 0" for n in (211, 97, 89, 83, 79, 53))
    return events.where(broken).count()


def test_dictionary_files_are_written_by_the_tasks_of_their_groups(spark, tmp_path):
    groups = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "grp string").coalesce(1)
    folders._write_dictionaries(spark, "", str(tmp_path), groups)
    lines = {p.parent.name: p.read_text().split("\n") for p in tmp_path.rglob("*.txt")}
    assert {k: [v[:12] for v in vs] for k, vs in lines.items()} == {
        "grp=1": ['{"code":"g1"', ""],
        "grp=2": ['{"code":"g2"', '{"code":"g2"', ""],
        "grp=__HIVE_DEFAULT_PARTITION__": ["", ""],
    }
    assert not list(tmp_path.rglob("*.crc"))

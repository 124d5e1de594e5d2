import pytest

from tabwarden.functions.text import NA_TOKENS
from tabwarden.model import Cde, Profile
from tabwarden.operators import long_lists
from tabwarden.operators.long_lists import long_enumeration_violations
from tabwarden.operators.row_checks import row_violations, wide_row_violations
from tabwarden.operators.skew import spread_join
from tabwarden.plans.validate import validate_rows

CDES = [
    Cde("var1", "text"),
    Cde("var2", "text", True, codes=("l1", "l2")),
    Cde("var3", "real", minimum=5.0, maximum=60.0),
    Cde("var4", "int"),
    Cde("zero", "int", minimum=0.0),
    Cde("level", "int", True, codes=("1", "02")),
    Cde("grade", "text", False, codes=("a",)),
]


def found(spark, column, values, profile=Profile.FILE, plan=row_violations):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {column} string")
    out = plan(rows, [c for c in CDES if c.code == column], ["id"], profile)
    return sorted((r["id"], r["rule"]) for r in out.collect())


@pytest.mark.parametrize("plan", [row_violations, wide_row_violations])
@pytest.mark.parametrize(
    ("column", "values", "expected"),
    [
        ("var4", ["22", None], []),
        ("var4", ["1", "1.1", "22.0", "1e3", "1_000", " 22", "+3"], [(1, "type"), (2, "type"), (3, "type"), (4, "type")]),
        ("var4", ["1", "twelve"], [(1, "type")]),
        ("var3", ["5.1", "5,5"], [(1, "type")]),
        ("var3", ["1.0d", "1f", "inf", "0x1p4", "6e0", "7.", ".5e2"], [(0, "type"), (1, "type"), (2, "type"), (3, "type")]),
        ("var3", ["nan", "NaN", "", "NA", "null", "None"], []),
        ("var3", ["4", "5"], [(0, "below_min")]),
        ("var3", ["60", "65"], [(1, "above_max")]),
        ("var2", ["1", "l1"], [(0, "not_in_enumeration")]),
        ("var2", ["l2", None, "None"], []),
        ("zero", ["-1", "0"], [(0, "below_min")]),
        ("level", ["1", "2", "3", "x"], [(2, "not_in_enumeration"), (3, "type")]),
        ("grade", ["z"], []),
        ("var1", ["anything", "x" * 300], []),
    ],
)
def test_file_profile(spark, plan, column, values, expected):
    assert found(spark, column, values, plan=plan) == expected


@pytest.mark.parametrize("plan", [row_violations, wide_row_violations])
def test_load_profile(spark, plan):
    assert found(spark, "var1", ["x" * 255, "x" * 256], Profile.LOAD, plan) == [(1, "storage_fit")]
    assert found(spark, "var4", ["3000000000", "-5", ""], Profile.LOAD, plan) == [(0, "storage_fit")]
    assert found(spark, "var3", ["NaN"], Profile.LOAD, plan) == [(0, "type")]


def test_plans_agree_on_mixed_rows(spark):
    rows = spark.range(3000).selectExpr(
        "id", "concat('l', id % 4) AS var2", "CAST(id % 71 AS string) AS var3",
        "CASE WHEN id % 9 = 0 THEN 'x' ELSE CAST(id % 5 AS string) END AS level", "CAST(id % 3 - 1 AS string) AS zero",
    )
    one = row_violations(rows, CDES, ["id"])
    parts = wide_row_violations(rows, CDES, ["id"], limit=100)
    assert one.count() > 3000
    assert one.exceptAll(parts).isEmpty() and parts.exceptAll(one).isEmpty()


def test_column_names_with_dots_and_keys_that_are_checked(spark):
    rows = spark.createDataFrame([("1", "x")], "`a.b` string, id string")
    out = row_violations(rows, [Cde("a.b", "text", True, codes=("2",)), Cde("id", "int")], ["id"])
    assert sorted((r["column"], r["id"], r["rule"]) for r in out.collect()) == [
        ("a.b", "x", "not_in_enumeration"),
        ("id", "x", "type"),
    ]


def test_missing_dataset_column_and_null_dataset(spark):
    cdes = [Cde("dataset", "text", True, codes=("a",))]
    rows = spark.createDataFrame([("f", "a"), ("f", None), ("g", "b")], "file string, dataset string")
    out = {(r["file"], r["rule"], r["value"]) for r in validate_rows(rows, cdes).collect()}
    assert out == {("f", "unknown_dataset", None), ("g", "unknown_dataset", "b"), ("g", "not_in_enumeration", "b")}
    bare = validate_rows(rows.select("file"), cdes)
    assert {(r["file"], r["rule"]) for r in bare.collect()} == {
        ("f", "missing_dataset_column"),
        ("g", "missing_dataset_column"),
    }


def test_row_rules_need_no_shuffle_and_prune_columns(spark, tmp_path):
    spark.range(10).selectExpr("id", "CAST(id AS string) AS var3", "'x' AS unused").write.parquet(str(tmp_path / "t"))
    out = row_violations(spark.read.parquet(str(tmp_path / "t")), CDES, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "unused" not in plan


def test_long_code_lists_say_the_same(spark):
    cdes = [Cde("a", "text", True, codes=("x", "y ")), Cde("b", "int", True, codes=("1", "02", "q")), Cde("c", "real", True, codes=("0", "1.50"))]
    cells = [(i, a, b, c) for i, (a, b, c) in enumerate([("x", "01", "-0.0"), ("y", "2", "1.5"), (None, "3", "zero"), ("NA", "", "15e-1"), ("z", "x", "7")])]
    cells += [(i, "z", "5", "0") for i in range(10, 60)]
    rows = spark.createDataFrame(cells, "id int, a string, b string, c string")
    codes = spark.createDataFrame([(d.code, v) for d in cdes for v in d.codes] + [("a", "x"), ("a", None)], "column string, code string")
    want = row_violations(rows, cdes, ["id"]).where("rule = 'not_in_enumeration'")
    types = {d.code: d.sql_type for d in cdes}
    for hot_rows in (10, 100_000):
        got = long_enumeration_violations(rows, codes, ["id"], types, NA_TOKENS, hot_rows)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)
    assert long_enumeration_violations(rows.where("false"), codes, ["id"], types).count() == 0
    assert long_enumeration_violations(rows, codes.where("false"), ["id"], {"a": "text"}).count() == 54


def test_only_cells_in_doubt_meet_the_unknown_values(spark, monkeypatch):
    met = []

    def watched(cells, *more):
        met.append(cells.count())
        return spread_join(cells, *more)

    monkeypatch.setattr(long_lists, "spread_join", watched)
    rows = spark.range(1000).selectExpr("id", "CAST(id % 100 AS string) AS a", "CAST(id % 10 AS string) AS b")
    codes = spark.range(100).selectExpr("'a' AS column", "CAST(id AS string) AS code").where("code <> '7'")
    codes = codes.unionByName(spark.range(10).selectExpr("'b' AS column", "CAST(id AS string) AS code"))
    found = long_enumeration_violations(rows, codes, ["id"]).collect()
    assert sorted((r["id"], r["column"], r["value"]) for r in found) == [(i, "a", "7") for i in range(7, 1000, 100)]
    assert met == [10]

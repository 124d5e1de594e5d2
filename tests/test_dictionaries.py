import pytest
from samples import model, study, text, variable, visits

from tabwarden.operators.dictionary import bounded_columns, compile_cdes, dataset_codes, primary_schema
from tabwarden.operators.dictionary_rules import dictionary_verdict, dictionary_violations
from tabwarden.sources.dictionaries import flatten_dictionaries, parse_dictionaries


def read(spark, *bodies):
    rows = [(str(i), body if isinstance(body, str) else text(body)) for i, body in enumerate(bodies)]
    parsed = parse_dictionaries(spark.createDataFrame(rows, "model_key string, body string"))
    return parsed, flatten_dictionaries(parsed)


def rules(spark, body):
    models, cdes = read(spark, body)
    return {(r["rule"], r["code"]) for r in dictionary_violations(models, cdes).collect()}


def test_flatten_order_and_paths(spark):
    _, cdes = read(spark, study(["a"]))
    rows = cdes.orderBy("ordinal").collect()
    assert [r["code"] for r in rows] == ["var1", "subjectcode", "var2", "dataset", "var3", "var4"]
    assert [r["group_path"] for r in rows][-2:] == [["group"], ["group", "inner"]]
    assert (rows[4]["min"], rows[4]["max"]) == (5.0, 60.0)


def test_schema_bounds_and_codes(spark):
    _, cdes = read(spark, study(["a", "b"], low=0, high=None))
    compiled = compile_cdes(cdes)["0"]
    fields = [(f.name, f.dataType.simpleString()) for f in primary_schema(compiled).fields]
    assert fields[0] == ("row_id", "bigint")
    assert fields[-2:] == [("var3", "double"), ("var4", "bigint")]
    assert [(r["code"], r["min"], r["max"]) for r in bounded_columns(cdes).collect()] == [("var3", 0.0, None)]
    assert {(r["dataset"], r["label"]) for r in dataset_codes(cdes).collect()} == {("a", "label of a"), ("b", "label of b")}


def test_last_of_repeated_codes_counts(spark):
    listed = [{"code": "x", "label": "1"}, {"code": "y", "label": "2"}, {"code": "x", "label": "3"}]
    _, cdes = read(spark, model("m", "1", [{**variable("dataset", codes=["x"]), "enumerations": listed}]))
    assert cdes.first()["enumerations"] == {"x": "3", "y": "2"}


def test_valid_dictionaries(spark):
    models, cdes = read(spark, study(["a"]), visits(), study(["b"], code="other"))
    verdict = dictionary_verdict(models, dictionary_violations(models, cdes))
    assert [r["is_valid"] for r in verdict.collect()] == [True] * 3


def without(made, *keys):
    return {k: v for k, v in made.items() if k not in keys}


def changed(base, name, **more):
    """The dictionary with keys of one root variable replaced, or dropped where None."""
    variables = [
        without({**v, **more}, *[k for k, x in more.items() if x is None]) if v["code"] == name else v
        for v in base["variables"]
    ]
    return {**base, "variables": variables}


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ('{"code": "m", ', ("invalid_json", None)),
        (without(study(["a"]), "version"), ("missing_version", None)),
        (changed(study(["a"]), "var1", label=None), ("missing_key", "var1")),
        (changed(study(["a"]), "var1", code="not valid"), ("bad_identifier", "not valid")),
        (changed(study(["a"]), "var1", isCategorical=True), ("categorical_without_enumerations", "var1")),
        (study(["a"], low=55, high=50), ("min_not_below_max", "var3")),
        (study(["a"], low=50, high=50), ("min_not_below_max", "var3")),
        (study(["a"], low="low"), ("bad_bound", "var3")),
        (changed(study(["a"]), "var1", type="polynominal"), ("bad_type", "var1")),
        (changed(study(["a"]), "var1", sql_type="decimal"), ("bad_sql_type", "var1")),
        (changed(study(["a"]), "dataset", code="data"), ("dataset_cde_missing", None)),
        (changed(study(["a"]), "dataset", isCategorical=False), ("dataset_cde_not_categorical", None)),
        (changed(study(["a"]), "dataset", sql_type="int"), ("dataset_cde_not_text", None)),
        (changed(study(["a"]), "var1", code="var2"), ("duplicate_cde", "var2")),
        ({**study(["a"]), "code": 'a"b'}, ("bad_model_name", None)),
        ({**study(["a"]), "longitudinal": "yes"}, ("longitudinal_not_boolean", None)),
        (changed(visits(), "subjectid", code="other"), ("subjectid_missing", None)),
        (changed(visits(), "visitid", code="other"), ("visitid_missing", None)),
        (changed(visits(), "visitid", isCategorical=False), ("visitid_not_categorical", None)),
        (changed(visits(), "visitid", sql_type="int"), ("visitid_not_text", None)),
        (changed(visits(), "visitid", enumerations=None), ("visitid_without_enumerations", None)),
        (changed(study(["a"]), "var2", enumerations=[{"code": "x"}]), ("bad_enumeration", "var2")),
    ],
)
def test_broken_dictionaries(spark, body, expected):
    assert expected in rules(spark, body)


def test_first_failure_follows_the_flatten_order(spark):
    body = changed(changed(study(["a"], low=9, high=1), "var1", type="x"), "var2", label=None)
    models, cdes = read(spark, body)
    verdict = dictionary_verdict(models, dictionary_violations(models, cdes)).first()
    assert (verdict["first_rule"], verdict["first_code"], verdict["n_violations"]) == ("bad_type", "var1", 3)

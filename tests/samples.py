"""Dictionaries and CSV texts for the tests, built from short descriptions."""

import json


def variable(code, sql_type="text", kind=None, codes=None, low=None, high=None, **more):
    made = {
        "code": code,
        "label": code.title(),
        "sql_type": sql_type,
        "type": kind or {"text": "nominal", "int": "integer", "real": "real"}[sql_type],
        "isCategorical": codes is not None,
        **more,
    }
    if codes is not None:
        made["enumerations"] = [{"code": c, "label": f"label of {c}"} for c in codes]
    if low is not None:
        made["minValue"] = low
    if high is not None:
        made["maxValue"] = high
    return made


def model(code, version, variables, groups=(), **more):
    return {"code": code, "version": version, "label": code.title(), "variables": variables, "groups": list(groups), **more}


def study(codes, var2=("l1", "l2"), low=5, high=60, code="study"):
    """Four root variables, one in a group, one in a group of that group."""
    inner = {"name": "inner", "label": "Inner", "variables": [variable("var4", "int")], "groups": []}
    group = {"name": "group", "label": "Group", "variables": [variable("var3", "real", low=low, high=high)], "groups": [inner]}
    root = [variable("var1"), variable("subjectcode"), variable("var2", codes=var2), variable("dataset", codes=codes)]
    return model(code, "1.0", root, [group])


def visits(code="visits", version="2.0", **more):
    return model(
        code,
        version,
        [variable("dataset", codes=["long"]), variable("subjectid"), variable("visitid", codes=["BL", "FL1", "FL2"])],
        longitudinal=True,
        **more,
    )


def text(dictionary):
    return json.dumps(dictionary)


def csv(header, *rows):
    return "\n".join([header, *rows]) + "\n"

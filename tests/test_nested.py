"""Report payloads: wrappers, single values, nulls, damage."""

import json

from claimlake.operators import nested

SARIF = {"runs": [{"tool": {"driver": {"name": "t", "version": "1"}}, "results": [{"ruleId": "a", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "x"}}}, None, {}]}, None]}, None]}
REPORT = {"summary": {"docs": 1}, "coverage": {"packages": [{"package": "p", "missing": "only"}, None, {"package": "q", "missing": ["a", None, "b"]}], "flags": {"missing": ["no"]}}}
BOTH = {"location": {(0, 0, 0), (0, 0, 2)}, "package": {(0, -1, -1), (2, -1, -1)}, "missing": {(0, 0, -1), (2, 0, -1), (2, 2, -1)}}


def found(spark, *payloads):
    rows = spark.createDataFrame([(n, p, "clash") for n, p in enumerate(payloads)], "report_id bigint, payload string, v string")
    out = {}
    for r in nested.child_positions(rows).collect():
        out.setdefault(r.report_id, {}).setdefault(r.child, set()).add((r.i, r.j, r.k))
    return out


def test_wrappers(spark):
    whole = {"sarif": SARIF, "report": REPORT}
    text = json.dumps(whole)
    got = found(spark, text, json.dumps(text), "﻿" + text + "\n", json.dumps([whole]), json.dumps({"delivery": {"id": 1}, "body": whole}), json.dumps({"envelope": {"content": {"data": whole}}}), json.dumps({"body": text}))
    assert all(got[n] == BOTH for n in range(7))


def test_any_number_of_wrappers(spark):
    deep = {"sarif": SARIF, "report": REPORT}
    for n in range(70):
        deep = {"body": deep} if n % 3 == 0 else [deep] if n % 3 == 1 else {"data": json.dumps(deep)} if n < 6 else {"data": deep}
    assert found(spark, json.dumps(deep)) == {0: BOTH}


def test_single_values_and_absent_lists(spark):
    single = {"runs": {"results": {"locations": {"physicalLocation": {}}}}}
    got = found(spark, json.dumps(single), json.dumps({"runs": None}), json.dumps({"runs": [{"results": None}, {}]}), json.dumps({"coverage": None}), json.dumps({"coverage": {"packages": {"missing": []}}}))
    assert got == {0: {"location": {(0, 0, 0)}}, 4: {"package": {(0, -1, -1)}}}


def test_damaged(spark):
    text = json.dumps(SARIF)
    assert found(spark, text[:-4], "", None, "null", "{}", "[]", text + "]", text + " " + text, "not json", "   ") == {}


def test_tables_keep_their_parents(spark):
    rows = spark.createDataFrame([(7, json.dumps({"sarif": SARIF, "report": REPORT}))], "report_id bigint, payload string")
    t = nested.flatten_reports(rows)
    assert t["runs"].collect() == [(7, 0, "t", "1")]
    assert [(r.i, r.j, r.rule_id) for r in t["results"].collect()] == [(0, 0, "a")]
    assert [(r.j, r.k, r.uri) for r in t["locations"].orderBy("k").collect()] == [(0, 0, "x"), (0, 2, None)]
    assert sorted(r.name for r in t["missing"].collect()) == ["a", "b", "only"]
    parents = t["packages"].select("report_id", "i")
    assert t["missing"].join(parents, ["report_id", "i"], "left_anti").isEmpty()


def test_empty_table(spark):
    assert found(spark) == {}

import json

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import rules as R
from duskwatch.operators.scoring import Settings
from duskwatch.sources.rulestore import load_rules

A = {"field": "a", "op": "eq", "value": 1}


def one(spark, **doc):
    return R.collect_rules(R.rules_frame(spark, [{"id": "r", "name": "n", **doc}]))[0]


@pytest.mark.parametrize("doc,kind,within,least", [
    ({"match": {"msgId": "M"}}, "single", None, None),
    ({"match": {"msgId": "M"}, "aggregate": {"minCount": 3}}, "threshold", 3600, 3),
    ({"match": {"msgId": "M"}, "aggregate": {"count": {"min": 4}, "minCount": 3, "within": "30s"}}, "threshold", 30, 4),
    ({"match": {"msgId": "M"}, "aggregate": {"type": "count"}}, "threshold", 3600, 1),
    ({"patterns": [{"match": {"msgId": "M"}, "quantifier": {"min": 5}}]}, "threshold", 3600, 5),
    ({"patterns": [{"match": {"msgId": "M"}, "quantifier": {"min": 5}}], "within": ""}, "threshold", 300, 5),
    ({"patterns": [{"match": {}}, {"match": {}}]}, "all", 1800, None),
    ({"patterns": [{"match": {}}, {"match": {}}], "within": "2"}, "all", 120, None),
    ({"patterns": [{"match": {}}, {"match": {}}], "logic": "or"}, "any", None, None),
    ({"events": [{"msgId": "A"}, {"msgId": "B"}]}, "sequence", 300, None),
    ({"events": [{"msgId": "A"}]}, "single", None, None),
    ({"conditions": [A]}, "single", None, None),
    ({}, "none", None, None),
])
def test_forms(spark, doc, kind, within, least):
    r = one(spark, **doc)
    assert (r["kind"], r["within_s"], r["min_count"]) == (kind, within, least)


def test_legacy_conditions_give_the_type(spark):
    p = one(spark, conditions=[{"field": "msgId", "op": "eq", "value": "M"}, A])["patterns"]
    assert p[0]["msg_id"] == "M" and [c["field"] for c in p[0]["conditions"]] == ["a"]


def test_sequence_is_sorted_and_drops_patterns_without_order(spark):
    r = one(spark, patterns=[{"order": 2, "match": {"msgId": "B"}}, {"match": {"msgId": "X"}}, {"order": 1, "match": {"msgId": "A"}, "quantifier": {"min": 2, "max": 4}}])
    assert [(p["msg_id"], p["qmin"], p["qmax"]) for p in r["patterns"]] == [("A", 2, 4), ("B", 1, 1)]
    r = one(spark, patterns=[{"order": 1, "match": {}, "quantifier": {"max": 3}}, {"order": 2, "match": {}, "quantifier": {"min": 2}}])
    assert [(p["qmin"], p["qmax"]) for p in r["patterns"]] == [(1, 3), (2, None)]


def test_defaults(spark):
    r = one(spark, match={"msgId": "M"})
    assert (r["severity"], r["by"], r["weight"], r["enabled"]) == ("MEDIUM", ["userId"], 0.0, False)
    r = one(spark, match={"msgId": "M"}, severity="LOW", cep={"severity": "HIGH"}, ueba={"weight": 3}, by=["hostname", "hostname"])
    assert (r["severity"], r["by"], r["weight"]) == ("HIGH", ["hostname"], 3.0)


M = {"msgId": "M"}


@pytest.mark.parametrize("doc,error", [
    ({"name": "", "match": M}, "name required"),
    ({"name": "n"}, "match required"),
    ({"name": "n", "match": {"logic": "and"}}, "match.msgId required"),
    ({"name": "n", "match": {**M, "conditions": [{"op": "eq", "value": 1}]}}, "conditions[0]: field required"),
    ({"name": "n", "match": {**M, "conditions": [A, {"field": "a", "op": "is", "value": 1}]}}, "conditions[1]: unknown operator"),
    ({"name": "n", "match": {**M, "conditions": [{"field": "a", "op": "eq"}]}}, "conditions[0]: value required"),
    ({"name": "n", "match": {**M, "conditions": [{"field": "hour", "op": "time_range", "end": 3}]}}, "conditions[0]: start required"),
    ({"name": "n", "match": {**M, "conditions": [{"field": "hour", "op": "time_range", "start": 3}]}}, "conditions[0]: end required"),
    ({"name": "n", "match": {**M, "conditions": [{"field": "a", "op": "gt", "value": "x"}]}}, "conditions[0]: value is not a number"),
    ({"name": "n", "match": M, "aggregate": {"type": "median"}}, "aggregate.type unknown: median"),
    ({"name": "n", "match": M, "aggregate": {"type": "sum"}}, "aggregate.field required"),
    ({"name": "n", "match": M, "within": "soon"}, "within is not a window length"),
    ({"name": "n", "patterns": [{"order": 1, "match": M}, {"match": M}]}, "patterns without order are ignored in a sequence"),
    ({"name": "n", "patterns": [{"match": M}, {"match": M}], "aggregate": {"minCount": 2}}, "aggregate is ignored with several patterns"),
    ({"name": "n", "patterns": [{"match": M}, {"match": M, "quantifier": {"min": 2}}]}, "quantifier is ignored without order"),
    ({"name": "n", "events": [{"msgId": "A", "conditions": [{"field": "a", "op": "?", "value": 1}]}]}, "pattern conditions[0]: unknown operator"),
])
def test_validation(spark, doc, error):
    assert R.validate_rules(R.rules_frame(spark, [{"id": "r", **doc}])).first()["errors"] == [error]


def test_valid_rules_have_no_errors(spark):
    ok = [{"id": "r", "name": "n", "match": {**M, "conditions": [
        {"field": "hour", "op": "time_range", "value": {"start": 22, "end": 6}}, {"field": "a", "op": "in", "value": [1]},
        {"field": "a", "op": "like", "value": "x%"}, {"field": "a", "op": "lte", "value": "5"}]}}]
    assert R.validate_rules(R.rules_frame(spark, ok)).first()["errors"] == []


def test_load_active_rules(spark, tmp_path):
    docs = [
        {"id": "a", "enabled": True, "cep": {"enabled": True}, "match": M},
        {"ruleId": "b", "enabled": True, "ueba": {"enabled": True}, "match": M},
        {"id": "c", "enabled": False, "cep": {"enabled": True}, "ueba": {"enabled": True}, "match": M},
        {"id": "d", "match": M},
    ]
    path = tmp_path / "rules.json"
    path.write_text("\n".join(map(json.dumps, docs)))
    ids = lambda kind: [r["rule_id"] for r in R.collect_rules(load_rules(spark, str(path), kind))]
    assert ids("cep") == ["a"] and ids("ueba") == ["b"] and ids(None) == ["a", "b", "c", "d"]
    assert R.collect_rules(load_rules(spark, str(path), "ueba"))[0]["name"] == "b"


def test_settings_defaults(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text('{"beta": 5, "lambda": 0.5,\n "multipliers": {"vip": 0.5}}')
    s = Settings.load(spark, str(path))
    assert (s.beta, s.decay, s.z_threshold, s.multipliers) == (5.0, 0.5, 2.0, {"vip": 0.5})


def test_merge_keeps_the_first_list(spark):
    a = spark.createDataFrame([("x", 1), ("y", None)], "rule_id string, w int")
    b = spark.createDataFrame([("y", 2), ("z", 3)], "rule_id string, w int")
    assert {(r.rule_id, r.w) for r in R.merge_rules(a, b).collect()} == {("x", 1), ("y", None), ("z", 3)}


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("x", "a", 1.0), ("y", "b", 2.0)], "rule_id string, name string, weight double")
    new = spark.createDataFrame([("y", 9.0), ("z", 3.0)], "rule_id string, weight double")
    gone = spark.createDataFrame([("x",)], "rule_id string")
    got = {(r.rule_id, r.name, r.weight) for r in R.upsert_rules(old, new, gone).collect()}
    assert got == {("y", "b", 9.0), ("z", None, 3.0)}
    weights = spark.createDataFrame([("x", None)], "rule_id string, weight double")
    assert {(r.rule_id, r.weight) for r in R.apply_weights(old, weights).collect()} == {("x", 0.0), ("y", 2.0)}


def test_rule_values_are_never_code(spark):
    from duskwatch.functions.predicates import condition

    df = spark.createDataFrame([({"a": "x' OR '1'='1"}, "M")], "ext map<string,string>, msg_id string")
    assert df.where(condition({"field": "a", "op": "eq", "value": "x' OR '1'='1"})).count() == 1
    assert df.where(condition({"field": "a", "op": "eq", "value": "y' OR '1'='1"})).count() == 0
    assert df.where(F.lit(True)).count() == 1

"""Rules as data against the same rules as columns."""

import datetime as dt
import operator
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from duskwatch import datasets as D
from duskwatch.functions.fields import as_number
from duskwatch.operators import detect as DT
from duskwatch.operators import ruleindex as X
from duskwatch.operators import rules as R
from duskwatch.schema import EVENT

VALUES = {
    "outcome": ["allowed", "blocked", "BLOCKED", ""],
    "fsize": ["60", "6e1", " 60 ", "60.5", "-1", "x", "1f", "NaN", "200"],
    "k": ["5", "05", "7", "-0", "0.0"],
    "action": ["error", "click"],
    "userId": ["1", "2", "3"],
    "hostname": ["h1", "h2"],
    "missing": ["1"],
    "": ["1"],
}
TYPES = ["M_A", "M_B", "M_C", None]


def condition(rng):
    name = rng.choice([*VALUES, "hour", "dayOfWeek"])
    value = rng.choice([*VALUES.get(name, ["1", "9", "13", "x"]), "60", "7"])
    op = rng.choice(["eq", "eq", "neq", "gt", "gte", "lt", "lte", "in", "in", "like", "regex", "contains", "time_range", "odd"])
    if op == "in":
        more = rng.sample(VALUES.get(name, ["1", "9"]), 1)
        return {"field": name, "op": op, **rng.choice([{"value": [value, *more]}, {"values": [value, *more]}, {"value": f'["{value.strip()}", 7, true]'}, {"value": "[1, "}])}
    if op == "time_range":
        return {"field": name, "op": op, **rng.choice([{"start": 9, "end": 13}, {"start": 22, "end": 3}, {"value": '{"start": 1, "end": 12}'}])}
    return {"field": name, "op": op, "value": {"like": "%l%", "regex": "^[a-b6].*", "contains": "LO"}.get(op, value)}


def rule(rng, i):
    def match():
        return {"msgId": rng.choice([*TYPES, ""]), "logic": rng.choice(["and", "or", "OR"]), "conditions": [condition(rng) for _ in range(rng.choice([0, 1, 1, 2, 3]))]}

    doc = {"id": f"r{i}", "name": f"rule {i}", "enabled": True, "cep": {"enabled": True}, "by": rng.choice([None, ["hostname"], ["userId", "k"], ["outcome", "userIp"]])}
    shape = rng.choice(["single", "threshold", "all", "any"])
    if shape in ("single", "threshold"):
        doc["match"] = match()
        if shape == "threshold":
            doc["aggregate"] = {"within": rng.choice(["1h", "12h", "30m"]), "minCount": rng.randint(1, 3)}
    else:
        doc["patterns"] = [{"match": match()} for _ in range(rng.randint(2, 3))]
        doc["logic"], doc["within"] = "OR" if shape == "any" else "AND", "12h"
    return doc


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        ext = {n: rng.choice(v) for n, v in VALUES.items() if n not in ("", "missing", "action", "userId", "hostname") and rng.random() < 0.8}
        if rng.random() < 0.8:
            ext["act"] = rng.choice(VALUES["action"])
        if rng.random() < 0.1:
            ext |= {"userId": "1", "": "1", "hour": "9"}
        at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 4000))
        rows.append((i, at, rng.choice(TYPES), rng.choice(["h1", "h2", None]), "app", rng.choice(["1", "2", "3", None]), None, rng.choice(["10.0.0.1", None]), ext, None))
    return spark.createDataFrame(rows, EVENT).cache()


def alerts(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_same_alerts_as_rules_in_the_plan(spark, events, seed):
    rng = random.Random(seed)
    docs = R.rules_frame(spark, [rule(rng, i) for i in range(30)])
    got = alerts(X.detect(events, docs))
    assert got == alerts(DT.detect(events, R.collect_rules(docs))) and len({a[1] for a in got}) > 10


def test_same_alerts_without_broadcasts(spark, events, monkeypatch):
    docs = R.rules_frame(spark, [rule(random.Random(9), i) for i in range(30)])
    want = alerts(DT.detect(events, R.collect_rules(docs)))
    monkeypatch.setattr(X, "broadcast_if_small", lambda df: df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert alerts(X.detect(events, docs)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def bounds(n):
    return [{"id": f"b{i}", "name": "b", "match": {"msgId": "M_A", "conditions": [{"field": "fsize", "op": ["gt", "gte", "lt", "lte"][i % 4], "value": i}]}} for i in range(n)]


def test_plan_does_not_grow_with_the_rules(spark, events):
    def size(n):
        found = X.matches(events, X.compile_rules(R.rules_frame(spark, bounds(n))))
        return len(found._jdf.queryExecution().analyzed().toString().split("\n"))

    assert size(10) == size(5000)


def test_bounds_are_found_by_few_nodes(spark, events):
    compiled = X.compile_rules(R.rules_frame(spark, bounds(1000)))
    per_rule = X.Index(compiled).entries.groupBy("rule_id", "p", "a").count().agg(F.max("count"), F.count("*")).first()
    assert per_rule[0] <= X.LEVELS + 1 and per_rule[1] == 1000
    values = [r[0] for r in events.where("msg_id = 'M_A'").select(as_number(F.col("ext")["fsize"])).collect() if r[0] is not None]
    test = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
    conditions = {d["id"]: d["match"]["conditions"][0] for d in bounds(1000)}
    want = {k: sum(test[c["op"]](v, c["value"]) for v in values) for k, c in conditions.items()}
    got = {r["rule_id"]: r["count"] for r in X.detect(events, R.rules_frame(spark, bounds(1000))).groupBy("rule_id").count().collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_an_event_meets_rules_of_its_values_only(spark, events):
    """Ten thousand rules on users; an event is a candidate of those of its own user."""
    docs = [{"id": f"u{i}", "name": "u", "match": {"msgId": "M_A", "conditions": [{"field": "userId", "op": "eq", "value": str(i)}]}} for i in range(10_000)]
    compiled = X.compile_rules(R.rules_frame(spark, docs))
    event, index = X.Event("UTC"), X.Index(compiled)
    probes = events.select("*", *event.columns()).select("event_id", F.explode(index.keys(event)).alias("key"))
    mine = events.where("msg_id = 'M_A' AND coalesce(ext['userId'], user_id) IS NOT NULL").count()
    assert probes.join(index.entries, "key").count() == mine > 0


def test_empty_tables(spark, events):
    none = R.rules_frame(spark, [])
    assert X.detect(events, none).count() == 0
    docs = R.rules_frame(spark, D.DETECTION_RULES + D.SEQUENCE_RULES + [{"id": "empty"}])
    assert X.detect(events.limit(0), docs).count() == 0
    assert {r["rule_id"] for r in X.compile_rules(docs).collect()} == {d["id"] for d in D.DETECTION_RULES}

import datetime as dt

import pytest

from duskwatch.functions.predicates import condition, match, on_days, text_search
from duskwatch.functions.windows import window_expr

EXT = {"n": "10", "f": "10.5", "t": "Hello", "hex": "12f", "flag": "true", "empty": "", "act": "write"}


@pytest.fixture(scope="module")
def event(spark):
    row = (EXT, "M", "host", "app", "u", "name", "1.2.3.4", dt.datetime(2024, 1, 6, 14, 30))
    return spark.createDataFrame(
        [row], "ext map<string,string>, msg_id string, hostname string, app_name string, user_id string, user_name string, user_ip string, ts timestamp")


def c(field, op, value=None, **more):
    return {"field": field, "op": op, "value": value, **more}


# The event is at 23:30 on a Saturday in local time.
@pytest.mark.parametrize("cond,holds", [
    (c("n", "eq", "10.0"), True), (c("n", "eq", 10), True), (c("t", "eq", "Hello"), True), (c("t", "eq", "hello"), False),
    (c("flag", "eq", True), True), (c("flag", "eq", "false"), False), (c("none", "eq", "x"), False), (c("empty", "eq", ""), True),
    (c("hex", "eq", "12"), False), (c("hex", "eq", "12f"), True), (c("hex", "gt", "1"), False),
    (c("n", "neq", "11"), True), (c("n", "neq", "10"), False), (c("none", "neq", "x"), False), (c("t", "neq", "5"), True),
    (c("n", "gt", "9"), True), (c("n", "gte", "10"), True), (c("n", "lt", "10"), False), (c("f", "lte", "10.5"), True),
    (c("t", "lt", "5"), False), (c("t", "gte", "0"), False), (c("none", "lte", "5"), False), (c("n", "gt", "x"), False),
    (c("n", "in", "[9, 10]"), True), (c("t", "in", '["a", "Hello"]'), True), (c("t", "in", "[]"), False), (c("n", "in", None, values=["10"]), True),
    (c("t", "like", "H%o"), True), (c("t", "like", "h%"), False), (c("t", "regex", "l{2}"), True), (c("t", "regex", "^l"), False),
    (c("t", "contains", "ELL"), True), (c("n", "contains", "1"), True), (c("none", "contains", ""), False),
    (c("action", "eq", "write"), True), (c("hostname", "eq", "host"), True), (c("userIp", "like", "1.2.%"), True),
    (c("hour", "eq", "23"), True), (c("time", "gte", "23"), True), (c("dayOfWeek", "in", "[1, 7]"), True), (c("dayOfWeek", "eq", "6"), False),
    (c("hour", "time_range", start=22, end=6), True), (c("hour", "time_range", start=9, end=18), False), (c("hour", "time_range", start=23, end=23), False),
    (c("hour", "time_range", '{"start": 22, "end": 6}'), True), (c("n", "time_range", start=10, end=11), True),
    (c("n", "sounds", "10"), False),
])
def test_condition(event, cond, holds):
    assert event.where(condition(cond)).count() == holds


@pytest.mark.parametrize("spec,holds", [
    ({"msg_id": "M", "conditions": []}, True), ({"msg_id": "X", "conditions": []}, False), ({}, True),
    ({"msg_id": "M", "logic": "AND", "conditions": [c("n", "eq", 10), c("t", "eq", "x")]}, False),
    ({"msg_id": "M", "logic": "OR", "conditions": [c("none", "eq", 10), c("t", "eq", "Hello")]}, True),
    ({"msg_id": "X", "logic": "or", "conditions": [c("n", "eq", 10)]}, False),
])
def test_match(event, spec, holds):
    assert event.where(match(spec)).count() == holds


def test_match_without_type(event):
    assert event.where(match({}, require_type=True)).count() == 0


def test_days_and_search(event):
    assert event.where(on_days("ts", "2024-01-06")).count() == 1
    assert event.where(on_days("ts", "2024-01-05")).count() == 0
    assert event.where(on_days("ts", "2024-01-06", tz="UTC")).count() == 1
    assert event.where(text_search("HOS", "user_id", "hostname")).count() == 1
    assert event.where(text_search("zz", "user_id", "hostname")).count() == 0
    assert event.where(text_search("", "user_id")).count() == 1


def test_filters_reach_the_scan(spark, event, tmp_path):
    path = str(tmp_path / "e")
    event.write.parquet(path)
    plan = spark.read.parquet(path).where(match({"msg_id": "M"}) & on_days("ts", "2024-01-06"))._jdf.queryExecution().toString()
    assert "EqualTo(msg_id,M)" in plan and "GreaterThanOrEqual(ts" in plan


def test_window_text():
    assert [window_expr(t) for t in ("30s", "5m", "2h", "7", "", None)] == ["30 seconds", "300 seconds", "7200 seconds", "420 seconds", "300 seconds", "300 seconds"]
    with pytest.raises(ValueError):
        window_expr("soon")

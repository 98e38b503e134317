"""Rule operators: per event type, how many events satisfy each condition, and a checksum of their ids."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch import datasets as D
from duskwatch.functions import predicates as P

from . import EV, query, with_


def tally(spark, d, **tests: Column):
    aggs = []
    for name, test in tests.items():
        aggs += [F.count(F.when(test, 1)).alias(f"{name}_n"), F.coalesce(F.sum(F.when(test, F.col("event_id"))), F.lit(0)).alias(f"{name}_ids")]
    return D.events(spark, d).groupBy("msg_id").agg(*aggs)


def tally_sql(**tests: str) -> str:
    cols = [f"count(CASE WHEN {t} THEN 1 END) AS {n}_n, CAST(coalesce(sum(CASE WHEN {t} THEN event_id END), 0) AS BIGINT) AS {n}_ids" for n, t in tests.items()]
    return with_(EV) + f"SELECT msg_id, {', '.join(cols)} FROM ev GROUP BY msg_id"


def cond(field: str, op: str, value=None, **more) -> Column:
    return P.condition({"field": field, "op": op, "value": value, **more})


def _register(name: str, tests: dict[str, tuple[Column, str]]) -> None:
    built = {k: v[0] for k, v in tests.items()}
    query(name, tally_sql(**{k: v[1] for k, v in tests.items()}))(functools.partial(_run, built))


def _run(built, spark, d):
    return tally(spark, d, **{k: v() for k, v in built.items()})


#: Query -> test -> (condition, the same in SQL). Columns are built when a query runs.
TESTS = {
    "predicate_eq": {
        "number": (lambda: cond("k", "eq", "42"), "k = 42"),
        "decimal": (lambda: cond("k", "eq", "42.0"), "k = 42"),
        "text": (lambda: cond("outcome", "eq", "blocked"), "outcome = 'blocked'"),
        "type": (lambda: cond("msgId", "eq", "MESSAGE_VIEW"), "msg_id = 'MESSAGE_VIEW'"),
        "absent": (lambda: cond("nothing", "eq", "x"), "false"),
    },
    "predicate_neq": {
        "number": (lambda: cond("k", "neq", "42"), "k <> 42"),
        "text": (lambda: cond("outcome", "neq", "blocked"), "outcome <> 'blocked'"),
        "absent": (lambda: cond("nothing", "neq", "x"), "false"),
    },
    "predicate_compare": {
        "gt": (lambda: cond("fsize", "gt", "100"), "fsize > 100"),
        "gte": (lambda: cond("k", "gte", "80"), "k >= 80"),
        "lt": (lambda: cond("fsize", "lt", "0.5"), "fsize < 0.5"),
        "lte": (lambda: cond("k", "lte", "10"), "k <= 10"),
        "not_a_number": (lambda: cond("outcome", "lt", "10"), "false"),
    },
    "predicate_in": {
        "numbers": (lambda: cond("k", "in", "[1, 7, 42]"), "k IN (1, 7, 42)"),
        "texts": (lambda: cond("hostname", "in", None, values=["host-1", "host-7"]), "hostname IN ('host-1', 'host-7')"),
        "mixed": (lambda: cond("act", "in", '["view", 5]'), "act = 'view'"),
    },
    "predicate_like": {
        "prefix": (lambda: cond("hostname", "like", "host-1%"), "hostname LIKE 'host-1%'"),
        "single": (lambda: cond("hostname", "like", "host-_"), "hostname LIKE 'host-_'"),
    },
    "predicate_regex": {
        "find": (lambda: cond("hostname", "regex", "-1[0-5]$"), "regexp_matches(hostname, '-1[0-5]$')"),
        "middle": (lambda: cond("act", "regex", "i[ce]"), "regexp_matches(act, 'i[ce]')"),
    },
    "predicate_contains": {
        "folded": (lambda: cond("outcome", "contains", "LOCK"), "contains(lower(outcome), 'lock')"),
        "digits": (lambda: cond("k", "contains", "7"), "contains(CAST(k AS VARCHAR), '7')"),
    },
    "predicate_time_range": {
        "day": (lambda: cond("hour", "time_range", start=9, end=18), "hour(lts) >= 9 AND hour(lts) < 18"),
        "night": (lambda: cond("hour", "time_range", start=22, end=6), "hour(lts) >= 22 OR hour(lts) < 6"),
        "inner": (lambda: cond("time", "time_range", '{"start": 22, "end": 6}'), "hour(lts) >= 22 OR hour(lts) < 6"),
        "weekend": (lambda: cond("dayOfWeek", "in", "[1, 7]"), "dayofweek(lts) IN (0, 6)"),
    },
    "predicate_match": {
        "all": (lambda: P.match({"msg_id": "MESSAGE_ERROR", "logic": "AND", "conditions": [
            {"field": "outcome", "op": "eq", "value": "blocked"}, {"field": "fsize", "op": "gt", "value": "50"}]}),
            "msg_id = 'MESSAGE_ERROR' AND outcome = 'blocked' AND fsize > 50"),
        "any": (lambda: P.match({"msg_id": "MESSAGE_ERROR", "logic": "OR", "conditions": [
            {"field": "outcome", "op": "eq", "value": "blocked"}, {"field": "nothing", "op": "eq", "value": "1"}, {"field": "fsize", "op": "gt", "value": "50"}]}),
            "msg_id = 'MESSAGE_ERROR' AND (outcome = 'blocked' OR fsize > 50)"),
        "open": (lambda: P.match({"conditions": []}), "true"),
    },
    "predicate_search": {
        "one": (lambda: P.text_search("OST-1", "user_id", "hostname"), "contains(hostname, 'ost-1')"),
        "either": (lambda: P.text_search("14", "user_id", "hostname"), "contains(user_id, '14') OR contains(hostname, '14')"),
    },
    "predicate_days": {
        "day": (lambda: P.on_days("ts", "2024-01-30"), "day = DATE '2024-01-30'"),
        "range": (lambda: P.on_days("ts", "2024-01-10", "2024-01-12"), "day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"),
        "last": (lambda: P.last_days("ts", "2024-01-30", 7), "day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'"),
    },
    "predicate_exists": {
        "present": (lambda: F.col("ext")["k"].isNotNull(), "true"),
        "absent": (lambda: F.col("ext")["nothing"].isNotNull(), "false"),
    },
}

for _name, _tests in TESTS.items():
    _register(_name, _tests)

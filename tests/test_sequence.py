"""Ordered rules against a plain loop."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskwatch.operators import detect as DT
from duskwatch.operators import rules as R
from duskwatch.operators import sequence as S
from duskwatch.operators.asof import as_of

T0 = dt.datetime(2024, 1, 1)


def loop(masks, times, quantifiers, within):
    """Matches as (first, last) index, found by trying everything."""
    out, i = [], 0

    def end(step, at, first):
        low, high = quantifiers[step]
        n = 0
        while at + n < len(masks) and (high is None or n < high) and masks[at + n] >> step & 1 and times[at + n] - times[first] < within:
            n += 1
        for take in range(n, low - 1, -1):
            stop = at + take if step == len(quantifiers) - 1 else end(step + 1, at + take, first)
            if stop is not None:
                return stop
        return None

    while i < len(masks):
        stop = end(0, i, i)
        if stop is None:
            i += 1
        else:
            out.append((i, stop - 1))
            i = stop
    return out


quantifier = st.tuples(st.integers(1, 3), st.one_of(st.none(), st.integers(0, 2))).map(lambda q: (q[0], None if q[1] is None else q[0] + q[1]))


@settings(max_examples=300, deadline=None)
@given(st.lists(quantifier, min_size=1, max_size=3), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 3), st.booleans()), max_size=40), st.integers(1, 12))
def test_match_ends_equals_loop(quantifiers, rows, within):
    masks = [m for m, _, _ in rows]
    times = np.cumsum([g for _, g, _ in rows]).tolist() if rows else []
    fresh = np.array([i == 0 or (f and times[i] % 3 == 0) for i, (_, _, f) in enumerate(rows)], dtype=bool)
    ends = S.match_ends(np.arange(len(rows)), np.array(times, dtype=np.int64), np.array(masks, dtype=np.int64), fresh, quantifiers, within)
    bounds = [*np.flatnonzero(fresh).tolist(), len(rows)] if rows else [0]
    want, got = [], []
    for a, b in zip(bounds, bounds[1:]):
        want += [(a + x, a + y) for x, y in loop(masks[a:b], times[a:b], quantifiers, within)]
        i = a
        while i < b:
            if ends[i] >= 0:
                got.append((i, int(ends[i])))
                i = int(ends[i])
            i += 1
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 4)), max_size=40), st.integers(5, 9), st.integers(1, 4))
def test_chunk_maps_compose_to_one_walk(pairs, chunk, per_group):
    """The two-level composition of chunk maps gives the entries of a single walk."""
    import pandas as pd

    cands = sorted({a: (a, a + n) for a, n in pairs}.values())
    want = [cands[i] for i in S._walk([a for a, _ in cands], [b for _, b in cands], 0)]
    rows = [("r", a // chunk, a, b, False) for a, b in cands] + [("r", a // chunk + 1, a, b, True) for a, b in cands if b // chunk > a // chunk]
    if not rows:
        return
    table = pd.DataFrame(rows, columns=["rule_id", "chunk", "start", "stop", "incoming"])
    maps = pd.concat([S._chunk_map(g, chunk) for _, g in table.groupby("chunk")])
    maps["grp"] = maps["chunk"] // per_group
    groups = pd.concat([S._group_map(g, chunk) for _, g in maps.groupby("grp")])
    entered = S._group_entries(groups, chunk)
    entries = pd.concat([S._chunk_entries(g, chunk) for _, g in maps.merge(entered, on=["rule_id", "grp"]).groupby("grp")])
    got = []
    for number, entry in zip(entries["chunk"], entries["entry"]):
        own = [c for c in cands if c[0] // chunk == number]
        got += [own[i] for i in S._walk([a for a, _ in own], [b for _, b in own], entry)]
    assert sorted(got) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 50)), max_size=40), st.integers(3, 9), st.integers(1, 4))
def test_chunk_maps_compose_with_matches_over_many_chunks(pairs, chunk, per_group):
    """Matches longer than a chunk, or a group of chunks, give the walk over all candidates too."""
    import pandas as pd

    cands = sorted({a: (a, a + n) for a, n in pairs}.values())
    want = [cands[i] for i in S._walk([a for a, _ in cands], [b for _, b in cands], 0)]
    rows = [("r", a // chunk, a, b, False) for a, b in cands] + [("r", b // chunk, a, b, True) for a, b in cands if b // chunk > a // chunk]
    if not rows:
        return
    table = pd.DataFrame(rows, columns=["rule_id", "chunk", "start", "stop", "incoming"])
    maps = pd.concat([S._chunk_map(g, chunk) for _, g in table.groupby("chunk")])
    maps["grp"] = maps["chunk"] // per_group
    groups = pd.concat([S._group_map(g, chunk) for _, g in maps.groupby("grp")])
    entered = S._group_entries(groups, chunk)
    entries = pd.concat([S._chunk_entries(g, chunk) for _, g in maps.merge(entered, on=["rule_id", "grp"]).groupby("grp")])
    got = []
    for number, entry in zip(entries["chunk"], entries["entry"]):
        own = [c for c in cands if c[0] // chunk == number]
        got += [own[i] for i in S._walk([a for a, _ in own], [b for _, b in own], entry)]
    assert sorted(got) == want


def rule(**doc):
    return {"id": "seq", "name": "seq", "enabled": True, "cep": {"enabled": True}, **doc}


def step(order, kind, **quantifier):
    return {"order": order, "match": {"msgId": kind}, **({"quantifier": quantifier} if quantifier else {})}


RULES = {
    "exact": rule(within="60s", patterns=[step(1, "A"), step(2, "A"), step(3, "B")]),
    "overlapping": rule(within="60s", patterns=[step(1, "A"), step(2, "A")]),
    "bounded": rule(within="60s", patterns=[step(1, "A", min=1, max=3), step(2, "B", min=2, max=2)]),
    "open": rule(within="40s", patterns=[step(1, "A", min=2), step(2, "B")]),
    "open_last": rule(within="90s", patterns=[step(1, "A", min=3)]),
    "open_three": rule(within="200s", patterns=[step(1, "A", min=1), step(2, "B", min=1, max=2), step(3, "A", min=2)]),
}


def events(spark, rows):
    """rows: (user, seconds, kind)"""
    data = [(i, T0 + dt.timedelta(seconds=s), k, f"h{i}", "app", u, u, "ip", {"suid": u}) for i, (u, s, k) in enumerate(rows)]
    return spark.createDataFrame(
        data, "event_id bigint, ts timestamp, msg_id string, hostname string, app_name string, user_id string, user_name string, user_ip string, ext map<string,string>")


def expected(rows, compiled):
    out = []
    for user in {u for u, _, _ in rows}:
        mine = sorted((s, i, k) for i, (u, s, k) in enumerate(rows) if u == user)
        masks = [sum(1 << j for j, p in enumerate(compiled["patterns"]) if p["msg_id"] == k) for _, _, k in mine]
        found = loop(masks, [s for s, _, _ in mine], [(p["qmin"], p["qmax"]) for p in compiled["patterns"]], compiled["within_s"])
        out += [(user, b - a + 1, f"h{mine[b][1]}") for a, b in found]
    return sorted(out)


def random_rows(n, seed):
    rnd = random.Random(seed)
    # One user holds most rows; few seconds, so many rows share an instant.
    return [("hot" if rnd.random() < 0.7 else rnd.choice("xyz"), rnd.randrange(0, n * 4), rnd.choice("AAABC")) for _ in range(n)]


@pytest.mark.parametrize("name", RULES)
def test_spark_equals_loop_in_small_chunks(spark, name):
    rows = random_rows(300, hash(name) % 97)
    compiled = R.collect_rules(R.rules_frame(spark, [RULES[name]]))
    got = S.detect_sequence(events(spark, rows), compiled, chunk=8, per_group=3).collect()
    assert sorted((r.user_id, r.cnt, r.hostname) for r in got) == expected(rows, compiled[0])


def test_limit_is_strict_and_skip_past_last_row(spark):
    compiled = R.collect_rules(R.rules_frame(spark, [RULES["overlapping"]]))
    rows = [("u", 0, "A"), ("u", 60, "A"), ("u", 119, "A"), ("u", 120, "A"), ("u", 121, "A")]
    got = S.detect_sequence(events(spark, rows), compiled).collect()
    assert sorted((r.cnt, r.hostname) for r in got) == [(2, "h2"), (2, "h4")]


def test_other_rows_of_the_key_break_a_match(spark):
    compiled = R.collect_rules(R.rules_frame(spark, [RULES["overlapping"]]))
    rows = [("u", 0, "A"), ("u", 1, "C"), ("u", 2, "A"), ("v", 3, "A"), ("w", 4, "A")]
    assert S.detect_sequence(events(spark, rows), compiled).count() == 0


def test_other_key_lists(spark):
    compiled = R.collect_rules(R.rules_frame(spark, [{**RULES["overlapping"], "by": ["appName"]}, {**RULES["overlapping"], "id": "mine"}]))
    rows = [("u", 0, "A"), ("v", 1, "A"), ("v", 2, "A")]
    got = {r.rule_id: r.cnt for r in S.detect_sequence(events(spark, rows), compiled).groupBy("rule_id").agg(F.count("*").alias("cnt")).collect()}
    assert got == {"seq": 1, "mine": 1}


def test_alert_ids_are_stable_and_unique(spark):
    rows = random_rows(200, 5)
    compiled = R.collect_rules(R.rules_frame(spark, [RULES["bounded"]]))
    ids = [sorted(r.alert_id for r in DT.detect(events(spark, rows), compiled).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == len(ids[0]) > 0


def test_hot_key_with_matches_over_many_chunks(spark):
    """One user with nearly all rows and a limit far beyond a chunk: ends come from lookups, alike for every rule."""
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.95 else "x", s, rnd.choices("ABC", (30, 3, 1))[0]) for s in range(600)]
    for i, patterns in enumerate([
        [step(1, "A", min=2)],
        [step(1, "A", min=2), step(2, "B")],
        [step(1, "A", min=1), step(2, "B", min=1), step(3, "A", min=2, max=9)],
        [step(1, "A", min=1), step(2, "B", min=1, max=2), step(3, "A", min=1), step(4, "B")],
    ]):
        compiled = R.collect_rules(R.rules_frame(spark, [rule(within=f"{60 + 90 * i}s", patterns=patterns)]))
        got = S.detect_sequence(events(spark, rows), compiled, chunk=8, per_group=3).collect()
        assert sorted((r.user_id, r.cnt, r.hostname) for r in got) == expected(rows, compiled[0])


def test_as_of_finds_the_last_point_of_its_group(spark):
    rnd = random.Random(4)
    points = [("hot" if rnd.random() < 0.8 else rnd.choice("xy"), rnd.randrange(100), rnd.choice([None, 1, 2])) for _ in range(60)]
    asked = [(i, rnd.choice(["hot", "x", "y", "none", None]), rnd.choice([None, *range(0, 110, 3)])) for i in range(200)]
    got = as_of(
        spark.createDataFrame(asked, "id int, g string, at int"), spark.createDataFrame(points, "g string, at int, v int"),
        "at", {"at": "found", "v": "v"}, group=["g"],
    )
    def best(g, at):
        fit = [(a, v) for k, a, v in points if at is not None and k == g and a <= at]
        return max(fit, key=lambda p: (p[0], -1 if p[1] is None else p[1]), default=(None, None))
    assert sorted((r.id, r.found, r.v) for r in got.collect()) == [(i, *best(g, at)) for i, g, at in asked]

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import behaviour as B
from duskwatch.operators import rules as R
from duskwatch.operators import scoring as S

DAY = "2024-01-30"
VALUE = "user_id string, rule_id string, value double"
COUNT = "user_id string, msg_id string, cnt bigint"
PREV = "user_id string, prev_score double, days_since int"
PROFILE = "user_id string, context string, start_date date, end_date date, note string, whitelisted boolean"
BASE = "scope string, user_id string, msg_id string, mean double, stddev double, sample_days int, updated date"
D = dt.date.fromisoformat
RULES = [{"id": "r", "name": "r", "enabled": True, "weight": 5, "ueba": {"enabled": True}, "match": {"msgId": "M"}}]


def score(spark, counts=(), values=(), prev=(), profiles=(), known=(), user="u", **settings):
    rules = R.collect_rules(R.rules_frame(spark, RULES))
    out = S.daily_risk(
        spark.createDataFrame(list(counts), COUNT), spark.createDataFrame(list(values), VALUE), rules,
        spark.createDataFrame(list(known), BASE), spark.createDataFrame(list(profiles), PROFILE),
        spark.createDataFrame(list(prev), PREV), S.Settings.of(**settings), DAY)
    return {r.user_id: r for r in out.collect()}.get(user)


OWN = ("user", "u", "M", 4.0, 1.0, 7, D(DAY))


def test_golden_rule_score(spark):
    r = score(spark, counts=[("u", "M", 3)], values=[("u", "r", 3.0)], prev=[("u", 50.0, 1)], known=[("user", "u", "M", 4.0, 1.0, 7, D(DAY))])
    assert (r.decayed_prev, r.rule_score, r.anomaly_score, r.risk_score, r.risk_level, r.status) == (45.0, 6.93, 0.0, 51.93, "MEDIUM", "active")
    assert (r.rule_scores, r.event_values, r.event_counts, r.daily_score) == ({"r": 6.93}, {"r": 3.0}, {"M": 3}, 6.93)


def test_golden_anomaly(spark):
    r = score(spark, counts=[("u", "M", 10)], values=[("u", "r", 3.0)], prev=[("u", 50.0, 1)], known=[OWN])
    assert (r.anomaly_score, r.risk_score) == (40.0, 91.93)


@pytest.mark.parametrize("known,points", [
    ([("user", "u", "M", 4.0, 1.0, 6, D(DAY))], 0.0),                                             # too few days
    ([("user", "u", "M", 0.9, 1.0, 7, D(DAY))], 0.0),                                             # mean below one
    ([("user", "u", "M", 9.0, 0.0, 7, D(DAY))], 0.0),                                             # z = 2 at the floored deviation
    ([("user", "u", "M", 8.0, 0.0, 7, D(DAY))], 20.0),                                            # z = 4
    ([("user", "u", "M", 4.0, 1.0, 7, D("2024-01-23"))], 40.0),                                   # seven days old: still valid
    ([("user", "u", "M", 4.0, 1.0, 7, D("2024-01-22")), ("global", None, "M", 6.0, 1.0, 7, D(DAY))], 20.0),  # stale: population
    ([("global", None, "M", 6.0, 1.0, 7, D(DAY))], 20.0),
    ([("user", "v", "M", 4.0, 1.0, 7, D(DAY))], 0.0),                                             # another user's
])
def test_baseline_choice(spark, known, points):
    assert score(spark, counts=[("u", "M", 10)], prev=[("u", 50.0, 1)], known=known).anomaly_score == points


def test_cold_start_beats_the_floor(spark):
    p = [("u", "blacklist", None, None, None, False)]
    r = score(spark, counts=[("u", "M", 3)], values=[("u", "r", 3.0)], profiles=p, floor_enabled=True, floor_default=30.0)
    assert (r.risk_score, r.status, r.rule_score) == (0.0, "cold_start", 6.93)
    r = score(spark, counts=[("u", "M", 3)], values=[("u", "r", 3.0)], profiles=p, floor_enabled=True, floor_default=30.0, prev=[("u", 10.0, 1)])
    assert (r.risk_score, r.status, r.decayed_prev) == (36.93, "no_baseline", 9.0)


def test_whitelisted_users_only_decay(spark):
    r = score(spark, counts=[("u", "M", 10)], values=[("u", "r", 3.0)], prev=[("u", 50.0, 1)], known=[OWN], profiles=[("u", "vip", None, None, None, True)])
    assert (r.risk_score, r.rule_score, r.anomaly_score, r.rule_scores) == (45.0, 0.0, 0.0, {})


def test_users_without_events_are_carried(spark):
    r = score(spark, prev=[("u", 50.0, 2)])
    assert (r.risk_score, r.event_counts, r.rule_scores) == (40.5, {}, {})
    assert score(spark, prev=[("u", 0.0, 1)]) is None


@pytest.mark.parametrize("profile,m", [
    (("u", "departing", None, None), 2.0), (("u", "departing", "2024-01-30", "2024-01-30"), 2.0),
    (("u", "departing", "2024-01-31", None), 1.0), (("u", "departing", None, "2024-01-29"), 1.0),
    (("u", "normal", None, None), 1.0), (("u", "unknown", None, None), 1.0), (("v", "departing", None, None), 1.0),
])
def test_context(spark, profile, m):
    u, c, a, b = profile
    p = [(u, c, a and D(a), b and D(b), None, False)]
    r = score(spark, counts=[("u", "M", 1)], values=[("u", "r", 1.0)], prev=[("u", 1.0, 1)], profiles=p, multipliers={"departing": 2.0}, frequency_function="linear")
    assert r.rule_score == 5.0 * m


@pytest.mark.parametrize("as_of,days,mode,want", [
    ("2024-01-29", 1, "skip", 1), ("2024-01-29", 2, "skip", 1), ("2024-01-29", 3, "skip", 1), ("2024-01-29", 4, "skip", 2),
    ("2024-01-30", 7, "skip", 5), ("2024-01-30", 15, "skip", 11), ("2024-01-30", 15, "", 15), ("2024-01-30", 0, "", 1), ("2024-01-29", 3, "time", 3),
])
def test_effective_days(spark, as_of, days, mode, want):
    row = spark.createDataFrame([(D(as_of), days)], "d date, n int").select(S.effective_days(F.col("n"), F.col("d"), mode)).first()
    assert row[0] == want


def test_levels_are_strict(spark):
    df = spark.createDataFrame([(40.0,), (40.01,), (99.0,), (99.01,)], "s double")
    assert [r[0] for r in df.select(S.classify(F.col("s"), 40, 99)).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_previous_score(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [
        ("a", 5.0, t("2024-01-28T10:00")), ("a", 7.0, t("2024-01-29T14:59:59")), ("a", 99.0, t("2024-01-29T15:00:00")),
        ("b", 5.0, t("2024-01-20T10:00")), ("b", 0.0, t("2024-01-21T10:00")), ("c", 3.0, t("2024-01-27T14:59:59")),
    ]
    scores = spark.createDataFrame(rows, "user_id string, risk_score double, ts timestamp")
    got = {r.user_id: (r.prev_score, r.days_since) for r in S.prev_scores(scores, DAY).collect()}
    # The day starts at 15:00 UTC, one second after the last snapshot of the day before.
    assert got == {"a": (7.0, 1), "b": (0.0, 1), "c": (3.0, 3)}
    noon = dt.datetime(2024, 1, 30, 3, tzinfo=dt.timezone.utc)
    assert {r.user_id: r.days_since for r in S.prev_scores(scores, DAY, noon).collect()} == {"a": 1, "b": 1, "c": 3}


def test_baseline_counts_inner_gaps_as_zero(spark):
    counts = spark.createDataFrame(
        [("u", "M", 4, D("2024-01-24")), ("u", "M", 2, D("2024-01-26")), ("u", "M", 9, D("2024-01-30")), ("u", "M", 9, D("2024-01-22")), ("v", "M", 5, D("2024-01-25"))],
        "user_id string, msg_id string, cnt bigint, day date")
    got = {r.user_id: (r.mean, round(r.stddev, 6), r.sample_days) for r in B.baselines(counts, DAY, 7).collect()}
    assert got == {"u": (2.0, round((8 / 3) ** 0.5, 6), 3), "v": (5.0, 0.0, 1)}
    common = B.global_baselines(B.baselines(counts, DAY, 7)).first()
    assert (common.mean, common.sample_days) == (3.5, 3)


def test_rules_with_one_name_keep_their_own_map_entry(spark):
    docs = [{**RULES[0], "id": "a", "name": "same"}, {**RULES[0], "id": "b", "name": "same"}]
    rules = R.collect_rules(R.rules_frame(spark, docs))
    values = spark.createDataFrame([("u", "a", 1.0), ("u", "b", 1.0)], VALUE)
    out = S.rule_scores(values, rules, spark.createDataFrame([], PROFILE), S.Settings(), DAY).first()
    assert set(out.rule_scores) == {"same (a)", "same (b)"}


def test_expired_profiles(spark):
    p = spark.createDataFrame([("a", "vip", None, D("2024-01-29"), "n", True), ("b", "vip", None, D(DAY), "n", False), ("c", "normal", None, D("2024-01-01"), "n", False)], PROFILE)
    users = spark.createDataFrame([("a",), ("new",), ("new",)], "user_id string")
    got = {r.user_id: (r.context, r.end_date, r.whitelisted) for r in S.refresh_profiles(p, users, DAY).collect()}
    assert got == {"a": ("normal", None, True), "b": ("vip", D(DAY), False), "c": ("normal", D("2024-01-01"), False), "new": ("normal", None, False)}


def test_scoring_uses_the_match_of_a_rule_with_patterns(spark):
    both = {"id": "r", "name": "r", "match": {"msgId": "M"}, "patterns": [{"match": {"msgId": "X"}}, {"match": {"msgId": "Y"}}]}
    only = {"id": "s", "name": "s", "events": [{"msgId": "X"}]}
    none = {"id": "t", "name": "t"}
    rules = R.collect_rules(R.rules_frame(spark, [both, only, none]))
    rows = [(1, dt.datetime(2024, 1, 30), "M", "u", {}), (2, dt.datetime(2024, 1, 30), "X", "u", {})]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, msg_id string, user_id string, ext map<string,string>")
    assert {(r.rule_id, r.value) for r in B.rule_values(events, rules).collect()} == {("r", 1.0), ("s", 1.0)}

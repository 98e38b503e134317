"""Paths put together: raw text to log, log to scores, on input as producers send it."""

import json

from duskwatch import datasets as D
from duskwatch.operators import behaviour, detect
from duskwatch.operators.rules import collect_rules, rules_frame
from duskwatch.operators.scoring import Settings
from duskwatch.operators.sequence import match_ends
from duskwatch.plans.daily import DailyJob
from duskwatch.session import scratch
from duskwatch.sources import stores
from duskwatch.sources.streams import parse_events, to_json_events
from duskwatch.operators.normalize import normalize
from pyspark.sql import functions as F
import numpy as np
import pytest

RAW = [
    {"event_id": 1, "@timestamp": "2024-01-30T03:00:00Z", "msgId": "A", "userId": "own", "cefExtensions": {"suid": "other"}, "severity": 7, "geo": {"cc": "KR"}},
    {"event_id": 2, "@timestamp": "2024-01-30T03:00:00Z", "msgId": "A", "userId": "", "cefExtensions": {"suid": "u2", "severity": "inner"}, "severity": "7"},
    {"event_id": 3, "@timestamp": "2024-01-30T03:00:00Z", "msgId": "A", "cefExtensions": {}},
    {"event_id": 4, "@timestamp": "2024-01-30T03:00:00Z", "userId": "own", "cefExtensions": {}},
]


def logged(spark):
    text = spark.createDataFrame([(json.dumps(r),) for r in RAW], "value string")
    return normalize(parse_events(text), F.current_timestamp())


def test_own_user_and_unknown_fields_are_kept_and_republished(spark):
    got = {r["event_id"]: r for r in logged(spark).collect()}
    assert [got[i]["user_id"] for i in (1, 2, 3, 4)] == ["own", "u2", None, "own"]
    assert got[1]["ext"] == {"suid": "other", "severity": "7", "geo": '{"cc":"KR"}'} and got[2]["ext"]["severity"] == "inner" and got[3]["extra"] is None
    back = {d["event_id"]: d for d in (json.loads(r["value"]) for r in to_json_events(logged(spark)).collect())}
    assert (back[1]["severity"], back[1]["geo"], back[1]["cefExtensions"]) == (7, {"cc": "KR"}, {"suid": "other"})
    assert back[2]["severity"] == "7" and back[2]["cefExtensions"] == {"suid": "u2", "severity": "inner"}


def test_events_without_user_or_type_are_nobodys_behaviour(spark, tmp_path):
    stores.write_event_log(logged(spark), str(tmp_path / "log"), run="0")
    job = DailyJob(str(tmp_path / "log"), str(tmp_path / "base"), str(tmp_path / "scores"), Settings())
    profiles = spark.createDataFrame([], "user_id string, context string, start_date date, end_date date, note string, whitelisted boolean")
    job.run(spark, [], profiles, "2024-01-30")
    assert {r["user_id"] for r in job.scores(spark).collect()} == {"own", "u2"}


def test_many_rules_are_one_scan(spark, small):
    docs = [{"id": f"r{i}", "name": f"r{i}", "severity": "LOW", "cep": {"enabled": True}, "match": {"msgId": "MESSAGE_CLICK", "conditions": [{"field": "k", "op": "eq", "value": str(i % 100)}]}} for i in range(400)]
    rules = collect_rules(rules_frame(spark, docs))
    events = D.events(spark, small)
    found = detect.matches(events, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(rules) == 400 and plan.count("FileScan") == 1
    clicks = events.where("msg_id = 'MESSAGE_CLICK'").count()
    assert found.count() == 4 * clicks


def test_windows_of_days_reach_the_scan(spark, small):
    plan = behaviour.window_counts(D.events(spark, small), D.AS_OF, 7)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


@pytest.mark.parametrize("quantifiers", [[(1, 2), (2, None), (1, 1)], [(1, None)] * 4, [(2, 3), (1, 2), (1, None), (2, 2)]])
def test_matcher_agrees_with_a_search_of_all_splits(quantifiers):
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, within = 14, 9
        mask = rng.integers(0, 1 << len(quantifiers), n) | rng.integers(0, 1 << len(quantifiers), n)
        position = np.cumsum(rng.choice([1, 1, 1, 2], n))
        fresh = np.append(True, rng.random(n - 1) < 0.1)

        def search(step, at, stop):
            low, high = quantifiers[step]
            held = 0
            while at + held < stop and mask[at + held] >> step & 1:
                held += 1
            for size in range(min(held, high or held), low - 1, -1):
                if step == len(quantifiers) - 1:
                    return at + size
                end = search(step + 1, at + size, stop)
                if end > 0:
                    return end
            return -1

        got = match_ends(position, np.arange(n), mask, fresh, quantifiers, within)
        for at in range(n):
            stop = at + 1
            while stop < min(n, at + within) and position[stop] == position[stop - 1] + 1 and not fresh[stop]:
                stop += 1
            assert got[at] == max(search(0, at, stop) - 1, -1) or (got[at] < 0 and search(0, at, stop) < 0)


def test_a_long_rule_list_of_five_steps_is_quick():
    n = 10_000
    ends = match_ends(np.arange(n), np.arange(n) * 1_000_000, np.full(n, 15), np.append(True, np.zeros(n - 1, bool)), [(3, None)] * 5, 3600 * 10**6)
    assert (ends < 0).all()


def test_settings_in_sections(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"anomaly": {"z_threshold": 3}, "decay": {"lambda": 0.8}, "tiers": {"green_max": 10}, "floor_score": {"enabled": True, "default": 30}, "multipliers": {"vip": {"multiplier": 0.5, "name": "VIP"}, "x": 2}}))
    s = Settings.load(spark, str(path))
    assert (s.z_threshold, s.decay, s.green_max, s.floor_enabled, s.floor_default, s.multipliers) == (3, 0.8, 10, True, 30, {"vip": 0.5, "x": 2})
    with pytest.raises(ValueError, match="unknown"):
        Settings.parse({"anomaly": {"zed": 1}})


def test_scratch_tables_are_gone_after_the_block(spark):
    with scratch(spark.range(5), "t") as held:
        assert held.count() == 5
        path = held.inputFiles()[0]
    assert not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_previous_scores_start_a_timeline(spark, small):
    from duskwatch.operators.timeline import risk_timeline

    rules, profiles, settings = collect_rules(rules_frame(spark, D.SCORING_RULES)), D.user_profiles(spark, small), Settings(multipliers={})
    whole = risk_timeline(D.events(spark, small), rules, profiles, settings, "2024-01-28", "2024-01-29")
    user = whole.where("day = '2024-01-28'").first()["user_id"]
    given = spark.createDataFrame([(user, 80.0)], "user_id string, prev_score double")
    moved = risk_timeline(D.events(spark, small), rules, profiles, settings, "2024-01-28", "2024-01-29", previous=given)
    first = {r["user_id"]: r["prev_score"] for r in moved.where("day = '2024-01-28'").collect()}
    assert first[user] == 80.0 and sum(first.values()) == 80.0


def test_users_without_events_are_carried_through_a_timeline(spark, small):
    """A user known by their score alone decays day by day; one with a later first event decays until then; scores of zero carry nobody."""
    from duskwatch.operators.timeline import risk_timeline

    rules, profiles, settings = collect_rules(rules_frame(spark, D.SCORING_RULES)), D.user_profiles(spark, small), Settings(multipliers={}, floor_enabled=False)
    late = D.events(spark, small).where("ts > '2024-01-12'").first()["user_id"]
    events = D.events(spark, small).where((F.col("user_id") != late) | (F.col("ts") > "2024-01-11 15:00:00")).cache()
    run = lambda given=None: {(r.user_id, r.day.isoformat()): r for r in risk_timeline(events, rules, profiles, settings, "2024-01-10", "2024-01-13", previous=given).collect()}
    plain = run()
    got = run(spark.createDataFrame([("absent", 80.0), (late, 50.0), ("zero", 0.0), (None, 9.0)], "user_id string, prev_score double"))
    days = ["2024-01-10", "2024-01-11", "2024-01-12", "2024-01-13"]
    assert [got["absent", d].risk_score for d in days] == [72.0, 64.8, 58.32, 52.49]
    assert (late, "2024-01-10") not in plain and got[late, "2024-01-10"].prev_score == 50.0
    whitelisted = {r.user_id for r in profiles.where("whitelisted").collect()}
    assert got[late, "2024-01-10"].risk_score == 45.0 or late in whitelisted
    assert not any(u in ("zero", None) for u, _ in got) and {k for k in got if k[0] not in ("absent", late)} == {k for k in plain if k[0] != late}

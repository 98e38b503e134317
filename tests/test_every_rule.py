"""Queries over every rule, against the alerts of the queries that SQL checks rule by rule."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry
from duskwatch import datasets as D

PARTS = ("detect_filter", "detect_threshold", "detect_repetition", "detect_all", "detect_any", "detect_sequence", "detect_sequence_repeats", "detect_sequence_open_ended")


@pytest.fixture(scope="module")
def alerts(spark, small):
    return [tuple(r) for name in PARTS for r in entry.queries()[name](spark, small).collect()]


def run(spark, small, name):
    return [tuple(r) for r in entry.queries()[name](spark, small).collect()]


def test_every_rule_raises_its_alerts(spark, small, alerts):
    got = run(spark, small, "detect_every_rule")
    assert Counter(got) == Counter(alerts)
    assert {a[0] for a in got} > {"error_burst", "three_allowed", "allowed_then_blocked", "long_allowed_run"}


def test_counts_of_every_rule(spark, small, alerts):
    tested = {r[0]: r[1:] for r in run(spark, small, "backtest_every_rule")}
    assert set(tested) == {r["id"] for r in D.DETECTION_RULES + D.SEQUENCE_RULES}
    for rule, (n, matched, users) in tested.items():
        mine = [a for a in alerts if a[0] == rule]
        assert (n, matched, users) == (len(mine), sum(a[6] for a in mine), len({a[3] for a in mine} - {None}))
    assert {r[0]: r[1:] for r in run(spark, small, "alert_ids_every_rule")} == {k: (n, n) for k, (n, _, _) in tested.items() if n}


def test_reports_see_every_rule(spark, small, alerts):
    day = lambda a: str((a[7] + timedelta(hours=9)).date())
    newest = sorted((a[7] for a in alerts), reverse=True)[:10]
    recent = run(spark, small, "dashboard_recent_every_rule")
    assert [r[2] for r in recent] == newest and all(isinstance(r[2], datetime) for r in recent)
    assert set(recent) <= {(a[0], a[3], a[7]) for a in alerts}
    assert run(spark, small, "alert_report_total_every_rule") == [(sum("2024-01-01" <= day(a) <= D.AS_OF for a in alerts),)]
    found = [a for a in alerts if "2024-01-24" <= day(a) <= D.AS_OF and a[2] == "MEDIUM" and any("1" in (t or "").lower() for t in (a[3], a[1], a[4]))]
    rows = run(spark, small, "alert_report_every_rule")
    assert [r[4] for r in rows] == sorted((a[7] for a in found), reverse=True)[:20]
    mine = [(a[0], a[7]) for a in alerts if a[3] == "116" and day(a) == D.AS_OF]
    assert Counter(run(spark, small, "user_detail_alerts_every_rule")) == Counter(mine)

"""Aggregates over behaviour, and field discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch import datasets as D
from duskwatch.operators import behaviour as B
from duskwatch.operators import catalog, reports
from duskwatch.session import stage

from . import EV, SNAP, query, with_
from .detection import compiled

#: Rule values of every user and day, as the scoring rules define them.
VALUES = """
vals AS (
  SELECT user_id, 'blocked_errors' AS rule_id, day, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE act = 'error' AND outcome = 'blocked' GROUP BY ALL
  UNION ALL SELECT user_id, 'purchase_volume', day, sum(fsize) FROM ev WHERE act = 'purchase' GROUP BY ALL
  UNION ALL SELECT user_id, 'click_spread', day, CAST(count(DISTINCT k) AS DOUBLE) FROM ev WHERE act = 'click' GROUP BY ALL
  UNION ALL SELECT user_id, 'odd_views', day, CAST(count(*) AS DOUBLE) FROM ev WHERE act = 'view' AND (hour(lts) >= 22 OR hour(lts) < 6 OR k IN (1, 7, 42)) GROUP BY ALL)
"""
CNT = "cnt AS (SELECT user_id, msg_id, day, count(*) AS c FROM ev GROUP BY ALL)"


def moments(first: str, last: str) -> str:
    """Baselines from densified days: an independent form of the closed formula."""
    return f"""
win AS (SELECT * FROM cnt WHERE day >= DATE '{first}' AND day <= DATE '{last}'),
dense AS (SELECT user_id, msg_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM win GROUP BY user_id, msg_id),
base AS (SELECT s.user_id, s.msg_id, avg(coalesce(x.c, 0)) AS mean, stddev_pop(coalesce(x.c, 0)) AS stddev, CAST(count(*) AS INTEGER) AS sample_days
         FROM dense s LEFT JOIN win x ON x.user_id = s.user_id AND x.msg_id = s.msg_id AND x.day = s.day GROUP BY s.user_id, s.msg_id),
world AS (SELECT msg_id, avg(mean) AS mean, avg(stddev) AS stddev, max(sample_days) AS sample_days FROM base GROUP BY msg_id)
"""


WEEK = moments("2024-01-23", "2024-01-29")


def r6(name: str):
    return (F.round(F.col(name) * 1e6) / 1e6).alias(name)


@query("rule_values", with_(EV, VALUES) + "SELECT user_id, rule_id, strftime(day, '%Y-%m-%d') AS day, round(value * 100) / 100 AS value FROM vals")
def rule_values(spark, d):
    out = B.rule_values(D.events(spark, d), compiled(spark, D.SCORING_RULES))
    return out.select("user_id", "rule_id", "day", (F.round(F.col("value") * 100) / 100).alias("value"))


@query("distinct_over_days", with_(EV) + """
SELECT user_id, CAST(count(DISTINCT k) AS DOUBLE) AS value, CAST(count(DISTINCT day) AS BIGINT) AS days FROM ev WHERE act = 'click' GROUP BY user_id""")
def distinct_over_days(spark, d):
    """Distinct values over all days from the sketches of each day; below a few hundred values a sketch is exact."""
    daily = stage(B.sketches(D.events(spark, d), compiled(spark, [r for r in D.SCORING_RULES if r["id"] == "click_spread"])), "sketches")
    days = daily.groupBy("user_id").agg(F.count("*").alias("days"))
    return B.sketched_values(B.merged_sketches(daily, "user_id", "kind")).join(days, "user_id").select("user_id", "value", "days")


@query("event_counts", with_(EV) + "SELECT user_id, msg_id, strftime(day, '%Y-%m-%d') AS day, count(*) AS cnt FROM ev GROUP BY ALL")
def event_counts(spark, d):
    return B.event_counts(D.events(spark, d))


@query("user_baselines", with_(EV, CNT, WEEK) + """
SELECT user_id, msg_id, round(mean * 1e6) / 1e6 AS mean, round(stddev * 1e6) / 1e6 AS stddev, sample_days, '2024-01-30' AS updated FROM base""")
def user_baselines(spark, d):
    out = B.baselines(B.window_counts(D.events(spark, d), D.AS_OF, 7), D.AS_OF, 7)
    return out.select("user_id", "msg_id", r6("mean"), r6("stddev"), "sample_days", "updated")


@query("user_baselines_full_window", with_(EV, CNT) + """
SELECT user_id, msg_id, round(sum(c) / 7 * 1e6) / 1e6 AS mean, round(sqrt(greatest(sum(c * c) / 7 - (sum(c) / 7) * (sum(c) / 7), 0)) * 1e6) / 1e6 AS stddev
FROM cnt WHERE day >= DATE '2024-01-23' AND day <= DATE '2024-01-29' GROUP BY user_id, msg_id""")
def user_baselines_full_window(spark, d):
    out = B.baselines(B.window_counts(D.events(spark, d), D.AS_OF, 7), D.AS_OF, 7, full_window=True)
    return out.select("user_id", "msg_id", r6("mean"), r6("stddev"))


@query("global_baselines", with_(EV, CNT, WEEK) + """
SELECT msg_id, round(mean * 1e6) / 1e6 AS mean, round(stddev * 1e6) / 1e6 AS stddev, sample_days FROM world""")
def global_baselines(spark, d):
    users = B.baselines(B.window_counts(D.events(spark, d), D.AS_OF, 7), D.AS_OF, 7)
    return B.global_baselines(users).select("msg_id", r6("mean"), r6("stddev"), "sample_days")


@query("top_terms", with_(EV) + "SELECT hostname, count(*) AS cnt FROM ev GROUP BY hostname ORDER BY cnt DESC, hostname LIMIT 6")
def top_terms(spark, d):
    return reports.top_terms(D.events(spark, d), "hostname", 6)


@query("date_histogram_day", with_(EV) + "SELECT CAST(day AS TIMESTAMP) AS bucket, count(*) AS cnt FROM ev GROUP BY ALL")
def date_histogram_day(spark, d):
    return reports.date_histogram(D.events(spark, d), "day")


@query("date_histogram_hour_filled", with_(EV) + """
SELECT g.b AS bucket, count(ev.event_id) AS cnt FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS b) g
LEFT JOIN ev ON date_trunc('hour', ev.lts) = g.b GROUP BY g.b""")
def date_histogram_hour_filled(spark, d):
    return reports.date_histogram(D.events(spark, d), "hour", D.AS_OF)


@query("user_hourly_activity", with_(EV) + """
SELECT user_id, CAST(hour(lts) AS INTEGER) AS hour, count(*) AS cnt FROM ev WHERE day = DATE '2024-01-30' GROUP BY ALL""")
def user_hourly_activity(spark, d):
    return reports.user_hourly(D.events(spark, d), D.AS_OF)


@query("score_history_daily", with_(EV, SNAP) + """
SELECT u.user_id, strftime(u.day, '%Y-%m-%d') AS day, coalesce(max(s.risk_score), 0) AS score
FROM (SELECT user_id, unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY)) AS day
      FROM (SELECT DISTINCT user_id FROM snap WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30')) u
LEFT JOIN snap s ON s.user_id = u.user_id AND s.day = u.day GROUP BY u.user_id, u.day""")
def score_history_daily(spark, d):
    return reports.score_history(D.snapshots(spark, d), D.AS_OF)["daily"]


@query("score_history_hourly", with_(EV, SNAP) + """
SELECT user_id, hour, max(rule_score) AS rule_score, max(anomaly_score) AS anomaly_score, max(decayed_prev) AS decay_score
FROM snap WHERE day = DATE '2024-01-30' GROUP BY ALL""")
def score_history_hourly(spark, d):
    return reports.score_history(D.snapshots(spark, d), D.AS_OF)["hourly"]


@query("population_stats", with_(EV, CNT, WEEK) + """
SELECT (SELECT count(DISTINCT user_id) FROM cnt WHERE day = DATE '2024-01-30') AS users,
       (SELECT count(*) FROM base) + (SELECT count(*) FROM world) AS baselines, CAST(4 AS BIGINT) AS rules,
       (SELECT CAST(sum(c) AS BIGINT) FROM cnt WHERE day = DATE '2024-01-30') AS events""")
def population_stats(spark, d):
    from duskwatch.operators.rules import active_rules, rules_frame

    counts = B.event_counts(D.events(spark, d), first="2024-01-23", last=D.AS_OF)
    active = active_rules(rules_frame(spark, D.SCORING_RULES), "ueba")
    return reports.stats(counts.where(F.col("day") == D.AS_OF), B.all_baselines(counts, D.AS_OF, 7), active)


@query("level_counts", with_(EV, SNAP) + """
SELECT CAST(0 AS BIGINT) AS critical, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium,
       count(*) FILTER (risk_level = 'LOW') AS low FROM snap""")
def level_counts(spark, d):
    return reports.level_counts(D.snapshots(spark, d))


@query("field_catalog", with_(EV) + """
SELECT msg_id, count(*) AS sample_count,
       CASE WHEN msg_id = 'MESSAGE_ERROR' THEN 'SizeClass,act,cn1,fsize,k,outcome,shost,src,suid,suser'
            ELSE 'KeyDecade,SizeClass,act,fsize,k,outcome,shost,src,suid,suser' END AS fields
FROM ev WHERE day BETWEEN DATE '2024-01-23' AND DATE '2024-01-30' GROUP BY msg_id""")
def field_catalog(spark, d):
    out = catalog.field_catalog(D.raw_events(spark, d), D.AS_OF)
    return out.select("msg_id", "sample_count", F.array_join("fields", ",").alias("fields"))


@query("field_values", with_(EV) + """
SELECT size_class AS value, 2 * count(*) AS cnt FROM ev WHERE act = 'click' GROUP BY ALL""")
def field_values(spark, d):
    from duskwatch.operators.normalize import expand_labels

    # Stored events hold the value under its label and under the raw key; both are counted.
    return catalog.field_values(expand_labels(D.raw_events(spark, d)), "MESSAGE_CLICK", "SizeClass")


@query("field_values_direct", with_(EV) + """
SELECT CAST(k AS VARCHAR) AS value, count(*) AS cnt FROM ev WHERE act = 'view' GROUP BY ALL ORDER BY cnt DESC, value LIMIT 100""")
def field_values_direct(spark, d):
    return catalog.field_values(D.raw_events(spark, d), "MESSAGE_VIEW", "k")

"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch import datasets as D
from duskwatch.operators import reports as R
from duskwatch.operators.normalize import alert_report_columns
from duskwatch.schema import ALERT_DDL
from duskwatch.sources.stores import latest_per_key

from . import EV, PROFILES, SNAP, query, with_
from .detection import ALERTS, EVERY, every_alert
from .scoring import DAY, SETTINGS, effective, factor

LATEST = "latest AS (SELECT user_id, arg_max(risk_score, ts) AS risk_score, arg_max(risk_level, ts) AS risk_level, arg_max(prev_score, ts) AS prev_score, arg_max(status, ts) AS status, max(ts) AS ts FROM snap GROUP BY user_id)"


@query("latest_per_key", with_(EV, SNAP, LATEST) + "SELECT * FROM latest")
def latest(spark, d):
    slim = D.snapshots(spark, d).select("user_id", "risk_score", "risk_level", "prev_score", "status", "ts")
    return latest_per_key(slim, ["user_id"], "ts")


@query("event_page", with_(EV) + "SELECT event_id, ts, user_id FROM ev ORDER BY fsize DESC, event_id LIMIT 25 OFFSET 50")
def event_page(spark, d):
    e = D.events(spark, d).select("event_id", "ts", "user_id", F.col("ext")["fsize"].cast("double").alias("fsize"))
    return R.page(e, "fsize", True, 50, 25).rows.drop("fsize")


@query("event_page_total", with_(EV) + "SELECT count(*) AS total FROM ev")
def event_page_total(spark, d):
    return R.page(D.events(spark, d), "ts").total


_FOUND = with_(*EVERY, ALERTS) + f"""
SELECT rule_id, severity, user_id, hostname, ts FROM al WHERE day BETWEEN {DAY} - 6 AND {DAY}
  AND (contains(user_id, '1') OR contains(lower(rule_name), '1') OR contains(hostname, '1')) AND severity = 'MEDIUM' ORDER BY ts DESC, alert_id LIMIT 20"""


# Queries of two names: the second is from when the first saw part of the rules.
@query("alert_report", _FOUND)
@query("alert_report_every_rule", _FOUND)
def alert_report(spark, d):
    rows = R.alert_report(every_alert(spark, d), "2024-01-24", D.AS_OF, search="1", severity="MEDIUM", length=20).rows
    return alert_report_columns(rows).select("rule_id", "severity", "user_id", "hostname", "ts")


@query("alert_report_total", with_(*EVERY, ALERTS) + "SELECT count(*) AS total FROM al WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' AND rule_id = 'long_allowed_run'")
def alert_report_total(spark, d):
    return R.alert_report(every_alert(spark, d), "2024-01-01", D.AS_OF, rule="long_allowed_run").total


@query("alert_report_total_every_rule", with_(*EVERY, ALERTS) + "SELECT count(*) AS total FROM al WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'")
def alert_report_total_every_rule(spark, d):
    return R.alert_report(every_alert(spark, d), "2024-01-01", D.AS_OF).total


@query("log_report", with_(EV) + f"""
SELECT event_id, ts, upper(act) AS type, user_id, hostname, user_ip, act AS action, outcome FROM ev
WHERE day = {DAY} AND (contains(lower(msg_id), 'host-1') OR contains(user_id, 'host-1') OR contains(hostname, 'host-1')) AND outcome = 'blocked' ORDER BY ts DESC, event_id LIMIT 15""")
def log_report(spark, d):
    return R.log_report(D.events(spark, d), D.AS_OF, search="HOST-1", outcome="blocked").rows


@query("user_report", with_(EV, SNAP, LATEST) + """
SELECT user_id, risk_score, risk_level, prev_score, status, ts, risk_score - prev_score AS score_diff FROM latest
WHERE contains(user_id, '1') ORDER BY risk_score DESC, user_id LIMIT 10 OFFSET 5""")
def user_report(spark, d):
    return R.user_report(D.snapshots(spark, d), search="1", start=5).rows


@query("user_list", with_(EV, SNAP, PROFILES, LATEST) + f"""
SELECT l.user_id, l.risk_score, l.risk_level, l.prev_score, s.rule_score, l.status, l.risk_score - l.prev_score AS score_diff,
       CASE WHEN p.user_id IS NULL THEN '' ELSE coalesce(ec, 'normal') END AS context, CASE WHEN p.user_id IS NULL THEN 1.0 ELSE {factor('ec')} END AS multiplier
FROM (SELECT user_id, arg_max(risk_score, ts) AS risk_score, arg_max(risk_level, ts) AS risk_level, arg_max(prev_score, ts) AS prev_score, arg_max(status, ts) AS status
      FROM snap WHERE day <= {DAY} AND contains(user_id, '1') GROUP BY user_id ORDER BY risk_score DESC, user_id LIMIT 20 OFFSET 3) l
JOIN (SELECT user_id, arg_max(rule_score, ts) AS rule_score FROM snap WHERE day <= {DAY} GROUP BY user_id) s USING (user_id)
LEFT JOIN (SELECT *, {effective(DAY)} AS ec FROM prof) p ON p.user_id = l.user_id""")
def user_list(spark, d):
    rows = R.user_list(D.snapshots(spark, d), D.user_profiles(spark, d), SETTINGS, D.AS_OF, search="1", start=3, length=20).rows
    return rows.drop("ts")


@query("user_report_level", with_(EV, SNAP, LATEST) + "SELECT user_id, risk_level FROM latest WHERE risk_level = 'HIGH' ORDER BY user_id LIMIT 1000")
def user_report_level(spark, d):
    rows = R.user_report(D.snapshots(spark, d), level="HIGH", order="user_id", descending=False, length=1000).rows
    return rows.select("user_id", "risk_level")


def _detail(spark, d):
    snaps = D.snapshots(spark, d).withColumn("event_values", F.create_map(
        F.lit("rule"), F.col("rule_score"), F.lit("anomaly"), F.col("anomaly_score"), F.lit("none"), F.lit(0.0)))
    return R.user_detail(D.events(spark, d), every_alert(spark, d), snaps, "116", D.AS_OF)


@query("user_detail_logs", with_(EV) + f"SELECT event_id, ts, msg_id FROM ev WHERE user_id = '116' AND day = {DAY} ORDER BY ts DESC, event_id LIMIT 50")
def user_detail_logs(spark, d):
    return _detail(spark, d)["logs"].select("event_id", "ts", "msg_id")


_NEWEST = with_(*EVERY, ALERTS) + f"SELECT rule_id, ts FROM al WHERE user_id = '116' AND day = {DAY} ORDER BY ts DESC, alert_id LIMIT 50"


@query("user_detail_alerts", _NEWEST)
@query("user_detail_alerts_every_rule", _NEWEST)
def user_detail_alerts(spark, d):
    return _detail(spark, d)["alerts"].select("rule_id", "ts")


@query("user_detail_values", with_(EV, SNAP) + """
, one AS (SELECT * FROM snap WHERE user_id = '116' ORDER BY ts DESC LIMIT 1)
SELECT name, value FROM (SELECT 'rule' AS name, rule_score AS value FROM one UNION ALL SELECT 'anomaly', anomaly_score FROM one) WHERE value > 0""")
def user_detail_values(spark, d):
    return _detail(spark, d)["values"]


def _dashboard(spark, d, part):
    return R.dashboard(D.events(spark, d), every_alert(spark, d) if part in ("severities", "rules", "recent") else _no_alerts(spark), D.snapshots(spark, d), D.AS_OF)[part]


def _no_alerts(spark):
    """Parts without alerts need no detection."""
    return spark.createDataFrame([], ALERT_DDL)


@query("dashboard_severities", with_(*EVERY, ALERTS) + f"SELECT severity, count(*) AS cnt FROM al WHERE day = {DAY} GROUP BY severity")
def dashboard_severities(spark, d):
    return _dashboard(spark, d, "severities")


@query("dashboard_rules", with_(*EVERY, ALERTS) + f"SELECT rule_name, count(*) AS cnt FROM al WHERE day = {DAY} GROUP BY rule_name ORDER BY cnt DESC, rule_name LIMIT 10")
def dashboard_rules(spark, d):
    return _dashboard(spark, d, "rules")


@query("dashboard_levels", with_(EV, SNAP, LATEST) + """
SELECT CAST(0 AS BIGINT) AS critical, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low FROM latest""")
def dashboard_levels(spark, d):
    return _dashboard(spark, d, "levels")


@query("dashboard_users", with_(EV, SNAP, LATEST) + """
SELECT user_id, risk_score, risk_level, prev_score, risk_score - prev_score AS score_diff FROM latest ORDER BY risk_score DESC, score_diff DESC, user_id LIMIT 10""")
def dashboard_users(spark, d):
    return _dashboard(spark, d, "users").select("user_id", "risk_score", "risk_level", "prev_score", "score_diff")


@query("dashboard_types", with_(EV) + f"SELECT msg_id, count(*) AS cnt FROM ev WHERE day = {DAY} GROUP BY msg_id ORDER BY cnt DESC, msg_id LIMIT 20")
def dashboard_types(spark, d):
    return _dashboard(spark, d, "types")


@query("dashboard_total", with_(EV) + f"SELECT count(*) AS total FROM ev WHERE day = {DAY}")
def dashboard_total(spark, d):
    return _dashboard(spark, d, "total")


_RECENT = with_(*EVERY, ALERTS) + "SELECT rule_id, user_id, ts FROM al ORDER BY ts DESC, alert_id LIMIT 10"


@query("dashboard_recent", _RECENT)
@query("dashboard_recent_every_rule", _RECENT)
def dashboard_recent(spark, d):
    return _dashboard(spark, d, "recent").select("rule_id", "user_id", "ts")


@query("type_totals", with_(EV) + f"SELECT upper(act) AS type, count(*) AS cnt FROM ev WHERE day = {DAY} GROUP BY act ORDER BY cnt DESC, type LIMIT 6")
def type_totals(spark, d):
    return R.type_totals(D.events(spark, d), D.AS_OF, 6)


@query("profile_report", with_(EV, PROFILES) + f"""
SELECT user_id, context, ec AS effective_context, {factor('ec')} AS multiplier, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, note, whitelisted
FROM (SELECT *, {effective(DAY)} AS ec FROM prof)""")
def profile_report(spark, d):
    return R.profile_report(D.user_profiles(spark, d), SETTINGS, D.AS_OF)

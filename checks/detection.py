"""Rule detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch import datasets as D
from duskwatch.operators import detect as DT
from duskwatch.operators import ruleindex as X
from duskwatch.operators import rules as R
from duskwatch.operators import sequence as SQ

from . import EV, query, with_

SHOWN = ("rule_id", "rule_name", "severity", "user_id", "hostname", "user_ip", "cnt", "ts")


def compiled(spark, docs, *ids):
    return R.collect_rules(R.rules_frame(spark, [x for x in docs if not ids or x["id"] in ids]))


def _alert(rule: str, name: str, severity: str, user: str = "user_id", origin: str = "event_id") -> str:
    return f"SELECT '{rule}' AS rule_id, '{name}' AS rule_name, '{severity}' AS severity, {user} AS user_id, hostname, user_ip, CAST({origin} AS VARCHAR) AS origin"


def _bucket(hours: int) -> str:
    return f"time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '1970-01-01')"


def _windowed(rule: str, name: str, severity: str, hours: int, where: str, having: str, user: str = "user_id") -> str:
    start = _bucket(hours)
    head = _alert(rule, name, severity, user, f"CAST(epoch({start}) AS BIGINT) || '|'")
    keys = "hostname, user_ip" if user != "user_id" else "user_id, hostname, user_ip"
    return head + f", count(*) AS cnt, {start} + INTERVAL {hours} HOUR AS ts FROM ev WHERE {where} GROUP BY {keys}, {start} HAVING {having}"


def shown(alerts: str) -> str:
    """The columns of an alert that queries show, of SQL that also has the origin its id is made of."""
    return f"SELECT {', '.join(SHOWN)} FROM ({alerts})"


SINGLE = (
    _alert("blocked_error", "Blocked error", "HIGH")
    + ", CAST(1 AS BIGINT) AS cnt, ts FROM ev WHERE act = 'error' AND outcome = 'blocked' AND fsize >= 60 UNION ALL "
    + _alert("odd_purchase", "Odd purchase", "LOW")
    + ", CAST(1 AS BIGINT), ts FROM ev WHERE act = 'purchase' AND (k < 5 OR fsize > 200)"
)
BURST = _windowed("error_burst", "Error burst", "CRITICAL", 6, "act = 'error'", "count(*) >= 2")
HOSTS = _windowed("host_signups", "Signups on one host", "MEDIUM", 24, "act = 'signup'", "count(*) >= 2", "CAST(NULL AS VARCHAR)")
REPEAT = _windowed("repeat_click", "Repeated click", "LOW", 12, "act = 'click'", "count(*) >= 2")
BOTH = _windowed("error_and_purchase", "Error and purchase together", "MEDIUM", 12, "act IN ('error', 'purchase')", "bool_or(act = 'error') AND bool_or(act = 'purchase')")
EITHER = _alert("odd_signup_or_view", "Odd signup or view", "MEDIUM") + ", CAST(1 AS BIGINT) AS cnt, ts FROM ev WHERE (act = 'signup' AND k < 10) OR (act = 'view' AND (hour(lts) >= 22 OR hour(lts) < 2))"
UNORDERED = " UNION ALL ".join([SINGLE, BURST, HOSTS, REPEAT, BOTH, EITHER])

_ROWS = "ord AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev)"
_PAIR = """
pair AS (SELECT a.user_id, b.hostname, b.user_ip, b.ts, b.event_id FROM ord a JOIN ord b ON a.user_id = b.user_id AND b.rn = a.rn + 1
         WHERE a.act = 'error' AND b.act = 'purchase' AND b.ts - a.ts < INTERVAL 24 HOUR)
"""
# Candidates of three allowed rows, then the leftmost ones that do not overlap, one step per recursion.
_TRIPLE = """
cand AS (SELECT a.user_id, a.rn, c.hostname, c.user_ip, c.ts, c.event_id FROM ord a
         JOIN ord b ON a.user_id = b.user_id AND b.rn = a.rn + 1 JOIN ord c ON a.user_id = c.user_id AND c.rn = a.rn + 2
         WHERE a.outcome = 'allowed' AND b.outcome = 'allowed' AND c.outcome = 'allowed' AND c.ts - a.ts < INTERVAL 48 HOUR),
pick AS (SELECT user_id, min(rn) AS rn FROM cand GROUP BY user_id
         UNION ALL
         SELECT p.user_id, (SELECT min(c.rn) FROM cand c WHERE c.user_id = p.user_id AND c.rn >= p.rn + 3) FROM pick p WHERE p.rn IS NOT NULL)
"""
_PAIR_ALERTS = _alert("error_then_purchase", "Error then purchase", "HIGH") + ", CAST(2 AS BIGINT) AS cnt, ts FROM pair"
_TRIPLE_ALERTS = _alert("three_allowed", "Three allowed in a row", "MEDIUM", "cand.user_id") + ", CAST(3 AS BIGINT) AS cnt, ts FROM cand JOIN pick ON cand.user_id = pick.user_id AND cand.rn = pick.rn"
# Allowed and blocked exclude each other, so a match ends at the next blocked row and the earliest start that fits wins.
_RUN = """
stop AS (SELECT *, min(CASE WHEN outcome = 'blocked' THEN rn END) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb FROM ord),
run AS (SELECT a.user_id, a.nb, min(a.rn) AS rn FROM stop a JOIN ord b ON a.user_id = b.user_id AND b.rn = a.nb
        WHERE a.outcome = 'allowed' AND a.nb - a.rn BETWEEN 2 AND 4 AND b.ts - a.ts < INTERVAL 96 HOUR GROUP BY a.user_id, a.nb)
"""
_RUN_ALERTS = _alert("allowed_then_blocked", "Two to four allowed, then blocked", "LOW", "run.user_id") + ", CAST(run.nb - run.rn + 1 AS BIGINT) AS cnt, ord.ts FROM run JOIN ord ON ord.user_id = run.user_id AND ord.rn = run.nb"
# A run of allowed rows may hold errors itself, so a match from a row ends at the last error in reach whose rows before it are all allowed.
_OPEN = """
until AS (SELECT *, min(CASE WHEN outcome = 'blocked' THEN rn END) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb FROM ord),
open_run AS (SELECT a.user_id, a.rn, max(b.rn) AS last FROM until a JOIN ord b ON a.user_id = b.user_id AND b.act = 'error' AND b.rn >= a.rn + 3
             AND b.ts - a.ts < INTERVAL 72 HOUR AND (a.nb IS NULL OR b.rn <= a.nb) GROUP BY a.user_id, a.rn),
following AS (SELECT a.user_id, a.rn, a.last, min(b.rn) AS nxt FROM open_run a LEFT JOIN open_run b ON a.user_id = b.user_id AND b.rn > a.last GROUP BY a.user_id, a.rn, a.last),
chain AS (SELECT user_id, min(rn) AS rn FROM following GROUP BY user_id
          UNION ALL SELECT c.user_id, f.nxt FROM chain c JOIN following f ON c.user_id = f.user_id AND c.rn = f.rn WHERE f.nxt IS NOT NULL)
"""
_OPEN_ALERTS = _alert("long_allowed_run", "Three or more allowed, then an error", "MEDIUM", "f.user_id", "ord.event_id") + """, CAST(f.last - f.rn + 1 AS BIGINT) AS cnt, ord.ts
FROM chain c JOIN following f ON c.user_id = f.user_id AND c.rn = f.rn JOIN ord ON ord.user_id = f.user_id AND ord.rn = f.last"""

#: All alerts of all rules, as a named table with the id of each.
EVERY = [EV, _ROWS, _PAIR, _TRIPLE, _RUN, _OPEN]
EVERY_ALERTS = " UNION ALL ".join([UNORDERED, _PAIR_ALERTS, _TRIPLE_ALERTS, _RUN_ALERTS, _OPEN_ALERTS])
_ID = ", ".join(f"coalesce('=' || {c}, '-')" for c in ("rule_id", "user_id", "hostname", "user_ip", "origin"))
ALERTS = f"al AS (SELECT *, md5(concat_ws('|', {_ID})) AS alert_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM ({EVERY_ALERTS}))"
_COUNTS = f"SELECT rule_id, count(*) AS alerts, CAST(sum(cnt) AS BIGINT) AS matched, count(DISTINCT user_id) AS users FROM ({EVERY_ALERTS}) GROUP BY rule_id"
_IDS = "SELECT rule_id, count(*) AS alerts, count(DISTINCT alert_id) AS ids FROM al GROUP BY rule_id"


@query("detect_filter", with_(EV) + shown(SINGLE))
def detect_filter(spark, d):
    return DT.detect_filter(D.events(spark, d), compiled(spark, D.DETECTION_RULES)).select(*SHOWN)


@query("detect_threshold", with_(EV) + shown(BURST + " UNION ALL " + HOSTS))
def detect_threshold(spark, d):
    return DT.detect_threshold(D.events(spark, d), compiled(spark, D.DETECTION_RULES, "error_burst", "host_signups")).select(*SHOWN)


@query("detect_repetition", with_(EV) + shown(REPEAT))
def detect_repetition(spark, d):
    return DT.detect_threshold(D.events(spark, d), compiled(spark, D.DETECTION_RULES, "repeat_click")).select(*SHOWN)


@query("detect_all", with_(EV) + shown(BOTH))
def detect_all(spark, d):
    return DT.detect_all(D.events(spark, d), compiled(spark, D.DETECTION_RULES)).select(*SHOWN)


@query("detect_any", with_(EV) + shown(EITHER))
def detect_any(spark, d):
    return DT.detect_any(D.events(spark, d), compiled(spark, D.DETECTION_RULES)).select(*SHOWN)


def _sequence(spark, d, *ids):
    rules = compiled(spark, D.SEQUENCE_RULES, *ids)
    return DT.to_alerts(SQ.detect_sequence(D.events(spark, d), rules), rules).select(*SHOWN)


@query("detect_sequence", with_(EV, _ROWS, _PAIR, _TRIPLE) + shown(_PAIR_ALERTS + " UNION ALL " + _TRIPLE_ALERTS))
def detect_sequence(spark, d):
    return _sequence(spark, d, "error_then_purchase", "three_allowed")


@query("detect_sequence_repeats", with_(EV, _ROWS, _RUN) + shown(_RUN_ALERTS))
def detect_sequence_repeats(spark, d):
    return _sequence(spark, d, "allowed_then_blocked")


@query("detect_sequence_open_ended", with_(EV, _ROWS, _OPEN) + shown(_OPEN_ALERTS))
def detect_sequence_open_ended(spark, d):
    return _sequence(spark, d, "long_allowed_run")


def every_alert(spark, d):
    """Alerts of all rules, the ordered ones too."""
    return DT.detect(D.events(spark, d), compiled(spark, D.DETECTION_RULES + D.SEQUENCE_RULES))


# Queries of two names: the second is from when the first saw part of the rules.
@query("detect_all_rules", with_(*EVERY) + shown(EVERY_ALERTS))
@query("detect_every_rule", with_(*EVERY) + shown(EVERY_ALERTS))
def detect_every_rule(spark, d):
    return every_alert(spark, d).select(*SHOWN)


@query("backtest_rules", with_(*EVERY) + _COUNTS)
@query("backtest_every_rule", with_(*EVERY) + _COUNTS)
def backtest_every_rule(spark, d):
    return DT.backtest(D.events(spark, d), compiled(spark, D.DETECTION_RULES + D.SEQUENCE_RULES))


@query("alert_ids", with_(*EVERY, ALERTS) + _IDS)
@query("alert_ids_every_rule", with_(*EVERY, ALERTS) + _IDS)
def alert_ids_every_rule(spark, d):
    return every_alert(spark, d).groupBy("rule_id").agg(F.count("*").alias("alerts"), F.count_distinct("alert_id").alias("ids"))


@query("detect_indexed_rules", with_(EV) + shown(UNORDERED))
def detect_indexed_rules(spark, d):
    """All rules without order, looked up in an index instead of compiled into the plan."""
    return X.detect(D.events(spark, d), R.rules_frame(spark, D.DETECTION_RULES)).select(*SHOWN)


# A rule for every user and type, and one for every host: the list grows with the table.
OWN = """
SELECT user_id || ' ' || msg_id AS rule_id, 'Own limit of ' || user_id AS rule_name, 'MEDIUM' AS severity, user_id, hostname, user_ip, CAST(1 AS BIGINT) AS cnt, ts
FROM ev WHERE fsize >= 50 + uid % 50
UNION ALL
SELECT hostname || ' burst', 'Burst on ' || hostname, 'HIGH', CAST(NULL AS VARCHAR), hostname, user_ip, count(*), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR
FROM ev WHERE act <> 'view' GROUP BY hostname, user_ip, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') HAVING count(*) >= 2
"""


@query("detect_many_rules", with_(EV) + OWN)
def detect_many_rules(spark, d):
    return X.detect(D.events(spark, d), D.own_rules(spark, d)).select(*SHOWN)

"""Scoring operators. The daily score and the timeline are checked against SQL that densifies and recurses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from duskwatch import datasets as D
from duskwatch.functions.fields import local_day
from duskwatch.operators import behaviour as B
from duskwatch.operators import scoring as S
from duskwatch.operators.timeline import risk_timeline
from duskwatch.session import stage_path
from duskwatch.sources.newest import NewestScores
from duskwatch.sources.stores import write_partitions

from . import EV, PROFILES, SNAP, query, with_
from .behaviour import CNT, VALUES, WEEK, r6
from .detection import compiled

SETTINGS = S.Settings.of(**D.SETTINGS)
DAY = "DATE '2024-01-30'"


def effective(day: str) -> str:
    return f"CASE WHEN start_date > {day} OR end_date < {day} THEN 'normal' ELSE coalesce(context, 'normal') END"


def factor(context: str) -> str:
    return f"CAST(CASE {context} WHEN 'departing' THEN 1.75 WHEN 'vacation' THEN 1.25 WHEN 'blacklist' THEN 2.5 WHEN 'vip' THEN 0.4 ELSE 1.0 END AS DOUBLE)"


CTX = f"ctx AS (SELECT user_id, ec, {factor('ec')} AS m, whitelisted FROM (SELECT *, {effective(DAY)} AS ec FROM prof))"
WEIGHTED = """
pts AS (SELECT user_id, day, rule_id, CASE rule_id WHEN 'blocked_errors' THEN 5.0 WHEN 'purchase_volume' THEN 0.5 WHEN 'click_spread' THEN 3.0 ELSE 4.0 END * ln(1 + value) AS p
        FROM vals WHERE value > 0)
"""
ANOM = """CASE WHEN sample_days >= 3 AND mean >= 1 AND (c - mean) / greatest(stddev, 0.5) > 1.0 THEN 10 * ((c - mean) / greatest(stddev, 0.5) - 1.0) ELSE 0 END"""
LOOKED = f"""
look AS (SELECT t.user_id, t.msg_id, t.c, coalesce(b.mean, g.mean) AS mean, coalesce(b.stddev, g.stddev) AS stddev, coalesce(b.sample_days, g.sample_days) AS sample_days,
                CASE WHEN b.mean IS NOT NULL THEN 'user' WHEN g.mean IS NOT NULL THEN 'global' END AS scope
         FROM cnt t LEFT JOIN base b ON b.user_id = t.user_id AND b.msg_id = t.msg_id LEFT JOIN world g ON g.msg_id = t.msg_id WHERE t.day = {DAY})
"""
PREV = """
newest AS (SELECT user_id, arg_max(risk_score, ts) AS s, max(ts) AS t FROM snap WHERE ts < TIMESTAMP '2024-01-29 15:00:00' GROUP BY user_id),
prev AS (SELECT user_id, CASE WHEN s > 0 THEN s ELSE 0 END AS prev_score,
                CAST(CASE WHEN s > 0 THEN greatest(1, floor(epoch(TIMESTAMP '2024-01-29 15:00:00' - t) / 86400) + 1) ELSE 1 END AS INTEGER) AS days_since FROM newest)
"""


def away(days: str, day: str) -> str:
    return f"(CASE WHEN {days} <= 1 THEN 1 ELSE greatest(1, (SELECT count(*) FROM generate_series(1, CAST({days} AS BIGINT)) g(i) WHERE dayofweek({day} - CAST(g.i AS INTEGER)) NOT IN (0, 6))) END)"


@query("frequency_functions", with_(EV) + """
SELECT event_id, round(ln(1 + fsize) * 1e6) / 1e6 AS log, round(log2(1 + fsize) * 1e6) / 1e6 AS log2, round(log10(1 + fsize) * 1e6) / 1e6 AS log10, fsize AS linear FROM ev""")
def frequency_functions(spark, d):
    e = D.source(spark, d)
    v = F.col("value")
    r = lambda c: F.round(c * 1e6) / 1e6
    return e.select("event_id", *[r(S.frequency(v, m)).alias(m) for m in ("log", "log2", "log10")], S.frequency(v, "linear").alias("linear"))


@query("effective_context", with_(EV, PROFILES, CTX) + "SELECT user_id, ec AS effective_context, m AS multiplier, whitelisted FROM ctx")
def effective_context(spark, d):
    p = D.user_profiles(spark, d)
    return S.with_context(p.select("user_id"), p, SETTINGS, F.lit(D.AS_OF).cast("date")).select("user_id", "effective_context", "multiplier", "whitelisted")


@query("context_multiplier", with_(EV, PROFILES, CTX) + """
SELECT u.user_id, coalesce(c.m, 1.0) AS multiplier FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN ctx c ON c.user_id = u.user_id""")
def context_multiplier(spark, d):
    users = D.events(spark, d).select("user_id").distinct()
    return S.with_context(users, D.user_profiles(spark, d), SETTINGS, F.lit(D.AS_OF).cast("date")).select("user_id", "multiplier")


@query("rule_scores", with_(EV, VALUES, WEIGHTED, PROFILES, CTX) + f"""
SELECT p.user_id, round(sum(p.p) * coalesce(any_value(c.m), 1.0) * 100) / 100 AS rule_score, count(*) AS rules,
       string_agg(p.rule_id || '=' || printf('%.2f', round(p.p * coalesce(c.m, 1.0) * 100) / 100), ',' ORDER BY p.rule_id) AS each
FROM pts p LEFT JOIN ctx c ON c.user_id = p.user_id WHERE p.day = {DAY} GROUP BY p.user_id""")
def rule_scores(spark, d):
    rules = compiled(spark, D.SCORING_RULES)
    values = B.rule_values(D.events(spark, d), rules, first=D.AS_OF)
    out = S.rule_scores(values, rules, D.user_profiles(spark, d), SETTINGS, D.AS_OF)
    each = F.transform(F.array_sort(F.map_entries("rule_scores")), lambda e: F.format_string("%s=%.2f", e["key"], e["value"]))
    return out.select("user_id", S.round2(F.col("rule_raw")).alias("rule_score"), F.size("rule_scores").cast("bigint").alias("rules"),
                      F.array_join(each, ",").alias("each"))


def _known(spark, d):
    counts = B.event_counts(D.events(spark, d), first="2024-01-23", last=D.AS_OF)
    return counts, B.all_baselines(counts, D.AS_OF, 7)


@query("baseline_lookup", with_(EV, CNT, WEEK, LOOKED) + """
SELECT user_id, msg_id, c AS cnt, round(mean * 1e6) / 1e6 AS mean, round(stddev * 1e6) / 1e6 AS stddev, sample_days, scope AS baseline_scope FROM look""")
def baseline_lookup(spark, d):
    counts, known = _known(spark, d)
    out = S.lookup_baseline(counts.where(F.col("day") == D.AS_OF).drop("day"), known, D.AS_OF, 7)
    return out.select("user_id", "msg_id", "cnt", r6("mean"), r6("stddev"), "sample_days", "baseline_scope")


@query("stale_baseline_lookup", with_(EV, CNT, WEEK) + f"""
SELECT t.user_id, t.msg_id, t.c AS cnt, round(g.mean * 1e6) / 1e6 AS mean, CASE WHEN g.mean IS NOT NULL THEN 'global' END AS baseline_scope
FROM cnt t LEFT JOIN world g ON g.msg_id = t.msg_id WHERE t.day = {DAY}""")
def stale_baseline_lookup(spark, d):
    counts, known = _known(spark, d)
    # Seen eight days after the update, own baselines are too old.
    out = S.lookup_baseline(counts.where(F.col("day") == D.AS_OF).drop("day"), known, "2024-02-07", 7)
    return out.select("user_id", "msg_id", "cnt", r6("mean"), "baseline_scope")


@query("anomaly_scores", with_(EV, CNT, WEEK, LOOKED) + f"SELECT user_id, round(sum({ANOM}) * 100) / 100 AS anomaly_score, count(*) AS types FROM look GROUP BY user_id")
def anomaly_scores(spark, d):
    counts, known = _known(spark, d)
    out = S.anomaly_scores(counts.where(F.col("day") == D.AS_OF), known, SETTINGS, D.AS_OF)
    return out.select("user_id", S.round2(F.col("anomaly_raw")).alias("anomaly_score"), F.size("event_counts").cast("bigint").alias("types"))


@query("anomaly_scores_ruled_types", with_(EV, CNT, WEEK, LOOKED) + f"""
SELECT user_id, round(sum(CASE WHEN msg_id IN ('MESSAGE_ERROR', 'MESSAGE_CLICK') THEN {ANOM} ELSE 0 END) * 100) / 100 AS anomaly_score FROM look GROUP BY user_id""")
def anomaly_scores_ruled_types(spark, d):
    counts, known = _known(spark, d)
    out = S.anomaly_scores(counts.where(F.col("day") == D.AS_OF), known, SETTINGS, D.AS_OF, only_types=["MESSAGE_ERROR", "MESSAGE_CLICK"])
    return out.select("user_id", S.round2(F.col("anomaly_raw")).alias("anomaly_score"))


@query("user_status", with_(EV, CNT, WEEK, SNAP, PREV) + """
SELECT u.user_id, max(b.sample_days) AS best_days,
       CASE WHEN coalesce(any_value(p.prev_score), 0) <= 0 AND coalesce(max(b.sample_days), 0) < 7 THEN 'cold_start' WHEN max(b.sample_days) IS NULL THEN 'no_baseline' ELSE 'active' END AS status
FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN (SELECT * FROM base WHERE msg_id <> 'MESSAGE_VIEW') b ON b.user_id = u.user_id
LEFT JOIN (SELECT * FROM prev WHERE prev_score >= 50) p ON p.user_id = u.user_id GROUP BY u.user_id""")
def user_status(spark, d):
    _, known = _known(spark, d)
    users = D.events(spark, d).select("user_id").distinct()
    best = S.best_sample_days(known.where("msg_id <> 'MESSAGE_VIEW'"))
    prev = S.prev_scores(D.snapshots(spark, d), D.AS_OF).where("prev_score >= 50")
    rows = users.join(best, "user_id", "left").join(prev, "user_id", "left").fillna({"prev_score": 0.0})
    cold = S.is_cold(F.col("prev_score"), F.col("best_days"), 7)
    return rows.select("user_id", "best_days", S.status(cold, F.col("best_days")).alias("status"))


@query("effective_days", with_(EV) + f"""
SELECT strftime(day, '%Y-%m-%d') AS day, k, CAST({away('k', 'day')} AS INTEGER) AS skipped, CAST(greatest(k, 1) AS INTEGER) AS counted FROM (SELECT DISTINCT day, k FROM ev)""")
def effective_days(spark, d):
    e = D.events(spark, d).select(local_day("ts").alias("day"), F.col("ext")["k"].cast("int").alias("k")).distinct()
    return e.select("day", "k", S.effective_days(F.col("k"), F.col("day"), "skip").alias("skipped"), S.effective_days(F.col("k"), F.col("day"), "").alias("counted"))


@query("decayed_scores", with_(EV) + "SELECT event_id, round(fsize * pow(0.9, k) * 100) / 100 AS decayed, CASE WHEN fsize > 99 THEN 'HIGH' WHEN fsize > 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM ev")
def decayed_scores(spark, d):
    e = D.events(spark, d)
    v = F.col("ext")["fsize"].cast("double")
    return e.select("event_id", S.round2(S.decayed(v, F.col("ext")["k"].cast("int"), 0.9)).alias("decayed"), S.classify(v, 40, 99).alias("level"))


@query("prev_scores", with_(EV, SNAP, PREV) + "SELECT user_id, prev_score, days_since FROM prev")
def prev_scores(spark, d):
    return S.prev_scores(D.snapshots(spark, d), D.AS_OF)


@query("prev_scores_carried", with_(EV, SNAP, PREV) + "SELECT user_id, prev_score, days_since FROM prev")
def prev_scores_carried(spark, d):
    """The same from generations of the newest scores, each made from the one before and the days since."""
    path = stage_path(spark, "snapshots")
    write_partitions(D.snapshots(spark, d).select("user_id", "ts", "risk_score", "day"), path, "day")
    newest, scores = NewestScores(stage_path(spark, "newest"), buckets=8), spark.read.parquet(path)
    for before in (8, 1):
        newest.before(spark, scores, (dt.date.fromisoformat(D.AS_OF) - dt.timedelta(days=before)).isoformat())
    return S.previous_of(newest.before(spark, scores, D.AS_OF), D.AS_OF)


DAILY = f"""
an AS (SELECT user_id, sum({ANOM}) AS a FROM look GROUP BY user_id),
ru AS (SELECT user_id, sum(p) AS r FROM pts WHERE day = {DAY} GROUP BY user_id),
best AS (SELECT user_id, max(sample_days) AS bd FROM base GROUP BY user_id),
who AS (SELECT user_id FROM an UNION SELECT user_id FROM prev WHERE prev_score > 0),
inp AS (SELECT w.user_id, coalesce(a, 0) AS a, coalesce(r, 0) * coalesce(m, 1.0) AS r, bd, coalesce(prev_score, 0) AS prev_score, coalesce(days_since, 1) AS ds,
               coalesce(ec, 'normal') AS ec, coalesce(whitelisted, false) AS wl
        FROM who w LEFT JOIN an USING (user_id) LEFT JOIN ru USING (user_id) LEFT JOIN best USING (user_id) LEFT JOIN prev USING (user_id) LEFT JOIN ctx USING (user_id)),
dec AS (SELECT *, prev_score * pow(0.9, {away('ds', DAY)}) AS base_score, NOT wl AND prev_score <= 0 AND coalesce(bd, 0) < 3 AS cold FROM inp),
fin AS (SELECT *, CASE WHEN wl THEN round(base_score * 100) / 100 WHEN cold THEN 0
                       ELSE round((CASE WHEN ec = 'blacklist' THEN greatest(base_score, 25) ELSE base_score END + r + a) * 100) / 100 END AS risk,
               CASE WHEN wl THEN 0 ELSE round(r * 100) / 100 END AS rs, CASE WHEN wl THEN 0 ELSE round(a * 100) / 100 END AS sc FROM dec)
"""


@query("daily_risk", with_(EV, VALUES, WEIGHTED, CNT, WEEK, LOOKED, SNAP, PREV, PROFILES, CTX, DAILY) + """
SELECT user_id, risk AS risk_score, CASE WHEN risk > 99 THEN 'HIGH' WHEN risk > 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       CASE WHEN cold THEN 'cold_start' WHEN bd IS NULL THEN 'no_baseline' ELSE 'active' END AS status,
       rs AS rule_score, sc AS anomaly_score, round((rs + sc) * 100) / 100 AS daily_score, round(base_score * 100) / 100 AS decayed_prev, prev_score FROM fin""")
def daily_risk(spark, d):
    e, rules = D.events(spark, d), compiled(spark, D.SCORING_RULES)
    _, known = _known(spark, d)
    prev = S.prev_scores(D.snapshots(spark, d), D.AS_OF)
    out = S.score_day(e, rules, known, D.user_profiles(spark, d), prev, SETTINGS, D.AS_OF)
    return out.select("user_id", "risk_score", "risk_level", "status", "rule_score", "anomaly_score",
                      S.round2(F.col("daily_score")).alias("daily_score"), "decayed_prev", "prev_score")


FIRST, LAST = "2024-01-10", "2024-01-30"
TIMELINE = f"""
days AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS day),
hist AS (SELECT c.user_id, c.msg_id, d.day AS as_of, datediff('day', min(c.day), max(c.day)) + 1 AS n, sum(c.c) AS s1, sum(c.c * c.c) AS s2
         FROM cnt c JOIN days d ON c.day >= d.day - 7 AND c.day < d.day GROUP BY ALL),
h AS (SELECT user_id, msg_id, as_of, n AS sample_days, s1 / n AS mean, sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)) AS stddev FROM hist),
g AS (SELECT msg_id, as_of, avg(mean) AS mean, avg(stddev) AS stddev, max(sample_days) AS sample_days FROM h GROUP BY ALL),
hl AS (SELECT h.user_id, h.msg_id, d.day, max(h.as_of) AS as_of FROM h JOIN days d ON h.as_of <= d.day GROUP BY ALL),
hd AS (SELECT hl.user_id, hl.msg_id, hl.day, h.* EXCLUDE (user_id, msg_id) FROM hl JOIN h ON h.user_id = hl.user_id AND h.msg_id = hl.msg_id AND h.as_of = hl.as_of),
gl AS (SELECT g.msg_id, d.day, max(g.as_of) AS as_of FROM g JOIN days d ON g.as_of <= d.day GROUP BY ALL),
gd AS (SELECT gl.day, g.* FROM gl JOIN g ON g.msg_id = gl.msg_id AND g.as_of = gl.as_of),
today AS (SELECT c.user_id, c.day, c.c, coalesce(o.mean, gd.mean) AS mean, coalesce(o.stddev, gd.stddev) AS stddev, coalesce(o.sample_days, gd.sample_days) AS sample_days
          FROM cnt c LEFT JOIN (SELECT * FROM hd WHERE day - as_of <= 7) o ON o.user_id = c.user_id AND o.msg_id = c.msg_id AND o.day = c.day
          LEFT JOIN gd ON gd.msg_id = c.msg_id AND gd.day = c.day WHERE c.day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'),
an AS (SELECT user_id, day, sum({ANOM}) AS a FROM today GROUP BY ALL),
ru AS (SELECT user_id, day, sum(p) AS r FROM pts GROUP BY ALL),
best AS (SELECT user_id, day, max(sample_days) AS bd FROM hd GROUP BY ALL),
grid AS (SELECT u.user_id, d.day FROM (SELECT user_id, min(day) AS since FROM cnt WHERE day >= DATE '{FIRST}' AND day <= DATE '{LAST}' GROUP BY user_id) u JOIN days d ON d.day >= u.since),
inp AS (SELECT gr.user_id, gr.day, coalesce(r, 0) * {factor('ec')} AS r, coalesce(a, 0) AS a, coalesce(bd, 0) AS bd, bd IS NULL AS nob, ec, wl
        FROM (SELECT q.user_id, q.day, coalesce({effective('q.day')}, 'normal') AS ec, coalesce(whitelisted, false) AS wl FROM grid q LEFT JOIN prof p ON p.user_id = q.user_id) gr
        LEFT JOIN ru ON ru.user_id = gr.user_id AND ru.day = gr.day LEFT JOIN an ON an.user_id = gr.user_id AND an.day = gr.day
        LEFT JOIN best ON best.user_id = gr.user_id AND best.day = gr.day),
fold AS (
  SELECT user_id, day, CAST(0 AS DOUBLE) AS prev, CASE WHEN wl THEN 0 WHEN bd < 3 THEN 0 ELSE round((CASE WHEN ec = 'blacklist' THEN 25 ELSE 0 END + r + a) * 100) / 100 END AS risk
  FROM inp WHERE (user_id, day) IN (SELECT user_id, min(day) FROM inp GROUP BY user_id)
  UNION ALL
  SELECT i.user_id, i.day, f.risk, CASE WHEN i.wl THEN round(f.risk * 0.9 * 100) / 100 WHEN f.risk <= 0 AND i.bd < 3 THEN 0
         ELSE round((CASE WHEN i.ec = 'blacklist' THEN greatest(f.risk * 0.9, 25) ELSE f.risk * 0.9 END + i.r + i.a) * 100) / 100 END
  FROM fold f JOIN inp i ON i.user_id = f.user_id AND i.day = f.day + 1)
"""


@query("risk_timeline", with_(EV, VALUES, WEIGHTED, CNT, PROFILES, TIMELINE) + """
SELECT f.user_id, strftime(f.day, '%Y-%m-%d') AS day, f.risk AS risk_score, CASE WHEN f.risk > 99 THEN 'HIGH' WHEN f.risk > 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       CASE WHEN NOT i.wl AND f.prev <= 0 AND i.bd < 3 THEN 'cold_start' WHEN i.nob THEN 'no_baseline' ELSE 'active' END AS status,
       f.prev AS prev_score, CASE WHEN i.wl THEN 0 ELSE round(i.r * 100) / 100 END AS rule_score, CASE WHEN i.wl THEN 0 ELSE round(i.a * 100) / 100 END AS anomaly_score
FROM fold f JOIN inp i ON i.user_id = f.user_id AND i.day = f.day""")
def timeline(spark, d):
    rules = compiled(spark, D.SCORING_RULES)
    out = risk_timeline(D.events(spark, d), rules, D.user_profiles(spark, d), SETTINGS, FIRST, LAST)
    return out.select("user_id", "day", "risk_score", "risk_level", "status", "prev_score", "rule_score", "anomaly_score")


# The same days for users who come into the range with a score: all of them, with events or without.
CARRIED = f"""
before AS (SELECT * FROM (SELECT user_id, arg_max(risk_score, ts) AS score FROM snap WHERE day < DATE '{FIRST}' GROUP BY user_id) WHERE score > 0)
""" + "," + TIMELINE.replace(
    "GROUP BY user_id) u JOIN days d", f"GROUP BY user_id UNION ALL SELECT user_id, DATE '{FIRST}' FROM before) v GROUP BY user_id) u JOIN days d"
).replace("grid AS (SELECT u.user_id, d.day FROM (SELECT user_id, min(day) AS since FROM cnt", "grid AS (SELECT u.user_id, d.day FROM (SELECT user_id, min(since) AS since FROM (SELECT user_id, min(day) AS since FROM cnt").replace(
    """CAST(0 AS DOUBLE) AS prev, CASE WHEN wl THEN 0 WHEN bd < 3 THEN 0 ELSE round((CASE WHEN ec = 'blacklist' THEN 25 ELSE 0 END + r + a) * 100) / 100 END AS risk
  FROM inp WHERE""",
    """coalesce(score, 0) AS prev, CASE WHEN wl THEN round(coalesce(score, 0) * 0.9 * 100) / 100 WHEN score IS NULL AND bd < 3 THEN 0
         ELSE round((CASE WHEN ec = 'blacklist' THEN greatest(coalesce(score, 0) * 0.9, 25) ELSE coalesce(score, 0) * 0.9 END + r + a) * 100) / 100 END AS risk
  FROM inp LEFT JOIN before USING (user_id) WHERE""",
)


@query("risk_timeline_carried", with_(EV, SNAP, VALUES, WEIGHTED, CNT, PROFILES, CARRIED) + """
SELECT f.user_id, strftime(f.day, '%Y-%m-%d') AS day, f.risk AS risk_score, f.prev AS prev_score, CASE WHEN i.wl THEN 0 ELSE round(i.r * 100) / 100 END AS rule_score,
       CASE WHEN NOT i.wl AND f.prev <= 0 AND i.bd < 3 THEN 'cold_start' WHEN i.nob THEN 'no_baseline' ELSE 'active' END AS status
FROM fold f JOIN inp i ON i.user_id = f.user_id AND i.day = f.day""")
def timeline_carried(spark, d):
    rules = compiled(spark, D.SCORING_RULES)
    before = S.prev_scores(D.snapshots(spark, d), FIRST)
    out = risk_timeline(D.events(spark, d), rules, D.user_profiles(spark, d), SETTINGS, FIRST, LAST, previous=before)
    return out.select("user_id", "day", "risk_score", "prev_score", "rule_score", "status")


@query("refresh_profiles", with_(EV, PROFILES) + f"""
SELECT user_id, CASE WHEN over THEN 'normal' ELSE context END AS context, CASE WHEN NOT over THEN strftime(start_date, '%Y-%m-%d') END AS start_date,
       CASE WHEN NOT over THEN strftime(end_date, '%Y-%m-%d') END AS end_date, CASE WHEN NOT over THEN note END AS note, whitelisted
FROM (SELECT *, coalesce(end_date < {DAY} AND context <> 'normal', false) AS over FROM prof)
UNION ALL SELECT DISTINCT user_id, 'normal', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false FROM ev WHERE user_id NOT IN (SELECT user_id FROM prof)""")
def refresh_profiles(spark, d):
    return S.refresh_profiles(D.user_profiles(spark, d), D.events(spark, d), D.AS_OF)


@query("score_delta", with_(EV, SNAP) + f"""
SELECT user_id, t AS risk_score, coalesce(y, 0) AS prev_day_score, t - coalesce(y, 0) AS score_diff FROM (
  SELECT user_id, arg_max(risk_score, ts) FILTER (day = {DAY}) AS t, arg_max(risk_score, ts) FILTER (day = {DAY} - 1) AS y
  FROM snap WHERE day >= {DAY} - 1 AND day <= {DAY} GROUP BY user_id) WHERE t IS NOT NULL""")
def score_delta(spark, d):
    return S.score_delta(D.snapshots(spark, d), D.AS_OF)

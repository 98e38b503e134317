"""Normalization, stores and rule tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from duskwatch import datasets as D
from duskwatch.functions.fields import field, local_day
from duskwatch.functions.windows import window_seconds
from duskwatch.operators import behaviour, catalog, normalize, rules
from duskwatch.session import stage_path
from duskwatch.sources import stores

from . import EV, SNAP, query, with_


@query("expand_labels", with_(EV) + """
SELECT event_id, size_class, CASE WHEN act <> 'error' THEN CAST(k // 10 AS VARCHAR) END AS key_decade,
       CAST(CASE WHEN act <> 'error' THEN 14 ELSE 13 END AS INTEGER) AS keys FROM ev""")
def expand_labels(spark, d):
    out = normalize.expand_labels(D.raw_events(spark, d))
    return out.select("event_id", F.col("ext")["SizeClass"].alias("size_class"), F.col("ext")["KeyDecade"].alias("key_decade"), F.size("ext").alias("keys"))


@query("default_event_time", with_(EV) + """
SELECT event_id, CASE WHEN k >= 90 THEN TIMESTAMP '2024-01-30 12:00:00' ELSE ts END AS ts FROM ev""")
def default_event_time(spark, d):
    e = D.events(spark, d)
    lost = e.withColumn("ts", F.when(F.col("ext")["k"].cast("int") < 90, F.col("ts")))
    return normalize.default_ts(lost, F.lit(dt.datetime(2024, 1, 30, 12, tzinfo=dt.timezone.utc))).select("event_id", "ts")


@query("identity_columns", with_(EV) + """
SELECT event_id, user_id, 'user ' || user_id AS user_name, user_ip FROM ev""")
def identity_columns(spark, d):
    return normalize.with_identity(D.raw_events(spark, d)).select("event_id", "user_id", "user_name", "user_ip")


@query("resolve_user", with_(EV) + """
SELECT event_id, CASE WHEN k < 50 THEN 'u' || user_id ELSE user_id END AS user_id FROM ev WHERE k >= 5""")
def resolve_user(spark, d):
    k = F.col("ext")["k"].cast("int")
    raw = D.raw_events(spark, d).withColumns({
        # The event's own user in the lower half, empty elsewhere; no user at all below five.
        "user_id": F.when((k >= 5) & (k < 50), F.concat(F.lit("u"), F.col("ext")["suid"])).otherwise(""),
        "ext": F.when(k >= 5, F.col("ext")).otherwise(F.map_filter("ext", lambda key, _: key != "suid")),
    })
    return normalize.resolve_user(raw).select("event_id", "user_id")


@query("field_lookup", with_(EV) + """
SELECT event_id, act AS action, hostname, size_class, CAST(k AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS absent FROM ev""")
def field_lookup(spark, d):
    e = D.events(spark, d)
    return e.select("event_id", field("action").alias("action"), field("hostname").alias("hostname"),
                    field("SizeClass").alias("size_class"), field("k").alias("k"), field("nothing").alias("absent"))


@query("virtual_fields", with_(EV) + """
SELECT CAST(hour(lts) AS INTEGER) AS hour, CAST(dayofweek(lts) + 1 AS INTEGER) AS weekday, count(*) AS cnt FROM ev GROUP BY ALL""")
def virtual_fields(spark, d):
    return D.events(spark, d).groupBy(field("hour").alias("hour"), field("dayOfWeek").alias("weekday")).agg(F.count("*").alias("cnt"))


@query("event_report_columns", with_(EV) + """
SELECT event_id, ts, upper(act) AS type, user_id, hostname, user_ip, act AS action, outcome FROM ev""")
def event_report_columns(spark, d):
    return normalize.event_report_columns(D.raw_events(spark, d))


@query("display_values", with_(EV) + """
SELECT event_id, upper(act) AS type, strftime(lts, '%m-%d %H:%M:%S') AS shown FROM ev""")
def display_values(spark, d):
    return D.events(spark, d).select("event_id", normalize.display_type("msg_id").alias("type"), normalize.local_time("ts").alias("shown"))


@query("normalized_events", with_(EV) + """
SELECT event_id, ts, msg_id, hostname, user_id, user_ip, size_class FROM ev""")
def normalized_events(spark, d):
    out = normalize.normalize(D.raw_events(spark, d), F.current_timestamp())
    return out.select("event_id", "ts", "msg_id", "hostname", "user_id", "user_ip", F.col("ext")["SizeClass"].alias("size_class"))


@query("window_lengths", with_(EV) + """
SELECT act, k, CAST(k * CASE act WHEN 'click' THEN 1 WHEN 'error' THEN 3600 WHEN 'purchase' THEN 60 WHEN 'signup' THEN 60 END AS BIGINT) AS seconds, count(*) AS cnt
FROM ev GROUP BY ALL""")
def window_lengths(spark, d):
    unit = F.create_map(*[F.lit(x) for x in ("click", "s", "error", "h", "purchase", "m", "signup", "", "view", "?")])
    text = F.concat(F.col("ext")["k"], unit[F.col("ext")["act"]])
    e = D.events(spark, d).select(F.col("ext")["act"].alias("act"), F.col("ext")["k"].cast("int").alias("k"), window_seconds(text).alias("seconds"))
    return e.groupBy("act", "k", "seconds").agg(F.count("*").alias("cnt"))


@query("day_range_scan", with_(EV) + """
SELECT strftime(day, '%Y-%m-%d') AS day, msg_id, count(*) AS cnt FROM ev
WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY ALL""")
def day_range_scan(spark, d):
    path = stage_path(spark, "event-log")
    stores.write_event_log(D.events(spark, d), path)
    return stores.read_day_range(spark, path, "2024-01-10", "2024-01-20").groupBy("day", "msg_id").agg(F.count("*").alias("cnt"))


@query("score_snapshot_upsert", with_(EV, SNAP) + """
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, hour, ts, risk_score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, day, hour ORDER BY (rule_score >= 50) DESC, ts DESC) AS rn FROM snap) WHERE rn = 1""")
def score_snapshot_upsert(spark, d):
    path = stage_path(spark, "scores")
    snaps = D.snapshots(spark, d).select("user_id", "ts", "risk_score", "rule_score")
    stores.upsert_scores(snaps.where("rule_score < 50"), path)
    stores.upsert_scores(snaps.where("rule_score >= 50"), path)
    return spark.read.parquet(path).select("user_id", "day", "hour", "ts", "risk_score")


@query("latest_catalog", with_(EV) + """
SELECT msg_id, count(*) AS sample_count FROM ev WHERE day BETWEEN DATE '2024-01-23' AND DATE '2024-01-30' GROUP BY ALL""")
def latest_catalog(spark, d):
    path = stage_path(spark, "catalog")
    e = D.raw_events(spark, d)
    for day in ("2024-01-15", "2024-01-30"):
        stores.save_catalog(catalog.field_catalog(e, day), path, dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc))
    return stores.latest_catalog(spark.read.parquet(path)).select("msg_id", "sample_count")


_REVISIONS = """
w AS (SELECT ts >= TIMESTAMP '2024-01-16' AS late, act || '-' || CAST(k AS VARCHAR) AS rule_id, CAST(count(*) AS DOUBLE) AS weight FROM ev GROUP BY ALL),
old AS (SELECT rule_id, 'rule ' || rule_id AS name, weight FROM w WHERE NOT late AND NOT ends_with(rule_id, '7')),
new AS (SELECT rule_id, CAST(NULL AS VARCHAR) AS name, weight FROM w WHERE late AND NOT ends_with(rule_id, '3'))
"""


@query("rule_upsert", with_(EV, _REVISIONS) + """
SELECT coalesce(n.rule_id, o.rule_id) AS rule_id, coalesce(n.name, o.name) AS name, coalesce(n.weight, o.weight) AS weight
FROM old o FULL JOIN new n ON o.rule_id = n.rule_id WHERE coalesce(n.rule_id, o.rule_id) NOT LIKE 'view-%'""")
def rule_upsert(spark, d):
    old, new = D.rule_revisions(spark, d)
    gone = old.where(F.col("rule_id").startswith("view-")).unionByName(new.where(F.col("rule_id").startswith("view-"))).distinct()
    return rules.upsert_rules(old, new, gone)


@query("rule_weights", with_(EV, _REVISIONS) + """
SELECT o.rule_id, o.name, coalesce(n.weight, o.weight) AS weight FROM old o LEFT JOIN new n ON o.rule_id = n.rule_id""")
def rule_weights(spark, d):
    old, new = D.rule_revisions(spark, d)
    return rules.apply_weights(old, new.select("rule_id", "weight"))


@query("merge_rules", with_(EV, _REVISIONS) + """
SELECT rule_id, name, weight FROM old UNION ALL SELECT rule_id, name, weight FROM new WHERE rule_id NOT IN (SELECT rule_id FROM old)""")
def merge_rules(spark, d):
    return rules.merge_rules(*D.rule_revisions(spark, d))


@query("weights_report", with_(EV, _REVISIONS) + """
SELECT rule_id, name, weight, 'MESSAGE_' || upper(split_part(rule_id, '-', 1)) AS msg_id FROM old WHERE weight >= 2""")
def weights_report(spark, d):
    old, _ = D.rule_revisions(spark, d)
    docs = old.select(F.to_json(F.struct(
        F.col("rule_id").alias("id"), "name", "weight",
        F.struct(F.concat(F.lit("MESSAGE_"), F.upper(F.split("rule_id", "-")[0])).alias("msgId")).alias("match"),
        F.struct((F.col("weight") >= 2).alias("enabled")).alias("ueba"),
    )).alias("value"))
    return rules.weights_report(rules.parse_rules(docs))


_MOMENTS = """
SELECT user_id, msg_id, avg(c) AS mean, stddev_pop(c) AS stddev, CAST(count(*) AS INTEGER) AS sample_days FROM (
  SELECT s.user_id, s.msg_id, coalesce(x.c, 0) AS c
  FROM (SELECT user_id, msg_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM {src} GROUP BY user_id, msg_id) s
  LEFT JOIN {src} x ON x.user_id = s.user_id AND x.msg_id = s.msg_id AND x.day = s.day) GROUP BY user_id, msg_id
"""


@query("baseline_upsert", with_(EV, "cnt AS (SELECT user_id, msg_id, day, count(*) AS c FROM ev GROUP BY ALL)",
    "a AS (SELECT * FROM cnt WHERE day >= DATE '2024-01-08' AND day < DATE '2024-01-15')",
    "b AS (SELECT * FROM cnt WHERE day >= DATE '2024-01-23' AND day < DATE '2024-01-30')",
    f"ma AS ({_MOMENTS.format(src='a')})", f"mb AS ({_MOMENTS.format(src='b')})") + """
SELECT user_id, msg_id, round(mean * 1e6) / 1e6 AS mean, round(stddev * 1e6) / 1e6 AS stddev, sample_days, '2024-01-30' AS updated FROM mb
UNION ALL SELECT user_id, msg_id, round(mean * 1e6) / 1e6, round(stddev * 1e6) / 1e6, sample_days, '2024-01-15' FROM ma ANTI JOIN mb USING (user_id, msg_id)""")
def baseline_upsert(spark, d):
    known = lambda day: behaviour.baselines(behaviour.window_counts(D.events(spark, d), day, 7), day, 7)
    both = behaviour.upsert_baselines(known("2024-01-30"), known("2024-01-15"))
    r6 = lambda c: (F.round(F.col(c) * 1e6) / 1e6).alias(c)
    return both.select("user_id", "msg_id", r6("mean"), r6("stddev"), "sample_days", "updated")


@query("backfilled_history", with_(EV) + """
SELECT event_id AS log_pk, msg_id, hostname, user_id, user_ip, act AS action, outcome, strftime(day, '%Y-%m-%d') AS day FROM ev""")
def backfilled_history(spark, d):
    from duskwatch.sources.history import backfill_history

    rows = D.events(spark, d).select(
        F.col("event_id").alias("log_pk"), F.col("ts").alias("time"), "hostname", "msg_id",
        F.lit("LOW").alias("severity"), F.to_json("ext").alias("cef_extensions"))
    path = stage_path(spark, "history")
    backfill_history(rows, path, run="first")
    return spark.read.parquet(path).withColumn("_d", local_day("ts")).where("day = _d").select(
        "log_pk", "msg_id", "hostname", "user_id", "user_ip", "action", "outcome", "day")


def raw_json(spark, d):
    """Raw JSON of the events: a third names its own user, a third only ``suid``, a third none; some lack a type; two unknown fields."""
    k = F.col("ext")["k"].cast("int")
    suid = F.when(k % 3 < 2, F.col("user_id"))
    own = F.when(k % 3 == 0, F.concat(F.lit("own-"), F.col("user_id"))).when(k % 3 == 1, F.lit(""))
    doc = F.struct(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("@timestamp"),
        F.when(k % 10 != 7, F.col("msg_id")).alias("msgId"), own.alias("userId"), k.alias("severity"),
        F.struct(F.concat(F.lit("z"), k.cast("string")).alias("name"), (k % 2 == 0).alias("even")).alias("zone"),
        F.map_filter(F.create_map(F.lit("suid"), suid, F.lit("act"), F.col("ext")["act"]), lambda _, v: v.isNotNull()).alias("cefExtensions"))
    return D.events(spark, d).select(F.to_json(doc).alias("value"))


@query("raw_to_behaviour", with_(EV) + """
SELECT CASE WHEN k % 3 = 0 THEN 'own-' || user_id ELSE user_id END AS user_id, msg_id, strftime(day, '%Y-%m-%d') AS day,
       count(*) AS cnt, count(*) FILTER (k >= 50) AS severe, count(DISTINCT k) AS republished
FROM ev WHERE k % 3 < 2 AND k % 10 <> 7 GROUP BY ALL""")
def raw_to_behaviour(spark, d):
    """Parse, normalize, store, count and republish: events without user or type are stored, but nobody's behaviour."""
    from duskwatch.operators.rules import collect_rules, rules_frame
    from duskwatch.sources.streams import parse_events, to_json_events

    path = stage_path(spark, "raw-log")
    late = F.lit(dt.datetime(2024, 1, 30, 12, tzinfo=dt.timezone.utc))
    stores.write_event_log(normalize.normalize(parse_events(raw_json(spark, d)), late), path, run="0")
    log = spark.read.parquet(path)
    severe = {"name": "severe", "weight": 1, "ueba": {"enabled": True}, "aggregate": {"type": "count"}}
    docs = [severe | {"id": t, "ruleId": t, "match": {"msgId": t, "conditions": [{"field": "severity", "op": "gte", "value": "50"}]}}
            for t in ("MESSAGE_CLICK", "MESSAGE_VIEW", "MESSAGE_PURCHASE", "MESSAGE_ERROR", "MESSAGE_SIGNUP")]
    values = behaviour.rule_values(log, collect_rules(rules_frame(spark, docs)))
    back = parse_events(to_json_events(log)).where(behaviour.scorable()).select("user_id", "msg_id", local_day("ts").alias("day"), F.from_json("extra", "severity int, zone struct<name:string,even:boolean>").alias("x"))
    names = back.where("x.zone.name = concat('z', x.severity) and x.zone.even = (x.severity % 2 = 0)")
    names = names.groupBy("user_id", "msg_id", "day").agg(F.countDistinct("x.severity").alias("republished"))
    counts = behaviour.event_counts(log).join(values.withColumnRenamed("rule_id", "msg_id"), ["user_id", "msg_id", "day"], "left").join(names, ["user_id", "msg_id", "day"], "left")
    return counts.select("user_id", "msg_id", "day", "cnt", F.coalesce("value", F.lit(0.0)).cast("bigint").alias("severe"), "republished")

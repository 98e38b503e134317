"""Adapter from the driver's ``events`` table to the event model, and the rule set, profiles and settings used with it.

Everything here is derived from ``events.parquet`` by Spark, or is a rule literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fields import local_day, local_hour, round2
from .operators.rules import parse_rules
from .session import LOCAL_TZ

#: Fixed value: the day one-day reports look at.
AS_OF = "2024-01-30"

#: The table stores UTC wall clocks; reading them as instants needs no cast, so time filters are pushed down.
EVENTS_DDL = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_DDL).parquet(f"{sf_dir}/events.parquet")


def _key_number():
    """The number inside ``{"k": n}`` as text."""
    return F.get_json_object("props", "$.k")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a producer sends them: the extension map still holds label/value pairs and no expanded names."""
    k = _key_number()
    user = F.col("user_id").cast("string")
    return source(spark, sf_dir).select(
        "event_id",
        "ts",
        F.concat(F.lit("MESSAGE_"), F.upper("event_type")).alias("msg_id"),
        F.create_map(
            F.lit("suid"), user,
            F.lit("suser"), F.concat(F.lit("user "), user),
            F.lit("shost"), F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string")),
            F.lit("src"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")),
            F.lit("act"), F.col("event_type"),
            F.lit("outcome"), F.when(k.cast("int") >= 80, "blocked").otherwise("allowed"),
            F.lit("fsize"), F.col("value").cast("string"),
            F.lit("k"), k,
            F.lit("cs1Label"), F.lit("Size Class"),
            F.lit("cs1"), F.when(F.col("value") >= 100, "large").otherwise("small"),
            F.lit("cn1Label"), F.when(F.col("event_type") == "error", "").otherwise("Key Decade"),
            F.lit("cn1"), F.floor(k.cast("int") / 10).cast("string"),
        ).alias("ext"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as the log store keeps them: identity columns and labels already in place."""
    return modelled(source(spark, sf_dir))


def modelled(rows: DataFrame) -> DataFrame:
    """Rows of the table (batch or stream) as stored events."""
    k = _key_number()
    user = F.col("user_id").cast("string")
    host = F.concat(F.lit("host-"), (F.col("user_id") % 20).cast("string"))
    ip = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))
    return rows.select(
        "event_id",
        "ts",
        F.concat(F.lit("MESSAGE_"), F.upper("event_type")).alias("msg_id"),
        host.alias("hostname"),
        F.lit("agent").alias("app_name"),
        user.alias("user_id"),
        F.concat(F.lit("user "), user).alias("user_name"),
        ip.alias("user_ip"),
        F.create_map(
            F.lit("suid"), user,
            F.lit("shost"), host,
            F.lit("src"), ip,
            F.lit("act"), F.col("event_type"),
            F.lit("outcome"), F.when(k.cast("int") >= 80, "blocked").otherwise("allowed"),
            F.lit("fsize"), F.col("value").cast("string"),
            F.lit("k"), k,
            F.lit("SizeClass"), F.when(F.col("value") >= 100, "large").otherwise("small"),
        ).alias("ext"),
    )


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for six of seven users, with every context, validity period and whitelist case."""
    u = F.col("user_id")
    users = source(spark, sf_dir).select("user_id").distinct().where(u % 7 != 3)
    kind = F.when(u % 6 == 0, "departing").when(u % 6 == 1, "vacation").when(u % 6 == 2, "blacklist")
    return users.select(
        u.cast("string").alias("user_id"),
        kind.when(u % 6 == 3, "vip").otherwise("normal").alias("context"),
        F.when(u % 4 == 0, F.lit("2024-01-10").cast("date")).when(u % 4 == 1, F.lit("2024-02-10").cast("date")).alias("start_date"),
        F.when(u % 5 == 0, F.lit("2024-01-20").cast("date")).alias("end_date"),
        F.concat(F.lit("note "), u.cast("string")).alias("note"),
        (u % 13 == 0).alias("whitelisted"),
    )


def snapshots(spark: SparkSession, sf_dir: str, tz: str = LOCAL_TZ) -> DataFrame:
    """One score snapshot per event, for the report operators: the event's value stands for the risk."""
    k = _key_number().cast("double")
    v = F.col("value")
    return source(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("user_id"),
        local_day("ts", tz).alias("day"),
        local_hour("ts", tz).alias("hour"),
        "ts",
        v.alias("risk_score"),
        F.when(v > 99, "HIGH").when(v > 40, "MEDIUM").otherwise("LOW").alias("risk_level"),
        F.when(k < 10, "cold_start").otherwise("active").alias("status"),
        k.alias("rule_score"),
        round2(v / 4).alias("anomaly_score"),
        round2(v * 0.9).alias("decayed_prev"),
        round2(v / 2).alias("prev_score"),
    )


def rule_revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two generations of a per-type rule list, weighted by what the first and second half of the month held."""
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz").cast("timestamp")
    rows = source(spark, sf_dir).withColumn("late", late)
    # One rule per event type and key number; each generation lacks some of the keys.
    rule = F.concat_ws("-", "event_type", _key_number())
    weighed = rows.groupBy("late", rule.alias("rule_id")).agg(F.count("*").cast("double").alias("weight"))
    old = weighed.where(~F.col("late") & ~F.col("rule_id").endswith("7"))
    new = weighed.where(F.col("late") & ~F.col("rule_id").endswith("3"))
    return (
        old.select("rule_id", F.concat(F.lit("rule "), "rule_id").alias("name"), "weight"),
        new.select("rule_id", F.lit(None).cast("string").alias("name"), "weight"),
    )


def own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule documents as a table: a limit of their own for every user and type, and a burst on every host."""

    def condition(name: str, op: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), F.lit(op).alias("op"), value.cast("string").alias("value"))

    seen = events(spark, sf_dir).select("user_id", "msg_id", "hostname")
    user, host = F.col("user_id"), F.col("hostname")
    own = seen.select("user_id", "msg_id").distinct().select(
        F.concat_ws(" ", user, "msg_id").alias("id"),
        F.concat(F.lit("Own limit of "), user).alias("name"),
        F.struct(F.col("msg_id").alias("msgId"), F.array(condition("fsize", "gte", 50 + user.cast("int") % 50), condition("userId", "eq", user)).alias("conditions")).alias("match"),
    )
    burst = seen.select("hostname").distinct().select(
        F.concat(host, F.lit(" burst")).alias("id"),
        F.concat(F.lit("Burst on "), host).alias("name"),
        F.lit("HIGH").alias("severity"),
        F.array(F.lit("hostname")).alias("by"),
        F.struct(F.array(condition("hostname", "eq", host), condition("action", "neq", F.lit("view"))).alias("conditions")).alias("match"),
        F.struct(F.lit("6h").alias("within"), F.lit(2).alias("minCount")).alias("aggregate"),
    )
    return parse_rules(own.select(F.to_json(F.struct("*")).alias("value")).unionByName(burst.select(F.to_json(F.struct("*")).alias("value"))))


#: Detection rules in the document form users write.
DETECTION_RULES = [
    {"id": "blocked_error", "name": "Blocked error", "enabled": True, "cep": {"enabled": True, "severity": "HIGH"},
     "match": {"msgId": "MESSAGE_ERROR", "logic": "AND", "conditions": [
         {"field": "outcome", "op": "eq", "value": "blocked"}, {"field": "fsize", "op": "gte", "value": 60}]}},
    {"id": "odd_purchase", "name": "Odd purchase", "enabled": True, "cep": {"enabled": True}, "severity": "LOW",
     "match": {"msgId": "MESSAGE_PURCHASE", "logic": "OR", "conditions": [
         {"field": "k", "op": "lt", "value": 5}, {"field": "fsize", "op": "gt", "value": 200}]}},
    {"id": "error_burst", "name": "Error burst", "enabled": True, "cep": {"enabled": True, "severity": "CRITICAL"},
     "match": {"msgId": "MESSAGE_ERROR"}, "aggregate": {"within": "6h", "minCount": 2}},
    {"id": "host_signups", "name": "Signups on one host", "enabled": True, "cep": {"enabled": True}, "by": ["hostname"],
     "match": {"msgId": "MESSAGE_SIGNUP"}, "aggregate": {"within": "24h", "count": {"min": 2}}},
    {"id": "repeat_click", "name": "Repeated click", "enabled": True, "cep": {"enabled": True, "severity": "LOW"}, "within": "12h",
     "patterns": [{"match": {"msgId": "MESSAGE_CLICK"}, "quantifier": {"min": 2}}]},
    {"id": "error_and_purchase", "name": "Error and purchase together", "enabled": True, "cep": {"enabled": True}, "within": "12h",
     "patterns": [{"match": {"msgId": "MESSAGE_ERROR"}}, {"match": {"msgId": "MESSAGE_PURCHASE"}}]},
    {"id": "odd_signup_or_view", "name": "Odd signup or view", "enabled": True, "cep": {"enabled": True}, "logic": "OR",
     "patterns": [{"match": {"msgId": "MESSAGE_SIGNUP", "conditions": [{"field": "k", "op": "lt", "value": 10}]}},
                  {"match": {"msgId": "MESSAGE_VIEW", "conditions": [{"field": "hour", "op": "time_range", "start": 22, "end": 2}]}}]},
]

#: Ordered rules. The first two have exact lengths, the others repeat.
SEQUENCE_RULES = [
    {"id": "error_then_purchase", "name": "Error then purchase", "enabled": True, "cep": {"enabled": True, "severity": "HIGH"}, "within": "24h",
     "events": [{"msgId": "MESSAGE_ERROR"}, {"msgId": "MESSAGE_PURCHASE"}]},
    {"id": "three_allowed", "name": "Three allowed in a row", "enabled": True, "cep": {"enabled": True}, "within": "48h",
     "patterns": [{"order": 2, "match": {"conditions": [{"field": "outcome", "op": "eq", "value": "allowed"}]}},
                  {"order": 1, "match": {"conditions": [{"field": "outcome", "op": "eq", "value": "allowed"}]}},
                  {"order": 3, "match": {"conditions": [{"field": "outcome", "op": "eq", "value": "allowed"}]}}]},
    {"id": "allowed_then_blocked", "name": "Two to four allowed, then blocked", "enabled": True, "cep": {"enabled": True, "severity": "LOW"}, "within": "96h",
     "patterns": [{"order": 1, "match": {"conditions": [{"field": "outcome", "op": "eq", "value": "allowed"}]}, "quantifier": {"min": 2, "max": 4}},
                  {"order": 2, "match": {"conditions": [{"field": "outcome", "op": "eq", "value": "blocked"}]}}]},
    {"id": "long_allowed_run", "name": "Three or more allowed, then an error", "enabled": True, "cep": {"enabled": True}, "within": "72h",
     "patterns": [{"order": 1, "match": {"conditions": [{"field": "outcome", "op": "eq", "value": "allowed"}]}, "quantifier": {"min": 3}},
                  {"order": 2, "match": {"msgId": "MESSAGE_ERROR"}}]},
]

#: Scoring rules: one per aggregate type, and both logics.
SCORING_RULES = [
    {"id": "blocked_errors", "name": "blocked_errors", "enabled": True, "weight": 5.0, "ueba": {"enabled": True},
     "match": {"msgId": "MESSAGE_ERROR", "logic": "and", "conditions": [{"field": "outcome", "op": "eq", "value": "blocked"}]},
     "aggregate": {"type": "count"}},
    {"id": "purchase_volume", "name": "purchase_volume", "enabled": True, "weight": 0.5, "ueba": {"enabled": True},
     "match": {"msgId": "MESSAGE_PURCHASE"}, "aggregate": {"type": "sum", "field": "fsize"}},
    {"id": "click_spread", "name": "click_spread", "enabled": True, "ueba": {"enabled": True, "weight": 3.0},
     "match": {"msgId": "MESSAGE_CLICK"}, "aggregate": {"type": "cardinality", "field": "k"}},
    {"id": "odd_views", "name": "odd_views", "enabled": True, "weight": 4.0, "ueba": {"enabled": True},
     "match": {"msgId": "MESSAGE_VIEW", "logic": "OR", "conditions": [
         {"field": "hour", "op": "time_range", "start": 22, "end": 6}, {"field": "k", "op": "in", "value": [1, 7, 42]}]}},
]

SETTINGS = {
    "cold_start_min_days": 3,
    "sigma_floor": 0.5,
    "z_threshold": 1.0,
    "weekend_mode": "skip",
    "floor_enabled": True,
    "floor_default": 25.0,
    "multipliers": {"departing": 1.75, "vacation": 1.25, "blacklist": 2.5, "vip": 0.4},
}

"""Schemas of the data model. Python literals only, so they can be shared by tests and jobs."""

from __future__ import annotations

from pyspark.sql import types as T

#: A raw event as producers send it: camel-case keys, open extension map.
RAW_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("@timestamp", T.StringType()),
    T.StructField("msgId", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("appName", T.StringType()),
    T.StructField("userId", T.StringType()),
    T.StructField("cefExtensions", T.MapType(T.StringType(), T.StringType())),
])

#: A normalized event, as the per-day log keeps it. ``extra`` is the JSON text of top-level fields that the schema doesn't
#: name; rules find their values in ``ext``, where a key of the event's own map comes first.
EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("msg_id", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("app_name", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("user_ip", T.StringType()),
    T.StructField("ext", T.MapType(T.StringType(), T.StringType())),
    T.StructField("extra", T.StringType()),
])

_CONDITION = """struct<field:string,op:string,value:string,`values`:array<string>,start:int,`end`:int>"""
_MATCH = f"struct<msgId:string,logic:string,conditions:array<{_CONDITION}>>"
_QUANTIFIER = "struct<min:int,max:int>"

#: The rule document. ``value`` keeps its text: numbers and lists are read from it when a rule is compiled.
RULE_DDL = f"""
    id string, ruleId string, name string, category string, enabled boolean,
    weight double, severity string, logic string, within string, `by` array<string>,
    `match` {_MATCH},
    conditions array<{_CONDITION}>,
    events array<{_MATCH}>,
    patterns array<struct<`order`:int,`match`:{_MATCH},quantifier:{_QUANTIFIER}>>,
    aggregate struct<type:string,field:string,within:string,minCount:bigint,count:struct<min:bigint>>,
    cep struct<enabled:boolean,severity:string>,
    ueba struct<enabled:boolean,weight:double>
"""

ALERT_DDL = """
    alert_id string, rule_id string, rule_name string, severity string,
    user_id string, hostname string, user_ip string, cnt bigint, ts timestamp
"""

PROFILE_DDL = "user_id string, context string, start_date date, end_date date, note string, whitelisted boolean"

BASELINE_DDL = """
    scope string, user_id string, msg_id string,
    mean double, stddev double, sample_days int, updated date
"""

#: Counters of a day, and what rules they are of.
COUNTER_DDL = """
    user_id string, kind string, name string, text string, n bigint, number double, made_by string, day date
"""

SCORE_DDL = """
    user_id string, day date, hour int, ts timestamp, risk_score double, risk_level string, status string,
    rule_score double, rule_scores map<string,double>, anomaly_score double, daily_score double,
    decayed_prev double, prev_score double, event_counts map<string,bigint>, event_values map<string,double>
"""

#: One row of the relational history table that is backfilled into the log.
HISTORY_DDL = """
    log_pk bigint, time timestamp, hostname string, msg_id string, severity string,
    cef_extensions map<string,string>
"""

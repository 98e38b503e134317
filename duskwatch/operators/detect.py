"""Rule detection over a batch of events: one scan for all rules without order."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import FieldColumns
from ..functions.predicates import explode_hits, match
from ..functions.windows import window_start
from ..session import LOCAL_TZ, stage
from .sequence import detect_sequence

Rule = Mapping[str, Any]

#: Kinds answered per event, and kinds answered per window.
ROW_KINDS = ("single", "any")
WINDOW_KINDS = ("threshold", "all")
#: Key columns that are columns of an alert.
_ALERT_KEYS = {"userId": "user_id", "hostname": "hostname", "userIp": "user_ip"}


def of_kind(rules: Sequence[Rule], *kinds: str) -> list[Rule]:
    return [r for r in rules if r["kind"] in kinds]


def _found(rule: Rule, row: Column, tz: str, fields: FieldColumns, kind: str | None) -> Column:
    """``row`` with the matched patterns as bits of ``mask``, or null; for events of a known type."""
    tests = [
        (1 << i, match(p, tz, fields=fields, known_type=kind or "")) for i, p in enumerate(rule["patterns"])
        if not p["msg_id"] or p["msg_id"] == kind
    ]
    if len(tests) == 1:
        bit, test = tests[0]
        return F.when(test, row.withField("mask", F.lit(bit).cast("bigint")))
    mask = functools.reduce(operator.add, [F.when(test, F.lit(bit)).otherwise(F.lit(0)) for bit, test in tests]).cast("bigint")
    return F.when(mask > 0, row.withField("mask", mask))


def _extra_keys(rule: Rule, fields: FieldColumns) -> Column:
    """Values of group keys that no alert column holds."""
    extra = [fields.text(name).cast("string") for name in rule["by"] if name not in _ALERT_KEYS]
    return F.array(*extra).cast("array<string>")


def _types(*rules: Rule) -> list[str] | None:
    """Event types the rules look at, or None when a pattern takes any type."""
    types = {p["msg_id"] for r in rules for p in r["patterns"]}
    return None if None in types or "" in types else sorted(types)


def matches(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ) -> DataFrame:
    """One row per (event, rule) that matches, from one scan of the events.

    Each event builds the array of rules of its type that it satisfies and
    explodes it, so most events cost a few comparisons and emit nothing.
    """
    types = _types(*rules)
    if types is not None:
        events = events.where(F.col("msg_id").isin(types))
    fields, parts = FieldColumns(tz), []
    for rule in rules:
        in_key = rule["kind"] in ROW_KINDS or "userId" in rule["by"]
        row = F.struct(
            F.lit(rule["rule_id"]).alias("rule_id"),
            F.lit(0).cast("bigint").alias("mask"),
            (F.col("user_id") if in_key else F.lit(None)).cast("string").alias("user_id"),
            _extra_keys(rule, fields).alias("by_values"),
        )
        parts.append((_types(rule), lambda kind, rule=rule, row=row: _found(rule, row, tz, fields, kind)))
    keep = ("event_id", "ts", "hostname", "user_ip")
    return explode_hits(events, parts, fields, *keep).select(*keep, "hit.*")


def by_rule(values: Mapping[str, Any]) -> Column:
    """A value of the rule a row belongs to, from a literal map: rule constants need not travel with the rows."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("rule_id")]


def row_matches(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Single patterns and alternatives: one match per event."""
    return found.where(F.col("rule_id").isin([r["rule_id"] for r in of_kind(rules, *ROW_KINDS)])).select(
        "rule_id", "user_id", "hostname", "user_ip", F.lit(1).cast("bigint").alias("cnt"), "ts",
        F.concat_ws("|", "event_id").alias("origin"),
    )


def reached(grouped: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Windows that fulfil their rule: the minimum count, and every pattern seen (a threshold has one)."""
    least = by_rule({r["rule_id"]: int(r["min_count"] or 1) for r in rules})
    needed = by_rule({r["rule_id"]: (1 << len(r["patterns"])) - 1 for r in rules})
    return grouped.where((F.col("cnt") >= least) & (F.col("seen") == needed))


WINDOW_KEYS = ["rule_id", "user_id", "hostname", "user_ip", "by_values"]


def window_matches(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Thresholds and co-occurrences of every width in one aggregate.

    The window start is computed from the rule's own width, so rules with
    different widths share one scan and one shuffle, and counts are combined on
    the map side before it: a hot user costs one row per task and window.
    """
    mine = of_kind(rules, *WINDOW_KINDS)
    width = by_rule({r["rule_id"]: int(r["within_s"]) for r in mine})
    grouped = (
        found.where(F.col("rule_id").isin([r["rule_id"] for r in mine]))
        .groupBy(*WINDOW_KEYS, window_start("ts", width).alias("start"))
        .agg(F.count("*").alias("cnt"), F.bit_or("mask").alias("seen"))
    )
    return reached(grouped, mine).select(
        "rule_id", "user_id", "hostname", "user_ip", "cnt",
        F.timestamp_seconds(F.col("start") + width).alias("ts"),
        F.concat_ws("|", "start", F.concat_ws("|", "by_values")).alias("origin"),
    )


def to_alerts(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Alert rows. The id depends on rule, key and window or event, so a replay writes the same ids."""
    # A null and an empty key must not share an id, hence the marks around each value.
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("rule_id", "user_id", "hostname", "user_ip", "origin")]
    return found.select(
        F.md5(F.concat_ws("|", *parts)).alias("alert_id"),
        "rule_id",
        by_rule({r["rule_id"]: r["name"] for r in rules}).alias("rule_name"),
        by_rule({r["rule_id"]: r["severity"] for r in rules}).alias("severity"),
        "user_id", "hostname", "user_ip", "cnt", "ts",
    )


def detect_filter(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ) -> DataFrame:
    """Rules with one pattern: an alert per matching event."""
    mine = of_kind(rules, "single")
    return to_alerts(row_matches(matches(events, mine, tz), mine), mine)


def detect_any(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ) -> DataFrame:
    """Alternatives: an alert per event that matches any pattern of a rule, once."""
    mine = of_kind(rules, "any")
    return to_alerts(row_matches(matches(events, mine, tz), mine), mine)


def detect_threshold(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ) -> DataFrame:
    """Counts per key and tumbling window that reach the rule's minimum."""
    mine = of_kind(rules, "threshold")
    return to_alerts(window_matches(matches(events, mine, tz), mine), mine)


def detect_all(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ) -> DataFrame:
    """Windows in which a key shows every pattern of a rule."""
    mine = of_kind(rules, "all")
    return to_alerts(window_matches(matches(events, mine, tz), mine), mine)


def detect(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ) -> DataFrame:
    """Alerts of all rules.

    Rules without order share one scan; when both per-event and per-window rules
    are present, the (much smaller) table of matches is written once and read by
    both branches. Ordered rules need every event of a key and scan once more.
    """
    rows, windows = of_kind(rules, *ROW_KINDS), of_kind(rules, *WINDOW_KINDS)
    ordered = of_kind(rules, "sequence")
    parts = []
    if rows or windows:
        found = matches(events, [*rows, *windows], tz)
        if rows and windows:
            found = stage(found, "matches")
        parts += [row_matches(found, rows)] if rows else []
        parts += [window_matches(found, windows)] if windows else []
    if ordered:
        parts.append(detect_sequence(events, ordered, tz))
    if not parts:
        raise ValueError("no rule can match: every rule is empty")
    return to_alerts(functools.reduce(DataFrame.unionByName, parts), [*rows, *windows, *ordered])


def backtest(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ) -> DataFrame:
    """What rules would have raised over stored history: alerts, matched events and users per rule.

    Rules that never match are listed with zeros.
    """
    alerts = detect(events, rules, tz)
    # Users first, so that the distinct count needs no second pass over the alerts of a hot user.
    per_user = alerts.groupBy("rule_id", "user_id").agg(F.count("*").alias("alerts"), F.sum("cnt").alias("matched"))
    counted = per_user.groupBy("rule_id").agg(
        F.sum("alerts").alias("alerts"), F.sum("matched").alias("matched"), F.count("user_id").alias("users")
    )
    listed = events.sparkSession.createDataFrame([(r["rule_id"],) for r in rules], "rule_id string")
    zero = F.lit(0).cast("bigint")
    return listed.join(counted, "rule_id", "left").select(
        "rule_id", *[F.coalesce(c, zero).alias(c) for c in ("alerts", "matched", "users")]
    )

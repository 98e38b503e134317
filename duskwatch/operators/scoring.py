"""Risk scoring of users for one day."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import round2
from ..functions.predicates import midnight, on_days
from ..session import LOCAL_TZ, broadcast_if_small, stage
from . import behaviour

#: Contexts with a meaning of their own.
NORMAL, BLACKLIST = "normal", "blacklist"


#: Sections of a settings document, with the fields that are named otherwise here.
_SECTIONS = {"anomaly": {}, "decay": {}, "tiers": {}, "floor_score": {"enabled": "floor_enabled", "default": "floor_default"}}


@dataclasses.dataclass(frozen=True)
class Settings:
    """Scoring settings; the defaults are fixed values."""

    z_threshold: float = 2.0
    beta: float = 10.0
    sigma_floor: float = 0.5
    cold_start_min_days: int = 7
    baseline_window_days: int = 7
    frequency_function: str = "log"
    decay: float = 0.9
    weekend_mode: str = ""
    green_max: float = 40.0
    yellow_max: float = 99.0
    floor_enabled: bool = False
    floor_default: float = 0.0
    multipliers: Mapping[str, float] = dataclasses.field(default_factory=dict)

    @classmethod
    def of(cls, **given: Any) -> Settings:
        """Settings with defaults for every value that is missing or null."""
        if "lambda" in given:
            given["decay"] = given.pop("lambda")
        return cls(**{k: v for k, v in given.items() if v is not None})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Settings:
        """Settings document (JSON), grouped in sections or flat; an absent field takes its default, an unknown one is refused."""
        rows = spark.read.text(path, wholetext=True).collect()
        return cls.parse(json.loads(rows[0]["value"]) if rows else {})

    @classmethod
    def parse(cls, document: Mapping[str, Any]) -> Settings:
        given: dict[str, Any] = {}
        for name, value in document.items():
            if name == "multipliers":
                given[name] = {k: m.get("multiplier") if isinstance(m, Mapping) else m for k, m in (value or {}).items()}
            elif name in _SECTIONS:
                given |= {_SECTIONS[name].get(k, k): v for k, v in (value or {}).items()}
            else:
                given[name] = value
        known = {f.name for f in dataclasses.fields(cls)} | {"lambda"}
        if strange := sorted(set(given) - known):
            raise ValueError(f"unknown settings: {', '.join(strange)}")
        return cls.of(**given)


def frequency(value: Column, mode: str) -> Column:
    """Damping of a rule value."""
    if mode == "log2":
        return F.log2(F.lit(1.0) + value)
    if mode == "log10":
        return F.log10(F.lit(1.0) + value)
    if mode == "linear":
        return value
    return F.log1p(value)


def effective_context(day: Column) -> Column:
    """Context of a profile row on ``day``: outside its period, or without profile, it is normal."""
    off = (F.col("start_date") > day) | (F.col("end_date") < day)
    return F.when(off, NORMAL).otherwise(F.coalesce("context", F.lit(NORMAL)))


def multiplier(context: Column, multipliers: Mapping[str, float]) -> Column:
    """Weight of a context; normal, empty and unknown contexts weigh one."""
    out = F.lit(1.0)
    for name, weight in multipliers.items():
        if name not in ("", NORMAL):
            out = F.when(context == name, F.lit(float(weight))).otherwise(out)
    return out


def effective_days(days: Column, as_of: Column, mode: str) -> Column:
    """Elapsed days; mode ``skip`` leaves out weekends when more than one day passed. At least one.

    The weekdays are counted by whole weeks plus a rest of at most six days, so
    a long absence costs no long array.
    """
    days = F.greatest(days, F.lit(1)).cast("int")
    if mode != "skip":
        return days
    # The days as_of-1 … as_of-days: whole weeks hold five working days each.
    rest = days % 7
    working = F.floor(days / 7).cast("int") * 5
    for back in range(1, 7):
        weekday = F.dayofweek(F.date_sub(as_of, back))
        working = working + F.when((rest >= back) & ~weekday.isin(1, 7), 1).otherwise(0)
    return F.when(days > 1, F.greatest(working, F.lit(1))).otherwise(days)


def decayed(prev: Column, days: Column, decay: float) -> Column:
    return prev * F.pow(F.lit(decay), days)


def classify(score: Column, green_max: float, yellow_max: float) -> Column:
    return F.when(score > yellow_max, "HIGH").when(score > green_max, "MEDIUM").otherwise("LOW")


def with_context(users: DataFrame, profiles: DataFrame, settings: Settings, day: Column) -> DataFrame:
    """Add effective context, multiplier and whitelist flag. Users without profile are normal."""
    kept = profiles.select("user_id", "context", "start_date", "end_date", "whitelisted")
    context = effective_context(day)
    return users.join(kept, "user_id", "left").withColumns({
        "effective_context": context,
        "multiplier": multiplier(context, settings.multipliers),
        "whitelisted": F.coalesce("whitelisted", F.lit(False)),
    }).drop("context", "start_date", "end_date")


def unique_names(rules: Sequence[Mapping[str, Any]]) -> dict[str, str]:
    """Rule id -> name as used in score maps; a repeated name gets its id added, so that map keys stay unique."""
    names = [r["name"] for r in rules]
    return {r["rule_id"]: r["name"] if names.count(r["name"]) == 1 else f"{r['name']} ({r['rule_id']})" for r in rules}


def literal_map(pairs: Mapping[str, Any]) -> Column:
    if not pairs:  # an untyped map can't be looked up in
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def weighted(values: DataFrame, rules: Sequence[Mapping[str, Any]], mode: str) -> DataFrame:
    """Add the rule's name and ``points`` = weight · f(value). Values of zero score nothing."""
    weights = literal_map({r["rule_id"]: float(r["weight"]) for r in rules})
    names = literal_map(unique_names(rules))
    return values.where(F.col("value") > 0).withColumns({
        "name": names[F.col("rule_id")],
        "points": weights[F.col("rule_id")] * frequency(F.col("value"), mode),
    })


def rule_scores(values: DataFrame, rules: Sequence[Mapping[str, Any]], profiles: DataFrame, settings: Settings, as_of: str) -> DataFrame:
    """Per user: unrounded rule score, rounded score per rule, and the rule values.

    The maps hold one entry per rule, so the groups are bounded by the rule list.
    """
    per_user = rule_points(values, rules, settings.frequency_function)
    return with_context(per_user, profiles, settings, F.lit(as_of).cast("date")).select(
        "user_id", (F.col("points") * F.col("multiplier")).alias("rule_raw"), _each_rule().alias("rule_scores"), "event_values"
    )


def rule_points(values: DataFrame, rules: Sequence[Mapping[str, Any]], mode: str) -> DataFrame:
    """Points per user, in all and per rule, before the user's multiplier."""
    return weighted(values, rules, mode).groupBy("user_id").agg(
        F.sum("points").alias("points"),
        F.collect_list(F.struct("name", "points")).alias("each"),
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("event_values"),
    )


def _each_rule() -> Column:
    return F.map_from_entries(F.transform("each", lambda x: F.struct(x["name"], round2(x["points"] * F.col("multiplier")))))


def lookup_baseline(counts: DataFrame, known: DataFrame, as_of: str, days: int) -> DataFrame:
    """Counts with the user's own baseline, or the global one when it is missing or older than ``days``."""
    fields = ("mean", "stddev", "sample_days")
    fresh = F.datediff(F.lit(as_of).cast("date"), "updated") <= days
    own = known.where((F.col("scope") == "user") & F.coalesce(fresh, F.lit(True))).select(
        "user_id", "msg_id", F.struct(*fields).alias("own")
    )
    # One row per event type. Shuffling the counts by type would send a third of them to one task.
    common = broadcast_if_small(known.where(F.col("scope") == "global").select("msg_id", F.struct(*fields).alias("common")))
    both = counts.join(own, ["user_id", "msg_id"], "left").join(common, "msg_id", "left")
    source = F.when(F.col("own").isNotNull(), "user").when(F.col("common").isNotNull(), "global")
    return both.select(*counts.columns, F.coalesce("own", "common").alias("b"), source.alias("baseline_scope")).select(
        *counts.columns, "b.*", "baseline_scope"
    )


def anomaly_points(settings: Settings) -> Column:
    """β·(z − threshold) where the count is unusual. Needs ``cnt, mean, stddev, sample_days``."""
    z = (F.col("cnt") - F.col("mean")) / F.greatest(F.col("stddev"), F.lit(settings.sigma_floor))
    usable = (F.col("sample_days") >= settings.cold_start_min_days) & (F.col("mean") >= 1)
    return F.when(usable & (z > settings.z_threshold), F.lit(settings.beta) * (z - settings.z_threshold)).otherwise(0.0)


def anomaly_scores(counts: DataFrame, known: DataFrame, settings: Settings, as_of: str, only_types: Sequence[str] | None = None) -> DataFrame:
    """Per user: unrounded anomaly score and the day's counts per type.

    ``only_types`` limits the score to event types that have rules.
    """
    looked_up = lookup_baseline(counts.select("user_id", "msg_id", "cnt"), known, as_of, settings.baseline_window_days)
    points = anomaly_points(settings)
    if only_types is not None:
        points = F.when(F.col("msg_id").isin(list(only_types)), points).otherwise(0.0)
    return looked_up.groupBy("user_id").agg(
        F.sum(points).alias("anomaly_raw"),
        F.map_from_entries(F.collect_list(F.struct("msg_id", "cnt"))).alias("event_counts"),
    )


def best_sample_days(known: DataFrame) -> DataFrame:
    """Most sample days of any own baseline per user."""
    return known.where(F.col("scope") == "user").groupBy("user_id").agg(F.max("sample_days").alias("best_days"))


def is_cold(prev: Column, best_days: Column, min_days: int) -> Column:
    """A user without previous score whose history is too short."""
    return ~(prev > 0) & (F.coalesce(best_days, F.lit(0)) < min_days)


def status(cold: Column, best_days: Column) -> Column:
    return F.when(cold, "cold_start").when(best_days.isNull(), "no_baseline").otherwise("active")


def prev_scores(scores: DataFrame, as_of: str, now: dt.datetime | None = None, tz: str = LOCAL_TZ) -> DataFrame:
    """Newest score before the local day ``as_of`` per user, with the days since.

    Days are counted up to ``now``, by default the start of the day, so a score
    of yesterday is one day old. A newest score of zero or less counts as none:
    score 0, one day.
    """
    newest = scores.where(F.col("ts") < F.lit(midnight(as_of, tz))).groupBy("user_id").agg(
        F.max(F.struct("ts", "risk_score")).alias("s")
    )
    return previous_of(newest.select("user_id", "s.*"), as_of, now, tz)


def previous_of(newest: DataFrame, as_of: str, now: dt.datetime | None = None, tz: str = LOCAL_TZ) -> DataFrame:
    """``prev_scores`` from one row per user, the newest before the day."""
    elapsed = F.unix_micros(F.lit(now or midnight(as_of, tz))) - F.unix_micros("ts")
    score, days = F.col("risk_score"), F.greatest(F.floor(elapsed / F.lit(24 * 3600 * 1_000_000)).cast("int") + 1, F.lit(1))
    return newest.select(
        "user_id",
        F.when(score > 0, score).otherwise(0.0).alias("prev_score"),
        F.when(score > 0, days).otherwise(1).cast("int").alias("days_since"),
    )


def combine(rows: DataFrame, settings: Settings, day: Column) -> DataFrame:
    """The daily formula over one row per user with its inputs.

    Needs ``prev_score, days_since, rule_raw, anomaly_raw, best_days,
    effective_context, whitelisted``. Unrounded parts are summed and rounded once.
    """
    away = effective_days(F.col("days_since"), day, settings.weekend_mode)
    base = decayed(F.col("prev_score"), away, settings.decay)
    cold = ~F.col("whitelisted") & is_cold(F.col("prev_score"), F.col("best_days"), settings.cold_start_min_days)
    lifted = base
    if settings.floor_enabled:
        lifted = F.when(F.col("effective_context") == BLACKLIST, F.greatest(base, F.lit(settings.floor_default))).otherwise(base)
    risk = (
        F.when(F.col("whitelisted"), round2(base))
        .when(cold, 0.0)
        .otherwise(round2(lifted + F.col("rule_raw") + F.col("anomaly_raw")))
    )
    scored = F.when(F.col("whitelisted"), 0.0)
    rule, anomaly = scored.otherwise(round2(F.col("rule_raw"))), scored.otherwise(round2(F.col("anomaly_raw")))
    return rows.withColumns({
        "risk_score": risk,
        "risk_level": classify(risk, settings.green_max, settings.yellow_max),
        "status": status(cold, F.col("best_days")),
        "rule_score": rule,
        "anomaly_score": anomaly,
        "daily_score": rule + anomaly,
        "decayed_prev": round2(base),
    })


def daily_risk(
    counts: DataFrame, values: DataFrame, rules: Sequence[Mapping[str, Any]], known: DataFrame,
    profiles: DataFrame, previous: DataFrame, settings: Settings, as_of: str,
) -> DataFrame:
    """Score rows of one day for every user with events or with a previous score.

    Every join is on the user, with one row per user on both sides, so no user
    can make one task large.
    """
    day = F.lit(as_of).cast("date")
    points = rule_points(values, rules, settings.frequency_function)
    unusual = anomaly_scores(counts, known, settings, as_of)
    carried = previous.where(F.col("prev_score") > 0)
    rows = (
        unusual.join(points, "user_id", "left")
        .join(carried, "user_id", "full_outer")
        .join(best_sample_days(known), "user_id", "left")
        .fillna({"points": 0.0, "anomaly_raw": 0.0, "prev_score": 0.0, "days_since": 1})
    )
    placed = with_context(rows, profiles, settings, day)
    out = combine(placed.withColumn("rule_raw", F.col("points") * F.col("multiplier")), settings, day)
    no_scores, no_counts = F.create_map().cast("map<string,double>"), F.create_map().cast("map<string,bigint>")
    return out.select(
        "user_id", day.alias("day"), "risk_score", "risk_level", "status", "rule_score",
        F.when(F.col("whitelisted"), no_scores).otherwise(F.coalesce(_each_rule(), no_scores)).alias("rule_scores"),
        "anomaly_score", "daily_score", "decayed_prev", "prev_score",
        F.coalesce("event_counts", no_counts).alias("event_counts"),
        F.coalesce("event_values", no_scores).alias("event_values"),
    )


def score_day(
    events: DataFrame, rules: Sequence[Mapping[str, Any]], known: DataFrame, profiles: DataFrame,
    previous: DataFrame, settings: Settings, as_of: str, tz: str = LOCAL_TZ,
) -> DataFrame:
    """``daily_risk`` from the events of the day.

    The day is scanned once: its counters, a small table, are written and serve
    both the event counts and the rule values.
    """
    today = events.where(on_days("ts", as_of, tz=tz))
    stored = stage(behaviour.counters(today, rules, tz), "counters")
    counts, values = behaviour.counted_types(stored), behaviour.counted_values(stored)
    return daily_risk(counts, values, rules, known, profiles, previous, settings, as_of)


def score_delta(scores: DataFrame, as_of: str) -> DataFrame:
    """Last score of the day and of the day before per user, and the difference."""
    day = F.lit(as_of).cast("date")
    last = (
        scores.where(F.col("day").between(F.date_sub(day, 1), day))
        .groupBy("user_id", "day")
        .agg(F.max(F.struct("ts", "risk_score"))["risk_score"].alias("score"))
        .groupBy("user_id")
        .agg(
            F.max(F.when(F.col("day") == day, F.col("score"))).alias("risk_score"),
            F.max(F.when(F.col("day") < day, F.col("score"))).alias("prev_day_score"),
        )
    )
    return last.where("risk_score is not null").select(
        "user_id", "risk_score", F.coalesce("prev_day_score", F.lit(0.0)).alias("prev_day_score"),
        (F.col("risk_score") - F.coalesce("prev_day_score", F.lit(0.0))).alias("score_diff"),
    )


def refresh_profiles(profiles: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Profiles whose period is over fall back to normal; users without profile get a normal one."""
    day = F.lit(as_of).cast("date")
    over = F.coalesce((F.col("end_date") < day) & (F.col("context") != NORMAL), F.lit(False))
    kept = profiles.select(
        "user_id",
        F.when(over, NORMAL).otherwise(F.col("context")).alias("context"),
        F.when(~over, F.col("start_date")).alias("start_date"),
        F.when(~over, F.col("end_date")).alias("end_date"),
        F.when(~over, F.col("note")).alias("note"),
        "whitelisted",
    )
    fresh = users.select("user_id").distinct().join(profiles.select("user_id"), "user_id", "left_anti")
    nothing = F.lit(None)
    return kept.unionByName(fresh.select(
        "user_id", F.lit(NORMAL).alias("context"), nothing.cast("date").alias("start_date"),
        nothing.cast("date").alias("end_date"), nothing.cast("string").alias("note"), F.lit(False).alias("whitelisted"),
    ))

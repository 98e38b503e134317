"""Report queries over events, alerts and scores. Limits here are the size of a report page, not caps on the data."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field, local, local_day
from ..functions.predicates import last_days, midnight, on_days, text_search
from ..session import LOCAL_TZ
from ..sources.stores import latest_per_key
from . import scoring
from .normalize import display_type, event_report_columns
from .ordering import with_positions
from .scoring import Settings

#: Severities and levels a dashboard always lists.
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
#: Rows up to which a page is taken from a top-k.
TOP_K_ROWS = 10_000


def top_terms(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Most frequent values with counts; equal counts in order of the value."""
    counted = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("cnt"))
    ordered = counted.orderBy(F.desc("cnt"), col)
    return ordered if n is None else ordered.limit(n)


def bucket(ts: Column | str, unit: str, tz: str = LOCAL_TZ) -> Column:
    """Local day or hour that holds an instant, as a wall clock."""
    return F.date_trunc(unit, local(ts, tz)).cast("timestamp_ntz")


def date_histogram(df: DataFrame, unit: str, first: str | None = None, last: str | None = None, tz: str = LOCAL_TZ) -> DataFrame:
    """Rows per local day or hour. With bounds, empty buckets of the local days are listed with zero."""
    if first is not None:
        df = df.where(on_days("ts", first, last, tz))
    counted = df.groupBy(bucket("ts", unit, tz).alias("bucket")).agg(F.count("*").alias("cnt"))
    if first is None:
        return counted
    return filled(counted, unit, first, last or first).select("bucket", F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt"))


def filled(counted: DataFrame, unit: str, first: str, last: str) -> DataFrame:
    """Every bucket of the days, with the columns of ``counted`` where it has a row."""
    start = F.lit(first).cast("timestamp_ntz")
    stop = F.lit(last).cast("timestamp_ntz") + F.expr("interval 1 day") - F.expr(f"interval 1 {unit}")
    axis = counted.sparkSession.range(1).select(F.explode(F.sequence(start, stop, F.expr(f"interval 1 {unit}"))).alias("bucket"))
    return axis.join(counted, "bucket", "left")


def daily_scores(scores: DataFrame, as_of: str, days: int = 7, tz: str = LOCAL_TZ) -> DataFrame:
    """Highest score per user on each of the last days, zero where there is none."""
    recent = scores.where(last_days("ts", as_of, days, tz))
    best = recent.groupBy("user_id", local_day("ts", tz).alias("day")).agg(F.max("risk_score").alias("score"))
    end = F.lit(as_of).cast("date")
    axis = F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day")
    users = best.select("user_id").distinct().select("user_id", axis)
    return users.join(best, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("score", F.lit(0.0)).alias("score"))


def hourly_scores(scores: DataFrame, as_of: str, tz: str = LOCAL_TZ) -> DataFrame:
    """Highest rule, anomaly and decayed score per user and hour of the day; rows without rule score are left out."""
    today = scores.where(on_days("ts", as_of, tz=tz) & F.col("rule_score").isNotNull())
    return today.groupBy("user_id", F.hour(local("ts", tz)).alias("hour")).agg(
        F.max("rule_score").alias("rule_score"), F.max("anomaly_score").alias("anomaly_score"),
        F.max("decayed_prev").alias("decay_score"),
    )


def score_history(scores: DataFrame, as_of: str, user: str | None = None, tz: str = LOCAL_TZ) -> dict[str, DataFrame]:
    """Seven days and the hours of the day, for one user or for all."""
    mine = scores if user is None else scores.where(F.col("user_id") == user)
    return {"daily": daily_scores(mine, as_of, tz=tz), "hourly": hourly_scores(mine, as_of, tz)}


def stats(day_counts: DataFrame, baselines: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: users and events of the day, stored baselines, active rules."""
    zero = F.lit(0).cast("bigint")
    per_user = day_counts.groupBy("user_id").agg(F.sum("cnt").alias("cnt"))
    parts = [
        per_user.agg(F.count("*").alias("users"), F.coalesce(F.sum("cnt"), zero).alias("events"), zero.alias("baselines"), zero.alias("rules")),
        baselines.agg(zero.alias("users"), zero.alias("events"), F.count("*").alias("baselines"), zero.alias("rules")),
        rules.agg(zero.alias("users"), zero.alias("events"), zero.alias("baselines"), F.count("*").alias("rules")),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.agg(*[F.sum(c).alias(c) for c in ("users", "baselines", "rules", "events")])


def level_counts(scores: DataFrame) -> DataFrame:
    """Users per level; the known levels are columns."""
    return scores.agg(*[F.count_if(F.col("risk_level") == level).alias(level.lower()) for level in LEVELS])


class Page(NamedTuple):
    """Rows of a page, and a one-row table with the number of all rows."""

    rows: DataFrame
    total: DataFrame


def page(df: DataFrame, order: str, descending: bool = True, start: int = 0, length: int = 10, tie: str = "event_id") -> Page:
    """A page of sorted rows. The tie column makes the order, and so the pages, stable.

    First pages are a top-k: each task keeps the few rows that can be on the
    page. Far pages number all rows in order instead, so that no task and not
    the driver holds the rows before the page.
    """
    by = [F.desc(order) if descending else F.asc(order), F.asc(tie)]
    if start + length <= TOP_K_ROWS:
        rows = df.orderBy(*by).offset(start).limit(length)
    else:
        placed = with_positions(df, *by, pos="_pos")
        inside = (F.col("_pos") >= start) & (F.col("_pos") < start + length)
        rows = placed.where(inside).orderBy("_pos").drop("_pos")
    return Page(rows, df.agg(F.count("*").alias("total")))


def alert_report(
    alerts: DataFrame, first: str, last: str | None = None, search: str = "", rule: str = "", severity: str = "",
    order: str = "ts", descending: bool = True, start: int = 0, length: int = 10, tz: str = LOCAL_TZ,
) -> Page:
    """Alerts of a range of days that hold the text, with the rule and severity."""
    found = alerts.where(on_days("ts", first, last, tz) & text_search(search, "user_id", "rule_name", "hostname"))
    if rule:
        found = found.where(F.col("rule_id") == rule)
    if severity:
        found = found.where(F.col("severity") == severity)
    return page(found, order, descending, start, length, tie="alert_id")


def log_report(
    events: DataFrame, as_of: str, search: str = "", msg_id: str = "", outcome: str = "",
    order: str = "ts", descending: bool = True, start: int = 0, length: int = 15, tz: str = LOCAL_TZ,
) -> Page:
    """Events of the day that hold the text, of a type and outcome (in either place)."""
    places = ["msg_id", "user_id", "hostname", F.col("ext")["suid"], F.col("ext")["shost"]]
    found = events.where(on_days("ts", as_of, tz=tz) & text_search(search, *places))
    if msg_id:
        found = found.where(F.col("msg_id") == msg_id)
    if outcome:
        own = [F.col("outcome") == outcome] if "outcome" in events.columns else []
        hit = F.col("ext")["outcome"] == outcome
        for o in own:
            hit = hit | o
        found = found.where(hit)
    return page(event_report_columns(found), order, descending, start, length)


def with_user_context(users: DataFrame, profiles: DataFrame, settings: Settings, as_of: str) -> DataFrame:
    """Rows of users with ``context``, the one in effect on the day (empty without profile), and ``multiplier``, its weight."""
    context = scoring.effective_context(F.lit(as_of).cast("date"))
    known = profiles.select("user_id", context.alias("context"), scoring.multiplier(context, settings.multipliers).alias("multiplier"))
    found = users.join(known, "user_id", "left")
    return found.withColumns({"context": F.coalesce("context", F.lit("")), "multiplier": F.coalesce("multiplier", F.lit(1.0))})


def user_list(
    scores: DataFrame, profiles: DataFrame, settings: Settings, as_of: str, search: str = "", level: str = "", order: str = "risk_score",
    descending: bool = True, start: int = 0, length: int = 10, tz: str = LOCAL_TZ,
) -> Page:
    """Users by their latest score, with its rule part and the context in effect on the day.

    Scores after the day are left out. Contexts are looked up for the rows of the page alone.
    """
    slim = scores.where(F.col("ts") < F.lit(midnight(as_of, tz, 1))).where(text_search(search, "user_id"))
    newest = latest_per_key(slim.select("user_id", "risk_score", "risk_level", "prev_score", "rule_score", "status", "ts"), ["user_id"], "ts")
    if level:
        newest = newest.where(F.col("risk_level") == level)
    newest = newest.withColumn("score_diff", F.col("risk_score") - F.col("prev_score"))
    found = page(newest, order, descending, start, length, tie="user_id")
    by = [F.desc(order) if descending else F.asc(order), F.asc("user_id")]
    return Page(with_user_context(found.rows, profiles, settings, as_of).orderBy(*by), found.total)


def user_report(
    scores: DataFrame, search: str = "", level: str = "", order: str = "risk_score",
    descending: bool = True, start: int = 0, length: int = 10,
) -> Page:
    """Latest score per user, filtered and sorted."""
    slim = scores.select("user_id", "risk_score", "risk_level", "prev_score", "status", "ts")
    newest = latest_per_key(slim.where(text_search(search, "user_id")), ["user_id"], "ts")
    if level:
        newest = newest.where(F.col("risk_level") == level)
    newest = newest.withColumn("score_diff", F.col("risk_score") - F.col("prev_score"))
    return page(newest, order, descending, start, length, tie="user_id")


def of_user(user: str) -> Column:
    """Events of a user, named in the event or in its extension map."""
    return (F.col("user_id") == user) | (F.col("ext")["suid"] == user)


def user_detail(events: DataFrame, alerts: DataFrame, scores: DataFrame, user: str, as_of: str, newest: int = 50, tz: str = LOCAL_TZ) -> dict[str, DataFrame]:
    """Newest alerts and events of a user on a day, and the values of their latest score row."""
    today = on_days("ts", as_of, tz=tz)
    mine = scores.where(F.col("user_id") == user).orderBy(F.desc("ts")).limit(1)
    out = {
        "alerts": alerts.where((F.col("user_id") == user) & today).orderBy(F.desc("ts"), "alert_id").limit(newest),
        "logs": events.where(today & of_user(user)).orderBy(F.desc("ts"), "event_id").limit(newest),
        "summary": mine,
    }
    if "event_values" in scores.columns:
        values = mine.select(F.explode("event_values").alias("name", "value"))
        out["values"] = values.where("value > 0").orderBy("name")
    return out


def dashboard(events: DataFrame, alerts: DataFrame, scores: DataFrame, as_of: str, tz: str = LOCAL_TZ) -> dict[str, DataFrame]:
    """The parts of the start page for one day."""
    today = on_days("ts", as_of, tz=tz)
    alerts_today, events_today = alerts.where(today), events.where(today)
    latest = latest_per_key(scores.select("user_id", "risk_score", "risk_level", "prev_score", "status", "ts"), ["user_id"], "ts")
    users = latest.withColumn("score_diff", F.col("risk_score") - F.col("prev_score"))
    return {
        "severities": top_terms(alerts_today, "severity"),
        "rules": top_terms(alerts_today, "rule_name", 10),
        "levels": level_counts(latest),
        "users": users.orderBy(F.desc("risk_score"), F.desc("score_diff"), "user_id").limit(10),
        "recent": alerts.orderBy(F.desc("ts"), "alert_id").limit(10),
        "types": top_terms(events_today, "msg_id", 20),
        "total": events_today.agg(F.count("*").alias("total")),
    }


def type_totals(events: DataFrame, as_of: str, n: int = 20, tz: str = LOCAL_TZ) -> DataFrame:
    """Most frequent event types of a day under their display name."""
    today = events.where(on_days("ts", as_of, tz=tz))
    return top_terms(today.withColumn("type", display_type("msg_id")), "type", n)


def profile_report(profiles: DataFrame, settings: Settings, as_of: str) -> DataFrame:
    """Profiles with configured and effective context, weight and period, by user."""
    context = scoring.effective_context(F.lit(as_of).cast("date"))
    return profiles.select(
        "user_id", "context", context.alias("effective_context"),
        scoring.multiplier(context, settings.multipliers).alias("multiplier"),
        "start_date", "end_date", "note", F.coalesce("whitelisted", F.lit(False)).alias("whitelisted"),
    ).orderBy("user_id")


def distinct_values(events: DataFrame, name: str, tz: str = LOCAL_TZ) -> DataFrame:
    """Values of a rule field with counts."""
    return top_terms(events.select(field(name, tz).alias("value")), "value")


def user_hourly(events: DataFrame, as_of: str, tz: str = LOCAL_TZ) -> DataFrame:
    """Events per user and local hour of a day."""
    today = events.where(on_days("ts", as_of, tz=tz))
    return today.groupBy("user_id", F.hour(local("ts", tz)).alias("hour")).agg(F.count("*").alias("cnt"))

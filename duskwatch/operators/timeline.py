"""Risk of every user over a range of days, each day building on the day before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import round2
from ..functions.predicates import midnight, on_days
from ..session import LOCAL_TZ, broadcast_if_small, stage
from . import behaviour, scoring
from .scoring import Settings


def _until(history: DataFrame, keys: Sequence[str], last: Column) -> DataFrame:
    """Add ``valid_to``: a stored baseline serves until the next one of its key is written."""
    # One row per key and day comes here, so the groups are as long as the range of days.
    nxt = F.lead("as_of").over(Window.partitionBy(*keys).orderBy("as_of"))
    return history.withColumn("valid_to", F.coalesce(F.date_sub(nxt, 1), last))


def _global_history(history: DataFrame) -> DataFrame:
    return history.groupBy("msg_id", "as_of").agg(
        F.avg("mean").alias("mean"), F.avg("stddev").alias("stddev"), F.max("sample_days").alias("sample_days")
    )


def daily_inputs(
    events: DataFrame, rules: Sequence[Mapping[str, Any]], settings: Settings, first: str, last: str, tz: str = LOCAL_TZ,
    carried: DataFrame | None = None,
) -> DataFrame:
    """``(user_id, day, points, anomaly_raw, best_days)`` for every user and day from their first event on.

    The users ``carried`` into the range have all of its days, with events or without.
    """
    n = settings.baseline_window_days
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    # One scan of the range and the days before it; everything below reads the small tables of counters.
    begin = midnight(first, tz, -n).date().isoformat()
    stored = stage(behaviour.counters(events.where(on_days("ts", begin, last, tz)), rules, tz), "counters")
    counts = behaviour.counted_types(stored)
    current = counts.where(F.col("day") >= lo)
    values = behaviour.counted_values(stored.where(F.col("day") >= lo))
    points = scoring.weighted(values, rules, settings.frequency_function).groupBy("user_id", "day").agg(F.sum("points").alias("points"))

    history = stage(_until(behaviour.baseline_history(counts, first, last, n), ["user_id", "msg_id"], hi), "history")
    # A stored baseline answers for its user while it is at most n days old, ...
    own = history.withColumn("day", F.explode(F.sequence("as_of", F.least("valid_to", F.date_add("as_of", n)))))
    # ... and the population's baseline answers after that.
    # (one row per type and day, so it is sent to the counts rather than the counts to it).
    common = _until(_global_history(history), ["msg_id"], hi).withColumn("day", F.explode(F.sequence("as_of", "valid_to")))
    fields = ("mean", "stddev", "sample_days")
    looked_up = (
        current.join(own.select("user_id", "msg_id", "day", F.struct(*fields).alias("own")), ["user_id", "msg_id", "day"], "left")
        .join(broadcast_if_small(common.select("msg_id", "day", F.struct(*fields).alias("common"))), ["msg_id", "day"], "left")
        .select("user_id", "day", "cnt", F.coalesce("own", "common").alias("b"))
        .select("user_id", "day", "cnt", "b.*")
    )
    unusual = looked_up.groupBy("user_id", "day").agg(F.sum(scoring.anomaly_points(settings)).alias("anomaly_raw"))
    stored = history.withColumn("day", F.explode(F.sequence("as_of", "valid_to"))).groupBy("user_id", "day").agg(
        F.max("sample_days").alias("best_days")
    )
    begins = current.select("user_id", "day")
    if carried is not None:
        begins = begins.unionByName(carried.where("user_id IS NOT NULL").select("user_id", lo.alias("day")))
    grid = begins.groupBy("user_id").agg(F.min("day").alias("since")).select(
        "user_id", F.explode(F.sequence("since", hi)).alias("day")
    )
    key = ["user_id", "day"]
    return (
        grid.join(points, key, "left").join(unusual, key, "left").join(stored, key, "left")
        .fillna({"points": 0.0, "anomaly_raw": 0.0})
    )


def risk_timeline(
    events: DataFrame, rules: Sequence[Mapping[str, Any]], profiles: DataFrame, settings: Settings,
    first: str, last: str, tz: str = LOCAL_TZ, previous: DataFrame | None = None,
) -> DataFrame:
    """Score rows per user and day.

    At midnight a day's risk becomes the previous score of the next day and
    decays once. Cold start, floor and rounding make that step non-linear, so
    the days of a user are folded in order. A user has one small row per day in
    the fold, whatever the number of their events. ``previous`` (``user_id``,
    ``prev_score``, a row per user) holds the scores of the day before
    ``first``: users with a score above 0 in it have every day of the range and
    decay on days without events. Without it, and for users not in it, the range
    starts at 0 with the first event.
    """
    carried = None if previous is None else previous.where("prev_score > 0").select("user_id", "prev_score")
    inputs = scoring.with_context(daily_inputs(events, rules, settings, first, last, tz, carried), profiles, settings, F.col("day"))
    step = F.struct(
        "day", (F.col("points") * F.col("multiplier")).alias("rule_raw"), "anomaly_raw", "best_days",
        "whitelisted", (F.col("effective_context") == scoring.BLACKLIST).alias("listed"),
    )
    days = inputs.groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("days"))
    if carried is None:
        days = days.withColumn("start", F.lit(0.0))
    else:
        days = days.join(carried.select("user_id", F.col("prev_score").alias("start")), "user_id", "left").fillna({"start": 0.0})

    def risk_of(prev: Column, d: Column) -> Column:
        base = prev * F.lit(settings.decay)
        cold = ~d["whitelisted"] & scoring.is_cold(prev, d["best_days"], settings.cold_start_min_days)
        lifted = F.when(d["listed"], F.greatest(base, F.lit(settings.floor_default))).otherwise(base) if settings.floor_enabled else base
        return (
            F.when(d["whitelisted"], round2(base)).when(cold, 0.0)
            .otherwise(round2(lifted + d["rule_raw"] + d["anomaly_raw"]))
        )

    # The fold carries the scores alone; the days they belong to are put beside them after it. Element 0 is the start.
    advance = lambda scores, d: F.concat(scores, F.array(risk_of(F.element_at(scores, -1), d)))
    scores = F.aggregate("days", F.array(F.col("start").cast("double")), advance)
    folded = days.select("user_id", "days", scores.alias("scores")).select("user_id", "scores", F.posexplode("days").alias("i", "d"))
    rows = folded.select(
        "user_id", "d.day", "d.rule_raw", "d.anomaly_raw", "d.best_days", "d.whitelisted",
        F.get("scores", F.col("i")).alias("prev_score"), F.get("scores", F.col("i") + 1).alias("risk_score"),
    )
    listed = F.col("whitelisted")
    rule = F.when(listed, 0.0).otherwise(round2(F.col("rule_raw")))
    anomaly = F.when(listed, 0.0).otherwise(round2(F.col("anomaly_raw")))
    cold = ~listed & scoring.is_cold(F.col("prev_score"), F.col("best_days"), settings.cold_start_min_days)
    return rows.select(
        "user_id", "day", "risk_score",
        scoring.classify(F.col("risk_score"), settings.green_max, settings.yellow_max).alias("risk_level"),
        scoring.status(cold, F.col("best_days")).alias("status"),
        rule.alias("rule_score"), anomaly.alias("anomaly_score"), (rule + anomaly).alias("daily_score"),
        round2(F.col("prev_score") * settings.decay).alias("decayed_prev"), "prev_score",
    )

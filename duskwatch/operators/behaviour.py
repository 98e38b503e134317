"""Behaviour per user and day: rule values, event counts and baselines."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import FieldColumns, local_day
from ..functions.predicates import explode_hits, match, on_days
from ..session import LOCAL_TZ, stage

Rule = Mapping[str, Any]


def scorable() -> Column:
    """Behaviour belongs to a user and a type; events without either have none."""
    return (F.length("user_id") > 0) & (F.length("msg_id") > 0)


def of_days(events: DataFrame, first: str | None, last: str | None = None, tz: str = LOCAL_TZ) -> DataFrame:
    """Events of the local days ``first`` to ``last``, by bounds that reach the scan; all events without ``first``."""
    return events if first is None else events.where(on_days("ts", first, last, tz))


def window_counts(events: DataFrame, as_of: str, days: int, tz: str = LOCAL_TZ) -> DataFrame:
    """Counts of the ``days`` days before ``as_of``: what a baseline of that day reads."""
    day = dt.date.fromisoformat(as_of)
    return event_counts(events, tz, (day - dt.timedelta(days=days)).isoformat(), (day - dt.timedelta(days=1)).isoformat())


#: Kind of a counter row that counts events per type; other kinds are aggregate types of rules.
TYPE = "type"


def observations(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ, types: bool = True) -> DataFrame:
    """``(user_id, day, kind, name, text, number)``: what each event adds, for all rules in one scan.

    With ``types`` every event also counts for its type. Only distinct counts
    carry a text, and only sums a number.
    """
    fields, parts = FieldColumns(tz), []
    events = events.where(scorable())
    if types:
        own = F.struct(F.lit(TYPE).alias("kind"), F.col("msg_id").alias("name"), F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("number"))
        parts.append((None, lambda _: own))
    else:
        wanted = sorted({r["scored"]["msg_id"] for r in rules if r["scored"] and r["scored"]["msg_id"]})
        events = events.where(F.col("msg_id").isin(wanted))
    for rule in rules:
        kind, name, spec = rule["agg_type"], rule["agg_field"], rule["scored"]
        if not spec:
            continue
        number = F.coalesce(fields.number(name), F.lit(0.0)) if kind == "sum" and name else F.lit(0.0)
        text = fields.text(name).cast("string") if kind == "cardinality" and name else F.lit(None).cast("string")
        row = F.struct(F.lit(kind).alias("kind"), F.lit(rule["rule_id"]).alias("name"), text.alias("text"), number.alias("number"))
        test = match(spec, tz, require_type=True, fields=fields, known_type=spec["msg_id"])
        parts.append(([spec["msg_id"] or ""], lambda _, test=test, row=row: F.when(test, row)))
    dated = events.withColumn("day", local_day("ts", tz))
    return explode_hits(dated, parts, fields, "user_id", "day").select("user_id", "day", "hit.*")


_COUNTER = ["user_id", "day", "kind", "name", "text"]


def counters(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ, types: bool = True) -> DataFrame:
    """Observations added up per user, day, kind and name (and value, for distinct counts).

    Rows are combined before the shuffle, and a user with very many distinct
    values is spread over tasks by the value.
    """
    return observations(events, rules, tz, types).groupBy(*_COUNTER).agg(F.count("*").alias("n"), F.sum("number").alias("number"))


def merged(parts: DataFrame) -> DataFrame:
    """Counters of several batches as one: a value seen in two batches is one distinct value."""
    return parts.groupBy(*_COUNTER).agg(F.sum("n").alias("n"), F.sum("number").alias("number"))


def definition(rules: Sequence[Rule]) -> str:
    """A name for what the counters of these rules count; weights and names of rules don't change it."""
    parts = [[r["rule_id"], r["scored"], r["agg_type"], r["agg_field"]] for r in rules]
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


#: Registers of a sketch, as a power of two: a relative standard error of about 1.6 percent.
SKETCH_BITS = 12


def sketches(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ, bits: int = SKETCH_BITS) -> DataFrame:
    """Rule counters per user, day, kind and name with distinct values as a sketch: ``(…, n, number, sketch)``.

    There is no row per value, before the shuffle or after it; a sketch has at
    most ``2 ** bits`` registers. Sketches of batches and days add up
    (``merged_sketches``), which estimates alone don't.
    """
    rows = observations(events, rules, tz, types=False).groupBy("user_id", "day", "kind", "name")
    sketch = F.when(F.col("kind") == "cardinality", F.hll_sketch_agg("text", bits))
    return rows.agg(F.count("*").alias("n"), F.sum("number").alias("number"), sketch.alias("sketch"))


def merged_sketches(parts: DataFrame, *keys: str) -> DataFrame:
    """Sketch counters of several batches as one, or of several days or users when ``keys`` leave those out."""
    by = keys or ("user_id", "day", "kind", "name")
    union = F.hll_union_agg("sketch", True)
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("number").alias("number"), F.when(F.count("sketch") > 0, union).alias("sketch")
    )


def sketched_values(stored: DataFrame) -> DataFrame:
    """Sketch counters with ``value`` in place of counts and sketch; ``kind`` has to be among their keys."""
    kind = F.col("kind")
    distinct = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("double")
    value = F.when(kind == "sum", F.col("number")).when(kind == "cardinality", distinct).otherwise(F.col("n").cast("double"))
    return stored.withColumn("value", value).drop("n", "number", "sketch")


def counted_types(stored: DataFrame) -> DataFrame:
    """Events per user, type and day, from counters."""
    per_type = stored.where(F.col("kind") == TYPE).groupBy("user_id", F.col("name").alias("msg_id"), "day")
    return per_type.agg(F.sum("n").cast("bigint").alias("cnt"))


def counted_values(stored: DataFrame) -> DataFrame:
    """Rule values per user and day, from counters of one batch (or ``merged`` ones)."""
    kind = F.col("kind")
    value = F.when(kind == "sum", F.sum("number")).when(kind == "cardinality", F.count("text").cast("double"))
    rules = stored.where(kind != TYPE).groupBy("user_id", "day", "kind", "name")
    return rules.agg(value.otherwise(F.sum("n").cast("double")).alias("value")).select(
        "user_id", F.col("name").alias("rule_id"), "day", "value"
    )


def rule_values(
    events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ, approx: bool = False, first: str | None = None, last: str | None = None
) -> DataFrame:
    """``(user_id, rule_id, day, value)``: count, sum or distinct values of the events a rule matches.

    With ``first`` (and ``last``) only those days are read. ``approx`` estimates distinct counts by sketches, without rows per value.
    """
    events = of_days(events, first, last, tz)
    if not approx:
        return counted_values(counters(events, rules, tz, types=False))
    return sketched_values(sketches(events, rules, tz)).select("user_id", F.col("name").alias("rule_id"), "day", "value")


def event_counts(events: DataFrame, tz: str = LOCAL_TZ, first: str | None = None, last: str | None = None) -> DataFrame:
    """Events per user, type and local day; of the days ``first`` to ``last`` only, if given."""
    return of_days(events, first, last, tz).where(scorable()).groupBy("user_id", "msg_id", local_day("ts", tz).alias("day")).agg(F.count("*").alias("cnt"))


def _moments(keys: Sequence[str], counts: DataFrame, days: Column | None) -> DataFrame:
    """Mean and population deviation of daily counts.

    Days without events between the first and the last active day count as
    zero. They need not exist as rows: with n days, the mean is Σc/n and the
    variance Σc²/n − mean².
    """
    c = F.col("cnt").cast("double")
    span = F.datediff(F.max("day"), F.min("day")) + 1
    sums = counts.groupBy(*keys).agg(
        F.sum(c).alias("s1"), F.sum(c * c).alias("s2"), (span if days is None else days).cast("int").alias("sample_days")
    )
    mean = F.col("s1") / F.col("sample_days")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("sample_days") - mean * mean, F.lit(0.0)))
    return sums.select(*keys, mean.alias("mean"), spread.alias("stddev"), "sample_days")


def baselines(counts: DataFrame, as_of: str, days: int, full_window: bool = False) -> DataFrame:
    """Baseline per user and type over the ``days`` days before ``as_of``.

    ``full_window`` counts every day of the window, not only those between the
    first and last active day.
    """
    end = F.lit(as_of).cast("date")
    window = counts.where((F.col("day") >= F.date_sub(end, days)) & (F.col("day") < end))
    span = F.lit(days) if full_window else None
    return _moments(["user_id", "msg_id"], window, span).select(
        F.lit("user").alias("scope"), "user_id", "msg_id", "mean", "stddev", "sample_days", end.alias("updated")
    )


def global_baselines(users: DataFrame) -> DataFrame:
    """Baseline per type over all users: mean of means, mean of deviations, most sample days."""
    return users.where(F.col("scope") == "user").groupBy("msg_id").agg(
        F.avg("mean").alias("mean"), F.avg("stddev").alias("stddev"),
        F.max("sample_days").alias("sample_days"), F.max("updated").alias("updated"),
    ).select(
        F.lit("global").alias("scope"), F.lit(None).cast("string").alias("user_id"),
        "msg_id", "mean", "stddev", "sample_days", "updated",
    )


def all_baselines(counts: DataFrame, as_of: str, days: int, full_window: bool = False) -> DataFrame:
    # Written once: both halves, and the checks of their size, read the result.
    users = stage(baselines(counts, as_of, days, full_window), "baselines")
    return users.unionByName(global_baselines(users))


def upsert_baselines(new: DataFrame, old: DataFrame) -> DataFrame:
    """New baselines replace old ones of the same key; other old ones stay."""
    key = ["scope", "user_id", "msg_id"]
    same = functools.reduce(lambda a, b: a & b, [old[k].eqNullSafe(new[k]) for k in key])
    return new.unionByName(old.join(new.select(*key), same, "left_anti"))


def baseline_history(counts: DataFrame, first: str, last: str, days: int) -> DataFrame:
    """Baselines of every day from ``first`` to ``last`` in one aggregate, as ``(user_id, msg_id, as_of, …)``.

    Each daily count is sent to the days whose window holds it, which is a
    bounded copy of an already small table.
    """
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    begin = F.greatest(F.date_add("day", 1), lo)
    end = F.least(F.date_add("day", days), hi)
    spread = counts.where(begin <= end).withColumn("as_of", F.explode(F.sequence(begin, end)))
    return _moments(["user_id", "msg_id", "as_of"], spread, None)

"""Field discovery over the open extension map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import let
from ..functions.predicates import last_days
from ..session import LOCAL_TZ
from .normalize import LABEL_SUFFIX, label_name, raw_key


def field_catalog(events: DataFrame, as_of: str, days: int = 7, top: int | None = None, tz: str = LOCAL_TZ, types: Sequence[str] | None = None) -> DataFrame:
    """``(msg_id, fields, sample_count)`` of all types of the last days, or of the ``top`` most frequent, or of given ``types``.

    Labelled pairs are listed under their label; the raw keys of a label are
    left out. Every event of the range is read. Keys are counted on the map side
    first, so only distinct (type, key, label) rows are shuffled.
    """
    recent = events.where(last_days("ts", as_of, days + 1, tz))
    if types is not None:
        recent = recent.where(F.col("msg_id").isin(list(types)))
    counted = recent.groupBy("msg_id").agg(F.count("*").alias("sample_count")).where(F.length("msg_id") > 0)
    if top is not None:
        counted = counted.orderBy(F.desc("sample_count"), "msg_id").limit(top)
    entry = recent.select("msg_id", F.explode("ext").alias("key", "value"))
    labelled = F.col("key").endswith(LABEL_SUFFIX)
    label = F.when(labelled & (F.length("value") > 0), F.col("value"))
    seen = entry.groupBy("msg_id", "key", label.alias("label")).agg(F.lit(1))
    # One row per distinct key: the sets below are as long as the list of field names.
    names = F.when(F.col("label").isNotNull(), label_name(F.col("label"))).when(~labelled, F.col("key"))
    hidden = F.when(F.col("label").isNotNull(), F.array(F.col("key"), raw_key(F.col("key"))))
    sets = seen.groupBy("msg_id").agg(
        F.collect_set(names).alias("names"), F.flatten(F.collect_set(hidden)).alias("hidden")
    )
    found = sets.select("msg_id", F.array_sort(F.array_except("names", "hidden")).alias("fields"))
    return counted.join(found, "msg_id", "left").select(
        "msg_id", F.coalesce("fields", F.array().cast("array<string>")).alias("fields"), "sample_count"
    )


def label_key(events: DataFrame, msg_id: str, name: str) -> str | None:
    """Raw key whose label reads ``name`` in the newest labelled event of a type."""
    named = lambda m: F.filter(F.map_keys(m), lambda k: k.endswith(LABEL_SUFFIX) & (label_name(m[k]) == name))
    key = F.get(F.array_sort(let(F.col("ext"), named)), F.lit(0))
    typed = events.where(F.col("msg_id") == msg_id).select("ts", key.alias("key"))
    row = typed.where("key is not null").agg(F.max_by("key", "ts").alias("key")).first()
    return row["key"][: -len(LABEL_SUFFIX)] if row and row["key"] else None


def field_values(events: DataFrame, msg_id: str, name: str, top: int | None = None) -> DataFrame:
    """Values of a field with counts, under its own key and under its raw key added up; ``top`` keeps the most frequent."""
    raw = label_key(events, msg_id, name)
    keys = [name] + ([raw] if raw else [])
    typed = events.where(F.col("msg_id") == msg_id)
    values = typed.select(F.explode(F.array(*[F.col("ext")[k] for k in keys])).alias("value")).where(F.length("value") > 0)
    counted = values.groupBy("value").agg(F.count("*").alias("cnt"))
    return counted if top is None else counted.orderBy(F.desc("cnt"), "value").limit(top)

"""Spans of pattern matches as columns: no Python, no shuffle.

A span counts code points, its end is exclusive. The text between matches
comes from ``split``, so every position is a sum of lengths of whole pieces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One found span; the order of fields is the order of spans.
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def matches(text: Column, pattern: str, only_if: Column | None = None) -> Column:
    """All leftmost non-overlapping matches; an empty list where ``only_if`` (a cheap necessary test) is false."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if only_if is None else F.when(only_if, found).otherwise(F.array().cast("array<string>"))


def gaps(text: Column, pattern: str, found: Column) -> Column:
    """The pieces between ``found``; the pattern runs again only in rows that have matches."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def located(found: Column, between: Column) -> Column:
    """``found`` as structs of start, end and value."""
    step = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def add(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(step, empty, add, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def ordered(*kinds: Column) -> Column:
    """All spans by start, then by the rank of their kind."""
    return F.array_sort(F.concat(*kinds))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def outside(spans: Column, others: Column) -> Column:
    """The spans that share no character with any of ``others``."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def replaced(text: Column, spans: Column, mark) -> Column:
    """``text`` with every span put out by ``mark(span)``; of overlapping spans the first one's mark stands for their union.

    ``spans`` must be in the order of :func:`ordered`.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc, s):
        fresh = s["start"] >= acc["at"]
        kept = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark(s))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(fresh, kept).otherwise(F.array().cast("array<string>"))).alias("out"))

    done = F.aggregate(spans, empty, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)

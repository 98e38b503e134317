"""Rule conditions as Spark columns.

A condition is a mapping with ``field``, ``op``, ``value`` (text) and, for
``time_range``, ``start`` and ``end``. Nothing is turned into SQL text, so no
value can change the meaning of a predicate, and Catalyst sees plain comparisons.
"""

from __future__ import annotations

import datetime as dt
import functools
import json
import math
import operator
import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import LOCAL_TZ
from .fields import HOUR_FIELDS, FieldColumns, field, field_number, is_virtual

#: The legal operators.
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "like", "regex", "contains", "time_range")
#: What a number looks like, in rule values as in fields (where the cast reads the same texts).
_NUMBER = re.compile(r"^[ \t\n\r\f\v]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\f\v]*\Z")
_ORDER = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def number_of(text: Any) -> float | None:
    """Rule value -> number, or None. Booleans are not numbers."""
    if isinstance(text, bool) or text is None:
        return None
    if isinstance(text, str) and not _NUMBER.match(text):
        return None
    number = float(text)
    return number if math.isfinite(number) else None


def text_of(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def list_of(cond: Mapping[str, Any]) -> list[Any]:
    """Members of an ``in`` list: the value as a list or as JSON text, else the ``values`` array."""
    value = cond.get("value")
    if isinstance(value, str) and value.lstrip().startswith("["):
        try:
            value = json.loads(value)
        except ValueError:
            value = None
    if isinstance(value, (list, tuple)):
        return list(value)
    return list(cond.get("values") or [])


def hours_of(cond: Mapping[str, Any]) -> tuple[int, int]:
    """Bounds of a ``time_range``: beside the operator, or inside the value."""
    inner = cond.get("value")
    if isinstance(inner, str):
        try:
            inner = json.loads(inner)
        except ValueError:
            inner = None
    inner = inner if isinstance(inner, Mapping) else {}
    bounds = []
    for name in ("start", "end"):
        bound = cond.get(name)
        bounds.append(int(inner.get(name, 0) if bound is None else bound))
    return bounds[0], bounds[1]


def in_hours(hour: Column, start: int, end: int) -> Column:
    """start <= hour < end; a start after the end wraps over midnight."""
    after, before = hour >= start, hour < end
    return (after | before) if start > end else (after & before)


class _Direct:
    """Fields as expressions in place, for a single filter: the scan can use them."""

    def __init__(self, tz: str):
        self.tz = tz

    def text(self, name: str) -> Column:
        return field(name, self.tz)

    def number(self, name: str) -> Column:
        return field_number(name, self.tz)


Fields = FieldColumns | _Direct


def _equals_any(name: str, values: Iterable[Any], fields: Fields) -> Column:
    """Numbers compare as numbers, all other values as text."""
    numbers, texts = [], []
    for v in values:
        n = number_of(v)
        (texts if n is None else numbers).append(text_of(v) if n is None else n)
    parts = []
    if numbers:
        parts.append(fields.number(name).isin(numbers))
    if texts:
        col = fields.text(name)
        parts.append((col.cast("string") if is_virtual(name) else col).isin(texts))
    return functools.reduce(operator.or_, parts) if parts else F.lit(False)


def condition(cond: Mapping[str, Any], tz: str = LOCAL_TZ, fields: Fields | None = None) -> Column:
    """One condition as a boolean column. A missing field gives null or false, never true: no match in a filter or ``when``.

    Comparisons stay bare, so that a filter on a stored column can be pushed to
    the scan. With ``fields``, many conditions share columns computed once.
    """
    fields = fields or _Direct(tz)
    name, op, value = cond.get("field") or "", cond.get("op"), cond.get("value")
    if op == "time_range":
        if name in HOUR_FIELDS or not name:
            return in_hours(fields.text(HOUR_FIELDS[0]), *hours_of(cond))
        return in_hours(F.floor(fields.number(name)), *hours_of(cond))
    if not name:
        return F.lit(False)
    if op == "eq":
        return _equals_any(name, [value], fields)
    if op == "neq":
        return fields.text(name).isNotNull() & ~F.coalesce(_equals_any(name, [value], fields), F.lit(False))
    if op == "in":
        return _equals_any(name, list_of(cond), fields)
    if op in _ORDER:
        bound = number_of(value)
        return F.lit(False) if bound is None else _ORDER[op](fields.number(name), F.lit(bound))
    text = fields.text(name).cast("string") if is_virtual(name) else fields.text(name)
    if op == "like":
        return text.like(text_of(value))
    if op == "regex":
        return text.rlike(text_of(value))
    if op == "contains":
        return F.lower(text).contains(text_of(value).lower())
    return F.lit(False)


def match(
    spec: Mapping[str, Any], tz: str = LOCAL_TZ, require_type: bool = False,
    fields: Fields | None = None, known_type: str | None = None,
) -> Column:
    """Type equality first (it prunes and is cheap), then the conditions joined by AND or OR.

    ``known_type`` is the type all rows are known to have.
    """
    parts = []
    msg_id = spec.get("msg_id") or ""
    if msg_id:
        if known_type is None:
            parts.append(F.col("msg_id") == msg_id)
        elif known_type != msg_id:
            return F.lit(False)
    elif require_type:
        return F.lit(False)
    conds = [condition(c, tz, fields) for c in spec.get("conditions") or []]
    if conds:
        join = operator.or_ if (spec.get("logic") or "and").lower() == "or" else operator.and_
        parts.append(functools.reduce(join, conds))
    return functools.reduce(operator.and_, parts) if parts else F.lit(True)


def text_search(needle: str, *columns: Column | str) -> Column:
    """Case-insensitive substring in any of the columns; an empty needle matches all rows."""
    if not needle:
        return F.lit(True)
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    hits = [F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False)) for c in cols]
    return functools.reduce(operator.or_, hits)


def midnight(day: str | dt.date, tz: str = LOCAL_TZ, plus: int = 0) -> dt.datetime:
    """The instant at which a local day starts."""
    d = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return dt.datetime.combine(d + dt.timedelta(days=plus), dt.time(), ZoneInfo(tz))


def on_days(ts: Column | str, first: str, last: str | None = None, tz: str = LOCAL_TZ) -> Column:
    """Local days ``first`` to ``last`` (both included) as a half-open range of literal instants.

    The bounds are literals, so they reach the file scan as pushed filters.
    """
    col = F.col(ts) if isinstance(ts, str) else ts
    return (col >= F.lit(midnight(first, tz))) & (col < F.lit(midnight(last or first, tz, 1)))


def last_days(ts: Column | str, as_of: str, days: int, tz: str = LOCAL_TZ) -> Column:
    """The ``days`` local days that end with ``as_of``."""
    first = dt.date.fromisoformat(as_of) - dt.timedelta(days=days - 1)
    return on_days(ts, first.isoformat(), as_of, tz)


#: Parts whose conditions make one array column; a longer list is several columns of one scan, each of a size the JVM compiles.
PARTS_PER_COLUMN = 150

#: The event types a rule can match (None: any), and its row for events of a type (None: of no listed type).
Part = tuple[Iterable[str] | None, Callable[[str | None], Column]]


def explode_hits(df: DataFrame, parts: Iterable[Part], fields: FieldColumns, *keep: str) -> DataFrame:
    """One row with column ``hit`` per non-null part, next to the columns to ``keep``.

    An event of one type never evaluates the rules of another, so the cost per
    event follows the rules of its type and not the length of the rule list.
    The array is a plain column and nulls are dropped after the explode: a
    higher-order filter would take all conditions out of generated code.
    """
    listed = [(None if types is None else set(types), row) for types, row in parts]
    batches = [listed[i : i + PARTS_PER_COLUMN] for i in range(0, max(len(listed), 1), PARTS_PER_COLUMN)]
    names = [f"_hits_{i}" for i in range(len(batches))]
    hits = [_hits(batch).alias(name) for batch, name in zip(batches, names)]  # this names the field columns
    found = fields.add_to(df).select(*keep, *hits)
    # An explode of a bare column makes the optimizer test its size first, and so build the array twice.
    bounded = F.concat(*names) if len(names) > 1 else F.coalesce(names[0], F.slice(names[0], 1, 0))
    return found.select(*keep, F.explode(bounded).alias("hit")).where("hit is not null")


def _hits(listed: list[Part]) -> Column:
    """The array of rows of an event's type, never null."""
    chosen = None
    for kind in sorted({t for types, _ in listed if types is not None for t in types}):
        mine = F.array(*[row(kind) for types, row in listed if types is None or kind in types])
        test = F.col("msg_id") == kind
        chosen = F.when(test, mine) if chosen is None else chosen.when(test, mine)
    free = F.array(*[row(None) for types, row in listed if types is None])
    if chosen is None:
        return free
    if any(types is None for types, _ in listed):
        return chosen.otherwise(free)
    types, row = listed[0]
    return chosen.otherwise(F.array(F.when(F.lit(False), row(min(types)))))

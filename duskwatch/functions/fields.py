"""Column lookups shared by rules, aggregates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import LOCAL_TZ

#: Rule field names that are columns of the event table.
TOP_LEVEL = {
    "msgId": "msg_id",
    "hostname": "hostname",
    "appName": "app_name",
    "userId": "user_id",
    "userName": "user_name",
    "userIp": "user_ip",
}
#: Names computed from the event time.
HOUR_FIELDS = ("hour", "time")
WEEKDAY_FIELD = "dayOfWeek"


def local(ts: Column | str, tz: str = LOCAL_TZ) -> Column:
    """Instant -> wall clock of ``tz``, whatever the session zone is."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.convert_timezone(F.current_timezone(), F.lit(tz), col.cast("timestamp_ntz"))


def local_day(ts: Column | str = "ts", tz: str = LOCAL_TZ) -> Column:
    return F.to_date(local(ts, tz))


def local_hour(ts: Column | str = "ts", tz: str = LOCAL_TZ) -> Column:
    return F.hour(local(ts, tz))


def local_weekday(ts: Column | str = "ts", tz: str = LOCAL_TZ) -> Column:
    """1 is Sunday, 7 is Saturday."""
    return F.dayofweek(local(ts, tz))


def non_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def is_virtual(name: str) -> bool:
    return name in HOUR_FIELDS or name == WEEKDAY_FIELD


def field(name: str, tz: str = LOCAL_TZ) -> Column:
    """Value of a rule field: extension map first, then the event's own column.

    ``action`` also answers for the raw key ``act``; hour and weekday come from
    the event time in local time. Map access by literal key stays inside
    generated code and lets the optimizer drop unused map entries.
    """
    if name in HOUR_FIELDS:
        return local_hour("ts", tz)
    if name == WEEKDAY_FIELD:
        return local_weekday("ts", tz)
    ext = F.col("ext")
    places = [ext[name]]
    if name == "action":
        places.insert(0, ext["act"])
    if name in TOP_LEVEL:
        places.append(F.col(TOP_LEVEL[name]))
    return F.coalesce(*places) if len(places) > 1 else places[0]


def as_number(col: Column) -> Column:
    """Text -> double, null when it is no number.

    Spark's cast also reads a trailing type letter ("12f") and the names of NaN
    and infinity; such texts are no numbers here.
    """
    number = col.try_cast("double")
    return F.when(~F.substring(col, -1, 1).isin("d", "D", "f", "F") & (F.abs(number) < F.lit(float("inf"))), number)


def field_number(name: str, tz: str = LOCAL_TZ) -> Column:
    col = field(name, tz)
    return col.cast("double") if is_virtual(name) else as_number(col)


def round2(col: Column) -> Column:
    """Two digits, halves away from zero, on the scaled binary value."""
    return F.round(col * F.lit(100.0)) / F.lit(100.0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Inside a lambda, an outer expression would be computed again for every
    element; as the variable of a one-element transform it is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


class FieldColumns:
    """Rule fields as columns that are computed once per event and shared by all rules.

    Conditions built with it refer to the columns; ``add_to`` adds them below.
    """

    def __init__(self, tz: str = LOCAL_TZ):
        self.tz = tz
        self.columns: dict[str, Column] = {}
        self.names: dict[tuple[str, bool], str] = {}

    def _column(self, name: str, number: bool) -> Column:
        key = (name, number)
        if key not in self.names:
            self.names[key] = f"_field_{len(self.names)}"
            self.columns[self.names[key]] = (field_number if number else field)(name, self.tz)
        return F.col(self.names[key])

    def text(self, name: str) -> Column:
        return self._column(name, False)

    def number(self, name: str) -> Column:
        return self._column(name, True)

    def add_to(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns) if self.columns else df

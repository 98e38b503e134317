"""Window length text: ``30s``, ``5m``, ``2h``; a bare number counts minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds per unit letter, and the default lengths per kind of rule.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600}
EMPTY_TEXT = "5m"
DEFAULT_WITHIN = {"threshold": "1h", "sequence": "5m", "all": "30m"}


def window_seconds(text: Column, default: str = EMPTY_TEXT) -> Column:
    """Seconds of a window text. Null takes ``default``, empty text five minutes, other text gives null."""
    t = F.coalesce(text, F.lit(default))
    t = F.when(t == "", F.lit(EMPTY_TEXT)).otherwise(t)
    number = F.regexp_extract(t, r"^(\d+)[smh]?$", 1).try_cast("bigint")
    unit = F.regexp_extract(t, r"^\d+([smh])$", 1)
    scale = F.lit(UNIT_SECONDS["m"])
    for letter, seconds in UNIT_SECONDS.items():
        scale = F.when(unit == letter, F.lit(seconds)).otherwise(scale)
    return number * scale


def window_expr(text: str | None, default: str = EMPTY_TEXT) -> str:
    """The same text as an interval argument of ``F.window``."""
    t = default if text is None else text
    t = t or EMPTY_TEXT
    digits, letter = (t[:-1], t[-1]) if t[-1:] in UNIT_SECONDS else (t, "m")
    if not digits.isdigit():
        raise ValueError(f"not a window length: {text!r}")
    return f"{int(digits) * UNIT_SECONDS[letter]} seconds"


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts)


def window_start(ts: Column | str, width: Column | int) -> Column:
    """Start of the epoch-aligned tumbling window, with a width that may differ per row."""
    s = epoch_seconds(ts)
    return s - F.pmod(s, width if isinstance(width, Column) else F.lit(width))

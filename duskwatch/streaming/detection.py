"""Detection over an event stream, on event time.

The batch operators work on processing-time-free semantics, so a stream of the
same events gives the same alerts once the watermark has passed them.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import ROW_KINDS, WINDOW_KEYS, WINDOW_KINDS, matches, of_kind, reached, row_matches, to_alerts
from ..session import LOCAL_TZ
from .sequences import sequence_stream

Rule = Mapping[str, Any]


def prepared(events: DataFrame, delay: str = "10 minutes", dedup: bool = False) -> DataFrame:
    """Watermark on the event time; rows later than ``delay`` are dropped by the operators behind it.

    ``dedup`` removes events sent twice within the delay. It has to come before any window.
    """
    marked = events.withWatermark("ts", delay)
    return marked.dropDuplicatesWithinWatermark(["event_id"]) if dedup else marked


def window_stream(events: DataFrame, rules: Sequence[Rule], width: int, tz: str = LOCAL_TZ) -> DataFrame:
    """Thresholds and co-occurrences of one window width. The window column lets Spark drop closed state."""
    found = matches(events, rules, tz)
    grouped = found.groupBy(F.window("ts", f"{width} seconds").alias("w"), *WINDOW_KEYS).agg(
        F.count("*").alias("cnt"), F.bit_or("mask").alias("seen")
    )
    return reached(grouped, rules).select(
        "rule_id", "user_id", "hostname", "user_ip", "cnt", F.col("w.end").alias("ts"),
        F.concat_ws("|", F.unix_seconds("w.start"), F.concat_ws("|", "by_values")).alias("origin"),
    )


def detect_stream(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ) -> DataFrame:
    """Alerts of all rules from a watermarked stream (``prepared``), in append mode.

    Per-event rules share one pass without state; each window width is one
    stateful aggregate; the ordered rules of a key list are one keyed operator.
    """
    parts = []
    rows = of_kind(rules, *ROW_KINDS)
    if rows:
        parts.append(row_matches(matches(events, rows, tz), rows))
    widths: dict[int, list[Rule]] = {}
    for rule in of_kind(rules, *WINDOW_KINDS):
        widths.setdefault(rule["within_s"], []).append(rule)
    parts += [window_stream(events, rs, w, tz) for w, rs in widths.items()]
    key_lists: dict[tuple[str, ...], list[Rule]] = {}
    for rule in of_kind(rules, "sequence"):
        key_lists.setdefault(tuple(rule["by"]), []).append(rule)
    parts += [sequence_stream(events, rs, tz) for rs in key_lists.values()]
    return to_alerts(functools.reduce(DataFrame.unionByName, parts), rules)

"""Registered queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Days as text and instants as UTC wall clocks, so that both engines hand out the same values."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        cols.append(c.cast("string").alias(name) if kind == "date" else c.cast("timestamp_ntz").alias(name) if kind == "timestamp" else c)
    return df.select(*cols)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: The event model in SQL; the start of most checks.
EV = """
ev AS (
  SELECT event_id, ts, user_id AS uid, CAST(user_id AS VARCHAR) AS user_id,
         'MESSAGE_' || upper(event_type) AS msg_id, event_type AS act,
         'host-' || CAST(user_id % 20 AS VARCHAR) AS hostname, '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS user_ip,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, value AS fsize,
         CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) >= 80 THEN 'blocked' ELSE 'allowed' END AS outcome,
         CASE WHEN value >= 100 THEN 'large' ELSE 'small' END AS size_class,
         ts + INTERVAL 9 HOUR AS lts, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day
  FROM events)
"""

#: One score snapshot per event, as the report checks use it.
SNAP = """
snap AS (
  SELECT user_id, day, CAST(hour(lts) AS INTEGER) AS hour, ts, fsize AS risk_score,
         CASE WHEN fsize > 99 THEN 'HIGH' WHEN fsize > 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
         CASE WHEN k < 10 THEN 'cold_start' ELSE 'active' END AS status, CAST(k AS DOUBLE) AS rule_score,
         round(fsize / 4 * 100) / 100 AS anomaly_score, round(fsize * 0.9 * 100) / 100 AS decayed_prev,
         round(fsize / 2 * 100) / 100 AS prev_score
  FROM ev)
"""

PROFILES = """
prof AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id,
         CASE user_id % 6 WHEN 0 THEN 'departing' WHEN 1 THEN 'vacation' WHEN 2 THEN 'blacklist' WHEN 3 THEN 'vip' ELSE 'normal' END AS context,
         CASE user_id % 4 WHEN 0 THEN DATE '2024-01-10' WHEN 1 THEN DATE '2024-02-10' END AS start_date,
         CASE WHEN user_id % 5 = 0 THEN DATE '2024-01-20' END AS end_date,
         'note ' || CAST(user_id AS VARCHAR) AS note, user_id % 13 = 0 AS whitelisted
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 <> 3))
"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts) + " "


def load() -> None:
    from . import behaviour, detection, ingest, predicates, reports, scoring, streams  # noqa: F401

"""Backfill of the event log from a relational history table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import LOCAL_TZ
from .stores import write_event_log

#: Log column and the key of the extension map it is read from.
HISTORY_KEYS = {
    "event_time": "rt",
    "user_id": "suid",
    "os_account": "suser",
    "user_ip": "src",
    "user_mac": "smac",
    "action": "act",
    "outcome": "outcome",
    "file_name": "fname",
    "file_path": "filePath",
}


def read_history(spark: SparkSession, url: str, table: str, low: int, high: int, slices: int, **properties: str) -> DataFrame:
    """The table in ``slices`` parallel key ranges of ``log_pk``; the bounds only shape the ranges, no row is left out."""
    return spark.read.jdbc(url, table, column="log_pk", lowerBound=low, upperBound=high, numPartitions=slices, properties=properties)


def history_events(rows: DataFrame) -> DataFrame:
    """History rows as log rows of 14 columns. The map may be stored as JSON text."""
    ext = F.col("cef_extensions")
    if dict(rows.dtypes)["cef_extensions"] == "string":
        ext = F.from_json(ext, "map<string,string>")
    return rows.withColumn("_ext", ext).select(
        F.col("time").cast("timestamp").alias("ts"), "log_pk", "msg_id", "severity", "hostname",
        *[F.col("_ext")[key].alias(name) for name, key in HISTORY_KEYS.items()],
    )


def backfill_history(rows: DataFrame, path: str, run: str, tz: str = LOCAL_TZ) -> None:
    """Write history rows to the log by day; the same run may be repeated after a failure."""
    write_event_log(history_events(rows), path, tz, run)

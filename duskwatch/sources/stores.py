"""Tables kept per local day: event log, alerts, score snapshots, baselines and the field catalog."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import local_day, local_hour
from ..session import LOCAL_TZ, stage


def write_partitions(df: DataFrame, path: str, *parts: str) -> None:
    """Write Parquet by ``parts``, replacing only the partitions that ``df`` holds.

    The rebalance hint lets adaptive execution split a large day over tasks and
    join small ones, so a day is neither one file per task nor one huge file.
    """
    (
        df.hint("rebalance", *[F.col(p) for p in parts])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )


def write_event_log(df: DataFrame, path: str, tz: str = LOCAL_TZ, run: str | None = None) -> None:
    """Events by local day. With ``run`` (a batch number), a repeated run replaces its own files only."""
    dated = df.withColumn("day", local_day("ts", tz))
    if run is None:
        dated.hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)
    else:
        write_partitions(dated.withColumn("run", F.lit(run)), path, "day", "run")


def read_day_range(spark: SparkSession, path: str, first: str, last: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of the local days ``first`` to ``last``; other partitions are not listed for reading."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    day = F.col("day")
    return reader.parquet(path).where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def write_alerts(alerts: DataFrame, path: str, now: Column, run: str, tz: str = LOCAL_TZ) -> None:
    """Alerts by local day; an alert without time takes ``now``. A repeated run replaces its own rows."""
    dated = alerts.withColumn("ts", F.coalesce("ts", now))
    write_partitions(dated.withColumn("day", local_day("ts", tz)).withColumn("run", F.lit(run)), path, "day", "run")


def latest_per_key(df: DataFrame, keys: list[str], ts: str, *ties: str) -> DataFrame:
    """Newest row per key. Rows are combined before the shuffle, so a key with very many rows costs one per task."""
    rest = [c for c in df.columns if c not in keys]
    # Without named ties the other columns decide, so that a retry can't change the result; maps have no order.
    kinds = dict(df.dtypes)
    order = F.struct(ts, *(ties or [c for c in rest if c != ts and "map<" not in kinds[c]]))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def last_snapshots(scores: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """One snapshot per user, local day and hour: the last one written."""
    keyed = scores.withColumns({"day": local_day("ts", tz), "hour": local_hour("ts", tz)})
    return latest_per_key(keyed, ["user_id", "day", "hour"], "ts")


def upsert_scores(new: DataFrame, path: str, tz: str = LOCAL_TZ) -> None:
    """Write snapshots into the stored days they belong to; per user and hour the last write wins.

    The result is written aside before the days are replaced, so a failed run
    leaves the stored days as they were.
    """
    spark = new.sparkSession
    fresh = stage(last_snapshots(new, tz), "snapshots")
    # Days of one run: one for a daily job, a few for a stream.
    days = [r[0] for r in fresh.select("day").distinct().collect()]
    if not days:
        return
    try:
        old = spark.read.parquet(path).where(F.col("day").isin(days)).select(*fresh.columns)
    except Exception as missing:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    else:
        key = ["user_id", "day", "hour"]
        fresh = stage(fresh.unionByName(old.join(fresh.select(*key), key, "left_anti")), "snapshots")
    write_partitions(fresh, path, "day")


def save_catalog(catalog: DataFrame, path: str, now: dt.datetime) -> None:
    catalog.withColumn("migrated_at", F.lit(now)).write.mode("append").parquet(path)


def latest_catalog(catalogs: DataFrame) -> DataFrame:
    """The rows of the catalog written last."""
    newest = catalogs.agg(F.max("migrated_at").alias("migrated_at"))
    return catalogs.join(F.broadcast(newest), "migrated_at").select(*catalogs.columns)

"""Raw stream -> normalized stream and event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import normalize
from ..session import LOCAL_TZ, scratch
from ..sources.streams import malformed, parse_events, to_json_events
from ..sources.stores import write_event_log, write_partitions


def batch_time(spark: SparkSession, path: str, batch_id: int) -> Column:
    """The time at which a micro-batch was first seen: a repeated batch finds what its first run wrote."""
    mine = f"{path}/{batch_id}"
    try:
        seen = spark.read.schema("ts timestamp").parquet(mine).first()
    except Exception as missing:  # the first run of this batch
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        seen = None
    if seen is None:
        spark.range(1).select(F.current_timestamp().alias("ts")).write.mode("overwrite").parquet(mine)
        seen = spark.read.schema("ts timestamp").parquet(mine).first()
    return F.lit(seen["ts"])


def start_ingest(text: DataFrame, log_path: str, checkpoint: str, publish_path: str | None = None, bad_path: str | None = None, tz: str = LOCAL_TZ, **trigger):
    """One query: decode, normalize, store by day, and publish.

    All outputs of a micro-batch are keyed by its number, so a repeated batch
    replaces what it wrote. Events without a time take the time at which the
    batch was first seen, which is kept beside the checkpoint.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        now = batch_time(batch.sparkSession, f"{checkpoint.rstrip('/')}-times", batch_id)
        # Decoded once: what is stored is what is published.
        with scratch(normalize(parse_events(batch), now), "ingest") as events:
            write_event_log(events, log_path, tz, run=str(batch_id))
            if publish_path:
                write_partitions(to_json_events(events).withColumn("run", F.lit(batch_id)), publish_path, "run")
        if bad_path:
            write_partitions(malformed(batch).withColumn("run", F.lit(batch_id)), bad_path, "run")

    writer = text.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

"""Event streams in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import let, non_empty
from ..schema import RAW_EVENT

_KNOWN = [f.name for f in RAW_EVENT.fields]
#: Column that keeps text which is not a JSON object.
BAD = "_malformed"


def read_kafka(spark: SparkSession, servers: str, topics: Sequence[str], starting: str = "latest", **options: str) -> DataFrame:
    """JSON text of several topics as one stream; offsets live in the query's checkpoint, so a restart loses nothing.

    Needs the Kafka connector on the class path.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(t.strip() for t in topics))
        .option("startingOffsets", starting)
    )
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"))


def read_events_stream(spark: SparkSession, path: str, fmt: str = "text", schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A folder of files as a stream: JSON lines as text, or Parquet with a schema."""
    reader = spark.readStream.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def _decoded(col: str) -> Column:
    wide = T.StructType([*RAW_EVENT.fields, T.StructField(BAD, T.StringType())])
    return F.from_json(F.col(col), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})


def _kept(df: DataFrame, *cols: Column) -> DataFrame:
    """``cols`` as the fields of ``_d``, computed once per row.

    A filter on a plain column goes below what computes it with a copy of that for
    each use, down to the scan; it can't go below a generator.
    """
    return df.select("*", F.explode(F.array(F.struct(*cols))).alias("_d"))


def _is_bad(e: Column) -> Column:
    """No event could be read at all. One field of a wrong type only loses that field."""
    nothing = F.lit(True)
    for f in RAW_EVENT.fields:
        nothing = nothing & e[f.name].isNull()
    return e.isNull() | (e[BAD].isNotNull() & nothing)


def parse_events(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON text -> raw events under the names of the event table. Malformed text is dropped, missing fields are null.

    Top-level fields that no column holds are kept as JSON text in ``extra``,
    and rules find their values in ``ext`` under names it does not have yet.
    """
    e = F.col("_e")
    texts = F.map_filter(F.from_json(F.col(col), "map<string,string>"), lambda k, v: ~k.isin(_KNOWN) & v.isNotNull())
    own = F.coalesce(e["cefExtensions"], F.create_map().cast("map<string,string>"))
    more = F.map_filter("_texts", lambda k, v: ~F.map_contains_key(own, k))
    ext = F.when(F.size("_texts") > 0, F.map_concat(own, more)).otherwise(e["cefExtensions"])
    values = F.map_filter(F.from_json(F.col(col), "map<string,variant>"), lambda k, v: ~k.isin(_KNOWN))
    extra = F.when(F.size("_texts") > 0, F.to_json(values))
    parsed = df.withColumns({"_e": _decoded(col), "_texts": texts})
    d = F.col("_d")
    e = d["e"]
    return _kept(parsed, F.col("_e").alias("e"), ext.alias("ext"), extra.alias("extra")).where(~_is_bad(e)).select(
        e["event_id"].alias("event_id"),
        e["@timestamp"].try_cast("timestamp").alias("ts"),
        e["msgId"].alias("msg_id"),
        e["hostname"].alias("hostname"),
        e["appName"].alias("app_name"),
        non_empty(e["userId"]).alias("user_id"),
        d["ext"].alias("ext"),
        d["extra"].alias("extra"),
    )


def malformed(df: DataFrame, col: str = "value") -> DataFrame:
    """The text that ``parse_events`` drops, for a side output."""
    return _kept(df, _decoded(col).alias("e")).where(_is_bad(F.col("_d")["e"])).select(F.col(col).alias("value"))


def to_json_events(df: DataFrame) -> DataFrame:
    """Normalized events as JSON text under the producers' names; fields kept in ``extra`` stand beside them again."""
    ext = F.col("ext")
    extra = F.col("extra") if "extra" in df.columns else F.lit(None).cast("string")
    less = lambda copied: F.map_filter(ext, lambda k, v: ~F.coalesce(copied[k] == v, F.lit(False)))
    own = F.when(extra.isNull(), ext).otherwise(let(F.from_json(extra, "map<string,string>"), less))
    known = F.to_json(F.struct(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("@timestamp"),
        F.col("msg_id").alias("msgId"), "hostname", F.col("app_name").alias("appName"),
        F.col("user_id").alias("userId"), own.alias("cefExtensions"),
    ))
    texts = df.select(known.alias("_known"), extra.alias("_extra"))
    known, more = F.col("_known"), F.substring("_extra", 2, 1 << 30)
    whole = F.concat(F.left(known, F.length(known) - 1), F.lit(","), more)
    return texts.select(F.coalesce(whole, known).alias("value"))


def write_events_stream(df: DataFrame, path: str, checkpoint: str, **kafka: str):
    """Publish normalized events as JSON: to files, or to a topic when Kafka options are given."""
    writer = to_json_events(df).writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    if kafka:
        return writer.format("kafka").options(**{k.replace("_", "."): v for k, v in kafka.items()}).option("topic", path)
    return writer.format("text").option("path", path)

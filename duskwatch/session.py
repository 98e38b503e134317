"""Session helpers: the local time zone, and tables written once to cut lineage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the zone in which days and hours are counted unless a caller names another.
LOCAL_TZ = "Asia/Seoul"


def configure(spark: SparkSession) -> SparkSession:
    """Settings the library is meant to run with.

    A long rule list makes long generated methods, which the JVM does not
    compile. With this limit such a stage is generated operator by operator, in
    methods of a size that is compiled.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        # A single process, as in tests: its own temporary folder is seen by all tasks.
        return _own_folder(spark.sparkContext.applicationId)
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"duskwatch-{application}-")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this application. The application's folder can be removed when it has ended."""
    return f"{shared_dir(spark)}/duskwatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where two branches read the same costly result: the written table is
    columnar (each branch reads only its columns), frozen (row numbers keep
    their values when a task is retried) and survives the loss of executors.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` staged for the length of a block, for streams: the table is removed at the end of the block."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows up to which a side of a join is sent to every executor.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast after counting it (no further than the bound).

    A larger table is joined by shuffle, where adaptive execution splits hot keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

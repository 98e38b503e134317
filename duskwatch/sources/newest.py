"""Newest score per user, one generation per day, in buckets of the user.

A generation holds the newest score of every user before a local day. The next
one is made from it and the scores stored since, so no reader goes through the
score history. Its files are bucketed by user: joined with another side on the
user, a generation is read where it lies, without a shuffle of its own.
"""

from __future__ import annotations

import dataclasses
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import midnight
from ..session import LOCAL_TZ

NEWEST_DDL = "user_id string, ts timestamp, risk_score double"


@dataclasses.dataclass
class NewestScores:
    """Generations below ``path``, in folders ``before=DAY``; ``buckets`` is fixed for a path."""

    path: str
    buckets: int = 64
    tz: str = LOCAL_TZ

    def _folder(self, day: str) -> str:
        return f"{self.path.rstrip('/')}/before={day}"

    def days(self, spark: SparkSession) -> list[str]:
        """Days that have a finished generation, in order."""
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return sorted(n.removeprefix("before=") for n in names if n.startswith("before=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def _table(self, day: str) -> str:
        return f"newest_{hashlib.md5(self._folder(day).encode()).hexdigest()}"

    def read(self, spark: SparkSession, day: str) -> DataFrame:
        """The generation of a day. The catalog entry only says how the files are bucketed; dropping it leaves them."""
        name, folder = self._table(day), self._folder(day).replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({NEWEST_DDL}) USING parquet CLUSTERED BY (user_id) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return spark.table(name)

    def _write(self, rows: DataFrame, day: str) -> None:
        spark, name = rows.sparkSession, self._table(day)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        # A task per bucket, so a bucket is one file.
        placed = rows.select("user_id", "ts", "risk_score").repartition(self.buckets, "user_id")
        placed.write.mode("overwrite").format("parquet").option("path", self._folder(day)).bucketBy(self.buckets, "user_id").saveAsTable(name)
        spark.sql(f"DROP TABLE IF EXISTS {name}")

    def before(self, spark: SparkSession, scores: DataFrame | None, day: str) -> DataFrame:
        """The generation of ``day``; made if it is not there.

        It starts from the generation before it and takes the scores stored for
        the days since, read by their ``day`` partitions. Without an earlier
        generation it takes all scores before the day once.
        """
        have = self.days(spark)
        if day in have:
            return self.read(spark, day)
        earlier = [d for d in have if d < day]
        if scores is None:
            fresh = spark.createDataFrame([], NEWEST_DDL)
        else:
            since = scores.where(F.col("day") < F.lit(day).cast("date")).where(F.col("ts") < F.lit(midnight(day, self.tz)))
            if earlier:
                since = since.where(F.col("day") >= F.lit(earlier[-1]).cast("date"))
            fresh = since.groupBy("user_id").agg(F.max(F.struct("ts", "risk_score")).alias("s")).select("user_id", "s.*")
        if earlier:
            old = self.read(spark, earlier[-1]).select("user_id", F.struct("ts", "risk_score").alias("old"))
            both = fresh.select("user_id", F.struct("ts", "risk_score").alias("new")).join(old, "user_id", "full_outer")
            fresh = both.select("user_id", F.greatest("new", "old").alias("s")).select("user_id", "s.*")
        self._write(fresh, day)
        return self.read(spark, day)

    def forget(self, spark: SparkSession, after: str) -> None:
        """Remove the generations of days later than ``after``: scores of that day have changed."""
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for day in self.days(spark):
            if day > after:
                spark.sql(f"DROP TABLE IF EXISTS {self._table(day)}")
                fs.delete(path(self._folder(day)), True)


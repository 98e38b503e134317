"""Running scores over an event stream.

Each micro-batch is reduced to counters (events per user and type, values per
user and rule, distinct values as rows of their own) and these are appended per
day and batch. A repeated batch replaces its own counters, so nothing counts
twice. Scores of the users in the batch are then computed from their counters
of the day, never from the day's events; a user with very many events costs no
more than any other after the map-side reduction.

A day has as many counter files as batches, so every so many batches their sum
is written as a base, bucketed by a hash of the user. A batch then reads the
newest base before it and the few batches since, and of the base only the
buckets of its users: what it reads does not grow with the batches of the day.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import midnight, on_days
from ..operators import behaviour, scoring
from ..operators.scoring import Settings
from ..session import LOCAL_TZ, scratch, stage
from ..sources.stores import write_partitions

Rule = Mapping[str, Any]

#: The batch number of counters made from the stored log.
RECOVERED = -1


_STORED = "user_id string, kind string, name string, text string, n bigint, number double"
BASE_DDL = f"{_STORED}, bucket int"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


@dataclasses.dataclass
class ScoreStream:
    """Scores every user of a micro-batch.

    ``context`` gives, for a day, the baselines, profiles and previous scores to
    use (usually tables written by the daily job). Scores go to ``scores_path``
    by day and batch; the newest row of a user is the current one. Days before
    ``score_from`` are counted and not scored, as when a stream begins with
    months of stored events.
    """

    rules: Sequence[Rule]
    settings: Settings
    context: Callable[[SparkSession, str], tuple[DataFrame, DataFrame, DataFrame]]
    counters_path: str
    scores_path: str
    tz: str = LOCAL_TZ
    score_from: str | None = None
    #: Batches after which the counters of a day are added up, and the parts of the sum.
    compact_every: int = 16
    buckets: int = 64

    @property
    def _bases(self) -> str:
        return f"{self.counters_path.rstrip('/')}-base"

    @staticmethod
    def _numbers(spark: SparkSession, folder: str, prefix: str, mark: str = "") -> list[int]:
        """Numbers of the folders of a day called ``prefix`` and a number, those with ``mark`` in them if given."""
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path(folder)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(folder))]
        names = [n for n in names if n.startswith(prefix)]
        return sorted(int(n.removeprefix(prefix)) for n in names if not mark or fs.exists(path(f"{folder}/{n}/{mark}")))

    def stored(self, spark: SparkSession, day: str, batch_id: int | None = None, users: DataFrame | None = None) -> DataFrame:
        """Counters of a day up to a batch (all of it if not given), possibly several rows per counter.

        A repeated batch sees what it saw first: later batches and bases are not
        counted, and a base counts once it is written to the end. Of the base
        only the buckets of ``users`` are read.
        """
        last = (1 << 62) if batch_id is None else batch_id
        bases = [n for n in self._numbers(spark, f"{self._bases}/day={day}", "upto=", "_SUCCESS") if n < last]
        upto = max(bases, default=RECOVERED - 1)
        fresh = [n for n in self._numbers(spark, f"{self.counters_path}/day={day}", "batch=") if upto < n <= last]
        parts = []
        if fresh:
            parts.append(spark.read.schema(_STORED).parquet(*[f"{self.counters_path}/day={day}/batch={n}" for n in fresh]))
        if bases:
            base = spark.read.schema(BASE_DDL).parquet(f"{self._bases}/day={day}/upto={upto}")
            if users is not None:
                wanted = sorted(r["b"] for r in users.select(_bucket(self.buckets).alias("b")).distinct().collect())  # as many as buckets
                base = base.where(F.col("bucket").isin(wanted))
            parts.append(base.drop("bucket"))
        rows = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _STORED)
        return rows.withColumn("day", F.lit(day).cast("date"))

    def compact(self, spark: SparkSession, day: str, batch_id: int) -> None:
        """Write the sum of a day's counters up to a batch, a file per bucket."""
        whole = behaviour.merged(self.stored(spark, day, batch_id)).drop("day").withColumn("bucket", _bucket(self.buckets))
        whole.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self._bases}/day={day}/upto={batch_id}")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(behaviour.counters(batch, self.rules, self.tz), "counters") as fresh:
            write_partitions(fresh.withColumn("batch", F.lit(batch_id).cast("bigint")), self.counters_path, "day", "batch")
            # Days of one micro-batch: a handful, around midnight or after an outage.
            if batch_id % self.compact_every == self.compact_every - 1:
                for (day,) in fresh.select("day").distinct().collect():
                    self.compact(spark, day.isoformat(), batch_id)
            scored = fresh if self.score_from is None else fresh.where(F.col("day") >= F.lit(self.score_from).cast("date"))
            for (day,) in sorted(scored.select("day").distinct().collect()):
                self.score(spark, day.isoformat(), batch_id, fresh.where(F.col("day") == F.lit(day)).select("user_id").distinct())

    def score(self, spark: SparkSession, day: str, batch_id: int, users: DataFrame | None = None) -> None:
        stored = behaviour.merged(self.stored(spark, day, batch_id, users))
        known, profiles, previous = self.context(spark, day)
        if users is not None:
            stored = stored.join(users, "user_id", "left_semi")
            # The population's baselines have no user; of the others only those of the batch are needed.
            known = known.where("scope = 'global'").unionByName(known.where("scope = 'user'").join(users, "user_id", "left_semi").select(*known.columns))
            previous = previous.join(users, "user_id", "left_semi")
        out = scoring.daily_risk(behaviour.counted_types(stored), behaviour.counted_values(stored), self.rules, known, profiles, previous, self.settings, day)
        write_partitions(out.withColumn("batch", F.lit(batch_id).cast("bigint")), self.scores_path, "day", "batch")

    def recover(self, spark: SparkSession, log: DataFrame, day: str) -> None:
        """Counters and scores of a day from the stored log of its events, when its counters are lost.

        All users with events or a previous score are scored. The counters count
        as those of one batch before all others, so a stream that goes on adds
        its later batches to them; recovering again replaces it.
        """
        if any(n > RECOVERED for n in self._numbers(spark, f"{self.counters_path}/day={day}", "batch=")):
            raise ValueError(f"{day} has counters of batches: they would count twice")
        fresh = behaviour.counters(log.where(on_days("ts", day, tz=self.tz)), self.rules, self.tz)
        write_partitions(fresh.withColumn("batch", F.lit(RECOVERED).cast("bigint")), self.counters_path, "day", "batch")
        self.score(spark, day, RECOVERED)

    def close_day(self, spark: SparkSession, day: str, path: str) -> None:
        """Final scores of a finished day, for users with and without events, stamped with the end of the day."""
        stored = behaviour.merged(self.stored(spark, day))
        known, profiles, previous = self.context(spark, day)
        out = scoring.daily_risk(behaviour.counted_types(stored), behaviour.counted_values(stored), self.rules, known, profiles, previous, self.settings, day)
        end = F.lit(midnight(day, self.tz, 1)) - F.expr("interval 1 second")
        write_partitions(out.withColumns({"ts": end, "hour": F.lit(23)}), path, "day")

    def start(self, events: DataFrame, checkpoint: str, **trigger: Any):
        """Run over a stream of events (see ``prepared`` for watermark and duplicates)."""
        writer = events.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def current_scores(spark: SparkSession, scores_path: str, day: str) -> DataFrame:
    """Newest score row per user of a day."""
    rows = spark.read.parquet(scores_path).where(F.col("day") == F.lit(day).cast("date"))
    rest = [c for c in rows.columns if c != "user_id"]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("user_id", "r.*")


def recover(events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ) -> tuple[DataFrame, DataFrame]:
    """Counts and rule values of a day from the stored log, when no counters exist."""
    stored = stage(behaviour.counters(events, rules, tz), "counters")
    return behaviour.counted_types(stored), behaviour.counted_values(stored)

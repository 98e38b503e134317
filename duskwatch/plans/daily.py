"""The daily job: counters of the day, baselines, previous scores, risk of the day, stored snapshots.

Events are read once, for the counters of their day: a small table per user,
type, rule and day. Baselines, scores, and scores after a change of weights or
settings read counters alone. Previous scores come from a table of the newest
score per user, carried on from day to day.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import midnight, on_days
from ..operators import behaviour, scoring
from ..operators.scoring import Settings
from ..schema import BASELINE_DDL, COUNTER_DDL
from ..session import LOCAL_TZ, stage
from ..sources.newest import NewestScores
from ..sources.stores import read_day_range, upsert_scores, write_partitions


@dataclasses.dataclass
class DailyJob:
    """Tables of the job. Every step may be repeated for a day; it replaces that day's rows.

    ``late_days`` days before the day of a run are counted again with it, as
    their events may have come after their own run.
    """

    log_path: str
    baselines_path: str
    scores_path: str
    settings: Settings
    tz: str = LOCAL_TZ
    counters_path: str = ""
    late_days: int = 1
    newest_path: str = ""

    def __post_init__(self) -> None:
        self.counters_path = self.counters_path or f"{self.scores_path.rstrip('/')}_counters"
        self.newest_path = self.newest_path or f"{self.scores_path.rstrip('/')}_newest"

    def log(self, spark: SparkSession, first: str, last: str) -> DataFrame:
        return read_day_range(spark, self.log_path, first, last)

    def count_days(self, spark: SparkSession, rules: Sequence[Mapping[str, Any]], first: str, last: str) -> None:
        """Count the events of these days in one scan and replace their stored counters."""
        events = self.log(spark, first, last).where(on_days("ts", first, last, self.tz))
        made = behaviour.counters(events, rules, self.tz).withColumn("made_by", F.lit(behaviour.definition(rules)))
        write_partitions(made, self.counters_path, "day")

    def counters(
        self, spark: SparkSession, rules: Sequence[Mapping[str, Any]], first: str, last: str, any_rules: bool = False
    ) -> DataFrame:
        """Stored counters of the days ``first`` to ``last``; days without them are counted first.

        So are days whose counters are of other rules, unless ``any_rules``
        says that only the counts per type matter.
        """
        stored = self._table(spark, self.counters_path, COUNTER_DDL)
        span = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        # One row per day of the range comes to the driver.
        have = {} if stored is None else dict(stored.where(span).groupBy("day").agg(F.max("made_by")).collect())
        wanted, begin = behaviour.definition(rules), dt.date.fromisoformat(first)
        days = [begin + dt.timedelta(days=i) for i in range((dt.date.fromisoformat(last) - begin).days + 1)]
        open_days = [d for d in days if d not in have or not (any_rules or have[d] == wanted)]
        while open_days:  # stretches of days, each in one scan
            n = next((i for i in range(1, len(open_days)) if open_days[i] != open_days[0] + dt.timedelta(days=i)), len(open_days))
            self.count_days(spark, rules, open_days[0].isoformat(), open_days[n - 1].isoformat())
            open_days = open_days[n:]
        return self._table(spark, self.counters_path, COUNTER_DDL).where(span)

    def _before(self, as_of: str, days: int) -> str:
        return (dt.date.fromisoformat(as_of) - dt.timedelta(days=days)).isoformat()

    def update_baselines(self, spark: SparkSession, as_of: str, rules: Sequence[Mapping[str, Any]] = ()) -> DataFrame:
        """Recompute baselines from counters of the days before ``as_of``; keys without recent events keep their last one."""
        n = self.settings.baseline_window_days
        stored = self.counters(spark, rules, self._before(as_of, n), self._before(as_of, 1), any_rules=True)
        counts = behaviour.counted_types(stored)
        known = behaviour.all_baselines(counts, as_of, n)
        before = self.baselines(spark, as_of, strictly=True)
        if before is not None:
            known = behaviour.upsert_baselines(known, before)
        write_partitions(known.withColumn("as_of", F.lit(as_of).cast("date")), self.baselines_path, "as_of")
        return self.baselines(spark, as_of)

    def baselines(self, spark: SparkSession, as_of: str, strictly: bool = False) -> DataFrame | None:
        """The newest stored baselines at ``as_of`` (before it, when ``strictly``)."""
        stored = self._table(spark, self.baselines_path, f"{BASELINE_DDL}, as_of date")
        if stored is None:
            return None
        day = F.lit(as_of).cast("date")
        kept = stored.where(F.col("as_of") < day if strictly else F.col("as_of") <= day)
        newest = kept.agg(F.max("as_of")).first()[0]
        return None if newest is None else stored.where(F.col("as_of") == F.lit(newest)).drop("as_of")

    def scores(self, spark: SparkSession) -> DataFrame | None:
        return self._table(spark, self.scores_path)

    def score(self, spark: SparkSession, rules: Sequence[Mapping[str, Any]], profiles: DataFrame, as_of: str) -> None:
        """Score the day from its counters and store one snapshot per user at the end of the day.

        Running it again after a rule change replaces the day's scores. Events
        are read again only where the change is in what the rules count.
        """
        newest = NewestScores(self.newest_path, tz=self.tz)
        previous = scoring.previous_of(newest.before(spark, self.scores(spark), as_of), as_of, tz=self.tz)
        known = self.baselines(spark, as_of)
        if known is None:  # the first day of a log has nothing before it
            known = spark.createDataFrame([], BASELINE_DDL)
        today = self.counters(spark, rules, as_of, as_of)
        counts, values = behaviour.counted_types(today), behaviour.counted_values(today)
        out = scoring.daily_risk(counts, values, rules, known, profiles, previous, self.settings, as_of)
        end = F.lit(midnight(as_of, self.tz, 1)) - F.expr("interval 1 second")
        fresh = stage(out.drop("day").withColumn("ts", end), "scores")
        # Later generations hold this day's scores; they go first, so that a run that stops here leaves none of them.
        newest.forget(spark, as_of)
        upsert_scores(fresh, self.scores_path, self.tz)

    def run(self, spark: SparkSession, rules: Sequence[Mapping[str, Any]], profiles: DataFrame, as_of: str) -> None:
        self.count_days(spark, rules, self._before(as_of, self.late_days), as_of)
        self.update_baselines(spark, as_of, rules)
        self.score(spark, rules, profiles, as_of)

    @staticmethod
    def _table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
        try:
            return (spark.read.schema(schema) if schema else spark.read).parquet(path)
        except Exception as missing:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

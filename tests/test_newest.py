"""Newest scores per user by generations equal a pass over the whole history."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duskwatch import datasets as D
from duskwatch.operators import scoring as S
from duskwatch.sources.newest import NewestScores

DAYS = ["2024-01-05", "2024-01-06", "2024-01-20", "2024-01-30"]


@pytest.fixture()
def history(spark, small, tmp_path):
    path = str(tmp_path / "scores")
    D.snapshots(spark, small).select("user_id", "ts", "risk_score", "day").write.partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def test_generations_equal_the_whole_history(spark, history, tmp_path):
    newest = NewestScores(str(tmp_path / "newest"), buckets=8)
    for day in DAYS:
        got = S.previous_of(newest.before(spark, history, day), day)
        want = S.prev_scores(history, day)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert newest.days(spark) == DAYS and newest.read(spark, DAYS[-1]).count() > 10
    newest.forget(spark, DAYS[1])
    assert newest.days(spark) == DAYS[:2]
    assert sorted(newest.before(spark, history, DAYS[-1]).collect()) == sorted(
        history.where(F.col("ts") < dt.datetime(2024, 1, 29, 15)).groupBy("user_id").agg(F.max(F.struct("ts", "risk_score")).alias("s")).select("user_id", "s.*").collect()
    )


def test_no_scores_yet(spark, tmp_path):
    newest = NewestScores(str(tmp_path / "newest"), buckets=4)
    assert newest.before(spark, None, "2024-01-01").count() == 0
    assert newest.before(spark, None, "2024-01-02").columns == ["user_id", "ts", "risk_score"]


def test_a_generation_is_joined_without_a_shuffle_and_reads_days_since(spark, history, tmp_path):
    newest = NewestScores(str(tmp_path / "newest"), buckets=8)
    newest.before(spark, history, DAYS[0])
    kept = S.previous_of(newest.before(spark, history, DAYS[1]), DAYS[1]).where("prev_score > 0")
    other = history.groupBy("user_id").agg(F.count("*").alias("n"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = other.join(kept, "user_id", "full_outer")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    side = plan.split("- Sort [")[-1]  # the right side of the join
    assert "Bucketed: true" in side and "Exchange" not in side and "FullOuter" in plan
    made = NewestScores(str(tmp_path / "newest"), buckets=8).before(spark, history, DAYS[2])._jdf.queryExecution().executedPlan().toString()
    assert "snapshots" not in made and "scores/" not in made  # a finished generation reads no scores

"""Streams give what the batch operators give; repeated runs change nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duskwatch import datasets as D
from duskwatch.functions.predicates import on_days
from duskwatch.operators import behaviour as B
from duskwatch.operators import detect as DT
from duskwatch.operators import rules as R
from duskwatch.operators import scoring as S
from duskwatch.operators.timeline import risk_timeline
from duskwatch.plans.daily import DailyJob
from duskwatch.sources import history, stores
from duskwatch.streaming import detection as SD
from duskwatch.streaming.scores import ScoreStream, current_scores

COLS = ("alert_id", "rule_id", "user_id", "cnt", "ts")


@pytest.fixture(scope="module")
def files(spark, small, tmp_path_factory):
    """The events in many files, in shuffled order within a day, plus a row far in the future that closes all windows."""
    path = str(tmp_path_factory.mktemp("stream") / "events")
    src = D.source(spark, small)
    src.withColumn("d", F.to_date("ts")).repartitionByRange(30, "d").drop("d").write.parquet(path)
    end = src.limit(1).withColumns({"ts": F.lit(dt.datetime(2024, 3, 1)).cast("timestamp"), "event_id": F.lit(10**9), "user_id": F.lit(10**6)})
    end.select(*src.columns).write.mode("append").parquet(path)
    return path


def run(spark, out, tmp_path, name="out"):
    path, cp = str(tmp_path / name), str(tmp_path / f"{name}-cp")
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.select(*COLS).collect() if r.user_id != str(10**6))


def stream(spark, path, delay="2 days", per_trigger=None, **kw):
    reader = spark.readStream.schema(D.EVENTS_DDL)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return SD.prepared(D.modelled(reader.parquet(path)), delay, **kw)


@pytest.mark.parametrize("ids", [("error_burst", "host_signups", "repeat_click", "error_and_purchase"), ("blocked_error", "odd_signup_or_view")])
def test_stream_equals_batch(spark, small, files, tmp_path, ids):
    rules = R.collect_rules(R.rules_frame(spark, [r for r in D.DETECTION_RULES if r["id"] in ids]))
    batch = rows(DT.detect(D.events(spark, small), rules))
    got = rows(run(spark, SD.detect_stream(stream(spark, files), rules), tmp_path).where("cnt > 0"))
    assert [r for r in got] == batch and batch


@pytest.mark.parametrize("name", ["three_allowed", "long_allowed_run"])
def test_sequence_stream_equals_batch(spark, small, files, tmp_path, name):
    rules = R.collect_rules(R.rules_frame(spark, [r for r in D.SEQUENCE_RULES if r["id"] == name]))
    batch = rows(DT.detect(D.events(spark, small), rules))
    got = rows(run(spark, SD.detect_stream(stream(spark, files, per_trigger=6), rules), tmp_path))
    assert got == batch and batch


def test_ordered_rules_of_a_key_list_share_one_operator(spark, small, files, tmp_path):
    rules = R.collect_rules(R.rules_frame(spark, D.SEQUENCE_RULES))
    out = SD.detect_stream(stream(spark, files, per_trigger=4), rules)
    assert out._jdf.queryExecution().analyzed().toString().count("TransformWithState") == 1
    batch = rows(DT.detect(D.events(spark, small), rules))
    assert rows(run(spark, out, tmp_path)) == batch and len({r[1] for r in batch}) == 4


def test_events_sent_twice_count_once(spark, small, files, tmp_path):
    rules = R.collect_rules(R.rules_frame(spark, [r for r in D.DETECTION_RULES if r["id"] == "error_burst"]))
    twice = str(tmp_path / "twice")
    spark.read.schema(D.EVENTS_DDL).parquet(files).write.parquet(twice)
    spark.read.schema(D.EVENTS_DDL).parquet(files).write.mode("append").parquet(twice)
    got = rows(run(spark, SD.detect_stream(stream(spark, twice, dedup=True), rules), tmp_path))
    assert got == rows(DT.detect(D.events(spark, small), rules))


def test_late_events_are_dropped(spark, tmp_path):
    rules = R.collect_rules(R.rules_frame(spark, [{"id": "t", "enabled": True, "match": {"msgId": "MESSAGE_CLICK"}, "aggregate": {"within": "1h"}}]))
    src = str(tmp_path / "src")
    t = lambda h: dt.datetime(2024, 1, 1, h, 30)
    # A row is late when the watermark of the batch before its own has passed it.
    for i, hours in enumerate([[1], [9], [9], [1], [20]]):
        data = [(i * 10 + j, t(h), 1, "click", 1.0, '{"k": 1}') for j, h in enumerate(hours)]
        spark.createDataFrame(data, D.EVENTS_DDL).coalesce(1).write.mode("append").parquet(src)
    got = run(spark, SD.detect_stream(stream(spark, src, "10 minutes", per_trigger=1), rules), tmp_path).collect()
    assert sorted((r.ts.hour, r.cnt) for r in got) == [(2, 1), (10, 2)]


def scoring(spark):
    return R.collect_rules(R.rules_frame(spark, D.SCORING_RULES)), S.Settings.of(**D.SETTINGS)


def test_score_stream_equals_batch_and_repeats_nothing(spark, small, tmp_path):
    rules, settings = scoring(spark)
    events, profiles = D.events(spark, small), D.user_profiles(spark, small)
    known = B.all_baselines(B.event_counts(events), D.AS_OF, 7)
    prev = S.prev_scores(D.snapshots(spark, small), D.AS_OF)
    day = events.where(on_days("ts", D.AS_OF))
    job = ScoreStream(rules, settings, lambda s, d: (known, profiles, prev), str(tmp_path / "counters"), str(tmp_path / "scores"))
    parts = [day.where(F.col("event_id") % 3 == i) for i in range(3)]
    for i, part in enumerate(parts):
        job.on_batch(part, i)
    job.on_batch(parts[2], 2)
    batch = S.score_day(events, rules, known, profiles, prev, settings, D.AS_OF)
    key = lambda df: {r.user_id: (r.risk_score, r.rule_score, r.anomaly_score, r.event_counts) for r in df.collect()}
    want = {u: v for u, v in key(batch).items() if v[3]}
    assert key(current_scores(spark, job.scores_path, D.AS_OF)) == want
    job.close_day(spark, D.AS_OF, str(tmp_path / "final"))
    assert key(spark.read.parquet(str(tmp_path / "final"))) == key(batch)


def test_daily_job_equals_timeline(spark, small, tmp_path):
    rules, settings = scoring(spark)
    settings = S.Settings.of(**{**D.SETTINGS, "weekend_mode": ""})
    events, profiles = D.events(spark, small), D.user_profiles(spark, small)
    log = str(tmp_path / "log")
    stores.write_event_log(events, log)
    job = DailyJob(log, str(tmp_path / "baselines"), str(tmp_path / "scores"), settings)
    days = ["2024-01-10", "2024-01-11", "2024-01-12"]
    for day in days:
        job.run(spark, rules, profiles, day)
    first = job.scores(spark).select("user_id", "day", "risk_score").orderBy("user_id", "day").collect()
    job.run(spark, rules, profiles, days[-1])
    assert job.scores(spark).select("user_id", "day", "risk_score").orderBy("user_id", "day").collect() == first
    line = {(r.user_id, r.day): r for r in risk_timeline(events, rules, profiles, settings, days[0], days[-1]).collect()}
    line = {k: r for k, r in line.items() if k[1].isoformat() in days}
    # The job lists users once they have events or a score; the timeline from their first event on.
    assert first and all(r.risk_score == line[(r.user_id, r.day)].risk_score for r in first)
    assert {k for k, r in line.items() if r.risk_score > 0} <= {(r.user_id, r.day) for r in first}


def test_rescoring_after_a_rule_change(spark, small, tmp_path):
    rules, settings = scoring(spark)
    log = str(tmp_path / "log")
    stores.write_event_log(D.events(spark, small), log)
    job = DailyJob(log, str(tmp_path / "baselines"), str(tmp_path / "scores"), settings)
    profiles = D.user_profiles(spark, small)
    job.run(spark, rules, profiles, D.AS_OF)
    before = job.scores(spark).agg(F.sum("rule_score"), F.count("*")).first()
    job.score(spark, [{**r, "weight": 2 * r["weight"]} for r in rules], profiles, D.AS_OF)
    after = job.scores(spark).agg(F.sum("rule_score"), F.count("*")).first()
    assert after[0] > before[0] and after[1] == before[1]


def test_daily_job_reads_events_of_new_days_alone(spark, small, tmp_path, monkeypatch):
    """A run reads its own day and the one before; a change of weights reads counters, a change of what is counted its day."""
    rules, settings = scoring(spark)
    log, asked = str(tmp_path / "log"), []
    stores.write_event_log(D.events(spark, small), log)
    job = DailyJob(log, str(tmp_path / "baselines"), str(tmp_path / "scores"), settings)
    read = DailyJob.log
    monkeypatch.setattr(DailyJob, "log", lambda self, spark, first, last: asked.append((first, last)) or read(self, spark, first, last))
    profiles = D.user_profiles(spark, small)
    job.run(spark, rules, profiles, "2024-01-29")
    assert asked[0] == ("2024-01-28", "2024-01-29") and asked[1:] == [("2024-01-22", "2024-01-27")]
    asked.clear()
    job.run(spark, rules, profiles, "2024-01-30")
    assert asked == [("2024-01-29", "2024-01-30")]
    asked.clear()
    job.score(spark, [{**r, "weight": 3 * r["weight"]} for r in rules], profiles, "2024-01-30")
    assert asked == []
    job.score(spark, rules[1:], profiles, "2024-01-30")
    assert asked == [("2024-01-30", "2024-01-30")]
    known = {(r.user_id, r.msg_id): (r.mean, r.stddev, r.sample_days) for r in job.baselines(spark, "2024-01-30").where("scope = 'user'").collect()}
    fresh = B.baselines(B.window_counts(D.events(spark, small), "2024-01-30", 7), "2024-01-30", 7).collect()
    assert known.items() >= {(r.user_id, r.msg_id): (r.mean, r.stddev, r.sample_days) for r in fresh}.items()


def test_sketches_add_up_over_batches_and_days(spark):
    """Two overlapping batches and three days: the union is within the bound of error, per day and over all days."""
    spec = next(r for r in scoring(spark)[0] if r["agg_type"] == "cardinality")
    compiled = [spec]
    ids = spark.range(60_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704200000) + (F.col("id") % 3) * 86400).alias("ts"),
        F.lit(spec["scored"]["msg_id"]).alias("msg_id"), F.lit("h").alias("hostname"), F.lit("app").alias("app_name"),
        F.when(F.col("id") % 10 < 7, "hot").otherwise("u").alias("user_id"), F.lit("n").alias("user_name"), F.lit("ip").alias("user_ip"),
        F.create_map(F.lit(spec["agg_field"]), (F.col("id") % 20_000).cast("string")).alias("ext"),
    )
    first, second = ids.where("event_id < 40000"), ids.where("event_id >= 30000")
    parts = B.sketches(first, compiled).unionByName(B.sketches(second, compiled))
    exact = {(r.user_id, r.day): r.value for r in B.rule_values(ids, compiled).collect()}
    near = {(r.user_id, r.day): r.value for r in B.sketched_values(B.merged_sketches(parts)).collect()}
    assert exact.keys() == near.keys() and len(exact) == 6
    assert all(abs(near[k] - v) <= 0.06 * v for k, v in exact.items())
    over = {r.user_id: r.value for r in B.sketched_values(B.merged_sketches(parts, "user_id", "kind", "name")).collect()}
    assert abs(over["hot"] - 14_000) <= 0.06 * 14_000 and abs(over["u"] - 6_000) <= 0.06 * 6_000
    plan = B.sketches(ids, compiled)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0]


def test_alert_writes_are_idempotent_and_take_a_default_time(spark, small, tmp_path):
    rules = R.collect_rules(R.rules_frame(spark, D.DETECTION_RULES[:2]))
    alerts = DT.detect(D.events(spark, small), rules)
    no_time = alerts.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))
    path, now = str(tmp_path / "alerts"), F.lit(dt.datetime(2024, 2, 2, tzinfo=dt.timezone.utc))
    for _ in range(2):
        stores.write_alerts(alerts, path, now, run="0")
        stores.write_alerts(no_time, path, now, run="1")
    stored = spark.read.parquet(path)
    assert stored.count() == alerts.count() + 1
    assert stored.where("day = date'2024-02-02'").count() == 1


def test_snapshot_upsert_takes_the_last_write(spark, tmp_path):
    path = str(tmp_path / "s")
    t = lambda m: dt.datetime(2024, 1, 1, 3, m)
    make = lambda data: spark.createDataFrame(data, "user_id string, ts timestamp, risk_score double")
    stores.upsert_scores(make([("a", t(1), 1.0), ("a", t(5), 2.0), ("b", t(1), 3.0)]), path)
    stores.upsert_scores(make([("a", t(2), 9.0), ("a", t(1) + dt.timedelta(days=1), 4.0)]), path)
    assert sorted((r.user_id, r.day.day, r.risk_score) for r in spark.read.parquet(path).collect()) == [("a", 1, 9.0), ("a", 2, 4.0), ("b", 1, 3.0)]


def test_history_rows(spark, tmp_path):
    rows_ = [(i, dt.datetime(2024, 1, 1, random.randrange(24)), "h", "M", "LOW", {"suid": f"u{i}", "act": "x", "fname": "f"}) for i in range(50)]
    df = spark.createDataFrame(rows_, "log_pk bigint, time timestamp, hostname string, msg_id string, severity string, cef_extensions map<string,string>")
    for _ in range(2):
        history.backfill_history(df, str(tmp_path / "h"), run="r")
    got = spark.read.parquet(str(tmp_path / "h"))
    assert got.count() == 50 and got.where("user_id = 'u7' and action = 'x' and file_name = 'f' and user_mac is null").count() == 1
    assert len(history.history_events(df).columns) == 14


def test_recovery_from_the_log(spark, small, tmp_path):
    """Recovered scores are those of the stream; batches that come after add to them, and counters of batches are never doubled."""
    rules, settings = scoring(spark)
    events = D.events(spark, small)
    day = events.where(on_days("ts", D.AS_OF)).orderBy("event_id").collect()
    early, late = (spark.createDataFrame(part, events.schema) for part in (day[: len(day) // 2], day[len(day) // 2 :]))
    none = spark.createDataFrame([], "scope string, user_id string, msg_id string, mean double, stddev double, sample_days int, updated date")
    before = spark.createDataFrame([("absent", 50.0, 1)], "user_id string, prev_score double, days_since int")
    context = lambda s, d: (none, D.user_profiles(s, small), before)

    def job(name):
        return ScoreStream(rules, settings, context, str(tmp_path / f"{name}-counters"), str(tmp_path / f"{name}-scores"))

    def rows(j):
        return {r.user_id: (r.risk_score, r.rule_score, r.event_counts) for r in current_scores(spark, j.scores_path, D.AS_OF).collect()}

    whole, two = job("whole"), job("two")
    whole.recover(spark, events, D.AS_OF)
    assert "absent" in rows(whole) and len(rows(whole)) > 3
    two.recover(spark, early, D.AS_OF)
    two.recover(spark, early, D.AS_OF)
    two.on_batch(late, 7)
    assert {u: v for u, v in rows(two).items() if v[2]} == {u: v for u, v in rows(whole).items() if v[2]}
    with pytest.raises(ValueError, match="twice"):
        two.recover(spark, early, D.AS_OF)


def test_days_before_the_first_scored_one_are_counted_only(spark, small, tmp_path):
    rules, settings = scoring(spark)
    none = spark.createDataFrame([], "scope string, user_id string, msg_id string, mean double, stddev double, sample_days int, updated date")
    nobody = spark.createDataFrame([], "user_id string, prev_score double, days_since int")
    job = ScoreStream(rules, settings, lambda s, d: (none, D.user_profiles(s, small), nobody), str(tmp_path / "c"), str(tmp_path / "s"), score_from=D.AS_OF)
    job.on_batch(D.events(spark, small), 0)
    assert min(r.day for r in spark.read.parquet(job.scores_path).select("day").distinct().collect()).isoformat() == D.AS_OF
    assert spark.read.parquet(job.counters_path).select("day").distinct().count() > 20


def test_files_read_per_batch_stay_flat(spark, small, tmp_path):
    """Counters of many batches: each sum equals that of all batches, a repeated batch sees its own past, and the files read don't grow."""
    rules, settings = scoring(spark)
    job = ScoreStream(rules, settings, None, str(tmp_path / "c"), str(tmp_path / "s"), score_from="2999-01-01", compact_every=4, buckets=4)
    events = D.events(spark, small).where(on_days("ts", D.AS_OF)).limit(6).cache()
    key = lambda df: sorted(tuple(r) for r in B.merged(df).select("user_id", "kind", "name", "text", "n").fillna("").collect())
    read = []
    for i in range(20):
        job.on_batch(events, i)
        read.append(len(job.stored(spark, D.AS_OF, i).inputFiles()))
    one = spark.read.parquet(job.counters_path).where("batch = 0").select("user_id", "kind", "name", "text", "n").fillna("").collect()
    for i in (0, 3, 4, 10, 19):
        assert key(job.stored(spark, D.AS_OF, i)) == sorted((r.user_id, r.kind, r.name, r.text, r.n * (i + 1)) for r in one)
    assert max(read[12:]) <= max(read[4:12]) <= 4 * read[0] + 4
    job.on_batch(events, 11)
    assert key(job.stored(spark, D.AS_OF)) == sorted((r.user_id, r.kind, r.name, r.text, r.n * 20) for r in one)
    users = events.select("user_id").distinct().limit(1)
    mine = job.stored(spark, D.AS_OF, 19, users).join(users, "user_id")
    assert key(mine) == [k for k in key(job.stored(spark, D.AS_OF, 19)) if k[0] == users.first()[0]]

import datetime as dt

from pyspark.sql import functions as F

from duskwatch.operators import normalize as N
from duskwatch.plans.ingest import start_ingest
from duskwatch.sources import streams

UTC = dt.timezone.utc


def expand(spark, ext):
    df = spark.createDataFrame([(ext,)], "ext map<string,string>")
    return N.expand_labels(df).first()["ext"]


def test_label_pairs(spark):
    assert expand(spark, {"cs1Label": "Config Type", "cs1": "ipchange"}) == {"cs1Label": "Config Type", "cs1": "ipchange", "ConfigType": "ipchange"}


def test_label_without_text_or_value_adds_nothing(spark):
    for ext in ({"cs1Label": "", "cs1": "x"}, {"cs1Label": "A"}, {"cs1Label": "A", "cs1": ""}, {"a": "b"}, {}):
        assert expand(spark, ext) == ext
    assert expand(spark, None) is None


def test_label_replaces_equal_key_and_last_pair_wins(spark):
    assert expand(spark, {"A": "old", "cs1Label": "A", "cs1": "new"})["A"] == "new"
    assert expand(spark, {"cs1Label": "A", "cs1": "one", "cs2Label": "A", "cs2": "two"})["A"] == "two"


RAW = [
    '{"event_id": 1, "@timestamp": "2024-01-30T10:00:00+09:00", "msgId": "M", "cefExtensions": {"suid": "u", "n": 5, "cs1Label": "A B", "cs1": "v"}}',
    '{"event_id": 2, "msgId": "M", "userId": "direct", "cefExtensions": {"suid": "u"}}',
    '{"event_id": 3, "msgId": "M"}',
    '{"event_id": 4, "cefExtensions": {"suid": "u"}}',
    '{"event_id": 5, "msgId": "M", "cefExtensions": "text"}',
    "not json",
    '{"broken": ',
    "[1, 2]",
]


def test_parse_drops_only_malformed_text(spark):
    df = spark.createDataFrame([(r,) for r in RAW], "value string")
    rows = {r.event_id: r for r in streams.parse_events(df).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1].ts == dt.datetime(2024, 1, 30, 1, tzinfo=UTC).replace(tzinfo=None) and rows[1].ext["n"] == "5"
    assert rows[2].ts is None and rows[2].user_id == "direct" and rows[5].ext is None
    assert {r.value for r in streams.malformed(df).collect()} == set(RAW[5:])


def test_resolve_user(spark):
    df = spark.createDataFrame([(r,) for r in RAW[:5]], "value string")
    got = {r.event_id: r.user_id for r in N.resolve_user(streams.parse_events(df)).collect()}
    assert got == {1: "u", 2: "direct"}


def test_ingest_stream_and_json_round_trip(spark, tmp_path):
    src, log, out, bad = (str(tmp_path / n) for n in ("in", "log", "out", "bad"))
    spark.createDataFrame([(r,) for r in RAW], "value string").coalesce(1).write.text(src)
    run = lambda: start_ingest(streams.read_events_stream(spark, src), log, str(tmp_path / "cp"), out, bad, availableNow=True).awaitTermination()
    run()
    rows = {r.event_id: r for r in spark.read.parquet(log).collect()}
    assert set(rows) == {1, 2, 3, 4, 5} and rows[1].day == dt.date(2024, 1, 30) and rows[1].ext["AB"] == "v"
    assert rows[2].ts is not None
    again = streams.parse_events(spark.read.parquet(out))
    assert {r.event_id for r in again.collect()} == {1, 2, 3, 4, 5} and again.where("event_id = 1").first().ts == rows[1].ts
    assert spark.read.parquet(bad).count() == 3
    run()
    assert spark.read.parquet(log).count() == 5


def test_report_columns_fall_back(spark):
    df = spark.createDataFrame(
        [(1, "MESSAGE_X", "", {"suid": "u", "shost": "h", "act": "a", "outcome": "o"}), (2, "Y", "top", {"suid": "u"})],
        "event_id bigint, msg_id string, user_id string, ext map<string,string>",
    ).withColumn("ts", F.lit(dt.datetime(2024, 1, 1, tzinfo=UTC)))
    rows = {r.event_id: r for r in N.event_report_columns(df).collect()}
    assert (rows[1].type, rows[1].user_id, rows[1].hostname, rows[1].action, rows[1].outcome) == ("X", "u", "h", "a", "o")
    assert (rows[2].user_id, rows[2].hostname) == ("top", "")


def test_local_time_is_independent_of_the_session_zone(spark):
    df = spark.createDataFrame([(1,)], "i int").withColumn("ts", F.lit(dt.datetime(2024, 1, 1, 20, tzinfo=UTC)))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(N.local_time("ts")).first()[0] == "01-02 05:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

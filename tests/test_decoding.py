"""JSON is decoded once per row, whatever reads the result; the rows stay the same."""

from pyspark.sql import functions as F

from duskwatch.sources.streams import malformed, parse_events, to_json_events

TEXTS = [
    '{"event_id": 1, "msgId": "M", "userId": "u", "severity": 7, "zone": {"name": "z7"}, "cefExtensions": {"a": "b", "severity": "own"}}',
    '{"event_id": 2, "msgId": "M", "userId": ""}', '{"event_id": "x", "msgId": "N", "more": null}', '{"other": 5}', "no json", "[1]", "", None,
]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_does_not_copy_the_decoding(spark, tmp_path):
    spark.createDataFrame([(t,) for t in TEXTS], "value string").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    back = parse_events(to_json_events(parse_events(texts))).where(F.length("user_id") > 0)
    x = back.select("event_id", F.from_json("extra", "severity int, zone struct<name:string>").alias("x"))
    picked = x.where("x.zone.name = concat('z', x.severity)")
    assert [tuple(r) for r in picked.select("event_id", "x.severity").collect()] == [(1, 7)]
    assert plan(picked).count("variant") <= 2 and plan(picked).count("@timestamp,StringType,true), StructField(msgId") <= 6


def test_rows_kept_and_dropped(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "value string")
    rows = {r.event_id: r for r in parse_events(texts).where("event_id is not null").collect()}
    assert rows[1].ext == {"a": "b", "severity": "own", "zone": '{"name":"z7"}'} and rows[1].extra == '{"severity":7,"zone":{"name":"z7"}}'
    assert rows[2].user_id is None and rows[2].ext is None and rows[2].extra is None
    assert sorted(str(r.msg_id) for r in parse_events(texts).collect()) == ["M", "M", "N", "None"]
    assert [r.value for r in malformed(texts).collect()].count("no json") == 1

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duskwatch import datasets as D
from duskwatch.operators import catalog
from duskwatch.operators import reports as R
from duskwatch.sources import streams


@pytest.mark.parametrize("descending", [True, False])
def test_far_pages_equal_top_k(spark, small, monkeypatch, descending):
    e = D.source(spark, small).select("event_id", "event_type", "value")
    want = [tuple(r) for r in R.page(e, "event_type", descending, 390, 25).rows.collect()]
    monkeypatch.setattr(R, "TOP_K_ROWS", 10)
    far = R.page(e, "event_type", descending, 390, 25)
    assert [tuple(r) for r in far.rows.collect()] == want and len(want) == 25
    assert far.total.first()[0] == e.count()


def test_pages_tile_the_rows(spark, small):
    e = D.source(spark, small).select("event_id", "event_type")
    ids = [r.event_id for s in range(0, 1000, 250) for r in R.page(e, "event_type", True, s, 250).rows.collect()]
    assert len(ids) == 1000 == len(set(ids))


def test_catalog_hides_raw_keys_of_a_type(spark):
    rows = [
        (1, "A", {"cs1Label": "Config Type", "cs1": "x", "k": "1"}), (2, "A", {"cs1": "y", "cs2Label": "", "cs2": "z"}),
        (3, "B", {"cs1": "y"}), (4, "B", None), (5, "", {"q": "1"}),
    ]
    df = spark.createDataFrame(rows, "event_id bigint, msg_id string, ext map<string,string>").withColumn("ts", F.lit(dt.datetime(2024, 1, 30, tzinfo=dt.timezone.utc)))
    got = {r.msg_id: (r.fields, r.sample_count) for r in catalog.field_catalog(df, "2024-01-30").collect()}
    assert got == {"A": (["ConfigType", "cs2", "k"], 2), "B": (["cs1"], 2)}


def test_values_of_a_labelled_field(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [
        (t(1), "A", {"cs1Label": "Mode", "cs1": "old"}), (t(2), "A", {"cs2Label": "Mode", "cs2": "new", "Mode": "new"}),
        (t(3), "A", {"cs2": "bare"}), (t(4), "B", {"cs3Label": "Mode", "cs3": "other"}),
    ]
    df = spark.createDataFrame(rows, "ts timestamp, msg_id string, ext map<string,string>")
    assert {(r.value, r.cnt) for r in catalog.field_values(df, "A", "Mode").collect()} == {("new", 2), ("bare", 1)}


def test_published_stream_can_be_read_again(spark, small, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    D.source(spark, small).write.parquet(src)
    rows = D.modelled(streams.read_events_stream(spark, src, "parquet", D.source(spark, small).schema))
    streams.write_events_stream(rows, out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = streams.parse_events(spark.read.text(out))
    assert got.select("event_id", "ts", "msg_id").exceptAll(D.events(spark, small).select("event_id", "ts", "msg_id")).count() == 0
    assert got.count() == 1000


def test_history_of_one_user(spark, small):
    one = R.score_history(D.snapshots(spark, small), D.AS_OF, "7")
    assert one["daily"].count() in (0, 7) and {r.user_id for r in one["daily"].collect()} <= {"7"}


def test_approximate_distinct_counts(spark, small):
    from duskwatch.operators import behaviour as B
    from duskwatch.operators import rules as RR

    rules = RR.collect_rules(RR.rules_frame(spark, D.SCORING_RULES))
    key = lambda df: sorted((r.user_id, r.rule_id, str(r.day), round(r.value, 6)) for r in df.collect())
    e = D.events(spark, small)
    assert key(B.rule_values(e, rules, approx=True)) == key(B.rule_values(e, rules))

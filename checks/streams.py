"""Streaming forms, driven to the end over the stored table."""

from __future__ import annotations

from duskwatch import datasets as D
from duskwatch.operators.scoring import prev_scores
from duskwatch.session import stage_path
from duskwatch.sources.stores import read_day_range, write_event_log
from duskwatch.streaming import detection as SD
from duskwatch.streaming.scores import ScoreStream, current_scores

from . import EV, PROFILES, SNAP, query, with_
from .behaviour import CNT, VALUES, WEEK
from .detection import _PAIR, _PAIR_ALERTS, _ROWS, _RUN, _RUN_ALERTS, _TRIPLE, _TRIPLE_ALERTS, BOTH, BURST, EITHER, HOSTS, REPEAT, SHOWN, SINGLE, compiled, shown
from .scoring import CTX, DAILY, LOOKED, PREV, SETTINGS, WEIGHTED, _known

#: The last windows stay open until the watermark, ten minutes behind the newest event, has passed them.
CLOSED = "ts <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE"
#: Rows in order are settled before the watermark, which counts milliseconds.
SETTLED = "ts < (SELECT date_trunc('milliseconds', max(ts)) FROM ev) - INTERVAL 10 MINUTE"


def stream(spark, sf_dir):
    rows = spark.readStream.schema(D.EVENTS_DDL).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return SD.prepared(D.modelled(rows))


def drained(spark, out, name):
    path = stage_path(spark, name)
    run = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", stage_path(spark, f"{name}-log"))
    run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query("stream_row_rules", with_(EV) + shown(SINGLE + " UNION ALL " + EITHER))
def stream_row_rules(spark, d):
    rules = compiled(spark, D.DETECTION_RULES, "blocked_error", "odd_purchase", "odd_signup_or_view")
    return drained(spark, SD.detect_stream(stream(spark, d), rules), "alerts").select(*SHOWN)


@query("stream_window_rules", with_(EV) + shown(f"SELECT * FROM ({' UNION ALL '.join([BURST, HOSTS, REPEAT, BOTH])}) WHERE {CLOSED}"))
def stream_window_rules(spark, d):
    rules = compiled(spark, D.DETECTION_RULES, "error_burst", "host_signups", "repeat_click", "error_and_purchase")
    return drained(spark, SD.detect_stream(stream(spark, d), rules), "alerts").select(*SHOWN)


def ordered_stream(spark, d, *ids):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return drained(spark, SD.detect_stream(stream(spark, d), compiled(spark, D.SEQUENCE_RULES, *ids)), "alerts").select(*SHOWN)


@query("stream_sequence", with_(EV, _ROWS, _PAIR) + shown(f"SELECT * FROM ({_PAIR_ALERTS}) WHERE {SETTLED}"))
def stream_sequence(spark, d):
    return ordered_stream(spark, d, "error_then_purchase")


# Of these rules a match is decided with its last row.
@query("stream_sequences", with_(EV, _ROWS, _PAIR, _TRIPLE, _RUN) + shown(f"SELECT * FROM ({_PAIR_ALERTS} UNION ALL {_TRIPLE_ALERTS} UNION ALL {_RUN_ALERTS}) WHERE {SETTLED}"))
def stream_sequences(spark, d):
    """Fixed and variable repeats in one keyed operator."""
    return ordered_stream(spark, d, "error_then_purchase", "three_allowed", "allowed_then_blocked")


def score_stream(spark, d):
    rules = compiled(spark, D.SCORING_RULES)
    _, known = _known(spark, d)
    snaps = D.snapshots(spark, d)

    def context(session, day):
        return known, D.user_profiles(session, d), prev_scores(snaps, day)

    return ScoreStream(rules, SETTINGS, context, stage_path(spark, "counters"), stage_path(spark, "stream-scores"), score_from=D.AS_OF)


_SCORES = with_(EV, VALUES, WEIGHTED, CNT, WEEK, LOOKED, SNAP, PREV, PROFILES, CTX, DAILY)


@query("stream_scores", _SCORES + "SELECT user_id, risk AS risk_score, prev_score, rs AS rule_score, sc AS anomaly_score FROM fin WHERE user_id IN (SELECT user_id FROM an)")
def stream_scores(spark, d):
    """The whole stream with previous scores; shown are the users with events on the last of its days that is looked at."""
    job = score_stream(spark, d)
    job.start(stream(spark, d), stage_path(spark, "score-log"), availableNow=True).awaitTermination()
    return current_scores(spark, job.scores_path, D.AS_OF).select("user_id", "risk_score", "prev_score", "rule_score", "anomaly_score")


@query("recovered_scores", _SCORES + "SELECT user_id, risk AS risk_score, prev_score, rs AS rule_score, sc AS anomaly_score FROM fin")
def recovered_scores(spark, d):
    """Scores of a day from the stored log after its counters are lost: all users with events or a previous score."""
    log = stage_path(spark, "event-log")
    write_event_log(D.events(spark, d), log)
    job = score_stream(spark, d)
    job.recover(spark, read_day_range(spark, log, D.AS_OF, D.AS_OF), D.AS_OF)
    return current_scores(spark, job.scores_path, D.AS_OF).select("user_id", "risk_score", "prev_score", "rule_score", "anomaly_score")

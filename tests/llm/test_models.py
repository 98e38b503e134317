import random

import numpy as np
import pytest
from fixtures import documents
from pyspark.sql import functions as F

import corpus_pipeline
from duskwatch.llm import decontaminate, near_text, pii, resample, topk, toxicity
from duskwatch.session import stage


def test_top_k_agrees_with_sorting(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([-(1 << 63), (1 << 63) - 1, 0, -1, rng.randint(-50, 50), rng.randint(-(1 << 62), 1 << 62)]), i * 7919 % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x long, y long").cache()
    ranked = sorted(((x, y) for _, x, y in rows), reverse=True)
    for k in (0, 1, 2, 77, 250, 499, 500, 900):
        found = topk.cut(df, k, F.col("x"), F.col("y"))
        got = sorted(((r["x"], r["y"]) for r in (df if found is None else df.filter(found)).collect()), reverse=True)
        want = [r for r in ranked if k and r >= ranked[min(k, 500) - 1]]
        assert got == want


def corpus(rng, n=240):
    good = lambda: " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta.", "of", "the"]) for _ in range(rng.randint(3, 80)))
    bad = lambda: " ".join(rng.choice(["CLICK!!", "buy***", "now###", "$$$", "x|"]) for _ in range(rng.randint(6, 80)))
    return [(i, good() if i % 4 else bad()) for i in range(n)]


def test_resampling_keeps_good_rows_and_rejects_junk(spark):
    rows = corpus(random.Random(2)) + [(900, None), (901, ""), (3, "repeated key"), (3, "repeated key")]
    df = documents(spark, rows).withColumnRenamed("lang", "sample_key").withColumnRenamed("source", "log_weight")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 240, 3)] + [(None, 1), (3, None)], "doc_id long, quality int")
    result = {r["doc_id"]: r["kept"] for r in resample.sample(df, labels, F.col("quality") == 1).collect()}
    assert all(result[i] == bool(i % 4) for i in range(240)) and result[900] and result[901]
    kept = resample.keep(df, labels, F.col("quality") == 1)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _ in rows if result[k])
    assert resample.sample(df, labels, F.col("quality") == 1, k=50).filter("kept").count() in (50, 51, 52)
    assert resample.keep(df.limit(0), labels, F.col("quality") == 1).count() == 0
    assert resample.keep(df, labels.limit(0), F.col("quality") == 1).count() == len(rows)


def test_ratios_agree_with_counts(spark):
    rows = corpus(random.Random(3), 60)
    df = documents(spark, rows)
    model = resample.fit(df, spark.createDataFrame([(i,) for i in range(60) if i % 4], "__target long"))
    import pyarrow as pa

    raw, target = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    for i, t in rows:
        _, bucket = resample.ngrams(pa.array([t]))
        assert len(bucket) == 2 * len(t.split()) - 1
        np.add.at(raw, bucket, 1)
        if i % 4:
            np.add.at(target, bucket, 1)
    want = np.log((target * raw.sum() / target.sum() + resample.SMOOTHING) / (raw + resample.SMOOTHING))
    assert np.allclose(model.ratio, want)
    _, bucket = resample.ngrams(pa.array([rows[5][1]]))
    assert resample.score(df, model).filter("doc_id = 5").first()["log_weight"] == pytest.approx(want[bucket].sum())


def test_gumbel_draws_follow_the_weights(spark):
    """The larger of two keys is that of the weightier row in proportion to the weights."""
    pair = spark.range(20_000).select(F.col("id"), (F.log(F.lit(3.0)) + resample.gumbel(F.col("id"), seed=1) > resample.gumbel(F.col("id"), seed=2)).alias("won"))
    assert abs(pair.filter("won").count() / 20_000 - 0.75) < 0.02


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = np.digitize(x @ [2.0, 1.0, 0.0] + rng.logistic(size=600), [-1.0, 2.0])
    row, feature = np.repeat(np.arange(600), 3), np.tile(np.arange(3), 600)
    w, cuts = toxicity.fit_thresholds(row, feature, x.ravel(), y, 3, steps=2000, rate=0.05)
    assert np.allclose(w, [2, 1, 0], atol=0.4) and np.allclose(cuts, [-1, 2], atol=0.4) and cuts[0] < cuts[1]

    def loss(w):
        over = [1 - toxicity._sigmoid(c - x @ w) for c in cuts]
        p = np.stack([1 - over[0], over[0] - over[1], over[1]])[y, np.arange(600)]
        return -np.log(p).mean()

    assert all(loss(w) <= loss(w + d) + 1e-4 for d in np.vstack([np.eye(3), -np.eye(3)[:2]]) * 0.05)


def test_held_out_toxicity(spark):
    """Half of the labels fit the model, the other half judge it."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = toxicity.fit(stage(toxicity.labelled(docs, labels.filter(half == 0), "doc_id", "text", "doc_id", F.col("toxic")), "t"), split=True)
    seen = toxicity.score(docs, model).join(labels.filter(half == 1), "doc_id").groupBy("toxic").agg(F.avg((F.col("toxicity_p") >= 0.5).cast("int")).alias("share"), F.avg("toxicity_severity").alias("severity"))
    got = {r["toxic"]: r for r in seen.collect()}
    assert got[1]["share"] > 0.8 and got[0]["share"] < 0.02 and got[1]["severity"] > 1 > 0.1 > got[0]["severity"]


def test_toxicity_of_odd_tables(spark):
    df = documents(spark, [(1, None), (1, ""), (None, "You FOOL again"), (2, "kind")]).withColumnRenamed("lang", "toxicity_p")
    empty = toxicity.fit(spark.createDataFrame([], "t string, y int"))
    assert toxicity.score(df, empty).filter("toxicity_severity = 0").count() == 4
    rows = [(f"you fool {i}", 1) for i in range(30)] + [(f"you friend {i}", 0) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "t string, y int"))
    got = {r["text"]: r for r in toxicity.score(df, model).collect()}
    assert got["You FOOL again"]["toxicity_p"] > 0.5 > got["kind"]["toxicity_p"] == got[None]["toxicity_p"]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_pipeline_stages_take_effect(spark, small):
    """Each stage against the operator's own decisions on its input, and the columns it hands on."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, docs
    results = {}
    for name, step in corpus_pipeline.STAGES:
        before = kept
        kept = stage(step(spark, before, small), name)
        results[name] = (before, kept)
        assert name == "encoding" or kept.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = results["near_dedup"]
    assert ids(after) == ids(near_text.near_duplicates(before, threshold=80).filter("kept")) < ids(before)
    before, after = results["decontamination"]
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert ids(after) == ids(decontaminate.mark(before, bench).filter("size(overlaps) = 0"))
    before, after = results["pii"]
    spans = {r["doc_id"]: r["pii"] for r in pii.scan(before).collect()}
    new = {r["doc_id"]: r for r in after.collect()}
    for r in before.collect():
        assert (new[r["doc_id"]]["text"] == r["text"]) == (not spans[r["doc_id"]]) and new[r["doc_id"]]["n_chars"] == len(new[r["doc_id"]]["text"])
    before, after = results["encoding"]
    assert ids(before) == ids(after) and after.filter("n_pieces = 0").count() == 0
    assert {(r["doc_id"], r["n_pieces"]) for r in corpus_pipeline.run(spark, small).collect()} == {(r["doc_id"], r["n_pieces"]) for r in after.collect()}

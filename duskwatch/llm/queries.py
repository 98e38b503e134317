"""The registered queries of this subpackage, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..session import stage
from . import decontaminate, heap_means, near_text, near_vectors, oracle_sql, periodic, pieces, pii, quality_rules, resample, secrets, sentences, tokens, toxicity
from .words import small_batches

#: Vocabulary files, at the same place on every machine.
TOKENIZERS = os.environ.get("DUSKWATCH_TOKENIZERS", "/opt/tokenizers")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op3_secret_scan": oracle_sql.SECRETS,
    "op4_minhash": oracle_sql.NEAR_TEXT,
    "op7_embedding_dedup": oracle_sql.NEAR_VECTORS,
    "op11_quality_rules": oracle_sql.QUALITY_RULES,
    "op12_periodic_runs": oracle_sql.PERIODIC,
    "op13_centroids": oracle_sql.CENTROIDS,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", alpha=0.9, seed=1, check="lossless")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "lossless")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.labelled(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "doc_id", F.col("toxic"))
    scored = toxicity.score(docs, toxicity.fit(stage(rows, "toxicity"), split=True))
    return scored.select("doc_id", "toxicity_severity", "toxicity_p", "toxicity_grade", (F.col("toxicity_p") >= 0.5).alias("toxic"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs))


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=85)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_by_section(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", rule="most")
    rows = counted.select("doc_id", F.col("token_sections_total").alias("doc_tokens"), F.posexplode("token_sections").alias("section", "s"))
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), "s.start", "s.end", F.col("s.n_tokens").cast("long").alias("n_tokens"), "s.n_crossing", "doc_tokens")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.sample(docs, table(spark, sf_dir, "labels"), F.col("quality") == 1, seed=6)


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.scan(docs))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = sentences.remove_repeats(docs)
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), "removed", "text")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("overlaps.item_id"))
    return marked.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), "overlaps")


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = quality_rules.rules(docs, table(spark, sf_dir, "labels"), F.col("quality") == 1)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return done.select("doc_id", *[f"signals.{c}" for c in base], "base_failed", "kept")


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.detect(docs.withColumn("text", rewritten(F.col("doc_id"), F.col("text"))), out="p", keep=["doc_id"])
    lines = F.transform("p.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = found.withColumn("b", periodic.best(F.col("p.runs")))
    return best.select(
        "doc_id",
        F.size("p.runs").cast("long").alias("n_runs"),
        "b.start",
        "b.length",
        "b.period",
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("p.collapsed"), 256).alias("collapsed_sha256"),
    )


def rewritten(key: Column, text: Column) -> Column:
    """One text in ten with its words from a place on replaced by repetitions of those there; place and period by the key's checksum."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    # Bound to a variable, the words are taken from the text once.
    words = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    new = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeated(ws)).otherwise(text))
    return F.when(h % 10 == 0, new[0]).otherwise(text)


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = heap_means.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

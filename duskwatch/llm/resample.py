"""Quality selection by importance resampling.

Two models of hashed n-grams, one of target rows and one of all rows, give
every document the log-ratio of its likelihoods. Gumbel noise on these ratios
and the largest keys draw documents without replacement in proportion to them.

The n-grams are of word shapes: letter case, length, closing marks and whether
a word repeats its neighbour. Shapes are few, so the models are sound on small
corpora too and say nothing about a document's topic or language.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from . import topk
from . import words as W

#: Buckets of hashed n-grams; the models are two vectors of this size, whatever the corpus.
BUCKETS = 1 << 16
#: Added to both counts of a bucket, the target's scaled to the size of the raw model.
SMOOTHING = 20.0
#: Labelled target rows that the target model is made of, at most; beyond, a share of them by hash.
TARGET_ROWS = 50_000
#: Scale of the noise, and the log-ratio from which a document counts to the sample's size.
TEMPERATURE, FLOOR = 0.25, -2.0

_PAIR = np.uint64(0xA24BAED4963EE407)
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def shapes(w: W.Words, raw: np.ndarray) -> np.ndarray:
    """A hash of each word's shape; ``raw`` has the bytes before lower-casing."""
    n = len(w.hash)

    def inside(mask):
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return upto[w.end] - upto[w.start]

    size = w.end - w.start
    upper, lower = inside((raw >= 65) & (raw <= 90)), inside((raw >= 97) & (raw <= 122))
    digits, other = inside((raw >= 48) & (raw <= 57)), inside(raw >= 128)
    title = (raw[w.start] >= 65) & (raw[w.start] <= 90) & (upper == 1)
    kinds = [digits > 0, upper + lower + other == 0, upper == 0, title, lower == 0]
    case = np.select(kinds, np.arange(len(kinds)), len(kinds))

    def mark(k):
        byte = np.where(size >= k, raw[np.maximum(w.end - k, 0)], 0)
        return np.where(_MARK[byte], byte, 0).astype(np.uint64)

    last = mark(1)
    before = np.where(last > 0, mark(2), 0).astype(np.uint64)
    again = np.zeros(n, np.uint64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    length = np.minimum(np.log2(np.maximum(size, 1)).astype(np.uint64), np.uint64(5))
    parts = [case.astype(np.uint64), length, again, last, before]
    code = np.zeros(n, np.uint64)
    for p in parts:
        code = code * np.uint64(256) + p
    return W.mix(code + np.uint64(1))


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of the shape of every word and of every pair of neighbours."""
    w = W.words(column)
    raw, _ = W.utf8(column)
    shape = shapes(w, raw) if len(w.hash) else np.zeros(0, np.uint64)
    near = np.flatnonzero(w.row[1:] == w.row[:-1]) if len(w.row) else np.zeros(0, np.int64)
    pair = W.mix(shape[near] * _PAIR + shape[near + 1])
    return np.concatenate([w.row, w.row[near]]), (np.concatenate([shape, pair]) % np.uint64(BUCKETS)).astype(np.int64)


class Model(NamedTuple):
    """The log-ratio of each bucket."""

    ratio: np.ndarray


def target_ids(labels: DataFrame, label_key: str, wanted: Column, rows: int = TARGET_ROWS) -> DataFrame:
    """Distinct keys with a label that is wanted: all of them, or about ``rows`` chosen by hash. The bound makes them fit a broadcast."""
    ids = labels.filter(wanted & F.col(f"`{label_key}`").isNotNull()).select(F.col(f"`{label_key}`").alias("__target")).distinct()
    n = ids.count()
    return ids if n <= rows else ids.filter(F.pmod(F.xxhash64("__target"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def fit(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", smoothing: float = SMOOTHING) -> Model:
    """Counts of all rows and of the target rows, from one scan. Without target rows every ratio is 0."""
    flagged = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(targets.withColumn("y", F.lit(True))), F.col("k") == F.col("__target"), "left").select("t", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in W.parts(batches, 0):
            row, bucket = ngrams(batch.column(0))
            raw += np.bincount(bucket, minlength=BUCKETS)
            wanted = ~np.array(batch.column(1).is_null())
            target += np.bincount(bucket[wanted[row]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    counts = flagged.mapInArrow(work, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = counts.toPandas()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    if not target.sum():
        return Model(np.zeros(BUCKETS))
    return Model(np.log((target * (raw.sum() / target.sum()) + smoothing) / (raw + smoothing)))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "log_weight") -> DataFrame:
    """Add ``out``, the log-ratio of the document's likelihoods; 0 without words. A column of that name is replaced."""
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    at_text, names, ratio = plain.columns.index(text), plain.columns, model.ratio

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches, at_text):
            row, bucket = ngrams(batch.column(at_text))
            total = np.bincount(row, weights=ratio[bucket], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total, pa.float64())], names=[*names, out])

    return plain.mapInArrow(work, T.StructType([*plain.schema.fields, T.StructField(out, T.DoubleType())]))


def gumbel(*key: Column, seed: int = 0) -> Column:
    """Standard Gumbel noise as a function of the key."""
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11).cast("double") + 0.5) * 2.0**-53
    return -F.log(-F.log(u))


def sampling_keys(scored: DataFrame, key: str = "doc_id", weight: str = "log_weight", temperature: float = TEMPERATURE, seed: int = 0, out: str = "sample_key") -> DataFrame:
    """Add ``out``: the log-ratio with noise, in steps of 2**-20 so that equal keys are equal everywhere."""
    noisy = F.col(weight) + temperature * gumbel(F.col(f"`{key}`"), seed=seed)
    return scored.withColumn(out, F.round(noisy * (1 << 20)).cast("long"))


def chosen(keyed: DataFrame, key: str = "doc_id", weight: str = "log_weight", k: int | None = None, floor: float = FLOOR, sample_key: str = "sample_key") -> Column:
    """The condition of the Gumbel top-k, over any table with the same rows. Without ``k``, as many as reach ``floor`` without noise."""
    if k is None:
        k = keyed.filter(F.col(weight) >= floor).count()
    found = topk.cut(keyed, k, F.col(sample_key), F.xxhash64(F.col(f"`{key}`")))
    return F.lit(True) if found is None else found


def sample(df: DataFrame, labels: DataFrame, wanted: Column, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", k: int | None = None, seed: int = 0) -> DataFrame:
    """``key``, ``log_weight``, ``sample_key`` and ``kept`` of every row: the result of the resampling.

    Rows of one key draw the same noise, so repeated rows are kept or dropped
    together. A text that is null or without words has ratio 0, neither target
    nor not. An empty table gives an empty one.
    """
    model = fit(df, target_ids(labels, label_key, wanted), key, text)
    slim = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    keyed = stage(sampling_keys(score(slim, model, "__text").drop("__text"), key, seed=seed), "sampling-keys")
    return keyed.withColumn("kept", chosen(keyed, key, k=k))


def keep(df: DataFrame, labels: DataFrame, wanted: Column, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", k: int | None = None, seed: int = 0) -> DataFrame:
    """The drawn rows of ``df``, all columns as they were. Texts are read twice more rather than shuffled."""
    model = fit(df, target_ids(labels, label_key, wanted), key, text)
    scored = sampling_keys(score(df, model, text, out="__log_weight"), key, "__log_weight", seed=seed, out="__sample_key")
    slim = stage(scored.select(F.col(f"`{key}`").alias(key), "__log_weight", "__sample_key"), "sampling-keys")
    return scored.filter(chosen(slim, key, "__log_weight", k=k, sample_key="__sample_key")).select(*[F.col(f"`{c}`") for c in df.columns])

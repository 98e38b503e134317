"""Severity of toxicity by cumulative-link regression over sparse text features.

Features are hashed runs of bytes of the lower-cased text, short and long, so
that a word counts in whatever compound it stands, and a stem with what follows. One weight vector serves all
ordered thresholds: ``P(grade <= j) = sigmoid(threshold_j - w . x)``; the
expected severity is the sum of ``P(grade > j)``.
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
from . import words as W

#: Bytes of a run, ascending; and the buckets in which runs are counted before the telling ones are counted exactly.
GRAMS, BUCKETS = (5, 8), 1 << 22
#: Labelled rows that the model is fitted on, at most; beyond, a share of them by hash. Their ids fit a broadcast.
FIT_ROWS = 20_000
#: Features of the model, the graded rows a feature must stand in (by number and by share), and how many times likelier it must be there.
FEATURES, LEAST_ROWS, LEAST_SHARE, LEAST_RATIO = 1024, 4, 0.02, 8.0
#: Bytes of text whose runs are held at a time: each byte starts two runs of some forty bytes in arrays.
PART = 1 << 20
_STEP = np.uint64(0xFF51AFD7ED558CCD)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of every run of bytes, with one space for each run of spaces and at both ends of a row."""
    w = W.words(column)
    size = w.end - w.start
    # Words with a space before each, and one at the end of each row.
    tails = np.zeros(len(size), np.int64)
    tails[w.first[1:][np.diff(w.first) > 0] - 1] = 1
    room = size + 1 + tails
    shift = np.cumsum(room) - room + 1 - w.start
    data = np.full(int(room.sum()), 32, np.uint8)
    source = np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    data[source + np.repeat(shift, size)] = w.data[source]
    of = np.repeat(w.row.astype(np.int32), room)
    rows, hashes, h = [], [], np.zeros(len(data), np.uint64)
    for k in range(GRAMS[-1]):
        n = max(len(data) - k, 0)
        h = (h[:n] + data[k : k + n] + np.uint64(1)) * _STEP
        h ^= h >> np.uint64(32)
        if k + 1 in GRAMS:
            whole = of[:n] == of[k : k + n]
            rows.append(of[:n][whole])
            hashes.append(h[whole] * _STEP + np.uint64(k))
    return np.concatenate(rows), np.concatenate(hashes)


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray


def counted(column: pa.Array, features: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, feature, value)`` of the features in each row; the value is ``log2(1 + count)``, 2 at most. ``present`` is :func:`bits` of them."""
    row, h = grams(column)
    maybe = np.flatnonzero(present[(h >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(features, h[maybe])
    has = features[np.minimum(at, len(features) - 1)] == h[maybe] if len(features) else np.zeros(0, bool)
    key, count = np.unique(row[maybe[has]].astype(np.int64) * len(features) + at[has], return_counts=True)
    return key // max(len(features), 1), key % max(len(features), 1), np.minimum(np.log2(1.0 + count), 2)


def bits(features: np.ndarray) -> np.ndarray:
    """A quick test for hashes that are not among ``features``."""
    out = np.zeros(1 << 20, bool)
    out[(features >> np.uint64(44)).astype(np.int64)] = True
    return out


def labelled(df: DataFrame, labels: DataFrame, key: str, text: str, label_key: str, grade: Column, rows: int = FIT_ROWS) -> DataFrame:
    """``t`` and ``y`` of about ``rows`` labelled rows at most, chosen by hash; copies of a text count once. Of several labels the highest counts."""
    graded = labels.select(F.col(f"`{label_key}`").alias("__l"), grade.cast("int").alias("y")).filter(F.col("__l").isNotNull() & F.col("y").isNotNull()).groupBy("__l").agg(F.max("y").alias("y"))
    n = graded.count()
    few = graded if n <= rows else graded.filter(F.pmod(F.xxhash64("__l"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    slim = df.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{text}`").alias("t"))
    return slim.join(F.broadcast(few), F.col("__k") == F.col("__l")).select("t", "y").dropDuplicates(["t"])


def telling_features(rows: DataFrame, features: int = FEATURES) -> np.ndarray:
    """Hashes that stand far more often in graded rows (``y > 0``) than in others: the strongest, in ascending order.

    Two looks at the rows: buckets are counted first, then the hashes in
    buckets that may tell are counted one by one.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for batch in W.parts(batches, 0, PART):
            y = (batch.column(1).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            row, h = grams(batch.column(0))
            key = np.unique(row.astype(np.int64) * BUCKETS + (h >> np.uint64(42)).astype(np.int64))
            for kind in (0, 1):
                seen[kind] += np.bincount((key % BUCKETS)[y[key // BUCKETS] == kind], minlength=BUCKETS).astype(np.int32)
            n += np.bincount(y, minlength=2)
        bad = np.flatnonzero(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(bad, -1), pa.int32()), pa.array(np.append(seen[1][bad], n[1]), pa.int64()), pa.array(np.append(seen[0][bad], n[0]), pa.int64())], names=["bucket", "bad", "good"])

    sums = rows.mapInArrow(tally, "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sums = stage(sums, "gram-counts")
    total = {r["bucket"]: r for r in sums.filter("bucket < 0").collect()}.get(-1)
    if not total or not total["bad"] or not total["good"]:
        return np.zeros(0, np.uint64)
    ratio = (F.col("bad") / total["bad"]) / ((F.col("good") + 0.5) / total["good"])
    score = F.col("bad") * F.log(ratio)
    least = max(LEAST_ROWS, LEAST_SHARE * total["bad"])
    maybe = sums.filter((F.col("bucket") >= 0) & (F.col("bad") >= least) & (ratio >= LEAST_RATIO / 2)).orderBy(score.desc(), "bucket").limit(4 * features)
    wanted = np.zeros(BUCKETS, bool)
    wanted[[r["bucket"] for r in maybe.select("bucket").collect()]] = True

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches, 0, PART):
            y = batch.column(1).to_numpy(zero_copy_only=False) > 0
            row, h = grams(batch.column(0))
            some = np.flatnonzero(wanted[(h >> np.uint64(42)).astype(np.int64)])
            pair = np.unique(np.stack([row[some].astype(np.uint64), h[some]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1].view(np.int64)), pa.array(y[pair[:, 0].astype(np.int64)])], names=["h", "bad"])

    counts = rows.mapInArrow(exact, "h long, bad boolean").groupBy("h").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    best = counts.filter((F.col("bad") >= least) & (ratio >= LEAST_RATIO)).orderBy(score.desc(), "h").limit(features).select("h")
    return np.sort(np.array([r["h"] for r in best.collect()], np.int64).view(np.uint64))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_thresholds(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, n_features: int, penalty: float = 1e-5, steps: int = 1500, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch Adam on the mean log-loss; thresholds are a first one plus positive steps.

    Every feature was chosen for standing in graded rows, so weights are not
    negative: nothing that stands beside a telling word can talk it away.
    """
    grades = int(y.max()) + 1 if len(y) else 1
    w, first, gaps = np.zeros(n_features), np.array(0.0), np.zeros(max(grades - 2, 0))
    if grades < 2:
        return w, np.zeros(0)
    first = np.array(np.log((y == 0).mean() / max((y > 0).mean(), 1e-9)) if (y == 0).any() else -3.0)
    state = [np.zeros(n_features + 1 + len(gaps)) for _ in range(2)]
    for step in range(1, steps + 1):
        cuts = first + np.concatenate([[0], np.cumsum(np.log1p(np.exp(gaps)))])
        eta = np.bincount(row, weights=value * w[feature], minlength=len(y))
        bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = _sigmoid(bounds[y + 1] - eta), _sigmoid(bounds[y] - eta)
        hi, lo = np.where(y + 1 == grades, 1.0, hi), np.where(y == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_eta = (d_hi - d_lo) / len(y)  # of the loss
        d_cut = np.bincount(np.minimum(y, grades - 2), weights=np.where(y + 1 == grades, 0, -d_hi) / len(y), minlength=grades - 1)
        d_cut += np.bincount(np.maximum(y - 1, 0), weights=np.where(y == 0, 0, d_lo) / len(y), minlength=grades - 1)
        grad = np.concatenate([np.bincount(feature, weights=value * d_eta[row], minlength=n_features) + penalty * w, [d_cut.sum()], np.cumsum(d_cut[::-1])[::-1][1:] * _sigmoid(gaps)])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = rate * (1 - step / (steps + 1)) * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, first, gaps = np.maximum(w - move[:n_features], 0), first - move[n_features], gaps - move[n_features + 1 :]
    return w, first + np.concatenate([[0], np.cumsum(np.log1p(np.exp(gaps)))])


def split_by_amount(rows: DataFrame, features: np.ndarray) -> DataFrame:
    """Grades 1 and 2 in place of a yes: rows at most at, and over, the median amount of telling features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = bits(features)
        for batch in W.parts(batches, 0, PART):
            row, _, value = counted(batch.column(0), features, present)
            amount = np.bincount(row, weights=value, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(amount, pa.float64())], names=["t", "y", "amount"])

    weighed = rows.mapInArrow(work, "t string, y int, amount double")
    middle = weighed.filter("y > 0").agg(F.percentile_approx("amount", 0.5, 10_000).alias("m")).first()["m"]
    return weighed.select("t", F.when((F.col("y") > 0) & (F.col("amount") > F.lit(middle)), 2).otherwise(F.col("y")).cast("int").alias("y"))


def fit(rows: DataFrame, split: bool = False, features: int = FEATURES) -> Model:
    """A model of graded rows ``t``, ``y`` (0 is not toxic). ``split`` makes two severities of a yes/no label.

    The rows' few telling features come to the driver, not their texts; their
    number is bounded by the rows the model is fitted on. Without rows of both
    kinds there are no features, and every text has severity 0.
    """
    hashes = telling_features(rows, features)
    if not len(hashes):
        return Model(hashes, np.zeros(0), np.zeros(0))
    graded = split_by_amount(rows, hashes) if split else rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = bits(hashes)
        for batch in W.parts(batches, 0, PART):
            row, feature, value = counted(batch.column(0), hashes, present)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists], names=["y", "f", "v"])

    found = graded.mapInArrow(work, "y int, f array<int>, v array<float>").toArrow()
    f, v = found.column("f").combine_chunks(), found.column("v").combine_chunks()
    sizes = np.diff(f.offsets.to_numpy())
    w, cuts = fit_thresholds(np.repeat(np.arange(len(sizes)), sizes), f.flatten().to_numpy(), v.flatten().to_numpy().astype(float), found.column("y").to_numpy(), len(hashes))
    return Model(hashes, w, cuts)


def score(df: DataFrame, model: Model, text: str = "text", prefix: str = "toxicity") -> DataFrame:
    """Add ``<prefix>_severity`` (expected grade), ``<prefix>_p`` (chance of a grade over 0) and ``<prefix>_grade`` (the likeliest).

    A null or empty text has no features and the scores of one. Columns of
    these names are replaced, all others pass through.
    """
    names = [f"{prefix}_severity", f"{prefix}_p", f"{prefix}_grade"]
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    at_text, columns = plain.columns.index(text), plain.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = bits(model.features)
        for batch in W.parts(batches, at_text, PART):
            row, feature, value = counted(batch.column(at_text), model.features, present)
            eta = np.bincount(row, weights=value * model.weights[feature], minlength=batch.num_rows)
            over = np.stack([np.ones(batch.num_rows), *[1 - _sigmoid(c - eta) for c in model.thresholds], np.zeros(batch.num_rows)], axis=1)
            severity, p = over[:, 1:].sum(axis=1), over[:, 1]
            grade = np.argmax(over[:, :-1] - over[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(severity), pa.array(p), pa.array(grade, pa.int32())], names=[*columns, *names])

    return plain.mapInArrow(work, T.StructType([*plain.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.IntegerType())]))

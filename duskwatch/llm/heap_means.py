"""Exact integer k-means with heap-ordered bounds.

Each vector has a gap: how much nearer its centroid is than the second one.
While centroids move, the gap shrinks by the moves of its own and of the
farthest-moved other centroid at most, so a vector can't change cluster before
these moves, added up per cluster, use the gap up. The key of a vector is its gap
plus the sum at the time of its scan; a vector expires when its cluster's sum
passes the key.

A cluster's heap is a set of sorted runs: every round writes the vectors it
scanned in order of cluster and key, and pops those whose key lies between the
sums before and after the last move. This is a range of each run, read by the
statistics of the stored file, so a round reads what expired and nothing else.
A popped vector is scanned against all centroids and pushed with its new key in
the round's own run. Vectors are never shuffled, rounds move only sums of the
vectors that changed cluster, and what a round needs of earlier ones is written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Components, their scale, clusters, and the rounds of assigning and moving.
DIMS, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: Size of a component beyond which squared distances would not fit a long; larger ones count as this.
WIDEST = 1 << 27
#: Room for rounding in keys, in proportion to the distances they are made of.
SLACK = 1e-9
#: Below this size all products and sums are whole numbers in double precision.
_EXACT = 1 << 22


def quantised(df: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``k`` and the integers ``x`` of the vectors with ``dims`` components, none of them null or not finite."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(WIDEST))), F.lit(float(-WIDEST)))).cast("int"))
    return df.filter(F.coalesce((F.size(v) == dims) & finite, F.lit(False))).select(F.col(f"`{key}`").cast("long").alias("k"), x.alias("x"))


def seeds(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the smallest hashes of their keys; rows of one key in the order of their components, without key last."""
    h = F.sha2(F.concat(F.lit("3:"), F.col("k").cast("string")), 256)
    first = vectors.orderBy(h.asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), -1 if first else 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _scan(centroids: np.ndarray, reach: np.ndarray):
    """Exact nearest centroids, smaller numbers first, and the keys of their gaps."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distances(_matrix(batch.column(1)), centroids)
            c = d.argmin(axis=1)
            near = np.sqrt(d[np.arange(len(d)), c].astype(np.float64))
            if d.shape[1] > 1:
                second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
                key = reach[c] + (second - near) - SLACK * (second + near + reach[c] + 1)
            else:
                key = np.full(len(d), np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(c.astype(np.int32)), pa.array(key)], names=["k", "x", "was", "c", "key"])

    return work


def _moved(run: DataFrame, clusters: int, dims: int) -> np.ndarray:
    """What the rows of a run add to each cluster: sums of components and, last, the count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, dims + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.hstack([_matrix(batch.column(0)), np.ones((batch.num_rows, 1), np.int64)])
                was, now = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                np.add.at(total, now, x)
                known = was >= 0
                np.subtract.at(total, was[known], x[known])
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["c", "sums"])

    parts = run.filter("was != c").select("x", "was", "c").mapInArrow(work, "c int, sums array<long>").select("c", F.posexplode("sums").alias("i", "s"))
    out = np.zeros((clusters, dims + 1), np.int64)
    for r in parts.groupBy("c", "i").agg(F.sum("s").alias("s")).collect():  # clusters * (dims + 1) rows
        out[r["c"], r["i"]] = r["s"]
    return out


def _between(low: np.ndarray | None, high: np.ndarray | None) -> Column:
    """Rows whose key lies over ``low`` and at or below ``high`` of their cluster."""
    of = []
    for c in range(len(low if low is not None else high)):
        is_in = F.col("c") == c
        if low is not None:
            is_in &= F.col("key") > F.lit(float(low[c]))
        if high is not None:
            is_in &= F.col("key") <= F.lit(float(high[c]))
        of.append(is_in)
    return reduce(Column.__or__, of)


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, scanned: list[int] | None = None
) -> DataFrame:
    """``key``, ``cluster``, ``distance`` (squared, exact), ``cluster_inertia``, ``inertia`` and ``centroid`` of every kept vector.

    Vectors with another number of components, or with a null or non-finite
    one, have no row. Components beyond 2**27 after scaling count as 2**27. Rows
    of one key are vectors of their own; one without key is clustered but is no
    first centroid while others are there. With fewer vectors than clusters,
    each is a centroid; without any the result is empty. Ties go to the smaller
    number, and a cluster that has lost all vectors keeps its centroid.

    ``scanned`` receives the number of vectors that each round scanned.
    """
    vectors = stage(quantised(df, key, vector, dims, scale), "vectors")
    centroids = seeds(vectors, clusters)
    n = len(centroids)
    if not n:
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return df.sparkSession.createDataFrame([], f"k long, {empty}").withColumnRenamed("k", key)
    row = "k long, x array<int>, was int, c int, key double"
    reach = np.zeros(n)

    def push(rows: DataFrame) -> DataFrame:
        return stage(rows.select("k", "x", "was").mapInArrow(_scan(centroids, reach), row).sortWithinPartitions("c", "key"), "heap-run")

    runs = [push(vectors.withColumn("was", F.lit(-1)))]
    sums = np.zeros((n, dims + 1), np.int64)
    popped = None
    for _ in range(rounds):
        if scanned is not None:
            scanned.append(runs[-1].count())
        sums += _moved(runs[-1], n, dims)
        some = sums[:, dims] > 0
        moved = centroids.copy()
        moved[some] = sums[some, :dims] // sums[some, dims:]
        drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(np.float64))
        others = np.array([np.delete(drift, c).max(initial=0.0) for c in range(n)])
        before, reach, centroids = reach, reach + drift + others, moved
        if not drift.any():
            break
        # All of the last run is still held; earlier ones have given up what the move before popped.
        held = [run.filter(_between(popped if run is not runs[-1] else None, reach)) for run in runs]
        popped = reach.copy()
        runs.append(push(reduce(DataFrame.unionByName, held).withColumn("was", F.col("c"))))
    live = [run.filter(_between(popped, None)) if popped is not None and run is not runs[-1] else run for run in runs]
    final = centroids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = batch.column(2).to_numpy(zero_copy_only=False)
                d = ((_matrix(batch.column(1)) - final[c]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], names=["k", "c", "d"])

    done = stage(reduce(DataFrame.unionByName, live).select("k", "x", "c").mapInArrow(measure, "k long, c int, d long"), "clustered")
    inertia = {r["c"]: r["d"] for r in done.groupBy("c").agg(F.sum("d").alias("d")).collect()}
    of_cluster = F.array(*[F.lit(int(inertia.get(c, 0))).cast("long") for c in range(n)])
    of_centroid = F.array(*[F.array(*[F.lit(int(v)).cast("long") for v in centre]) for centre in final])
    return done.select(
        F.col("k").alias(key),
        F.col("c").alias("cluster"),
        F.col("d").alias("distance"),
        F.element_at(of_cluster, F.col("c") + 1).alias("cluster_inertia"),
        F.lit(int(sum(inertia.values()))).cast("long").alias("inertia"),
        F.element_at(of_centroid, F.col("c") + 1).alias("centroid"),
    )

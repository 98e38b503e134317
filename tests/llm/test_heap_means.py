import hashlib

import numpy as np
import pytest

from duskwatch.llm import heap_means as H


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(k, v, 1, "c") for k, v in rows], f"vec_id long, embedding array<{kind}>, x int, key string")


def brute(rows, clusters=8, rounds=10):
    x = {k: np.floor(np.float64(1024) * np.array(v, np.float64)).astype(np.int64) for k, v in rows}
    order = sorted(x, key=lambda k: hashlib.sha256(f"3:{k}".encode()).hexdigest())[:clusters]
    c = np.array([x[k] for k in order])
    keys, m = list(x), np.array(list(x.values()))
    for r in range(rounds + 1):
        d = ((m[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        if r < rounds:
            c = np.array([m[near == i].sum(axis=0) // (near == i).sum() if (near == i).any() else c[i] for i in range(len(c))])
    dist = d[np.arange(len(m)), near]
    return {k: (near[i], dist[i], dist[near == near[i]].sum(), dist.sum(), c[near[i]].tolist()) for i, k in enumerate(keys)}


def found(df, **kw):
    return {r["vec_id"]: (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in H.cluster(df, **kw).collect()}


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_agrees_with_plain_rounds(spark, spread):
    """Groups of vectors, exact copies and vectors on a coarse grid, where distances tie."""
    rng = np.random.default_rng(3)
    heart = rng.normal(size=(12, 64))
    rows = [(i, (heart[i % 12] + spread * rng.normal(size=64)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(100)]
    rows += [(2000 + i, (rng.integers(-1, 2, size=64) / 1024).tolist()) for i in range(200)]
    scanned = []
    got, want = found(vectors(spark, rows).repartition(5), scanned=scanned), brute(rows)
    assert got.keys() == want.keys() and all(got[k] == tuple(want[k]) for k in want)
    assert scanned[0] == 900 and sum(scanned[1:]) < 900 * (len(scanned) - 1)


def test_bounds_spare_scans(spark):
    """Of vectors in well separated groups few expire after the first rounds."""
    rng = np.random.default_rng(4)
    heart = 5 * rng.normal(size=(8, 64))
    rows = [(i, (heart[i % 8] + 0.05 * rng.normal(size=64)).tolist()) for i in range(2000)]
    scanned = []
    assert found(vectors(spark, rows), scanned=scanned) == {k: tuple(v) for k, v in brute(rows).items()}
    assert max(scanned[2:]) < 0.2 * 2000


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=64).tolist()) for i in range(20)]
    bad = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] * 64), (106, [float("inf")] + [0.0] * 63)]
    got = found(vectors(spark, good + bad))
    assert got == {k: tuple(v) for k, v in brute(good).items()}
    few = found(vectors(spark, good[:3] + bad))
    assert {k: v[:2] for k, v in few.items()} == {k: (c, 0) for c, k in enumerate(sorted(range(3), key=lambda k: hashlib.sha256(f"3:{k}".encode()).hexdigest()))}
    assert H.cluster(vectors(spark, bad)).count() == 0 and H.cluster(vectors(spark, [])).columns == H.cluster(vectors(spark, good)).columns
    assert H.cluster(vectors(spark, good + good + [(None, good[0][1])])).count() == 41
    single = found(vectors(spark, [(1, [0.5] * 64), (2, [0.25] * 64)], "float"), clusters=1)
    assert single[1][1] == single[2][1] == 64 * 128 * 128


def test_large_components_stay_exact():
    rng = np.random.default_rng(6)
    x, c = rng.integers(-(1 << 27), 1 << 27, size=(50, 64)), rng.integers(-(1 << 27), 1 << 27, size=(8, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
    assert H.distances(x, c).tolist() == want
    small = rng.integers(-(1 << 22), 1 << 22, size=(50, 64))
    assert H.distances(small, small[:8]).tolist() == ((small[:, None] - small[None, :8]) ** 2).sum(axis=2).tolist()

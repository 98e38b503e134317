import math
import random
import re

import numpy as np
import pytest
from fixtures import Sets, documents, same_as_sql

import corpus_pipeline
from duskwatch.llm import near_text, near_vectors, oracle_sql
from duskwatch.llm.components import components


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets, parts = {k: shingles(t) for k, t in rows if k is not None}, Sets()
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parts.join(a, b)
    return {k: (len(sets[k]), parts.top(k), parts.top(k) == k) for k in keys}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.random()
        out[at : at + 1] = [] if kind < 0.3 else [f"e{rng.randint(0, 9999)}"] if kind < 0.7 else [out[at], f"e{rng.randint(0, 9999)}"]
    return out


@pytest.fixture(scope="module")
def texts():
    """Families of near copies with chains, a hot group, a passage in every third text, short, empty and null texts."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocabulary, k=12)
    rows = []

    def add(words):
        rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(words)))

    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(8, 160)) + (passage if rng.random() < 0.4 else [])
        add(base)
        for _ in range(rng.randint(0, 4)):
            base = edited(rng, base, rng.randint(0, 3))
            add(base)
    hot = rng.choices(vocabulary, k=150)
    for _ in range(90):
        add(edited(rng, hot, rng.randint(0, 6)))
    for t in (None, "", " \n", "one", "One", "two words", "two  WORDS", "a b c d", "a b c d e"):
        rows.append((len(rows), t))
    rows += [(len(rows) + i, rows[0][1].upper()) for i in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("leaf", "depth"), [(near_text.LEAF, near_text.DEPTH), (6, 2), (10, 0)])
def test_components_agree_with_all_pairs(spark, texts, leaf, depth):
    """Small leaves make the same data branch and end in tiles."""
    got = near_text.near_duplicates(documents(spark, texts), leaf=leaf, depth=depth).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute(texts)
    assert len(got) == len(texts)


def test_agrees_with_sql(spark, texts):
    df = documents(spark, texts)
    same_as_sql(near_text.near_duplicates(df), oracle_sql.NEAR_TEXT, documents=df)


def test_stage_links_from_eighty_percent(spark, small):
    """Pairs alike by about 0.7 to 0.97, against brute force at 0.8."""
    rng = random.Random(6)
    rows = []
    for i in range(120):
        base = [f"b{i}-{j}" for j in range(rng.randint(60, 200))]
        other = list(base)
        # Words changed at the end alone make the similarity as fine as needed.
        other[len(base) - 1 - int(len(base) * rng.uniform(0.02, 0.3)) :] = [f"o{i}"]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    alike = [len(shingles(rows[i][1]) & shingles(rows[i + 1][1])) / len(shingles(rows[i][1]) | shingles(rows[i + 1][1])) for i in range(0, 240, 2)]
    want = {k for k, _ in rows} - {2 * i + 1 for i, a in enumerate(alike) if a >= 0.8}
    assert sum(0.8 <= a < 0.85 for a in alike) > 10 and sum(a < 0.8 for a in alike) > 5
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), small).select("doc_id").collect()}
    assert got == want


def test_a_pair_at_the_threshold_has_enough_equal_coordinates():
    for threshold in (80, 85, 90):
        m, p = near_text.least_equal(threshold), threshold / 100
        assert sum(math.comb(64, x) * p**x * (1 - p) ** (64 - x) for x in range(m)) <= 1e-5
    assert near_text.least_equal(85) == 41


def test_threshold_is_met_exactly():
    x = np.arange(1000, dtype=np.uint64)
    assert near_text.similar(x[:85], x[:100]) and not near_text.similar(x[:84], x[:100])


def test_odd_tables(spark, texts):
    df = documents(spark, [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (5, "A B C D E F")]).withColumnRenamed("lang", "component_id")
    got = sorted(map(str, near_text.near_duplicates(df).collect()))
    assert sum("component_id=3" in r for r in got) == 3 and sum("component_id=None, kept=True" in r for r in got) == 2
    assert near_text.deduplicate(df).columns == df.columns and near_text.deduplicate(df).filter("doc_id = 5").count() == 0
    assert near_text.near_duplicates(df.limit(0)).count() == 0


def test_star_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 2000), (None, 3)]
    parts = Sets()
    for a, b in edges[:-1]:
        parts.join(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: parts.top(x) for x in list(parts.parent)}


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for g in range(60):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 6)) if g else 120):
            rows.append((centre * float(rng.uniform(0.1, 9)) + rng.normal(size=24) * rng.uniform(0.05, 0.5)).tolist())
    rows += [rows[0]] * 30 + [rows[130]] * 3
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 0.0]]
    return [(i, v, i % 3) for i, v in enumerate(rows + odd)]


@pytest.mark.parametrize("tile", [near_vectors.TILE, 16])
def test_vector_links_agree_with_sql(spark, vectors, tile):
    df = spark.createDataFrame(vectors, VECTORS)
    whole = df.filter("size(embedding) <> 2 or embedding is null")
    same_as_sql(near_vectors.near_duplicates(whole, tile=tile), oracle_sql.NEAR_VECTORS, embeddings=whole)


def test_vectors_of_other_dimensions_and_empty_tables(spark, vectors):
    df = spark.createDataFrame(vectors[-30:] + [(None, [1.0] * 24, 0)], VECTORS).withColumnRenamed("label", "n_links")
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(df).collect()}
    assert got[vectors[-1][0]]["n_links"] == 0 and got[None]["kept"] and len(got) == 31
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_bounds_give_up_no_pair():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 50)) * np.linspace(3, 0.1, 50)
    x[150:] = x[:150] + rng.normal(size=(150, 50)) * rng.uniform(0.01, 1, size=(150, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = near_vectors.close_pairs(x[:200], x[100:], 0.9)
    want = np.argwhere(x[:200] @ x[100:].T >= 0.9)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))

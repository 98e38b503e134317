import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, same_as_sql
from pyspark.sql import functions as F

from duskwatch.llm import oracle_sql, periodic, queries


def brute(w):
    """Runs by their definition: every lag, every maximal stretch, its smallest period."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i - a + q >= max(24, 3 * q):
                found.setdefault((a, i - a + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_words(rng):
    """Repetitions of several lengths, some within others, some broken by one word, over few different words."""
    out = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 33, 40]))]
        if rng.random() < 0.3:
            unit = unit * 3 + [rng.choice("abcd")]
        out += (unit * 9)[: rng.randint(1, 6 * len(unit))]
        out += [rng.choice("abcd") for _ in range(rng.randint(0, 4))]
        if out and rng.random() < 0.4:
            out[rng.randrange(len(out))] = "z"
    return out


def test_agrees_with_the_definition():
    rng = random.Random(4)
    texts = [periodic_words(rng) for _ in range(300)] + [[rng.choice("ab") for _ in range(rng.randint(0, 120))] for _ in range(300)]
    got = periodic.collapse(pa.array([" ".join(t) for t in texts])).to_pylist()
    some = 0
    for w, r in zip(texts, got, strict=True):
        want = brute(w)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed(w, want) and r["n_words"] == len(w)
        some += bool(want)
    assert some > 150


@pytest.mark.parametrize("length, period, found", [(23, 1, False), (24, 1, True), (24, 8, True), (26, 9, False), (27, 9, True), (299, 100, False), (300, 100, True), (301, 100, True)])
def test_least_lengths(length, period, found):
    text = " ".join(["head", *(f"w{i % period}" for i in range(length)), "tail"])
    (r,) = periodic.collapse(pa.array([text])).to_pylist()
    assert r["runs"] == ([{"start": 1, "length": length, "period": period}] if found else [])


def test_long_texts(spark):
    """A million equal words, and a stretch of thousands of words three times, at less than a square's cost."""
    same = "a " * 1_000_000
    unit = " ".join(f"w{i}" for i in range(100_000))
    one = "x" * 2_000_000
    rng = np.random.default_rng(0)
    frequent = " ".join(rng.choice(["the", "of", "it"], 300_000))
    got = periodic.collapse(pa.array([same, f"{unit} {unit} {unit}", one, frequent])).to_pylist()
    assert got[0]["runs"] == [{"start": 0, "length": 1_000_000, "period": 1}] and got[0]["collapsed"] == "a"
    assert got[1]["runs"] == [{"start": 0, "length": 300_000, "period": 100_000}] and got[1]["collapsed"] == unit
    assert got[2]["collapsed"] == one and got[3]["n_words"] == 300_000


def digest(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))


def test_query_agrees_with_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\t", "  "]).join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90)))) for i in range(200)]
    rows += [(200 + i, " ".join(periodic_words(rng))) for i in range(40)] + [(900, None), (901, ""), (902, " \n"), (None, "a " * 30)]
    df = documents(spark, rows)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).filter("doc_id is not null").collect())
    assert got == sorted(digest(k, t) for k, t in rows if k is not None)
    keyed = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id is not null")
    same_as_sql(queries.op12_periodic_runs(spark, str(tmp_path)).filter("doc_id is not null"), oracle_sql.PERIODIC, documents=keyed)


def test_odd_tables(spark):
    df = documents(spark, [(1, "a " * 40), (1, "a " * 40), (None, None), (2, "")]).withColumnRenamed("lang", "periodic").withColumnRenamed("source", "row")
    got = periodic.detect(df)
    assert got.columns == ["doc_id", "text", "row", "n_chars", "periodic"]
    assert sorted((r["doc_id"] or 0, len(r["periodic"]["runs"]), r["periodic"]["collapsed"]) for r in got.collect()) == [(0, 0, ""), (1, 1, "a"), (1, 1, "a"), (2, 0, "")]
    assert periodic.detect(df.limit(0)).count() == 0
    assert [r["b"] for r in got.select(periodic.best(F.col("periodic.runs")).alias("b")).collect()].count(None) == 2

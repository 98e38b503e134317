import random
import re
from fractions import Fraction
from math import comb

import pyarrow as pa
from fixtures import documents
from pyspark.sql import functions as F

from duskwatch.llm import quality_rules as Q


def by_hand(text):
    text = text or ""
    words = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    w = [x for _, x in words]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "n_lines": len(lines),
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_shouts": text.count("!"),
    }


def odd_texts(rng, n):
    parts = ["a", "B", "é!", "x|y", "\n", " \n ", "\t", "  ", "\r", "\x0b", "😀", " ", "a a a a a a", "<#>", ""]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_agree_with_plain_python():
    texts = [None, "", "\n", "one", *odd_texts(random.Random(1), 400)]
    assert Q.count(pa.array(texts, pa.string())).to_pylist() == [by_hand(t) for t in texts]
    assert Q.count(pa.array(texts, pa.string()).slice(7, 9)).to_pylist() == [by_hand(t) for t in texts[7:16]]
    assert len(Q.count(pa.array([], pa.string()))) == 0


def test_long_texts_are_counted_whole():
    word = "w" * 1_000_000
    lines = "same line\n" * 200_000
    many = " ".join(f"w{i}" for i in range(300_000)) + " w0 w1 w2 w3 w4"
    got = Q.count(pa.array([word, lines, many])).to_pylist()
    assert got[0]["word_chars"] == 1_000_000 and got[0]["n_words"] == 1
    assert got[1]["n_dup_lines"] == 199_999 and got[1]["n_repeat_words"] == 400_000
    assert got[2]["n_repeat_words"] == 10 and got[2]["n_words"] == 300_005


def test_tail_is_the_exact_binomial_sum():
    for n, k, share in [(1, 0, 0.1), (50, 2, 0.1), (300, 0, 0.004), (2000, 3, 0.004), (40, 39, 0.99)]:
        p = Fraction(share)
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(Q.binomial_tail(n, k, share) - float(exact)) < 1e-9 * float(exact)
    assert Q.binomial_tail(10, 1, 0.1) == 1.0 and 0 < Q.binomial_tail(10**6, 3600, 0.004) < 1e-9


def corpus(spark, rng, n):
    """Two strata: good rows seldom have symbols, bad ones often; only the large stratum has enough labels for a proof."""
    rows = []
    for i in range(n):
        lang, bad = ("en" if i % 10 else None), i % 4 == 0
        mark = "***" if bad or (lang is None and i % 20 == 10) else ""
        rows.append((i, " ".join(f"w{rng.randint(0, 999)}{mark}" for _ in range(30)), lang, not bad))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean").cache()


def test_cutoffs_hold_their_limit_in_each_stratum(spark):
    df = corpus(spark, random.Random(3), 4000)
    labels = df.select("doc_id", F.col("good").cast("int").alias("quality"))
    counted = Q.signals(df, keep=["doc_id", "lang", "good"])
    found = {r["stratum"]: r for r in Q.certified(counted, "lang", F.col("good"), limit=0.05, error=0.05).collect()}
    assert found["en"]["symbols"] == min(Q.CUTOFFS) and found["en"]["dup_lines"] == min(Q.CUTOFFS)
    # Half of the good rows of the null stratum have symbols in about half of their characters.
    assert found[None]["symbols"] is None or found[None]["symbols"] > 300
    done = Q.rules(df, labels, F.col("quality") == 1, limit=0.05).join(df.select("doc_id", "good", "lang"), "doc_id")
    by = {(r["lang"], r["good"]): r for r in done.groupBy("lang", "good").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert by["en", True]["kept"] == 1 and by["en", False]["kept"] == 0 and by[None, True]["kept"] >= 0.95
    few = Q.rules(df, labels.filter("doc_id < 200"), F.col("quality") == 1)
    assert few.filter("kept").count() == 4000  # 150 good rows prove nothing


def test_false_rejections_stay_within_the_limit_over_many_holdouts(spark):
    """Good rows with a ratio over a cutoff as often as the limit allows or a little more: it is hardly ever in force."""
    counts = ", ".join(f"'{c}', cast(0 as long)" for c in Q._COUNTS if c not in ("n_symbols", "word_chars"))
    rows = spark.range(400 * 500).select(F.expr("id div 500").alias("lang"), F.lit(True).alias("good"), (F.rand(5) < 0.025).alias("over"))
    s = F.expr(f"named_struct({counts}, 'n_symbols', cast(if(over, 1000, 0) as long), 'word_chars', 1000L)")
    found = Q.certified(rows.withColumn("signals", s), "lang", F.col("good"), limit=0.1, error=20.0)  # tests at 0.01 each
    wrong = found.filter("symbols is not null").count()
    assert wrong <= 12  # 4 expected at most


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e f g h i j k"), (3, "a b c d e f g h i j"), (3, "a b c d e f g h i j"), (4, "x y " * 30)]
    df = documents(spark, rows).withColumnRenamed("source", "signals").withColumnRenamed("n_chars", "stratum")
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, None), (None, 1), (99, 0)], "doc_id long, quality int")
    got = sorted(((r["doc_id"] or 0, r["base_failed"], r["kept"]) for r in Q.rules(df, labels, F.col("quality") == 1).collect()))
    assert got == [(0, False, True), (1, True, False), (2, True, False), (3, False, True), (3, False, True), (4, True, False)]
    kept = Q.signals(df, out="signals")
    assert kept.columns == ["doc_id", "text", "lang", "stratum", "signals"] and kept.count() == 6
    assert Q.rules(df.limit(0), labels, F.col("quality") == 1).count() == 0
    assert Q.rules(df, labels.limit(0), F.col("quality") == 1).filter("kept").count() == 3

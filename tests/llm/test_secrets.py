import random
import string

from fixtures import documents, same_as_sql

from duskwatch.llm import oracle_sql, secrets


def spans(df):
    return {r["doc_id"]: r for r in secrets.digest(secrets.scan(df)).collect()}


def test_all_spans_agree_with_sql(spark):
    rng = random.Random(3)
    rnd = lambda n, abc: "".join(rng.choice(abc) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    rows = [(0, None), (1, ""), (2, "no secrets here"), (3, "password=hunter2 PassWord: 'correcthorse9' token=token:abcdefgh12"), (4, "é" * 7 + " AKIA" + "A" * 11 + " AKIA" + "Z9" * 9 + "x"), (5, "aaaaabbbbb" * 4)]
    for i in range(6, 120):
        parts = [rnd(rng.randint(1, 9), string.ascii_lowercase) for _ in range(12)]
        for _ in range(rng.randint(0, 3)):
            word = rng.choice([rnd(rng.randint(15, 60), alnum), rnd(rng.randint(18, 50), "0123456789abcdef"), rnd(30, string.ascii_lowercase + string.digits), rnd(24, "ab1"), "secret = " + rnd(rng.randint(4, 30), alnum + "+/"), "example-" + rnd(30, alnum), "AKIA" + rnd(rng.randint(8, 16), string.ascii_uppercase), "Ünï" + rnd(40, alnum)])
            parts.insert(rng.randint(0, len(parts)), word)
        rows.append((i, " ".join(parts)))
    df = documents(spark, rows)
    got = spans(df)
    assert sum("entropy" in r["spans"] for r in got.values()) > 20
    same_as_sql(secrets.digest(secrets.scan(df)), oracle_sql.SECRETS, documents=df)


def test_allow_list_and_kinds(spark):
    secret = "q7Zk2Lm9Xw4Tb8Rv1Ny6"
    rows = [(1, secret), (2, "550e8400-e29b-41d4-a716-446655440000"), (3, "sha256-" + secret * 2), (4, "example_" + secret), (5, "abcdefghijklmnopqrst1234567890"), (6, "internationalizationconfiguration"), (7, "token=" + secret)]
    got = {k: r["spans"] for k, r in spans(documents(spark, rows)).items()}
    assert got == {1: "entropy:0:20", 2: "", 3: "", 4: "", 5: "", 6: "", 7: "assign:0:26"}


def test_clashing_columns_repeats_long_texts_and_empty_tables(spark):
    long = "x" * 30_000 + " token=abcdefgh " + "Zk3" * 4000
    df = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (None, None, None)], "doc_id long, text string, _base string")
    out = secrets.scan(df.withColumnRenamed("_base", "secrets"))
    assert out.columns == ["doc_id", "text", "secrets"]
    rows = sorted(out.collect(), key=str)
    assert rows[0] == rows[1] or rows[1] == rows[2]
    assert secrets.scan(df.limit(0)).count() == 0
    assert "<assign>" in secrets.redact(out.filter("doc_id is not null")).first()["text"]

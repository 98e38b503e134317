import hashlib
import random
import re

from fixtures import documents

from duskwatch.llm import pii

# The base kinds as the contract words them.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    found = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_base_spans_agree_with_the_patterns(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "x.y+z@ex-1.example.com", "@", "a@b", "a@b.c_d@e.f.", "é", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "001.002.003.255", "1.2.3.45.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "0" * 14, "0" * 25, "+1 (555) 555-0100", "+49.30.1234567", "+1", "12", "- ", " ", "\n", "word", "+1 22 333 4444 55555 666666", "..", "%@a.b"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 8)))) for i in range(400)] + [(400, None), (401, ""), (402, "1" * 20_000), (403, "a" * 20_000 + "@b.c")]
    got = {r["doc_id"]: r for r in pii.digest(pii.scan(documents(spark, rows))).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        assert got[k]["base_sha256"] == hashlib.sha256(brute(t).encode()).hexdigest(), t
        assert got[k]["spans"].startswith(brute(t)) or "context" in got[k]["spans"]


def planted():
    """Known addresses after ``reach me`` and unknown identifiers in the same place; the same kind of word elsewhere stays."""
    rows = [(i, f"please reach me user{i}@mail.example.com today") for i in range(14)]
    rows += [(100 + i, f"please reach me handle_{i}77 today") for i in range(2)]
    rows += [(200 + i, f"the build number handle{i}88 passed") for i in range(5)]
    return rows


def test_contexts_discover_unseen_identifiers(spark):
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.scan(documents(spark, planted()))).collect()}
    assert got[100] == got[101] == "context:16:26"
    assert all(got[k].startswith("email:16:") for k in range(14)) and all(got[k] == "" for k in range(200, 205))


def scores(edges, rounds):
    """Brute force of the graph scoring."""
    seeds = {i for _, i, s in edges if s}
    per_edge = {(p, i): 1.0 if s else 0.0 for p, i, s in edges}

    def confidence():
        out = {}
        for p in {p for p, _, _ in edges}:
            s = [v for (q, _), v in per_edge.items() if q == p]
            c = sum(s) / (len(s) + 1)
            if sum(v >= pii.INSTANCE_CONFIDENCE for v in s) >= pii.LEAST_SEEDS and c >= pii.PATTERN_CONFIDENCE:
                out[p] = c
        return out

    for _ in range(rounds):
        known, score = confidence(), {}
        for i in {i for _, i, _ in edges}:
            mine = [(p, s) for p, j, s in edges if j == i and p in known]
            if mine:
                miss = 1.0
                for p, _ in mine:
                    miss *= 1 - min(known[p], 0.999999)
                score[i] = 1.0 if any(s for _, s in mine) else 1 - miss
        per_edge = {(p, i): max(score.get(i, 0.0), 1.0 if s else 0.0) for p, i, s in edges}
    return confidence(), {i for i, v in score.items() if v >= pii.INSTANCE_CONFIDENCE}, seeds


def test_graph_scores_agree_with_brute_force(spark):
    rng = random.Random(9)
    edges = sorted({(f"p{rng.randint(0, 6)}", f"i{rng.randint(0, 40)}") for _ in range(120)})
    edges = [(p, i, int(i[1:]) % 5 != 0 and int(p[1:]) < 4) for p, i in edges]
    patterns, instances = pii.bootstrap(spark.createDataFrame(edges, "pattern string, instance string, seed boolean"))
    want_p, want_i, _ = scores(edges, pii.ROUNDS)
    got = {r["pattern"]: r["confidence"] for r in patterns.collect()}
    assert got.keys() == want_p.keys() and all(abs(got[p] - want_p[p]) < 1e-9 for p in got) and want_p
    assert {r["instance"] for r in instances.collect()} == want_i


def test_redaction_keeps_rows_and_columns(spark):
    rows = [*planted(), (None, "mail a@b.c now"), (7, None), (7, ""), (100, "please reach me handle_077 today")]
    df = documents(spark, rows).withColumnRenamed("lang", "h")
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert (None, "mail <email> now") in texts and (7, None) in texts and texts.count((100, "please reach me <context> today")) == 2
    assert pii.scan(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_overlapping_spans_are_put_out_once(spark):
    out = pii.redact(documents(spark, [(1, "x 1.2.3.4@b.co y")])).first()["text"]
    assert out == "x <email> y"

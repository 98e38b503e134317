import random

import pytest
from fixtures import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duskwatch.llm import tokens as T
from duskwatch.llm.queries import TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = [None, "", "\n", "one line", "two\nlines here\n", "é日本😀\n\n\n  indented\twords", "trailing \n  space", "a" * 400 + "\n" + "word " * 300]


def spans(text):
    """Character spans by another library."""
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).offsets


def brute(text, sections, rule):
    out = [0.0] * len(sections)
    for a, b in spans(text):
        over = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        for i, o in enumerate(over):
            if rule == "share":
                out[i] += o / (b - a)
            elif rule == "start" and sections[i][0] <= a < sections[i][1] or rule == "most" and o and i == over.index(max(over)):
                out[i] += 1
    return out


@pytest.mark.parametrize("rule", T.RULES)
def test_lines_agree_with_brute_force(spark, rule):
    for r in T.count_by_section(documents(spark, list(enumerate(TEXTS))), RANKS, rule=rule).collect():
        text = TEXTS[r["doc_id"]] or ""
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
        sections = list(zip(starts, starts[1:] + [len(text)], strict=True))
        got = r["token_sections"]
        assert [(s["start"], s["end"]) for s in got] == sections
        assert [s["n_tokens"] for s in got] == pytest.approx(brute(text, sections, rule))
        assert sum(s["n_tokens"] for s in got) == pytest.approx(r["token_sections_total"])


def test_given_sections_overlap_and_leave_gaps(spark):
    df = documents(spark, [(1, "alpha beta gamma delta epsilon")]).withColumn("token_sections", F.lit("clash"))
    sections = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end")) for n, a, b in [("late", 8, 99), ("first", 2, 12), ("none", 4, 4)]])
    got = T.count_by_section(df, RANKS, sections=sections, rule="share").first()["token_sections"]
    assert [(s["name"], s["start"], s["end"]) for s in got] == [("first", 2, 12), ("none", 12, 12), ("late", 12, 30)]
    assert [s["n_tokens"] for s in got] == pytest.approx(brute("alpha beta gamma delta epsilon", [(2, 12), (12, 12), (12, 30)], "share"))


def test_fields_share_one_encoding(spark):
    df = spark.createDataFrame([("Title", "Body text", None), (None, "", "x")], "title string, body string, text string")
    joined = T.joined_fields(df, ["title", "body", "text"])
    rows = T.count_by_section(joined, RANKS, sections="sections").collect()
    assert rows[0]["text"] == "Title\nBody text\n" and [s["name"] for s in rows[0]["token_sections"]] == ["title", "body", "text"]
    assert all(sum(s["n_tokens"] for s in r["token_sections"]) == r["token_sections_total"] for r in rows)
    assert T.count_by_section(joined.limit(0), RANKS).count() == 0


def test_long_gaps_give_the_tokens_of_the_whole_text():
    encoding, _ = T.read_encoding(RANKS)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "\t", "\u00a0", "\x1c", "\u2003", "   \n ", "1", "!", "é"]) for _ in range(rng.randint(0, 60)))
        assert T.encode(encoding, text, 3).tolist() == encoding.encode_to_numpy(text, disallowed_special=()).tolist()


def test_texts_of_millions_of_characters_are_encoded():
    encoding, _ = T.read_encoding(RANKS)
    for text in (" " * 2_000_000 + "x", "x" + " " * 1_500_000, "\n" * 1_200_000, "word" * 250_000):
        assert encoding.decode(T.encode(encoding, text).tolist()) == text

import random
import re

import numpy as np
import pyarrow as pa

from duskwatch.llm import words as W

TEXTS = [None, "", " \t\n", "One", "A bé \x0bC d", "x" * 5000, "a b c d e f a b c d e", "Été straße 日本", "AB ab aB"]


def plain(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower)


def test_words_are_those_of_the_pattern():
    w = W.words(pa.array(TEXTS))
    raw = bytes(w.data)
    for i, text in enumerate(TEXTS):
        at = range(w.first[i], w.first[i + 1])
        assert [raw[w.start[k] : w.end[k]].decode() for k in at] == plain(text)
        assert all(w.row[k] == i for k in at)


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)] + ["ab", "ba", "a", "b"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(200)]
    whole, halves = W.words(pa.array(texts)), [W.words(pa.array(texts[:77])), W.words(pa.array(texts[77:]))]
    assert (whole.hash == np.concatenate([h.hash for h in halves])).all()
    by_word = {}
    for word, h in zip([x for t in texts for x in plain(t)], whole.hash.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_windows_agree_with_tuples_of_words():
    texts = [*TEXTS, "p q r s t u v", "q r s t u", "p q", "p q ", "P Q"]
    row, _, h = W.windows(W.words(pa.array(texts)), 5)
    seen = {}
    for i, text in enumerate(texts):
        ws = plain(text)
        want = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)] if len(ws) >= 5 else [tuple(ws)] if ws else []
        got = h[row == i].tolist()
        assert len(got) == len(want)
        for a, b in zip(want, got, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_spaced_windows_ignore_the_other_positions():
    _, _, h = W.spaced(W.words(pa.array(["a b c d", "a x c d", "a b y d"])), (0, 2, 3))
    assert h[0] == h[1] != h[2]


def test_parts_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"i": list(range(50)), "t": ["x" * (i * 7 % 40) if i % 5 else None for i in range(50)]})
    parts = list(W.parts(iter([batch, batch.slice(0, 0)]), 1, most=64))
    assert len(parts) > 3 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(50))

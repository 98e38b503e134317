import collections
import itertools
import math

import numpy as np
import pytest
from fixtures import documents

from duskwatch.llm import pieces as P
from duskwatch.llm.queries import TOKENIZERS
from duskwatch.llm.words import mix

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
TEXTS = ["", None, " ", "  a  b ", "a\n\tb", "▁x ▁", "ｆｕｌｌ①", "é", "x" * 3000, "a\0b", "😀 ok", "The quick brown fox. " * 400]


@pytest.fixture(scope="module")
def vocabulary():
    return P.read_vocabulary(MODEL)


def segmentations(word, v):
    if not word:
        yield (), 0.0
    for k in range(1, len(word) + 1):
        for i in [i for i, p in enumerate(v.pieces) if p == word[:k]]:
            for rest, log_p in segmentations(word[k:], v):
                yield (i, *rest), log_p + v.log_p[i]


@pytest.mark.parametrize("alpha", [0.5, 1.0])
def test_draws_follow_the_distribution_of_all_segmentations(vocabulary, alpha):
    weight = {s: math.exp(alpha * p) for s, p in segmentations("▁over", vocabulary)}
    total, n = sum(weight.values()), 60_000
    ids, at = P.sample(["over"] * n, mix(np.arange(n).astype(np.uint64)), vocabulary, alpha)
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(at))
    assert set(seen) <= set(weight) and len(weight) > 5
    assert all(abs(seen[s] / n - w / total) < 0.01 for s, w in weight.items())


def test_every_text_comes_back(spark, vocabulary):
    df = documents(spark, list(enumerate(TEXTS))).withColumnRenamed("source", "piece_ids")
    coded = P.encode(df, MODEL, check="same")
    assert coded.columns == ["doc_id", "text", "lang", "n_chars", "piece_ids", "same"]
    back = {r["doc_id"]: r for r in P.decode(coded.withColumnRenamed("text", "old"), MODEL).collect()}
    for i, t in enumerate(TEXTS):
        assert back[i]["text"] == t and back[i]["same"] == (None if t is None else True)
    assert back[0]["piece_ids"] == [] and back[1]["piece_ids"] is None
    assert P.encode(df.limit(0), MODEL).count() == 0


def test_partitioning_changes_nothing_and_keys_do(spark):
    df = documents(spark, [(i, "sampled segmentations of one text") for i in range(60)] + [(3, "sampled segmentations of one text"), (None, "sampled")])
    one = {(r["doc_id"], tuple(r["piece_ids"])) for r in P.encode(df.coalesce(1), MODEL, seed=5).collect()}
    assert one == {(r["doc_id"], tuple(r["piece_ids"])) for r in P.encode(df.repartition(7), MODEL, seed=5).collect()}
    assert len(one) == 61 and len({s for _, s in one}) > 5
    assert one != {(r["doc_id"], tuple(r["piece_ids"])) for r in P.encode(df, MODEL, seed=6).collect()}


def test_parts_of_a_batch_change_nothing(vocabulary, monkeypatch):
    keys = mix(np.arange(len(TEXTS)).astype(np.uint64))
    whole = P.sample(TEXTS, keys, vocabulary)
    monkeypatch.setattr(P, "PART_WORDS", 50)
    parts = P.sample(TEXTS, keys, vocabulary)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_lattices_are_filtered_once_per_distinct_word(vocabulary, monkeypatch):
    filtered, plain = [], P._filter
    monkeypatch.setattr(P, "_filter", lambda words, *rest: (filtered.extend(words), plain(words, *rest))[1])
    lat, keys = P.Lattices(vocabulary, 0.9), mix(np.arange(len(TEXTS)).astype(np.uint64))
    first = P.sample(TEXTS, keys, vocabulary, 0.9, lat)
    assert len(filtered) == len(set(filtered)) == len({w for t in TEXTS for w in P.split_words(t or "")})
    again = P.sample([*TEXTS, "brown foxes"], np.append(keys, keys[:1]), vocabulary, 0.9, lat)
    assert filtered[-1:] == ["▁foxes"] and len(filtered) == len(set(filtered))
    assert (again[0][: len(first[0])] == first[0]).all() and (again[1][: len(first[1])] == first[1]).all()


@pytest.mark.parametrize(("kept", "block"), [(0, 1), (30, 7), (10_000, 100)])
def test_bounds_on_lattices_change_nothing(vocabulary, monkeypatch, kept, block):
    keys = mix(np.arange(len(TEXTS)).astype(np.uint64))
    whole = P.sample(TEXTS, keys, vocabulary, 0.9)
    monkeypatch.setattr(P, "KEPT_CHARS", kept)
    monkeypatch.setattr(P, "BLOCK_CHARS", block)
    lat = P.Lattices(vocabulary, 0.9)
    parts = [P.sample([t], keys[i : i + 1], vocabulary, 0.9, lat)[0] for i, t in enumerate(TEXTS)]
    assert (np.concatenate(parts) == whole[0]).all()
    assert lat.nodes <= kept or len(lat.end) == len(set(P.split_words(TEXTS[-1])))


def one_by_one(text, key, v, alpha):
    """Filtering and drawing as defined, a word and a piece at a time."""
    number = {p: i for i, p in enumerate(v.pieces) if p}
    out, before = [], 0
    for word in P.split_words(text):
        forward, into = [0.0], [[]]
        for p in range(1, len(word) + 1):
            ways = [(k, number[word[p - k : p]], alpha * v.log_p[number[word[p - k : p]]]) for k in range(1, min(p, v.longest) + 1) if word[p - k : p] in number]
            if not ways or ways[0][0] > 1:
                spelled = v.byte_ids[list((P.SPACE if word[p - 1] == P.LITERAL else word[p - 1]).encode())].tolist()
                ways.insert(0, (1, spelled, alpha * v.log_p[v.byte_ids[0]] * len(spelled)))
            weight = [math.exp(forward[p - k] + g - forward[p - 1]) for k, _, g in ways]
            forward.append(forward[p - 1] + math.log(sum(weight)))
            into.append([(k, i, c / sum(weight)) for (k, i, _), c in zip(ways, itertools.accumulate(weight), strict=True)])
        got, p = [], len(word)
        while p:
            draw = mix(np.array([key], np.uint64) + np.array([before + p], np.uint64) * P._GOLDEN)
            u = int(draw[0] >> np.uint64(40)) * 2.0**-24
            k, i = next(((k, i) for k, i, c in into[p] if c > u), into[p][-1][:2])
            got = (i if isinstance(i, list) else [i]) + got
            p -= k
        out, before = out + got, before + len(word)
    return out


def test_segmentations_are_those_drawn_one_by_one(vocabulary):
    texts = [t for t in TEXTS if t] + [" lead", "trail  ", "two  in", "naïve Ångström 東京 word", "internationalization of incomprehensibilities"]
    keys = mix(np.arange(len(texts)).astype(np.uint64))
    ids, at = P.sample(texts, keys, vocabulary, 0.9)
    for t, key, a, b in zip(texts, keys, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == one_by_one(t, key, vocabulary, 0.9), t

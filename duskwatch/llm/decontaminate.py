"""Benchmark passages in documents, found by spaced seeds and verified with substitutions allowed.

A seed hashes the words at fixed offsets and ignores the positions between
them, so a changed word between two of its offsets does not hide a hit. Every
hit names a diagonal (document position less item position), on which the words
of both sides are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

#: Offsets of the hashed words: a solid run, and three with ignored positions.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 6, 8), (0, 1, 4, 6, 7, 9))
#: Words that an overlap has to share with an item; of a shorter item, this share of its words.
LEAST_WORDS, LEAST_SHARE = 13, 0.8
#: Items of fewer words are not looked for: their words alone prove nothing.
LEAST_ITEM = 5
#: A changed word costs as much as so many equal words give.
PENALTY = 3
#: Words of benchmark items held by a task at a time; a larger benchmark is taken in blocks, each a pass over the documents' rows.
BLOCK_WORDS = 2_000_000

OVERLAP = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("n_equal", T.LongType()), T.StructField("n_words", T.LongType()),
])


class Items(NamedTuple):
    ids: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    masks: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # offsets, filter, sorted seeds, their items and positions


FILTER_BITS = 20


def index_items(ids: list[int], texts: list[str | None]) -> Items:
    """Seeds of benchmark items. An item shorter than a mask is looked for by all of its words but one, whichever that is."""
    w = W.words(pa.array(texts, pa.string()))
    count = np.diff(w.first)
    longest = max(m[-1] + 1 for m in MASKS)
    short = [int(n) for n in np.unique(count[(count >= LEAST_ITEM) & (count < longest)])]
    # A run of all words but one stands at both ends of the item, the other masks leave out one word within it.
    spared = [(tuple(k for k in range(n) if k != left), n) for n in short for left in range(1, n)]
    masks = []
    for offsets, only in [(m, None) for m in MASKS] + spared:
        row, at, seed = W.spaced(w, offsets)
        keep = count[row] == only if only is not None else count[row] >= longest
        row, at, seed = row[keep], at[keep], seed[keep]
        if len(seed):
            order = np.argsort(seed, kind="stable")
            present = np.zeros(1 << FILTER_BITS, bool)
            present[(seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            masks.append((offsets, present, seed[order], row[order], (at - w.first[row])[order]))
    return Items(np.array(ids, np.int64), w.first, w.hash, masks)


def overlaps(w: W.Words, items: Items) -> list[tuple[int, int, int, int, int, int]]:
    """``(row, item, first word, one past the last word, equal words, words)`` of every verified overlap; words count from the row's first."""
    found = []
    for offsets, present, seeds, item, place in items.masks:
        row, at, seed = W.spaced(w, offsets)
        maybe = np.flatnonzero(present[(seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        low, high = np.searchsorted(seeds, seed[maybe], "left"), np.searchsorted(seeds, seed[maybe], "right")
        times = high - low
        hit = np.repeat(maybe, times)
        which = np.repeat(low, times) + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)
        if len(hit):
            found.append(np.stack([row[hit], item[which], at[hit] - w.first[row[hit]] - place[which]], axis=1))
    out = []
    for row, item, diagonal in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
        mine, theirs = w.hash[w.first[row] : w.first[row + 1]], items.hash[items.first[item] : items.first[item + 1]]
        low, high = max(0, -diagonal), min(len(theirs), len(mine) - diagonal)
        equal = theirs[low:high] == mine[low + diagonal : high + diagonal]
        needs = min(LEAST_WORDS, math.ceil(LEAST_SHARE * len(theirs)))
        for start, end, n_equal in best_runs(equal, needs):
            out.append((row, item, low + diagonal + start, low + diagonal + end, n_equal, end - start))
    return out


def best_runs(equal: np.ndarray, needs: int) -> list[tuple[int, int, int]]:
    """The runs of a diagonal with ``needs`` equal words: the best one, then the best beside it on either side, and so on; by start."""
    found, parts = [], [(0, len(equal))]
    while parts:
        low, high = parts.pop()
        if int(equal[low:high].sum()) < needs:
            continue
        score = np.concatenate([[0], np.cumsum(np.where(equal[low:high], 1, -PENALTY))])
        gain = score - np.minimum.accumulate(score)
        end = int(np.argmax(gain))
        start = int(np.flatnonzero(score[: end + 1] == score[: end + 1].min())[-1])
        n_equal = int(equal[low + start : low + end].sum())
        if n_equal >= needs:
            found.append((low + start, low + end, n_equal))
        if end > start:
            parts += [(low, low + start), (low + end, high)]
    return sorted(found)


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items in parts of about ``block_words`` words at most (a part holds one longer item at least)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sized = benchmark.select(F.col(f"`{item}`").cast("long").alias("i"), t.alias("t"), (F.length(t) / 2 + 1).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(1.25 * total / block_words))
    for k in range(parts if total else 0):
        rows = (sized if parts == 1 else sized.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)).select("i", "t").collect()
        rows = sorted(r for r in rows if r["i"] is not None)
        yield [r["i"] for r in rows], [r["t"] for r in rows]


def mark(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "overlaps", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``out``, the overlaps of each row with benchmark items: spans in characters, equal words and words.

    An overlap is an ungapped run on one diagonal (which may hold several) with at least
    :data:`LEAST_WORDS` equal words (of a shorter item, :data:`LEAST_SHARE` of
    them), where every changed word is outweighed by :data:`PENALTY` equal ones.
    A null or empty text has none, repeated rows are treated alike; an item
    without id, or of fewer than :data:`LEAST_ITEM` words, is not looked for. A
    column already named ``out`` is replaced. No document leaves its partition.
    """
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    at_text, names = plain.columns.index(text), plain.columns
    marked = plain.withColumn(out, F.array().cast(T.ArrayType(OVERLAP)))
    for ids, texts in blocks(benchmark, item, item_text, block_words):
        shared = df.sparkSession.sparkContext.broadcast((ids, texts))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = index_items(*shared.value)
            for batch in W.parts(batches, at_text):
                w = W.words(batch.column(at_text))
                lists = batch.column(len(names)).to_pylist()
                for row, k, start, end, n_equal, n_words in overlaps(w, items):
                    a, b = w.first[row] + start, w.first[row] + end - 1
                    lists[row].append({"item_id": int(items.ids[k]), "start": W.char_index(w, row, int(w.start[a])), "end": W.char_index(w, row, int(w.end[b])), "n_equal": n_equal, "n_words": n_words})
                for found in lists:
                    found.sort(key=lambda o: (o["start"], o["end"], o["item_id"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lists, _ARROW)], names=[*names, out])

        marked = marked.mapInArrow(work, marked.schema)
    return marked


_ARROW = pa.list_(pa.struct([(f.name, pa.int64()) for f in OVERLAP]))


def clean(df: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """The rows without an overlap, all columns as they were."""
    free = "_overlaps"
    while free in df.columns:
        free += "_"
    return mark(df, benchmark, out=free, **kwargs).filter(F.size(f"`{free}`") == 0).drop(free)

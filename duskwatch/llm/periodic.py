"""Periodic runs of words: stretches that repeat themselves at least three times, found along diagonals.

Comparing a text with itself, a run of period ``q`` is a stretch of the
diagonal at lag ``q`` on which all words match. The walk over the words keeps
the match length of the active lag: the earlier occurrence of a word lengthens
its lag or ends the stretch before it, which is emitted if it is long enough.

A frequent word has many earlier occurrences and only one of them matters. Of a
word with as many words after it as the period at least, the *latest* earlier
occurrence within a run lies exactly one period back: a nearer one would give
the run a smaller period. So contexts of 16, 32, 64 … words serve lags of up to
16, 17 to 32, 33 to 64 …, each word lengthens one diagonal per context, and a
text of ``n`` words costs ``n log(n)`` steps per context whatever repeats in it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .rows import with_result

#: Words of a run at least, and periods of a run at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the shortest context: every run matches on so many words at least.
CONTEXT = 16
#: Words copied at a time into a collapsed text.
_COPIED = 1 << 18

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

_LEFT, _ROW = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)


class Runs(NamedTuple):
    """Row, first word (counted over all rows), words and period of each run, in order of row, start and period."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find(h: np.ndarray, row: np.ndarray, first: np.ndarray) -> Runs:
    """The runs among words with hashes ``h``; ``row`` is the row of a word and ``first`` the first word of a row, and one past the last."""
    n = len(h)
    words = np.diff(first)
    last = first[1:][row] if n else np.zeros(0, np.int64)
    size, gram = 1, h.copy()
    while size < CONTEXT:
        gram[: max(n - size, 0)] = W.mix(gram[: max(n - size, 0)] * _LEFT + gram[size:])
        size *= 2
    # Contexts reach over words of one row only.
    at = np.flatnonzero((np.arange(n) + size <= last) & (words[row] >= LEAST_WORDS)) if n else np.zeros(0, np.int64)
    found = []
    while len(at):
        where = row[at]
        key = gram[at] + where.astype(np.uint64) * _ROW
        order = np.argsort(key, kind="stable")
        same = (key[order[1:]] == key[order[:-1]]) & (where[order[1:]] == where[order[:-1]])
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][same]] = at[order[1:][same]] - at[order[:-1][same]]
        low = 0 if size == CONTEXT else size // 2
        on = np.flatnonzero((lag > low) & (lag <= size))
        # A diagonal goes on while the next word has the same lag.
        goes_on = (at[on[1:]] == at[on[:-1]] + 1) & (lag[on[1:]] == lag[on[:-1]]) & (where[on[1:]] == where[on[:-1]])
        heads = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(on) else np.zeros(0, np.int64)
        matched = np.diff(np.append(heads, len(on))) + size - 1
        period = lag[on[heads]]
        length = matched + period
        kept = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        start = at[on[heads]] - period
        found.append((where[on[heads]][kept], start[kept], length[kept], period[kept]))
        # A longer context repeats only where both of its halves do.
        repeats = np.zeros(n + 1, bool)
        repeats[at[order[1:][same]]] = True
        repeats[at[order[:-1][same]]] = True
        at = at[repeats[at] & (at + 2 * size <= last[at]) & (words[where] >= LEAST_PERIODS * (size + 1))]
        at = at[repeats[at + size]]
        gram[at] = W.mix(gram[at] * _LEFT + gram[at + size])
        size *= 2
    parts = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4)]
    order = np.lexsort((parts[3], parts[1], parts[0]))
    return Runs(*[p[order] for p in parts])


def dropped(runs: Runs, n: int) -> np.ndarray:
    """For each of ``n`` words, whether a run contains it after the run's first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs.start + runs.period, 1)
    np.add.at(cover, runs.start + runs.length, -1)
    return np.cumsum(cover)[:-1] > 0


def joined(w: W.Words, kept: np.ndarray) -> pa.Array:
    """The words at ``kept`` of each row with one space between them."""
    row = w.row[kept]
    lead = np.zeros(len(kept), np.int64)
    lead[1:] = row[1:] == row[:-1]
    size = w.end[kept] - w.start[kept] + lead
    offsets = np.zeros(len(w.first), np.int64)
    offsets[1:] = np.cumsum(np.bincount(row, weights=size, minlength=len(w.first) - 1)).astype(np.int64)
    out = np.empty(int(size.sum()), np.uint8)
    done = 0
    for at in range(0, len(kept), _COPIED):
        part = slice(at, at + _COPIED)
        ends = np.cumsum(size[part])
        source = np.arange(ends[-1]) + np.repeat(w.start[kept[part]] - lead[part] - ends + size[part], size[part])
        piece = w.data[np.maximum(source, 0)]
        piece[(ends - size[part])[lead[part] > 0]] = 32
        out[done : done + len(piece)] = piece
        done += len(piece)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def collapse(column: pa.Array) -> pa.StructArray:
    """Words, runs and the text without repetitions of each text."""
    w = W.words(column, fold=False)
    runs = find(w.hash, w.row, w.first)
    kept = np.flatnonzero(~dropped(runs, len(w.hash)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(runs.row, minlength=len(column)))]).astype(np.int32)
    parts = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in (runs.start - w.first[runs.row], runs.length, runs.period)], names=["start", "length", "period"])
    return pa.StructArray.from_arrays([pa.array(np.diff(w.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), parts), joined(w, kept)], names=["n_words", "runs", "collapsed"])


def detect(df: DataFrame, text: str = "text", out: str = "periodic", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``out``: ``n_words``, ``runs`` (``start``, ``length``, ``period`` in words) and ``collapsed``.

    ``collapsed`` is the text with one space between words and each run cut to
    its first period. A null text counts as empty: no words, no runs, an empty
    ``collapsed``. Rows are looked at one by one, so repeated rows and keys
    change nothing; an empty table gives an empty one; a column named ``out``
    is replaced and other names are free. A text is held whole in one task,
    with about a hundred bytes per word.
    """
    return with_result(df, text, out, RESULT, collapse, keep)


def best(runs: Column) -> Column:
    """The run with the greatest length per period; of equals the first, then that of the smaller period. Null without runs."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"

    def better(acc: Column, r: Column) -> Column:
        return F.when(acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"]), r).otherwise(acc)

    return F.aggregate(runs, F.lit(None).cast(kind), better)

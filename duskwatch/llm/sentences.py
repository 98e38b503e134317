"""Repeated passages: runs of consecutive sentences that occur before, in this document or in another.

Each run of :data:`RUN` sentences (more where they are short) becomes one small row of hashes and a span.
Equal runs are grouped to their first document before anything is joined, so a
passage that a third of all documents share is one row on the grouped side,
and its occurrences are the splittable side of a plain join.

A longer sentence is several pieces, cut after words chosen by their hashes
alone, and a line break ends a sentence in one reading and not in another, so a
passage that begins within a sentence or is wrapped otherwise holds the same
runs as its other copies: any 50 equal words hold three whole pieces.

Most runs occur once. The first pass over the texts groups the hashes; the
second drops, by a bitmap of fixed size, the runs that can't be among the
repeated ones before anything of them is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from . import words as W

#: Sentences of a run, and the words a run needs to count as a passage; shorter runs take in further sentences.
RUN, LEAST_WORDS = 3, 8
#: A sentence of more words is cut after each word whose hash is the least of so many neighbours: a piece has no more words than that.
REACH = 8
#: Bits of the bitmap of repeated runs at most (16 MB in each worker); with more runs it lets more of the others pass, which the join then drops.
MOST_BITS = 1 << 27
_TAIL = 6
#: Words looked at together for the least of neighbours.
_BLOCK = 1 << 17

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


class Sentences(NamedTuple):
    row: np.ndarray
    first: np.ndarray  # first word
    last: np.ndarray  # one past the last word
    by_row: np.ndarray  # first sentence of each row, and one past the last


def sentences(w: W.Words, reach: int | None = REACH, lines: bool = True) -> Sentences:
    """A sentence ends at a word with ``. ! ?`` in its closing punctuation, at the end of its row and, with ``lines``, at a line break.

    Sentences longer than ``reach`` are cut into pieces, alike whatever stands around them; without ``reach`` none is.
    """
    n = len(w.hash)
    ends = np.zeros(n, bool)
    open_ = np.ones(n, bool)
    for k in range(1, _TAIL + 1):
        at = w.end - k
        open_ &= at >= w.start
        byte = w.data[np.maximum(at, 0)]
        open_ &= _PUNCTUATION[byte]
        ends |= open_ & _STOP[byte]
    if n:
        if lines:
            newlines = np.concatenate([[0], np.cumsum(w.data == 10, dtype=np.int64)])
            ends[:-1] |= newlines[w.start[1:]] > newlines[w.end[:-1]]
        tails = w.first[1:][np.diff(w.first) > 0] - 1
        ends[tails] = True
        if reach is not None:
            size = np.diff(np.concatenate([[0], np.flatnonzero(ends) + 1]))
            of = np.repeat(np.arange(len(size)), size)
            ends |= _least(of, W.mix(w.hash), reach) & (size > reach)[of]
    last = np.flatnonzero(ends) + 1
    first = np.concatenate([[0], last[:-1]]) if len(last) else last
    row = w.row[first] if n else first
    return Sentences(row, first, last, np.searchsorted(row, np.arange(len(w.first))))


def _least(of: np.ndarray, h: np.ndarray, reach: int) -> np.ndarray:
    """Marks the least of each ``reach`` neighbours of one group, the first of equal ones."""
    chosen = np.zeros(len(h), bool)
    for low in range(0, len(h), _BLOCK):
        g, x = of[low : low + _BLOCK + reach - 1], h[low : low + _BLOCK + reach - 1]
        if len(x) >= reach:
            inside = np.flatnonzero(g[: len(x) - reach + 1] == g[reach - 1 :])
            chosen[low + inside + np.lib.stride_tricks.sliding_window_view(x, reach)[inside].argmin(axis=1)] = True
    return chosen


def _prefix(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]))[:n]
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    backs = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]))
    return np.concatenate([[np.uint64(0)], np.cumsum(values * powers)]), backs


_BASES = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _hashes(w: W.Words, a: np.ndarray, b: np.ndarray, base: np.uint64) -> np.ndarray:
    sums, backs = _prefix(w.hash, base)
    return W.mix((sums[b] - sums[a]) * backs[a] + (b - a).astype(np.uint64))


class Runs(NamedTuple):
    row: np.ndarray
    hash: np.ndarray
    check: np.ndarray
    start: np.ndarray  # in characters of the row
    end: np.ndarray
    repeat: np.ndarray  # not the first of its kind in its row


def _bounds(s: Sentences, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words, and one past the last, of the shortest runs of enough sentences and words on from each sentence and up to each sentence."""
    least_sentences = np.minimum(run, np.diff(s.by_row))[s.row]
    at = np.arange(len(s.row))
    to = np.maximum(at + least_sentences, np.searchsorted(s.last, s.first + least_words) + 1)
    since = np.minimum(at + 1 - least_sentences, np.searchsorted(s.first, s.last - least_words, side="right") - 1)
    on, up = to <= s.by_row[s.row + 1], since >= s.by_row[s.row]
    return s.first[np.concatenate([at[on], since[up]])], s.last[np.concatenate([to[on] - 1, at[up]])]


def runs(w: W.Words, run: int = RUN, least_words: int = LEAST_WORDS, reach: int | None = REACH) -> Runs:
    """The shortest runs of at least ``run`` sentences and ``least_words`` words from each sentence on and up to each sentence.

    A row with fewer sentences is one run. Of a stretch with as many sentences
    and words, every sentence lies in a run that lies in the stretch. Spans
    reach to the start of the next sentence. With ``reach``, sentences are
    pieces, and the runs are those of both readings of line breaks.
    """
    n = len(w.hash)
    readings = [sentences(w, reach)] if reach is None else [sentences(w, reach), sentences(w, reach, lines=False)]
    pairs = [a * (n + 1) + b for a, b in (_bounds(s, run, least_words) for s in readings)]
    a, b = np.divmod(np.unique(np.concatenate(pairs)).astype(np.int64), n + 1)
    out = [_hashes(w, a, b, base) for base in _BASES]
    row = w.row[a]
    heads = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
    begin = np.where(a == w.first[row], w.row_start[row], np.append(w.start, 0)[a])
    finish = np.where(b == w.first[row + 1], w.row_start[row + 1], np.append(w.start, 0)[b])
    order = np.lexsort((a, out[0], row))
    repeat = np.zeros(len(row), bool)
    repeat[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (out[0][order[1:]] == out[0][order[:-1]])
    # A repeat that overlaps the first of its kind leaves that whole.
    if len(order):
        of = order[np.maximum.accumulate(np.where(repeat[order], 0, np.arange(len(order))))]
        begin[order] = np.where(repeat[order], np.minimum(np.maximum(begin[order], finish[of]), finish[order]), begin[order])
    return Runs(row, out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32), heads[begin] - heads[w.row_start[row]], heads[finish] - heads[w.row_start[row]], repeat)


def run_rows(df: DataFrame, key: str, text: str, among: np.ndarray | None = None, **limits) -> DataFrame:
    """One row per run: ``k``, ``hash``, ``check``, ``start``, ``end`` and whether the run occurs earlier in its own row.

    With ``among``, a bitmap of hashes, runs that aren't in it and don't repeat in their row are left out.
    """
    fed = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t")).filter("k IS NOT NULL")
    sent = None if among is None else df.sparkSession.sparkContext.broadcast(among)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches, 1):
            r = runs(W.words(batch.column(1)), **limits)
            if sent is not None:
                keep = np.flatnonzero(r.repeat | _marked(sent.value, r.hash))
                r = Runs(*[c[keep] for c in r])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(r.row)), pa.array(r.hash), pa.array(r.check), pa.array(r.start, pa.int32()), pa.array(r.end, pa.int32()), pa.array(r.repeat)],
                names=["k", "hash", "check", "start", "end", "repeat"],
            )

    return fed.mapInArrow(work, "k long, hash long, check int, start int, end int, repeat boolean")


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.uint64) % np.uint64(len(bits) * 64)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(hashes: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A bit for each ``hash`` by its remainder, in words of 64; as many bits as keep most others out, up to ``most_bits``."""
    n = hashes.count()
    words = min(most_bits, 1 << max(10, (16 * n).bit_length())) // 64
    at = F.expr(f"CAST(pmod(hash, {words * 64}) AS BIGINT)")
    # By a power of two, the remainder of a hash is its lower bits, signed or not.
    found = hashes.select(F.floor(at / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("bit"))
    table = found.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # a row per word at most
    out = np.zeros(words, np.uint64)
    out[table.column("w").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``key`` and ``removed``: the spans covered by a run that is not the first of its kind, merged and in order.

    The first is the one of the smallest key, and within a row the earliest.
    Rows of one key are one document: they do not repeat each other. Rows
    without key or text, and documents without repeated runs, are not in the
    result. Only the hashes are shuffled, no text.
    """
    firsts = run_rows(df, key, text, **limits).filter("NOT repeat").groupBy("hash", "check").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    firsts = stage(firsts.filter(F.col("first") < F.col("last")).select("hash", "check", "first"), "repeated-runs")
    found = run_rows(df, key, text, bitmap(firsts), **limits)
    # The runs are the side that can be split where one passage has most of them.
    later = found.join(firsts, ["hash", "check"], "left").filter(F.col("repeat") | (F.col("k") > F.col("first")))
    spans = later.groupBy("k").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    kind = "removed array<struct<start:int,end:int>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), merged(batch.column(1))], names=["k", "removed"])

    return spans.mapInArrow(work, f"k long, {kind}").withColumnRenamed("k", key)


def merged(lists: pa.ListArray) -> pa.ListArray:
    """Sorted spans of each row with those that touch made one."""
    spans = lists.flatten()
    start, end = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    if not len(row):
        return lists
    # Rows are set apart by a step wider than any text, so that one running maximum serves all of them.
    shift = row * (1 << 33)
    reached = np.maximum.accumulate(end + shift)
    head = np.concatenate([[True], (start + shift)[1:] > reached[:-1]])
    heads = np.flatnonzero(head)
    to = reached[np.append(heads[1:], len(row)) - 1] - shift[heads]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[heads], minlength=len(lists)))]).astype(np.int32)
    out = pa.StructArray.from_arrays([pa.array(start[heads].astype(np.int32)), pa.array(to.astype(np.int32))], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), out)


def without(text: str, spans: list[dict[str, int]]) -> str:
    parts, at = [], 0
    for s in spans:
        parts.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*parts, text[at:]])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``df`` with repeated passages cut out of ``text``, and ``removed``, their spans in the old text (empty if none).

    A null text stays null and an empty one empty. A text of repeats alone
    becomes empty. A row without key keeps its text. An empty table gives an
    empty one. A column already named ``removed`` is replaced; other names are
    free. ``limits`` are those of :func:`runs`.
    """
    names = [c for c in df.columns if c != "removed"]
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fed = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != text]).alias("row"))
    spans = repeated_spans(df, key, text, **limits).select(F.col(f"`{key}`").alias("s"), F.col("removed").alias("spans"))
    beside = fed.join(spans, F.col("k") == F.col("s"), "left").select("t", "row", F.coalesce("spans", F.array().cast(kind)).alias("removed"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches, 0):
            some = np.asarray(batch.column(2).value_lengths()) > 0
            texts = batch.column(0)
            if some.any():
                held = pa.array(some)
                new = [None if t is None else without(t, r) for t, r in zip(texts.filter(held).to_pylist(), batch.column(2).filter(held).to_pylist(), strict=True)]
                texts = pa.compute.replace_with_mask(texts, held, pa.array(new, texts.type))
            yield pa.RecordBatch.from_arrays([texts, batch.column(1), batch.column(2)], names=["t", "row", "removed"])

    done = beside.mapInArrow(work, T.StructType([T.StructField("t", T.StringType()), fed.schema["row"], T.StructField("removed", kind)]))
    return done.select(*[F.col("t").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names], "removed")

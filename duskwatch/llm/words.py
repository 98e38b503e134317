"""Words of many texts at once, as arrays: the inner loop of the operators that hash words.

A batch of texts is one byte buffer. ``A-Z`` are lower-cased and words are the
runs of bytes other than space and 0x09-0x0D. Every word gets a 64-bit hash
that depends on its bytes alone, so equal words agree in all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xF1357AEA2E62A9C5)
#: Bytes hashed in one piece; buffers stay in the processor's cache.
PIECE = 1 << 18


class Words(NamedTuple):
    """``row`` (non-decreasing), byte span within ``data`` and hash of each word."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row_start: np.ndarray
    first: np.ndarray  # first word of each row, and one past the last word


def small_batches(spark: SparkSession, rows: int = 2000) -> SparkSession:
    """Batches handed to Python hold ``rows`` rows at most: long texts in them stay bounded on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return spark


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: Bytes of text worked on together; the arrays of a part are some twenty times as large.
PART = 2 << 20


def parts(batches: Iterator[pa.RecordBatch], text: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts of about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        part = (offsets[1:] - offsets[0]) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def words(column: pa.Array | pa.ChunkedArray, fold: bool = True) -> Words:
    """The words of a text column, ``A-Z`` lower-cased if ``fold``."""
    data, offsets = utf8(column)
    n = len(data)
    if fold:
        upper = (data >= 65) & (data <= 90)
        data = np.where(upper, data + 32, data).astype(np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    # A word starts where a word byte follows a gap or the start of a row.
    inside = ~gap
    starts = inside.copy()
    starts[1:] &= gap[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    starts[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= gap[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets, side="left")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, row, start, end, hash_spans(data, start, end), offsets, first)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes: a polynomial from prefix sums, scrambled with the length."""
    out = np.empty(len(start), dtype=np.uint64)
    longest = int((end - start).max()) if len(start) else 0
    size = min(len(data), max(PIECE, longest))
    powers, inverses = _powers(size, _BASE), _powers(size, _BASE_INVERSE)
    at = 0
    while at < len(start):
        base = start[at]
        to = max(int(np.searchsorted(end, base + PIECE, side="right")), at + 1)
        piece = data[base : end[to - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece * powers[: len(piece)], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def windows(w: Words, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, first word, hash)`` of every run of ``size`` words; a shorter row is one run if ``whole``."""
    return spaced(w, tuple(range(size)), whole)


def spaced(w: Words, offsets: tuple[int, ...], whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash the words at ``offsets`` after each word that has all of them in its row; other positions are ignored.

    With ``whole``, a row too short for any gets one hash of all its words. Rows come in order.
    """
    n, span = len(w.hash), offsets[-1] + 1
    at = np.flatnonzero(w.row[: n - span + 1] == w.row[span - 1 :]) if n >= span else np.zeros(0, np.int64)
    total = np.zeros(len(at), dtype=np.uint64)
    for o in offsets:
        total = total * _STEP + w.hash[at + o]
    total, row = mix(total), w.row[at]
    if whole:
        count = np.diff(w.first)
        short = np.flatnonzero((count > 0) & (count < span))
        if len(short):
            extra = count[short].astype(np.uint64)
            for k in range(span - 1):
                has = count[short] > k
                extra[has] = extra[has] * _STEP + w.hash[w.first[short[has]] + k]
            row, at, total = np.concatenate([row, short]), np.concatenate([at, w.first[short]]), np.concatenate([total, mix(extra)])
            order = np.argsort(row, kind="stable")
            row, at, total = row[order], at[order], total[order]
    return row, at, total


def char_index(w: Words, row: int, byte: int) -> int:
    """The code points of ``row`` before ``byte``."""
    return int(np.count_nonzero((w.data[w.row_start[row] : byte] & 0xC0) != 0x80))

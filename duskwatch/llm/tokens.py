"""Token counts of parts of a document, from one encoding of the whole.

Encoding parts on their own gives other tokens than encoding the document, so
a document is encoded once; its tokens' character spans are then joined with
the spans of its sections, and a token that crosses a boundary is allocated by
a stated rule. Spans and sections of a row are in one place, so the interval
join needs no shuffle.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import parts

#: Fixed value: the split pattern that belongs to the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "start", "share")

SECTION = "struct<name:string,start:bigint,end:bigint>"
COUNTED = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("n_tokens", T.DoubleType()), T.StructField("n_crossing", T.LongType()),
]))


def read_encoding(ranks: str):
    """A tiktoken encoding of a file of ranks, and the bytes of each token by id."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    lengths = np.zeros(max(table.values()) + 1, np.int64)
    for token, rank in table.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), lengths


#: White space of the pattern, in runs that it would search with a stack of their length.
_LONG_GAP = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}"
LONG_GAP = 100_000


def encode(encoding, value: str, long_gap: int = LONG_GAP) -> np.ndarray:
    """The tokens of a text of any length.

    A long run of white space is taken out as the pattern itself would: all of
    it at the end of the text, else without its last character, which belongs to
    what follows.
    """
    if len(value) < long_gap:
        return encoding.encode_to_numpy(value, disallowed_special=())
    out, at = [], 0
    for m in re.finditer(_LONG_GAP % long_gap, value):
        end = m.end() - (m.end() < len(value))
        out += [encoding.encode_to_numpy(value[at : m.start()], disallowed_special=()), np.array(encoding._encode_single_piece(value[m.start() : end]), np.uint32)]
        at = end
    return np.concatenate([*out, encoding.encode_to_numpy(value[at:], disallowed_special=())])


def char_spans(text: bytes, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of consecutive tokens of ``n_bytes`` bytes; a character cut by tokens is in the spans of all of them."""
    ends = np.cumsum(n_bytes)
    starts = ends - n_bytes
    heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    upto = np.cumsum(heads)  # characters begun up to and with each byte
    return (upto[starts] - 1, upto[ends - 1]) if len(ends) else (starts, ends)


def line_starts(text: bytes) -> np.ndarray:
    """The character at which each line starts; a line ends with its newline, and no line follows the last newline."""
    raw = np.frombuffer(text, np.uint8)
    upto = np.cumsum((raw & 0xC0) != 0x80)
    breaks = upto[raw == 10]
    return np.concatenate([[0], breaks[breaks < (upto[-1] if len(upto) else 0)]])


def allocate(start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens ``[start, end)`` counted by section ``[first, last)``; both sorted, sections disjoint.

    ``most``: a token counts where most of its characters are, the earlier
    section on ties. ``start``: where its first character is. ``share``: in
    each section by its share of characters. A token outside all sections
    counts nowhere. The second result counts the tokens that cross a boundary
    of the section and are (partly) counted in it.
    """
    n = len(first)
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n or not len(start):
        return counts, crossing
    low = np.searchsorted(last, start, side="right")  # first section that ends after the token's start
    high = np.searchsorted(first, end, side="left")  # one past the last section that starts before its end
    times = np.maximum(high - low, 0)
    token = np.repeat(np.arange(len(start)), times)
    section = np.repeat(low, times) + np.arange(len(token)) - np.repeat(np.cumsum(times) - times, times)
    overlap = np.minimum(end[token], last[section]) - np.maximum(start[token], first[section])
    real = overlap > 0
    token, section, overlap = token[real], section[real], overlap[real]
    if rule == "share":
        weight = overlap / (end[token] - start[token])
    elif rule == "start":
        weight = (first[section] <= start[token]).astype(float)
    else:
        # Of the pairs of one token, the widest and then earliest comes first.
        order = np.lexsort((section, -overlap, token))
        heads = np.ones(len(order), bool)
        heads[1:] = token[order][1:] != token[order][:-1]
        weight = np.zeros(len(token))
        weight[order[heads]] = 1
    np.add.at(counts, section, weight)
    crosses = (weight > 0) & ((start[token] < first[section]) | (end[token] > last[section]))
    np.add.at(crossing, section, crosses)
    return counts, crossing


def joined_fields(df: DataFrame, fields: list[str], text: str = "text", sections: str = "sections", separator: str = "\n") -> DataFrame:
    """One text of several fields (null is empty), and their sections; a separator belongs to the field before it."""
    values = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    parts = [F.concat(v, F.lit(separator)) if i + 1 < len(fields) else v for i, v in enumerate(values)]
    spans, at = [], F.lit(0).cast("bigint")
    for name, part in zip(fields, parts, strict=True):
        to = at + F.length(part)
        spans.append(F.struct(F.lit(name).alias("name"), at.alias("start"), to.alias("end")))
        at = to
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (text, sections)]
    return df.select(*keep, F.concat(*parts).alias(text), F.array(*spans).alias(sections))


def count_by_section(df: DataFrame, ranks: str, text: str = "text", sections: str | Column | None = None, rule: str = "most", out: str = "token_sections") -> DataFrame:
    """Add ``out``: the sections of each row with their tokens, and the number of tokens as ``out + "_total"``.

    ``sections`` is an array of ``(name, start, end)`` in characters, or none
    for the lines of the text. Sections are taken by start; where two overlap
    the characters belong to the earlier one; a section is cut to the text. A
    null text counts as empty: its sections have no tokens, and without given
    sections it has one empty line. Columns named like the results are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    total = f"{out}_total"
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (out, total)])
    names = plain.columns
    given = F.lit(None) if sections is None else F.col(sections) if isinstance(sections, str) else sections
    fed = plain.select("*", given.cast(f"array<{SECTION}>").alias("__sections"))
    schema = T.StructType([*plain.schema.fields, T.StructField(out, COUNTED), T.StructField(total, T.LongType())])
    own = sections is None
    at_text = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = read_encoding(ranks)
        for batch in parts(batches, at_text):
            texts = batch.column(at_text).to_pylist()
            listed = [None] * len(texts) if own else batch.column(len(names)).to_pylist()
            rows, columns, totals = [0], ([], [], [], [], []), []
            for value, spans in zip(texts, listed, strict=True):
                value = value or ""
                raw = value.encode("utf-8")
                start, end = char_spans(raw, lengths[encode(encoding, value)])
                if own:
                    first = line_starts(raw)
                    last = np.append(first[1:], len(value))
                    labels = [f"line {i}" for i in range(len(first))]
                else:
                    spans = sorted((s for s in spans or [] if s), key=lambda s: (s["start"] or 0, s["end"] or 0))
                    labels = [s["name"] for s in spans]
                    last = np.clip([s["end"] or 0 for s in spans], 0, len(value)).astype(np.int64)
                    last = np.maximum.accumulate(last) if len(last) else last
                    first = np.clip([s["start"] or 0 for s in spans], 0, len(value)).astype(np.int64)
                    first = np.minimum(np.maximum(first, np.concatenate([[0], last[:-1]])) if len(last) else first, last)
                counts, crossing = allocate(start, end, first, last, rule)
                totals.append(len(start))
                rows.append(rows[-1] + len(first))
                for column, part in zip(columns, (labels, first, last, counts, crossing), strict=True):
                    column.extend(part)
            fields = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)]
            listed = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(fields, names=[f.name for f in COUNTED.elementType]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], listed, pa.array(totals, pa.int64())], names=[*names, out, total])

    return fed.mapInArrow(work, schema)

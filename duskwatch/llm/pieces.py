"""Sampled segmentation into the pieces of a SentencePiece vocabulary, and lossless decoding.

No piece reaches over the start of a word, so the lattice of a text is the
chain of the lattices of its words. Forward filtering runs over all new
distinct words of a part of a batch together, and a task keeps the lattices of
the words it met, up to a bound; backward sampling then draws one piece at a
time for all words together. A lattice is a function of its word, a draw one of
the row's key, the seed and the position of the lattice node in its text, so
neither the partitioning nor a retried task changes a segmentation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix, parts

SPACE = "▁"
#: Stands for a literal SPACE character of the text, which must come back as such. No text holds a lone surrogate.
LITERAL = "\ud800"
#: Stands between words that are worked on together; likewise in no text, and in no piece.
BREAK = "\ud801"
#: A longer word is cut after every so many characters, and no piece reaches over a cut.
WORD_CHARS = 256
#: Words worked on together; bounds the arrays of a batch or of a very long text.
PART_WORDS = 150_000
#: Characters of the words whose lattices a task keeps, some 50 bytes each; beyond it starts over with the words of a part.
KEPT_CHARS = 2_500_000
#: Characters of new words filtered together; bounds the arrays that filtering needs for a while, some 200 bytes each.
BLOCK_CHARS = 150_000

_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_GOLDEN = np.uint64(0xD1342543DE82EF95)


class Vocabulary(NamedTuple):
    pieces: list[str]  # by id; empty for ids that are never drawn
    log_p: np.ndarray  # by id
    byte_ids: np.ndarray  # by byte
    longest: int
    slots: np.ndarray  # open-addressed table of the hashes of all beginnings of pieces; 0 where empty
    ids: np.ndarray  # by slot: the id of the piece, -1 for a beginning that is none


def _hash(codes: np.ndarray, before: np.ndarray | np.uint64) -> np.ndarray:
    x = (before + codes + np.uint64(1)) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def read_vocabulary(model: str) -> Vocabulary:
    """The pieces of a SentencePiece model file.

    A BPE model's scores are minus the rank of a merge. Ranks become
    probabilities by Zipf's law, ``p(rank) ~ 1 / (rank + 2.7)``, as piece
    frequencies fall about so; a unigram model's scores are log-probabilities
    and are taken as they are. A byte piece gets the least probability.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces, score, byte_ids = [""] * n, {}, np.zeros(256, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[i], score[i] = sp.id_to_piece(i), sp.get_score(i)
    if all(s == int(s) for s in score.values()):
        score = {i: -math.log(2.7 + min(-s, n)) for i, s in score.items()}
    total = math.log(sum(math.exp(s) for s in score.values()))
    log_p = np.full(n, min(score.values()) - total)
    log_p[list(score)] = np.array(list(score.values())) - total
    ids = {pieces[i][:k]: -1 for i in score for k in range(1, len(pieces[i]))} | {pieces[i]: i for i in score}
    size = 1 << (4 * len(ids)).bit_length()
    slots, by_slot = [0] * size, np.full(size, -1, np.int32)
    for length in set(map(len, ids)):
        of = [p for p in ids if len(p) == length]
        codes = np.frombuffer("".join(of).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, length)
        h = np.zeros(len(of), np.uint64)
        for k in range(length):
            h = _hash(codes[:, k], h)
        for p, x, at in zip(of, h.tolist(), _slot(h, size).tolist(), strict=True):
            while slots[at]:
                at = (at + 1) % size
            slots[at], by_slot[at] = x, ids[p]
    return Vocabulary(pieces, log_p, byte_ids, max(map(len, pieces)), np.array(slots, np.uint64), by_slot)


def _slot(h: np.ndarray, size: int) -> np.ndarray:
    return ((h >> np.uint64(40)) & np.uint64(size - 1)).view(np.int64)  # the size is a power of two


def _find(v: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes ``h`` are beginnings of pieces, and the slots of these."""
    size = len(v.slots)
    at = _slot(h, size)
    there = v.slots[at]
    hit = there == h
    open_ = np.flatnonzero(~hit & (there != 0))
    while len(open_):
        at[open_] = (at[open_] + 1) % size
        there = v.slots[at[open_]]
        same = there == h[open_]
        hit[open_[same]] = True
        open_ = open_[~same & (there != 0)]
    hit = np.flatnonzero(hit)
    return hit, at[hit]


class Lattices:
    """Lattices of distinct words: a node per character, after it, and one before the first. Words are added as they come.

    The edges into a node stand together, shorter ones first; ``last`` is by
    node, and the node ``n`` characters before another is ``n`` below it.
    """

    def __init__(self, v: Vocabulary, alpha: float):
        self.v, self.alpha = v, alpha
        # By piece id; -1, no piece, is the last.
        self.gain = np.append(alpha * v.log_p, -np.inf)
        self.forget()

    def forget(self) -> None:
        self.end: dict[str, int] = {}  # last node by word
        self.nodes = self.edges = 0  # in use; the arrays have room for more
        self.last, self.depth = np.empty(0, np.int32), np.empty(0, np.int16)  # by node: its last edge, characters before it
        self.piece = np.empty(0, np.int32)  # by edge: piece id, or -1 - code point for a spelled character
        self.size = np.empty(0, np.int16)  # by edge: characters
        self.low = np.empty(0, np.float32)  # by edge: cumulative probability of the edges before it

    def ends(self, words: list[str]) -> np.ndarray:
        """The last nodes of ``words``; new words are added."""
        found = self._known(words)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        some = [words[i] for i in missing.tolist()]
        new = set(some)
        if self.end and self.nodes + sum(map(len, new)) > KEPT_CHARS:
            self.forget()
            some, new, missing = words, set(words), slice(None)
        self._add(sorted(new, key=len, reverse=True))
        found[missing] = self._known(some)
        return found

    def _known(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.end.get, words, repeat(-1)), np.int64, len(words))

    def _add(self, words: list[str]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        block = np.cumsum(sizes) // BLOCK_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(words)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            last, depth, piece, size, low = _filter(words[a:b], sizes[a:b], self.v, self.gain, self.alpha)
            self.end.update(zip(words[a:b], (np.cumsum(sizes[a:b] + 1) + (self.nodes - 1)).tolist(), strict=True))
            self.last, self.depth = _put(self.last, self.nodes, last + np.int32(self.edges)), _put(self.depth, self.nodes, depth)
            self.piece, self.size, self.low = _put(self.piece, self.edges, piece), _put(self.size, self.edges, size), _put(self.low, self.edges, low)
            self.nodes, self.edges = self.nodes + len(last), self.edges + len(low)


def _put(into: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``into`` with ``more`` after its first ``used`` values, in place if there is room."""
    upto = used + len(more)
    if upto > len(into):
        into = np.concatenate([into[:used], np.empty(upto + upto // 2 - used, into.dtype)])
    into[used:upto] = more
    return into


def _filter(words: list[str], sizes: np.ndarray, v: Vocabulary, gain: np.ndarray, alpha: float) -> tuple[np.ndarray, ...]:
    """Forward filtering: ``last``, ``depth``, ``piece``, ``size`` and ``low`` of ``words``, which are in descending order of length."""
    n, top = len(words), int(sizes[0])
    codes = np.frombuffer(BREAK.join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    # A node is filtered with those of its depth; among them, the words with so many characters or more.
    alive = np.searchsorted(-sizes, -np.arange(top + 1), side="right")
    level = np.concatenate([[0], np.cumsum(alive)])
    depth = np.arange(len(codes) - 1) - np.repeat(begin, sizes + 1)
    order = level[depth] + np.repeat(np.arange(n), sizes + 1)
    width = min(v.longest, top)
    edge = np.full((width, len(order)), -1, np.int32)
    at, h = np.flatnonzero(codes != ord(BREAK)), np.uint64(0)
    for k in range(width):
        h = _hash(codes[at + k], h)
        hit, slot = _find(v, h)
        at, h, ids = at[hit], h[hit], v.ids[slot]
        is_piece = np.flatnonzero(ids >= 0)
        edge[k, order[at[is_piece] + k]] = ids[is_piece]
    forward = np.zeros(len(order))
    low = np.full((width, len(order)), 2, np.float32)
    for p in range(1, top + 1):
        here, wide = slice(level[p], level[p] + alive[p]), min(width, p)
        ids = edge[:wide, here]
        weight = gain[ids]
        for k in range(wide):
            weight[k] += forward[level[p - k - 1] : level[p - k - 1] + alive[p]]
        spell = np.flatnonzero(ids[0] < 0)
        if len(spell):
            real = codes[begin[spell] + p].astype(np.int32)
            real[real == ord(LITERAL)] = ord(SPACE)
            n_bytes = 1 + (real >= 0x80).astype(np.int64) + (real >= 0x800) + (real >= 0x10000)
            weight[0, spell] = forward[level[p - 1] + spell] + alpha * v.log_p[v.byte_ids[0]] * n_bytes
            ids[0, spell] = -1 - real
        best = weight.max(axis=0)
        part = np.exp(weight - best)
        # Added up one by one, as a sum's order may depend on the number of words.
        upto = np.cumsum(part, axis=0)
        total = upto[-1]
        forward[here] = best + np.log(total)
        low[0, here] = 0
        np.copyto(low[1:wide, here], upto[:-1] / total, where=part[1:] > 0, casting="same_kind")
    has = low < 2
    count = has.sum(axis=0, dtype=np.int32)
    last = np.cumsum(count, dtype=np.int32) - np.int32(1)
    free = last + np.int32(1) - count
    n_edges = int(last[-1]) + 1
    piece, size, cumulative = np.empty(n_edges, np.int32), np.empty(n_edges, np.int16), np.empty(n_edges, np.float32)
    for k in range(width):
        node = np.flatnonzero(has[k])
        to = free[node]
        piece[to], size[to], cumulative[to] = edge[k, node], k + 1, low[k, node]
        free[node] += 1
    return last[order], depth.astype(np.int16), piece, size, cumulative


def _spelled(ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with every spelled character put out by its byte pieces, and the number of pieces each id became."""
    times = np.ones(len(ids), np.int64)
    low = np.flatnonzero(ids < 0)
    if not len(low):
        return ids, times
    chars, which = np.unique(-1 - ids[low], return_inverse=True)
    coded = [chr(c).encode("utf-8") for c in chars.tolist()]
    table = np.zeros((len(chars), 4), np.int32)
    for i, b in enumerate(coded):
        table[i, : len(b)] = v.byte_ids[list(b)]
    times[low] = np.array([len(b) for b in coded])[which]
    out = np.repeat(ids, times)
    first = (np.cumsum(times) - times)[low]
    for k in range(4):
        has = times[low] > k
        out[first[has] + k] = table[which[has], k]
    return out, times


def _part(words: list[str], key: np.ndarray, offset: np.ndarray, count: np.ndarray, lat: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of ``words`` in order, and their number by stretch of ``count`` words; ``offset`` and ``key`` are those of the stretches."""
    node = lat.ends(words)
    left = lat.depth[node].astype(np.int32)
    ends = np.cumsum(left, dtype=np.int64)
    position = ends - left
    first = np.cumsum(count) - count
    # A draw's place is the key of its row, moved on by its node's position in the text.
    place = np.repeat(key + (offset - position[first]).astype(np.uint64) * _GOLDEN, count) + position.astype(np.uint64) * _GOLDEN
    at, steps = np.arange(len(words)), np.zeros(len(words), np.int64)
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        draw = mix(place + left.astype(np.uint64) * _GOLDEN)
        u = (draw >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        # The last edge that begins at the draw or below.
        edge = lat.last[node]
        open_ = np.flatnonzero(lat.low[edge] > u)
        while len(open_):
            edge[open_] -= 1
            open_ = open_[lat.low[edge[open_]] > u[open_]]
        taken.append((at, lat.piece[edge]))
        steps[at] = len(taken)
        size = lat.size[edge]
        more = np.flatnonzero(left > size)
        at, place, size = at[more], place[more], size[more]
        left, node = left[more] - size, node[more] - size
    ends = np.cumsum(steps)
    ids = np.empty(int(ends[-1]), np.int32)
    for k, (at, piece) in enumerate(taken):
        ids[ends[at] - 1 - k] = piece
    ids, times = _spelled(ids, v=lat.v)
    upto = np.concatenate([[0], np.cumsum(times)])[np.append(0, ends)]
    return ids, upto[first + count] - upto[first]


def split_words(text: str) -> list[str]:
    """The words of a text, each with the spaces before it; the text gets one space in front, as the model expects."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, LITERAL)
    if text[0] != " " and "  " not in text:
        words = (SPACE + text.replace(" ", BREAK + SPACE)).split(BREAK)
    else:
        words = _WORD.findall(SPACE + text.replace(" ", SPACE))
    if max(map(len, words)) > WORD_CHARS:
        words = [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


def sample(texts: list[str | None], keys: np.ndarray, v: Vocabulary, alpha: float = 1.0, lat: Lattices | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in order, and the offsets of the texts in them; ``lat`` holds lattices from one call to the next."""
    lat = lat or Lattices(v, alpha)
    ids: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    held: list[str] = []
    stretches: list[tuple[int, int, int]] = []  # row, characters of the row before, words

    def flush():
        nonlocal held, stretches
        if held:
            row, offset, count = np.array(stretches, np.int64).T
            got, n = _part(held, keys[row], offset, count, lat)
            ids.append(got)
            np.add.at(counts, row, n)
        held, stretches = [], []

    for r, text in enumerate(texts):
        words, before = split_words(text or ""), 0
        for i in range(0, len(words), PART_WORDS):
            some = words[i : i + PART_WORDS] if len(words) > PART_WORDS else words
            stretches.append((r, before, len(some)))
            held += some
            if len(some) < len(words):
                before += sum(map(len, some))
            if len(held) >= PART_WORDS:
                flush()
    flush()
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(counts)])


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    """The text of piece ids; pieces that spell bytes are joined first. The first space, put in front by encoding, goes."""
    byte = _bytes_by_id(v)
    raw = b"".join([byte[i] for i in ids])
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _bytes_by_id(v: Vocabulary) -> list[bytes]:
    out = [p.replace(SPACE, " ").encode("utf-8") for p in v.pieces]
    for b, i in enumerate(v.byte_ids):
        out[i] = bytes([b])
    return out


def row_key(*columns: Column | str, seed: int = 0) -> Column:
    """The 64-bit key of a row's draws."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in columns], F.lit(seed))


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", out: str = "piece_ids", alpha: float = 1.0, seed: int = 0, check: str | None = None) -> DataFrame:
    """Add ``out``, a sampled segmentation of ``text`` as piece ids; with ``check`` also whether decoding gives the text back.

    Rows with equal keys and texts get equal segmentations, whatever the
    partitioning. A null text gives null, an empty one no pieces. A null key
    is a key like any other. Columns named ``out`` or ``check`` are replaced,
    others pass through.
    """
    plain = df.drop(*[c for c in (out, check) if c])
    fields = [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(check, T.BooleanType())] if check else [])
    keyed = plain.withColumn("__key", row_key(f"`{key}`", seed=seed))
    at_text, names = plain.columns.index(text), plain.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = read_vocabulary(model)
        byte, lat = pa.array(_bytes_by_id(v), pa.large_binary()), Lattices(v, alpha)
        for batch in parts(batches, at_text, 1 << 20):
            texts = batch.column(at_text).to_pylist()
            keys = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids, offsets = sample(texts, keys, v, alpha, lat)
            null = np.array([t is None for t in texts], dtype=bool)
            listed = pa.ListArray.from_arrays(pa.array(np.where(np.append(null, False), 0, offsets), pa.int32(), mask=np.append(null, False)), pa.array(ids, pa.int32()))
            columns = [*batch.columns[: len(names)], listed]
            if check:
                columns.append(pa.array(_comes_back(texts, ids, offsets, byte), pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[f.name for f in fields]])

    return keyed.mapInArrow(work, T.StructType([*plain.schema.fields, *fields]))


def _comes_back(texts: list[str | None], ids: np.ndarray, offsets: np.ndarray, byte: pa.LargeBinaryArray) -> list[bool | None]:
    spelled = byte.take(pa.array(ids))
    raw = spelled.buffers()[2].to_pybytes() if len(ids) else b""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(spelled).to_numpy())])[offsets].tolist()
    return [None if t is None else (raw[a + 1 : b] if b > a else b"") == t.encode("utf-8") for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]


def decode(df: DataFrame, model: str, ids: str = "piece_ids", out: str = "text") -> DataFrame:
    """Add ``out``, the text of ``ids``: null for null, empty for none. A column named ``out`` is replaced."""
    plain = df.drop(out) if ids != out else df
    names = plain.columns
    schema = T.StructType([*plain.schema.fields, T.StructField(out, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = read_vocabulary(model)
        for batch in batches:
            texts = [None if x is None else decode_ids(x, v) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, out])

    return plain.mapInArrow(work, schema)

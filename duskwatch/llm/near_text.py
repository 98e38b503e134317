"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

A document's shingles are embedded into :data:`COORDINATES` minwise tokens. A
tree branches at its root, and wherever a node is still large, on the tokens
of two chosen coordinates; small nodes are compared exhaustively; independent
trees repeat this. A pair at a threshold of 80 (85) meets in one root node of
eight with probability ``1 - 0.2 ** 8`` (``1 - 0.15 ** 8``). Every link is confirmed on the full sets.

Exact copies are one class before anything is compared. Nodes hand on only the
links that join different components, so a group of many copies costs as many
links as it has members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage
from . import words as W
from .components import components
from .groups import pairs, whole_groups

SHINGLE = 5
#: Linked are sets with ``100 * intersection >= threshold * union``: by default, and where a corpus is deduplicated.
THRESHOLD, CORPUS_THRESHOLD = 85, 80
#: Root coordinates (four trees with two branches each) keep 32 bits of their tokens, the others 16.
ROOTS, COORDINATES = 8, 64
#: Members of a node that is compared exhaustively, and the levels of branching below a root.
LEAF, DEPTH = 1000, 3
_SKETCH_BYTES = 4 * ROOTS + 2 * (COORDINATES - ROOTS)

_random = np.random.default_rng(20_180)
_MULTIPLY = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def least_equal(threshold: int) -> int:
    """Equal coordinates from which a pair is compared on its sets: at the threshold at most about one pair in a hundred thousand has fewer."""
    p, fewer = threshold / 100, 0.0
    for m in range(COORDINATES + 1):
        fewer += math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if fewer > 1e-5:
            return m
    return COORDINATES


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer words, the hash of all of them."""
    w = W.words(column)
    row, _, shingle = W.windows(w, size)
    at = np.searchsorted(row, np.arange(len(w.first)))
    return [np.unique(shingle[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def minwise(sets: list[np.ndarray], block: int = 1 << 15) -> np.ndarray:
    """The minwise tokens of non-empty sets, one row each."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= block):
            n += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        for c in range(COORDINATES):
            out[at:to, c] = np.minimum.reduceat((x * _MULTIPLY[c] + _ADD[c]) >> np.uint64(32), starts)
        at = to
    return out


def sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    """``k``, ``n`` (distinct shingles), ``copy`` (checksum of the set), ``roots`` and ``sketch``; the last three null without words."""
    fed = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches, 1):
            sets = shingle_sets(batch.column(1))
            some = np.array([len(s) > 0 for s in sets], dtype=bool)
            tokens = minwise([s for s in sets if len(s)])
            raw = np.concatenate([tokens[:, :ROOTS].copy().view(np.uint8), tokens[:, ROOTS:].astype(np.uint16).view(np.uint8)], axis=1) if len(tokens) else np.zeros((0, _SKETCH_BYTES), np.uint8)
            number = np.cumsum(some) - 1
            copies = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            roots = [tokens[number[i], :ROOTS].astype(np.int64).tolist() if some[i] else None for i in range(len(sets))]
            lines = [raw[number[i]].tobytes() if some[i] else None for i in range(len(sets))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(copies, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(lines, pa.binary())],
                names=["k", "n", "copy", "roots", "sketch"],
            )

    return fed.mapInArrow(work, "k long, n long, copy binary, roots array<long>, sketch binary")


def _with_sizes(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two members or more, with the number ``size``."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    return rows.join(sizes, "node")


def leaves(members: DataFrame, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Members of nodes of at most about ``leaf`` rows: ``node``, ``k``, ``n``, ``sketch``, ``root`` and ``direct``.

    ``direct`` has a bit for every root coordinate whose node is a leaf. A pair
    that meets in several is compared in the first of them only; ``root`` is
    the coordinate, or 64 below a branched root.
    """
    rooted = members.select("k", F.posexplode("roots").alias("root", "token"))
    rooted = _with_sizes(rooted.select("k", "root", (F.shiftleft(F.col("root").cast("long"), 32) + F.col("token")).alias("node")))
    bit = F.when(F.col("size") <= leaf, F.expr("shiftleft(1, root)")).otherwise(0)
    of = rooted.groupBy("k").agg(F.bit_or(bit).alias("direct"), F.collect_list(F.struct("node", "root", "size")).alias("nodes"))
    wide = members.select("k", "n", "sketch").join(of, "k").select("k", "n", "sketch", "direct", F.explode("nodes").alias("x"))
    wide = stage(wide.select("x.node", "k", "n", "sketch", "direct", F.col("x.root").alias("root"), "x.size"), "nodes")
    columns = ["node", "k", "n", "sketch", "root", "direct"]
    out = wide.filter(F.col("size") <= leaf).select(*columns)
    large = wide.filter(F.col("size") > leaf).withColumn("root", F.lit(64))
    for level in range(depth):
        if large.isEmpty():
            return out
        branches = []
        for b in range(2):
            j = F.pmod(F.xxhash64("node", F.lit(level), F.lit(b)), F.lit(COORDINATES - ROOTS)).cast("int")
            token = F.substring(F.col("sketch"), F.lit(1 + 4 * ROOTS) + 2 * j, F.lit(2))
            branches.append(large.select(F.xxhash64("node", F.lit(b), j, token).alias("node"), *columns[1:]))
        grown = stage(_with_sizes(branches[0].unionByName(branches[1])), "nodes")
        out = out.unionByName(grown.filter(F.col("size") <= leaf).select(*columns))
        large = grown.filter(F.col("size") > leaf)
    return out.unionByName(tiles(large, leaf).select(*columns))


def tiles(large: DataFrame, leaf: int) -> DataFrame:
    """Nodes that stay large, as pairs of blocks: every two members meet in one tile, and no tile holds more than about ``leaf``."""
    n_blocks = F.ceil(F.col("size") / (leaf // 2)).cast("int")
    mine = F.pmod(F.xxhash64("k"), n_blocks).cast("int")
    met = large.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    return met.withColumn("node", F.xxhash64("node", F.least("_mine", "_other"), F.greatest("_mine", "_other")))


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, _SKETCH_BYTES)
    heads, rest = raw[:, : 4 * ROOTS].copy().view(np.uint32), raw[:, 4 * ROOTS :].copy().view(np.uint16)
    return heads, rest, table.column("n").to_numpy(), table.column("k").to_numpy(), table.column("root").to_numpy(), table.column("direct").to_numpy()


def candidates(table: pa.Table, offsets: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the pairs that are this node's to compare, and their equal coordinates."""
    heads, rest, n, k, root, direct = _columns(table)
    left, right, equal = [], [], []
    least = least_equal(threshold)
    for a, b in pairs(offsets):
        near = (100 * np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])) & (k[a] != k[b])
        a, b = a[near], b[near]
        same = heads[a] == heads[b]
        bits = (same * (1 << np.arange(ROOTS))).sum(axis=1) & direct[a]
        first = np.where(bits > 0, np.log2(np.maximum(bits & -bits, 1)), 64).astype(np.int64)
        mine = first == root[a]
        a, b = a[mine], b[mine]
        count = same[mine].sum(axis=1) + (rest[a] == rest[b]).sum(axis=1)
        close = count >= least
        left.append(a[close])
        right.append(b[close])
        equal.append(count[close])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right), np.concatenate(equal)) if left else (none, none, none)


def _suspects(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for table, offsets in whole_groups(batches):
        a, b, _ = candidates(table, offsets, threshold)
        if len(a):
            yield from table.take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()


def _confirmed(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links that join two parts of a node, the likeliest pairs first; pairs already connected within the node need no look."""
    for table, offsets in whole_groups(batches):
        a, b, equal = candidates(table, offsets, threshold)
        order = np.argsort(-equal, kind="stable")
        keys, raw = table.column("k").to_numpy(), table.column("shingles")
        sets: dict[int, np.ndarray] = {}
        parent = list(range(table.num_rows))

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def shingles(i):
            if i not in sets:
                sets[i] = np.frombuffer(raw[i].as_py(), np.uint64)
            return sets[i]

        found = []
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            x, y = top(i), top(j)
            if x != y and similar(shingles(i), shingles(j), threshold):
                parent[max(x, y)] = min(x, y)
                found.append((i, j))
        if found:
            i, j = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(keys[j])], names=["a", "b"])


def similar(x: np.ndarray, y: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sorted sets are linked."""
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= threshold * (len(both) - common)


def links(df: DataFrame, members: DataFrame, key: str, text: str, leaf: int = LEAF, depth: int = DEPTH, threshold: int = THRESHOLD) -> DataFrame:
    """Confirmed links ``(a, b)`` of class representatives ``members``, enough to connect whatever is linked."""
    nodes = leaves(members, leaf, depth)
    sorted_ = nodes.repartition("node").sortWithinPartitions("node")
    suspects = stage(sorted_.mapInArrow(lambda batches: _suspects(batches, threshold), sorted_.schema), "suspects")
    needed = suspects.select(F.col("k").alias("__needed")).distinct()
    fed = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    fed = fed.join(broadcast_if_small(needed, 300_000), F.col("k") == F.col("__needed"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches, 1):
            raw = [s.tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["k", "shingles"])

    full = suspects.join(fed.mapInArrow(sets, "k long, shingles binary"), "k").select("node", "k", "n", "sketch", "root", "direct", "shingles")
    return full.repartition("node").sortWithinPartitions("node").mapInArrow(lambda batches: _confirmed(batches, threshold), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", leaf: int = LEAF, depth: int = DEPTH, threshold: int = THRESHOLD) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (the smallest key reachable by links) and ``kept`` for every row.

    Words are lower-cased in ``A-Z`` and split at space and 0x09-0x0D. A text
    with fewer words than a shingle has one shingle of all of them; a text that
    is null or has no words has none, and is alone. Rows of one key are one
    document. A row without key has no component and is kept. Nothing is
    capped: nodes that stay large are compared in tiles.
    """
    sk = stage(sketches(df, key, text), "sketches")
    real = sk.filter(F.col("k").isNotNull() & F.col("copy").isNotNull())
    classes = real.groupBy("copy").agg(F.min("k").alias("class"))
    classes = stage(classes, "classes")
    members = sk.join(classes, (sk["copy"] == classes["copy"]) & (sk["k"] == classes["class"])).select(sk["k"], "n", "roots", "sketch")
    members = members.dropDuplicates(["k", "sketch"])
    found = components(links(df, members, key, text, leaf, depth, threshold)).select(F.col("id").alias("class"), "component")
    slim = sk.select("k", "n", "copy").join(classes, "copy", "left").join(found, "class", "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce("component", "class", "k"))
    return slim.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = CORPUS_THRESHOLD) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest key; all columns as they were."""
    dropped = near_duplicates(df, key, text, threshold=threshold).filter(~F.col("kept")).select(F.col(key).alias("__dropped"))
    dropped = broadcast_if_small(stage(dropped, "dropped"), 300_000)
    return df.join(dropped, F.col(f"`{key}`").cast("long") == F.col("__dropped"), "left_anti")

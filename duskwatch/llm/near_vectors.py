"""Near-duplicate vectors by tiled comparison in PCA order.

Vectors are rotated into their principal axes, so that leading coordinates hold
most of the variance, and ordered by the first. Tiles of consecutive vectors
meet if their ranges in it are near enough. A pair of tiles is compared
coordinate block by coordinate block: what the remaining coordinates can add is
at most the product of the suffix norms, and pairs whose bound can't reach the
threshold are given up.

Equal vectors are one class before anything is compared. A pair of tiles hands
on sums of links per vector and as many links as connect it, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_positions
from ..session import stage
from .components import components
from .groups import whole_groups

#: Fixed value: the cosine from which vectors are linked.
THRESHOLD = 0.95
#: Vectors of a tile, rows of it compared at a time, and coordinates of a block of the accumulation.
TILE, ROWS, BLOCK = 4096, 1024, 16
#: Room for rounding in bounds; the decision itself is made in double precision.
SLACK = 1e-5


def usable(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Positions and values of the vectors that have a direction: not null or zero, no null or non-finite component."""
    at, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.asarray(v)
            if np.isfinite(x).all() and x.any():
                at.append(i)
                out.append(x)
    return at, out


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1 in double precision, of the bytes of vectors of one dimension."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(df: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """``k``, dimensions ``d``, bytes ``v`` and their checksum ``copy`` of the usable vectors with a key."""
    fed = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{vector}`").alias("v")).filter(F.col("k").isNotNull())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = usable(batch.column(1))
            raw = [(v.astype(kind) + 0).tobytes() for v in values]  # -0 and 0 are equal
            copies = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([len(v) for v in values], pa.int32()), pa.array(raw, pa.binary()), pa.array(copies, pa.binary())], names=["k", "d", "v", "copy"]
            )

    return fed.mapInArrow(work, "k long, d int, v binary, copy binary")


def principal_axes(vectors: DataFrame, d: int, kind: str) -> np.ndarray:
    """The principal axes of all unit vectors as columns, the widest first, from sums over all rows: ``d`` rows per task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((d, d + 2)), 0
        for batch in batches:
            if batch.num_rows:
                x = units(batch.column(0).to_pylist(), kind)
                sums[:, :d] += x.T @ x
                sums[:, d] += x.sum(axis=0)
                n += len(x)
        sums[:, d + 1] = n
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["i", "x"])

    parts = vectors.select("v").mapInArrow(work, "i int, x array<double>").select("i", F.posexplode("x").alias("j", "x"))
    found = np.zeros((d, d + 2))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():  # d * (d + 2) rows
        found[r["i"], r["j"]] = r["x"]
    n = max(found[0, d + 1], 1)
    mean = found[:, d] / n
    values, axes = np.linalg.eigh(found[:, :d] / n - np.outer(mean, mean))
    return axes[:, np.argsort(-values)]


def _leading(vectors: DataFrame, axes: np.ndarray, kind: str) -> DataFrame:
    first = axes[:, :1].copy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = (units(batch.column(1).to_pylist(), kind) @ first)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], names=["k", "v", "copies", "x"])

    return vectors.select("k", "v", "copies").mapInArrow(work, "k long, v binary, copies long, x double")


def meetings(placed: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles ``(i, j)``, ``i <= j``, that may hold a link.

    Linked unit vectors are at most ``sqrt(2 - 2 * threshold)`` apart in a
    coordinate, and tiles are consecutive in the first, so the partners of a
    tile are consecutive too: two rows per tile go through the window.
    """
    reach = float(np.sqrt(2 - 2 * threshold) + SLACK)
    ends = placed.groupBy("tile").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    marks = ends.select("tile", F.col("low").alias("at"), F.lit(0).alias("asks")).unionByName(ends.select("tile", (F.col("high") + reach).alias("at"), F.lit(1).alias("asks")))
    seen = F.max(F.when(F.col("asks") == 0, F.col("tile"))).over(Window.orderBy("at", "asks", "tile").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marks.withColumn("last", seen).filter("asks = 1").select(F.col("tile").alias("i"), F.explode(F.sequence("tile", "last")).alias("j"))


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows at or over ``threshold``; the rows are rotated unit vectors.

    The first block of coordinates is one matrix product in single precision.
    The pairs that the bound leaves are carried on block by block, and what is
    left at the end is decided by the product over all coordinates in double.
    """
    d = a.shape[1]
    cuts = [*range(BLOCK, d, BLOCK), d]
    rest = {at: (np.sqrt((a[:, at:] ** 2).sum(axis=1)), np.sqrt((b[:, at:] ** 2).sum(axis=1))) for at in cuts}
    lead = cuts[0]
    part = np.hstack([a[:, :lead], rest[lead][0][:, None]]).astype(np.float32) @ np.hstack([b[:, :lead], rest[lead][1][:, None]]).astype(np.float32).T
    left, right = np.nonzero(part >= threshold - SLACK)
    out = []
    for at in range(0, len(left), 1 << 17):
        i, j = left[at : at + (1 << 17)], right[at : at + (1 << 17)]
        dot = np.einsum("ij,ij->i", a[i, :lead], b[j, :lead])
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            dot = dot + np.einsum("ij,ij->i", a[i, low:high], b[j, low:high])
            alive = dot + rest[high][0][i] * rest[high][1][j] >= threshold - SLACK
            i, j, dot = i[alive], j[alive], dot[alive]
        sure = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
        out.append((i[sure], j[sure]))
    none = np.zeros(0, np.int64)
    return (np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])) if out else (none, none)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` positions is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(axes: np.ndarray, kind: str, threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, offsets in whole_groups(batches):
            for low, high in zip(offsets[:-1], offsets[1:], strict=True):
                group = table.slice(low, high - low)
                x = units(group.column("v").to_pylist(), kind) @ axes
                k, copies, tile = (group.column(c).to_numpy() for c in ("k", "copies", "tile"))
                first, second = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
                links = np.zeros(len(k), np.int64)
                edges = []
                for at in range(0, len(first), ROWS):
                    mine = first[at : at + ROWS]
                    i, j = close_pairs(x[mine], x[second], threshold)
                    i, j = mine[i], second[j]
                    if tile.min() == tile.max():
                        i, j = i[i < j], j[i < j]
                    other = k[i] != k[j]
                    i, j = i[other], j[other]
                    links += np.bincount(i, weights=copies[j], minlength=len(k)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(k)).astype(np.int64)
                    top = roots(len(k), i, j)
                    hung = np.flatnonzero(top != np.arange(len(k)))
                    edges.append((hung, top[hung]))
                some = np.flatnonzero(links)
                a, b = (np.concatenate([e[s] for e in edges]) if edges else np.zeros(0, np.int64) for s in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([k[some], k[a]])), pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])), pa.array([None] * len(some) + k[b].tolist(), pa.int64())],
                    names=["k", "n", "b"],
                )

    return work


def _links(classes: DataFrame, d: int, kind: str, threshold: float, tile: int) -> DataFrame:
    """``k``, ``n`` and ``b``: parts of the sum of links of a vector, and links ``(k, b)`` that connect."""
    axes = principal_axes(classes, d, kind)
    placed = with_positions(_leading(classes, axes, kind), "x", "k").withColumn("tile", F.floor(F.col("pos") / tile).cast("int"))
    met = meetings(placed, threshold).withColumn("pair", F.shiftleft(F.col("i").cast("long"), 32) + F.col("j"))
    sides = met.select("pair", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    # Rows of one pair of tiles are two tiles at most, whatever the data.
    grouped = placed.join(sides, "tile").select("pair", "k", "v", "copies", "tile").repartition("pair").sortWithinPartitions("pair")
    return grouped.mapInArrow(_compare(axes, kind, threshold), "k long, n long, b long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``key``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest key reachable) and ``kept`` of every row.

    A vector that is null, empty or zero, or holds null or non-finite
    components, links with nothing, and vectors of different dimensions don't
    link. Keys are expected to be distinct; rows of one key don't link with each
    other. A row without key has no component and is kept.
    """
    kind = "<f4" if dict(df.dtypes)[vector] == "array<float>" else "<f8"
    rows = stage(_rows(df, key, vector, kind), "vectors")
    counted = rows.groupBy("copy").agg(F.min("k").alias("class"), F.count("*").alias("copies"))
    of = stage(counted, "vector-classes")
    members = rows.join(of, (rows["copy"] == of["copy"]) & (rows["k"] == of["class"])).select("k", "d", "v", "copies").dropDuplicates(["k", "v"])
    members = stage(members, "vector-members")
    parts = [_links(members.filter(F.col("d") == r["d"]), r["d"], kind, threshold, tile) for r in members.select("d").distinct().collect()]
    if not parts:
        return df.select(F.col(f"`{key}`").alias(key), F.lit(0).cast("long").alias("n_links"), F.col(f"`{key}`").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(reduce(DataFrame.unionByName, parts), "vector-links")
    sums = found.groupBy("k").agg(F.sum("n").alias("n")).withColumnRenamed("k", "class")
    reached = components(found.filter(F.col("b").isNotNull()).select(F.col("k").alias("a"), "b")).select(F.col("id").alias("class"), "component")
    slim = rows.select("k", "copy").join(of, "copy").join(sums, "class", "left").join(reached, "class", "left")
    slim = slim.select(F.col("k").alias("__k"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("c"))
    whole = df.select(F.col(f"`{key}`").alias(key)).join(slim, F.col(f"`{key}`").cast("long") == F.col("__k"), "left")
    own = F.col(f"`{key}`").cast("long")
    component = F.coalesce("c", own)
    return whole.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(own == component, F.lit(True)).alias("kept"))

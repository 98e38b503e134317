"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id in ``links`` ``(a, b)``; self-links count.

    A large star hangs the larger neighbours of every node on its smallest
    neighbour, a small star the smaller ones and itself. Each round is two
    groupings with map-side combine and two joins whose hot side can be split;
    the edges are written after each round, so no lineage grows and no round
    depends on cached blocks. Rounds are logarithmic in the longest path.
    """
    low, high = F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")
    edges = stage(links.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(low, high).distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        tops = large.groupBy("v").agg(F.min("u").alias("m"))
        hung = large.join(tops, "v")
        small = hung.filter(F.col("u") != F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(hung.select(F.col("m").alias("u"), "v"))
        following = stage(small.unionByName(edges.filter(F.col("u") == F.col("v"))).distinct(), "links")
        before, mark, edges = mark, _mark(following), following
        if mark == before:
            break
    stars = edges.groupBy("v").agg(F.min("u").alias("u"))
    return stars.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(stars.select(F.col("u").alias("id"), F.col("u").alias("component"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and two sums over them: equal for equal sets."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit((1 << 31) - 1))), F.sum(F.shiftrightunsigned(h, 33))).first()
    return tuple(row)

"""Last known values in an order of rows, with no task that holds a key.

Rows are range-partitioned and sorted, so slices are equal whatever keys are
frequent, and written once. A slice finds its own last values in a running
window that keeps one row; what is known before a slice comes from a table with
one row per slice.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def with_last_known(rows: DataFrame, order: Sequence[Column | str], values: Mapping[str, Column]) -> DataFrame:
    """Add, under each name of ``values``, its last value that isn't null among the rows up to each one.

    Rows that are equal in ``order`` may see each other's values or not.
    """
    points = {n: f"_point_{n}" for n in values}
    marked = rows.select("*", *[v.alias(points[n]) for n, v in values.items()])
    placed = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = stage(placed.select("*", F.spark_partition_id().alias("_slice"), row.alias("_row")), "last-known")

    # The number of shuffle partitions bounds these tables, and the window over them.
    tops = written.groupBy("_slice").agg(*[F.max(F.when(F.col(p).isNotNull(), F.col("_row"))).alias(f"_top_{n}") for n, p in points.items()])
    is_top = {n: F.col("_row") == F.col(f"_top_{n}") for n in values}
    tails = (
        written.join(F.broadcast(tops), "_slice").where(functools.reduce(operator.or_, is_top.values()))
        .groupBy("_slice").agg(*[F.max_by(points[n], F.when(is_top[n], 1)).alias(f"_tail_{n}") for n in values])
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("_slice").join(tails, "_slice", "left").select(
        "_slice", *[F.last(f"_tail_{n}", ignorenulls=True).over(before).alias(f"_carried_{n}") for n in values]
    )
    here = Window.partitionBy("_slice").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = written.select("*", *[F.last(p, ignorenulls=True).over(here).alias(f"_near_{n}") for n, p in points.items()])
    return near.join(F.broadcast(carried), "_slice").select(
        *rows.columns, *[F.coalesce(f"_near_{n}", f"_carried_{n}").alias(n) for n in values]
    )


def as_of(queries: DataFrame, points: DataFrame, at: str, take: Mapping[str, str], group: Sequence[str] = ()) -> DataFrame:
    """Every row of ``queries`` with columns of the last point of its group whose ``at`` is not after its own.

    ``take`` names the columns of ``points`` that are taken, and what they are
    called in the result; they are null where no such point is. Of points with
    one ``at`` the greatest in the order of ``take`` counts. A row without ``at``
    or without one of the group's columns finds nothing, and no point is found
    without them. Neither side is multiplied, and a hot group is spread like
    other rows.
    """
    keys, found = [*group, at], [f"_take_{i}" for i in range(len(take))]
    whole = functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys])
    asked = queries.select(*keys, F.lit(1).alias("_kind"), F.struct(*queries.columns).alias("_query"))
    known = points.where(whole).select(*keys, F.lit(0).alias("_kind"), *[F.col(c).alias(f) for c, f in zip(take, found)])
    both = asked.unionByName(known, allowMissingColumns=True)
    # Queries are told apart by a hash, so that many with one place can lie in several slices.
    spread = F.when(F.col("_kind") == 1, F.xxhash64(*[F.col(f"_query.{c}") for c, t in queries.dtypes if "map<" not in t]))
    point = F.when(F.col("_kind") == 0, F.struct(*group, *found))
    seen = with_last_known(both, [*keys, "_kind", *found, spread], {"_seen": point}).where("_kind = 1")
    same = functools.reduce(operator.and_, [F.col(g) == F.col(f"_seen.{g}") for g in group], whole)
    return seen.select("_query.*", *[F.when(same, F.col(f"_seen.{f}")).alias(name) for f, name in zip(found, take.values())])

"""Global row positions without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def with_positions(df: DataFrame, *order: Column | str, pos: str = "pos") -> DataFrame:
    """Add the dense position of each row in the given order; the order has to be total.

    Rows are range-partitioned and sorted, which gives equal slices whatever
    values are frequent, and written once with their number in the slice, so
    that a retried task cannot change a number. Positions then only need the
    sizes of the slices.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = stage(placed.select("*", F.spark_partition_id().alias("_slice"), row.alias("_row")), "ordered")
    # One row per slice: the number of shuffle partitions bounds this table, and the window over it.
    sizes = written.groupBy("_slice").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_slice", F.coalesce(before, F.lit(0)).alias("_base"))
    return written.join(F.broadcast(offsets), "_slice").select(*df.columns, (F.col("_base") + F.col("_row")).alias(pos))

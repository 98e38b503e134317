"""The k-th largest row of a table of any size, found by counting digits: nothing is sorted, no row leaves its partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 12


def cut(df: DataFrame, k: int, *order: Column) -> Column | None:
    """A condition that holds for the ``k`` largest rows by the 64-bit columns ``order``; rows equal in all of them stay together.

    Null when all rows are among them. Each round counts the rows that share
    the digits found so far by their next digit: at most 4096 counts.
    """
    if k <= 0:
        return F.lit(False)
    reached, above = F.lit(True), F.lit(False)
    rest = k
    for c in order:
        # Shifted to the unsigned order, so that digits compare as numbers do.
        value = c.bitwiseXOR(F.lit(-(1 << 63)))
        for shift in range(60, -1, -_BITS):
            digit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << _BITS) - 1))
            counts = sorted(((r["d"], r["n"]) for r in df.filter(reached).groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
            for d, n in counts:
                if rest <= n:
                    above, reached = above | (reached & (digit > d)), reached & (digit == d)
                    break
                rest -= n
            else:
                return None
            if rest == n:
                return above | reached
    return above | reached

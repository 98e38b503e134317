"""Rows beside their texts: what a table carries goes through a worker as one struct, whatever its columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W


def with_result(df: DataFrame, text: str, out: str, kind: T.DataType, work: Callable[[pa.Array], pa.Array], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all if not given) and ``out``, what ``work`` makes of a part of the texts; a column named ``out`` is replaced.

    Parts hold a few megabytes of text, or one row.
    """
    names = [c for c in (df.columns if keep is None else keep) if c != out]
    fed = df.select(F.col(f"`{text}`").cast("string").alias("t"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c != text]).alias("row"))
    whole = text in names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.parts(batches, 0):
            given = [batch.column(0)] if whole else []
            yield pa.RecordBatch.from_arrays([*given, batch.column(1), work(batch.column(0))], names=[*(["t"] if whole else []), "row", "out"])

    fields = [*([T.StructField("t", T.StringType())] if whole else []), fed.schema["row"], T.StructField("out", kind)]
    done = fed.mapInArrow(apply, T.StructType(fields))
    return done.select(*[F.col("t").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names], F.col("out").alias(out))

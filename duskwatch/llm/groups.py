"""Rows of bounded groups side by side: iteration over a sorted partition without a Python call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the offsets of the groups in them; the input is sorted by column ``key``."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = table.column(key).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        held = table.slice(starts[-1])
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts
    if held is not None:
        yield held, np.array([0, held.num_rows])


def pairs(offsets: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within each group, in parts of about ``most`` pairs (one row's pairs at least)."""
    n = int(offsets[-1])
    end = np.repeat(offsets[1:], np.diff(offsets))
    later = end - np.arange(n) - 1
    upto = np.concatenate([[0], np.cumsum(later)])
    row = 0
    while row < n:
        to = max(int(np.searchsorted(upto, upto[row] + most, side="right")) - 1, row + 1)
        left = np.repeat(np.arange(row, to), later[row:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(upto[row:to] - upto[row], later[row:to])
        if len(left):
            yield left, right
        row = to

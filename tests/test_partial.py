"""Partial matches row by row against a plain loop."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st
from test_sequence import loop, quantifier

from duskwatch.streaming.partial import Moves, PartialMatches


def fed(quantifiers, within, rows, sizes):
    """Matches as (first, last) row, the rows handed over in parts and the state stored between them."""
    moves, stored, out, at = Moves(quantifiers), None, [], 0
    for size in [*sizes, len(rows)]:
        partial = PartialMatches(moves, within, stored)
        part = rows[at : at + size]
        found = partial.feed([(t, m, (t, at + i, "u", None, None)) for i, (t, m) in enumerate(part)])
        at += len(part)
        mark = rows[at][0] if at < len(rows) else 10**9
        for n, last in found + partial.settle(mark):
            out.append((last[1] - n + 1, last[1]))
        stored = partial.stored()
    assert stored is None
    return out


@settings(max_examples=400, deadline=None)
@given(
    st.lists(quantifier, min_size=1, max_size=3), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 3)), max_size=40),
    st.integers(1, 12), st.lists(st.integers(0, 7), max_size=8),
)
def test_equals_loop(quantifiers, rows, within, sizes):
    times, t = [], 0
    for _, gap in rows:
        t += gap
        times.append(t)
    masks = [m for m, _ in rows]
    assert fed(quantifiers, within, list(zip(times, masks)), sizes) == loop(masks, times, quantifiers, within)


def test_cost_of_a_row_does_not_grow_with_rows_before_it():
    """Rows that open no match leave nothing; a run of decided matches keeps the state small."""
    moves, stored, kept = Moves([(2, 4), (1, 1)]), None, []
    for part in range(50):
        partial = PartialMatches(moves, 1000, stored)
        partial.feed([(part * 400 + i, (1, 1, 2, 0)[i % 4], (0, 0, None, None, None)) for i in range(400)])
        stored = partial.stored()
        kept.append(0 if stored is None else len(stored[3]))
    assert max(kept) <= 4


def test_many_open_starts_of_one_key():
    moves = Moves([(3, None), (1, 1)])
    rows = [(i, 1, (i, i, None, None, None)) for i in range(20_000)]
    begin = time.perf_counter()
    partial = PartialMatches(moves, 10**6, None)
    assert partial.feed(rows) == []
    again = PartialMatches(moves, 10**6, partial.stored())
    assert again.feed([(20_000, 2, (20_000, 20_000, "u", None, None)), (20_001, 0, (0,) * 5)]) == [(20_001, (20_000, 20_000, "u", None, None))]
    assert again.stored() is None
    assert time.perf_counter() - begin < 20

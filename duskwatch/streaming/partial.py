"""Partial matches of one ordered rule over rows that come one after another.

Every row that fits the first pattern opens a start. A start holds its possible
places in the rule as an ordered list of ``(step, rows taken)``, the preferred
one first: longer repeats of earlier steps come before shorter ones. A row moves
every place once. When a place completes the rule, the places behind it are
given up and those before it go on, as they would give a preferred match.

Starts with equal lists behave alike, so a move is looked up once per list. While
few starts are open they are moved one by one, many of them as one array operation.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np

Places = tuple[tuple[int, int], ...]

#: Open starts up to which each is moved by itself.
FEW = 48
_NEVER = -1


class Moves:
    """Moves between lists of places; a list is known by a number, 0 is the empty one."""

    def __init__(self, quantifiers: Sequence[tuple[int, int | None]]):
        self.quantifiers = list(quantifiers)
        self.lists: list[Places] = [()]
        self.number: dict[Places, int] = {(): 0}
        self.first = self.of(((0, 0),))
        self._to: dict[int, np.ndarray] = {}
        self._done: dict[int, np.ndarray] = {}
        self.steps: dict[int, dict[int, tuple[int, bool]]] = {}

    def of(self, places: Places) -> int:
        if places not in self.number:
            self.number[places] = len(self.lists)
            self.lists.append(places)
        return self.number[places]

    def move(self, places: Places, mask: int) -> tuple[Places, bool]:
        """The places after a row, and whether the row completes the rule."""
        out: dict[tuple[int, int], None] = {}
        for step, taken in places:
            if not mask >> step & 1:
                continue
            low, high = self.quantifiers[step]
            # Beyond its minimum an open-ended step is always in the same place.
            n = min(taken + 1, low) if high is None else taken + 1
            if high is None or n < high:
                out.setdefault((step, n))
            if n >= low:
                if step == len(self.quantifiers) - 1:
                    return tuple(out), True
                out.setdefault((step + 1, 0))
        return tuple(out), False

    def one(self, mask: int) -> dict[int, tuple[int, bool]]:
        """``move`` by the number of a list, for the lists known so far."""
        known = self.steps.setdefault(mask, {})
        for s in range(len(known), len(self.lists)):
            places, done = self.move(self.lists[s], mask)
            known[s] = self.of(places), done
        return known

    def all(self, state: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """``move`` for an array of lists."""
        to, done = self._to.get(mask), self._done.get(mask)
        if to is None or len(to) < len(self.lists):
            more = len(self.lists) * 2 - (0 if to is None else len(to))
            to = np.append(to if to is not None else np.zeros(0, np.int64), np.full(more, _NEVER))
            done = np.append(done if done is not None else np.zeros(0, bool), np.zeros(more, bool))
            self._to[mask], self._done[mask] = to, done
        new = to[state]
        if (new == _NEVER).any():
            for s in np.unique(state[new == _NEVER]).tolist():
                places, done[s] = self.move(self.lists[s], mask)
                to[s] = self.of(places)
            new = to[state]
        return new, done[state]


class PartialMatches:
    """Open starts of one rule and one key."""

    def __init__(self, moves: Moves, within: int, stored: Sequence[Any] | None = None):
        self.moves, self.within = moves, within
        self.seen, self.first, self.n = 0, 0, 0
        self.lasts: dict[int, tuple] = {}
        none = np.zeros(0, np.int64)
        self.state, self.start, self.pos, self.stop = none, none, none, none
        if stored is not None:
            seen, lists, state, start, pos, stop, lasts = stored
            numbers = np.array([moves.of(tuple(zip(flat[::2], flat[1::2]))) for flat in lists], dtype=np.int64)
            self.seen, self.n = seen, len(start)
            self.state = numbers[np.array(state, dtype=np.int64)] if self.n else none
            self.start, self.pos, self.stop = (np.array(a, dtype=np.int64) for a in (start, pos, stop))
            self.lasts = {r[0]: tuple(r)[1:] for r in lasts}

    def feed(self, rows: Sequence[tuple[int, int, tuple]]) -> list[tuple[int, tuple]]:
        """Take rows ``(micros, mask, last-row columns)`` in order; returns ``(rows matched, last row)`` of decided matches."""
        out: list[tuple[int, tuple]] = []
        rows = rows[self._feed_few(rows, out) :]
        if not rows:
            return out
        self._make_room(len(rows))
        for micros, mask, columns in rows:
            self._expire(micros)
            if mask & 1:
                self.state[self.n], self.start[self.n] = self.moves.first, micros
                self.pos[self.n], self.stop[self.n] = self.seen, _NEVER
                self.n += 1
            if self.n > self.first:
                live = slice(self.first, self.n)
                self.state[live], done = self.moves.all(self.state[live], mask)
                if done.any():
                    self.stop[live][done] = self.seen
                    self.lasts[self.seen] = columns
            self._decide(out)
            self.seen += 1
            if self.first == self.n:
                self.first = self.n = 0
        return out

    def _feed_few(self, rows: Sequence[tuple[int, int, tuple]], out: list[tuple[int, tuple]]) -> int:
        """``feed`` as long as few starts are open; returns how many rows were taken."""
        if self.n - self.first > FEW:
            return 0
        state, start, pos, stop = (a[self.first : self.n].tolist() for a in (self.state, self.start, self.pos, self.stop))
        moves, first, within, seen = self.moves, self.moves.first, self.within, self.seen
        steps = moves.steps
        taken = 0
        for micros, mask, columns in rows:
            if len(state) > FEW:
                break
            taken += 1
            if mask & 1:
                state.append(first)
                start.append(micros)
                pos.append(seen)
                stop.append(_NEVER)
            if state:
                # A start whose time is over, this row's own not among them, can't be moved any more.
                over = bisect.bisect_right(start, micros - within) if start[0] <= micros - within else 0
                to = steps.get(mask) or moves.one(mask)
                for j, s in enumerate(state):
                    if j < over:
                        state[j] = 0
                    elif s:
                        if s not in to:
                            to = moves.one(mask)
                        state[j], done = to[s]
                        if done:
                            stop[j] = seen
                            self.lasts[seen] = columns
                head = 0
                while head < len(state) and state[head] == 0:
                    end = stop[head]
                    if end >= 0:
                        out.append((end - pos[head] + 1, self.lasts[end]))
                        head = bisect.bisect_right(pos, end, head)
                    else:
                        head += 1
                if head:
                    del state[:head], start[:head], pos[:head], stop[:head]
            seen += 1
        self.seen, self.first, self.n = seen, 0, len(state)
        self.state, self.start, self.pos, self.stop = (np.array(a, dtype=np.int64) for a in (state, start, pos, stop))
        return taken

    def settle(self, mark: int) -> list[tuple[int, tuple]]:
        """No row before ``mark`` will come any more: decide the starts whose time is over."""
        out: list[tuple[int, tuple]] = []
        self._expire(mark)
        self._decide(out)
        return out

    def due(self) -> int | None:
        """When the first open start is decided at the latest."""
        return int(self.start[self.first]) + self.within if self.n > self.first else None

    def stored(self) -> tuple | None:
        """The open starts for the state store, None without any. A start that can't match any more is left out."""
        live = slice(self.first, self.n)
        keep = (self.state[live] != 0) | (self.stop[live] >= 0)
        state, start, pos, stop = (a[live][keep] for a in (self.state, self.start, self.pos, self.stop))
        if not len(start):
            return None
        used, codes = np.unique(state, return_inverse=True)
        lists = [[x for place in self.moves.lists[s] for x in place] for s in used.tolist()]
        ends = sorted({p for p in stop.tolist() if p >= 0})
        return (self.seen, lists, codes.tolist(), start.tolist(), pos.tolist(), stop.tolist(), [(p, *self.lasts[p]) for p in ends])

    def _make_room(self, more: int) -> None:
        live = slice(self.first, self.n)
        self.state, self.start, self.pos, self.stop = (np.append(a[live], np.zeros(more, np.int64)) for a in (self.state, self.start, self.pos, self.stop))
        self.first, self.n = 0, self.n - live.start

    def _expire(self, micros: int) -> None:
        over = np.searchsorted(self.start[self.first : self.n], micros - self.within, side="right")
        self.state[self.first : self.first + over] = 0

    def _decide(self, out: list[tuple[int, tuple]]) -> None:
        """Starts in order: a decided match drops the starts inside it."""
        while self.first < self.n and self.state[self.first] == 0:
            stop = int(self.stop[self.first])
            if stop >= 0:
                out.append((stop - int(self.pos[self.first]) + 1, self.lasts[stop]))
                self.first += int(np.searchsorted(self.pos[self.first : self.n], stop, side="right"))
            else:
                self.first += 1


def moves_of(rule: Mapping[str, Any]) -> Moves:
    return Moves([(p["qmin"], p["qmax"]) for p in rule["patterns"]])

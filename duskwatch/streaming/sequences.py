"""Ordered rules over a stream: rows wait in keyed state until the watermark fixes their order."""

from __future__ import annotations

import functools
import json
import operator
import pickle
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fields import field
from ..functions.predicates import match
from ..session import LOCAL_TZ
from .partial import PartialMatches, moves_of

_MICROS = 1_000_000
#: So many waiting rows of a key are kept in one value at most.
HELD = 256
#: More are kept by stretches of this length times ``WIDER ** level``, from the widest level down. A stretch above the lowest
#: level that would get more than ``HELD`` rows is cut into those of the next level.
STRETCH = 60 * _MICROS
WIDER = 8
TOP = 6
#: Bits of the patterns of several rules that are handed over in one number.
WORD = 62
_FOUND = "rule_id string, user_id string, hostname string, user_ip string, cnt bigint, micros bigint, event_id bigint"
_Found = Row("rule_id", "user_id", "hostname", "user_ip", "cnt", "micros", "event_id")
_ORDER = operator.itemgetter(0, 1)

#: ``(micros, event_id, user_id, hostname, user_ip, words of pattern bits ...)``
Waiting = tuple


def _words(rules: Sequence[Mapping[str, Any]]) -> list[tuple[int, int]]:
    """The word in which each rule's pattern bits stand, and how far they are shifted in it."""
    out, word, used = [], 0, 0
    for n in (len(r["patterns"]) for r in rules):
        if used and used + n > WORD:
            word, used = word + 1, 0
        out.append((word, used))
        used += n
    return out


def _packed(rows: list[Waiting]) -> bytes:
    return pickle.dumps(rows, 5) if rows else b""


def _unpacked(held: bytes) -> list[Waiting]:
    return pickle.loads(held) if held else []


class SequenceProcessor(StatefulProcessor):
    """All ordered rules of one key list.

    A row waits until the watermark has passed it. Then it moves the partial
    matches of each rule once and leaves the state. A call to the state costs
    far more than a row in it, so a key has one value for its timer, its partial
    matches and a few waiting rows. Many waiting rows go to stretches of time, of
    which a timer reads those that have become settled, and of each level of
    stretches the one that the watermark is in, not all rows that wait.
    A match is put out when no preferred one is possible any more.
    """

    def __init__(self, rules: Sequence[Mapping[str, Any]]):
        self.rules = [
            (r["rule_id"], r["within_s"] * _MICROS, moves_of(r), 5 + word, shift, (1 << len(r["patterns"])) - 1)
            for r, (word, shift) in zip(rules, _words(rules), strict=True)
        ]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "level int, stretch bigint", "rows binary")
        # When the timer is due; whether rows wait in stretches; rows that wait here; what ``PartialMatches`` stores, by rule.
        self.held = handle.getValueState("held", "ms bigint, spread boolean, rows binary, open binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh = [tuple(r.values()) for r in json.loads(f"[{','.join([r[-1] for r in rows])}]")]
        if not fresh:
            return iter([])
        ms, spread, held, open_ = self.held.get() or (None, False, b"", b"")
        waiting = _unpacked(held) + fresh
        if len(waiting) > HELD:
            self._wait(waiting, TOP)
            waiting, spread = [], True
        # The first moment at which one of these rows is settled.
        ms = self._wake(min(r[0] for r in fresh), ms)
        self.held.update((ms, spread, _packed(waiting), open_))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        _, spread, held, open_ = self.held.get()
        waiting = _unpacked(held)
        settled, moments = self._settled(mark) if spread else ([], [])
        spread = bool(moments)
        settled += [r for r in waiting if r[0] < mark]
        settled.sort(key=_ORDER)
        waiting = [r for r in waiting if r[0] >= mark]
        moments += [r[0] for r in waiting]
        before = pickle.loads(open_) if open_ else {}
        after, out = {}, []
        for i, (rule_id, within, moves, word, shift, bits) in enumerate(self.rules):
            stored = before.get(i)
            fed = [(r[0], r[word] >> shift & bits, r) for r in settled]
            if stored is None and not any(mask & 1 for _, mask, _ in fed):
                continue
            partial = PartialMatches(moves, within, stored)
            for cnt, (micros, event_id, user, host, ip, *_) in partial.feed(fed) + partial.settle(mark):
                out.append(_Found(rule_id, user, host, ip, cnt, micros, event_id))
            kept = partial.stored()
            if kept is not None:
                after[i] = kept
                moments.append(partial.due())
        if moments:
            ms = self._wake(max(min(moments), mark), None)
            self.held.update((ms, spread, _packed(waiting), pickle.dumps(after, 5) if after else b""))
        else:
            self.held.clear()
        return iter(out)

    def close(self) -> None:
        pass

    def _wait(self, rows: Sequence[Waiting], level: int) -> None:
        """Put rows into the stretches of a level; stretches that get too many rows are cut into narrower ones."""
        width = STRETCH * WIDER**level
        by_stretch: dict[int, list[Waiting]] = {}
        for r in rows:
            by_stretch.setdefault(r[0] // width, []).append(r)
        for stretch, more in by_stretch.items():
            if level and len(more) > HELD:
                self._wait(more, level - 1)
                continue
            held = self._rows(level, stretch)
            if level and len(held) + len(more) > HELD:
                self.waiting.removeKey((level, stretch))
                self._wait(held + more, level - 1)
            else:
                self.waiting.updateValue((level, stretch), (_packed(held + more),))

    def _rows(self, level: int, stretch: int) -> list[Waiting]:
        held = self.waiting.getValue((level, stretch))
        return [] if held is None else _unpacked(held[0])

    def _settled(self, mark: int) -> tuple[list[Waiting], list[int]]:
        """Rows of stretches before ``mark``, taken out of the state, and when the first row of each of the others is settled."""
        settled, moments = [], []
        # Rows of lower levels came first; the order of arrival decides between equal times and ids.
        for level, stretch in sorted(tuple(k) for k in self.waiting.keys()):
            begin = stretch * STRETCH * WIDER**level
            if begin >= mark:
                moments.append(begin)
                continue
            rows = self._rows(level, stretch)
            later = [r for r in rows if r[0] >= mark]
            settled += rows if not later else [r for r in rows if r[0] < mark]
            if not later:
                self.waiting.removeKey((level, stretch))
                continue
            if len(later) < len(rows):
                self.waiting.updateValue((level, stretch), (_packed(later),))
            moments.append(min(r[0] for r in later))
        return settled, moments

    def _wake(self, micros: int, held: int | None) -> int:
        """Keep one timer per key, the earliest; ``held`` is the one that is set."""
        ms = micros // 1000 + 1
        if held is not None and held <= ms:
            return held
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(ms)
        return ms


def _mask(rule: Mapping[str, Any], tz: str, shift: int) -> Column:
    bits = [F.when(match(p, tz), F.lit(1 << i + shift).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, p in enumerate(rule["patterns"])]
    return functools.reduce(operator.add, bits)


def _masks(rules: Sequence[Mapping[str, Any]], tz: str) -> list[Column]:
    """The patterns that a row fits, of as many rules in one number as it has bits for."""
    words: dict[int, list[Column]] = {}
    for rule, (word, shift) in zip(rules, _words(rules), strict=True):
        words.setdefault(word, []).append(_mask(rule, tz, shift))
    return [functools.reduce(operator.add, parts).alias(f"masks_{word}") for word, parts in words.items()]


def sequence_stream(events: DataFrame, rules: Sequence[Mapping[str, Any]], tz: str = LOCAL_TZ) -> DataFrame:
    """Matches of ordered rules with one key list from a watermarked stream, in one keyed operator.

    Needs the RocksDB state store provider. A key is one task of a micro-batch.
    Its state holds the rows that the watermark has not reached, and per rule the
    starts of the last ``within`` that are not decided.
    """
    # A null and an empty key are two keys, as in a batch.
    names = rules[0]["by"]
    keys = [F.coalesce(F.concat(F.lit("="), field(name, tz).cast("string")), F.lit("-")).alias(f"key_{i}") for i, name in enumerate(names)]
    waiting = [F.unix_micros("ts").alias("micros"), "event_id", "user_id", "hostname", "user_ip", *_masks(rules, tz)]
    # One text per row: columns are handed to Python cell by cell.
    rows = events.select(*keys, "ts", F.to_json(F.struct(*waiting), {"ignoreNullFields": "false"}).alias("waiting"))
    found = rows.groupBy(*[f"key_{i}" for i in range(len(keys))]).transformWithState(
        statefulProcessor=SequenceProcessor(rules), outputStructType=_FOUND, outputMode="append", timeMode="eventTime",
    )
    return found.select(
        "rule_id", "user_id", "hostname", "user_ip", "cnt", F.timestamp_micros("micros").alias("ts"),
        F.concat_ws("|", "event_id").alias("origin"),
    )

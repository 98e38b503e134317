"""The keyed state of ordered rules: what waits, how often the state is called, and how much of it a timer reads."""

import json
import random
from types import SimpleNamespace

import pytest
from test_sequence import loop

from duskwatch.streaming import sequences as Q

RULE = {"rule_id": "r", "within_s": 96 * 3600, "patterns": [{"qmin": 2, "qmax": 4}, {"qmin": 1, "qmax": 1}]}
OTHER = {"rule_id": "o", "within_s": 60, "patterns": [{"qmin": 1, "qmax": 1}] * 40}


class State:
    """One state variable of one key as a dict, with its calls and the bytes of its values counted."""

    def __init__(self, seen):
        self.kept, self.seen = {}, seen

    def getValue(self, k):
        self.seen["calls"] += 1
        self.seen["bytes"] += len(self.kept[k][0]) if k in self.kept else 0
        return self.kept.get(k)

    def updateValue(self, k, v):
        self.seen["calls"] += 1
        self.kept[k] = v

    def removeKey(self, k):
        self.seen["calls"] += 1
        self.kept.pop(k, None)

    def keys(self):
        self.seen["calls"] += 1
        return iter(list(self.kept))

    def get(self):
        self.seen["calls"] += 1
        return self.kept.get(())

    def update(self, v):
        self.seen["calls"] += 1
        self.kept[()] = v

    def clear(self):
        self.seen["calls"] += 1
        self.kept.pop((), None)


class Key:
    def __init__(self, *rules):
        self.seen, self.timers, self.out = {"calls": 0, "bytes": 0}, set(), []
        self.processor = Q.SequenceProcessor(rules)
        self.processor.init(SimpleNamespace(
            getMapState=lambda *_: State(self.seen), getValueState=lambda *_: State(self.seen),
            registerTimer=self.timers.add, deleteTimer=self.timers.remove,
        ))

    def rows(self, rows):
        """``(micros, event_id, words ...)``"""
        texts = [("=u", None, json.dumps({"m": m, "e": e, "u": "u", "h": None, "i": "ip"} | {str(k): w for k, w in enumerate(words)})) for m, e, *words in rows]
        assert list(self.processor.handleInputRows(("=u",), iter(texts), None)) == []

    def watermark(self, ms):
        """As Spark does: every timer that is due, and those that are set meanwhile for a moment that is over."""
        while due := [t for t in self.timers if t <= ms]:
            self.timers.remove(min(due))
            values = SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
            self.out += self.processor.handleExpiredTimer(("=u",), values, None)
            if min(self.timers, default=ms + 1) <= ms:
                break


def made(n, seconds, seed=1):
    """Rows in order, some of equal times."""
    rng = random.Random(seed)
    return [(t * Q._MICROS, i, rng.choice((1, 1, 1, 2))) for i, t in enumerate(sorted(rng.randrange(seconds) for _ in range(n)))]


def wanted(rows):
    found = loop([r[2] for r in rows], [r[0] for r in rows], [(2, 4), (1, 1)], RULE["within_s"] * Q._MICROS)
    return [(b - a + 1, rows[b][1]) for a, b in found]


@pytest.mark.parametrize("n, seconds, parts", [(60, 30 * 86400, 1), (5000, 30 * 86400, 1), (5000, 3600, 7), (3000, 30 * 86400, 40)])
def test_matches_whatever_waits_together(n, seconds, parts):
    rows = made(n, seconds)
    key, shuffled = Key(RULE), random.Random(2).sample(rows, n)
    for i in range(parts):
        key.rows(shuffled[i::parts])
    for ms in range(0, seconds * 1000 + 7_200_000, seconds * 1000 // 9):
        key.watermark(ms)
    key.watermark(seconds * 1000 + 10 * 86_400_000)
    assert [(r.cnt, r.event_id) for r in key.out] == wanted(rows) and key.out
    assert not key.timers and not key.processor.waiting.kept and not key.processor.held.kept


def test_state_is_not_called_per_row():
    rows = made(200, 30 * 86400)
    key = Key(RULE)
    key.rows(rows)
    key.watermark(50 * 86_400_000)
    assert [(r.cnt, r.event_id) for r in key.out] == wanted(rows)
    assert key.seen["calls"] < 10
    many = made(50_000, 30 * 86400)
    key = Key(RULE)
    key.rows(many)
    key.watermark(50 * 86_400_000)
    assert [(r.cnt, r.event_id) for r in key.out] == wanted(many)
    assert key.seen["calls"] < len(many) / 5


def test_a_timer_reads_settled_rows_and_few_others():
    """100,000 rows wait for days; each hour the watermark passes few of them."""
    rows = made(100_000, 100 * 86400)
    key = Key(RULE)
    key.rows(rows)
    size = len(Q._packed(rows))
    key.watermark(3_600_000)
    key.seen["bytes"] = 0
    for hour in range(2, 12):
        key.watermark(hour * 3_600_000)
    assert key.seen["bytes"] < size / 10


def test_pattern_bits_of_many_rules():
    """More patterns than a number has bits: each rule still finds its own bits."""
    assert Q._words([OTHER, RULE, OTHER]) == [(0, 0), (0, 40), (1, 0)]
    key, rows = Key(OTHER, RULE, OTHER), made(50, 86400)
    key.rows([(m, e, mask << 40, 0) for m, e, mask in rows])
    key.watermark(10 * 86_400_000)
    assert [(r.rule_id, r.cnt, r.event_id) for r in key.out] == [("r", *w) for w in wanted(rows)]

"""Ordered rules: strictly adjacent rows of a key, with repeats, within a time limit.

Semantics: per key in order of (ts, event_id); a match is a run of directly
following rows that satisfy the patterns in order (longest repeats first), its
last row less than ``within`` after its first; after a match the search goes on
behind its last row.

Plan. One key may hold a large part of all rows, so nothing is grouped by key.

1. All rows are range-partitioned and sorted by (key, ts, event_id): equal
   slices whatever the keys are. Slices are numbered and written once, which
   gives every row a dense position that no retry can change.
2. Rows that match no pattern are dropped; their positions leave gaps, which is
   all that adjacency needs.
3. Positions are cut into chunks. A chunk also receives the first rows of the
   next one (as many as a match can reach), so each start finds its match end
   inside one chunk. Where an open-ended rule reaches further than a chunk, ends
   are found by lookups in the order of positions instead (``_far_candidates``).
4. Which of the overlapping candidates survive depends on where the previous
   match ended. Each chunk reports, for every place at which a match from an
   earlier chunk may end, where its own last match ends; these maps are
   composed first within groups of chunks, then over the groups, and give each
   chunk its true entry. A match may be longer than a chunk, or than a group.
"""

from __future__ import annotations

import bisect
import functools
import operator
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.predicates import match
from ..session import LOCAL_TZ, stage
from .asof import as_of, with_last_known
from .ordering import with_positions

Rule = Mapping[str, Any]

#: Positions per chunk, and chunks whose maps are composed in one task.
CHUNK = 1 << 16
CHUNKS_PER_GROUP = 1 << 12
_MICROS = 1_000_000
#: Columns a match takes from its last row.
_LAST_ROW = ("user_id", "hostname", "user_ip", "ts", "event_id")


def is_exact(rule: Rule) -> bool:
    """Every pattern repeats a fixed number of times."""
    return all(p["qmax"] is not None and p["qmin"] == p["qmax"] for p in rule["patterns"])


def exact_steps(rule: Rule) -> list[int]:
    """Pattern index wanted at each row of a fixed-length match."""
    return [i for i, p in enumerate(rule["patterns"]) for _ in range(p["qmin"])]


def longest(rule: Rule) -> int | None:
    """Most rows a match can have, None when a pattern is open-ended."""
    tops = [p["qmax"] for p in rule["patterns"]]
    return None if None in tops else sum(tops)


def match_ends(
    position: np.ndarray, micros: np.ndarray, mask: np.ndarray, new_key: np.ndarray,
    quantifiers: Sequence[tuple[int, int | None]], within_micros: int,
) -> np.ndarray:
    """Index of the last row of the match that starts at each row, or -1.

    ``position`` increases; a gap, or a row flagged ``new_key``, ends adjacency.
    """
    n = len(position)
    ends = np.full(n, -1, dtype=np.int64)
    if n == 0:
        return ends
    index = np.arange(n)
    cut = np.ones(n, dtype=bool)
    cut[1:] = (np.diff(position) != 1) | new_key[1:]
    starts = np.flatnonzero(cut)
    stops = np.append(starts[1:], n)
    stop_of = np.repeat(stops, stops - starts)
    limit = np.empty(n, dtype=np.int64)
    for a, b in zip(starts, stops):
        limit[a:b] = a + np.searchsorted(micros[a:b], micros[a:b] + within_micros, side="left")

    runs, places = [], []
    for bit, (low, _) in enumerate(quantifiers):
        hit = (mask >> bit) & 1 == 1
        stop = np.where(hit, n, index)
        stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], stop_of)
        run = np.where(hit, stop - index, 0)
        runs.append(run)
        places.append(np.flatnonzero(run >= low).tolist())
    last = len(quantifiers) - 1
    least = _least_ends(runs, places, quantifiers)

    def stop_from(at: int, bound: int) -> int:
        """Longest first, step by step; a row is taken if the rest can end within the bound from there."""
        for step, (low, high) in enumerate(quantifiers):
            room = min(int(runs[step][at]), bound - at)
            high = room if high is None else min(high, room)
            if step == last:
                return at + high
            nxt, ends_ = places[step + 1], least[step + 1]
            i = bisect.bisect_right(nxt, at + high) - 1
            while ends_[nxt[i]] > bound:
                i -= 1
            at = nxt[i]
        return at

    for at in places[0]:
        bound = int(limit[at])
        if least[0][at] <= bound:
            ends[at] = stop_from(at, bound) - 1
    return ends


def _least_ends(runs: Sequence[np.ndarray], places: Sequence[Sequence[int]], quantifiers: Sequence[tuple[int, int | None]]) -> list[np.ndarray]:
    """For every step and row, the earliest place at which the steps from there on can stop; beyond all rows if they can't.

    Filled from the last step back. The rows at which the next step may start
    are one range, and its minimum comes from a table of powers of two, so the
    cost is ``steps * rows * log(rows)`` whatever the patterns.
    """
    n = len(runs[0])
    never = np.iinfo(np.int64).max
    out: list[np.ndarray] = [np.full(n, never, dtype=np.int64) for _ in runs]
    for step in range(len(runs) - 1, -1, -1):
        at, (low, high) = np.asarray(places[step], dtype=np.int64), quantifiers[step]
        if step == len(runs) - 1:
            out[step][at] = at + low
            continue
        nxt = np.asarray(places[step + 1], dtype=np.int64)
        run = runs[step][at]
        first = np.searchsorted(nxt, at + low, side="left")
        stop = np.searchsorted(nxt, at + (run if high is None else np.minimum(run, high)), side="right")
        some = stop > first
        if not some.any():
            continue
        table = [out[step + 1][nxt]]
        while 2 << (len(table) - 1) <= len(nxt):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        a, b = first[some], stop[some]
        level = np.log2(b - a).astype(np.int64)
        best = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            mine = level == k
            best[mine] = np.minimum(table[k][a[mine]], table[k][b[mine] - (1 << int(k))])
        out[step][at[some]] = best
    return out


def _numbered(events: DataFrame, rules: Sequence[Rule], by: Sequence[str], tz: str) -> DataFrame:
    """All rows with key columns, one bit mask per rule, and a dense position in key and time order."""
    keys = [field(name, tz).cast("string").alias(f"key_{i}") for i, name in enumerate(by)]
    masks = []
    for i, rule in enumerate(rules):
        bits = [F.when(match(p, tz), F.lit(1 << b)).otherwise(F.lit(0)) for b, p in enumerate(rule["patterns"])]
        masks.append(functools.reduce(operator.add, bits).cast("bigint").alias(f"mask_{i}"))
    order = [f"key_{i}" for i in range(len(by))] + ["ts", "event_id"]
    rows = events.select(*keys, "ts", "event_id", "user_id", "hostname", "user_ip", *masks)
    return with_positions(rows, *order)


def _reach(rows: DataFrame, rule: Rule, mask: str, keys: Sequence[str]) -> int:
    """Rows a match of the rule can span at most.

    Open-ended rules are measured: a match is shorter than ``within``, so it lies
    in two neighbouring windows of that length.
    """
    top = longest(rule)
    if top is not None:
        return top
    width = F.lit(rule["within_s"] * _MICROS)
    window = F.floor(F.unix_micros("ts") / width)
    counted = rows.where(F.col(mask) > 0).groupBy(*keys, window.alias("w")).count()
    most = counted.agg(F.max("count")).first()[0]
    return 2 * int(most or 0) + 1


def _with_halo(rows: DataFrame, chunk: int, reach: int) -> DataFrame:
    """Rows per chunk, with the first ``reach - 1`` rows of the next chunk behind them."""
    own = F.floor(F.col("pos") / chunk)
    early = (F.pmod("pos", F.lit(chunk)) < reach - 1) & (own > 0)
    return rows.withColumn("chunk", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))))


def _exact_candidates(rows: DataFrame, rules: Mapping[str, Rule], keys: Sequence[str], chunk: int) -> DataFrame:
    """Fixed-length matches from every start, by looking ahead in a window over one chunk."""
    reach = max(len(exact_steps(r)) for r in rules.values())
    seen = functools.reduce(operator.or_, [F.col(m) > 0 for m in rules])
    wide = _with_halo(rows.where(seen), chunk, reach)
    ahead = Window.partitionBy("chunk").orderBy("pos")
    found = []
    for mask, rule in rules.items():
        steps = exact_steps(rule)
        far = len(steps) - 1

        def at(col: str, j: int):
            return F.lead(col, j).over(ahead) if j else F.col(col)

        tests = [at(mask, j).bitwiseAND(F.lit(1 << bit)) != 0 for j, bit in enumerate(steps)]
        tests.append(at("pos", far) == F.col("pos") + far)
        tests += [at(k, far).eqNullSafe(F.col(k)) for k in keys]
        tests.append(F.unix_micros(at("ts", far)) - F.unix_micros("ts") < rule["within_s"] * _MICROS)
        row = F.struct(
            F.lit(rule["rule_id"]).alias("rule_id"),
            F.col("pos").alias("start"),
            (F.col("pos") + far).alias("stop"),
            *[at(c, far).alias(c) for c in _LAST_ROW],
        )
        found.append(F.when(functools.reduce(operator.and_, tests), row))
    own = F.floor(F.col("pos") / chunk) == F.col("chunk")
    return (
        wide.select(own.alias("own"), F.array(*found).alias("found"))
        .where("own")
        .select(F.explode(F.filter("found", lambda x: x.isNotNull())).alias("m"))
        .select("m.*")
    )


def _repeat_candidates(rows: DataFrame, rule: Rule, mask: str, keys: Sequence[str], chunk: int, reach: int) -> DataFrame:
    """Matches with variable repeats, chunk by chunk.

    A task holds a few numbers per row of one chunk and its halo; the columns of
    the last row are joined to the matches that are found.
    """
    quantifiers = [(p["qmin"], p["qmax"]) for p in rule["patterns"]]
    within, rule_id = rule["within_s"] * _MICROS, rule["rule_id"]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        pos, key = pdf["pos"].to_numpy(), pdf["key"].to_numpy()
        new_key = np.append(True, key[1:] != key[:-1])
        ends = match_ends(pos, pdf["micros"].to_numpy(), pdf[mask].to_numpy(), new_key, quantifiers, within)
        hit = np.flatnonzero((ends >= 0) & (pos // chunk == pdf["chunk"].iloc[0]))
        return pd.DataFrame({"rule_id": rule_id, "start": pos[hit], "stop": pos[ends[hit]]})

    matching = rows.where(F.col(mask) > 0)
    # The number only has to differ between neighbouring keys.
    slim = matching.select("pos", F.unix_micros("ts").alias("micros"), mask, F.xxhash64(*[F.coalesce(F.concat(F.lit("="), k), F.lit("-")) for k in keys]).alias("key"))
    found = _with_halo(slim, chunk, reach).groupBy("chunk").applyInPandas(search, "rule_id string, start bigint, stop bigint")
    last = matching.select(F.col("pos").alias("stop"), *_LAST_ROW)
    return found.join(last, "stop").select("rule_id", "start", "stop", *_LAST_ROW)


def _far_candidates(rows: DataFrame, rule: Rule, mask: str, keys: Sequence[str]) -> DataFrame:
    """Matches of any length with variable repeats, by lookups in the order of positions.

    Where the rest of a match from a step on may begin is a set of rows, and the
    earliest end of that rest never decreases along it: it belongs to the first
    row of the set for the next step. So the earliest ends take one lookup per
    step, from the last one back, and the longest-first choice takes the last
    row of the set that leaves room for the rest. A task holds one row at a time.
    """
    steps = [(p["qmin"], p["qmax"]) for p in rule["patterns"]]
    last = len(steps) - 1
    pos = F.col("pos")

    def up_to(start: Column, high: int | None, *others: Column) -> Column:
        room = [*others, *([] if high is None else [start + high])]
        return F.least(*room) if len(room) > 1 else room[0]

    # The number only has to differ between neighbouring keys.
    key = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), k), F.lit("-")) for k in keys])
    slim = rows.where(F.col(mask) > 0).select("pos", F.unix_micros("ts").alias("micros"), F.col(mask).alias("mask"), key.alias("key"))
    behind = slim.select((pos - 1).alias("pos"), F.col("key").alias("next_key"), F.col("mask").alias("next_mask"))
    goes_on = F.coalesce(F.col("next_key") == F.col("key"), F.lit(False))
    ends = {"block": F.when(~goes_on, pos + 1)}
    for k in range(len(steps)):
        ends[f"stop_{k}"] = F.when(~(goes_on & (F.col("next_mask").bitwiseAND(F.lit(1 << k)) != 0)), pos + 1)
    runs = stage(with_last_known(slim.join(behind, "pos", "left"), [-pos], ends).drop("next_key", "next_mask"), "runs")

    def fitting(k: int) -> DataFrame:
        """Rows with enough repeats of the step."""
        enough = F.col(f"stop_{k}") - pos >= steps[k][0]
        return runs.where((F.col("mask").bitwiseAND(F.lit(1 << k)) != 0) & enough).select(
            "pos", "micros", "block", F.col(f"stop_{k}").alias("stop")
        )

    # Per step: the rows from which it and all later ones can be taken, with the earliest end of those.
    begins = {last: fitting(last).withColumn("least", pos + steps[last][0])}
    for k in range(last - 1, -1, -1):
        low, high = steps[k]
        after = begins[k + 1].select("pos", "least", (-pos).alias("seek"))
        found = as_of(fitting(k).withColumn("seek", -(pos + low)), after, "seek", {"pos": "next", "least": "least"})
        begins[k] = stage(found.where(F.col("next") <= up_to(pos, high, F.col("stop"))).drop("seek", "next"), "begins")

    # A row too late for a match: the first one of the block at or beyond the time limit.
    late = runs.select("block", (-F.col("micros")).alias("seek"), (-pos).alias("first"))
    limit = -(F.col("micros") + rule["within_s"] * _MICROS)
    timed = as_of(begins[0].withColumn("seek", limit), late, "seek", {"first": "late"}, group=["block"])
    at = timed.withColumn("bound", F.coalesce(-F.col("late"), F.col("block"))).where("least <= bound").select(
        pos.alias("start"), "pos", "stop", "bound"
    )
    for k in range(1, last + 1):
        top = up_to(pos, steps[k - 1][1], F.col("stop"))
        if k == last:
            top = F.least(top, F.col("bound") - steps[k][0])
        else:
            by_end = begins[k].select(F.col("least").alias("seek"), "pos")
            at = as_of(at.withColumn("seek", F.col("bound")), by_end, "seek", {"pos": "fits"})
            top = F.least(top, F.col("fits"))
        there = begins[k].select(pos.alias("seek"), "pos", "stop")
        at = as_of(at.select("start", "bound", top.alias("seek")), there, "seek", {"pos": "pos", "stop": "stop"})
    stop = up_to(pos, steps[last][1], F.col("stop"), F.col("bound")) - 1
    rear = rows.where(F.col(mask) > 0).select(pos.alias("stop"), *_LAST_ROW)
    return at.select(F.lit(rule["rule_id"]).alias("rule_id"), "start", stop.alias("stop")).join(rear, "stop").select("rule_id", "start", "stop", *_LAST_ROW)


def _walk(starts: Sequence[int], stops: Sequence[int], free: int) -> Iterator[int]:
    """Indexes of the candidates taken from left to right when the first free position is ``free``."""
    for i, (start, stop) in enumerate(zip(starts, stops)):
        if start >= free:
            yield i
            free = stop + 1


def _chunk_map(pdf: pd.DataFrame, chunk: int) -> pd.DataFrame:
    """Where the last match of the chunk ends, for every place at which the chunk may be entered."""
    rule_id, number = pdf["rule_id"].iloc[0], int(pdf["chunk"].iloc[0])
    own = pdf[~pdf["incoming"]].sort_values("start")
    starts, stops = own["start"].to_numpy(), own["stop"].to_numpy()
    first, nxt = number * chunk, (number + 1) * chunk
    entries = sorted({first, *pdf.loc[pdf["incoming"], "stop"].add(1).tolist()})
    # Walks that meet go on together: the end of a walk is found once per candidate, from the last one back.
    follow = np.searchsorted(starts, stops + 1, side="left")
    end = np.append(stops + 1, 0)
    for i in range(len(starts) - 1, -1, -1):
        if follow[i] < len(starts):
            end[i] = end[follow[i]]
    exits = []
    for entry, i in zip(entries, np.searchsorted(starts, np.asarray(entries), side="left")):
        exits.append(max(int(end[i]) if i < len(starts) else int(entry), nxt))
    return pd.DataFrame({"rule_id": [rule_id], "chunk": [number], "entries": [entries], "exits": [exits]})


def _follow(rows: pd.DataFrame, entry: int, chunk: int) -> tuple[list[int], int]:
    """Entry of each chunk, and the exit after the last one, when the first chunk is entered at ``entry``."""
    got, free = [], entry
    for number, entries, exits in zip(rows["chunk"], rows["entries"], rows["exits"]):
        # Chunks without candidates and ends are not listed. A place in a chunk is among its entries;
        # any other one lies behind it, and the match that ends there covers the chunk.
        free = max(free, number * chunk)
        got.append(free)
        free = dict(zip(entries, exits)).get(free, free)
    return got, free


def _group_map(pdf: pd.DataFrame, chunk: int) -> pd.DataFrame:
    """The maps of a group of chunks composed into one, for entries at any place of the group."""
    pdf = pdf.sort_values("chunk")
    numbers = pdf["chunk"].tolist()
    final: dict[int, int] = {}
    for entries, exits in zip(pdf["entries"][::-1], pdf["exits"][::-1]):
        ahead = {}
        for entry, leave in zip(entries, exits):
            i = bisect.bisect_left(numbers, leave // chunk)
            ahead[entry] = final[max(leave, numbers[i] * chunk)] if i < len(numbers) else leave
        # An entry right behind a chunk is the first place of the next one, which is known already.
        final = {**ahead, **final}
    head, entries = pdf.iloc[0], sorted(final)
    return pd.DataFrame({
        "rule_id": [head["rule_id"]], "grp": [head["grp"]], "first": [head["chunk"]],
        "entries": [entries], "exits": [[final[e] for e in entries]],
    })


def _group_entries(pdf: pd.DataFrame, chunk: int) -> pd.DataFrame:
    """Entry of each group of chunks; one small row per group comes here."""
    pdf = pdf.sort_values("grp").rename(columns={"first": "chunk"})
    got, _ = _follow(pdf, int(pdf["chunk"].iloc[0]) * chunk, chunk)
    return pd.DataFrame({"rule_id": pdf["rule_id"], "grp": pdf["grp"], "group_entry": got})


def _chunk_entries(pdf: pd.DataFrame, chunk: int) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    got, _ = _follow(pdf, int(pdf["group_entry"].iloc[0]), chunk)
    return pd.DataFrame({"rule_id": pdf["rule_id"], "chunk": pdf["chunk"], "entry": got})


def without_overlap(candidates: DataFrame, chunk: int = CHUNK, per_group: int = CHUNKS_PER_GROUP) -> DataFrame:
    """Leftmost matches that do not overlap, of candidates ``(rule_id, start, stop, …)``.

    No task sees more than one chunk of candidates, or the maps of one group of
    chunks: a row per chunk, with as many entries as places in it at which
    matches from earlier chunks end.
    """
    candidates = candidates.withColumn("chunk", F.floor(F.col("start") / chunk))
    spill = candidates.where(F.floor(F.col("stop") / chunk) > F.col("chunk"))
    incoming = spill.select("rule_id", F.floor(F.col("stop") / chunk).alias("chunk"), "start", "stop", F.lit(True).alias("incoming"))
    own = candidates.select("rule_id", "chunk", "start", "stop", F.lit(False).alias("incoming"))
    maps = (
        own.unionByName(incoming.distinct())
        .groupBy("rule_id", "chunk")
        .applyInPandas(lambda pdf: _chunk_map(pdf, chunk), "rule_id string, chunk bigint, entries array<bigint>, exits array<bigint>")
        .withColumn("grp", F.floor(F.col("chunk") / per_group))
    )
    maps = stage(maps, "chunk-maps")
    groups = maps.groupBy("rule_id", "grp").applyInPandas(
        lambda pdf: _group_map(pdf, chunk),
        "rule_id string, grp bigint, first bigint, entries array<bigint>, exits array<bigint>",
    )
    entered = groups.groupBy("rule_id").applyInPandas(
        lambda pdf: _group_entries(pdf, chunk), "rule_id string, grp bigint, group_entry bigint"
    )
    entries = maps.join(entered, ["rule_id", "grp"]).groupBy("rule_id", "grp").applyInPandas(
        lambda pdf: _chunk_entries(pdf, chunk), "rule_id string, chunk bigint, entry bigint"
    )
    out = candidates.schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", ignore_index=True)
        taken = list(_walk(pdf["start"].to_numpy(), pdf["stop"].to_numpy(), int(pdf["entry"].iloc[0])))
        return pdf.iloc[taken].drop(columns="entry")

    return (
        candidates.join(entries, ["rule_id", "chunk"])
        .select(*candidates.columns, "entry")
        .groupBy("rule_id", "chunk")
        .applyInPandas(choose, out)
        .drop("chunk")
    )


def _one_key_list(events: DataFrame, rules: Sequence[Rule], by: Sequence[str], tz: str, chunk: int, per_group: int) -> DataFrame:
    keys = [f"key_{i}" for i in range(len(by))]
    rows = _numbered(events, rules, by, tz)
    masks = {f"mask_{i}": r for i, r in enumerate(rules)}
    reach = {m: _reach(rows, r, m, keys) for m, r in masks.items()}
    chunk = max(chunk, *[reach[m] for m, r in masks.items() if longest(r) is not None], 1)
    exact = {m: r for m, r in masks.items() if is_exact(r)}
    found = [_exact_candidates(rows, exact, keys, chunk)] if exact else []
    for m, r in masks.items():
        if m in exact:
            continue
        near = reach[m] <= chunk
        found.append(_repeat_candidates(rows, r, m, keys, chunk, reach[m]) if near else _far_candidates(rows, r, m, keys))
    candidates = stage(functools.reduce(DataFrame.unionByName, found), "candidates")
    return without_overlap(candidates, chunk, per_group)


def detect_sequence(
    events: DataFrame, rules: Sequence[Rule], tz: str = LOCAL_TZ,
    chunk: int = CHUNK, per_group: int = CHUNKS_PER_GROUP,
) -> DataFrame:
    """Matches of all ordered rules; host and address are those of the last row.

    Rules with the same key list share one sort of the events.
    """
    key_lists: dict[tuple[str, ...], list[Rule]] = {}
    for rule in rules:
        key_lists.setdefault(tuple(rule["by"]), []).append(rule)
    parts = [_one_key_list(events, rs, by, tz, chunk, per_group) for by, rs in key_lists.items()]
    return functools.reduce(DataFrame.unionByName, parts).select(
        "rule_id", "user_id", "hostname", "user_ip",
        (F.col("stop") - F.col("start") + 1).alias("cnt"), "ts",
        F.concat_ws("|", "event_id").alias("origin"),
    )

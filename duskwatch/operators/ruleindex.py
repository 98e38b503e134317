"""Detection with rules as data: an index over the rules' conditions, looked up per event.

``detect.matches`` turns rules into columns, so its plan grows with the rule
list. Here the rules stay a table and the plan has the same size for ten rules
and for ten thousand.

1. Of every pattern one condition is its *anchor*: an equality if it has one,
   else an order comparison; alternatives (``or``) need all of their conditions as
   anchors. Patterns without such a condition are found by their event type.
2. Anchors become rows of an inverted index under a hashed key: type, field and
   value; or, for comparisons, nodes of a binary tree over :data:`BINS` ranges of
   the field, cut at quantiles of the rules' own bounds. A bound is at most one
   node per level, and a number has one node per level.
3. An event asks for the keys of its own values only. The fields to ask for are
   those that anchors name: few, whatever the number of rules.
4. Candidates are checked against the whole rule by one fixed expression, and
   of the ways in which a rule was found the first counts.

An event costs a probe per anchored field of its type plus the rules that share a
value with it. Index and rules are sent to every executor while they are small,
and joined by shuffle beyond; events travel once, as rows of one stage.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import HOUR_FIELDS, TOP_LEVEL, WEEKDAY_FIELD, as_number, let, local_hour, local_weekday
from ..functions.windows import window_start
from ..session import LOCAL_TZ, broadcast_if_small, stage
from .detect import _ALERT_KEYS, ROW_KINDS, WINDOW_KEYS, WINDOW_KINDS
from .rules import normalize_rules

#: Ranges of a field's numbers, and the levels of the tree over them.
LEVELS = 6
BINS = 1 << LEVELS
#: What a number looks like, as in ``predicates``.
_NUMBER = r"^[ \t\n\r\f\x0B]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\f\x0B]*\z"
_EQUAL, _ORDER = ("eq", "in"), ("gt", "gte", "lt", "lte")


def _number_of(text: Column) -> Column:
    """Rule value -> number, or null."""
    n = text.try_cast("double")
    return F.when(text.rlike(_NUMBER) & (F.abs(n) < F.lit(float("inf"))), n + F.lit(0.0))


def _condition(c: Column) -> Column:
    """A condition with its value read: ``numbers`` and ``texts`` to be equal to, ``bound``, and the hours of a range."""
    listed = F.from_json(F.when(F.ltrim(c["value"]).startswith("["), c["value"]), "array<string>")
    members = F.when(c["op"] == "in", F.coalesce(listed, c["values"], F.array().cast("array<string>"))).otherwise(F.array(c["value"]))
    named = F.transform(members, lambda m: F.coalesce(m, F.lit("None")))

    def hour(name: str) -> Column:
        inside = F.when(F.ltrim(c["value"]).startswith("{"), F.get_json_object(c["value"], f"$.{name}").try_cast("int"))
        return F.coalesce(c[name], inside, F.lit(0)).alias(name)

    return F.struct(
        F.coalesce(c["field"], F.lit("")).alias("field"),
        c["op"].alias("op"),
        F.coalesce(c["value"], F.lit("None")).alias("value"),
        F.array_distinct(F.array_compact(F.transform(named, _number_of))).alias("numbers"),
        F.array_distinct(F.filter(named, lambda m: _number_of(m).isNull())).alias("texts"),
        _number_of(c["value"]).alias("bound"),
        hour("start"),
        hour("end"),
    )


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules of the kinds that have no order, with ``tests``: their patterns as data. Rule ids are expected to be distinct."""

    def pattern(p: Column) -> Column:
        return F.struct(F.coalesce(p["msg_id"], F.lit("")).alias("scope"), p["logic"].alias("logic"), F.transform(p["conditions"], _condition).alias("conds"))

    normal = normalize_rules(rules).where(F.col("kind").isin(*ROW_KINDS, *WINDOW_KINDS))
    return normal.select("rule_id", "name", "severity", "kind", "by", "within_s", F.coalesce("min_count", F.lit(1)).alias("min_count"), F.transform("patterns", pattern).alias("tests"))


class Event:
    """Values of an event by names that are data."""

    def __init__(self, tz: str):
        self.hour, self.weekday = local_hour("ts", tz), local_weekday("ts", tz)
        self.top = F.create_map(*[x for name, column in TOP_LEVEL.items() for x in (F.lit(name), F.col(column))])

    def columns(self) -> list[Column]:
        return [self.hour.alias("_hour"), self.weekday.alias("_weekday"), self.top.alias("_top")]

    @staticmethod
    def _virtual(name: Column) -> Column:
        return F.when(name.isin(*HOUR_FIELDS), F.col("_hour")).when(name == WEEKDAY_FIELD, F.col("_weekday"))

    def text(self, name: Column) -> Column:
        stored = F.coalesce(F.when(name == "action", F.col("ext")["act"]), F.col("ext")[name], F.col("_top")[name])
        return F.when(name.isin(*HOUR_FIELDS, WEEKDAY_FIELD), self._virtual(name).cast("string")).otherwise(stored)

    def number(self, name: Column, text: Column) -> Column:
        return F.coalesce(self._virtual(name).cast("double"), as_number(text))


def holds(c: Column, event: Event) -> Column:
    """Whether an event fulfils a condition that is data; a missing field or an unknown operator never does."""
    name, op = c["field"], c["op"]

    def test(text: Column) -> Column:
        def with_number(n: Column) -> Column:
            equal = F.coalesce(F.array_contains(c["numbers"], n), F.lit(False)) | F.coalesce(F.array_contains(c["texts"], text), F.lit(False))
            hour = F.when((name == "") | name.isin(*HOUR_FIELDS), F.col("_hour")).otherwise(F.floor(n))
            after, before = hour >= c["start"], hour < c["end"]
            order = F.when(op == "gt", n > c["bound"]).when(op == "gte", n >= c["bound"]).when(op == "lt", n < c["bound"]).when(op == "lte", n <= c["bound"])
            inside = F.when(c["start"] > c["end"], after | before).otherwise(after & before)
            found = (
                F.when(op == "time_range", inside)
                .when(name == "", F.lit(False))
                .when(op.isin(*_EQUAL), equal)
                .when(op == "neq", text.isNotNull() & ~equal)
                .when(op.isin(*_ORDER), order)
                .when(op == "like", F.like(text, c["value"]))
                .when(op == "regex", F.rlike(text, c["value"]))
                .when(op == "contains", F.lower(text).contains(F.lower(c["value"])))
            )
            return F.coalesce(found, F.lit(False))

        return let(event.number(name, text), with_number)

    return let(event.text(name), test)


def _held(t: Column, event: Event) -> Column:
    """The conditions of a pattern that an event fulfils, as booleans."""
    return F.transform(t["conds"], lambda c: holds(c, event))


def _fulfils(t: Column, event: Event) -> Column:
    def join(h: Column) -> Column:
        return (F.size(h) == 0) | F.when(t["logic"] == "or", F.array_contains(h, True)).otherwise(~F.array_contains(h, False))

    return ((t["scope"] == "") | F.coalesce(t["scope"] == F.col("msg_id"), F.lit(False))) & let(_held(t, event), join)


def anchors(compiled: DataFrame) -> DataFrame:
    """``rule_id``, pattern ``p``, condition ``a`` (-1: by type alone), ``scope`` and the condition, one row per anchor."""
    rows = compiled.select("rule_id", F.posexplode("tests").alias("p", "t"))
    conds = F.transform("t.conds", lambda c, i: F.struct(i.alias("a"), c.alias("c")))

    def equal(x: Column) -> Column:
        return (x["c"]["field"] != "") & x["c"]["op"].isin(*_EQUAL)

    def ordered(x: Column) -> Column:
        return (x["c"]["field"] != "") & x["c"]["op"].isin(*_ORDER) & x["c"]["bound"].isNotNull()

    first = F.slice(F.concat(F.filter(conds, equal), F.filter(conds, ordered)), 1, 1)
    none = F.slice(conds, 1, 0)
    every = F.when(F.forall(conds, lambda x: F.coalesce(equal(x) | ordered(x), F.lit(False))), conds).otherwise(none)
    chosen = F.when(F.col("t.logic") == "or", every).otherwise(first)
    return rows.select("rule_id", "p", F.col("t.scope").alias("scope"), F.explode_outer(chosen).alias("x")).select(
        "rule_id", "p", "scope", F.coalesce("x.a", F.lit(-1)).alias("a"), "x.c"
    )


def _bin(number: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= number))


class Index:
    """``entries`` (``key``, ``rule_id``, ``p``, ``a``) and what an event has to ask for, as JSON: the anchored fields of each type with their cuts, and the types themselves."""

    def __init__(self, compiled: DataFrame):
        found = anchors(compiled)
        by_type = found.where("a < 0").select(F.xxhash64(F.lit("t"), "scope").alias("key"), "rule_id", "p", "a", "scope")
        by_value = found.where("a >= 0").select("rule_id", "p", "a", "scope", F.col("c.field").alias("field"), "c")
        order = F.col("c.op").isin(*_ORDER)
        quantiles = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
        fields = by_value.groupBy("scope", "field").agg(
            F.max(~order & (F.size("c.texts") > 0)).alias("texts"),
            F.max(~order & (F.size("c.numbers") > 0)).alias("numbers"),
            F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(F.when(order, F.col("c.bound")), quantiles, 10_000), F.array().cast("array<double>")))).alias("cuts"),
            F.max(order).alias("ordered"),
        )
        # One row per anchored field of a type: the event schema bounds them, not the number of rules.
        self.fields: list[dict[str, Any]] = [r.asDict() for r in fields.orderBy("scope", "field").collect()]
        self.types: list[str] = sorted(r["scope"] for r in by_type.select("scope").distinct().collect())
        texts = by_value.where(~order).select("rule_id", "p", "a", "scope", "field", F.explode("c.texts").alias("v"))
        numbers = by_value.where(~order).select("rule_id", "p", "a", "scope", "field", F.explode("c.numbers").alias("v"))
        ranges = by_value.where(order).join(F.broadcast(fields.select("scope", "field", "cuts")), ["scope", "field"])
        at = _bin(F.col("c.bound"), F.col("cuts"))
        up = F.col("c.op").isin("gt", "gte")
        ranges = ranges.select("rule_id", "p", "a", "scope", "field", F.when(up, at).otherwise(0).alias("low"), F.when(up, BINS - 1).otherwise(at).alias("high"))
        # A node stands for a range when it lies in it and its parent doesn't.
        level = ranges.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
        node = level.withColumn("node", F.explode(F.expr(f"sequence(0, shiftright({BINS}, level) - 1)")))

        def inside(up: int) -> Column:
            return F.expr(f"shiftright(node, {up}) * shiftleft(1, level + {up}) >= low AND (shiftright(node, {up}) + 1) * shiftleft(1, level + {up}) - 1 <= high")

        cover = node.where(inside(0) & ((F.col("level") == LEVELS) | ~inside(1)))
        kept = ["key", "rule_id", "p", "a"]
        self.entries = (
            by_type.select(kept)
            .unionByName(texts.withColumn("key", F.xxhash64(F.lit("e"), "scope", "field", "v")).select(kept))
            .unionByName(numbers.withColumn("key", F.xxhash64(F.lit("n"), "scope", "field", "v")).select(kept))
            .unionByName(cover.withColumn("key", F.xxhash64(F.lit("i"), "scope", "field", "level", "node")).select(kept))
        )

    def keys(self, event: Event) -> Column:
        """The distinct keys an event asks for."""
        asked = F.from_json(F.lit(json.dumps(self.fields)), "array<struct<scope:string,field:string,texts:boolean,numbers:boolean,ordered:boolean,cuts:array<double>>>")
        types = F.from_json(F.lit(json.dumps(self.types)), "array<string>")
        here = F.coalesce(F.col("msg_id"), F.lit(""))

        def probe(q: Column) -> Column:
            def of_text(t: Column) -> Column:
                def of_number(n: Column) -> Column:
                    def of_bin(b: Column) -> Column:
                        return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.xxhash64(F.lit("i"), q["scope"], q["field"], k, F.call_function("shiftright", b, k)))

                    nodes = F.when(q["ordered"] & n.isNotNull(), let(_bin(n, q["cuts"]), of_bin)).otherwise(F.array().cast("array<bigint>"))
                    equal = F.array(
                        F.when(q["texts"] & t.isNotNull(), F.xxhash64(F.lit("e"), q["scope"], q["field"], t)),
                        F.when(q["numbers"] & n.isNotNull(), F.xxhash64(F.lit("n"), q["scope"], q["field"], n + F.lit(0.0))),
                    )
                    return F.concat(equal, nodes)

                return let(event.number(q["field"], t), of_number)

            return let(event.text(q["field"]), of_text)

        mine = F.filter(asked, lambda q: (q["scope"] == "") | (q["scope"] == here))
        by_type = F.transform(F.filter(types, lambda t: (t == "") | (t == here)), lambda t: F.xxhash64(F.lit("t"), t))
        return F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform(mine, probe)), by_type)))


#: What a match keeps of its event, and of its rule.
_EVENT = ["event_id", "ts", "hostname", "user_ip"]
_RULE = ["rule_id", "kind", "within_s", "min_count"]


def matches(events: DataFrame, compiled: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """One row per (event, rule) that matches: columns of the event and rule, ``mask`` of its patterns, and the values of its keys."""
    event, index = Event(tz), Index(compiled)
    asked = events.select("*", *event.columns())
    probes = asked.select(*_EVENT, "msg_id", "user_id", "ext", "_hour", "_weekday", "_top", F.explode(index.keys(event)).alias("key"))
    slim = compiled.select(*_RULE, "by", "tests")
    found = probes.join(broadcast_if_small(index.entries), "key").join(broadcast_if_small(slim), "rule_id")
    fulfilled = F.transform("tests", lambda t: _fulfils(t, event))

    def way(f: Column) -> Column:
        """The mask, if this is the first pattern fulfilled and the first of its anchors."""
        t = F.element_at("tests", F.col("p") + 1)
        first = F.array_position(f, True) == F.col("p") + 1
        anchor = (F.col("a") < 0) | (t["logic"] != "or") | (F.array_position(_held(t, event), True) == F.col("a") + 1)
        bits = F.aggregate(F.transform(f, lambda h, i: F.when(h, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda x, y: x + y)
        return F.when(first & anchor, bits)

    in_key = F.col("kind").isin(*ROW_KINDS) | F.array_contains("by", "userId")
    extra = F.transform(F.filter("by", lambda b: ~b.isin(*_ALERT_KEYS)), event.text)
    return found.select(*_EVENT, *_RULE, let(fulfilled, way).alias("mask"), F.when(in_key, F.col("user_id")).alias("user_id"), extra.alias("by_values")).where("mask IS NOT NULL")


def detect(events: DataFrame, rules: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Alerts of all rules without order in ``rules``, a table of rule documents: the rows and ids of ``detect.detect`` for the same list.

    An event that is null in a field fulfils no condition on it. An empty table
    of rules or events gives no alerts.
    """
    # Written first, so that documents which are still JSON text are parsed once per column and not once per use of it.
    compiled = stage(compile_rules(stage(rules, "rule-documents")), "rules")
    found = stage(matches(events, compiled, tz), "matches")
    single = found.where(F.col("kind").isin(*ROW_KINDS)).select(
        "rule_id", "user_id", "hostname", "user_ip", F.lit(1).cast("bigint").alias("cnt"), "ts", F.concat_ws("|", "event_id").alias("origin")
    )
    about = broadcast_if_small(compiled.select("rule_id", "name", "severity", "min_count", F.size("tests").alias("n")))
    width = F.col("within_s").cast("bigint")
    grouped = (
        found.where(F.col("kind").isin(*WINDOW_KINDS))
        .groupBy(*WINDOW_KEYS, width.alias("width"), "min_count", window_start("ts", width).alias("start"))
        .agg(F.count("*").alias("cnt"), F.bit_or("mask").alias("seen"))
        .where("cnt >= min_count")
    )
    windows = grouped.select(
        "rule_id", "user_id", "hostname", "user_ip", "cnt", F.timestamp_seconds(F.col("start") + F.col("width")).alias("ts"),
        F.concat_ws("|", "start", F.concat_ws("|", "by_values")).alias("origin"), "seen",
    )
    alerts = single.withColumn("seen", F.lit(None).cast("bigint")).unionByName(windows).join(about, "rule_id")
    needed = F.expr("shiftleft(1L, n) - 1")
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("rule_id", "user_id", "hostname", "user_ip", "origin")]
    return alerts.where(F.col("seen").isNull() | (F.col("seen") == needed)).select(
        F.md5(F.concat_ws("|", *parts)).alias("alert_id"), "rule_id", F.col("name").alias("rule_name"), "severity", "user_id", "hostname", "user_ip", "cnt", "ts"
    )

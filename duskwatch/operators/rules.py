"""Rule documents: one normal form, checks, updates and merging, all as DataFrame operations."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import non_empty
from ..functions.predicates import OPERATORS
from ..functions.windows import DEFAULT_WITHIN, window_seconds
from ..schema import RULE_DDL

#: Defaults of a rule document.
DEFAULT_SEVERITY = "MEDIUM"
DEFAULT_BY = "userId"
AGGREGATE_TYPES = ("count", "sum", "cardinality")
NUMERIC_OPERATORS = ("gt", "gte", "lt", "lte")


def parse_rules(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON text -> rule columns."""
    return df.select(F.from_json(col, RULE_DDL).alias("r")).where("r is not null").select("r.*")


def rules_frame(spark: SparkSession, docs: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Rule documents held by the program as a rules DataFrame."""
    # An Arrow table becomes a local relation, which the optimizer evaluates without starting a job.
    return parse_rules(spark.createDataFrame(pa.table({"value": pa.array([json.dumps(d) for d in docs], pa.string())})))


def _rule_id() -> Column:
    return F.coalesce(non_empty(F.col("id")), non_empty(F.col("ruleId")))


def _name() -> Column:
    return F.coalesce(non_empty(F.col("name")), _rule_id())


def _pattern(order: str, match: str, conditions: str, quantifier: str | None = None) -> str:
    """SQL of one pattern. No quantifier is exactly one; a minimum above one without maximum is open (null)."""
    low = f"greatest(coalesce({quantifier}.min, 1), 1)" if quantifier else "1"
    high = f"CASE WHEN {quantifier}.max > 0 THEN greatest({quantifier}.max, {low}) WHEN {low} > 1 THEN NULL ELSE 1 END" if quantifier else "1"
    return (
        f"named_struct('ord', CAST({order} AS INT), 'msg_id', {match}.msgId, 'logic', lower(coalesce({match}.logic, 'and')), "
        f"'conditions', coalesce({conditions}, array()), 'qmin', {low}, 'qmax', CAST({high} AS INT))"
    )


#: SQL of a rule's patterns: from ``patterns``, else ``events``, else ``match``, else the legacy ``conditions``
#: (whose msgId comparison becomes the type); an empty array when the rule has none. The text is fixed: rule
#: values stay in columns.
_TYPED = "filter(conditions, c -> c.field = 'msgId')"
_LEGACY = f"named_struct('msgId', CASE WHEN size({_TYPED}) > 0 THEN element_at({_TYPED}, -1).value END, 'logic', CAST(NULL AS STRING))"
_PATTERNS = f"""CASE
  WHEN size(patterns) > 0 THEN transform(patterns, p -> {_pattern("p.order", "p.match", "p.match.conditions", "p.quantifier")})
  WHEN size(events) > 0 THEN transform(events, (e, i) -> {_pattern("CASE WHEN size(events) > 1 THEN i + 1 END", "e", "e.conditions")})
  WHEN `match` IS NOT NULL THEN array({_pattern("NULL", "`match`", "`match`.conditions")})
  WHEN conditions IS NOT NULL THEN array({_pattern("NULL", _LEGACY, "filter(conditions, c -> NOT (c.field <=> 'msgId'))")})
  ELSE array() END"""


#: What scoring looks at: the rule's ``match`` when it has one, else its first pattern.
_SCORED = f"CASE WHEN `match` IS NOT NULL THEN {_pattern('NULL', '`match`', '`match`.conditions')} ELSE get(_p, 0) END"


def _patterns() -> Column:
    return F.expr(_PATTERNS)


def normalize_rules(rules: DataFrame) -> DataFrame:
    """One row per rule with its kind, patterns, window, keys and threshold.

    Kinds: ``single`` (row per event), ``threshold`` (count per window),
    ``sequence`` (ordered), ``all`` (co-occurrence), ``any`` (alternative) and ``none``.
    """
    p = F.col("_p")
    ordered = F.filter(p, lambda x: x["ord"].isNotNull())
    count_min = F.coalesce(F.col("aggregate.count.min"), F.col("aggregate.minCount"), F.lit(1))
    repeats = p[0]["qmin"]
    one = F.size(p) == 1
    kind = (
        F.when(F.size(p) == 0, "none")
        .when(one & (F.col("aggregate").isNotNull() | (repeats > 1)), "threshold")
        .when(one, "single")
        .when(F.size(ordered) > 0, "sequence")
        .when(F.upper("logic") == "OR", "any")
        .otherwise("all")
    )
    # A threshold takes its window from the aggregate when there is one, else from the rule.
    k = F.col("kind")
    text = F.when((k == "threshold") & F.col("aggregate").isNotNull(), F.col("aggregate.within")).otherwise(F.col("within"))
    fallback = F.lit(None).cast("string")
    for name, length in DEFAULT_WITHIN.items():
        fallback = F.when(k == name, length).otherwise(fallback)
    width = F.when(k.isin(*DEFAULT_WITHIN), window_seconds(F.coalesce(text, fallback)))
    by = F.when(F.size("by") > 0, F.array_distinct("by")).otherwise(F.array(F.lit(DEFAULT_BY)))
    return (
        rules.withColumn("_p", _patterns())
        .withColumn("kind", kind)
        .select(
            _rule_id().alias("rule_id"),
            _name().alias("name"),
            F.coalesce(non_empty(F.col("cep.severity")), non_empty(F.col("severity")), F.lit(DEFAULT_SEVERITY)).alias("severity"),
            F.coalesce("weight", "ueba.weight", F.lit(0.0)).alias("weight"),
            F.coalesce("enabled", F.lit(False)).alias("enabled"),
            F.coalesce("cep.enabled", F.lit(False)).alias("cep_enabled"),
            F.coalesce("ueba.enabled", F.lit(False)).alias("ueba_enabled"),
            "kind",
            F.when(F.col("kind") == "sequence", F.array_sort(ordered)).otherwise(p).alias("patterns"),
            F.expr(_SCORED).alias("scored"),
            width.alias("within_s"),
            F.when(F.col("kind") == "threshold", F.when(F.col("aggregate").isNotNull(), count_min).otherwise(repeats.cast("bigint"))).alias("min_count"),
            by.alias("by"),
            F.lower(F.coalesce(non_empty(F.col("aggregate.type")), F.lit("count"))).alias("agg_type"),
            F.col("aggregate.field").alias("agg_field"),
        )
    )


def active_rules(rules: DataFrame, kind: str) -> DataFrame:
    """Enabled rules whose feature flag (``cep`` or ``ueba``) is on."""
    return rules.where(F.col("enabled") & F.col(f"{kind}.enabled"))


def collect_rules(rules: DataFrame) -> list[dict[str, Any]]:
    """Normal form as plain dictionaries, ready to be compiled into columns.

    A rule table is configuration written by people; its rows become part of the
    query plan, so they have to be on the driver.
    """
    rows = [r.asDict(recursive=True) for r in normalize_rules(rules).collect()]
    return sorted(rows, key=lambda r: r["rule_id"])


def _condition_errors(conds: Column, place: str) -> Column:
    def errors(c: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{place}["), i.cast("string"), F.lit("]: "))
        value_needed = c["op"].isNull() | (c["op"] != "time_range")
        has_bounds = F.get_json_object(c["value"], "$.start").isNotNull()
        has_end = F.get_json_object(c["value"], "$.end").isNotNull()
        no_value = c["value"].isNull() & (F.coalesce(F.size(c["values"]), F.lit(0)) <= 0)
        numeric = c["op"].isin(*NUMERIC_OPERATORS)
        found = [
            (c["field"].isNull() | (c["field"] == ""), "field required"),
            (~F.coalesce(c["op"].isin(*OPERATORS), F.lit(False)), "unknown operator"),
            (value_needed & no_value, "value required"),
            ((c["op"] == "time_range") & c["start"].isNull() & ~has_bounds, "start required"),
            ((c["op"] == "time_range") & c["end"].isNull() & ~has_end, "end required"),
            (numeric & c["value"].try_cast("double").isNull(), "value is not a number"),
        ]
        return F.array(*[F.when(test, F.concat(at, F.lit(text))) for test, text in found])

    return F.flatten(F.transform(F.coalesce(conds, F.array()), errors))


def validate_rules(rules: DataFrame) -> DataFrame:
    """``(rule_id, errors)``: every problem of a rule; an empty array means the rule is usable."""
    p = F.col("_p")
    m = F.col("match")
    agg = F.col("aggregate")
    has_agg_type = non_empty(agg["type"]).isNotNull()
    ordered = F.size(F.filter(p, lambda x: x["ord"].isNotNull()))
    simple = [
        (non_empty(F.col("name")).isNull(), F.lit("name required")),
        (F.size(p) == 0, F.lit("match required")),
        (m.isNotNull() & non_empty(m["msgId"]).isNull() & (F.coalesce(F.size("patterns"), F.lit(0)) <= 0), F.lit("match.msgId required")),
        (has_agg_type & ~agg["type"].isin(*AGGREGATE_TYPES), F.concat(F.lit("aggregate.type unknown: "), agg["type"])),
        (agg["type"].isin("sum", "cardinality") & non_empty(agg["field"]).isNull(), F.lit("aggregate.field required")),
        ((ordered > 0) & (ordered < F.size(p)), F.lit("patterns without order are ignored in a sequence")),
        ((F.size(p) > 1) & agg.isNotNull(), F.lit("aggregate is ignored with several patterns")),
        ((F.size(p) > 1) & (ordered == 0) & F.exists(p, lambda x: (x["qmin"] > 1) | x["qmax"].isNull()), F.lit("quantifier is ignored without order")),
        (window_seconds(F.coalesce(agg["within"], F.col("within"))).isNull(), F.lit("within is not a window length")),
    ]
    errors = F.concat(
        F.array(*[F.when(test, text) for test, text in simple]),
        _condition_errors(m["conditions"], "conditions"),
        F.flatten(F.transform(F.when(m.isNull(), p).otherwise(F.array()), lambda x, i: _condition_errors(x["conditions"], "pattern conditions"))),
    )
    return rules.withColumn("_p", _patterns()).select(
        _rule_id().alias("rule_id"), F.filter(errors, lambda e: e.isNotNull()).alias("errors")
    )


def upsert_rules(rules: DataFrame, changes: DataFrame, deleted: DataFrame | None = None, key: str = "rule_id") -> DataFrame:
    """Changed columns replace stored ones, new rules are added, deleted ids are removed."""
    old, new = rules.alias("old"), changes.alias("new")
    cols = [F.coalesce(F.col(f"new.{key}"), F.col(f"old.{key}")).alias(key)]
    for name in rules.columns:
        if name != key:
            picked = [F.col(f"new.{name}")] if name in changes.columns else []
            cols.append(F.coalesce(*picked, F.col(f"old.{name}")).alias(name))
    merged = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(*cols)
    return merged if deleted is None else merged.join(deleted.select(key), key, "left_anti")


def apply_weights(rules: DataFrame, weights: DataFrame, key: str = "rule_id") -> DataFrame:
    """Set the weight of listed rules (a missing weight becomes 0); other rules keep theirs."""
    listed = weights.select(F.col(key), F.coalesce("weight", F.lit(0.0)).alias("_w"))
    return rules.join(listed, key, "left").withColumn("weight", F.coalesce("_w", "weight")).drop("_w")


def merge_rules(*lists: DataFrame, key: str = "rule_id") -> DataFrame:
    """Union of rule lists; of rules with one id, that of the earliest list stays."""
    ranked = [df.withColumn("_rank", F.lit(i)) for i, df in enumerate(lists)]
    union = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    cols = [c for c in union.columns if c not in (key, "_rank")]
    best = union.groupBy(key).agg(F.min_by(F.struct(*cols), "_rank").alias("_row"))
    return best.select(key, "_row.*")


def weights_report(rules: DataFrame) -> DataFrame:
    """Scoring rules with name, weight and event type."""
    return rules.where(F.col("ueba.enabled")).select(
        _rule_id().alias("rule_id"),
        _name().alias("name"),
        F.coalesce("weight", "ueba.weight", F.lit(0.0)).alias("weight"),
        F.coalesce("match.msgId", F.lit("")).alias("msg_id"),
    )

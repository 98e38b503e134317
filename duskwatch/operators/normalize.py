"""Projection and normalization of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import let, local, non_empty
from ..session import LOCAL_TZ

#: Suffix of label keys, and the prefix of event types.
LABEL_SUFFIX = "Label"
TYPE_PREFIX = "MESSAGE_"


def label_name(label: Column) -> Column:
    """A label as a field name: blanks removed."""
    return F.replace(label, F.lit(" "), F.lit(""))


def raw_key(label_key: Column) -> Column:
    """``cs1Label`` -> ``cs1``."""
    return F.left(label_key, F.length(label_key) - len(LABEL_SUFFIX))


def expanded(ext: Column) -> Column:
    """Add ``label -> value`` for every ``xLabel``/``x`` pair with text in both.

    An added name replaces an equal key of the event. When two pairs carry one
    label, the pair with the highest key wins; without a rule it would be left to
    chance, a fixed order keeps replays equal.
    """

    def pairs(m: Column) -> Column:
        labelled = F.filter(F.map_entries(m), lambda e: e["key"].endswith(LABEL_SUFFIX) & (e["value"] != ""))
        named = F.transform(
            F.array_sort(labelled),
            lambda e: F.struct(label_name(e["value"]).alias("key"), m[raw_key(e["key"])].alias("value")),
        )
        return F.filter(named, lambda p: p["value"] != "")

    def last_of(found: Column, names: Column) -> Column:
        later = lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["key"])
        return F.when(F.size(F.array_distinct(names)) == F.size(names), found).otherwise(F.filter(found, later))

    def merged(m: Column, found: Column, names: Column) -> Column:
        kept = F.filter(F.map_entries(m), lambda e: ~F.array_contains(names, e["key"]))
        return F.map_from_entries(F.concat(kept, last_of(found, names)))

    def expand(m: Column) -> Column:
        with_names = lambda found: let(F.transform(found, lambda p: p["key"]), lambda names: merged(m, found, names))
        return let(pairs(m), lambda found: F.when(F.size(found) > 0, with_names(found)).otherwise(m))

    # Most events carry no label; looking for one in the joined keys stays in generated code.
    labelled = F.array_join(F.map_keys(ext), "\n").contains(LABEL_SUFFIX)
    return F.when(labelled, let(ext, expand)).otherwise(ext)


def expand_labels(df: DataFrame, map_col: str = "ext") -> DataFrame:
    return df.withColumn(map_col, expanded(F.col(map_col)))


def default_ts(df: DataFrame, now: Column, ts_col: str = "ts") -> DataFrame:
    """Events without a time take ``now``."""
    return df.withColumn(ts_col, F.coalesce(F.col(ts_col), now))


def with_identity(df: DataFrame, map_col: str = "ext") -> DataFrame:
    """Identity columns: the event's own value first, then the extension map's."""
    ext = F.col(map_col)

    def place(name: str, key: str) -> Column:
        return F.coalesce(non_empty(F.col(name)), ext[key]) if name in df.columns else ext[key]

    return df.withColumns({"user_id": place("user_id", "suid"), "user_name": place("user_name", "suser"), "user_ip": place("user_ip", "src")})


def resolve_user(df: DataFrame, map_col: str = "ext") -> DataFrame:
    """User from the event, else from the extension map; events without user or type are dropped."""
    own = [non_empty(F.col("user_id"))] if "user_id" in df.columns else []
    user = F.coalesce(*own, non_empty(F.col(map_col)["suid"]))
    return df.withColumn("user_id", user).where(F.col("user_id").isNotNull() & (F.length("msg_id") > 0))


def normalize(raw: DataFrame, now: Column) -> DataFrame:
    """Raw event -> row of the event log: default time, expanded labels, identity columns."""
    out = with_identity(expand_labels(default_ts(raw, now)))
    own_host = [non_empty(F.col("hostname"))] if "hostname" in raw.columns else []
    return out.withColumn("hostname", F.coalesce(*own_host, F.col("ext")["shost"]))


def first_text(*cols: Column) -> Column:
    """First value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[non_empty(c) for c in cols], F.lit(""))


def display_type(msg_id: Column | str) -> Column:
    return F.replace(F.col(msg_id) if isinstance(msg_id, str) else msg_id, F.lit(TYPE_PREFIX), F.lit(""))


def local_time(ts: Column | str, tz: str = LOCAL_TZ) -> Column:
    return F.coalesce(F.date_format(local(ts, tz), "MM-dd HH:mm:ss"), F.lit("-"))


def event_report_columns(df: DataFrame) -> DataFrame:
    """The seven columns of a log list; each looks at the event first and then at its extension map."""
    ext = F.col("ext")

    def place(column: str, *keys: str) -> Column:
        own = [F.col(column)] if column in df.columns else []
        return first_text(*own, *[ext[k] for k in keys])

    return df.select(
        "event_id",
        "ts",
        display_type("msg_id").alias("type"),
        place("user_id", "userId", "suid").alias("user_id"),
        place("hostname", "hostname", "shost").alias("hostname"),
        place("user_ip", "userIp", "src").alias("user_ip"),
        place("action", "action", "act").alias("action"),
        place("outcome", "outcome").alias("outcome"),
    )


def alert_report_columns(df: DataFrame) -> DataFrame:
    """Alert columns under their plain names; producers that capitalise a name are read as well.

    Spark resolves names without case, so such a table needs case-sensitive analysis
    or two columns that already differ (``RuleName`` and ``rule_name``).
    """
    present = set(df.columns)
    pairs = {"rule_name": "RuleName", "rule_id": "RuleId", "severity": "Severity", "user_id": "UserId", "hostname": "Hostname"}
    cols = []
    for plain, capital in pairs.items():
        found = [F.col(f"`{c}`") for c in (capital, plain) if c in present]
        cols.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(plain))
    return df.select("ts", *cols)

"""Secret scan: credential patterns, and strings of high local entropy.

Built from column functions alone: every row is read once, and nothing is
shuffled, so a frequent source or a very long text is no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S

# The patterns and lengths of the base kinds, in the order of their ranks.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""^(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}+"  # AKIA[A-Z0-9]+ of 16 characters or more: a shorter run holds no longer match
HEX = r"[0-9a-f]{32,}+"  # [0-9a-f]+ of 32 characters or more, likewise
KINDS = ("assign", "access", "hex")

#: Strings whose windows are measured.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Bits per character from which a window of :data:`WINDOW` characters counts, by the class of its string.
LIMITS = {"hex": 2.95, "alnum": 3.52, "base64": 3.83}
#: Strings that look random and are no secrets: identifiers, checksums with a named algorithm, placeholders, alphabets.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(?i:md5|sha1|sha256|sha384|sha512)-",
    r"(?i:example|sample|placeholder|dummy|changeme|your[_-])",
    r"(?i:abcdefghij|0123456789|1234567890|qwertyuiop)",
    r"^(?:[0-9]+[-/_=+]?)+$",
    r"^(?:[A-Za-z]+[-/_=+]*)+$",
)


def character_class(value: Column) -> Column:
    """``hex``, ``base64`` (both cases and a digit) or ``alnum``; null for strings without both letters and digits."""
    lower, upper, digit = value.rlike("[a-z]"), value.rlike("[A-Z]"), value.rlike("[0-9]")
    return F.when(~digit | ~(lower | upper), None).when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(lower & upper, "base64").otherwise("alnum")


def _nlogn(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def high_entropy_runs(value: Column, limit: Column, window: int = WINDOW) -> Column:
    """Runs of overlapping windows at or over ``limit`` bits, as ``(start, end)`` within ``value``.

    One pass: a step drops the leaving character and adds the entering one, and
    changes ``sum(n log n)`` by the counts of these two alone. The entropy of a
    window is ``log2(window) - sum(n log n) / window``.
    """
    runs = "array<struct<start:int,end:int>>"
    empty = F.struct(F.lit(0).alias("i"), F.lit("").alias("held"), F.lit(0.0).alias("total"), F.array().cast(runs).alias("runs"))
    full = F.log2(F.lit(float(window)))

    def times(text, ch):
        return (F.length(text) - F.length(F.replace(text, ch, F.lit("")))).cast("double")

    def step(acc, ch):
        leaves = F.length(acc["held"]) >= window
        old = F.substring(acc["held"], 1, 1)
        n_old = times(acc["held"], old)
        rest = F.when(leaves, F.substring(acc["held"], 2, window)).otherwise(acc["held"])
        n_new = times(rest, ch)
        total = acc["total"] - F.when(leaves, _nlogn(n_old) - _nlogn(n_old - 1)).otherwise(0.0) + _nlogn(n_new + 1) - _nlogn(n_new)
        end = acc["i"] + 1
        begin = end - window
        high = (begin >= 0) & (full - total / window >= limit)
        last = F.try_element_at(acc["runs"], F.lit(-1))
        joined = F.coalesce(begin < last["end"], F.lit(False))
        kept = F.when(joined, F.slice(acc["runs"], F.lit(1), F.greatest(F.size(acc["runs"]) - 1, F.lit(0)))).otherwise(acc["runs"])
        run = F.struct(F.when(joined, last["start"]).otherwise(begin).alias("start"), end.alias("end"))
        return F.struct(end.alias("i"), F.concat(rest, ch).alias("held"), total.alias("total"), F.when(high, F.concat(kept, F.array(run))).otherwise(acc["runs"]).alias("runs"))

    return F.aggregate(F.split(value, ""), empty, step, lambda acc: acc["runs"])


def scan(df: DataFrame, text: str = "text", out: str = "secrets", allow: tuple[str, ...] = ALLOW, limits: dict[str, float] | None = None) -> DataFrame:
    """Add ``out``: spans ``(start, rank, kind, end, value)`` of assignments, access keys, hex runs and high-entropy strings.

    Base matches always stay. Entropy spans are added where they share no
    character with a base match and their string is on no allow list. A null
    or empty text has no spans; repeated rows are scanned alike; other columns
    pass through, and a column already named ``out`` is replaced.
    """
    limits = limits or LIMITS
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # One struct holds the row, so that no name of its columns can clash with one used here.
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != out]).alias("_row"), t.alias("_t"))
    wide = wide.select(
        "*",
        S.matches(F.col("_t"), ASSIGN, F.col("_t").rlike("[:=]")).alias("_am"),
        S.matches(F.col("_t"), ACCESS, F.col("_t").contains("AKIA")).alias("_km"),
        S.matches(F.col("_t"), HEX).alias("_hm"),
        S.matches(F.col("_t"), CANDIDATE).alias("_cm"),
    )
    wide = wide.select(
        "*",
        S.located(F.col("_am"), S.gaps(F.col("_t"), ASSIGN, F.col("_am"))).alias("_a"),
        S.located(F.col("_km"), S.gaps(F.col("_t"), ACCESS, F.col("_km"))).alias("_k"),
        S.located(F.col("_hm"), S.gaps(F.col("_t"), HEX, F.col("_hm"))).alias("_h"),
        # Most texts have long words without a digit only: no positions are needed there.
        F.when(F.exists("_cm", lambda m: character_class(m).isNotNull()), S.located(F.col("_cm"), S.gaps(F.col("_t"), CANDIDATE, F.col("_cm")))).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")).alias("_c"),
    )
    value = lambda s: F.regexp_replace(s["value"], ASSIGN_VALUE, "")
    base = S.ordered(
        S.tagged(F.filter("_a", lambda s: F.length(value(s)) >= ASSIGN_LEAST), "assign", 0),
        S.tagged(F.col("_k"), "access", 1),
        S.tagged(F.col("_h"), "hex", 2),
    )
    allowed = lambda v: F.lit(False) if not allow else F.array_contains(F.array(*[v.rlike(p) for p in allow]), True)
    suspects = F.filter("_c", lambda s: character_class(s["value"]).isNotNull() & ~allowed(s["value"]))

    def runs(s):
        limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), character_class(s["value"]))
        return F.transform(
            high_entropy_runs(s["value"], limit),
            lambda r: F.struct((s["start"] + r["start"]).alias("start"), (s["start"] + r["end"]).alias("end"), F.substring(s["value"], r["start"] + 1, r["end"] - r["start"]).alias("value")),
        )

    wide = wide.select("*", base.alias("_base"), F.flatten(F.transform(suspects, runs)).alias("_runs"))
    added = S.outside(S.tagged(F.col("_runs"), "entropy", 3), F.col("_base"))
    return wide.select("_row", S.ordered(F.col("_base"), added).alias("_all")).select("_row.*", F.col("_all").alias(out))


def digest(scanned: DataFrame, key: str = "doc_id", spans: str = "secrets") -> DataFrame:
    """Counts per base kind, the checksum of the base spans, and all spans as text."""
    base = F.filter(F.col(spans), lambda s: s["rank"] < 3)
    return scanned.select(
        key,
        *[S.count(F.col(spans), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(S.digest(base), 256).alias("base_sha256"),
        S.digest(F.col(spans)).alias("spans"),
    )


def redact(scanned: DataFrame, text: str = "text", spans: str = "secrets") -> DataFrame:
    """Replace every span by ``<kind>``; a null text stays null."""
    return scanned.withColumn(text, S.replaced(F.col(text), F.col(spans), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">"))))

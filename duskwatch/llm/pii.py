"""Personal data: identifier patterns, and identifiers found by the words around them.

The base kinds are patterns with checks. The rest is bootstrapped: base
matches are the seeds, the words beside them are lexical patterns, and both
are scored on the graph of patterns and instances until patterns that mostly
stand beside known identifiers vouch for unknown ones. All of it is column
functions, joins and grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, stage
from . import spans as S

# What the base kinds match, in the order of their ranks. Possessive repeats and the look-behinds change
# no match; they keep long runs of one class linear. A match starts mid-run only where the last one ended (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # shorter runs of digits can't pass
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: An identifier-like unit: a whole phone or card number, or a word with a digit.
UNIT = r"\+[0-9][\x20().0-9-]+[0-9]|(?<![^\x20\x09-\x0D])(?:[0-9](?:[\x20-]?[0-9]){13,}+|[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+)"
_TRIM_LEFT, _TRIM_RIGHT = r"^[\"'(\[{<]+", r"[\"')\]}>.,;:!?]+$"

#: Rounds of scoring, the confidence from which a pattern vouches and an instance counts, and the distinct seeds a pattern needs.
ROUNDS = 3
PATTERN_CONFIDENCE = 0.75
INSTANCE_CONFIDENCE = 0.75
LEAST_SEEDS = 3


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` have a checksum divisible by ten."""
    digits = F.reverse(F.filter(F.split(number, ""), lambda c: c.rlike("[0-9]")))

    def part(c, i):
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(digits, part), F.lit(0), lambda a, x: a + x) % 10 == 0


def n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def small_parts(address: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(address, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).try_cast("int") <= 255))


def base(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the base spans of ``text`` in order."""
    t = F.col(text)
    tests = {"email": (EMAIL, t.contains("@")), "ip": (IP, t.rlike(r"[0-9]\.[0-9]")), "card": (CARD, t.rlike("[0-9]")), "phone": (PHONE, t.contains("+"))}
    passes = {
        "email": lambda v: F.lit(True),
        "ip": small_parts,
        "card": lambda v: n_digits(v).between(14, 19) & luhn(v),
        "phone": lambda v: n_digits(v).between(10, 15),
    }
    wide = df.select("*", *[S.matches(t, p, only).alias(f"_m_{k}") for k, (p, only) in tests.items()])
    wide = wide.select("*", *[S.located(F.col(f"_m_{k}"), S.gaps(t, p, F.col(f"_m_{k}"))).alias(f"_s_{k}") for k, (p, _) in tests.items()])
    passing = lambda k: F.filter(f"_s_{k}", lambda s: passes[k](s["value"]))
    found = [S.tagged(passing(k), k, i) for i, k in enumerate(KINDS)]
    return wide.select(*[F.col(f"`{c}`") for c in df.columns], S.ordered(*found).alias(out))


def units(df: DataFrame, text: str, found: str, out: str) -> DataFrame:
    """Add ``out``: identifier-like units with their span, the words beside them and whether a base match shares a character."""
    t = F.col(text)
    wide = df.select("*", S.matches(t, UNIT, t.rlike("[0-9]")).alias("_um"))
    wide = wide.select("*", S.gaps(t, UNIT, F.col("_um")).alias("_ug"))
    wide = wide.select("*", S.located(F.col("_um"), F.col("_ug")).alias("_us"))

    def unit(s, i):
        left, right = F.get(F.col("_ug"), i), F.get(F.col("_ug"), i + 1)
        cut = F.length(F.regexp_extract(s["value"], _TRIM_LEFT, 0))
        value = F.regexp_replace(F.regexp_replace(s["value"], _TRIM_LEFT, ""), _TRIM_RIGHT, "")
        begin = s["start"] + cut
        end = begin + F.length(value)
        known = F.exists(F.col(found), lambda b: (b["start"] < end) & (begin < b["end"]))
        return F.struct(
            begin.alias("start"),
            end.alias("end"),
            value.alias("value"),
            F.lower(F.regexp_extract(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)).alias("left2"),
            F.lower(F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)).alias("left"),
            F.lower(F.regexp_extract(right, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)).alias("right"),
            known.alias("seed"),
        )

    return wide.select(*df.columns, F.filter(F.transform("_us", unit), lambda u: F.length(u["value"]) > 0).alias(out))


def pattern_of(unit: Column) -> Column:
    """The lexical patterns of a unit: the two words before it, and the words on both sides."""
    both = F.when((unit["left"] != "") & (unit["right"] != ""), F.concat(F.lit("LR\t"), unit["left"], F.lit("\t"), unit["right"]))
    two = F.when(unit["left2"] != "", F.concat(F.lit("LL\t"), unit["left2"]))
    return F.array_compact(F.array(two, both))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and instances from ``edges`` ``(pattern, instance, seed)``, one row per distinct pair.

    Seeds score 1. A pattern's confidence is the summed score of its distinct
    instances over their number plus one, and 0 with fewer than
    :data:`LEAST_SEEDS` seeds or found instances; an instance's score is the
    chance that one of its vouching patterns is right. Distinct instances are
    counted, so copies of one document add nothing.
    """
    score = F.when(F.col("seed"), 1.0).otherwise(0.0)
    scored = edges.select("pattern", "instance", "seed", score.alias("score"))
    for _ in range(rounds):
        patterns = confidence(scored)
        vouch = edges.join(patterns, "pattern").groupBy("instance").agg(F.max("seed").alias("_s"), F.sum(F.log1p(-F.least("confidence", F.lit(0.999999)))).alias("_l"))
        instances = vouch.select("instance", F.when(F.col("_s"), 1.0).otherwise(1 - F.exp("_l")).alias("score"))
        scored = edges.join(instances, "instance", "left").select("pattern", "instance", "seed", F.greatest(F.coalesce("score", F.lit(0.0)), score).alias("score"))
    return confidence(scored), instances.filter(F.col("score") >= INSTANCE_CONFIDENCE)


def confidence(scored: DataFrame) -> DataFrame:
    known = F.sum(F.when(F.col("score") >= INSTANCE_CONFIDENCE, 1).otherwise(0))
    p = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), known.alias("_known"))
    return p.filter((F.col("_known") >= LEAST_SEEDS) & (F.col("confidence") >= PATTERN_CONFIDENCE)).select("pattern", "confidence")


def _found(df: DataFrame, key: str, text: str) -> DataFrame:
    """``k``, base spans ``b``, units ``u`` and the checksum ``h`` of each text, written once.

    Small beside the texts, and read for the graph, for the discovered spans
    and for the result.
    """
    docs = df.select(F.col(f"`{key}`").alias("k"), _plain(text).alias("t"))
    found = units(base(docs, "t", "b"), "t", "b", "u")
    # Texts without units have nothing to join; numbers spread them where a null key would gather them.
    h = F.when(F.size("u") > 0, F.sha2(F.col("t"), 256)).otherwise(F.monotonically_increasing_id().cast("string"))
    return stage(found.select("k", "b", "u", h.alias("h")), "pii")


def _plain(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


_SPANS = "array<struct<start:int,end:int,value:string>>"


def discovered(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``h`` and ``a``: the spans that bootstrapping adds to a text."""
    seen = found.select("h", F.explode("u").alias("u"))
    seen = seen.select("h", "u", F.explode(pattern_of(F.col("u"))).alias("pattern"), F.lower("u.value").alias("instance"))
    edges = stage(seen.groupBy("pattern", "instance").agg(F.max("u.seed").alias("seed")), "pii-graph")
    patterns, instances = bootstrap(edges, rounds)
    fresh = seen.filter(~F.col("u.seed")).join(patterns.select("pattern"), "pattern", "left_semi").join(instances.select("instance"), "instance", "left_semi")
    return fresh.groupBy("h").agg(F.collect_set(F.struct("u.start", "u.end", "u.value")).alias("a"))


def _all_spans(base_spans: Column, added: Column) -> Column:
    return S.ordered(base_spans, S.tagged(F.coalesce(added, F.array().cast(_SPANS)), "context", 4))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "pii", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``key`` and ``out``, spans ``(start, rank, kind, end, value)`` of base kinds and of kind ``context``.

    A null or empty text has no spans. Rows may repeat, and a key may stand
    for several texts or be null; each row gets the spans of its own text.
    Other columns of ``df`` are not looked at, so their names can't clash.
    """
    found = _found(df, key, text)
    whole = found.select("k", "b", "h").join(discovered(found, rounds), "h", "left")
    return whole.select(F.col("k").alias(key), _all_spans(F.col("b"), F.col("a")).alias(out))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``df`` with every span of :func:`scan` replaced by ``<kind>``; a null text stays null, all other columns are as they were.

    The texts stay where they are: base spans are found again in their rows,
    and the discovered ones, few beside the texts, come by a join.
    """
    added = stage(discovered(_found(df, key, text), rounds), "pii-added").select(F.col("h").alias("__h"), F.col("a").alias("__a"))
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), _plain(text).alias("t")).withColumn("k", F.sha2("t", 256))
    wide = wide.join(broadcast_if_small(added), F.col("k") == F.col("__h"), "left")
    wide = base(wide, "t", "b").withColumn("s", _all_spans(F.col("b"), F.col("__a")))
    new = F.when(F.col(f"r.`{text}`").isNotNull(), S.replaced(F.col("t"), F.col("s"), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">"))))
    return wide.select(*[new.alias(c) if c == text else F.col(f"r.`{c}`").alias(c) for c in df.columns])


def digest(scanned: DataFrame, key: str = "doc_id", spans: str = "pii") -> DataFrame:
    """Counts per base kind, the checksum of the base spans, and all spans as text."""
    found = F.filter(F.col(spans), lambda s: s["rank"] < 4)
    return scanned.select(
        key,
        *[S.count(F.col(spans), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(S.digest(found), 256).alias("base_sha256"),
        S.digest(F.col(spans)).alias("spans"),
    )

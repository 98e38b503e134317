"""Quality rules with cutoffs whose false rejections are bounded by labelled rows.

A rule rejects a text when a ratio of counts lies over a cutoff. In every
stratum the labelled good rows are a holdout: for each rule the cutoffs are
tried from the most lenient to the strictest, and a cutoff stays in force while
the exact binomial tail shows that it rejects no more than its share of good
rows. Trying in a fixed order and stopping at the first failure needs no
correction within a rule; over rules and strata the error is divided
(Bonferroni), and the allowed rejections are divided over the rules, so that with
probability ``1 - ERROR`` no stratum loses more than ``LIMIT`` of its good rows.

The cutoffs are fixed beforehand, so every labelled row is a holdout row. A
stratum with too few of them for a proof has no cutoff and rejects nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, stage
from . import words as W
from .rows import with_result

#: Share of the good rows of a stratum that all rules together may reject, and the probability that any stratum loses more.
LIMIT, ERROR = 0.02, 0.05
#: Words of a window whose repetition counts.
WINDOW = 5
#: Rules: what is counted, and of what.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "shouts": ("n_shouts", "n_words"),
}
#: Cutoffs in thousandths, the most lenient first.
CUTOFFS = (900, 700, 500, 400, 300, 200, 150, 100, 70, 50)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")
SIGNALS = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS])


def _earlier(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of what has an equal before it in its row, and of what has an equal at all."""
    order = np.lexsort((h, row))
    same = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    later, shared = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return later, shared


def count(column: pa.Array) -> pa.StructArray:
    """The counts of each text; letters count as they are written, a null text as an empty one."""
    w = W.words(column, fold=False)
    n = len(column)

    def by_row(marks: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return upto[w.row_start[1:]] - upto[w.row_start[:-1]]

    gap = (w.data == 32) | ((w.data >= 9) & (w.data <= 13))
    # Lines end at a line feed and at the end of their row; one without a word is none.
    breaks = np.unique(np.concatenate([np.flatnonzero(w.data == 10) + 1, w.row_start])) if len(w.data) else np.zeros(1, np.int64)
    start, end = breaks[:-1], breaks[1:]
    end = np.where(w.data[end - 1] == 10, end - 1, end) if len(end) else end
    holds = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[holds], end[holds]
    row = np.searchsorted(w.row_start, start, side="right") - 1
    again, _ = _earlier(row, W.hash_spans(w.data, start, end))

    window_row, at, h = W.windows(w, WINDOW, whole=False)
    _, shared = _earlier(window_row, h)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at[shared], 1)
    np.add.at(cover, at[shared] + WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0

    n_words = np.diff(w.first)
    found = {
        "n_words": n_words,
        "word_chars": by_row(~gap & ((w.data & 0xC0) != 0x80)),
        "n_symbols": by_row(_SYMBOL[w.data]),
        "n_dup_lines": np.bincount(row[again], minlength=n),
        "n_repeat_words": np.bincount(w.row[repeated], minlength=n),
        "n_lines": np.bincount(row, minlength=n),
        "n_upper": by_row((w.data >= 65) & (w.data <= 90)),
        "n_shouts": by_row(w.data == 33),
    }
    return pa.StructArray.from_arrays([pa.array(found[c].astype(np.int64)) for c in _COUNTS], names=list(_COUNTS))


def signals(df: DataFrame, text: str = "text", out: str = "signals", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``out``, the counts of each text."""
    return with_result(df, text, out, SIGNALS, count, keep)


def base_failed(signals: Column) -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (signals["n_words"] < 10) | (100 * signals["n_repeat_words"] > 20 * signals["n_words"])


def exceeds(signals: Column, rule: str, cutoff: Column) -> Column:
    of, per = RULES[rule]
    return 1000 * signals[of] > cutoff * signals[per]


def binomial_tail(n: int, k: int, share: float) -> float:
    """The probability of at most ``k`` rejections among ``n`` rows each rejected with probability ``share``."""
    if k >= n * share:
        return 1.0
    i = np.arange(k)
    logs = n * np.log1p(-share) + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + np.log(share) - np.log1p(-share))])
    return float(np.exp(logs - logs.max()).sum() * np.exp(logs.max()))


def certified(labelled: DataFrame, stratum: str, good: Column, limit: float = LIMIT, error: float = ERROR, signals: str = "signals", cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """``stratum`` and a column of each rule with its strictest proven cutoff, null without one: a row per stratum with good rows.

    Labels are grouped to counts before anything leaves its partition, so a
    stratum with most of the rows is one row per task. Null is a stratum too.
    """
    share = limit / len(RULES)
    rows = labelled.filter(good).select(F.col(f"`{stratum}`").alias("stratum"), F.col(signals).alias("s"))
    counts = [F.sum(exceeds(F.col("s"), rule, F.lit(c)).cast("long")) for rule in RULES for c in cutoffs]
    grouped = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*counts).alias("k"))
    strata = grouped.select(F.count("*")).first()[0]
    per_test = error / max(strata * len(RULES), 1)
    width = len(cutoffs)

    @F.pandas_udf("array<int>")
    def strictest(n: pd.Series, k: pd.Series) -> pd.Series:
        def of(n: int, k: np.ndarray) -> list[int | None]:
            out: list[int | None] = []
            for at in range(0, len(k), width):
                best = None
                for cutoff, rejected in zip(cutoffs, k[at : at + width], strict=True):
                    if binomial_tail(int(n), int(rejected), share) > per_test:
                        break
                    best = cutoff
                out.append(best)
            return out

        return pd.Series([of(a, b) for a, b in zip(n, k, strict=True)])

    found = grouped.select("stratum", strictest("n", "k").alias("c"))
    return found.select("stratum", *[F.col("c")[i].alias(rule) for i, rule in enumerate(RULES)])


def judged(counted: DataFrame, cutoffs: DataFrame, stratum: str, signals: str = "signals", out: str = "verdict") -> DataFrame:
    """``counted`` with ``out``, whether no certified cutoff of its stratum rejects the row. A column of that name is replaced."""
    rows = counted.select(F.struct(*[F.col(f"`{c}`") for c in counted.columns if c != out]).alias("row"))
    beside = rows.join(broadcast_if_small(cutoffs), F.col("row")[stratum].eqNullSafe(F.col("stratum")), "left")
    rejected = [F.coalesce(exceeds(F.col("row")[signals], rule, F.col(rule)), F.lit(False)) for rule in RULES]
    some = rejected[0]
    for r in rejected[1:]:
        some = some | r
    return beside.select("row.*", (~some).alias(out))


def rules(df: DataFrame, labels: DataFrame, good: Column, key: str = "doc_id", text: str = "text", stratum: str = "lang", label_key: str = "doc_id", limit: float = LIMIT, error: float = ERROR) -> DataFrame:
    """``key``, ``signals``, ``base_failed``, ``verdict`` and ``kept`` of every row.

    A null or empty text has no words, so it fails the base rules. A key with
    several labels counts once, as good only if all of its labels are; rows of
    one key are holdout rows each; labels without key or row are left out. An
    empty table gives an empty one, and without labels no rule rejects anything.
    """
    slim = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{stratum}`").alias("stratum"), F.col(f"`{text}`").alias("t"))
    counted = stage(signals(slim, "t", keep=["k", "stratum"]), "quality-signals")
    marks = labels.filter(F.col(f"`{label_key}`").isNotNull()).groupBy(F.col(f"`{label_key}`").alias("k")).agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
    found = certified(counted.join(marks, "k"), "stratum", F.col("good"), limit, error)
    done = judged(counted, stage(found, "quality-cutoffs"), "stratum")
    failed = base_failed(F.col("signals"))
    return done.select(F.col("k").alias(key), "signals", failed.alias("base_failed"), "verdict", (~failed & F.col("verdict")).alias("kept"))

"""Quality rules whose cutoffs carry a bound on false rejection.

Only DataFrame expressions.  Each rule rejects documents from a cutoff of one
statistic on, and has as many cutoffs as the others: step i takes every rule's
i-th cutoff, and later steps are stricter.  In every stratum the labelled good
documents test the steps from the mildest on; a step is taken while the exact
binomial test shows, at the corrected level, that its rules together reject at most
the allowed share of good documents, and the first failure ends the sequence.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.llm.scratch import Scratch

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Rules: statistic as (numerator, denominator) of the base columns, and its
# cutoffs from the mildest to the strictest, one for each step.
RULES = {
    "symbols": ("n_symbols", "n_words", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "repeated_words": ("n_repeat_words", "n_words", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3]),
    "duplicate_lines": ("n_dup_lines", "n_lines", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3]),
    "word_length": ("word_chars", "n_words", [60.0, 40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0]),
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text."""

    def covered(places: Column) -> Column:
        """Words under windows that start at these ascending places."""
        gaps = F.zip_with(F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(places) == 0, 0).otherwise(3 + F.aggregate(gaps, F.lit(0), lambda s, g: s + g))

    def twice(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        same = lambda rows, x, j: F.coalesce(F.get(rows, j)["w"] == x["w"], F.lit(False))
        shared = lambda rows: F.filter(rows, lambda x, k: same(rows, x, k - 1) | same(rows, x, k + 1))
        return _let(_let(ordered, lambda rows: F.array_sort(F.transform(shared(rows), lambda x: x["i"]))), covered)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    count = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(twice(w)))
    return F.when(F.size(words) < 4, 0).otherwise(count)


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text without null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words")))
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "counted": counted,
        "line_counts": line_counts,
        "word_chars": F.char_length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series at x + 8."""
    y = x + 8.0
    inverse = 1.0 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    below = reduce(lambda a, b: a + b, (F.ln(x + float(i)) for i in range(8)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - below


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), where k < n p; 1 elsewhere.

    The probability of k, times the sum of ratios going down from it; terms
    beyond ten standard deviations add nothing in double precision.
    """
    kd, nd = k.cast("double"), n.cast("double")
    log_p = log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * math.log(p) + (nd - kd) * math.log1p(-p)
    steps = F.least(k, F.ceil(F.sqrt(nd * p * (1 - p)) * 10).cast("long") + 50)
    odds = (1 - p) / p
    down = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, j: _let(s["term"] * (kd - j + 1) / (nd - kd + j) * odds, lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))),
        lambda s: s["sum"],
    )
    return F.when(kd < nd * p, F.exp(log_p) * down).otherwise(1.0)


def _statistic(top: str, bottom: str) -> Column:
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")), F.lit(0.0))


def _reaches(rules: dict, step: int) -> Column:
    """Whether some rule's statistic reaches its cutoff at this step."""
    return reduce(lambda x, y: x | y, (_statistic(a, b) >= F.lit(float(cuts[step])) for a, b, cuts in rules.values()))


def certified_steps(stats: DataFrame, good: DataFrame, risk: float, delta: float, rules: dict = RULES) -> DataFrame:
    """(stratum, step, n_good, n_rejected) for the strata of which some step is certified.

    stats: doc_id, stratum, digest and base columns; good: doc_id of labelled
    good documents, each once.  Copies of a text are no independent trials, so a
    stratum counts each digest once.  ``risk`` is the allowed share of good
    documents that the rules of a step reject together; with probability 1 -
    delta it holds in all strata at once, by Bonferroni's correction over strata and
    fixed-sequence testing within a stratum.  Without any rejected, a stratum needs
    ln(delta / strata) / ln(1 - risk) good documents.
    """
    steps = range(len(next(iter(rules.values()))[2]))
    if any(len(cuts) != len(steps) for _, _, cuts in rules.values()):
        raise ValueError("all rules need the same number of cutoffs")
    held = stats.join(good, "doc_id").dropDuplicates(["stratum", "digest"])
    wide = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum(_reaches(rules, i).cast("long")).alias(f"k{i}") for i in steps))
    strata = F.count("*").over(Window.partitionBy())  # of one row for each stratum
    tests = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("k")) for i in steps)))
    long = wide.withColumn("strata", strata).select("stratum", "n", "strata", tests.alias("t")).select("stratum", "n", "strata", "t.*")
    failed = binomial_tail(F.col("k"), F.col("n"), risk) > delta / F.col("strata")
    ends = long.withColumn("failed", failed).groupBy("stratum").agg(F.coalesce(F.min(F.when(F.col("failed"), F.col("i"))), F.lit(len(steps))).alias("end"), F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("i", "k"))).alias("k"))
    return ends.where("end > 0").select("stratum", (F.col("end") - 1).alias("step"), F.col("n").alias("n_good"), F.col("k")[F.col("end") - 1].alias("n_rejected"))


def apply_quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    stratum: Column | None = None,
    risk: float = 0.04,
    delta: float = 0.05,
    rules: dict = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """Base columns, base_failed and kept of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text.  base_failed: fewer than
    50 words, or more than half of them in repeated 3-word windows.  kept is
    false if base_failed or if a rule's statistic reaches its cutoff at the last step
    certified in the row's stratum (``lang`` unless given; null is a stratum
    '').  In a stratum without a certified step, as where good labels are too
    few, the rules reject nothing.

    Returns one row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, n_lines (lines with a
    word), rejected_by (rules, joined by commas).  Null and empty texts have no
    words and fail.  Labelled ids with value 1 are the good holdouts, ids with
    several labels by their least; rows that repeat an id each count.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "quality_rules")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = F.coalesce((F.col("lang") if stratum is None else stratum).cast("string"), F.lit(""))
    stats = docs.select(F.col(id_col).cast("long").alias("doc_id"), kind.alias("stratum"), F.md5(text).alias("digest"), *(c.alias(n) for n, c in base_columns(text).items()))
    stats = scratch.save(stats.select("doc_id", "stratum", "digest", "counted.n_words", "word_chars", "n_symbols", "line_counts.n_dup_lines", "counted.n_repeat_words", "line_counts.n_lines"), "stats")
    good = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("y")).where("y = 1").select("doc_id")
    steps = scratch.save(certified_steps(stats, good, risk, delta, rules).select("stratum", "step"), "steps")
    out = stats.join(steps, "stratum", "left")
    cutoff = {r: F.get(F.array(*(F.lit(float(c)) for c in cuts)), F.col("step")) for r, (_, _, cuts) in rules.items()}
    hits = F.filter(F.array(*(F.when(_statistic(a, b) >= cutoff[r], F.lit(r)) for r, (a, b, _) in rules.items())), lambda x: x.isNotNull())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("rejected_by", F.array_join(hits, ","))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~failed & (F.col("rejected_by") == "")).alias("kept"), "n_lines", "rejected_by")

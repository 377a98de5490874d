"""Reliability curves by isotonic regression, and score decompositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecal.functions import scores as S
from scorecal.operators.curves import apply_linear, apply_step
from scorecal.operators.isotonic import pav_blocks, pav_fit, step_knots
from scorecal.operators.keep import kept
from scorecal.operators.ties import By, join_by, tie_table


def reliability_curve(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None, by: By = ()) -> DataFrame:
    """(by, x, cep, weight): the calibrated probability at each distinct score."""
    fit = pav_fit(tie_table(df, score, label, weight, by), by)
    return fit.select(*by, "x", F.col("z").alias("cep"), F.col("w").alias("weight"))


def recalibrated(df: DataFrame, curve: DataFrame, score: str = "score", output: str = "cep", by: By = (), step: bool = False) -> DataFrame:
    """df with the curve's value at its scores: lines between distinct scores, or steps."""
    knots = curve.select(*by, "x", F.col("cep").alias("y"))
    return (apply_step if step else apply_linear)(df, knots, score, output, by)


def _total(kind: str, p: Column) -> Column:
    """Summed score of a tie group at forecast p, from w and wy."""
    w, wy = F.col("w"), F.col("wy")
    if kind == "brier":
        return w * p * p - 2 * wy * p + wy
    if kind == "log":
        q = S.clipped(p)
        return -(wy * F.ln(q) + (w - wy) * F.ln(1 - q))
    raise ValueError(f"score must be brier or log, not {kind!r}")


def score_decomposition(df: DataFrame, score: str = "score", label: str = "label", kind: str = "brier", weight: str | None = None, by: By = (), ties: DataFrame | None = None) -> DataFrame:
    """(by, mean_score, mcb, dsc, unc), where mean_score = mcb - dsc + unc.

    Both scores are linear in a 0/1 label, so the mean score is a sum over the
    tie table and the calibrated one a sum over the isotonic blocks.  ``ties``
    may hand in a tie table.
    """
    t = kept(tie_table(df, score, label, weight, by) if ties is None else ties)
    own = t.groupBy(*by).agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"), F.sum(_total(kind, F.col("x"))).alias("_s"))
    fit = pav_blocks(t, by).groupBy(*by).agg(F.sum(_total(kind, F.col("value"))).alias("_z"))
    base = _total(kind, F.col("wy") / F.col("w"))
    means = join_by(own, fit, by).select(*by, *((c / F.col("w")).alias(n) for c, n in ((F.col("_s"), "mean_score"), (F.col("_z"), "_calibrated"), (base, "unc"))))
    return means.select(*by, "mean_score", (F.col("mean_score") - F.col("_calibrated")).alias("mcb"), (F.col("unc") - F.col("_calibrated")).alias("dsc"), "unc")


def isotonic_knots(ties: DataFrame, by: By = ()) -> DataFrame:
    return step_knots(pav_blocks(ties, by), by)

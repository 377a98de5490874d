"""The tables behind calibration plots; drawing is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.functions import scores as S
from scorecal.operators.corp import reliability_curve, score_decomposition
from scorecal.operators.metrics import bin_sensitivity, sweep_error
from scorecal.operators.resample import resampling_bands
from scorecal.operators.ties import By, tie_table, with_ranks


def reliability_diagram(df: DataFrame, score: str = "score", label: str = "label", bands: str | None = None, **how) -> DataFrame:
    """The curve and, if asked, its band at each score."""
    curve = reliability_curve(df, score, label)
    return curve.join(resampling_bands(df, bands, score=score, label=label, **how), "x", "left") if bands else curve


def score_histogram(df: DataFrame, score: str = "score", n_bins: int = 30, weight: str | None = None, by: By = ()) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    return df.groupBy(*by, S.uniform_bin(F.col(score), n_bins).alias("bin")).agg(F.sum(w).alias("mass"))


def mcb_dsc_plane(df: DataFrame, by: By, **columns) -> DataFrame:
    """A point for each forecaster."""
    return score_decomposition(df, by=by, **columns).select(*by, "dsc", "mcb", "mean_score", "unc")


def resolution_frontier(df: DataFrame, by: By, score: str = "score", label: str = "label") -> DataFrame:
    """(by, n_distinct, brier) of each method's outputs."""
    return df.groupBy(*by).agg(F.count_distinct(score).alias("n_distinct"), F.avg(S.brier(F.col(score), F.col(label))).alias("brier"))


def map_on_grid(model, points: int = 500) -> DataFrame:
    """A fitted map on an even grid of [0, 1], per segment."""
    spark = model.knots.sparkSession
    grid = spark.range(points).select((F.col("id") / (points - 1)).alias("x"))
    if model.by:
        grid = grid.crossJoin(model.knots.select(*model.by).distinct())
    return model.transform(grid, "x", "y")


def ece_bin_sensitivity(df: DataFrame, bins: range = range(2, 51), by: By = ()) -> DataFrame:
    ranked = with_ranks(tie_table(df, by=by), by)
    found, line = bin_sensitivity(df, bins, by=by, ranked=ranked).select(*by, "n_bins", "plugin", "debiased"), sweep_error(df, by=by, ranked=ranked)
    return found.join(line, list(by)) if by else found.crossJoin(line)

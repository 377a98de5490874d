"""Calibration of probability vectors, class by class and by the top class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.operators.corp import reliability_curve, score_decomposition
from scorecal.operators.metrics import equal_mass_errors, sweep_error
from scorecal.operators.ties import By


def checked_matrix(df: DataFrame, probabilities: str = "probabilities", label: str = "label") -> DataFrame:
    """Fails at run time on vectors that are no distribution, or labels outside them."""
    p, y = F.col(probabilities), F.col(label)
    ok = F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0)) & (F.abs(F.aggregate(p, F.lit(0.0), lambda s, v: s + v) - 1) <= 2e-8)
    ok = ok & (y >= 0) & (y < F.size(p)) & (y == F.floor(y))
    return df.withColumn(probabilities, F.when(ok, p).otherwise(F.raise_error(F.lit("not a probability vector, or a label outside it")).cast("array<double>")))


def one_vs_rest(df: DataFrame, probabilities: str = "probabilities", label: str = "label", by: By = ()) -> DataFrame:
    """(by, class, score, label): each row once for each class; vectors and labels are checked."""
    rows = checked_matrix(df, probabilities, label).select(*by, F.col(label).cast("int").alias("_y"), F.posexplode(probabilities).alias("class", "score"))
    return rows.select(*by, "class", "score", (F.col("class") == F.col("_y")).cast("double").alias("label"))


def classwise_decomposition(df: DataFrame, kind: str = "brier", probabilities: str = "probabilities", label: str = "label", by: By = ()) -> DataFrame:
    return score_decomposition(one_vs_rest(df, probabilities, label, by), kind=kind, by=[*by, "class"])


def classwise_reliability(df: DataFrame, probabilities: str = "probabilities", label: str = "label", by: By = ()) -> DataFrame:
    return reliability_curve(one_vs_rest(df, probabilities, label, by), by=[*by, "class"])


def _error(rows: DataFrame, by: By, n_bins: int, estimator: str) -> DataFrame:
    if estimator == "debiased":
        return equal_mass_errors(rows, n_bins=n_bins, by=by).select(*by, F.col("debiased").alias("ece"))
    if estimator == "sweep":
        return sweep_error(rows, by=by).select(*by, F.col("sweep_ece").alias("ece"))
    raise ValueError("estimator must be debiased or sweep")


def classwise_ece(df: DataFrame, n_bins: int = 15, estimator: str = "debiased", probabilities: str = "probabilities", label: str = "label", by: By = ()) -> DataFrame:
    """Mean over classes of each class's error against the rest."""
    own = _error(one_vs_rest(df, probabilities, label, by), [*by, "class"], n_bins, estimator)
    return own.groupBy(*by).agg(F.avg("ece").alias("classwise_ece"))


def top_label_ece(df: DataFrame, n_bins: int = 15, estimator: str = "debiased", probabilities: str = "probabilities", label: str = "label", by: By = ()) -> DataFrame:
    """Error of the largest probability as confidence in the first class that has it."""
    df = checked_matrix(df, probabilities, label)
    top = F.array_max(probabilities)
    right = (F.array_position(probabilities, top) - 1 == F.col(label)).cast("double")
    rows = df.select(*by, top.alias("score"), right.alias("label"))
    return _error(rows, by, n_bins, estimator).select(*by, F.col("ece").alias("top_label_ece"))


def miscalibration_profile(df: DataFrame, probabilities: str = "probabilities", label: str = "label") -> DataFrame:
    """One row: mean_mcb, spread (deviation over mean), worst (classes by falling mcb), reading."""
    own = classwise_decomposition(df, "brier", probabilities, label)
    out = own.agg(F.avg("mcb").alias("mean_mcb"), F.stddev_pop("mcb").alias("_sd"), F.sort_array(F.collect_list(F.struct((-F.col("mcb")).alias("m"), "class"))).alias("_o"))
    spread = F.when(F.col("mean_mcb") > 2.3e-16, F.col("_sd") / F.col("mean_mcb")).otherwise(0.0)
    out = out.select("mean_mcb", spread.alias("spread"), F.transform("_o", lambda v: v["class"]).alias("worst"))
    reading = F.when(F.col("mean_mcb") <= 1e-6, "none").when(F.col("spread") <= 0.25, "global").otherwise("per class")
    return out.withColumn("reading", reading)

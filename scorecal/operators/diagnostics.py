"""Plateaus of calibrated outputs, learning curves and the one-row report."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.functions import kernels
from scorecal.operators.close import with_close_runs
from scorecal.operators.corp import score_decomposition
from scorecal.operators.metrics import basic_metrics, equal_mass_errors, smooth_error, sweep_error
from scorecal.operators.resample import bootstrap_ci
from scorecal.operators.keep import kept
from scorecal.operators.ranges import Stretches, running, with_neighbours
from scorecal.operators.ties import By, join_by, tie_table, with_ranks


def plateaus(df: DataFrame, score: str = "score", calibrated: str = "calibrated", label: str | None = None, min_width: int = 2, by: By = (), rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Runs of ``min_width`` or more rows along the score with outputs within ``atol + rtol * |value|`` of their first one.

    (by, plateau_id, x_lo, x_hi, value, width, label_var, density): density is very_sparse
    under 5 rows, sparse under 10, else adequate.  Runs are found on distinct
    (score, output) cells; with both tolerances 0 outputs must be equal.
    """
    y = F.col(label).cast("double") if label else F.lit(None).cast("double")
    cells = df.groupBy(*by, F.col(score).cast("double").alias("x"), F.col(calibrated).cast("double").alias("z")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    cells = kept(cells)
    stretches = Stretches(cells.select("x"))
    if rtol or atol:
        new = with_close_runs(cells, "z", ["x", "z"], stretches, rtol, atol, by).withColumn("z", F.col("_anchor")).drop("_anchor")
    else:
        near = with_neighbours(stretches.of(cells, "x"), F.col("z"), by, ["x", "z"])
        new = kept(near.withColumn("_new", F.coalesce((F.col("z") != F.col("before")).cast("int"), F.lit(0))).drop("before", "after", "_part"))
    runs = running(new, {"run": F.col("_new")}, by, ["x", "z"], stretches)
    m = F.sum("s") / F.sum("n")
    out = runs.groupBy(*by, "run").agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.first("z").alias("value"), F.sum("n").alias("width"), F.greatest(F.sum("q") / F.sum("n") - m * m, F.lit(0.0)).alias("label_var"))
    wide = kept(out.where(F.col("width") >= min_width))
    out = running(wide, {"_count": F.lit(1)}, by, "run").withColumn("plateau_id", (F.col("_count") - 1).cast("int"))
    density = F.when(F.col("width") < 5, "very_sparse").when(F.col("width") < 10, "sparse").otherwise("adequate")
    return out.select(*by, "plateau_id", "x_lo", "x_hi", "value", "width", "label_var", density.alias("density"))


def plateau_warnings(found: DataFrame, by: By = ()) -> DataFrame:
    """Text for the thin plateaus."""
    thin = F.when(F.col("density") == "very_sparse", F.format_string("Plateau %d has only %d samples - may be unreliable", F.col("plateau_id") + 1, "width"))
    thin = thin.when(F.col("density") == "sparse", F.format_string("Plateau %d has %d samples - consider collecting more data in this range", F.col("plateau_id") + 1, "width"))
    return found.select(*by, thin.alias("warning")).where("warning is not null")


def plateau_quality(df: DataFrame, score: str = "score", calibrated: str = "calibrated", label: str = "label", by: By = ()) -> DataFrame:
    """Mean over plateaus of exp(-label variance - distance of the width from a tenth of all rows); 1 without any."""
    found = plateaus(df, score, calibrated, label, by=by)
    n = df.groupBy(*by).agg((F.count("*") * 0.1).alias("tenth"))
    rows = join_by(n, found, by, "left")
    one = F.exp(-F.col("label_var") - F.abs(F.col("width") - F.col("tenth")) / F.col("tenth"))
    return rows.groupBy(*by).agg(F.coalesce(F.avg(one), F.lit(1.0)).alias("plateau_quality"))


def change_positions(df: DataFrame, score: str = "score", calibrated: str = "calibrated", precision: int = 6, by: By = ()) -> DataFrame:
    """Scores where the rounded output changes."""
    cells = df.groupBy(*by, F.col(score).alias("x")).agg(F.bround(F.min(calibrated), precision).alias("z"))
    cells = kept(cells)
    near = with_neighbours(Stretches(cells.select("x")).of(cells, "x"), F.col("z"), by)
    return near.where(F.col("before").isNull() | (F.col("before") != F.col("z"))).select(*cells.columns)


def learning_curve(df: DataFrame, key: list[str], sizes: list[int], n_trials: int = 10, seed: int = 0, score: str = "score", label: str = "label") -> DataFrame:
    """(size, trials, diversity, diversity_sd): distinct share of isotonic outputs on samples.

    A trial's sample is the rows of the ``size`` smallest hashes of key and trial.
    """
    trials = df.withColumn("trial", F.explode(F.array(*map(F.lit, range(n_trials)))))
    top = max(sizes)
    h = F.xxhash64(*key, F.lit(seed), "trial")
    total = df.count()
    share = min(1.0, 2.0 * top / max(total, 1) + 1e-4)
    while True:  # wide enough for every trial: one pass, seldom two
        near = trials.withColumn("h", F.pmod(h, F.lit(1 << 30))).where(F.col("h") < F.lit(int((1 << 30) * share)))
        held = {r["trial"]: r["count"] for r in near.groupBy("trial").count().collect()} if share < 1 else {}
        if share == 1 or all(held.get(t, 0) >= min(top, total) for t in range(n_trials)):
            break
        share = min(1.0, 2 * share)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("trial").orderBy("h", *key)))
    rows = ranked.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("r <= size")
    own = ["size", "trial"]

    def distinct(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        return pd.DataFrame({"size": pdf["size"].iloc[:1], "trial": pdf["trial"].iloc[:1], "d": [len(np.unique(kernels.pava(pdf["y"].to_numpy(), pdf["w"].to_numpy()))) / pdf["n"].sum()]})

    each = tie_table(rows, score, label, by=own).groupBy(*own).applyInPandas(distinct, "size int, trial int, d double")
    return each.groupBy("size").agg(F.count("*").alias("trials"), F.avg("d").alias("diversity"), F.stddev_pop("d").alias("diversity_sd"))


def calibration_report(df: DataFrame, score: str = "score", label: str = "label", n_bins: int = 15, by: By = (), ci: bool = False, **how) -> DataFrame:
    """Everything in one row per segment, from one tie table.

    n, base_rate, mean_prediction, bias, brier, mcb, dsc, unc, smece, smece_sigma, debiased_ece,
    plugin_ece, sweep_ece, sweep_bins, n_bins, n_distinct, distinct_ratio and,
    with ``ci`` and no segments, intervals for brier, smece and debiased_ece.
    """
    ties = kept(tie_table(df, score, label, by=by))
    ranked = with_ranks(ties, by)
    rows = ties.select(*by, F.col("x").alias("score"), "n", "wy")
    base = rows.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("wy") / F.sum("n")).alias("base_rate"), (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_prediction"), F.count("*").alias("n_distinct"))
    base = base.withColumn("bias", F.col("mean_prediction") - F.col("base_rate")).withColumn("distinct_ratio", F.col("n_distinct") / F.col("n")).withColumn("n_bins", F.lit(n_bins))
    parts = [
        base,
        score_decomposition(df, by=by, ties=ties).withColumnRenamed("mean_score", "brier"),
        smooth_error(df, by=by, ties=ties).withColumnRenamed("sigma", "smece_sigma"),
        equal_mass_errors(df, n_bins=n_bins, by=by, ranked=ranked).select(*by, F.col("debiased").alias("debiased_ece"), F.col("plugin_l2").alias("plugin_ece")),
        sweep_error(df, score, label, by=by, ranked=ranked),
    ]
    out = reduce(lambda a, b: join_by(a, b, by), parts)
    if ci and not by:
        found = bootstrap_ci(df, ["brier", "smece", "debiased_ece"], score=score, label=label, **how)
        packed = found.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct(*[c for c in found.columns if c != "metric"])))).alias("intervals"))
        out = out.crossJoin(packed)
    return out


def report_text(row) -> str:
    """A report row as a text block."""
    d = row.asDict()
    lines = [f"Calibration of {d['n']} rows, base rate {d['base_rate']:.4f}, mean prediction {d['mean_prediction']:.4f}"]
    lines += [f"  {k:<14}{d[k]:.6f}" for k in ("bias", "brier", "mcb", "dsc", "unc", "smece", "smece_sigma", "debiased_ece", "plugin_ece", "sweep_ece", "distinct_ratio")]
    return "\n".join(lines)


__all__ = ["basic_metrics", "calibration_report", "change_positions", "learning_curve", "plateau_quality", "plateau_warnings", "plateaus", "report_text"]

"""Summaries of a benchmark grid: cells of (dataset, model, seed, method) with measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarise(rows: DataFrame, measures: list[str], keys: tuple[str, ...] = ("dataset", "model", "method")) -> DataFrame:
    """Means of finite values per cell, over seeds, rounded to 6 decimals, and n_seeds."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c))
    return rows.groupBy(*keys).agg(F.count_distinct("seed").alias("n_seeds"), *(F.round(F.avg(finite(m)), 6).alias(m) for m in measures))


def incomplete(rows: DataFrame, seeds: int, keys: tuple[str, ...] = ("dataset", "model", "method"), worst: int = 5) -> DataFrame:
    """The cells with the fewest seeds, of those with too few."""
    return rows.groupBy(*keys).agg(F.count_distinct("seed").alias("n_seeds")).where(F.col("n_seeds") < seeds).orderBy("n_seeds", *keys).limit(worst)


def against_baseline(rows: DataFrame, baseline: str, measure: str = "brier", cell: tuple[str, ...] = ("dataset", "model"), lower_is_better: bool = True) -> DataFrame:
    """(cell, seed, method, delta): the baseline's measure less the method's on the same seed; positive is better."""
    base = rows.where(F.col("method") == baseline).select(*cell, "seed", F.col(measure).alias("_base"))
    sign = 1 if lower_is_better else -1
    return rows.where(F.col("method") != baseline).join(base, [*cell, "seed"]).select(*cell, "seed", "method", (sign * (F.col("_base") - F.col(measure))).alias("delta"))


def paired_intervals(deltas: DataFrame, cell: tuple[str, ...] = ("dataset", "model"), resamples: int = 2000, seed: int = 0) -> DataFrame:
    """(cell, method, n_seeds, delta, lower, upper, wins, beats) with bootstrap intervals over seeds."""
    keys = [*cell, "method"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.sort(pdf["delta"].to_numpy())
        draws = np.random.Generator(np.random.PCG64(seed)).choice(d, (resamples, len(d))).mean(axis=1)
        lo, hi = np.percentile(draws, [2.5, 97.5])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n_seeds": len(d), "delta": d.mean(), "lower": lo, "upper": hi, "wins": int((d > 0).sum()), "beats": bool(lo > 0)}])

    types = "".join(f"`{k}` {deltas.schema[k].dataType.simpleString()}, " for k in keys)
    return deltas.groupBy(*keys).applyInPandas(run, types + "n_seeds long, delta double, lower double, upper double, wins int, beats boolean")

"""An incremental calibration monitor; an extension, since tie tables add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.functions import scores as S


def windowed_bins(stream: DataFrame, time: str = "ts", score: str = "score", label: str = "label", window: str = "1 day", late: str = "1 hour", n_bins: int = 10) -> DataFrame:
    """(window_start, bin, n, sum_score, sum_label); the state is n_bins rows a window."""
    total = lambda c: F.sum(F.col(c).cast("double"))
    rows = stream.withColumn("_t", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        rows = rows.withWatermark("_t", late)
    binned = rows.groupBy(F.window("_t", window).alias("w"), S.uniform_bin(F.col(score), n_bins).alias("bin"))
    return binned.agg(F.count("*").alias("n"), total(score).alias("sum_score"), total(label).alias("sum_label")).select(F.col("w.start").alias("window_start"), "bin", "n", "sum_score", "sum_label")


def window_errors(bins: DataFrame) -> DataFrame:
    """ece of each closed window."""
    gap = F.abs(F.col("sum_score") - F.col("sum_label"))
    return bins.groupBy("window_start").agg((F.sum(gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))

"""Applying piecewise maps kept as knots (by, x, y): an as-of join of rows with the last knot at or below their score.

Knots up to ``SENT`` rows, which are counted first, go to every task, where
rows find theirs by bisection, and no row moves.  More are merged with the
rows in stretches of the axis, cut at quantiles of both: each stretch is
sorted once, knots and rows together, and gets the last knot before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.operators.ranges import STRETCH, Stretches
from scorecal.operators.ties import By, join_by

SENT = 1 << 20  # knots, of 16 bytes


class Bisection:
    """Sorted knots of several maps, end to end."""

    def __init__(self, x: np.ndarray, y: np.ndarray, starts: np.ndarray):
        self.x, self.y, self.starts, self.ends = x, y, starts, np.append(starts[1:], len(x))

    def last_at(self, which: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The place of the last knot at or below each score, or one before the map's first."""
        if len(self.starts) == 1:
            return np.searchsorted(self.x, score, side="right") - 1
        lo, hi = self.starts[which].copy(), self.ends[which].copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            right = open_ & (self.x[np.minimum(mid, len(self.x) - 1)] <= score)
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        return lo - 1

    def value(self, which: np.ndarray, score: np.ndarray, step: bool) -> np.ndarray:
        at = self.last_at(which, score)
        first, last = self.starts[which], self.ends[which] - 1
        lo = np.maximum(at, first)
        if step:
            return self.y[lo]
        hi = np.minimum(at + 1, last)
        with np.errstate(invalid="ignore", divide="ignore"):
            part = np.where((at < first) | (hi == lo), 0.0, (score - self.x[lo]) / (self.x[hi] - self.x[lo]))
        return self.y[lo] + (self.y[hi] - self.y[lo]) * part


def _sent(df: DataFrame, knots: DataFrame, score: str, output: str, by: By, step: bool) -> DataFrame:
    """Every task gets all knots, whose number has been checked."""
    spark = df.sparkSession
    if by:
        maps = knots.select(*by).distinct().collect()
        maps = spark.createDataFrame([(*r, i) for i, r in enumerate(maps)], knots.select(*by, F.lit(0).alias("_map")).schema)
        sorted_ = join_by(knots, maps, by).select("_map", "x", "y").toArrow().to_pandas().sort_values(["_map", "x"])
        starts = np.searchsorted(sorted_["_map"].to_numpy(), np.arange(sorted_["_map"].nunique()))
        rows = join_by(df, F.broadcast(maps), by, "left")  # a row for each map
    else:
        sorted_, starts, rows = knots.select("x", "y").toArrow().to_pandas().sort_values("x"), np.zeros(1, int), df.withColumn("_map", F.lit(0))
    known = spark.sparkContext.broadcast(Bisection(sorted_["x"].to_numpy(float), sorted_["y"].to_numpy(float), starts))

    @F.pandas_udf("double")
    def found(which: pd.Series, at: pd.Series) -> pd.Series:
        ok = (which.notna() & at.notna()).to_numpy()
        out = np.full(len(at), np.nan)
        if ok.any() and len(known.value.x):
            out[ok] = known.value.value(which[ok].to_numpy(int), at[ok].to_numpy(float), step)
        return pd.Series(out)

    return rows.withColumn(output, found("_map", F.col(score).cast("double"))).drop("_map")


def merged(df: DataFrame, knots: DataFrame, score: str, output: str, by: By, step: bool, rows: int = STRETCH) -> DataFrame:
    """The same by a sorted merge of rows and knots, for any number of knots."""
    stretches = Stretches(knots.select("x"), df.select(score), rows=rows)
    own = [*by, "_part"]
    placed = stretches.of(knots.select(*by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "x")
    along = Window.partitionBy(*own).orderBy("x")
    ends = placed.groupBy(*own).agg(F.min_by(F.struct("x", "y"), "x").alias("first"), F.max_by(F.struct("x", "y"), "x").alias("last"))
    over = Window.partitionBy(*by).orderBy("_part")  # a segment's stretches
    ends = ends.select("*", F.lead("first").over(over).alias("next"), F.lead("_part").over(over).alias("upto"), F.lag("_part").over(over).isNull().alias("opens"))
    line = lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), F.coalesce(b["x"], a["x"]).alias("x1"), F.coalesce(b["y"], a["y"]).alias("y1"))
    own_line = line(F.struct("x", "y"), F.coalesce(F.lead(F.struct("x", "y")).over(along), F.col("next")))
    within = join_by(placed, ends.select(*own, "next"), own).select(*by, "_part", "x", own_line.alias("line"))
    low = F.lit(float("-inf"))
    top = F.lit(len(stretches) - 1)
    carried = ends.withColumn("to", F.coalesce("upto", top)).where("to > _part").select(*by, F.explode(F.sequence(F.col("_part") + 1, F.col("to"))).alias("_part"), low.alias("x"), line(F.col("last"), F.col("next")).alias("line"))
    opening = ends.where("opens").select(*by, F.explode(F.sequence(F.lit(0), F.col("_part"))).alias("_part"), low.alias("x"), line(F.col("first"), F.col("first")).alias("line"))
    starts = within.unionByName(carried).unionByName(opening)

    deals = F.array(*map(F.lit, stretches.weights))  # of a stretch that one value fills
    deal = F.element_at(deals, F.coalesce("_part", F.lit(0)) + 1)
    s = F.col(score).cast("double")
    left = stretches.of(df.select(*by, s.alias("x"), F.struct(*df.columns).alias("row")), "x")
    left = left.withColumn("deal", F.pmod(F.monotonically_increasing_id(), deal).cast("int"))
    right = starts.withColumn("deal", F.explode(F.sequence(F.lit(0), deal - 1)))
    both = right.select(*own, "deal", "x", F.lit(0).alias("kind"), "line", F.lit(None).cast(left.schema["row"].dataType).alias("row"))
    both = both.unionByName(left.select(*own, "deal", "x", F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["line"].dataType).alias("line"), "row"))
    order = Window.partitionBy(*own, "deal").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("line", F.last("line", ignorenulls=True).over(order)).where("kind = 1")
    x, a = F.col("x"), F.col("line")
    part = F.when((a["x1"] > a["x0"]) & (x > a["x0"]), (x - a["x0"]) / (a["x1"] - a["x0"])).otherwise(0.0)
    value = a["y0"] if step else a["y0"] + (a["y1"] - a["y0"]) * part
    return found.select("row.*", F.when(x.isNotNull() & ~F.isnan(x), value).alias(output))


def _apply(df: DataFrame, knots: DataFrame, score: str, output: str, by: By, step: bool) -> DataFrame:
    few = df.isStreaming or knots.limit(SENT + 1).count() <= SENT
    return (_sent if few else merged)(df, knots, score, output, by, step)


def apply_linear(df: DataFrame, knots: DataFrame, score: str = "score", output: str = "calibrated", by: By = ()) -> DataFrame:
    """Lines between knots, constant beyond them; null or NaN scores give null."""
    return _apply(df, knots, score, output, by, step=False)


def apply_step(df: DataFrame, knots: DataFrame, score: str = "score", output: str = "calibrated", by: By = ()) -> DataFrame:
    """The value of the last knot at or below the score, or of the first one."""
    return _apply(df, knots, score, output, by, step=True)


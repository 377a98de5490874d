"""Nearly isotonic fits in pieces that do not depend on each other.

The price on the fall from a score to the next one is settled by a dual value
in [0, lam].  Some scores amid a stretch, more where need be, are solved twice, with its outer duals both at
0 and both at lam.  Duals inside rise with the outer ones, so one that is lam
in the first solution, or 0 in the second, is so in the whole fit, and the fit
can be cut there: what lies between two cuts is solved alone, with their duals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.functions import kernels
from scorecal.operators.keep import kept
from scorecal.operators.ranges import STRETCH, Stretches
from scorecal.operators.segments import By, join_by

ABOUT = 1 << 10  # scores on each side of a stretch's middle, among which a cut is looked for first
GAP = 1e-10  # of lam, by which a dual may be off its bound where the fit is cut


def settled_place(y: np.ndarray, w: np.ndarray, price: float, first: bool, last: bool, about: int) -> tuple[int, float] | None:
    """The settled place nearest to the middle among ``about`` scores on each side of it, more where none is, and its dual."""
    middle, half = len(y) // 2, about
    while True:
        lo, hi = max(0, middle - half), min(len(y), middle + half)
        opens, closes = first and lo == 0, last and hi == len(y)  # no fall lies beyond
        _, low = kernels.nearly_isotonic_between(y[lo:hi], w[lo:hi], price, 0.0, 0.0)
        _, high = kernels.nearly_isotonic_between(y[lo:hi], w[lo:hi], price, 0.0 if opens else price, 0.0 if closes else price)
        settled = np.flatnonzero((low >= price * (1 - GAP)) | (high <= price * GAP))
        settled = settled[settled < hi - lo - 1] if closes else settled
        if len(settled):
            at = settled[np.abs(lo + settled - middle).argmin()]
            return int(lo + at), price if low[at] >= price * (1 - GAP) else 0.0
        if hi - lo == len(y):
            return None
        half *= 4


def nearly_isotonic_fit(ties: DataFrame, lam: Column, by: By = (), rows: int = STRETCH, about: int = ABOUT) -> DataFrame:
    """(by, x, z): the minimiser of sum w (y - z)^2 + lam * (sum of falls), weights positive.

    A stretch is cut at one place, so a task holds two stretches of scores
    where each has such a place; falls that cost more than any stretch's labels
    can outweigh leave none, and then stretches stay together.
    """
    stretches = Stretches(ties.select("x"), rows=rows)
    own = [*by, "_part"]
    placed = kept(stretches.of(ties.select(*by, "x", "y", "w", lam.cast("double").alias("_lam")), "x"))
    types = "".join(f"`{c}` {placed.schema[c].dataType.simpleString()}, " for c in by)
    keys, part_keys = list(by), own

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        """A settled place near the stretch's middle, and its dual."""
        pdf = pdf.sort_values("x")
        price, first, last = float(pdf["_lam"].iloc[0]), bool(pdf["_first"].iloc[0]), bool(pdf["_last"].iloc[0])
        found = settled_place(pdf["y"].to_numpy(), pdf["w"].to_numpy(float), price, first, last, about)
        at, dual = (pdf["x"].iloc[found[0]], found[1]) if found else (np.nan, np.nan)
        return pdf[part_keys].iloc[:1].assign(_cut=at, _dual=dual)

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        left, right = (float(np.nan_to_num(pdf[c].iloc[0])) for c in ("_left", "_right"))
        z, _ = kernels.nearly_isotonic_between(pdf["y"].to_numpy(), pdf["w"].to_numpy(float), float(pdf["_lam"].iloc[0]), left, right)
        return pdf[[*keys, "x"]].assign(z=z)

    if len(stretches) == 1:
        pieces = placed.withColumns({"_piece": F.lit(0), "_left": F.lit(0.0), "_right": F.lit(0.0)})
    else:
        over = Window.partitionBy(*by).orderBy("_part")  # a segment's stretches
        ends = placed.select(*own).distinct().select(*own, F.lag("_part").over(over).isNull().alias("_first"), F.lead("_part").over(over).isNull().alias("_last"))
        found = kept(join_by(placed, ends, own).groupBy(*own).applyInPandas(cut, f"{types}_part int, _cut double, _dual double"))
        found = found.withColumn("_cut", F.when(~F.isnan("_cut"), F.col("_cut"))).withColumn("_dual", F.when(F.col("_cut").isNotNull(), F.col("_dual")))
        before = F.coalesce(F.count("_cut").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = found.withColumn("_before", before)
        duals = found.where("_cut is not null").select(*by, F.col("_before").alias("_piece"), F.col("_dual").alias("_right"))
        after = duals.select(*by, (F.col("_piece") + 1).alias("_piece"), F.col("_right").alias("_left"))
        pieces = join_by(placed, found.select(*own, "_cut", "_before"), own)
        pieces = pieces.withColumn("_piece", F.col("_before") + F.coalesce((F.col("x") > F.col("_cut")).cast("int"), F.lit(0)))
        pieces = join_by(join_by(pieces, duals, [*by, "_piece"], "left"), after, [*by, "_piece"], "left")
    pieces = pieces.select(*by, "_piece", "x", "y", "w", "_lam", "_left", "_right")
    return pieces.groupBy(*by, "_piece").applyInPandas(solved, types + "x double, z double")

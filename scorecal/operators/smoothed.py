"""Isotonic fits smoothed by local polynomials, without a task that needs a segment's scores.

The fit is a step function, so a window's polynomial is its value at one place
plus a share of each jump inside the window.  A stretch of scores meets the
jumps that its windows reach, by stretches; with adaptive windows also the
scores within reach, which settle the widths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.functions import kernels
from scorecal.operators.isotonic import pav_blocks
from scorecal.operators.keep import kept
from scorecal.operators.ranges import STRETCH, Stretches, running, with_neighbours
from scorecal.operators.segments import By, join_by

DEAL = 64  # stretches of the table, at most: each one's scores meet those within reach again


def smoothed_fit(ties: DataFrame, window: int | None, order: int, adaptive: bool, least: int, most: int | None, by: By = (), rows: int = STRETCH) -> DataFrame:
    """(by, x, z): as ``kernels.smooth_isotonic`` of the isotonic fit."""
    ties, own, keys = kept(ties), [*by, "_part"], list(by)
    order, least = max(order, 1), max(least, 3)
    stretches = Stretches(ties.select("x"), rows=max(rows, -(-ties.count() // DEAL)))
    blocks = kept(pav_blocks(ties, by))
    sizes = blocks.groupBy(*by).agg(F.sum("scores").alias("_m"), F.min("x_lo").alias("_lo"), F.max("x_hi").alias("_hi"), (F.sum(F.col("scores") * F.col("value")) / F.sum("scores")).alias("_mean"))
    gap = F.col("value") - F.col("_mean")
    spread = join_by(blocks, sizes, by).groupBy(*by).agg((F.sum(F.col("scores") * gap * gap) / F.sum("scores")).alias("_var"))
    sizes = kept(join_by(sizes.drop("_mean"), spread, by))

    placed = running(blocks.select(*by, "x_lo", "value", "scores"), {"_upto": F.col("scores")}, by, "x_lo", stretches)
    near = with_neighbours(placed, F.col("value"), by, "x_lo").where("before is null or before <> value")
    jumps = near.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct((F.col("_upto") - F.col("scores")).alias("at"), F.col("value").alias("to")))).alias("_jumps"))
    cells = stretches.of(ties.select(*by, "x"), "x").groupBy(*own).agg(F.sort_array(F.collect_list("x")).alias("_xs"))
    cells = join_by(cells, jumps, own, "left").withColumn("_k", F.size("_xs").cast("long"))
    cells = kept(cells.select(*own, "_k", "_xs", F.col("_jumps.at").alias("_at"), F.col("_jumps.to").alias("_to")))

    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a segment's stretches
    ends = cells.select(*own, "_k", F.get("_xs", F.lit(0)).alias("_first"), F.element_at("_xs", -1).alias("_last"), F.element_at("_to", -1).alias("_out"))
    ends = ends.withColumns({"_start": F.coalesce(F.sum("_k").over(before), F.lit(0)), "_in": F.last("_out", ignorenulls=True).over(before)}).drop("_out")
    ends = kept(join_by(ends, sizes, by))

    m, span = F.col("_m"), F.col("_hi") - F.col("_lo")
    if adaptive:
        top = F.greatest(F.lit(least), F.lit(most) if most else F.floor(m / 5)) + 2
        reach = F.least(top, m)
        far = span * (top / m + 1e-9)
    else:
        reach = F.least(F.lit(window) if window else F.greatest(F.lit(5), F.floor(m / 10)), m) + 1
        far = F.lit(0.0)
    target = ends.select(*by, F.col("_part").alias("_own"), F.col("_first").alias("_a"), F.col("_last").alias("_b"), F.col("_start").alias("_from"), (F.col("_start") + F.col("_k")).alias("_until"), reach.alias("_reach"), far.alias("_far"), *(c for c in sizes.columns if c not in by))
    source = ends.select(*own, "_k", "_first", "_last", "_start", "_in")
    pairs = join_by(target, source, by)
    mine = F.col("_part") == F.col("_own")
    seen = mine | (F.lit(adaptive) & (F.col("_last") >= F.col("_a") - F.col("_far")) & (F.col("_first") <= F.col("_b") + F.col("_far")))
    met = (F.col("_start") < F.col("_until") + F.col("_reach")) & (F.col("_start") + F.col("_k") > F.col("_from") - F.col("_reach"))
    pairs = pairs.withColumns({"_seen": seen, "_met": met}).where("_seen or _met").drop("_k", "_first", "_last", "_a", "_b", "_until", "_reach", "_far")
    pairs = join_by(pairs, cells.drop("_k"), own).withColumn("_xs", F.when(F.col("_seen"), F.col("_xs"))).withColumns({c: F.when(F.col("_met"), F.col(c)) for c in ("_at", "_to")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_start")
        one = pdf[pdf["_part"] == pdf["_own"]].iloc[0]
        x, begins, m, whole = np.asarray(one["_xs"], float), int(one["_start"]), int(one["_m"]), float(one["_hi"] - one["_lo"])
        place = begins + np.arange(len(x))
        some = pdf[pdf["_met"]]
        at = np.concatenate([np.asarray(v, np.int64) for v in some["_at"] if v is not None] or [np.empty(0, np.int64)])
        to = np.concatenate([np.asarray(v, float) for v in some["_to"] if v is not None] or [np.empty(0)])
        entry = some["_in"].iloc[0]
        if np.isnan(entry):  # the segment's first stretch, which a jump opens
            entry = to[0]
        steps = kernels.Steps(at, to, float(entry))
        if float(one["_var"]) < 1e-6:
            z = steps.value(place)
        elif adaptive:
            if m < 5 or whole <= 0:
                z = steps.value(place)
            else:
                seen = pdf[pdf["_seen"]]
                around = (np.concatenate([np.asarray(v, float) for v in seen["_xs"]]) - one["_lo"]) / whole
                here = int(seen.loc[seen["_start"] < begins, "_xs"].map(len).sum())
                widths = kernels.local_widths(around, here, here + len(x), m, least, most or max(least, m // 5))
                z = kernels.smoothed_steps(steps, place, *kernels.adaptive_windows(place, np.minimum(widths, 2 * m), m), order)
        else:
            width = window or max(5, m // 10)
            width += 1 - width % 2
            width = min(width, m if m % 2 else m - 1)
            if m < width or width < 3:
                z = steps.value(place)
            else:
                first = np.clip(place - width // 2, 0, m - width)
                z = kernels.smoothed_steps(steps, place, np.full(len(x), width), first, order)
        return pdf[[*keys, "_own"]].iloc[:1].loc[lambda d: d.index.repeat(len(x))].reset_index(drop=True).assign(x=x, z=z)

    types = "".join(f"`{c}` {ties.schema[c].dataType.simpleString()}, " for c in by)
    rough = kept(pairs.groupBy(*by, "_own").applyInPandas(run, types + "_own int, x double, z double")).withColumnRenamed("_own", "_part")
    inner = Window.partitionBy(*own).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    tops = rough.groupBy(*own).agg(F.max("z").alias("_top")).select(*own, F.max("_top").over(before).alias("_top"))
    return join_by(rough.withColumn("z", F.max("z").over(inner)), tops, own).select(*by, "x", F.greatest("z", "_top").alias("z"))

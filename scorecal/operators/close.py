"""Pairs of values within a tolerance, and runs of close values, without one task for a segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.functions import kernels
from scorecal.operators.keep import kept
from scorecal.operators.ranges import Stretches
from scorecal.operators.segments import By, join_by


def close_pairs(cells: DataFrame, a: str, b: str, tolerance: float, count: str = "k", by: By = ()) -> DataFrame:
    """(by, pairs): pairs of rows whose values of ``a``, and of ``b``, differ by ``tolerance`` at most.

    ``cells`` has each distinct (a, b) once, with the count of its rows.  Both
    axes are cut at quantiles, and a tile counts the pairs of its cells with
    the cells after them along ``a``; for that it also gets the cells that lie
    a tolerance beyond its edges.  A cell goes to as many tiles as a tolerance
    reaches, four to six for one that is short against a stretch.  Null and NaN are in no pair.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    own = [*by, "_ta", "_tb"]
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    rows = cells.select(*by, x.alias("_a"), y.alias("_b"), F.col(count).alias("_k")).where(~F.isnan("_a") & ~F.isnan("_b"))
    rows = kept(rows.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()))
    along, across = Stretches(rows.select("_a")), Stretches(rows.select("_b"))
    reach = lambda c: F.lit(float(tolerance)) + (F.abs(c) + tolerance) * 1e-15  # past the rounding of a difference
    placed = rows
    for name, cuts, at in (("_ta", along, F.col("_a")), ("_ta0", along, F.col("_a") - reach(F.col("_a"))), ("_tb", across, F.col("_b")), ("_tb0", across, F.col("_b") - reach(F.col("_b"))), ("_tb1", across, F.col("_b") + reach(F.col("_b")))):
        placed = cuts.of(placed.withColumn("_at", at), "_at", name).drop("_at")
    placed = placed.withColumnRenamed("_ta", "_ha").withColumnRenamed("_tb", "_hb")
    sent = placed.withColumn("_ta", F.explode(F.sequence("_ta0", "_ha"))).withColumn("_tb", F.explode(F.sequence("_tb0", "_tb1")))
    home = (F.col("_ta") == F.col("_ha")) & (F.col("_tb") == F.col("_hb"))
    sent = sent.select(*own, "_a", "_b", "_k", home.alias("_home"))
    keys = list(by)

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_a", "_b"])
        found = kernels.pairs_within(pdf["_a"].to_numpy(), pdf["_b"].to_numpy(), pdf["_k"].to_numpy(float), pdf["_home"].to_numpy(), tolerance)
        return pdf[keys].iloc[:1].assign(pairs=found)

    types = "".join(f"`{c}` {cells.schema[c].dataType.simpleString()}, " for c in by)
    return sent.groupBy(*own).applyInPandas(counted, types + "pairs double").groupBy(*by).agg(F.sum("pairs").alias("pairs"))


def with_close_runs(rows: DataFrame, value: str, order: list[str], stretches: Stretches, rtol: float, atol: float, by: By = ()) -> DataFrame:
    """Written rows with _new, 1 where a run begins, and _anchor, its first value.

    A run goes on while values lie within ``atol + rtol * |anchor|`` of its
    first one.  Stretches are scanned with the anchor that the stretch before
    ends on; the first scan takes none, and scans go on until no stretch gets
    another anchor than it had, which is soon, as a stretch forgets it at its
    first step beyond the tolerance.
    """
    own = [*by, "_part"]
    placed = kept(stretches.of(rows, order[0]))
    scans = kept(placed.select(*own).distinct().withColumn("_in", F.lit(None).cast("double")))
    types = "".join(f"`{c}` {placed.schema[c].dataType.simpleString()}, " for c in own)
    keys, columns = own, rows.columns

    def scanned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        anchors, _ = kernels.close_runs(pdf[value].to_numpy(float), pdf["_in"].iloc[0], rtol, atol)
        return pdf[keys].iloc[:1].assign(_out=anchors[-1])

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        anchors, new = kernels.close_runs(pdf[value].to_numpy(float), pdf["_in"].iloc[0], rtol, atol)
        return pdf[columns].assign(_new=new.astype(int), _anchor=anchors)

    before = Window.partitionBy(*by).orderBy("_part")  # over a segment's stretches
    while len(stretches) > 1:
        ends = join_by(placed, scans, own).groupBy(*own).applyInPandas(scanned, types + "_out double")
        ends = kept(join_by(scans, ends, own).withColumn("_next", F.lag("_out").over(before)))
        moved = ends.where(~F.col("_in").eqNullSafe(F.col("_next"))).limit(1).count()
        scans = ends.select(*own, F.col("_next").alias("_in"))
        if not moved:
            break
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields)
    return kept(join_by(placed, scans, own).groupBy(*own).applyInPandas(marked, schema + "_new int, _anchor double"))

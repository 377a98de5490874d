"""The tie table: one row per distinct score, from which almost everything follows.

It is one partial and final hash aggregation of the rows; windows over scores
run on it only.  ``by`` columns make every result per segment in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecal.operators.keep import kept
from scorecal.operators.ranges import running
from scorecal.operators.segments import By, join_by, ordered


def validated(df: DataFrame, score: str = "score", label: str = "label", allow_nan: bool = False, unit: bool = False) -> DataFrame:
    """Fails at run time on a null score or label, on NaN unless allowed, and with ``unit`` on scores outside [0, 1]."""
    p, y = F.col(score).cast("double"), F.col(label).cast("double")
    bad = p.isNull() | y.isNull()
    bad = bad if allow_nan else bad | F.isnan(p) | F.isnan(y)
    bad = bad | (p < 0) | (p > 1) if unit else bad
    return df.withColumn(score, F.when(bad, F.raise_error(F.lit("invalid score or label")).cast("double")).otherwise(p))


def tie_table(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None, by: By = (), digits: int | None = None) -> DataFrame:
    """(by, x, n, w, wy, y): rows, weight, weighted labels and mean label of each distinct score.

    A group of zero weight has y = 0.  A null or NaN score or label is an
    error at run time; segments of null are segments.  ``digits`` rounds scores first, which
    bounds the table at 10**digits + 1 rows a segment for scores in [0, 1].
    """
    x = F.col(score).cast("double")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    df = validated(df, score, label)
    rows = df.select(*by, (F.round(x, digits) if digits is not None else x).alias("x"), F.col(label).cast("double").alias("_y"), w.alias("_w"))
    out = rows.groupBy(*by, "x").agg(F.count("*").alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("wy"))
    return out.withColumn("y", F.coalesce(F.try_divide("wy", "w"), F.lit(0.0)))


def checked_weights(df: DataFrame, weight: str) -> DataFrame:
    """Fails at run time on a weight that is null, negative or not finite."""
    w = F.col(weight).cast("double")
    bad = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    return df.withColumn(weight, F.when(bad, F.raise_error(F.lit("weights must be finite and not negative"))).otherwise(w))


def with_ranks(ties: DataFrame, by: By = ()) -> DataFrame:
    """A tie table with lo and hi, the counts of rows before and through each score, sx and sy, the sums of scores and labels through it, and total; written once."""
    ties = kept(ties)
    sums = {"hi": F.col("n"), "sx": F.col("x") * F.col("n"), "sy": F.col("wy")}
    rows = running(ties, sums, by).withColumn("lo", F.col("hi") - F.col("n"))
    return kept(join_by(rows.drop("_part"), ties.groupBy(*by).agg(F.sum("n").alias("total")), by))


def cuts_through(rank: Column, bins: Column) -> Column:
    """How many of the ideal cuts, at ranks floor(k * total / bins), lie at or below a rank."""
    b = F.least(bins.cast("long"), F.col("total"))
    top = (rank + 1) * b - 1
    return F.least(b - 1, (top - F.pmod(top, F.col("total"))) / F.col("total"))


def equal_mass_bins(ties: DataFrame, n_bins: int | Column, by: By = ()) -> DataFrame:
    """Adds bin, which rises along the scores: a cut that falls inside a tie moves to its end.

    Scores of one bin have as many cuts at or below the rank before them.
    """
    wanted = F.lit(n_bins) if isinstance(n_bins, int) else n_bins
    cut = with_ranks(ties, by).withColumn("_cuts", cuts_through(F.col("lo"), wanted).cast("int"))
    own = [*by, "_cuts"]
    numbers = cut.select(*own).distinct().withColumn("bin", F.row_number().over(ordered(by, "_cuts")) - 1)  # over bins
    return join_by(cut, numbers, own).drop("_cuts")


def bin_summaries(binned: DataFrame, by: By = ()) -> DataFrame:
    """(by, bin, n, conf, acc, total) of rows in each bin."""
    return binned.groupBy(*by, "bin").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("conf"),
        (F.sum("wy") / F.sum("n")).alias("acc"),
        F.first("total").alias("total"),
    )


def _cuts(total: int, bins: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranks above ``low`` and through ``high`` of ideal cuts, ascending, and the place in ``bins`` of the number of bins that each is of."""
    most = np.minimum(bins, total)
    first = np.maximum(1, -(-(low + 1) * most // total))
    count = np.maximum(0, np.minimum(most - 1, -(-(high + 1) * most // total) - 1) - first + 1)
    which = np.repeat(np.arange(len(bins)), count)
    k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count - first, count)
    at = k * total // most[which]
    order = np.argsort(at, kind="stable")
    return at[order], which[order]


def bin_ends(ranked: DataFrame, bins: Iterable[int], by: By = ()) -> DataFrame:
    """(by, hi, sx, sy, total, n_bins): the scores of a table of ``with_ranks`` at which a bin ends, once for each number of bins."""
    wanted = np.array(bins, np.int64)
    rows = ranked.select(*by, "hi", "sx", "sy", "total", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, total = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("lo", "hi", "total"))
            found = []
            for n in np.unique(total).tolist():
                mine = np.flatnonzero(total == n)
                at, which = _cuts(n, wanted, int(lo[mine].min()), int(hi[mine].max()))
                first, last = (np.searchsorted(at, v[mine], side="right") for v in (lo, hi))
                rows, count = mine[last > first], (last - first)[last > first]
                cut = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first[last > first], count)
                top = mine[hi[mine] == n]
                found.append(np.stack([np.concatenate([np.repeat(rows, count), np.repeat(top, len(wanted))]), np.concatenate([which[cut], np.tile(np.arange(len(wanted)), len(top))])]))
            row, which = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), int)
            if len(row):
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns[:-1], pa.array(wanted[which].astype(np.int32))], [*taken.schema.names[:-1], "n_bins"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, types + "n_bins int")


def summaries_of(ranked: DataFrame, bins: Iterable[int], by: By = ()) -> DataFrame:
    """(by, n_bins, bin, n, conf, acc, total) for each number of bins, from one table of ``with_ranks``.

    Only the scores at which a bin ends are taken, with the sums through them.
    """
    edges = bin_ends(ranked, bins, by)
    along = ordered([*by, "n_bins"], "hi")  # over bins
    own = lambda c: F.col(c) - F.coalesce(F.lag(c).over(along), F.lit(0))
    rows = edges.select(*by, "n_bins", (F.row_number().over(along) - 1).alias("bin"), own("hi").alias("n"), own("sx").alias("_x"), own("sy").alias("_y"), "total")
    return rows.select(*by, "n_bins", "bin", "n", (F.col("_x") / F.col("n")).alias("conf"), (F.col("_y") / F.col("n")).alias("acc"), "total")

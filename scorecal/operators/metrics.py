"""Calibration metrics as aggregations, one row per segment."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.functions import kernels
from scorecal.functions import scores as S
from scorecal.operators.close import close_pairs
from scorecal.operators.keep import kept
from scorecal.operators.ranges import Stretches, running
from scorecal.operators.ties import By, join_by, ordered, summaries_of, tie_table, validated, with_ranks


def basic_metrics(df: DataFrame, score: str = "score", label: str = "label", by: By = ()) -> DataFrame:
    """n, base_rate, mean_prediction, bias, mean_calibration_error, brier, log_loss; a null score or label is an error."""
    df = validated(df, score, label)
    p, y = F.col(score).cast("double"), F.col(label).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(y).alias("base_rate"), F.avg(p).alias("mean_prediction"), (F.avg(p) - F.avg(y)).alias("bias"),
        F.abs(F.avg(p) - F.avg(y)).alias("mean_calibration_error"), F.avg(S.brier(p, y)).alias("brier"), F.avg(S.log_score(p, y)).alias("log_loss"),
    )


def _bins(df: DataFrame, score: str, label: str, by: By, index: Column) -> DataFrame:
    return validated(df, score, label).groupBy(*by, index.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(score).cast("double")).alias("conf"), F.avg(F.col(label).cast("double")).alias("acc"))


def uniform_errors(df: DataFrame, score: str = "score", label: str = "label", n_bins: int = 10, by: By = ()) -> DataFrame:
    """ece and mce over equal-width bins of [0, 1]; empty bins do not count."""
    gap = F.abs(F.col("conf") - F.col("acc"))
    bins = _bins(df, score, label, by, S.uniform_bin(F.col(score), n_bins))
    return bins.groupBy(*by).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def quantiles(df: DataFrame, column: str, at: list[float], by: By = (), count: str | None = None) -> DataFrame:
    """(by, _e): the exact quantiles, between neighbouring ranks in a line; ranks come from counts of equal values.

    Null and NaN take no part.  ``count`` is how often each row counts.  Sums
    over stretches of the axis tell those with a wanted rank; only these are sorted.
    """
    x = F.col(column).cast("double")
    sound = df.where(x.isNotNull() & ~F.isnan(x))
    counts = kept(sound.groupBy(*by, x.alias("x")).agg((F.sum(count) if count else F.count("*")).alias("n")))
    rows, own = Stretches(counts.select("x")).of(counts, "x"), [*by, "_part"]
    sizes, over = rows.groupBy(*own).agg(F.sum("n").alias("_size")), Window.partitionBy(*by).orderBy("_part")  # a segment's stretches
    placed = sizes.select(*own, "_size", (F.sum("_size").over(over) - F.col("_size")).alias("_before"), (F.sum("_size").over(Window.partitionBy(*by)) - 1).alias("_top"))
    inside = lambda r, before, n: (r >= before) & (r < before + n)
    low, high = F.floor("place"), F.ceil("place")
    either = lambda before, n: inside(low, before, n) | inside(high, before, n)
    every = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("at")) for k, q in enumerate(at)))
    asked = placed.withColumn("s", F.explode(every)).withColumns({"k": F.col("s.k"), "place": F.col("_top") * F.col("s.at")})
    # Written, so that Spark sends it round: a row for each quantile and stretch that has its rank.
    asked = kept(asked.where(either(F.col("_before"), F.col("_size"))).select(*own, "_before", "k", "place"))
    near = join_by(rows, asked.select(*own, "_before").distinct(), own)
    rank = F.col("_before") + F.sum("n").over(Window.partitionBy(*own).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    met = join_by(near.withColumn("_lo", rank).drop("_before"), asked.drop("_before"), own).where(either(F.col("_lo"), F.col("n")))
    here = lambda r: F.max(F.when(inside(r, F.col("_lo"), F.col("n")), F.col("x")))
    each = met.groupBy(*by, "k").agg(here(low).alias("a"), here(high).alias("b"), F.first(F.col("place") - low).alias("part"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda s: s["v"]).alias("_e"))


def _with_edges(df: DataFrame, over: str, n_bins: int, strategy: str, by: By) -> tuple[DataFrame, Column]:
    """df with its segment's edges, and the bin index; quantile edges interpolate linearly."""
    at = [k / n_bins for k in range(n_bins + 1)]
    x = F.col(over).cast("double")
    if strategy == "quantile":
        span = quantiles(df, over, at, by)
    elif strategy == "uniform":
        span = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        step = (F.col("_hi") - F.col("_lo")) / n_bins
        span = span.select(*by, F.array(*(F.col("_lo") + k * step for k in range(n_bins)), F.col("_hi")).alias("_e"))
    else:
        raise ValueError(f"strategy must be uniform or quantile, not {strategy!r}")
    return join_by(df, span, by), S.bin_index(x, [F.col("_e")[k] for k in range(n_bins + 1)])


def binned_calibration_error(df: DataFrame, score: str = "score", label: str = "label", x: str | None = None, n_bins: int = 10, strategy: str = "uniform", by: By = ()) -> DataFrame:
    """bce: root mean square over occupied bins, each counting alike, of the bins' gaps."""
    rows, index = _with_edges(df, x or score, n_bins, strategy, by)
    gap = F.col("conf") - F.col("acc")
    return _bins(rows, score, label, by, index).groupBy(*by).agg(F.sqrt(F.avg(gap * gap)).alias("bce"), F.count("*").alias("n_bins"))


def calibration_curve(df: DataFrame, score: str = "score", label: str = "label", n_bins: int = 10, strategy: str = "uniform", by: By = ()) -> DataFrame:
    """(by, bin, acc, conf, n) of every bin, zeros where it is empty."""
    if strategy == "uniform":
        rows, index = df, S.uniform_bin(F.col(score), n_bins)
    else:
        rows, index = _with_edges(df, score, n_bins, strategy, by)
    found = _bins(rows, score, label, by, index)
    groups = found.select(*by).distinct() if by else df.sparkSession.range(1).select()
    spine = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    out = join_by(spine, found, [*by, "bin"], "left")
    return out.select(*by, "bin", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("acc", "conf")), F.coalesce("n", F.lit(0)).alias("n"))


def _gap_terms(bins: DataFrame) -> DataFrame:
    gap = F.col("conf") - F.col("acc")
    noise = F.when(F.col("n") > 1, F.col("acc") * (1 - F.col("acc")) / F.greatest(F.col("n") - 1, F.lit(1)))
    return bins.withColumn("_gap", gap).withColumn("_share", F.col("n") / F.col("total")).withColumn("_unbiased", F.when(F.col("n") > 1, gap * gap - noise).otherwise(0.0))


def equal_mass_errors(df: DataFrame, score: str = "score", label: str = "label", n_bins: int = 15, by: By = (), ranked: DataFrame | None = None) -> DataFrame:
    """plugin_l1, plugin_l2, debiased_squared and debiased over equal-mass, tie-safe bins."""
    r = with_ranks(tie_table(df, score, label, by=by), by) if ranked is None else ranked
    terms = _gap_terms(summaries_of(r, [n_bins], by))
    out = terms.groupBy(*by).agg(
        F.sum(F.col("_share") * F.abs("_gap")).alias("plugin_l1"),
        F.sqrt(F.sum(F.col("_share") * F.col("_gap") * F.col("_gap"))).alias("plugin_l2"),
        F.greatest(F.sum(F.col("_share") * F.col("_unbiased")), F.lit(0.0)).alias("debiased_squared"),
    )
    return out.withColumn("debiased", F.sqrt("debiased_squared"))


def bin_sensitivity(df: DataFrame, bins: range = range(2, 51), score: str = "score", label: str = "label", by: By = (), ranked: DataFrame | None = None) -> DataFrame:
    """(by, n_bins, plugin, debiased, occupied, monotone) for each number of bins, from one table of running sums."""
    r = with_ranks(tie_table(df, score, label, by=by), by) if ranked is None else ranked
    own = [*by, "n_bins"]
    falls = (F.col("acc") < F.lag("acc").over(ordered(own, "bin"))).cast("int")  # over bins
    terms = _gap_terms(summaries_of(r, bins, by).withColumn("_falls", F.coalesce(falls, F.lit(0))))
    return terms.groupBy(*own).agg(
        F.sum(F.col("_share") * F.abs("_gap")).alias("plugin"),
        F.sqrt(F.greatest(F.sum(F.col("_share") * F.col("_unbiased")), F.lit(0.0))).alias("debiased"),
        F.count("*").alias("occupied"),
        (F.max("_falls") == 0).alias("monotone"),
    )


def sweep_error(df: DataFrame, score: str = "score", label: str = "label", by: By = (), step: int = 64, ranked: DataFrame | None = None) -> DataFrame:
    """sweep_ece (l1) and sweep_bins: bins grow while their label means keep rising.

    Numbers of bins are tried in blocks, of ``step`` at first and then of as
    many as were tried before while their bins are some millions, all segments
    at once, on one table of running sums; the segments that pass a whole block
    go on to the next.
    """
    r = with_ranks(tie_table(df, score, label, by=by), by) if ranked is None else ranked
    top = kept(r.groupBy(*by).agg(F.first("total").alias("_rows")))
    done, first, live, open_ = [], 1, r, top
    while True:
        block = join_by(bin_sensitivity(df, range(first, first + step), by=by, ranked=live), open_, by).where(F.col("n_bins") <= F.col("_rows"))
        stop = F.min(F.when(~F.col("monotone"), F.col("n_bins")))
        best = block.groupBy(*by).agg(stop.alias("_stop"), F.first("_rows").alias("_rows"), F.collect_list(F.struct("n_bins", "plugin", "occupied")).alias("_tried"))
        risen = F.filter("_tried", lambda s: F.col("_stop").isNull() | (s["n_bins"] < F.col("_stop")))
        best = kept(best.withColumn("_last", F.array_max(risen)))
        done.append(best.where("_last is not null").select(*by, F.col("_last.n_bins").alias("n_bins"), F.col("_last.plugin").alias("sweep_ece"), F.col("_last.occupied").alias("sweep_bins")))
        first += step
        step = max(64, min(first - 1, (1 << 22) // first))
        open_ = best.where(F.col("_stop").isNull() & (F.col("_rows") >= first)).select(*by, "_rows")
        if open_.isEmpty():
            break
        live = join_by(r, open_.drop("_rows").withColumn("_open", F.lit(True)), by).drop("_open") if by else r
    every = reduce(DataFrame.unionByName, done)
    return every.groupBy(*by).agg(F.max_by("sweep_ece", "n_bins").alias("sweep_ece"), F.max_by("sweep_bins", "n_bins").alias("sweep_bins"))


def rank_metrics(df: DataFrame, a: str, b: str, by: By = ()) -> DataFrame:
    """spearman of two columns by average ranks; NaN where one is constant."""
    cells = kept(df.groupBy(*by, F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b)).agg(F.count("*").alias("_k")))

    def ranks(c: str) -> DataFrame:
        t = kept(cells.groupBy(*by, c).agg(F.sum("_k").alias("_n")))
        return running(t, {"_hi": F.col("_n")}, by, c).select(*by, c, (F.col("_hi") - (F.col("_n") - 1) / 2).alias(f"_r_{c}"))

    j = join_by(join_by(cells, ranks(a), [*by, a]), ranks(b), [*by, b])
    k, u, v = F.col("_k"), F.col(f"_r_{a}"), F.col(f"_r_{b}")
    sums = j.groupBy(*by).agg(F.sum(k).alias("n"), F.sum(k * u).alias("u"), F.sum(k * v).alias("v"), F.sum(k * u * u).alias("uu"), F.sum(k * v * v).alias("vv"), F.sum(k * u * v).alias("uv"))
    top = F.col("n") * F.col("uv") - F.col("u") * F.col("v")
    bottom = F.sqrt((F.col("n") * F.col("uu") - F.col("u") * F.col("u")) * (F.col("n") * F.col("vv") - F.col("v") * F.col("v")))
    return sums.select(*by, F.coalesce(F.try_divide(top, bottom), F.lit(float("nan"))).alias("spearman"))


def auc(df: DataFrame, score: str = "score", label: str = "label", by: By = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half; null with one class only."""
    t = kept(tie_table(df, score, label, by=by).withColumn("neg", F.col("n") - F.col("wy")))
    wins = running(t, {"_upto": F.col("neg")}, by).withColumn("wins", F.col("wy") * (F.col("_upto") - F.col("neg") / 2))
    return wins.groupBy(*by).agg(F.try_divide(F.sum("wins"), F.sum("wy") * F.sum("neg")).alias("auc"))


def unique_value_counts(df: DataFrame, score: str = "score", original: str | None = None, precision: int = 6, by: By = ()) -> DataFrame:
    """n_unique after rounding half to even and, with ``original``, its count and the ratio."""
    out = [F.count_distinct(F.bround(F.col(score).cast("double"), precision)).alias("n_unique")]
    if original:
        out.append(F.count_distinct(F.bround(F.col(original).cast("double"), precision)).alias("n_unique_original"))
    found = df.groupBy(*by).agg(*out)
    return found.withColumn("preservation_ratio", F.try_divide(F.col("n_unique"), F.col("n_unique_original"))) if original else found


def diversity_index(df: DataFrame, score: str = "score", reference: float | None = None, by: By = ()) -> DataFrame:
    """Distinct share of the outputs, over a reference share if given."""
    own = F.count_distinct(score) / F.count("*")
    if reference == 0:
        own = F.when(own > 0, F.lit(float("inf"))).otherwise(1.0)
    elif reference is not None:
        own = own / reference
    return df.groupBy(*by).agg(own.alias("diversity"))


def tie_preservation(df: DataFrame, original: str, calibrated: str, by: By = (), tolerance: float = 1e-10) -> DataFrame:
    """Share of the original's tied pairs kept, less the share of all pairs newly tied, within [0, 1].

    Values are tied when they differ by ``tolerance`` at most.  At 0, pairs
    are counted from the sizes of groups of equal values, else by ``close_pairs``.
    """
    pairs = lambda n: n * (n - 1) / 2
    value = lambda c, name: F.col(c).cast("double").alias(name)
    cells = kept(df.groupBy(*by, value(original, "_o"), value(calibrated, "_c")).agg(F.count("*").alias("k")))
    sums = cells.groupBy(*by).agg(F.sum(pairs(F.col("k"))).alias("kept"), F.sum("k").alias("n"))
    if tolerance == 0:
        one = lambda c, name: cells.groupBy(*by, c).agg(F.sum("k").alias("k")).groupBy(*by).agg(F.sum(pairs(F.col("k"))).alias(name))
    else:
        both = close_pairs(cells, "_o", "_c", tolerance, by=by).withColumnRenamed("pairs", "kept")
        sums = join_by(sums.drop("kept"), both, by)
        one = lambda c, name: close_pairs(cells.groupBy(*by, c).agg(F.sum("k").alias("k")).withColumn("_z", F.lit(0.0)), c, "_z", tolerance, by=by).withColumnRenamed("pairs", name)
    t = join_by(join_by(sums, one("_o", "tied_o"), by), one("_c", "tied_c"), by)
    share = F.coalesce(F.try_divide(F.col("kept"), F.col("tied_o")), F.lit(1.0))
    new = F.coalesce(F.try_divide(F.col("tied_c") - F.col("kept"), pairs(F.col("n"))), F.lit(0.0))
    return t.select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share - new)).alias("tie_preservation"))


def smooth_grid(df: DataFrame, m: int | Column, score: str = "score", label: str = "label", by: By = (), ties: DataFrame | None = None) -> DataFrame:
    """(by, i, residual, mass): sums of p - y and of rows on m grid points of [0, 1].

    Each row is split between its two neighbours; this is the only pass over
    the rows that kernel smoothing needs, and leaves m rows a segment.
    """
    t = tie_table(df, score, label, by=by) if ties is None else ties
    m = F.lit(m) if isinstance(m, int) else m
    place = F.col("x") * (m - 1)
    lo = F.least(F.greatest(F.floor(place), F.lit(0)), m - 2).cast("int")
    rows = t.select(*by, "x", "n", "wy", lo.alias("_lo"), (place - lo).alias("_f"))
    parts = F.explode(F.array(F.struct(F.col("_lo").alias("i"), (1 - F.col("_f")).alias("s")), F.struct((F.col("_lo") + 1).alias("i"), F.col("_f").alias("s"))))
    rows = rows.select(*by, (F.col("x") * F.col("n") - F.col("wy")).alias("r"), "n", parts.alias("p"))
    return rows.groupBy(*by, F.col("p.i").alias("i")).agg(F.sum(F.col("r") * F.col("p.s")).alias("residual"), F.sum(F.col("n") * F.col("p.s")).alias("mass"))


class _NoGrid(Exception):
    pass


def smooth_error(df: DataFrame, sigma: float | None = None, score: str = "score", label: str = "label", by: By = (), ties: DataFrame | None = None) -> DataFrame:
    """smece and its bandwidth sigma, per segment; the bandwidth solves sigma = error unless given.

    Bandwidths of 0.02 and more share one grid.  The finer grids are summed up
    for the segments alone whose error is below them.
    """
    if sigma is not None and sigma <= 0:
        raise ValueError("sigma must be positive")
    t = tie_table(df, score, label, by=by) if ties is None else ties
    if sigma:
        return _smoothed(t, [kernels.grid_size(sigma)], sigma, by)
    t = kept(t)
    found = kept(_smoothed(t, [kernels.grid_size(1.0)], None, by))
    open_ = found.where("sigma is null").select(*by, F.lit(True).alias("_open"))
    if open_.isEmpty():
        return found
    rest = join_by(t, open_, by).drop("_open") if by else t
    every = sorted({kernels.grid_size(k / 1024) for k in range(1, 1025)})
    return found.where("sigma is not null").unionByName(_smoothed(rest, every, None, by))


def _smoothed(ties: DataFrame, sizes: list[int], sigma: float | None, by: By) -> DataFrame:
    """smece and sigma from grids of some sizes, all in one aggregation; null where the bandwidth needs another size."""
    every = ties.withColumn("m", F.explode(F.array(*map(F.lit, sizes))))
    grids = smooth_grid(ties, F.col("m"), by=[*by, "m"], ties=every)
    keys = list(by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        def dense(m: int) -> tuple[np.ndarray, np.ndarray]:
            if m not in sizes:
                raise _NoGrid(m)
            own = pdf[pdf["m"] == m]
            r, d = np.zeros(m), np.zeros(m)
            r[own["i"]], d[own["i"]] = own["residual"], own["mass"]
            return r, d

        error = lambda s: kernels.smoothed_error(*dense(kernels.grid_size(s)), s)
        try:
            s = sigma or kernels.chosen_bandwidth(error)
            found = {"smece": [error(s)], "sigma": [float(s)]}
        except _NoGrid:
            found = {"smece": [None], "sigma": [None]}
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, **found})

    types = "".join(f"`{c}` {ties.schema[c].dataType.simpleString()}, " for c in by)
    return grids.groupBy(*keys).applyInPandas(solve, types + "smece double, sigma double")

"""Folds, cross-validated settings and out-of-fold outputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecal.functions import scores as S
from scorecal.operators.keep import kept, passing
from scorecal.operators.ranges import Stretches, running
from scorecal.operators.ties import By, join_by, tie_table, validated

SCORINGS = {"log_loss": "log", "brier": "brier"}


def with_folds(df: DataFrame, key: Sequence[str], folds: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """A fold number from a hash of the key: the same whatever the partitions.

    Folds of many rows have the label's shares up to chance, without sorting
    or moving any row.
    """
    if folds < 2:
        raise ValueError("folds must be 2 or more")
    return df.withColumn(name, F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(folds)).cast("int"))


def stratified_folds(df: DataFrame, key: Sequence[str], label: str = "label", folds: int = 5, seed: int = 0, name: str = "fold", by: By = ()) -> DataFrame:
    """Folds whose rows of each 0/1 label differ by one at most, per segment.

    Rows are ranked within segment and label by a hash of the key, in stretches
    of the hash, and dealt in turn.  A segment has as many folds as its rarer
    label has rows, if those are fewer, and two at least; other labels than
    0 and 1 are one class.
    """
    if folds < 2:
        raise ValueError("folds must be 2 or more")
    hashed = kept(df.withColumn("_hash", F.xxhash64(*key, F.lit(seed))).withColumn("_y", F.col(label).cast("double")))
    sound = F.col("_y").isin(0.0, 1.0)
    counts = hashed.groupBy(*by).agg(F.min(F.coalesce(sound, F.lit(False))).alias("_binary"), F.count_if(F.col("_y") == 0).alias("_no"), F.count_if(F.col("_y") == 1).alias("_yes"), F.count("*").alias("_all"))
    rarer = F.when(~F.col("_binary"), F.col("_all")).when(F.least("_no", "_yes") > 0, F.least("_no", "_yes")).otherwise(F.greatest("_no", "_yes"))
    counts = counts.select(*by, "_binary", F.greatest(F.lit(2), F.least(F.lit(folds), rarer, F.col("_all"))).alias("_folds"))
    rows = join_by(hashed, counts, by).withColumn("_class", F.when(F.col("_binary"), F.col("_y")).otherwise(0.0))
    ranked = running(rows, {"_rank": F.lit(1)}, [*by, "_class"], ["_hash", *key], Stretches(hashed.select("_hash")))
    fold = F.pmod(F.col("_rank") - 1 + F.when(F.col("_class") == 1, F.floor(F.col("_folds") / 2)).otherwise(0), F.col("_folds"))
    return ranked.withColumn(name, fold.cast("int")).select(*df.columns, name)


def _share(most: int) -> Column:
    """The part of a segment's rows, of which there are _all, that ``most`` of them are."""
    return F.least(F.lit(1.0), F.lit(float(most)) / F.col("_all"))


def _hash(seed: int) -> Column:
    return F.xxhash64("x", "y", "w", F.lit(seed))


def _in_reach(rows: DataFrame, totals: DataFrame, by: By, most: int, seed: int) -> DataFrame:
    """The rows of all cells of which ``_thinned`` can draw any.

    A cell of n rows is drawn from where its hash lies below 1 - (1 - share)**n,
    which is at most n * share; n is at most _most, the rows of the segment's
    most frequent score.  So whole cells stay or go before they are counted.
    """
    place = _hash(seed).cast("double") / 2.0**64
    place = F.when(place < 0, place + 1.0).otherwise(place)
    reach = _share(most) * F.col("_most") * (1 + 1e-9)
    return join_by(rows, totals, by).where((place < reach) | (reach >= 1)).select(*rows.columns)


def _thinned(cells: DataFrame, by: By, most: int, seed: int, totals: DataFrame | None = None) -> DataFrame:
    """Cells with n drawn binomially so that a segment keeps about ``most`` rows; segments of fewer are whole.

    The cell's hash tells the first of its rows that is drawn, a geometric
    number; those after it are drawn binomially.  ``totals`` has the rows of
    each segment, where ``cells`` are not all.
    """
    found = cells.groupBy(*by).agg(F.sum("n").alias("_all")) if totals is None else totals
    rows = join_by(cells, found.select(*by, "_all"), by).withColumn("_share", _share(most)).withColumn("_seed", _hash(seed))

    @F.pandas_udf("long")
    def drawn(n: pd.Series, share: pd.Series, seed: pd.Series) -> pd.Series:
        """From a hash of the cell, so that the draw does not depend on the table's layout."""
        out, share, seeds = n.to_numpy().copy(), share.to_numpy(), seed.to_numpy()
        place = seeds.view(np.uint64).astype(float) / 2.0**64
        one, part = place < share, share < 1
        with np.errstate(divide="ignore"):
            before = np.where(one, 0, np.log1p(-place) / np.log1p(-np.where(part, share, 0.5)))
        met = part & np.where(out == 1, one, before < out)
        out[part & ~met] = 0
        for i in np.flatnonzero(met & (out > 1)):
            after = np.random.Generator(np.random.PCG64(int(seeds[i]) % 2**63))
            out[i] = 1 + after.binomial(int(out[i]) - 1 - int(before[i]), float(share[i]))
        return pd.Series(out)

    return rows.withColumn("n", drawn("n", "_share", "_seed")).where("n > 0").select(*cells.columns)


def dealt_folds(y: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """Stratified folds of the rows of one segment's sample, in its order."""
    binary = bool(np.isin(y, (0.0, 1.0)).all())
    counts = np.bincount(y.astype(int)) if binary else np.array([len(y)])
    k = int(max(2, min(folds, counts[counts > 0].min(), len(y))))
    rng, out = np.random.Generator(np.random.PCG64(seed)), np.empty(len(y), int)
    for c, label in enumerate((0.0, 1.0) if binary else (None,)):
        at = np.flatnonzero(y == label) if binary else np.arange(len(y))
        out[rng.permutation(at)] = (np.arange(len(at)) + c * (k // 2)) % k
    return out


def held_out_losses(rows: pd.DataFrame, fitted: Callable, settings: Sequence, folds: int, scoring: str, seed: int) -> list[float]:
    """The mean held-out score of each setting on one segment's rows (x, y, w)."""
    rows = rows.sort_values(["x", "y", "w"])
    x, y, w = (rows[c].to_numpy(float) for c in ("x", "y", "w"))
    fold = dealt_folds(y, folds, seed)
    out = []
    for setting in settings:
        total = weight = 0.0
        for k in np.unique(fold):
            train, held = fold != k, fold == k
            at, which = np.unique(x[train], return_inverse=True)
            tw, twy, n = (np.bincount(which, v) for v in (w[train], w[train] * y[train], np.ones(train.sum())))
            try:
                p = fitted(at, np.divide(twy, tw, out=np.zeros(len(at)), where=tw > 0), tw, n, setting)(x[held])
            except (ValueError, ArithmeticError, np.linalg.LinAlgError):
                total = float("nan")
                break
            q = np.clip(p, S.EPS, 1 - S.EPS)
            loss = -(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)) if scoring == "log_loss" else (y[held] - p) ** 2
            total, weight = total + float(np.dot(w[held], loss)), weight + float(w[held].sum())
        out.append(total / weight if weight > 0 else float("nan"))
    return out


def drawn_rows(cells: DataFrame, by: By = (), most: int = 20_000, seed: int = 0) -> DataFrame:
    """From cells (by, x, y, w), one for each row, those of about ``most`` rows of each segment with n; for first trials only, settings are chosen on all rows."""
    totals = kept(cells.groupBy(*by, "x").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("_all"), F.max("n").alias("_most")))
    near = _in_reach(cells, totals, by, most, seed).groupBy(*by, "x", "y", "w").agg(F.count("*").alias("n"))
    return _thinned(near, by, most, seed, totals)


def _loss(scoring: str) -> Column:
    """The summed loss of held-out scores (p, w, wy); Brier up to what no setting changes."""
    q = S.clipped(F.col("p"))
    if scoring == "log_loss":
        return F.sum(-(F.col("wy") * F.ln(q) + (F.col("w") - F.col("wy")) * F.ln(1 - q)))
    return F.sum(F.col("w") * F.col("p") * F.col("p") - 2 * F.col("wy") * F.col("p") + F.col("wy"))


def _train_and_held(rows: DataFrame, by: By, folds: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (by, x, y, w) the tie tables (by, _fold, x, ...) outside and inside each stratified fold.

    A score's sums of all folds are one row, so rows are grouped and moved once.
    """
    dealt = stratified_folds(rows, ["x", "y", "w"], "y", folds, seed, "_fold", by)
    inside = lambda k: F.col("_fold") == k
    sums = {"n": lambda k: F.count_if(inside(k)), "w": lambda k: F.sum(F.when(inside(k), F.col("w")).otherwise(0.0)), "wy": lambda k: F.sum(F.when(inside(k), F.col("w") * F.col("y")).otherwise(0.0))}
    folded = kept(dealt.groupBy(*by, "x").agg(*(f(k).alias(f"_{c}{k}") for c, f in sums.items() for k in range(folds))))

    def table(of: Callable[[int], list[int]]) -> DataFrame:
        each = F.array(*(F.struct(F.lit(k).alias("_fold"), *(reduce(lambda a, b: a + b, (F.col(f"_{c}{j}") for j in of(k))).alias(c) for c in sums)) for k in range(folds)))
        return folded.select(*by, "x", F.inline(F.filter(each, lambda t: t["n"] > 0))).withColumn("y", F.coalesce(F.try_divide("wy", "w"), F.lit(0.0)))

    return kept(table(lambda k: [j for j in range(folds) if j != k])), kept(table(lambda k: [k]))


def select_by_cv(
    df: DataFrame,
    fitted: Callable,
    settings: Sequence,
    score: str = "score",
    label: str = "label",
    weight: str | None = None,
    by: By = (),
    folds: int = 5,
    scoring: str = "log_loss",
    max_rows: int = 20_000,
    seed: int = 0,
    ties: DataFrame | None = None,
    spread: Sequence[Callable] = (),
) -> DataFrame:
    """(by, setting): for each segment the place of the first best of ``settings`` by its held-out score.

    All rows take part.  Folds are of rows, stratified, and fits see the
    weights of their rows.  For a segment of up to ``max_rows`` rows, each
    setting is a task: ``fitted(x, y, w, n, setting)`` fits a tie table and
    returns a function of scores.  Larger segments are fitted by ``spread``,
    which together try all settings: each takes the tie tables outside and inside the
    folds and their segments (by, _fold), and returns the inner table with
    setting, its place, and p, the fit's output.  ``ties`` may hand in the
    rows' tie table, from which scores are counted.
    """
    if scoring not in SCORINGS:
        raise ValueError(f"scoring must be one of {sorted(SCORINGS)}")
    if not settings:
        raise ValueError("the grid is empty")
    keys = list(by)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = validated(df, score, label).select(*by, F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    counts = rows.groupBy(*by, "x").agg(F.count("*").alias("n")) if ties is None else ties
    totals = kept(counts.groupBy(*by).agg(F.sum("n").alias("_all")))
    large = totals.where(F.col("_all") > max_rows).count() if spread else 0
    of_size = lambda which: join_by(rows, totals.where(which), by).select(*rows.columns)

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["setting"].iloc[0])
        whole = pdf.loc[pdf.index.repeat(pdf["n"].astype(int)), ["x", "y", "w"]]
        (loss,) = held_out_losses(whole, fitted, [settings[i]], folds, scoring, seed)
        return pdf[keys].iloc[:1].assign(setting=i, loss=loss)

    few = of_size(F.col("_all") <= max_rows) if large else rows
    few = kept(few.groupBy(*by, "x", "y", "w").agg(F.count("*").alias("n"))).withColumn("setting", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))))
    types = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    losses = [few.groupBy(*keys, "setting").applyInPandas(scored, types + "setting int, loss double")]
    if large:
        spark = df.sparkSession
        with passing(spark):
            train, held = _train_and_held(of_size(F.col("_all") > max_rows), by, folds, seed)
            for tried in spread:
                with passing(spark):
                    out = tried(train, held, [*by, "_fold"]).groupBy(*keys, "setting").agg((_loss(scoring) / F.sum("w")).alias("loss"))
                    losses.append(kept(out, lasting=True))
    every = reduce(DataFrame.unionByName, losses).where("loss is not null and not isnan(loss)")
    found = kept(every.groupBy(*by).agg(F.min_by("setting", F.struct("loss", "setting")).alias("setting")))
    if found.where("setting is null").count() or found.isEmpty():
        raise ValueError("no setting could be scored")
    return found


def _tie_folds(ties: DataFrame, folds: int) -> DataFrame:
    """A tie table dealt into folds: the labels' weights of each score go round by thinning.

    They are dealt in units of the score's mean row weight, and a unit's
    fraction goes to one fold, so the folds' weights sum to the table's.  A
    score of one row falls into one fold, whatever its weight.
    """
    rows = ties.where("w > 0").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rows = rows.withColumn("_pos", F.col("wy")).withColumn("_neg", F.col("w") - F.col("wy"))
    for salt, c in ((1, "_pos"), (2, "_neg")):
        some = F.col(c) > F.col("w") * 1e-14  # less is rounding of the sums
        raw = F.col(c) * F.col("n") / F.col("w")
        units = F.when((F.round(raw) >= 1) & (F.abs(raw - F.round(raw)) < 1e-9), F.round(raw)).otherwise(raw)
        each = F.floor(units / folds)
        turn = F.pmod(F.xxhash64("x", F.lit(salt)) + F.col("fold"), F.lit(folds))
        dealt = each + F.least(F.lit(1.0), F.greatest(F.lit(0.0), units - folds * each - turn))
        rows = rows.withColumn(f"{c}_n", F.when(some, dealt).otherwise(0.0)).withColumn(c, F.when(some, F.col(c) * dealt / units).otherwise(0.0))
    rows = rows.withColumn("w", F.col("_pos") + F.col("_neg")).withColumn("wy", F.col("_pos")).where("w > 0")
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.round(F.col("_pos_n") + F.col("_neg_n"))).cast("long"))
    return rows.withColumn("y", F.col("wy") / F.col("w")).drop("_pos", "_neg", "_pos_n", "_neg_n")


def select_setting(ties: DataFrame, make: Callable, grid: Sequence, folds: int = 5, scoring: str = "log_loss"):
    """The first best of ``grid`` by the mean held-out score over folds.

    Folds are additive on tie tables: a fold's training table is the sum of the
    others.  All folds of a candidate fit in one pass, as segments.
    """
    if scoring not in SCORINGS:
        raise ValueError(f"scoring must be one of {sorted(SCORINGS)}")
    if not grid:
        raise ValueError("the grid is empty")
    held = _tie_folds(ties, folds).cache()
    others = held.crossJoin(held.sparkSession.range(folds).select(F.col("id").cast("int").alias("to"))).where("fold <> to")
    train = others.groupBy("to", "x").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("wy").alias("wy")).withColumn("y", F.col("wy") / F.col("w")).withColumnRenamed("to", "fold").cache()
    scored = []
    for i, setting in enumerate(grid):
        model = make(setting).fit_ties(train, ["fold"])
        out = model.transform(held, "x", "p")
        q = S.clipped(F.col("p"))
        total = -(F.col("wy") * F.ln(q) + (F.col("w") - F.col("wy")) * F.ln(1 - q)) if scoring == "log_loss" else F.col("w") * F.col("p") * F.col("p") - 2 * F.col("wy") * F.col("p") + F.col("wy")
        scored.append(out.agg(F.lit(i).alias("i"), (F.sum(total) / F.sum("w")).alias("score")))
    found = reduce(DataFrame.unionByName, scored).where("score is not null and not isnan(score)").orderBy("score", "i").first()
    held.unpersist()
    train.unpersist()
    if found is None:
        raise ValueError("no setting could be scored")
    return grid[found["i"]]


def _without_each_fold(dealt: DataFrame, folds: int, score: str, label: str, by: By, digits: int | None) -> DataFrame:
    """The tie table of the rows outside each fold, with _fold.

    A score's sums of all folds are one row, so rows are grouped and moved
    once; a score that only one fold has is left out of that fold's table.
    """
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    x = x if digits is None else F.round(x, digits)
    outside = lambda k: F.col("_fold") != k
    each = [(F.count_if(outside(k)).alias(f"_n{k}"), F.sum(F.when(outside(k), y)).alias(f"_y{k}")) for k in range(folds)]
    sums = dealt.groupBy(*by, x.alias("x")).agg(*(c for pair in each for c in pair))
    tables = F.array(*(F.struct(F.lit(k).alias("_fold"), F.col(f"_n{k}").alias("n"), F.col(f"_y{k}").alias("wy")) for k in range(folds)))
    rows = sums.select(*by, "x", F.inline(F.filter(tables, lambda t: t["n"] > 0)))
    return rows.select(*by, "_fold", "x", "n", F.col("n").cast("double").alias("w"), "wy", (F.col("wy") / F.col("n")).alias("y"))


def cross_val_calibrate(df: DataFrame, calibrator, key: Sequence[str], score: str = "score", label: str = "label", folds: int = 5, seed: int = 0, output: str = "calibrated", by: By = (), stratified: bool = False) -> DataFrame:
    """df with each row's output of the map fitted on the other folds.

    Folds come from a hash of the key, without moving a row, or are
    ``stratified`` exactly.  Settings that are ``auto`` are chosen anew on each
    fold's training rows.
    """
    dealt = kept(stratified_folds(df, key, label, folds, seed, "_fold", by)) if stratified else with_folds(df, key, folds, seed, "_fold")
    own = [*by, "_fold"]
    if calibrator.automatic():
        train = dealt.withColumn("_to", F.explode(F.array(*map(F.lit, range(folds))))).where("_fold <> _to").drop("_fold").withColumnRenamed("_to", "_fold")
        held = join_by(train, dealt.select(*own).distinct().withColumn("_held", F.lit(True)), own).drop("_held")
        return calibrator.fit(held, score, label, by=own).transform(dealt, score, output).drop("_fold")
    train = _without_each_fold(validated(dealt, score, label), folds, score, label, by, calibrator.digits)
    model = calibrator.fit_ties(train, own)
    model.knots = kept(model.knots)
    return model.transform(dealt, score, output).drop("_fold")

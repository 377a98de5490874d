"""Monotone calibrators: fit on rows, keep knots, transform without a shuffle of the fit.

Every calibrator fits one map per segment of ``by`` in one pass, on the scores
as they are; ``digits`` rounds them first, only where it is given.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecal.functions import kernels
from scorecal.functions import scores as S
from scorecal.operators.curves import apply_linear, apply_step
from scorecal.operators.isotonic import bounded_fit, centred_knots, pav_blocks, step_knots, with_running_max
from scorecal.operators.keep import kept
from scorecal.operators.nearly import nearly_isotonic_fit
from scorecal.operators.ranges import Stretches, running, with_neighbours
from scorecal.operators.smoothed import smoothed_fit
from scorecal.operators.splines import fit_splines, spline_value, with_basis, with_value
from scorecal.operators.ties import By, checked_weights, join_by, ordered, tie_table

# The grids of settings chosen by cross-validation.
EPSILON_GRID = [0.0, 0.001, 0.005, 0.01, 0.05]
LAM_GRID = [0.0, 0.001, 0.01, 0.1, 1.0, 10.0]
ALPHA_GRID = [0.0, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0]


RANKS = 4096  # scores in a stretch of ranks


@dataclass
class Model:
    """A fitted map: knots (by, x, y), joined by lines or steps, and the chosen settings."""

    knots: DataFrame
    by: By = ()
    step: bool = False
    out_of_bounds: str = "clip"
    params: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, score: str = "score", output: str = "calibrated") -> DataFrame:
        out = (apply_step if self.step else apply_linear)(df, self.knots, score, output, self.by)
        if self.out_of_bounds == "clip":
            return out
        span = self.knots.groupBy(*self.by).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
        out = join_by(out, span, self.by)
        outside = (F.col(score) < F.col("_lo")) | (F.col(score) > F.col("_hi"))
        told = F.lit(float("nan")) if self.out_of_bounds == "nan" else F.raise_error(F.lit("score outside the fitted range"))
        return out.withColumn(output, F.when(outside, told.cast("double")).otherwise(F.col(output))).drop("_lo", "_hi")

    def save(self, path: str) -> None:
        self.knots.write.mode("overwrite").parquet(path)

    def check_monotonic(self, strict: bool = False) -> DataFrame:
        """(by, monotonic) of the knots."""
        placed = Stretches(self.knots.select("x")).of(self.knots, "x")
        rise = F.col("y") - F.col("before")
        bad = (rise <= 0) if strict else (rise < 0)
        return with_neighbours(placed, F.col("y"), self.by).withColumn("_bad", F.coalesce(bad, F.lit(False))).groupBy(*self.by).agg((~F.max("_bad")).alias("monotonic"))


@dataclass(kw_only=True)
class Calibrator:
    """Settings of a calibrator; ``fit`` leaves them as they are and writes the knots once."""

    digits: int | None = None
    weighted = True

    def fit(self, df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None, by: By = (), ties: DataFrame | None = None) -> Model:
        """The map of the rows; ``ties`` may hand in their tie table."""
        if weight is not None:
            if not self.weighted:
                raise ValueError(f"{type(self).__name__} takes no weights")
            df = checked_weights(df, weight)
        ties = kept(tie_table(df, score, label, weight, by, self.digits) if ties is None else ties)
        settings = self.chosen(df, score, label, weight, by, ties) if self.automatic() else None
        model = self.fit_ties(ties if settings is None else join_by(ties, settings, by), by)
        model.knots = kept(model.knots)
        return model

    def automatic(self) -> bool:
        """Whether settings are left to cross-validation."""
        return False

    def chosen(self, df: DataFrame, score: str, label: str, weight: str | None, by: By, ties: DataFrame | None = None) -> DataFrame:
        """(by, ...): the settings of each segment, by cross-validation on its rows."""
        raise NotImplementedError

    def fit_ties(self, ties: DataFrame, by: By = ()) -> Model:
        """The map of a tie table, which has the columns of ``chosen`` where settings were left to choose."""
        raise NotImplementedError

    def fit_transform(self, df: DataFrame, score: str = "score", label: str = "label", output: str = "calibrated", **more) -> DataFrame:
        return self.fit(df, score, label, **more).transform(df, score, output)


class SplineModel(Model):
    """Fitted splines (by, t, theta): ``transform`` evaluates them at every score; ``knots`` are points of a grid."""

    def __init__(self, coefficients: DataFrame, by: By, degree: int, link: str, clip: bool, points: int, params: dict):
        self.coefficients, self.shape = coefficients, (degree, link, clip)
        span = coefficients.select("*", F.get("t", F.lit(degree)).alias("_lo"), F.get("t", F.size("t") - degree - 1).alias("_hi"))
        grid = span.select(*by, "t", "theta", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_at"))
        grid = grid.withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_at") / (points - 1))
        knots = with_value(grid, F.col("x"), F.col("t"), F.col("theta"), *self.shape, "y").select(*by, "x", "y")
        super().__init__(knots, by, params=params)

    def transform(self, df: DataFrame, score: str = "score", output: str = "calibrated") -> DataFrame:
        x = F.col(score).cast("double")
        found = self.coefficients.select(*self.by, F.col("t").alias("_sp_knots"), F.col("theta").alias("_sp_coefficients"))
        out = with_value(join_by(df, found, self.by, "left"), x, F.col("_sp_knots"), F.col("_sp_coefficients"), *self.shape, output)
        return out.drop("_sp_knots", "_sp_coefficients")


def _clip(y: Column, clip: bool) -> Column:
    return F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)) if clip else y


@dataclass(kw_only=True)
class Isotonic(Calibrator):
    """Isotonic regression with lines between block ends."""

    y_min: float | None = None
    y_max: float | None = None
    increasing: bool = True
    out_of_bounds: str = "clip"

    def fit_ties(self, ties: DataFrame, by: By = ()) -> Model:
        if self.out_of_bounds not in ("clip", "nan", "raise"):
            raise ValueError("out_of_bounds must be clip, nan or raise")
        knots = step_knots(pav_blocks(ties, by, increasing=self.increasing, weighty=True), by)
        y = F.col("y")
        y = y if self.y_min is None else F.greatest(y, F.lit(float(self.y_min)))
        y = y if self.y_max is None else F.least(y, F.lit(float(self.y_max)))
        return Model(knots.withColumn("y", y), by, out_of_bounds=self.out_of_bounds)


@dataclass(kw_only=True)
class CentredIsotonic(Calibrator):
    """Isotonic regression with lines between block centres; strictly rising inside."""

    clip_output: bool = True

    def fit_ties(self, ties: DataFrame, by: By = ()) -> Model:
        return Model(centred_knots(pav_blocks(ties, by), by).withColumn("y", _clip(F.col("y"), self.clip_output)), by)


@dataclass(kw_only=True)
class RelaxedIsotonic(Calibrator):
    """Isotonic up to falls of ``epsilon``, or with rises of ``min_slope``, between neighbouring scores."""

    epsilon: float | str = 0.0
    min_slope: float | str = 0.0
    clip_output: bool = True
    cv: int = 5
    scoring: str = "log_loss"
    seed: int = 0

    def automatic(self) -> bool:
        return self.epsilon == "auto" and not (self.min_slope != "auto" and self.min_slope > 0)

    def chosen(self, df: DataFrame, score: str, label: str, weight: str | None, by: By, ties: DataFrame | None = None) -> DataFrame:
        from scorecal.operators.selection import select_by_cv

        clip = self.clip_output

        def fitted(x, y, w, n, epsilon):
            z = kernels.bounded_steps(y, w, np.full(len(x) - 1, -epsilon))
            z = np.clip(z, 0, 1) if clip else z
            return lambda at: np.interp(at, x, z)

        def spread(train: DataFrame, held: DataFrame, own: list[str]) -> DataFrame:
            """All settings along ranks of scores, between which held-out scores lie: a fit is its blocks less epsilon a rank."""
            rank, names = F.col("_rank").cast("double"), [f"_moved{i}" for i in range(len(EPSILON_GRID))]
            moved = {c: F.col("y") + e * (rank - 1) for c, e in zip(names, EPSILON_GRID, strict=True)}
            ranked = kept(running(train, {"_rank": F.lit(1)}, own).select(*own, F.col("x").alias("_x"), rank.alias("x"), "n", "w", "wy", *(v.alias(c) for c, v in moved.items())))
            among = kept(apply_linear(held, ranked.select(*own, F.col("_x").alias("x"), F.col("x").alias("y")), "x", "_at", own))
            outs = []
            for i, (c, e) in enumerate(zip(names, EPSILON_GRID, strict=True)):
                knots = kept(step_knots(pav_blocks(ranked, own, c), own))
                out = apply_linear(among, knots, "_at", "p", own).withColumn("p", F.col("p") - e * (F.col("_at") - 1))
                outs.append(out.withColumn("p", _clip(F.col("p"), clip)).withColumn("setting", F.lit(i)))
            return reduce(DataFrame.unionByName, outs)

        found = select_by_cv(df, fitted, EPSILON_GRID, score, label, weight, by, self.cv, self.scoring, seed=self.seed, ties=ties, spread=[spread])
        return found.select(*by, F.element_at(F.array(*map(F.lit, EPSILON_GRID)), F.col("setting") + 1).alias("epsilon"))

    def fit_ties(self, ties: DataFrame, by: By = ()) -> Model:
        epsilon = F.col("epsilon") if "epsilon" in ties.columns else F.lit(0.0 if self.epsilon == "auto" else float(self.epsilon))
        slope = 0.0 if self.min_slope == "auto" else float(self.min_slope)
        fixed = 0.0 if self.epsilon == "auto" else float(self.epsilon)
        if min(fixed, slope) < 0 or (fixed > 0 and slope > 0):
            raise ValueError("epsilon and min_slope must not be negative, nor both positive")
        least = F.lit(slope)
        if self.min_slope == "auto" and self.epsilon == "auto":
            # Written, as other tables of a row for each segment, so that Spark sends it round and no task gets a whole segment.
            ties = join_by(ties, kept(ties.groupBy(*by).agg(F.count("*").alias("_m"))), by)
            least = F.when(epsilon == 0, F.lit(0.01) / F.col("_m")).otherwise(0.0)
        ties = kept(ties.withColumn("_least", least - epsilon))
        fit = bounded_fit(ties, "_least", by)
        knots = fit.select(*by, "x", _clip(F.col("z"), self.clip_output).alias("y"))
        return Model(knots, by, params=_settings(ties, by, "epsilon") or {"epsilon": fixed, "min_slope": slope})


def _lines(fit: DataFrame, held: DataFrame, by: By, setting: int, clip: bool) -> DataFrame:
    """``held`` with p, by lines between the fit's scores, and setting."""
    knots = kept(fit.select(*by, "x", _clip(F.col("z"), clip).alias("y")))
    return apply_linear(held, knots, "x", "p", by).withColumn("setting", F.lit(setting))


def _settings(ties: DataFrame, by: By, *names: str) -> dict:
    """The chosen settings: values without segments, a table (by, ...) with them."""
    if not set(names) <= set(ties.columns):
        return {}
    found = kept(ties.groupBy(*by).agg(*(F.first(n).alias(n) for n in names)))
    return {"chosen": found} if by else found.first().asDict()


@dataclass(kw_only=True)
class NearlyIsotonic(Calibrator):
    """Least squares with a price ``lam`` on falls, by the exact solution path."""

    lam: float | str = 1.0
    method: str = "path"
    clip_output: bool = True
    cv: int = 5
    scoring: str = "log_loss"
    weighted = False

    def fit_ties(self, ties: DataFrame, by: By = ()) -> Model:
        if self.method not in ("path", "cvx"):  # both have the same optimum
            raise ValueError("method must be path or cvx")
        ties = kept(ties)
        lam = F.col("lam") if "lam" in ties.columns else F.lit(float(self.lam))
        fit = nearly_isotonic_fit(ties, lam, by)
        knots = fit.select(*by, "x", _clip(F.col("z"), self.clip_output).alias("y"))
        return Model(knots, by, params=_settings(ties, by, "lam") or {"lam": self.lam})

    def automatic(self) -> bool:
        return self.lam == "auto"

    def chosen(self, df: DataFrame, score: str, label: str, weight: str | None, by: By, ties: DataFrame | None = None) -> DataFrame:
        from scorecal.operators.selection import select_by_cv

        clip = self.clip_output

        def fitted(x, y, w, n, lam):
            z = kernels.nearly_isotonic(y, w, lam)
            z = np.clip(z, 0, 1) if clip else z
            return lambda at: np.interp(at, x, z)

        def spread(i: int) -> Callable:
            return lambda train, held, own: _lines(nearly_isotonic_fit(train, F.lit(LAM_GRID[i]), own), held, own, i, clip)

        found = select_by_cv(df, fitted, LAM_GRID, score, label, weight, by, self.cv, self.scoring, ties=ties, spread=[*map(spread, range(len(LAM_GRID)))])
        return found.select(*by, F.element_at(F.array(*map(F.lit, LAM_GRID)), F.col("setting") + 1).alias("lam"))


@dataclass(kw_only=True)
class MonotoneSpline(Calibrator):
    """Penalised monotone spline on the log-odds or probability scale."""

    n_knots: int | str = 10
    degree: int = 3
    knots: str = "quantile"
    alpha: float | str = 0.1
    link: str = "logit"
    clip_output: bool = True
    cv: int = 5
    scoring: str = "log_loss"
    points: int = 2001

    def fit_ties(self, ties: DataFrame, by: By = ()) -> Model:
        if self.link not in ("logit", "identity"):
            raise ValueError("link must be logit or identity")
        ties = kept(ties)
        each = lambda c, fixed: F.first(c) if c in ties.columns else F.first(F.lit(fixed))
        settings = ties.groupBy(*by).agg(F.count("*").alias("_n"), each("n_knots", self.n_knots).alias("n_knots"), each("alpha", self.alpha).alias("alpha"))
        found = fit_splines(ties, kept(settings.where("_n > 0").drop("_n")), self.degree, self.knots, self.link, by)
        params = _settings(ties, by, "n_knots", "alpha") or {"n_knots": self.n_knots, "alpha": self.alpha}
        return SplineModel(found, by, self.degree, self.link, self.clip_output, self.points, params)

    def automatic(self) -> bool:
        return "auto" in (self.alpha, self.n_knots)

    def chosen(self, df: DataFrame, score: str, label: str, weight: str | None, by: By, ties: DataFrame | None = None) -> DataFrame:
        from scorecal.operators.selection import select_by_cv

        counts = [5, 10, 20] if self.n_knots == "auto" else [self.n_knots]
        alphas = ALPHA_GRID if self.alpha == "auto" else [self.alpha]
        grid = [(k, float(a)) for k in counts for a in alphas]
        degree, kind, link, clip = self.degree, self.knots, self.link, self.clip_output

        def fitted(x, y, w, n, setting):
            return _spline(x, y, w, n, *setting, degree, kind, link, clip)[1]

        every = F.array(*(F.struct(F.lit(k).alias("n_knots"), F.lit(a).alias("alpha")) for k, a in grid))

        def spread(train: DataFrame, held: DataFrame, own: list[str]) -> DataFrame:
            """All settings at once, as they share passes over the scores."""
            tried = kept(train.select(*own).distinct()).select(*own, F.posexplode(every).alias("setting", "_s")).select(*own, "setting", "_s.*")
            found = fit_splines(train, kept(tried), degree, kind, link, own, ["setting"])
            shape = [*own, "n_knots"]
            based = with_basis(join_by(held, kept(found.select(*shape, "t").distinct()), own), F.col("x"), F.col("t"), degree)
            return join_by(based, found.select(*shape, "setting", "theta"), shape).withColumn("p", spline_value("theta", degree, link, clip))

        found = select_by_cv(df, fitted, grid, score, label, weight, by, self.cv, self.scoring, ties=ties, spread=[spread])
        each = F.element_at(every, F.col("setting") + 1)
        return found.select(*by, each["n_knots"].alias("n_knots"), each["alpha"].alias("alpha"))


def _spline(x, y, w, n, n_knots: int, alpha: float, degree: int, kind: str, link: str, clip: bool):
    """The knots of a fitted spline, and its function."""
    at = kernels.knots_for(x, n, n_knots, kind)
    beta = kernels.fit_spline(kernels.spline_design(x, at, degree), y, w, alpha, link)

    def predict(scores: np.ndarray) -> np.ndarray:
        z = kernels.predict_spline(beta, kernels.spline_design(scores, at, degree), link)
        return np.clip(z, 0, 1) if clip else z

    return at, predict


@dataclass(kw_only=True)
class RegularizedIsotonic(MonotoneSpline):
    """The same spline with a fixed number of knots and ``alpha`` chosen by cross-validation."""

    alpha: float | str = "auto"


@dataclass(kw_only=True)
class SmoothedIsotonic(Calibrator):
    """Isotonic fit, Savitzky-Golay smoothed and made monotone again."""

    window_length: int | None = None
    poly_order: int = 3
    adaptive: bool = False
    min_window: int = 5
    max_window: int | None = None
    clip_output: bool = True
    weighted = False

    def fit_ties(self, ties: DataFrame, by: By = ()) -> Model:
        fit = smoothed_fit(ties, self.window_length, self.poly_order, self.adaptive, self.min_window, self.max_window, by)
        return Model(fit.select(*by, "x", _clip(F.col("z"), self.clip_output).alias("y")), by)


@dataclass(kw_only=True)
class DecisionAwareIsotonic(Calibrator):
    """Isotonic with neighbour bounds that keep differences near decision thresholds.

    ``cdi_bounds`` has the bound of each neighbouring pair; the map is a step
    function.  Scores are normalised to [0, 1] first, and thresholds are on
    that axis.
    """

    thresholds: tuple[float, ...] = ()
    threshold_weights: tuple[float, ...] = ()
    bandwidth: float = 0.05
    alpha: float = 0.05
    gamma: float = 0.15
    window: int = 25
    clip_output: bool = True

    def bounds(self, ties: DataFrame, by: By = ()) -> DataFrame:
        """The tie table with bound: the least step from the score before it.

        Sums over neighbouring scores are taken in stretches of ranks that
        overlap by a window.
        """
        z = NormalDist().inv_cdf(1 - self.alpha / 2)
        ties = kept(ties)
        ends = ties.groupBy(*by).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
        ranked = join_by(running(ties, {"_rank": F.lit(1)}, by).drop("_part"), ends, by)
        stretch = lambda rank: F.floor(rank / max(RANKS, self.window))
        rank = F.col("_rank")
        rows = ranked.withColumn("_in", F.explode(F.array_distinct(F.array(*(stretch(rank + d) for d in (0, self.window, -self.window))))))
        w = ordered([*by, "_in"], "_rank")
        left, right = w.rowsBetween(-self.window, -1), w.rowsBetween(0, self.window - 1)
        wl, yl, wr, yr = F.sum("w").over(left), F.sum("wy").over(left), F.sum("w").over(right), F.sum("wy").over(right)
        p_l, p_r = F.try_divide(yl, wl), F.try_divide(yr, wr)
        pool = F.try_divide(yl + yr, wl + wr)
        se = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), wl) + F.try_divide(F.lit(1.0), wr)))
        scale = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
        mid = ((F.col("x") + F.lag("x").over(w)) / 2 - F.col("_lo")) / scale
        part = self.threshold_weights or (1.0,) * len(self.thresholds)
        if sum(part) > 0:
            near = reduce(lambda a, b: a + b, (a * S.triangle(mid - t, self.bandwidth) for t, a in zip(self.thresholds, part, strict=True))) / (sum(part) + 1e-12)
        else:
            near = F.lit(1.0)
        rows = rows.withColumns({"_near": F.when(rank > 1, near), "_gap": p_r - p_l, "_se": se})
        rows = kept(rows.where(stretch(rank) == F.col("_in")).select(*ties.columns, "_near", "_gap", "_se"))
        rows = join_by(rows, rows.groupBy(*by).agg(F.max("_near").alias("_top")), by)
        e = F.when((F.col("_top") > 0) & F.lit(sum(part) > 0), F.col("_near") / F.col("_top")).otherwise(F.col("_near"))
        bound = self.gamma * e * F.greatest(F.lit(0.0), F.col("_gap") - z * F.col("_se")) - (1 - e) * z * F.col("_se")
        return rows.withColumn("bound", F.coalesce(bound, F.lit(0.0))).drop("_near", "_gap", "_se", "_top")

    def fit_ties(self, ties: DataFrame, by: By = ()) -> Model:
        fit = bounded_fit(self.bounds(ties, by), "bound", by)
        return Model(fit.select(*by, "x", _clip(F.col("z"), self.clip_output).alias("y")), by, step=True)


def enforce_monotonic(df: DataFrame, value: str, by: By = (), order: str = "x") -> DataFrame:
    """Running maximum along ``order``; for tie tables and knots."""
    return with_running_max(df, value, by, order)


@dataclass(kw_only=True)
class TemperatureScaler:
    """One temperature for a probability vector, by golden section on the mean log loss."""

    max_log_temperature: float = 3.0
    rounds: int = 6
    parallel: int = 16

    def loss(self, cells: DataFrame, log_temperatures: list[float]) -> list[float]:
        """The mean log loss at each temperature, from cells (_l, _y, _n): log probabilities, label and rows."""
        sharp = np.exp(-np.array(log_temperatures))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight = np.zeros(len(sharp)), 0
            for batch in batches:
                l, y, n = (batch.column(c) for c in range(3))
                n, y = n.to_numpy(), y.to_numpy()
                sizes, values = np.diff(l.offsets.to_numpy()), l.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                top, own = np.maximum.reduceat(values, starts), values[starts + y]
                for i, a in enumerate(sharp):
                    z = np.exp((values - np.repeat(top, sizes)) * a)
                    total[i] += np.dot(n, np.log(np.add.reduceat(z, starts)) - (own - top) * a)
                weight += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sharp), dtype=np.int32)), pa.array(total), pa.array(np.full(len(sharp), weight))], ["i", "total", "n"])

        found = cells.mapInArrow(run, "i int, total double, n long").groupBy("i").agg((F.sum("total") / F.sum("n")).alias("loss"))
        return [r["loss"] for r in sorted(found.collect())]

    def fit(self, df: DataFrame, probabilities: str = "probabilities", label: str = "label") -> float:
        """The temperature; each round evaluates a whole bracket in one pass over the distinct (probabilities, label)."""
        y = F.col(label).cast("int")
        told = (y >= 0) & (y < F.size(probabilities)) & F.forall(probabilities, lambda v: v.isNotNull())
        cells = df.where(told).groupBy(F.col(probabilities).cast("array<double>").alias("_p"), y.alias("_y")).agg(F.count("*").alias("_n"))
        cells = kept(cells.select(F.transform("_p", lambda v: F.ln(F.greatest(v, F.lit(S.EPS)))).alias("_l"), "_y", "_n"))
        lo, hi = -self.max_log_temperature, self.max_log_temperature
        for _ in range(self.rounds):
            at = [lo + (hi - lo) * k / self.parallel for k in range(self.parallel + 1)]
            found = self.loss(cells, at)
            best = found.index(min(found))
            lo, hi = at[max(0, best - 1)], at[min(self.parallel, best + 1)]
        return math.exp((lo + hi) / 2)


def apply_temperature(df: DataFrame, temperature: float, probabilities: str = "probabilities", output: str = "calibrated") -> DataFrame:
    """softmax(log p / T); the largest class stays the largest."""
    z = F.transform(probabilities, lambda v: F.ln(F.greatest(v, F.lit(S.EPS))) / F.lit(temperature))
    e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    return df.withColumn(output, F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, u: s + u)))


def platt(df: DataFrame, score: str = "score", label: str = "label", rounds: int = 25) -> tuple[float, float]:
    """(slope, intercept) of a logistic map of the log-odds, by Newton steps; one pass over the ties each."""
    ties = tie_table(df, score, label).select(S.logit(F.col("x")).alias("t"), "n", "wy").cache()
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = S.expit(F.col("t") * F.lit(a) + F.lit(b))
        g, h = F.col("n") * p - F.col("wy"), F.col("n") * p * (1 - p)
        s = ties.agg(F.sum(g * F.col("t")), F.sum(g), F.sum(h * F.col("t") * F.col("t")), F.sum(h * F.col("t")), F.sum(h)).first()
        step = np.linalg.solve(np.array([[s[2], s[3]], [s[3], s[4]]]) + 1e-10 * np.eye(2), np.array([s[0], s[1]]))
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-10:
            break
    ties.unpersist()
    return a, b

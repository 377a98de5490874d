"""Bootstrap intervals and resampling bands on the scores as they are.

A resample of the rows is a multinomial draw of the counts of (score, label)
cells, so no row is ever copied.  The draw goes down a tree: first the rows of
a resample are dealt to stretches of the score axis, then those of a stretch
to its cells.  A stretch's task gives each metric's partial state, and the
states of a resample meet, not its cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.functions import kernels
from scorecal.operators.isotonic import pav_fit
from scorecal.operators.keep import kept
from scorecal.operators.ranges import Stretches
from scorecal.operators.ties import By, join_by, tie_table, validated

BATCH = 50  # resamples that a task draws
CELLS = 1 << 15  # cells of a stretch, about
BAND_TIES = 1 << 11  # scores of a stretch where bands are drawn, since all resamples of a score meet
PARTS = 64


def _ties(x, y, n):
    """The distinct scores of ascending x, their weights and weighted labels."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.add.reduceat(n, first), np.add.reduceat(n * y, first)


class Metric:
    """A statistic of a resample as a state of each stretch, and its value from their states in order of the scores."""

    def state(self, x: np.ndarray, y: np.ndarray, k: np.ndarray, before: int, total: int) -> np.ndarray:
        """x ascends; k rows of each cell, all positive; ``before`` rows of the resample lie below, of ``total``."""
        raise NotImplementedError

    def value(self, states: list[np.ndarray], total: int) -> float:
        raise NotImplementedError

    def __call__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
        """On one table of cells."""
        order = np.lexsort((y, x))
        total = int(n.sum())
        return self.value([self.state(x[order], y[order], n[order], 0, total)], total)


class Brier(Metric):
    def state(self, x, y, k, before, total):
        return np.array([np.dot(k, (x - y) ** 2)])

    def value(self, states, total):
        return float(sum(s[0] for s in states) / total)


class SmoothError(Metric):
    """Sums on the grids of all bandwidths, of the grid points that the stretch touches."""

    sizes = sorted({kernels.grid_size(j / 1024) for j in range(1, 1025)})

    def state(self, x, y, k, before, total):
        out = []
        for m in self.sizes:
            lo, hi = (int(np.clip(np.floor(v * (m - 1)), 0, m - 2)) for v in (x[0], x[-1]))
            out += [[lo, hi + 2], *(kernels.spread(x, v, m)[lo : hi + 2] for v in (k * (x - y), k))]
        return np.concatenate(out)

    def value(self, states, total):
        sums = {m: np.zeros((2, m)) for m in self.sizes}
        for s in states:
            at = 0
            for m in self.sizes:
                lo, hi = int(s[at]), int(s[at + 1])
                sums[m][:, lo:hi] += s[at + 2 : at + 2 + 2 * (hi - lo)].reshape(2, -1)
                at += 2 + 2 * (hi - lo)
        error = lambda s: kernels.smoothed_error(*sums[kernels.grid_size(s)], s)
        return error(kernels.chosen_bandwidth(error))


class DebiasedError(Metric):
    """Sums through the scores at which an equal-mass bin ends."""

    bins = 15

    def state(self, x, y, k, before, total):
        at, w, wy = _ties(x, y, k)
        hi = before + np.cumsum(w).astype(np.int64)
        lo = hi - w.astype(np.int64)
        b = min(self.bins, total)
        through = lambda r: np.minimum(b - 1, ((r + 1) * b - 1) // total)
        ends = np.flatnonzero((through(hi) > through(lo)) | (hi == total))
        parts = np.searchsorted(ends, np.arange(len(at)))
        sums = [np.bincount(parts, v, len(ends) + 1) for v in (w, w * at, wy)]
        return np.concatenate([[len(ends)], *sums])

    def value(self, states, total):
        rows, left = [], np.zeros(3)
        for s in states:
            sums = s[1:].reshape(3, -1)
            for i in range(int(s[0])):
                rows.append(left + sums[:, i])
                left = np.zeros(3)
            left = left + sums[:, -1]
        k, x, y = np.array(rows).T
        conf, acc = x / k, y / k
        term = np.where(k > 1, (conf - acc) ** 2 - acc * (1 - acc) / np.maximum(k - 1, 1), 0)
        return float(np.sqrt(max(0.0, np.dot(k / total, term))))


class Miscalibration(Metric):
    """The scores' own Brier sum, and the isotonic blocks of the stretch."""

    def state(self, x, y, k, before, total):
        at, w, wy = _ties(x, y, k)
        z = kernels.pava(wy / w, w)
        first = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]]))
        return np.concatenate([[np.sum(w * at * at - 2 * wy * at)], np.add.reduceat(w, first), np.add.reduceat(wy, first)])

    def value(self, states, total):
        w, wy = np.concatenate([s[1:].reshape(2, -1) for s in states], axis=1)
        z = kernels.pava(wy / w, w)
        return float((sum(s[0] for s in states) - np.sum(w * z * z - 2 * wy * z)) / total)


@dataclass
class Whole(Metric):
    """Any function of (scores, labels, counts); a resample's cells meet in one task."""

    function: Callable

    def state(self, x, y, k, before, total):
        return np.concatenate([x, y, k])

    def value(self, states, total):
        return float(self.function(*np.concatenate([s.reshape(3, -1) for s in states], axis=1)))


METRICS: dict[str, Metric] = {"brier": Brier(), "smece": SmoothError(), "debiased_ece": DebiasedError(), "mcb": Miscalibration()}


def _named(metrics: list[str] | dict[str, Callable | Metric]) -> dict[str, Metric]:
    named = metrics if isinstance(metrics, dict) else {m: METRICS[m] for m in metrics}
    return {m: f if isinstance(f, Metric) else Whole(f) for m, f in named.items()}


def _generator(seed: int, resample: int, segment: tuple, part: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([seed, resample, crc32(repr(segment).encode()), part]))


def _types(df: DataFrame, by: By) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def _segment(pdf: pd.DataFrame, keys: list[str]) -> tuple:
    return tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in pdf[keys].iloc[0])


def _of(segment: tuple, keys: list[str], out: pd.DataFrame) -> pd.DataFrame:
    for c, v in reversed(list(zip(keys, segment, strict=True))):
        out.insert(0, c, [v] * len(out))
    return out


def _cells(df: DataFrame, score: str, label: str, by: By, digits: int | None) -> DataFrame:
    x = F.col(score).cast("double")
    x = x if digits is None else F.round(x, digits)
    return kept(validated(df, score, label).groupBy(*by, x.alias("x"), F.col(label).cast("double").alias("y")).agg(F.count("*").alias("n")))


def bootstrap_draws(df: DataFrame, metrics: list[str] | dict[str, Callable], n_resamples: int = 1000, seed: int = 0, score: str = "score", label: str = "label", by: By = (), digits: int | None = None, cells: int = CELLS) -> DataFrame:
    """(by, resample, metric, value); resample -1 is the observed value.

    The draws depend on the seed, the segment and the table's distinct cells,
    not on how its rows are laid out.
    """
    named, keys = _named(metrics), list(by)
    found = _cells(df, score, label, by, digits)
    placed = kept(Stretches.of_distinct(found.select("x"), cells).of(found, "x"))
    own = [*keys, "_part"]
    sizes = placed.groupBy(*own).agg(F.sum("n").alias("size"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of every resample in every stretch of a segment."""
        pdf = pdf.sort_values("_part")
        segment, size = _segment(pdf, keys), pdf["size"].to_numpy()
        drawn = [size] + [_generator(seed, r, segment, 0).multinomial(size.sum(), size / size.sum()) for r in range(n_resamples)]
        drawn = np.stack(drawn)
        before = np.cumsum(drawn, axis=1) - drawn
        return _of(segment, keys, pd.DataFrame({"_part": pdf["_part"].to_numpy(), "counts": list(drawn.T), "before": list(before.T), "total": size.sum()}))

    counts = kept(sizes.groupBy(*keys).applyInPandas(deal, _types(found, by) + "_part int, counts array<long>, before array<long>, total long"))
    batch = F.explode(F.sequence(F.lit(0), F.lit(-(-n_resamples // BATCH) - 1))).alias("batch")
    left, right = placed.select("*", batch), counts.select("*", batch)

    def draw(own_cells: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        rows = []
        segment = _segment(dealt, keys)
        own_cells = own_cells.sort_values(["x", "y"])
        x, y, n = (own_cells[c].to_numpy() for c in ("x", "y", "n"))
        part, batch, total = (int(dealt[c].iloc[0]) for c in ("_part", "batch", "total"))
        counts, before = dealt["counts"].iloc[0], dealt["before"].iloc[0]
        share = n / n.sum()
        for r in range(batch * BATCH - (batch == 0), min((batch + 1) * BATCH, n_resamples)):
            k = n if r < 0 else _generator(seed, r, segment, part + 1).multinomial(counts[r + 1], share)
            some = k > 0
            if some.any():
                rows += [(r, m, part, total, f.state(x[some], y[some], k[some].astype(float), int(before[r + 1]), total)) for m, f in named.items()]
        return _of(segment, keys, pd.DataFrame(rows, columns=["resample", "metric", "_part", "total", "state"]))

    together = [*own, "batch"]
    states = left.groupBy(*together).cogroup(right.groupBy(*together)).applyInPandas(draw, _types(found, by) + "resample int, metric string, _part int, total long, state array<double>")

    def value(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        m = pdf["metric"].iloc[0]
        out = named[m].value([np.asarray(s, float) for s in pdf["state"]], int(pdf["total"].iloc[0]))
        return _of(_segment(pdf, keys), keys, pd.DataFrame([(int(pdf["resample"].iloc[0]), m, out)], columns=["resample", "metric", "value"]))

    return states.groupBy(*keys, "resample", "metric").applyInPandas(value, _types(found, by) + "resample int, metric string, value double")


def interval(draws: np.ndarray, observed: float, level: float = 0.95, method: str = "bc", left_out: np.ndarray | None = None, acceleration: float = 0.0) -> dict:
    """An interval from sorted or unsorted draws: percentile, basic, bc or bca.

    bca takes the acceleration, or the values with one row left out.
    """
    if not 0 < level < 1:
        raise ValueError("level must lie in (0, 1)")
    tails = np.array([(1 - level) / 2, (1 + level) / 2])
    if method in ("bc", "bca"):
        below = np.mean(draws < observed) + 0.5 * np.mean(draws == observed)
        floor = 1 / (len(draws) + 1)
        z0 = NormalDist().inv_cdf(min(max(below, floor), 1 - floor))
        a = acceleration if method == "bca" else 0.0
        if method == "bca" and left_out is not None:
            c = left_out.mean() - left_out
            a = float((c**3).sum() / (6 * (c**2).sum() ** 1.5)) if (c**2).sum() > 0 else 0.0
        z = np.array([NormalDist().inv_cdf(t) for t in tails])
        tails = np.clip([NormalDist().cdf(z0 + (z0 + v) / (1 - a * (z0 + v))) for v in z], 0, 1)
    elif method not in ("percentile", "basic"):
        raise ValueError("method must be percentile, basic, bc or bca")
    lo, hi = np.quantile(draws, tails)
    if method == "basic":
        lo, hi = 2 * observed - hi, 2 * observed - lo
    return {"estimate": observed, "lower": float(lo), "upper": float(hi), "bias": float(np.mean(draws) - observed), "degenerate": bool(hi - lo < 1e-12)}


def acceleration_rows(cells: DataFrame, named: dict[str, Metric], by: By = ()) -> DataFrame:
    """(by, metric, acceleration) from leaving out one row of each cell.

    As the definition has it, a metric is evaluated once for each cell, so its
    cells must fit into a task; the left-out cells are dealt to tasks.  A value
    counts once for each row of its cell, by weighted sums of its distance
    from the observed value.  For the Brier score the sums are one aggregation.
    """
    keys = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        x, y, n = (pdf[c].to_numpy(float) for c in ("x", "y", "n"))
        rows = []
        if n.sum() > 1:
            whole = {m: f(x, y, n) for m, f in others.items()}
            for i in range(part, len(x), PARTS):
                less = n.copy()
                less[i] -= 1
                keep = less > 0
                for m, f in others.items():
                    d = f(x[keep], y[keep], less[keep]) - whole[m]
                    rows.append((m, n[i], n[i] * d, n[i] * d**2, n[i] * d**3))
        return _of(_segment(pdf, keys), keys, pd.DataFrame(rows, columns=["metric", "s0", "s1", "s2", "s3"]))

    schema = _types(cells, by) + "metric string, s0 double, s1 double, s2 double, s3 double"
    parts = []
    for m in [m for m, f in named.items() if isinstance(f, Brier)]:
        one = (F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))
        whole = cells.groupBy(*by).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * one) / F.sum("n")).alias("_mean"))
        d = (F.col("_mean") - one) / (F.col("_n") - 1)
        n = F.col("n").cast("double")
        parts.append(join_by(cells, whole.where("_n > 1"), by).groupBy(*by).agg(F.sum(n).alias("s0"), F.sum(n * d).alias("s1"), F.sum(n * d * d).alias("s2"), F.sum(n * d * d * d).alias("s3")).withColumn("metric", F.lit(m)))
    others = {m: f for m, f in named.items() if not isinstance(f, Brier)}
    if others:
        dealt = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        parts.append(dealt.groupBy(*keys, "part").applyInPandas(run, schema).groupBy(*by, "metric").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(4))))
    sums = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    mean = F.col("s1") / F.col("s0")
    square = F.col("s2") - F.col("s0") * mean * mean
    cube = F.col("s3") - 3 * mean * F.col("s2") + 2 * F.col("s0") * mean * mean * mean
    return sums.where("s0 > 0").select(*by, "metric", F.when(square > 0, -cube / (6 * F.pow(square, F.lit(1.5)))).otherwise(0.0).alias("acceleration"))


def accelerations(cells: DataFrame, named: dict[str, Metric]) -> dict[str, float]:
    """The acceleration of each metric over one table of cells."""
    return {r["metric"]: r["acceleration"] for r in acceleration_rows(cells, named).collect()}


def bootstrap_ci(df: DataFrame, metrics: list[str] | dict[str, Callable], level: float = 0.95, n_resamples: int = 1000, seed: int = 0, method: str = "bc", by: By = (), **columns) -> DataFrame:
    """(by, metric, estimate, lower, upper, level, n_resamples, method, bias, degenerate).

    ``metrics`` are names, or functions of (scores, labels, counts).
    """
    keys = list(by)
    draws = bootstrap_draws(df, metrics, n_resamples, seed, by=by, **columns)
    if method == "bca":
        cells = _cells(df, columns.get("score", "score"), columns.get("label", "label"), by, columns.get("digits"))
        draws = join_by(draws, kept(acceleration_rows(cells, _named(metrics), by)), [*by, "metric"], "left")
    else:
        draws = draws.withColumn("acceleration", F.lit(0.0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        observed = float(pdf.loc[pdf["resample"] < 0, "value"].iloc[0])
        a = float(pdf["acceleration"].fillna(0.0).iloc[0])
        ends = interval(pdf.loc[pdf["resample"] >= 0, "value"].to_numpy(), observed, level, method, acceleration=a)
        return _of(_segment(pdf, keys), keys, pd.DataFrame([{"metric": pdf["metric"].iloc[0], **ends, "level": level, "n_resamples": n_resamples, "method": method}]))

    return draws.groupBy(*keys, "metric").applyInPandas(run, _types(df, by) + "metric string, estimate double, lower double, upper double, bias double, degenerate boolean, level double, n_resamples int, method string")


def resampling_bands(df: DataFrame, kind: str = "consistency", level: float = 0.9, n_resamples: int = 1000, seed: int = 0, score: str = "score", label: str = "label", by: By = (), digits: int | None = None, scores: int = BAND_TIES) -> DataFrame:
    """(by, x, lower, upper): pointwise bands of the reliability curve at each score.

    consistency: labels are drawn from the scores themselves; confidence: from
    the fitted curve.  Each stretch of scores draws on its own and pools its
    blocks, which keep their numbers of scores; those of a resample are pooled
    again, and the stretch takes over the values of its blocks.
    """
    if not 0 < level < 1 or n_resamples < 2:
        raise ValueError("level must lie in (0, 1), n_resamples be 2 or more")
    if kind not in ("consistency", "confidence"):
        raise ValueError("kind must be consistency or confidence")
    keys = list(by)
    ties = kept(tie_table(df, score, label, by=by, digits=digits))
    chance = ties.withColumn("p", F.col("x")) if kind == "consistency" else pav_fit(ties, by).withColumnRenamed("z", "p")
    chance = kept(chance.select(*by, "x", "n", F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)).alias("p")))
    placed = kept(Stretches.of_distinct(chance.select("x"), scores).of(chance, "x"))
    own = [*keys, "_part"]
    tail = (1 - level) / 2

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each resample the blocks' weights, labels and numbers of scores."""
        pdf = pdf.sort_values("x")
        segment, part, n, p = _segment(pdf, keys), int(pdf["_part"].iloc[0]), pdf["n"].to_numpy(), pdf["p"].to_numpy()

        def each(r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            k = _generator(seed, r, segment, part + 1).binomial(n, p)
            z = kernels.pava(k / n, n)
            first = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]]))
            return np.add.reduceat(n, first), np.add.reduceat(k, first), np.diff(np.append(first, len(n))).astype(np.int32)

        rows = [(r, part, *each(r)) for r in range(n_resamples)]
        return _of(segment, keys, pd.DataFrame(rows, columns=["resample", "_part", "w", "s", "m"]))

    def pooled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        w, s = np.concatenate(list(pdf["w"])).astype(float), np.concatenate(list(pdf["s"]))
        z = np.split(kernels.pava(s / w, w), np.cumsum([len(v) for v in pdf["w"]])[:-1])
        out = pd.DataFrame({"resample": pdf["resample"].to_numpy(), "_part": pdf["_part"].to_numpy(), "z": z, "m": pdf["m"].to_numpy()})
        return _of(_segment(pdf, keys), keys, out)

    def band(own_ties: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        every = np.stack([np.repeat(z, m) for z, m in zip(values["z"], values["m"], strict=True)])
        lower, upper = np.quantile(every, [tail, 1 - tail], axis=0)
        return _of(_segment(own_ties, keys), keys, pd.DataFrame({"x": np.sort(own_ties["x"].to_numpy()), "lower": lower, "upper": upper}))

    head = _types(ties, by)
    found = placed.groupBy(*own).applyInPandas(blocks, head + "resample int, _part int, w array<long>, s array<long>, m array<int>")
    values = kept(found.groupBy(*keys, "resample").applyInPandas(pooled, head + "resample int, _part int, z array<double>, m array<int>"))
    return placed.groupBy(*own).cogroup(values.groupBy(*own)).applyInPandas(band, head + "x double, lower double, upper double")

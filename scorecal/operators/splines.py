"""Monotone splines of all segments at once, fitted on sums that Spark keeps partial.

A score meets ``degree + 1`` of its spline's basis functions, so the normal
equations are banded: a pass over the tie table adds up, for each segment and
knot interval, the products of neighbouring basis values.  What reaches a task
that takes a Newton step are those sums, a few numbers for each interval, and
never a segment's scores.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecal.functions import kernels
from scorecal.functions import scores as S
from scorecal.operators.keep import kept
from scorecal.operators.metrics import quantiles
from scorecal.operators.ties import By, join_by

PASSES = 400  # Newton steps and halvings
SLOTS = 64  # parts of a knot interval for the first guess, about


def knot_table(ties: DataFrame, n_knots: list[int], degree: int, kind: str, by: By = ()) -> DataFrame:
    """(by, n_knots, t): the knots of each segment for each wanted number, with ``degree`` more on each side.

    Quantile knots are exact quantiles of the rows, and even where those
    coincide; a segment of one score has a span of 1.
    """
    if min(n_knots) < 3:
        raise ValueError("n_knots must be 3 or more")
    if degree < 1:
        raise ValueError("degree must be 1 or more")
    if kind not in ("quantile", "uniform"):
        raise ValueError("knots must be quantile or uniform")
    span = ties.groupBy(*by).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    span = span.withColumn("_hi", F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo") + 1.0))
    if kind == "quantile":
        span = join_by(span, quantiles(ties, "x", [k / (c - 1) for c in n_knots for k in range(c)], by, count="n"), by)
    first, every = 1, []
    for c in n_knots:
        width = (F.col("_hi") - F.col("_lo")) / (c - 1)
        even = F.array(*(F.col("_lo") + k * width for k in range(c - 1)), F.col("_hi"))
        inner = even
        if kind == "quantile":
            own = F.slice("_e", first, c)
            rising = F.size(F.array_distinct(own)) == c  # they never fall
            inner = F.when(rising, own).otherwise(even)
        every.append(F.struct(F.lit(c).alias("n_knots"), inner.alias("k")))
        first += c
    rows = span.select(*by, F.explode(F.array(*every)).alias("s")).select(*by, "s.n_knots", "s.k")
    low, high = F.element_at("k", 1), F.element_at("k", -1)
    left = F.array(*(low - (F.element_at("k", 2) - low) * i for i in range(degree, 0, -1)))
    right = F.array(*(high + (high - F.element_at("k", -2)) * i for i in range(1, degree + 1)))
    return rows.select(*by, "n_knots", F.concat(left, "k", right).alias("t"))


def with_basis(df: DataFrame, x: Column, t: Column, degree: int) -> DataFrame:
    """df with _sp_c, the first basis function that x meets, and the values _sp_b0 to _sp_b<degree> from there on.

    Values beyond the knots are those at the outer knots.  Each degree's
    values follow from the one below, at most two of them for each.
    """
    t_name = "_sp_t"
    df = df.withColumn(t_name, t)
    last = F.size(t_name) - degree - 1  # place of the last knot
    low, high = F.get(t_name, F.lit(degree)), F.get(t_name, last)
    df = df.withColumn("_sp_x", F.least(F.greatest(x, low), high))
    passed = F.size(F.filter(F.slice(t_name, degree + 2, F.size(t_name) - 2 * degree - 2), lambda k: k <= F.col("_sp_x")))
    df = df.withColumn("_sp_c", passed.cast("int"))
    knot = lambda i: F.get(t_name, F.col("_sp_c") + degree + i)  # from the one at or below x
    df = df.withColumns({f"_sp_k{i + degree}": knot(i) for i in range(1 - degree, degree + 1)})
    k = lambda i: F.col(f"_sp_k{i + degree}")
    values = [F.lit(1.0)]
    at = F.col("_sp_x")
    for d in range(1, degree + 1):
        # function j of this degree starts at knot j - d and shares the two of the degree below
        rise = [(at - k(j + 1 - d)) / (k(j + 1) - k(j + 1 - d)) for j in range(d)]
        new = []
        for j in range(d + 1):
            up = values[j - 1] * rise[j - 1] if j > 0 else None
            down = values[j] * (1 - rise[j]) if j < d else None
            new.append(up if down is None else down if up is None else up + down)
        df = df.withColumns({f"_sp_v{d}_{j}": v for j, v in enumerate(new)})
        values = [F.col(f"_sp_v{d}_{j}") for j in range(d + 1)]
    df = df.withColumns({f"_sp_b{j}": v for j, v in enumerate(values)})
    spare = [t_name, "_sp_x", *(f"_sp_k{i}" for i in range(1, 2 * degree + 1)), *(f"_sp_v{d}_{j}" for d in range(1, degree + 1) for j in range(d + 1))]
    return df.drop(*spare)


def with_value(df: DataFrame, x: Column, t: Column, theta: Column, degree: int, link: str, clip: bool, output: str) -> DataFrame:
    """df with the spline of coefficients ``theta`` at x, null where x is null or NaN or there are none."""
    df = with_basis(df.withColumn("_sp_theta", theta), x, t, degree)
    value = spline_value("_sp_theta", degree, link, clip)
    df = df.withColumn("_sp_out", F.when(x.isNotNull() & ~F.isnan(x) & F.col("_sp_theta").isNotNull(), value)).drop("_sp_theta", *basis_columns(degree))
    return df.drop(output).withColumnRenamed("_sp_out", output) if output in df.columns else df.withColumnRenamed("_sp_out", output)


def spline_value(theta: str, degree: int, link: str, clip: bool) -> Column:
    """The spline of coefficients ``theta`` where ``with_basis`` has put its values."""
    eta = reduce(lambda a, b: a + b, (F.col(f"_sp_b{j}") * F.get(theta, F.col("_sp_c") + j) for j in range(degree + 1)))
    value = S.expit(eta) if link == "logit" else eta
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) if clip else value


def basis_columns(degree: int) -> list[str]:
    return ["_sp_c", *(f"_sp_b{j}" for j in range(degree + 1))]


def _pairs(degree: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(degree + 1) for j in range(i, degree + 1)]


def _coefficients(increments: str) -> Column:
    """Running sums of an array."""
    return F.transform(F.sequence(F.lit(1), F.size(increments)), lambda i: F.aggregate(F.slice(increments, F.lit(1), i), F.lit(0.0), lambda s, v: s + v))


def _unbanded(pdf: pd.DataFrame, p: int, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives by increments, from the sums of each interval."""
    g, h = np.zeros(p), np.zeros((p, p))
    c = pdf["_sp_c"].to_numpy(int)
    for i in range(degree + 1):
        np.add.at(g, c + i, pdf[f"g{i}"].to_numpy(float))
    for i, j in _pairs(degree):
        v = pdf[f"h{i}{j}"].to_numpy(float)
        np.add.at(h, (c + i, c + j), v)
        if i != j:
            np.add.at(h, (c + j, c + i), v)
    # an increment raises all coefficients from its own on
    return g[::-1].cumsum()[::-1], h[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]


def fit_splines(ties: DataFrame, settings: DataFrame, degree: int = 3, kind: str = "quantile", link: str = "logit", by: By = (), per: By = ()) -> DataFrame:
    """(by, per, t, theta, n_knots, alpha): penalised monotone splines by projected Newton steps.

    ``ties`` is a written tie table and ``settings`` (by, per, n_knots, alpha) has a
    row for each segment, or several that ``per`` tells apart: they share the
    segment's scores and basis values, and a pass adds up the sums of all.  On the probability scale one pass gives all sums; on
    the log-odds scale a pass adds up the sums at each open segment's trial
    point, and a step is halved until the loss falls.  The first point is the
    fit of scores merged within parts of knot intervals.  Segments without weight
    start and stay at 0 on their link's scale.
    """
    counts = sorted(r[0] for r in settings.select("n_knots").distinct().collect()) or [3]  # of a grid
    wanted = join_by(settings, knot_table(ties, counts, degree, kind, by), [*by, "n_knots"])
    totals = ties.groupBy(*by).agg(F.sum("w").alias("_w"), F.sum("wy").alias("_wy"))
    start = F.coalesce(F.try_divide("_wy", "_w"), F.lit(0.5 if link == "logit" else 0.0))
    start = S.logit(F.least(F.greatest(start, F.lit(1e-6)), F.lit(1 - 1e-6))) if link == "logit" else start
    state = kept(join_by(wanted, totals, by).select(*by, *per, "t", "n_knots", F.col("alpha").cast("double").alias("alpha"), "_w", start.cast("double").alias("_start")))
    shape = [*by, "n_knots"] if per else list(by)
    shapes = kept(state.select(*shape, "t").distinct()) if per else state.select(*by, "t")
    based = with_basis(join_by(ties, shapes, by), F.col("x"), F.col("t"), degree)
    rows = kept(based.select(*shape, *basis_columns(degree), "w", "wy"))
    b = [F.col(f"_sp_b{j}") for j in range(degree + 1)]
    keys = [*by, *per]
    types = "".join(f"`{c}` {state.schema[c].dataType.simpleString()}, " for c in keys)
    own = [*keys, "_sp_c"]
    told = [*keys, *(c for c in shape if c not in by)]

    def column(pdf: pd.DataFrame, name: str):
        return pdf[name].iloc[0]

    def head(pdf: pd.DataFrame, **more) -> pd.DataFrame:
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, **{k: [v] for k, v in more.items()}})

    if link == "identity":
        w = F.col("w")
        sums = rows.groupBy(*shape, "_sp_c").agg(*(F.sum(2 * w * b[i] * b[j]).alias(f"h{i}{j}") for i, j in _pairs(degree)), *(F.sum(-2 * F.col("wy") * b[i]).alias(f"g{i}") for i in range(degree + 1)))

        def solved(pdf: pd.DataFrame) -> pd.DataFrame:
            p = len(column(pdf, "t")) - degree - 1
            g, h = _unbanded(pdf, p, degree)
            h = h + kernels.spline_penalty(p, column(pdf, "alpha"))
            beta = np.zeros(p)
            beta[0] = column(pdf, "_start")
            loss = lambda v: float(0.5 * v @ h @ v + g @ v)
            beta = kernels.projected_newton(beta, loss, lambda v: (g + h @ v, h), float(column(pdf, "_w")))
            return head(pdf, t=column(pdf, "t"), theta=np.cumsum(beta), n_knots=column(pdf, "n_knots"), alpha=column(pdf, "alpha"))

        return kept(join_by(sums, state, shape).groupBy(*keys).applyInPandas(solved, types + "t array<double>, theta array<double>, n_knots int, alpha double"))

    w = F.col("w")
    slots = [F.floor(c * SLOTS).alias(f"_slot{i}") for i, c in enumerate((b[0], b[-1]))]  # along an interval one falls and one rises
    merged = rows.where("w > 0").groupBy(*shape, "_sp_c", *slots).agg(F.sum(w).alias("w"), F.sum("wy").alias("wy"), *(F.avg(c).alias(f"m{j}") for j, c in enumerate(b)))

    def warm(pdf: pd.DataFrame) -> pd.DataFrame:
        p = len(column(pdf, "t")) - degree - 1
        basis = np.zeros((len(pdf), p))
        for j in range(degree + 1):
            basis[np.arange(len(pdf)), pdf["_sp_c"].to_numpy(int) + j] = pdf[f"m{j}"]
        w = pdf["w"].to_numpy(float)
        design = basis[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
        return head(pdf, _warm=kernels.fit_spline(design, pdf["wy"].to_numpy(float) / w, w, column(pdf, "alpha"), link))

    first = join_by(merged.drop("_slot0", "_slot1"), state.select(*told, "t", "alpha"), shape)
    state = join_by(state, first.groupBy(*keys).applyInPandas(warm, types + "_warm array<double>"), keys, "left")
    zeros = F.array_repeat(F.lit(0.0), F.size("t") - degree - 2)
    flat = F.coalesce("_warm", F.concat(F.array("_start"), zeros))
    inf = F.lit(float("inf"))
    state = kept(state.select(*(c for c in state.columns if c != "_warm"), flat.alias("beta"), flat.alias("trial"), flat.alias("step"), F.lit(1.0).alias("size"), inf.alias("loss"), F.lit(False).alias("done")))
    schema = types + "t array<double>, n_knots int, alpha double, _w double, _start double, beta array<double>, trial array<double>, step array<double>, size double, loss double, done boolean"

    def advanced(pdf: pd.DataFrame) -> pd.DataFrame:
        beta, trial, step = (np.array(column(pdf, c), float) for c in ("beta", "trial", "step"))
        size, before, total, done = float(column(pdf, "size")), float(column(pdf, "loss")), float(column(pdf, "_w")), False
        g, h = _unbanded(pdf, len(beta), degree)
        penalty = kernels.spline_penalty(len(beta), column(pdf, "alpha"))
        loss = float(pdf["own"].sum() + 0.5 * trial @ penalty @ trial)
        if loss < before:
            beta, before, size = trial, loss, 1.0
            g, h = g + penalty @ beta, h + penalty
            step = kernels.newton_step(beta, g, h, total)
            done = step is None
            if not done:
                gain = -float(g @ (kernels.kept_monotone(beta + step) - beta))
                done = gain <= 1e-13 * max(1.0, abs(loss))  # less than the sums can tell: take the step and end
                beta = kernels.kept_monotone(beta + step) if done and gain >= 0 else beta
        else:
            size /= 2
            done = size < 1e-12
        step = np.zeros(len(beta)) if step is None else step
        return head(pdf, t=column(pdf, "t"), n_knots=column(pdf, "n_knots"), alpha=column(pdf, "alpha"), _w=total, _start=column(pdf, "_start"), beta=beta, trial=kernels.kept_monotone(beta + size * step), step=step, size=size, loss=before, done=done)

    finished = []
    for left in range(PASSES, 0, -1):
        open_ = join_by(rows, state.select(*told, _coefficients("trial").alias("theta")), shape)
        eta = reduce(lambda p, q: p + q, (b[j] * F.get("theta", F.col("_sp_c") + j) for j in range(degree + 1)))
        open_ = open_.select(*own, "w", "wy", *b, eta.alias("_eta"))
        open_ = open_.select("*", S.expit(F.col("_eta")).alias("_mu"))
        r, curve = F.col("w") * F.col("_mu") - F.col("wy"), F.col("w") * F.greatest(F.col("_mu") * (1 - F.col("_mu")), F.lit(1e-10))
        loss = F.col("w") * S.softplus(F.col("_eta")) - F.col("wy") * F.col("_eta")
        sums = open_.groupBy(*own).agg(*(F.sum(curve * b[i] * b[j]).alias(f"h{i}{j}") for i, j in _pairs(degree)), *(F.sum(r * b[i]).alias(f"g{i}") for i in range(degree + 1)), F.sum(loss).alias("own"))
        state = kept(join_by(sums, state, keys).groupBy(*keys).applyInPandas(advanced, schema))
        ended, live = state.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        if ended or not live or left == 1:
            finished.append(state if left == 1 else state.where("done"))
        if not live:
            break
        state = state.where("not done") if ended else state
    return kept(reduce(DataFrame.unionByName, finished).select(*keys, "t", _coefficients("beta").alias("theta"), "n_knots", "alpha"))

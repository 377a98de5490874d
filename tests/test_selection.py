"""Folds and settings: exact strata, choices per segment against a plain search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorecal.functions import kernels
from scorecal.operators import calibrators as C
from scorecal.operators import metrics, selection

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def rows(spark):
    n = 900
    g = np.where(np.arange(n) % 3 == 0, "a", "b")
    x = RNG.random(n).round(3)
    p = np.where(g == "a", x, 0.5 + 0.4 * np.sin(12 * x))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "score": x, "label": (RNG.random(n) < p) * 1.0, "weight": 1.0 + np.arange(n) % 4})
    return spark.createDataFrame(pdf).repartition(5), pdf


def test_folds_are_stratified(spark, rows):
    df, pdf = rows
    out = selection.stratified_folds(df, ["id"], folds=4, seed=1, by=["g"])
    got = out.groupBy("g", "label", "fold").count().toPandas()
    assert out.count() == len(pdf) and set(out.columns) == {*df.columns, "fold"}
    for _, own in got.groupby(["g", "label"]):
        assert len(own) == 4 and own["count"].max() - own["count"].min() <= 1
    again = {r.id: r.fold for r in selection.stratified_folds(df.repartition(3), ["id"], folds=4, seed=1, by=["g"]).collect()}
    assert again == {r.id: r.fold for r in out.collect()}


def test_folds_are_capped_by_the_rarer_class(spark):
    df = spark.range(200).select("id", (F.col("id") < 3).cast("double").alias("label"))
    found = {r.fold: r.k for r in selection.stratified_folds(df, ["id"]).where("label = 1").groupBy("fold").agg(F.count("*").alias("k")).collect()}
    assert found == {0: 1, 1: 1, 2: 1}
    with pytest.raises(ValueError):
        selection.stratified_folds(df, ["id"], folds=1)
    soft = df.withColumn("label", F.col("id") / 200)
    assert {r.k for r in selection.stratified_folds(soft, ["id"]).groupBy("fold").agg(F.count("*").alias("k")).collect()} == {40}


def plain_choice(own, grid, fit, folds, scoring="log_loss"):
    """The first best of the grid by a plain loop over the folds."""
    own = own.sort_values(["score", "label", "weight"])
    fold = selection.dealt_folds(own["label"].to_numpy(), folds, 0)
    losses = []
    for setting in grid:
        total = 0.0
        for k in range(fold.max() + 1):
            ties = own[fold != k].assign(wy=lambda d: d["weight"] * d["label"]).groupby("score")[["weight", "wy"]].sum()
            p = np.clip(np.interp(own["score"][fold == k], ties.index, fit(ties["wy"] / ties["weight"], ties["weight"], setting)), 2.2e-16, 1 - 2.2e-16)
            y, w = own["label"][fold == k].to_numpy(), own["weight"][fold == k].to_numpy()
            total += (w * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        losses.append(total / own["weight"].sum())
    return grid[int(np.argmin(losses))]


def test_settings_are_chosen_for_each_segment(rows):
    df, pdf = rows
    model = C.RelaxedIsotonic(epsilon="auto").fit(df, weight="weight", by=["g"])
    got = {r.g: r.epsilon for r in model.params["chosen"].collect()}
    fit = lambda y, w, e: np.clip(kernels.bounded_steps(y.to_numpy(), w.to_numpy(), np.full(len(y) - 1, -e)), 0, 1)
    assert got == {g: plain_choice(own, C.EPSILON_GRID, fit, 5) for g, own in pdf.groupby("g")}
    assert len(set(got.values())) == 2  # a wave needs falls, a rise none
    alone = {g: C.RelaxedIsotonic(epsilon=e).fit(df.where(F.col("g") == g), weight="weight").knots.orderBy("x").collect() for g, e in got.items()}
    for g, want in alone.items():
        own = model.knots.where(F.col("g") == g).orderBy("x").collect()
        assert np.allclose([(r.x, r.y) for r in own], [(r.x, r.y) for r in want])


def test_nearly_isotonic_and_spline_choose(rows):
    df, pdf = rows
    plain = df.drop("weight")
    found = C.NearlyIsotonic(lam="auto").fit(plain, by=["g"]).params["chosen"].collect()
    fit = lambda y, w, lam: np.clip(kernels.nearly_isotonic(y.to_numpy(), w.to_numpy(), lam), 0, 1)
    assert {r.g: r.lam for r in found} == {g: plain_choice(own.assign(weight=1.0), C.LAM_GRID, fit, 5) for g, own in pdf.groupby("g")}
    spline = C.MonotoneSpline(n_knots="auto", alpha="auto").fit(plain)
    assert spline.params["n_knots"] in (5, 10, 20) and spline.params["alpha"] in C.ALPHA_GRID


@pytest.mark.parametrize("kind", ["relaxed", "nearly", "spline", "identity"])
def test_large_segments_are_scored_on_all_rows(spark, rows, monkeypatch, kind):
    """Beyond ``max_rows`` fits are spread, and each setting's held-out loss is that of a plain loop over all rows.

    Log loss near 0 and 1 hangs on rounding, so raw means are scored by Brier.
    """
    df, pdf = rows
    weight = None if kind == "nearly" else "weight"
    model, grid = {
        "relaxed": (C.RelaxedIsotonic(epsilon="auto", scoring="brier"), C.EPSILON_GRID),
        "nearly": (C.NearlyIsotonic(lam="auto", cv=3, scoring="brier"), C.LAM_GRID),
        "spline": (C.MonotoneSpline(n_knots="auto", alpha="auto", cv=3), [(k, float(a)) for k in (5, 10, 20) for a in C.ALPHA_GRID]),
        "identity": (C.MonotoneSpline(alpha="auto", link="identity"), [(10, float(a)) for a in C.ALPHA_GRID]),
    }[kind]
    seen, plain, choose = [], {}, selection.select_by_cv

    def told(out, **more):
        found = keep(out, **more)
        seen.extend(found.collect() if more else [])
        return found

    def small(df, fitted, *args, **more):
        plain["fit"] = fitted
        return choose(df, fitted, *args, **more, max_rows=350)

    keep = selection.kept
    monkeypatch.setattr(selection, "kept", told)
    monkeypatch.setattr(selection, "select_by_cv", small)
    chosen = {r.g: r for r in model.fit(df, weight=weight, by=["g"]).params["chosen"].collect()}
    losses = {r.setting: r.loss for r in seen if r.g == "b"}
    assert {r.g for r in seen} == {"b"} and set(losses) == set(range(len(grid))), "a has 300 rows, b 600"

    own = df.where("g = 'b'").select("g", F.col("score").alias("x"), F.col("label").alias("y"), (F.lit(1.0) if weight is None else F.col("weight")).alias("w"))
    dealt = selection.stratified_folds(own, ["x", "y", "w"], "y", model.cv, 0, "fold", ["g"]).toPandas()
    assert len(dealt) == 600
    for i, setting in enumerate(grid):
        total = 0.0
        for k in range(model.cv):
            ties = dealt[dealt["fold"] != k].assign(wy=lambda d: d["w"] * d["y"]).groupby("x").agg(w=("w", "sum"), wy=("wy", "sum"), n=("w", "size"))
            held = dealt[dealt["fold"] == k]
            p = plain["fit"](ties.index.to_numpy(), (ties["wy"] / ties["w"]).to_numpy(), ties["w"].to_numpy(), ties["n"].to_numpy(), setting)(held["x"].to_numpy())
            q, y, w = np.clip(p, 2.2e-16, 1 - 2.2e-16), held["y"], held["w"]
            total += (w * ((y - p) ** 2 if model.scoring == "brier" else -(y * np.log(q) + (1 - y) * np.log(1 - q)))).sum()
        assert np.isclose(losses[i], total / dealt["w"].sum(), rtol=1e-5)
    best = grid[min(losses, key=lambda i: (losses[i], i))]
    assert (best if isinstance(best, tuple) else (best,)) == tuple(v for c, v in chosen["b"].asDict().items() if c != "g")


def test_samples_are_bounded_and_repeatable(spark, rows):
    df, _ = rows
    cells = df.groupBy("g", F.col("score").alias("x"), F.col("label").alias("y"), F.lit(1.0).alias("w")).agg((F.count("*") * 50).alias("n"))
    one = selection._thinned(cells, ["g"], 2000, 0)
    sizes = {r.g: r.n for r in one.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    assert all(1700 < n < 2300 for n in sizes.values())
    other = selection._thinned(cells.repartition(7), ["g"], 2000, 0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert selection._thinned(cells, ["g"], 10**9, 0).agg(F.sum("n")).first()[0] == 900 * 50


def test_out_of_fold_with_strata_and_auto(rows):
    df, _ = rows
    out = selection.cross_val_calibrate(df, C.RelaxedIsotonic(epsilon="auto"), ["id"], folds=3, by=["g"], stratified=True)
    assert out.count() == 900 and out.where("calibrated is null or calibrated not between 0 and 1").count() == 0
    assert metrics.basic_metrics(out, "calibrated").first().brier < 0.25


def test_tables_outside_each_fold_move_rows_once(spark, rows):
    df, pdf = rows
    dealt = selection.with_folds(df, ["id"], 4, name="_fold")
    train = selection._without_each_fold(dealt, 4, "score", "label", ["g"], None)
    assert train._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    own = dealt.toPandas()
    want = pd.concat([own[own["_fold"] != k].assign(_fold=k, x=lambda d: d["score"]) for k in range(4)]).groupby(["g", "_fold", "x"])["label"].agg(["count", "sum"])
    got = train.toPandas().set_index(["g", "_fold", "x"]).sort_index()
    assert len(got) == len(want) and np.array_equal(got["n"], want["count"]) and np.array_equal(got["wy"], want["sum"])
    assert np.array_equal(got["w"], got["n"]) and np.allclose(got["y"], got["wy"] / got["n"])


def test_only_cells_in_reach_of_a_draw_are_counted(spark):
    """Their draws are those from all cells, and a large segment's other rows are left before they are counted."""
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.floor(F.col("id") / 4) / 15_000).alias("x"), (F.pmod(F.hash("id"), F.lit(3)) == 0).cast("double").alias("y"), F.lit(1.0).alias("w"))
    ties = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    totals = ties.groupBy("g").agg(F.sum("n").alias("_all"), F.max("n").alias("_most"))
    cells = lambda rows: rows.groupBy("g", "x", "y", "w").agg(F.count("*").alias("n"))
    near = selection._in_reach(df, totals, ["g"], 1000, 0)
    assert near.count() < 6000
    want = sorted(map(tuple, selection._thinned(cells(df), ["g"], 1000, 0).collect()))
    assert want == sorted(map(tuple, selection._thinned(cells(near), ["g"], 1000, 0, totals).collect()))
    assert 1700 < sum(r[-1] for r in want) < 2300 and {r[-1] for r in want} == {1, 2}
    assert selection._in_reach(df, totals, ["g"], 10**9, 0).count() == 60_000


def test_quantiles_sort_only_stretches_that_hold_one(spark, monkeypatch):
    from scorecal.operators import ranges

    monkeypatch.setattr(ranges.Stretches.__init__, "__kwdefaults__", {"rows": 50})
    pdf = pd.DataFrame({"g": np.arange(4000) % 2, "x": RNG.random(4000).round(3), "n": 1 + np.arange(4000) % 3})
    at = [0.0, 0.123, 0.5, 1.0]
    found = metrics.quantiles(spark.createDataFrame(pdf), "x", at, ["g"], count="n")
    for r in found.collect():
        own = pdf[pdf["g"] == r.g]
        assert np.allclose(r["_e"], np.quantile(np.repeat(own["x"], own["n"]), at), rtol=0, atol=1e-12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan[plan.index("Window [") :], "the window sorts what the broadcast leaves"


def test_no_task_gets_a_segment_by_the_joins_of_a_relaxed_fit(spark, monkeypatch):
    """Tables of a row for each segment are sent round, where the tie table is too large for it."""
    from scorecal.operators import isotonic

    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("score"), (F.rand(2) < 0.5).cast("double").alias("label"))
    plans, write = {}, isotonic.kept

    def told(out):
        for c in ("_least", "_moved"):
            if out.columns[-1] == c and c not in plans:
                plans[c] = out._jdf.queryExecution().executedPlan().toString()
        return write(out)

    monkeypatch.setattr(isotonic, "kept", told)
    monkeypatch.setattr(C, "kept", told)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        model = C.RelaxedIsotonic(epsilon="auto", min_slope="auto").fit(df, by=["g"])
        plans["chosen"] = model.knots.join(model.params["chosen"], "g")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(plans) == {"_least", "_moved", "chosen"}
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans.values())

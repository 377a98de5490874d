"""Resampling by a splitting tree: states of stretches give what whole tables give, and nothing is rounded."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorecal.functions import kernels
from scorecal.operators import corp, resample
from scorecal.operators.ranges import Stretches

RNG = np.random.default_rng(11)


def rows(n, top):
    x = RNG.random(n) * top
    x[: n // 4] = np.round(x[: n // 4], 1)
    return pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "a", "b"), "score": x, "label": (RNG.random(n) < 0.3 + 0.4 * x / top) * 1.0})


def test_states_of_stretches_add_up():
    pdf = rows(600, 1.0).groupby(["score", "label"]).size().reset_index(name="n")
    x, y, n = (pdf[c].to_numpy(float) for c in ("score", "label", "n"))
    parts = np.searchsorted([0.1, 0.35, 0.36, 0.8], x, side="right")
    named = resample.METRICS | {"user": resample.Whole(lambda a, b, k: float(np.dot(k, a * b)))}
    for name, f in named.items():
        states, before = [], 0
        for p in range(5):
            own = parts == p
            states.append(f.state(x[own], y[own], n[own], before, int(n.sum())))
            before += int(n[own].sum())
        assert f.value(states, int(n.sum())) == pytest.approx(f(x, y, n), abs=1e-12), name


def test_scores_are_not_rounded(spark):
    df = spark.createDataFrame(rows(4000, 1e-5))
    own = {r.metric: r.estimate for r in resample.bootstrap_ci(df, ["mcb", "brier"], n_resamples=10, cells=300).collect()}
    assert own["mcb"] == pytest.approx(corp.score_decomposition(df).first().mcb, abs=1e-12)
    bands = resample.resampling_bands(df, n_resamples=20, scores=200)
    assert bands.select("x").distinct().count() == df.select("score").distinct().count() == bands.count()


def test_draws_are_those_of_a_plain_tree(spark):
    pdf = rows(900, 1.0)
    df = spark.createDataFrame(pdf)
    got = {(r.g, r.resample, r.metric): r.value for r in resample.bootstrap_draws(df.repartition(7), ["brier", "mcb", "debiased_ece"], 12, seed=5, by=["g"], cells=100).collect()}
    cuts = Stretches.of_distinct(df.groupBy("g", "score", "label").count().select("score"), 100).cuts
    assert len(cuts) > 3 and len(got) == 2 * 13 * 3
    for g, own in pdf.groupby("g"):
        cells = own.groupby(["score", "label"]).size().reset_index(name="n")
        x, y, n = cells["score"].to_numpy(), cells["label"].to_numpy(), cells["n"].to_numpy()
        part = np.searchsorted(cuts, x, side="right")
        held = np.unique(part)
        size = np.bincount(part, n)[held].astype(int)
        for r in range(12):
            dealt = resample._generator(5, r, (g,), 0).multinomial(size.sum(), size / size.sum())
            k = np.zeros(len(n))
            for p, c in zip(held, dealt, strict=True):
                k[part == p] = resample._generator(5, r, (g,), int(p) + 1).multinomial(c, n[part == p] / n[part == p].sum())
            for m in ("brier", "mcb", "debiased_ece"):
                assert got[g, r, m] == pytest.approx(resample.METRICS[m](x[k > 0], y[k > 0], k[k > 0]), abs=1e-12)
            assert got[g, -1, "brier"] == pytest.approx(np.mean((own["score"] - own["label"]) ** 2), abs=1e-12)


def test_bands_are_those_of_plain_draws(spark):
    pdf = rows(500, 1.0)
    df = spark.createDataFrame(pdf)
    for kind in ("consistency", "confidence"):
        got = {(r.g, r.x): (r.lower, r.upper) for r in resample.resampling_bands(df, kind, 0.8, 30, seed=2, by=["g"], scores=60).collect()}
        cuts = Stretches.of_distinct(df.groupBy("g", "score").count().select("score"), 60).cuts
        for g, own in pdf.groupby("g"):
            ties = own.groupby("score")["label"].agg(["size", "sum"])
            x, n = ties.index.to_numpy(), ties["size"].to_numpy()
            p = x if kind == "consistency" else kernels.pava(ties["sum"].to_numpy() / n, n)
            part = np.searchsorted(cuts, x, side="right")
            every = []
            for r in range(30):
                k = np.zeros(len(n))
                for q in np.unique(part):
                    k[part == q] = resample._generator(2, r, (g,), int(q) + 1).binomial(n[part == q], np.clip(p[part == q], 0, 1))
                every.append(kernels.pava(k / n, n))
            lo, hi = np.quantile(every, [0.1, 0.9], axis=0)
            assert np.allclose([got[g, v] for v in x], np.stack([lo, hi], axis=1), atol=1e-9)


def test_null_segments_and_methods(spark):
    df = spark.createDataFrame(rows(300, 1.0)).withColumn("g", F.when(F.col("g") == "a", F.col("g")))
    for method in ("percentile", "basic", "bc", "bca"):
        got = resample.bootstrap_ci(df, ["brier", "mcb"] if method != "bca" else ["brier"], n_resamples=40, method=method, by=["g"]).collect()
        assert {r.g for r in got} == {"a", None} and all(r.lower <= r.upper for r in got)


def test_fast_pooling_is_the_plain_one():
    for n in (65, 200, 1000):
        for y in (RNG.random(n), RNG.integers(0, 2, n) * 1.0, -np.arange(n) * 1.0, np.append(np.arange(n - 1.0), -1e6), np.sin(np.arange(n) / 9)):
            w = RNG.integers(1, 5, n) * 1.0
            assert np.allclose(kernels.pava(y, w), kernels._pooled(y, w), atol=1e-9)


def test_bands_draw_each_stretch_once(spark, tmp_path, monkeypatch):
    own, path = resample._generator, str(tmp_path / "draws")

    def counted(*at):
        with open(path, "a") as f:
            f.write("x")
        return own(*at)

    df = spark.range(600).select((F.col("id") / 600).alias("score"), (F.col("id") % 2).cast("double").alias("label"))
    stretches = Stretches.of_distinct(df.select("score"), 100)
    monkeypatch.setattr(resample, "_generator", counted)
    out = resample.resampling_bands(df, n_resamples=7, scores=100).toPandas()
    assert len(out) == 600 and (out["lower"] <= out["upper"]).all() and len(stretches) > 2
    with open(path) as f:
        assert len(f.read()) == 7 * len(stretches)

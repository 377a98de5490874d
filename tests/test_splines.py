"""Splines fitted on partial sums against the dense kernel, per segment."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorecal.functions import kernels
from scorecal.operators import calibrators as C

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def rows(spark):
    n = 3000
    g = np.array(["a", "b", None], dtype=object)[np.arange(n) % 3]
    x = np.where(np.arange(n) % 3 == 0, RNG.random(n), RNG.random(n) ** 4 * 1e-3)
    p = np.where(np.arange(n) % 3 == 0, x**2, x / x.max())
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "score": x.round(6), "label": (RNG.random(n) < p) * 1.0, "weight": 0.5 + np.arange(n) % 4})
    return spark.createDataFrame(pdf).repartition(6), pdf


def plain(own, n_knots, alpha, degree, kind, link, at):
    t = own.assign(wy=own["weight"] * own["label"]).groupby("score").agg(n=("id", "size"), w=("weight", "sum"), wy=("wy", "sum"))
    x, y = t.index.to_numpy(), (t["wy"] / t["w"]).to_numpy()
    knots = kernels.knots_for(x, t["n"].to_numpy(), n_knots, kind)
    beta = kernels.fit_spline(kernels.spline_design(x, knots, degree), y, t["w"].to_numpy(), alpha, link)
    return np.clip(kernels.predict_spline(beta, kernels.spline_design(at, knots, degree), link), 0, 1)


@pytest.mark.parametrize(("n_knots", "alpha", "degree", "kind", "link"), [(10, 0.1, 3, "quantile", "logit"), (6, 1.0, 2, "uniform", "logit"), (8, 0.5, 3, "quantile", "identity"), (4, 0.01, 1, "uniform", "identity")])
def test_fit_agrees_with_the_dense_kernel(rows, n_knots, alpha, degree, kind, link):
    df, pdf = rows
    model = C.MonotoneSpline(n_knots=n_knots, alpha=alpha, degree=degree, knots=kind, link=link).fit(df, weight="weight", by=["g"])
    got = model.transform(df.withColumn("theta", F.lit("kept"))).toPandas()
    assert len(got) == len(pdf) and set(got["theta"]) == {"kept"}
    for g in ("a", "b", None):
        own = pdf[pdf["g"].isna()] if g is None else pdf[pdf["g"] == g]
        out = got[got["g"].isna()] if g is None else got[got["g"] == g]
        want = plain(own, n_knots, alpha, degree, kind, link, out["score"].to_numpy())
        assert np.abs(out["calibrated"].to_numpy() - want).max() < 1e-7
        by_score = out.sort_values("score")["calibrated"].to_numpy()
        assert np.diff(by_score).min() > -1e-12


def test_settings_differ_by_segment_and_odd_scores(spark, rows):
    df, pdf = rows
    model = C.MonotoneSpline(n_knots="auto", alpha="auto").fit(df, by=["g"])
    chosen = {r.g: (r.n_knots, r.alpha) for r in model.params["chosen"].collect()}
    assert len(chosen) == 3
    odd = spark.createDataFrame([("a", -5.0), ("a", 0.0), ("a", 7.0), ("a", None), ("a", float("nan")), ("z", 0.5)], "g string, score double")
    got = [(r.g, r.score, r.calibrated) for r in model.transform(odd).collect()]
    values = {s: v for g, s, v in got if g == "a" and s is not None and s == s}
    own = pdf[pdf["g"] == "a"].assign(weight=1.0)
    want = plain(own, *chosen["a"], 3, "quantile", "logit", np.array([-5.0, 0.0, 7.0]))
    assert np.allclose([values[-5.0], values[0.0], values[7.0]], want, atol=1e-7)
    assert sum(v is None for *_, v in got) == 3


def test_degenerate_segments(spark):
    one = spark.createDataFrame([(0.3, 1.0), (0.3, 0.0)], "score double, label double")
    for link in ("logit", "identity"):
        assert abs(C.MonotoneSpline(link=link).fit(one).transform(one).first().calibrated - 0.5) < 1e-6
        none = C.MonotoneSpline(link=link).fit(one.where("false"))
        assert none.transform(one).where("calibrated is null").count() == 2
    with pytest.raises(ValueError):
        C.MonotoneSpline(n_knots=2).fit(one)
    light = one.withColumn("w", F.lit(0.0))
    assert C.MonotoneSpline().fit(light, weight="w").transform(light).where("calibrated is null").count() == 0

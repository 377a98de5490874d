"""Pairs and runs within a tolerance against plain loops."""

import numpy as np
import pandas as pd
import pytest

from scorecal.functions import kernels
from scorecal.operators import close, diagnostics, metrics
from scorecal.operators.ranges import Stretches

RNG = np.random.default_rng(5)


def all_pairs(o, c, tolerance):
    i, j = np.triu_indices(len(o), 1)
    a, b = np.abs(o[i] - o[j]) <= tolerance, np.abs(c[i] - c[j]) <= tolerance
    return a.sum(), b.sum(), (a & b).sum()


def plain_score(o, c, tolerance):
    tied, tied_c, both = all_pairs(o, c, tolerance)
    share = 1.0 if tied == 0 else both / tied
    return max(0.0, min(1.0, share - (tied_c - both) / (len(o) * (len(o) - 1) / 2 or 1)))


def table(spark, n=500):
    o = RNG.random(n).round(2)
    c = np.where(RNG.random(n) < 0.5, o, RNG.random(n).round(2))
    o[::7], c[::5] = 0.5, 0.25  # a value that many share
    pdf = pd.DataFrame({"g": np.where(np.arange(n) % 4 == 0, "a", None), "o": o, "c": c})
    return spark.createDataFrame(pdf).repartition(4), pdf


@pytest.mark.parametrize("tolerance", [0.0, 1e-10, 0.01, 0.07, 2.0])
def test_tie_preservation_by_all_pairs(spark, tolerance, monkeypatch):
    monkeypatch.setattr("scorecal.operators.close.Stretches", lambda *v: Stretches(*v, rows=60))
    df, pdf = table(spark)
    got = {r.g: r.tie_preservation for r in metrics.tie_preservation(df, "o", "c", ["g"], tolerance).collect()}
    for g in ("a", None):
        own = pdf[pdf["g"].isna()] if g is None else pdf[pdf["g"] == g]
        assert got[g] == pytest.approx(plain_score(own["o"].to_numpy(), own["c"].to_numpy(), tolerance), abs=1e-12)
    whole = metrics.tie_preservation(df, "o", "c", tolerance=tolerance).first().tie_preservation
    assert whole == pytest.approx(plain_score(pdf["o"].to_numpy(), pdf["c"].to_numpy(), tolerance), abs=1e-12)


def test_pairs_of_empty_and_odd_tables(spark):
    df = spark.createDataFrame([(0.1, None, 3), (float("nan"), 0.2, 2), (0.1, 0.2, 4)], "o double, c double, k long")
    assert close.close_pairs(df, "o", "c", 0.5).first().pairs == 6
    assert close.close_pairs(df.where("false"), "o", "c", 0.5).first().pairs is None
    one = metrics.tie_preservation(df.where("k = 4"), "o", "c").first().tie_preservation
    assert one == 1.0
    with pytest.raises(ValueError):
        close.close_pairs(df, "o", "c", -1.0)


def plain_runs(z, rtol, atol, least):
    out, first = [], 0
    for i in range(1, len(z) + 1):
        if i == len(z) or not abs(z[i] - z[first]) <= atol + rtol * abs(z[first]):
            out += [(z[first], i - first)] if i - first >= least else []
            first = i
    return out


@pytest.mark.parametrize(("rtol", "atol"), [(1e-5, 1e-8), (0.0, 0.004), (0.05, 0.0), (0.0, 0.0), (0.0, 5.0)])
def test_plateaus_hold_close_values(spark, rtol, atol, monkeypatch):
    monkeypatch.setattr("scorecal.operators.diagnostics.Stretches", lambda *v: Stretches(*v, rows=50))
    n = 700
    x = np.arange(n) / n
    z = np.maximum.accumulate(np.floor(x * 20) / 20 + RNG.random(n) * np.where(x < 0.5, 1e-9, 0.01))
    pdf = pd.DataFrame({"g": "a", "score": x, "calibrated": z})
    both = pd.concat([pdf, pdf.assign(g="b", calibrated=z[::-1].copy())])
    df = spark.createDataFrame(both).repartition(4)
    got = diagnostics.plateaus(df, by=["g"], rtol=rtol, atol=atol).orderBy("g", "plateau_id").collect()
    for g, own in both.groupby("g"):
        assert [(r.value, r.width) for r in got if r.g == g] == plain_runs(own["calibrated"].to_numpy(), rtol, atol, 2)


def test_kernel_counts_only_own_cells():
    a, b, k = np.array([0.0, 0.0, 0.1, 0.2]), np.array([0.0, 1.0, 0.0, 0.0]), np.array([2.0, 1.0, 3.0, 1.0])
    assert kernels.pairs_within(a, b, k, np.array([True, True, True, True]), 0.15) == 1 + 6 + 3 + 3
    assert kernels.pairs_within(a, b, k, np.array([True, False, False, False]), 0.15) == 1 + 6

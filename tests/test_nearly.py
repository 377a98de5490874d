"""Nearly isotonic fits in pieces against the whole path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorecal.functions import kernels
from scorecal.operators import calibrators as C
from scorecal.operators.nearly import nearly_isotonic_fit, settled_place
from scorecal.operators.ties import tie_table

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def ties(spark):
    n = 2400
    g = np.where(np.arange(n) % 3 == 0, "a", "b")
    x = np.where(g == "a", RNG.random(n), RNG.random(n) * 1e-5)
    p = np.where(g == "a", x, 0.5 + 0.4 * np.sin(x * 1e6))
    pdf = pd.DataFrame({"g": g, "score": x, "label": (RNG.random(n) < p) * 1.0})
    df = spark.createDataFrame(pdf).repartition(5)
    return df, tie_table(df, by=["g"])


@pytest.mark.parametrize("lam", [0.0, 0.01, 1.0, 8.0, 1e4])
def test_pieces_agree_with_the_path(ties, lam):
    _, t = ties
    got = nearly_isotonic_fit(t, F.lit(lam), ["g"], rows=100).toPandas()
    pdf = t.toPandas()
    assert len(got) == len(pdf)
    for g, own in pdf.sort_values("x").groupby("g"):
        want = kernels.nearly_isotonic(own["y"].to_numpy(), own["n"].to_numpy(float), lam)
        assert np.abs(got[got["g"] == g].sort_values("x")["z"].to_numpy() - want).max() < 1e-8


def test_small_scores_keep_their_outputs(ties):
    df, _ = ties
    own = df.where("g = 'b'")
    out = C.NearlyIsotonic(lam=2.0).fit(own).transform(own)
    assert out.select(F.count_distinct(F.round("calibrated", 9))).first()[0] > 20


def test_duals_stay_within_the_price():
    y, w = RNG.random(300), RNG.integers(1, 4, 300).astype(float)
    z, dual = kernels.nearly_isotonic_between(y, w, 0.7, 0.0, 0.0)
    assert dual.min() > -1e-9 and dual.max() < 0.7 + 1e-9 and abs(dual[-1]) < 1e-9
    low = kernels.nearly_isotonic_between(y[100:200], w[100:200], 0.7, dual[99], dual[199])[0]
    assert np.abs(low - z[100:200]).max() < 1e-9  # a piece with its neighbours' duals


def test_a_cut_is_found_among_few_scores(monkeypatch):
    n, lam = 4000, 1.5
    y, w = (RNG.random(n) < np.linspace(0, 1, n)) * 1.0, np.ones(n)
    z, sizes, solve = kernels.nearly_isotonic(y, w, lam), [], kernels.nearly_isotonic_between
    dual = 2 * np.cumsum(w * (y - z))
    monkeypatch.setattr(kernels, "nearly_isotonic_between", lambda v, *more: sizes.append(len(v)) or solve(v, *more))
    at, found = settled_place(y, w, lam, True, True, 100)
    assert abs(dual[at] - found) < 1e-8
    assert max(sizes) < n  # not the whole stretch


def test_a_cut_is_looked_for_in_the_whole_stretch():
    y, w = np.array([0.0, 0.0, 1.0, 0.0, 1.0, 1.0]), np.ones(6)
    at, found = settled_place(y, w, 0.1, True, True, 1)
    z = kernels.nearly_isotonic(y, w, 0.1)
    assert at < 5 and abs(2 * np.cumsum(w * (y - z))[at] - found) < 1e-8
    assert settled_place(np.linspace(1, 0, 40), np.ones(40), 1e6, False, False, 4) is None

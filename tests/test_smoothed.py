"""Smoothed isotonic fits by stretches, against the same on a whole segment."""

import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from scorecal.functions import kernels as k
from scorecal.operators.smoothed import smoothed_fit


def table(seed: int, m: int, sort: bool = False) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = np.unique(rng.beta(0.7, 2.0, m))
    n = rng.integers(1, 4, len(x))
    wy = rng.binomial(n, x).astype(float)
    y = x**2 if sort else wy / n
    return pd.DataFrame({"x": x, "y": y, "n": n, "w": n.astype(float), "wy": y * n})


@pytest.mark.parametrize("adaptive,window,order,most", [(False, None, 3, None), (False, 31, 2, None), (True, None, 3, None), (True, None, 2, 90), (True, None, 5, 3)])
def test_stretches_agree_with_one_segment(spark, adaptive, window, order, most):
    parts = {"a": table(1, 900), "b": table(2, 700, sort=True), None: table(3, 61), "few": table(4, 3), "flat": table(5, 40).assign(y=0.0, wy=0.0)}
    ties = spark.createDataFrame(pd.concat([p.assign(g=g) for g, p in parts.items()]).astype({"g": object}).where(lambda d: d.notna(), None), "x double, y double, n long, w double, wy double, g string")
    got = smoothed_fit(ties, window, order, adaptive, 5, most, ["g"], rows=100).toPandas()
    for g, p in parts.items():
        mine = got[got["g"].isna() if g is None else got["g"] == g].sort_values("x")
        want = k.smooth_isotonic(p["x"].to_numpy(), k.pava(p["y"].to_numpy(), p["w"].to_numpy()), window, order, adaptive, 5, most)
        assert (mine["x"].to_numpy() == p["x"].to_numpy()).all()
        assert np.abs(mine["z"].to_numpy() - want).max() < 1e-9, g


def test_adaptive_windows_of_many_scores_take_seconds():
    m, rng = 100_000, np.random.default_rng(0)
    u = np.sort(rng.random(m))
    at = np.sort(rng.choice(m - 1, 20_000, replace=False)) + 1
    steps = k.Steps(at, np.linspace(0, 1, len(at) + 1)[1:], 0.0)
    began = time.process_time()
    size, start = k.adaptive_windows(np.arange(m), k.local_widths(u, 0, m, m, 5, m // 5), m)
    z = k.smoothed_steps(steps, np.arange(m), size, start, 3)
    assert time.process_time() - began < 30
    rows = rng.choice(np.flatnonzero(size > 3), 50)
    for r in rows:
        t = (np.arange(size[r]) - size[r] // 2) / (size[r] // 2)
        fit = np.polynomial.polynomial.polyfit(t, steps.value(start[r] + np.arange(size[r])), min(3, size[r] - 1))
        assert z[r] == pytest.approx(np.polynomial.polynomial.polyval(t[r - start[r]], fit), abs=1e-9)


def test_windows_of_many_places_are_worked_on_in_parts():
    m = 300_000
    at = np.arange(100, m, 1000)
    steps, place = k.Steps(at, np.linspace(0.1, 1, len(at)), 0.0), np.arange(m)
    size = np.full(m, 30_001)
    start = np.clip(place - 15_000, 0, m - 30_001)
    tracemalloc.start()
    got = k.smoothed_steps(steps, place, size, start, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert np.array_equal(got[:100], k.smoothed_steps(steps, place[:100], size[:100], start[:100], 3))

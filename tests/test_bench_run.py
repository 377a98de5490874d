"""Cells against plain numpy, and a grid that is cut short and resumed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorecal.functions import kernels
from scorecal.operators import calibrators as C
from scorecal.plans import bench_run as B

RNG = np.random.default_rng(2)
FEW = ["brier", "log_loss", "auc", "spearman_to_raw", "tie_preservation", "true_error", "n_distinct", "mcb"]


@pytest.fixture(scope="module")
def rows(spark):
    n = 400
    x = RNG.random(n).round(2)
    pdf = pd.DataFrame({"id": np.arange(n), "dataset": np.where(np.arange(n) % 2 == 0, "d", None), "model": "identity", "score": x, "p_true": x**2, "label": (RNG.random(n) < x**2) * 1.0})
    return B.split_cells(spark.createDataFrame(pdf).repartition(3), ["id"], [0, 1])


def plain(own, out):
    """Measures of one cell's held rows by definition."""
    o, y, p = own["score"].to_numpy(), own["label"].to_numpy(), np.asarray(out)
    q = np.clip(p, 2.220446049250313e-16, 1 - 2.220446049250313e-16)
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    i, j = np.triu_indices(len(o), 1)
    tied, tied_p = np.abs(o[i] - o[j]) <= 1e-10, np.abs(p[i] - p[j]) <= 1e-10
    share = (tied & tied_p).sum() / tied.sum() if tied.any() else 1.0
    score = share - (tied_p & ~tied).sum() / len(i)
    at, which = np.unique(p, return_inverse=True)
    w = np.bincount(which)
    fit = kernels.pava(np.bincount(which, y) / w, w)[which]
    return {
        "brier": ((p - y) ** 2).mean(), "log_loss": -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean(),
        "auc": ((pos > neg) + (pos == neg) / 2).mean(), "spearman_to_raw": np.corrcoef(pd.Series(o).rank(), pd.Series(p).rank())[0, 1],
        "tie_preservation": min(1.0, max(0.0, score)), "true_error": np.abs(p - own["p_true"]).mean(), "n_distinct": len(np.unique(p.round(6))), "mcb": ((p - y) ** 2).mean() - ((fit - y) ** 2).mean(),
    }


def test_cells_by_definition(rows):
    pdf = rows.toPandas()
    for _, own in pdf.groupby(["dataset", "seed", "label"], dropna=False):
        assert abs(own["test"].sum() - (~own["test"]).sum()) <= 1
    got = B.run_cells(rows, {"raw": None, "isotonic": C.Isotonic()}, measures=FEW, truth="p_true").collect()
    assert len(got) == 8
    for r in got:
        own = pdf[(pdf["dataset"].isna() if r.dataset is None else pdf["dataset"] == r.dataset) & (pdf["seed"] == r.seed)]
        fit, held = own[~own["test"]], own[own["test"]]
        assert (r.n_fit, r.n_test) == (len(fit), len(held)) and r.seconds > 0
        out = held["score"]
        if r.method == "isotonic":
            t = fit.groupby("score")["label"].agg(["size", "mean"])
            out = np.interp(out, t.index, kernels.pava(t["mean"].to_numpy(), t["size"].to_numpy()))
        for name, value in plain(held, out).items():
            assert r[name] == pytest.approx(value, abs=1e-9), (name, r.method)


def test_a_resumed_run_equals_one_run(rows, tmp_path):
    methods = {"raw": None, "centred": C.CentredIsotonic()}
    how = {"measures": ["brier", "n_distinct", "true_error"], "truth": "p_true", "batches": 3}
    keys = [*B.CELL, "method"]
    whole = B.run_grid(rows, methods, f"file:{tmp_path}/one", **how)
    part = B.run_grid(rows, methods, f"file:{tmp_path}/two", stop_after=1, **how)
    first = {tuple(r[k] for k in keys): r.seconds for r in part.collect()}
    assert 0 < len(first) < whole.count()
    resumed = B.run_grid(rows, methods, f"file:{tmp_path}/two", **how)
    again = B.run_grid(rows, methods, f"file:{tmp_path}/two", **how)
    values = lambda df: {tuple(r[k] for k in keys): (r.n_fit, r.n_test, round(r.brier, 12), r.n_distinct) for r in df.collect()}
    assert values(resumed) == values(whole) == values(again) and len(values(whole)) == 8
    later = {tuple(r[k] for k in keys): r.seconds for r in again.collect()}
    assert all(later[k] == v for k, v in first.items())  # not run again
    noted = rows.sparkSession.read.json(f"file:{tmp_path}/two/manifest")
    assert noted.count() == 4 and {"settings", "environment", "finished"} <= set(noted.columns)


def test_measures_are_checked(rows):
    with pytest.raises(ValueError):
        B.evaluate(rows.withColumn("calibrated", F.col("score")), measures=["none"])
    with pytest.raises(ValueError):
        B.run_cells(rows, {})

"""Two-level sums, as-of joins and hull rounds against plain versions, with stretches of few rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorecal.functions import kernels
from scorecal.operators import curves, isotonic, metrics, ties
from scorecal.operators.keep import kept
from scorecal.operators.ranges import Stretches, in_ranges, running, with_neighbours, with_places

RNG = np.random.default_rng(7)
TABLE = pd.DataFrame({"g": np.repeat(["a", "b", None], 400), "x": np.concatenate([RNG.permutation(400) / 4e5, RNG.permutation(400) / 400.0, -np.arange(400.0)]), "n": RNG.integers(1, 5, 1200)})
TABLE["g"] = TABLE["g"].astype(object).where(TABLE["g"].notna(), None)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(TABLE.astype({"n": int}), "g string, x double, n long")


@pytest.mark.parametrize("rows", [30, 10**6])
def test_running(table, rows):
    cut = Stretches(table.select("x"), rows=rows)
    assert (len(cut) > 20) == (rows == 30)
    got = running(table, {"hi": F.col("n")}, ["g"], stretches=cut, tops={"top": F.col("n")}).toPandas().sort_values(["g", "x"], na_position="first")
    by = got.groupby("g", dropna=False)["n"]
    assert (got["hi"] == by.cumsum()).all() and (got["top"] == by.cummax()).all()


def test_neighbours(table):
    placed = Stretches(table.select("x"), rows=30).of(table, "x")
    got = with_neighbours(placed, F.col("n"), ["g"]).toPandas().sort_values(["g", "x"], na_position="first")
    by = got.groupby("g", dropna=False)["n"]
    assert got["before"].equals(by.shift(1)) and got["after"].equals(by.shift(-1))


def test_stretches_keep_ties_and_odd_values(spark):
    df = spark.createDataFrame([(0.5,)] * 300 + [(float(i),) for i in range(100)] + [(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    cut = Stretches(df.select("x"), rows=20)
    rows = cut.of(df, "x").groupBy("x").agg(F.count_distinct("_part").alias("k"), F.max("_part").alias("p")).collect()
    assert all(r.k <= 1 for r in rows) and max(cut.weights) > 5
    assert {r.x: r.p for r in rows}[float("inf")] == len(cut) - 1
    assert len(Stretches(df.limit(0).select("x"))) == 1


def test_places(spark):
    df = spark.createDataFrame([(int(v),) for v in RNG.integers(0, 50, 500)], "v int")
    got = with_places(kept(in_ranges(df, F.desc("v"), parts=5)), "r").orderBy("r").collect()
    assert [r.r for r in got] == list(range(500)) and [r.v for r in got] == sorted((r.v for r in got), reverse=True)


KNOTS = [(g, float(x), float(y)) for g in ("a", None, "c") for x, y in zip(np.sort(RNG.permutation(900)[:300]) / 3e5, RNG.random(300), strict=True)]
ROWS = [(g, s, i) for i, (g, s) in enumerate(zip(RNG.choice(np.array(["a", "c", "z", None], object), 1500), np.where(RNG.random(1500) < 0.4, 0.0017, RNG.random(1500) * 0.004 - 0.0004).tolist(), strict=True))]
ROWS += [("a", None, 2000), ("c", float("nan"), 2001), ("c", float("inf"), 2002), (None, float("-inf"), 2003)] + [("a", x, 3000 + i) for i, (_, x, _) in enumerate(KNOTS[:40])]


@pytest.mark.parametrize("step", [True, False])
@pytest.mark.parametrize("how", ["sent", "merged"])
def test_as_of_join(spark, step, how):
    knots = spark.createDataFrame(KNOTS, "g string, x double, y double")
    df = spark.createDataFrame(ROWS, "g string, score double, i int").withColumn("payload", F.create_map(F.lit("k"), F.col("i")))
    out = curves._sent(df, knots, "score", "out", ["g"], step) if how == "sent" else curves.merged(df, knots, "score", "out", ["g"], step, rows=40)
    got = {r.i: r.out for r in out.collect()}
    assert len(got) == len(ROWS) and out.columns == [*df.columns, "out"]
    for g, s, i in ROWS:
        own = [(x, y) for h, x, y in KNOTS if h == g]
        if not own or s is None or np.isnan(s):
            assert got[i] is None
            continue
        x, y = map(np.array, zip(*own, strict=True))
        want = y[max(np.searchsorted(x, s, side="right") - 1, 0)] if step else np.interp(s, x, y)
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_as_of_join_without_segments_or_knots(spark):
    df = spark.createDataFrame([(0.2,), (0.4,), (None,)], "score double")
    none = spark.createDataFrame([], "x double, y double")
    for f in (curves._sent, curves.merged):
        assert [r.o for r in f(df, none, "score", "o", (), True).collect()] == [None] * 3
        one = spark.createDataFrame([(0.3, 7.0)], "x double, y double")
        assert sorted(r.o or -1 for r in f(df, one, "score", "o", (), False).collect()) == [-1, 7, 7]


def plain_blocks(pdf, increasing):
    pdf = pdf.sort_values("x")
    sign = 1 if increasing else -1
    return dict(zip(pdf["x"], sign * kernels.pava(sign * pdf["y"].to_numpy(), pdf["w"].to_numpy()), strict=True))


@pytest.mark.parametrize("increasing", [True, False])
@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "wave", "weights"])
def test_hulls_agree_with_pooling(spark, shape, increasing):
    n = 3000
    x = np.sort(RNG.random(n)) / 1e5
    t = np.arange(n)
    y = {"noise": RNG.integers(0, 2, n) * 1.0, "rising": t / n, "falling": -t / n, "wave": np.sin(t / 300) + RNG.normal(0, 0.3, n), "weights": (RNG.random(n) < t / n) * 1.0}[shape]
    w = RNG.random(n) if shape == "weights" else np.ones(n)
    if shape == "weights":
        w[RNG.random(n) < 0.2] = 0
    pdf = pd.DataFrame({"g": np.where(t % 3 == 0, "a", "b"), "x": x, "n": 1, "w": w, "y": np.where(w > 0, y, 0.0)})
    pdf["wy"] = pdf["w"] * pdf["y"]
    df = spark.createDataFrame(pdf)
    cut = Stretches(df.select("x"), rows=100)
    blocks = isotonic.pav_blocks(df, ["g"], increasing=increasing, meet=0, stretches=cut, evenly=4).toPandas()
    whole = isotonic.pav_blocks(df, ["g"], increasing=increasing).toPandas()
    for g, own in blocks.groupby("g"):
        own = own.sort_values("x_lo").reset_index(drop=True)
        assert (own["block"] == range(len(own))).all() and (own["last"] == len(own) - 1).all()
        want = plain_blocks(pdf[pdf["g"] == g], increasing)
        at = np.array(list(want))
        found = own["value"].to_numpy()[np.searchsorted(own["x_lo"].to_numpy(), at, side="right") - 1]
        inner = pdf[pdf["g"] == g].sort_values("x")["w"].to_numpy() > 0
        assert np.allclose(found[inner], np.array(list(want.values()))[inner], atol=1e-9)
        other = whole[whole["g"] == g].sort_values("x_lo")
        if shape != "weights":
            assert len(other) == len(own) and np.allclose(other[["x_lo", "x_hi", "value", "n", "w", "wy", "centre"]], own[["x_lo", "x_hi", "value", "n", "w", "wy", "centre"]])
        assert own["n"].sum() == (pdf["g"] == g).sum()


def test_many_blocks_never_meet(spark, monkeypatch):
    """50,000 rising labels are 50,000 blocks; the one-task way must not be taken."""
    monkeypatch.setattr(isotonic, "_in_one_task", lambda *_: pytest.fail("blocks met"))
    df = spark.range(50_000).select((F.col("id") / 1e9).alias("x"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("w"), (F.col("id") / 5e4).alias("wy"), (F.col("id") / 5e4).alias("y"))
    out = isotonic.pav_blocks(df, stretches=Stretches(df.select("x"), rows=5000))
    assert out.count() == 50_000 and out.agg(F.max("last")).first()[0] == 49_999


def test_quantiles(spark):
    pdf = pd.DataFrame({"g": np.where(np.arange(501) < 7, "a", "b"), "x": np.round(RNG.random(501), 2)})
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["_e"] for r in metrics.quantiles(spark.createDataFrame(pdf), "x", at, ["g"]).collect()}
    for g, own in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(own["x"], at).tolist(), abs=1e-12)


def test_no_window_over_a_segments_scores(spark):
    """Plans order scores within stretches only."""
    import re

    rows = spark.createDataFrame([("a", i / 1000, float(i % 2)) for i in range(100)], "g string, score double, label double")
    for df in (metrics.auc(rows, by=["g"]), metrics.rank_metrics(rows, "score", "label", ["g"]), ties.with_ranks(ties.tie_table(rows, by=["g"]), ["g"])):
        plan = df._jdf.queryExecution().analyzed().toString()
        assert all("_part" in spec for spec in re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan) if re.search(r"\bx#|\bscore#", spec))


def test_bin_ends_agree_with_counting_cuts(spark):
    from scorecal.operators.ties import bin_ends, cuts_through, tie_table, with_ranks

    rng = np.random.default_rng(5)
    rows = [(g, float(np.round(v, d)), float(v > 0.4)) for g, n, d in (("a", 700, 2), ("b", 300, 6), (None, 5, 1)) for v in rng.random(n)]
    ranked = with_ranks(tie_table(spark.createDataFrame(rows, "g string, score double, label double"), by=["g"]), ["g"])
    bins = [1, 2, 3, 7, 50, 299, 300, 301, 1000]
    ends = lambda b: (cuts_through(F.col("hi"), b) > cuts_through(F.col("lo"), b)) | (F.col("hi") == F.col("total"))
    want = ranked.select("g", "hi", "sx", "sy", "total", F.explode(F.filter(F.array(*map(F.lit, bins)), ends)).alias("n_bins"))
    got = bin_ends(ranked, bins, ["g"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "MapInArrow" in metrics.summaries_of(ranked, bins, ["g"])._jdf.queryExecution().toString()  # no row meets each number of bins


def test_groups_pool_over_their_ends_in_few_writes(spark, monkeypatch):
    """Teeth of rising labels fall back again and again: all of it is one block, whatever the groups; rising labels take one round."""
    writes = []
    monkeypatch.setattr(isotonic, "kept", lambda df: writes.append(1) or kept(df))
    n = 6000
    i = F.col("id")
    base = spark.range(n).select((i / 1e4).alias("x"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("w"), ((i % 500) / 500).alias("saw"), (i / n).alias("up"))
    for shape, blocks, most in (("saw", None, 20), ("up", n, 4)):
        writes.clear()
        df = base.select("x", "n", "w", F.col(shape).alias("wy"), F.col(shape).alias("y"))
        out = isotonic.pav_blocks(df, stretches=Stretches(df.select("x"), rows=100), meet=0).toPandas().sort_values("block")
        at = df.orderBy("x").toPandas()
        found = out["value"].to_numpy()[np.searchsorted(out["x_lo"].to_numpy(), at["x"].to_numpy(), side="right") - 1]
        assert np.allclose(found, kernels.pava(at["y"].to_numpy()), atol=1e-12)
        assert len(out) == blocks if blocks else len(out) < 510
        assert len(writes) <= most


def test_tasks_that_sort_follow_the_table(spark):
    ties = spark.range(2000).select((F.col("id") / 2000).alias("x"), F.lit(1).alias("n"), F.lit(1.0).alias("w"), (F.col("id") % 3 / 2).alias("wy"), (F.col("id") % 3 / 2).alias("y"))
    stretches = Stretches(ties.select("x"), rows=10)
    local = isotonic._local_blocks(ties, [], "y", 1.0, stretches, False)
    assert local.rdd.getNumPartitions() >= len(stretches) / isotonic.TOGETHER > 20
    assert local.agg(F.sum("n"), F.sum("_k"), F.sum("wy")).first()[:] == (2000, 2000, ties.agg(F.sum("wy")).first()[0])

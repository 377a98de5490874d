"""Spark operators against small known values and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecal.operators import arrays, calibrators as C, corp, diagnostics, metrics, multiclass, resample, selection
from scorecal.operators.curves import apply_linear, apply_step
from scorecal.operators.isotonic import pav_fit
from scorecal.operators.ties import equal_mass_bins, tie_table
from scorecal.sources.scored import read_results, synthetic, write_results
from scorecal.streaming.monitor import windowed_bins

# Five published scores and labels; the metrics of them that the tests name are known.
P, Y = [0.2, 0.7, 0.8, 0.4, 0.6], [0, 1, 1, 0, 1]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(list(zip(P, map(float, Y), strict=True)), "score double, label double")


@pytest.fixture(scope="module")
def over(spark):
    return synthetic(spark, "heavy_tie", 4000, 3).select("id", "score", "label", "p_true").repartition(4).cache()


def test_known_metric_values(five):
    basic = metrics.basic_metrics(five).first()
    assert basic.brier == pytest.approx(0.098) and basic.mean_calibration_error == pytest.approx(0.06)
    two = metrics.uniform_errors(five, n_bins=2).first()
    assert two.ece == pytest.approx(0.3) and two.mce == pytest.approx(0.3)
    assert metrics.binned_calibration_error(five, n_bins=2).first().bce == pytest.approx(0.3)
    assert metrics.rank_metrics(five, "score", "label").first().spearman == pytest.approx(0.866, abs=1e-3)
    assert np.isnan(metrics.rank_metrics(five.withColumn("one", F.lit(1.0)), "score", "one").first().spearman)
    assert metrics.auc(five).first().auc == 1.0


def test_unique_counts(spark):
    df = spark.createDataFrame(list(zip([0.2, 0.7, 0.8, 0.2, 0.7], [0.1, 0.6, 0.9, 0.2, 0.5], strict=True)), "p double, o double")
    assert tuple(metrics.unique_value_counts(df, "p", "o").first()) == (3, 5, 0.6)


def test_equal_mass_bins_by_their_rule(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.random(300), 2)
    df = spark.createDataFrame([(float(v), 1.0) for v in x], "score double, label double")
    s = np.sort(x)
    for b in (1, 2, 7, 15, 99, 400):
        n, own = len(s), min(b, len(s))
        cuts = set()
        for c in (j * n // own for j in range(1, own)):
            while 0 < c < n and s[c] == s[c - 1]:
                c += 1
            if 0 < c < n:
                cuts.add(c)
        want = {}
        for i, v in enumerate(s):
            want[v] = sum(c <= i for c in cuts)
        got = {r.x: r.bin for r in equal_mass_bins(tie_table(df), b).collect()}
        assert got == want


def test_sweep_without_violation_stops_at_the_rows(spark):
    df = spark.createDataFrame([(i / 100, float(i >= 50)) for i in range(100)], "score double, label double")
    assert metrics.sweep_error(df).first().sweep_bins == 100
    both = df.withColumn("g", F.lit("a")).union(df.withColumn("g", F.lit("b")).withColumn("label", 1 - F.col("label")))
    got = {r.g: r.sweep_bins for r in metrics.sweep_error(both, by=["g"]).collect()}
    assert got == {"a": 100, "b": 1}


def test_decomposition_identity_and_idempotence(over):
    for kind in ("brier", "log"):
        d = corp.score_decomposition(over, kind=kind).first()
        assert d.mean_score == pytest.approx(d.mcb - d.dsc + d.unc, abs=1e-12) and d.mcb >= 0 and d.dsc >= 0
    curve = corp.reliability_curve(over)
    again = corp.recalibrated(over, curve)
    assert corp.score_decomposition(again, "cep").first().mcb == pytest.approx(0, abs=1e-12)


def test_weights_are_repetitions(over):
    weighted = over.withColumn("w", (F.col("id") % 3).cast("double"))
    repeated = weighted.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).where("w > 0")
    a = {r.x: r.cep for r in corp.reliability_curve(weighted.where("w > 0"), weight="w").collect()}
    b = {r.x: r.cep for r in corp.reliability_curve(repeated).collect()}
    assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x]) for x in a)
    with pytest.raises(Exception, match="weights"):
        C.Isotonic().fit(weighted.withColumn("w", F.lit(-1.0)), weight="w").knots.collect()


def test_two_rounds_of_pooling_are_one(spark):
    from scorecal.functions.kernels import pava

    rng = np.random.default_rng(4)
    x = np.unique(np.r_[rng.random(3000), -0.5, 1.7])
    y, w = rng.random(len(x)) + x, rng.random(len(x))
    df = spark.createDataFrame([(*map(float, v), 1) for v in zip(x, y, w, strict=True)], "x double, y double, w double, n int")
    got = pav_fit(df).orderBy("x").toPandas()
    assert np.allclose(got.z, pava(y, w))
    assert np.allclose(pav_fit(df, increasing=False).orderBy("x").toPandas().z, -pava(-y, w))


def test_curves(spark):
    knots = spark.createDataFrame([(0.0, 0.2), (1.0, 0.8)], "x double, y double")
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.25, 1.0, 5.0, float("nan"), None)], "score double")
    by_score = lambda df: {str(r.score): r.calibrated if r.calibrated is None else round(r.calibrated, 6) for r in df.collect()}
    assert by_score(apply_linear(df, knots)) == {"-1.0": 0.2, "0.0": 0.2, "0.25": 0.35, "1.0": 0.8, "5.0": 0.8, "nan": None, "None": None}
    assert by_score(apply_step(df, knots)) == {"-1.0": 0.2, "0.0": 0.2, "0.25": 0.2, "1.0": 0.8, "5.0": 0.8, "nan": None, "None": None}


def test_isotonic_bounds_and_ranges(spark, over):
    m = C.Isotonic(y_min=0.1, y_max=0.9, out_of_bounds="nan").fit(over)
    out = m.transform(spark.createDataFrame([(-0.2,), (0.5,), (1.3,)], "score double")).orderBy("score").collect()
    assert np.isnan(out[0].calibrated) and np.isnan(out[2].calibrated) and 0.1 <= out[1].calibrated <= 0.9
    with pytest.raises(ValueError):
        C.Isotonic(out_of_bounds="x").fit(over)


CALIBRATORS = [C.Isotonic(), C.CentredIsotonic(), C.RelaxedIsotonic(min_slope=0.001), C.NearlyIsotonic(lam=100.0), C.MonotoneSpline(), C.RegularizedIsotonic(alpha=1.0), C.SmoothedIsotonic(), C.SmoothedIsotonic(adaptive=True), C.DecisionAwareIsotonic(thresholds=(0.5,))]


@pytest.mark.parametrize("calibrator", CALIBRATORS, ids=lambda c: type(c).__name__)
def test_calibrators_improve_and_stay_in_range(over, calibrator):
    model = calibrator.fit(over)
    out = model.transform(over).agg(F.min("calibrated").alias("lo"), F.max("calibrated").alias("hi"), F.avg((F.col("calibrated") - F.col("p_true")) ** 2).alias("e"), F.avg((F.col("score") - F.col("p_true")) ** 2).alias("raw"), F.count("calibrated").alias("n")).first()
    assert out.n == 4000 and 0 <= out.lo <= out.hi <= 1 and out.e < out.raw
    if not isinstance(calibrator, (C.NearlyIsotonic, C.DecisionAwareIsotonic)):
        assert model.check_monotonic().first().monotonic
    if not calibrator.weighted:
        with pytest.raises(ValueError):
            calibrator.fit(over.withColumn("w", F.lit(1.0)), weight="w")


def test_relaxed_without_slack_is_isotonic(over):
    a = C.RelaxedIsotonic().fit(over).transform(over).select("id", F.col("calibrated").alias("a"))
    b = C.Isotonic().fit(over).transform(over).select("id", F.col("calibrated").alias("b"))
    assert a.join(b, "id").where("abs(a - b) > 1e-9").count() == 0


def test_selection_and_folds(over):
    folds = selection.with_folds(over, ["id"], 4)
    assert {r.fold for r in folds.select("fold").distinct().collect()} == {0, 1, 2, 3}
    best = selection.select_setting(tie_table(over), lambda a: C.MonotoneSpline(n_knots=5, alpha=a), [0.1, 1e6], 3)
    assert best == 0.1
    with pytest.raises(ValueError):
        selection.select_setting(tie_table(over), lambda a: C.Isotonic(), [], 3)
    oof = selection.cross_val_calibrate(over, C.Isotonic(), ["id"], folds=3)
    assert oof.count() == 4000 and corp.score_decomposition(oof, "calibrated").first().mcb > 1e-6


def test_resampling(over):
    ci = {r.metric: r for r in resample.bootstrap_ci(over, ["brier", "smece", "debiased_ece"], n_resamples=60, digits=2).collect()}
    assert ci["brier"].lower < ci["brier"].estimate < ci["brier"].upper
    assert ci["debiased_ece"].estimate == pytest.approx(metrics.equal_mass_errors(over).first().debiased, abs=1e-9)
    assert ci["smece"].estimate == pytest.approx(metrics.smooth_error(over).first().smece, abs=1e-9)
    bands = resample.resampling_bands(over, n_resamples=60, digits=2).collect()
    assert all(0 <= b.lower <= b.upper <= 1 for b in bands)


def test_multiclass_of_two_is_binary(over):
    two = over.select(F.array(1 - F.col("score"), "score").alias("probabilities"), F.col("label").cast("int").alias("label"), "score")
    own = corp.score_decomposition(over).first()
    got = {r["class"]: r for r in multiclass.classwise_decomposition(two).collect()}
    assert got[1].mcb == pytest.approx(own.mcb) and got[0].mcb == pytest.approx(own.mcb)
    inner = F.least(F.greatest(F.col("score"), F.lit(0.01)), F.lit(0.99))
    t = C.TemperatureScaler().fit(two.withColumn("probabilities", F.array(1 - inner, inner)))
    assert 1.4 < t < 2.3
    after = C.apply_temperature(two, t)
    assert after.where("array_position(calibrated, array_max(calibrated)) <> array_position(probabilities, array_max(probabilities))").count() == 0
    with pytest.raises(Exception, match="probability"):
        multiclass.checked_matrix(two.withColumn("probabilities", F.array(F.lit(0.4), F.lit(0.4)))).collect()


def test_report_and_diagnostics(over):
    row = diagnostics.calibration_report(over, ci=True, n_resamples=40, digits=2).first()
    assert row.brier == pytest.approx(row.mcb - row.dsc + row.unc) and row.plugin_ece >= row.debiased_ece
    assert set(row.intervals) == {"brier", "smece", "debiased_ece"} and "base rate" in diagnostics.report_text(row)


def test_plateaus(spark):
    df = spark.createDataFrame([(float(i), z) for i, z in enumerate([0.2, 0.2, 0.2, 0.5, 0.8, 0.8])], "score double, calibrated double")
    found = diagnostics.plateaus(df).orderBy("plateau_id").collect()
    assert [(r.x_lo, r.x_hi, r.value, r.width, r.density) for r in found] == [(0.0, 2.0, 0.2, 3, "very_sparse"), (4.0, 5.0, 0.8, 2, "very_sparse")]
    assert "only 3 samples" in diagnostics.plateau_warnings(diagnostics.plateaus(df)).first().warning


def test_array_helpers(spark):
    df = spark.createDataFrame([(1.0,), (1.0 + 1e-12,), (2.0,)], "v double")
    assert [(r.value, r.n) for r in arrays.value_groups(df, "v").orderBy("value").collect()] == [(1.0, 2), (2.0, 1)]
    with pytest.raises(Exception, match="invalid"):
        arrays.validated(spark.createDataFrame([(2.0, 1.0)], "score double, label double"), unit=True).collect()


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d", "m", 1, "a", "0.5"), ("d", "m", 2, "a", "oops")], "dataset string, model string, seed int, method string, brier string")
    write_results(df, str(tmp_path / "r"))
    got = sorted((r.seed, r.brier) for r in read_results(spark, str(tmp_path / "r"), ["brier"]).collect())
    assert got[0] == (1, 0.5) and np.isnan(got[1][1])


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(2000).select((F.timestamp_seconds(F.col("id") * 200)).alias("ts"), (F.col("id") % 97 / 97).alias("score"), (F.col("id") % 2).cast("double").alias("label"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_bins(stream).writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("bins").select("window_start", "bin", "n", F.round("sum_score", 6))) == key(windowed_bins(rows).select("window_start", "bin", "n", F.round("sum_score", 6)))


def test_folds_keep_fractions_of_weights(spark):
    rng = np.random.default_rng(4)
    rows = [(float(x), float(rng.random() < x), float(w)) for x, w in zip(rng.random(300), rng.random(300) / 150, strict=True)]
    rows += [(0.5, float(i % 3 == 0), 0.001) for i in range(60)]
    df = spark.createDataFrame(rows, "score double, label double, w double")
    ties = tie_table(df, weight="w")
    held = selection._tie_folds(ties, 5).toPandas()
    want = ties.toPandas().set_index("x").sort_index()
    got = held.groupby("x")[["w", "wy", "n"]].sum()
    assert len(got) == len(want) and np.allclose(got["w"], want["w"], rtol=1e-9) and np.allclose(got["wy"], want["wy"], rtol=1e-9, atol=1e-15)
    assert (got["n"] == want["n"]).all() and held["x"].value_counts().drop(0.5).eq(1).all()
    assert held[held["x"] == 0.5]["n"].tolist() == [12] * 5 and held.groupby("fold")["w"].sum().min() > 0.1 * want["w"].sum()
    best = selection.select_setting(ties, lambda a: C.MonotoneSpline(n_knots=5, alpha=a), [0.1, 1e6], 3)
    scaled = tie_table(df.withColumn("w", F.col("w") * 1024), weight="w")
    assert best == selection.select_setting(scaled, lambda a: C.MonotoneSpline(n_knots=5, alpha=a), [0.1, 1e6], 3)
    rounded = tie_table(df.selectExpr("round(score, 1) as score", "label"))
    counts = selection._tie_folds(rounded, 5).toPandas()
    assert (counts["w"] == counts["n"]).all() and (counts["w"] % 1 == 0).all() and (counts["wy"] % 1 == 0).all()


def test_bca_acceleration_is_that_of_all_rows(spark):
    rows = [(round(i % 7 / 7, 3), float(i % 7 > 3 or i % 5 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "score double, label double")
    named = {m: resample.METRICS[m] for m in ("brier", "debiased_ece", "mcb")}
    cells = df.groupBy(F.col("score").alias("x"), F.col("label").alias("y")).agg(F.count("*").cast("double").alias("n"))
    got = resample.accelerations(cells, named)
    x, y = (np.array(c) for c in zip(*rows, strict=True))
    for m, f in named.items():
        left = []
        for i in range(len(rows)):
            at = sorted((a, b) for j, (a, b) in enumerate(zip(x, y, strict=True)) if j != i)
            keys = sorted(set(at))
            left.append(f(*(np.array(c, float) for c in zip(*keys, strict=True)), np.array([at.count(k) for k in keys], float)))
        c = np.mean(left) - np.array(left)
        assert got[m] == pytest.approx((c**3).sum() / (6 * (c**2).sum() ** 1.5), abs=1e-9)
    found = resample.bootstrap_ci(df, ["brier"], n_resamples=60, method="bca").first()
    assert found.lower <= found.estimate <= found.upper
    assert resample.accelerations(cells.limit(0), named) == {}


def test_learning_curve_samples_are_whole(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 100 / 100).alias("score"), (F.pmod(F.xxhash64("id"), F.lit(2))).cast("double").alias("label"))
    sizes = {r["size"]: r.trials for r in diagnostics.learning_curve(rows, ["id"], [10, 5000], 3).collect()}
    assert sizes == {10: 3, 5000: 3}
    few = diagnostics.learning_curve(rows, ["id"], [1], 5).collect()
    assert [(r["size"], r.trials, r.diversity) for r in few] == [(1, 5, 1.0)]


def test_temperature_passes_over_distinct_rows(spark, monkeypatch):
    """Rounds read each distinct (probabilities, label) once, with its rows; vectors may differ in length."""
    rows = [([0.7, 0.3], 0)] * 60 + [([0.7, 0.3], 1)] * 40 + [([0.2, 0.5, 0.3], 1)] * 30 + [([0.2, 0.5, 0.3], 2)] * 25 + [([0.5, 0.5], None), ([0.5, 0.5], 2)]
    df = spark.createDataFrame(rows, "probabilities array<double>, label int")
    seen, loss = [], C.TemperatureScaler.loss
    monkeypatch.setattr(C.TemperatureScaler, "loss", lambda self, cells, *rest: seen.append(cells.count()) or loss(self, cells, *rest))
    found = C.TemperatureScaler().fit(df)
    assert seen == [4] * 6
    at = np.linspace(-3, 3, 200_001)
    mean = sum(n * (np.log(np.sum([np.array(v) ** np.exp(-at)[:, None] for v in [p]][0], axis=1)) - np.exp(-at) * np.log(p[y])) for p, y, n in (([0.7, 0.3], 0, 60), ([0.7, 0.3], 1, 40), ([0.2, 0.5, 0.3], 1, 30), ([0.2, 0.5, 0.3], 2, 25)))
    assert found == pytest.approx(float(np.exp(at[mean.argmin()])), abs=1e-4)

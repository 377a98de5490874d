"""Segments of null are kept, and a null or NaN score or label is an error."""

import pytest
from pyspark.sql import functions as F

from scorecal.operators import calibrators, corp, diagnostics, metrics
from scorecal.operators.ties import tie_table


@pytest.fixture(scope="module")
def rows(spark):
    found = [(g, (i * 37 % 100) / 100, float((i * 7919) % 100 < i * 37 % 100)) for g in ("a", None) for i in range(120)]
    return spark.createDataFrame(found, "g string, score double, label double").repartition(3)


EACH = {
    "basic": lambda df, by: metrics.basic_metrics(df, by=by),
    "uniform": lambda df, by: metrics.uniform_errors(df, by=by),
    "bce_quantile": lambda df, by: metrics.binned_calibration_error(df, strategy="quantile", by=by),
    "equal_mass": lambda df, by: metrics.equal_mass_errors(df, by=by),
    "sweep": lambda df, by: metrics.sweep_error(df, by=by),
    "spearman": lambda df, by: metrics.rank_metrics(df, "score", "label", by),
    "auc": lambda df, by: metrics.auc(df, by=by),
    "tie_preservation": lambda df, by: metrics.tie_preservation(df, "score", "label", by),
    "smooth": lambda df, by: metrics.smooth_error(df, 0.1, by=by),
    "decomposition": lambda df, by: corp.score_decomposition(df, by=by),
    "plateau_quality": lambda df, by: diagnostics.plateau_quality(df.withColumn("calibrated", F.round("score", 1)), by=by),
}


@pytest.mark.parametrize("name", EACH)
def test_null_segment_is_a_segment(rows, name):
    got = {r.g: r for r in EACH[name](rows, ["g"]).collect()}
    assert set(got) == {"a", None}
    alone = EACH[name](rows.where("g is null"), []).first()
    assert [got[None][c] for c in alone.__fields__] == pytest.approx(list(alone), nan_ok=True)


def test_fit_and_curve_of_a_null_segment(rows):
    for model in (calibrators.Isotonic(out_of_bounds="nan"), calibrators.CentredIsotonic(), calibrators.RelaxedIsotonic(epsilon=0.01)):
        out = model.fit(rows, by=["g"]).transform(rows)
        assert out.where("calibrated is null").count() == 0 and out.count() == 240
    assert metrics.calibration_curve(rows, by=["g"]).where("g is null").agg(F.sum("n")).first()[0] == 120


@pytest.mark.parametrize("score, label", [(None, 1.0), (0.5, None), (float("nan"), 1.0), (0.5, float("nan"))])
def test_missing_values_are_errors(spark, score, label):
    df = spark.createDataFrame([(0.2, 1.0), (score, label)], "score double, label double")
    for f in (tie_table, metrics.basic_metrics, metrics.uniform_errors, lambda d: metrics.binned_calibration_error(d, strategy="uniform")):
        with pytest.raises(Exception, match="invalid score or label"):
            f(df).collect()

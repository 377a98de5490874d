"""The benchmark itself: every method on every cell (dataset, model, seed), all cells of a batch in one pass.

A cell's rows are split in two.  Calibrators are fitted on one part, as
segments, and measured on the other one, which is used for nothing else.
"""

from __future__ import annotations

import json
import platform
import time
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.functions import scores as S
from scorecal.operators.calibrators import Calibrator
from scorecal.operators.corp import score_decomposition
from scorecal.operators.keep import kept
from scorecal.operators.metrics import auc, equal_mass_errors, rank_metrics, smooth_error, sweep_error, tie_preservation
from scorecal.operators.selection import stratified_folds
from scorecal.operators.ties import By, join_by, validated

CELL = ("dataset", "model", "seed")
PLAIN = ("brier", "log_loss", "n_distinct", "distinct_ratio", "true_error")
MEASURES = (*PLAIN, "mcb", "dsc", "unc", "mcb_log", "dsc_log", "unc_log", "plugin_ece", "debiased_ece", "sweep_ece", "sweep_bins", "smece", "smece_sigma", "spearman_to_raw", "auc", "auc_raw", "tie_preservation")


def evaluate(df: DataFrame, by: By = (), n_bins: int = 15, measures: Sequence[str] = MEASURES, raw: str = "score", calibrated: str = "calibrated", label: str = "label", truth: str | None = None) -> DataFrame:
    """(by, n_test, base_rate, measures): one row per segment; only what ``measures`` names is computed.

    ``true_error`` is the mean distance to the column ``truth``, NaN without
    one or where it is null.  ``auc`` is NaN with one class only.
    """
    unknown = set(measures) - set(MEASURES)
    if unknown:
        raise ValueError(f"unknown measures {sorted(unknown)}")
    nan = F.lit(float("nan"))
    p, y = F.col(calibrated).cast("double"), F.col(label).cast("double")
    error = nan if truth is None else F.coalesce(F.avg(F.abs(p - F.col(truth).cast("double"))), nan)
    plain = {"brier": F.avg(S.brier(p, y)), "log_loss": F.avg(S.log_score(p, y)), "true_error": error}
    distinct = F.count_distinct(F.bround(p, 6))
    plain |= {"n_distinct": distinct.cast("double"), "distinct_ratio": distinct / F.count("*")}
    sound = validated(df, calibrated, label)
    parts = [sound.groupBy(*by).agg(F.count("*").alias("n_test"), F.avg(y).alias("base_rate"), *(plain[m].alias(m) for m in PLAIN if m in measures))]
    wants = lambda *names: any(n in measures for n in names)
    how = {"score": calibrated, "label": label, "by": by}
    if wants("mcb", "dsc", "unc"):
        parts.append(score_decomposition(df, **how).select(*by, "mcb", "dsc", "unc"))
    if wants("mcb_log", "dsc_log", "unc_log"):
        parts.append(score_decomposition(df, kind="log", **how).select(*by, *(F.col(c).alias(f"{c}_log") for c in ("mcb", "dsc", "unc"))))
    if wants("plugin_ece", "debiased_ece"):
        parts.append(equal_mass_errors(df, n_bins=n_bins, **how).select(*by, F.col("plugin_l2").alias("plugin_ece"), F.col("debiased").alias("debiased_ece")))
    if wants("sweep_ece", "sweep_bins"):
        parts.append(sweep_error(df, **how).select(*by, "sweep_ece", F.col("sweep_bins").cast("double").alias("sweep_bins")))
    if wants("smece", "smece_sigma"):
        parts.append(smooth_error(df, **how).select(*by, "smece", F.col("sigma").alias("smece_sigma")))
    if wants("spearman_to_raw"):
        parts.append(rank_metrics(df, raw, calibrated, by).select(*by, F.col("spearman").alias("spearman_to_raw")))
    for name, column in (("auc", calibrated), ("auc_raw", raw)):
        if wants(name):
            parts.append(auc(df, column, label, by).select(*by, F.coalesce("auc", nan).alias(name)))
    if wants("tie_preservation"):
        parts.append(tie_preservation(df, raw, calibrated, by))
    out = reduce(lambda a, b: join_by(a, b, by), parts)
    return out.select(*by, "n_test", "base_rate", *measures)


def split_cells(df: DataFrame, key: Sequence[str], seeds: Sequence[int], cell: Sequence[str] = CELL[:2], label: str = "label") -> DataFrame:
    """df once for each seed, with seed and test: half of each cell's rows of each label, by a hash of key and seed."""
    rows = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    dealt = stratified_folds(rows, [*key, "seed"], label, 2, name="_half", by=[*cell, "seed"])
    return dealt.withColumn("test", F.col("_half") == 1).drop("_half")


def run_cells(rows: DataFrame, methods: dict[str, Calibrator | None], cell: By = CELL, n_bins: int = 15, measures: Sequence[str] = MEASURES, score: str = "score", label: str = "label", truth: str | None = None) -> DataFrame:
    """(cell, method, n_fit, n_test, base_rate, n_distinct_input, measures, seconds) of every method on every cell.

    ``rows`` has a boolean ``test``.  A method of None leaves scores as they
    are.  All methods see the same rows; ``seconds`` is what a method's fits and
    outputs took for all cells together.
    """
    if not methods:
        raise ValueError("no methods")
    rows = kept(rows)
    fit, held = rows.where(~F.col("test")), rows.where("test")
    columns = [*dict.fromkeys([*cell, score, label, *([truth] if truth else [])])]
    outputs = []
    for name, calibrator in methods.items():
        began = time.perf_counter()
        test = held.select(*columns)
        out = test.withColumn("calibrated", F.col(score).cast("double")) if calibrator is None else calibrator.fit(fit, score, label, by=cell).transform(test, score)
        out = kept(out.withColumn("method", F.lit(name)))
        outputs.append(out.withColumn("seconds", F.lit(time.perf_counter() - began)))
    every = kept(reduce(DataFrame.unionByName, outputs))
    own = [*cell, "method"]
    found = evaluate(every, own, n_bins, measures, score, "calibrated", label, truth)
    times = every.groupBy(*own).agg(F.first("seconds").alias("seconds"))
    sizes = rows.groupBy(*cell).agg(F.count_if(~F.col("test")).alias("n_fit"), F.count_distinct(F.when(F.col("test"), F.bround(F.col(score).cast("double"), 6))).alias("n_distinct_input"))
    out = join_by(join_by(found, times, own), sizes, cell)
    return out.select(*own, "n_fit", "n_test", "base_rate", "n_distinct_input", *measures, "seconds")


def environment() -> dict[str, str]:
    return {"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__, "numpy": np.__version__}


def _listed(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def run_grid(rows: DataFrame, methods: dict[str, Calibrator | None], folder: str, cell: By = CELL, batches: int = 8, stop_after: int | None = None, **how) -> DataFrame:
    """``run_cells`` in batches of cells, kept in ``folder``; what a run has finished is not run again.

    Results are a Parquet partition for each cell, overwritten one by one, and
    the manifest is a JSON row for each cell, written after its results: the
    cell, the run's settings, environment and time.  A cell is skipped if the
    manifest has it with the same settings, so a run that was cut short goes
    on where it stopped.  ``stop_after`` ends a run after so many batches.
    """
    spark = rows.sparkSession
    settings = json.dumps({"methods": {k: repr(v) for k, v in sorted(methods.items())}, **{k: repr(v) for k, v in sorted(how.items())}})
    results, manifest = f"{folder}/results", f"{folder}/manifest"
    cells = kept(rows.select(*cell).distinct().withColumn("_batch", F.pmod(F.xxhash64(*cell), F.lit(batches))))
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cell)
    if _listed(spark, manifest):
        done = spark.read.schema(f"{types}, settings string").json(manifest).where(F.col("settings") == settings).select(*cell).distinct()
        done = join_by(cells, done.withColumn("_done", F.lit(True)), cell, "left")
        cells = kept(done.where("_done is null").drop("_done"))
    waiting = sorted(r[0] for r in cells.select("_batch").distinct().collect())  # of ``batches``
    schema = run_cells(rows.limit(0), methods, cell, **how).schema if not waiting else None
    for batch in waiting[:stop_after]:
        todo = cells.where(F.col("_batch") == batch).select(*cell)
        part = join_by(rows, todo.withColumn("_todo", F.lit(True)), cell).drop("_todo")
        found = run_cells(part, methods, cell, **how)
        schema = found.schema
        found.repartition(*cell).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cell).parquet(results)
        noted = todo.select("*", F.lit(settings).alias("settings"), F.lit(json.dumps(environment())).alias("environment"), F.current_timestamp().cast("string").alias("finished"))
        noted.write.mode("append").json(manifest)
    return spark.read.schema(schema).parquet(results).select(*schema.names)


def headline_table(results: DataFrame, baseline: str, cell: By = CELL[:2]) -> DataFrame:
    """(cell, method, brier, delta, smece, n_distinct, true_error, wins, n_seeds), means over seeds, against a baseline.

    ``wins`` counts the seeds on which a method's Brier score is below the
    baseline's; the baseline has null for it and for ``delta``.
    """
    base = results.where(F.col("method") == baseline).select(*cell, "seed", F.col("brier").alias("_base"))
    own = join_by(results, base, [*cell, "seed"])
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    rest = F.col("method") != baseline
    return own.groupBy(*cell, "method").agg(
        F.avg("brier").alias("brier"), F.avg(F.when(rest, F.col("_base") - F.col("brier"))).alias("delta"), F.avg(finite("smece")).alias("smece"),
        F.avg("n_distinct").alias("n_distinct"), F.avg(finite("true_error")).alias("true_error"), F.sum(F.when(rest, (F.col("brier") < F.col("_base")).cast("int"))).alias("wins"), F.count_distinct("seed").alias("n_seeds"),
    )

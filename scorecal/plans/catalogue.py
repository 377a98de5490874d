"""Registered calibration queries and the SQL that checks them.

Queries run on scores of nine decimals, which keep all prices of the table
apart.  Oracles use another formulation where there is one: isotonic fits by
the convex hull of the cumulative sum diagram, bins by literal edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecal.functions import scores as S
from scorecal.operators import calibrators as C
from scorecal.operators import corp, diagnostics, metrics, multiclass, resample, selection

from scorecal.operators.keep import kept
from scorecal.operators.ties import bin_summaries, equal_mass_bins, tie_table
from scorecal.plans import bench_grid, bench_run, plot_data
from scorecal.sources.scored import CLASS_PROBS, DESIGNS, SCORED_DOCS, SCORED_LINEITEM, UNIFORMS, class_probabilities, lineitem_uniforms, scored_lineitem, synthetic
from scorecal.streaming.monitor import window_errors, windowed_bins

FLAG = ["l_returnflag"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Common SQL: the scored view, tie tables, and fits by convex hulls.
VIEW = f"v AS ({SCORED_LINEITEM.format(dp=9)})"
VIEW6 = f"v AS ({SCORED_LINEITEM.format(dp=6)})"


def ties_sql(by: str = "l_returnflag", view: str = "v", w: str = "1.0") -> str:
    return f"t AS (SELECT {by}, score AS x, count(*) AS n, sum({w}) AS w, sum({w} * label) AS wy, sum({w} * label) / sum({w}) AS y FROM {view} GROUP BY {by}, score)"


def fit_sql(by: str = "l_returnflag", y: str = "y", ties: str = "t", out: str = "f") -> str:
    """Weighted isotonic fit z: means between the points of the lower convex hull of (weight, weighted y), found by dropping points above their neighbours' line until none is."""
    o = f"OVER (PARTITION BY {by} ORDER BY i)"
    return f"""{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY x) AS i FROM {ties}),
{out}_h AS (SELECT {by}, 0::BIGINT AS i, 0.0::DOUBLE AS cw, 0.0::DOUBLE AS cy, 0 AS round FROM {out}_r GROUP BY {by} UNION ALL SELECT {by}, i, sum(w) {o}, sum(w * {y}) {o}, 0 FROM {out}_r
  UNION ALL SELECT {by}, i, cw, cy, round + 1 FROM (SELECT *, bool_or(above) OVER () AS more FROM (SELECT *, coalesce((cy - lag(cy) {o}) / (cw - lag(cw) {o}) >= (lead(cy) {o} - cy) / (lead(cw) {o} - cw), false) AS above FROM {out}_h)) WHERE more AND NOT above),
{out}_s AS (SELECT {by}, lag(i) {o} AS i0, i AS i1 FROM {out}_h WHERE round = (SELECT max(round) FROM {out}_h)),
{out} AS (SELECT r.*, sum(w * {y}) OVER (PARTITION BY r.{by}, i1) / sum(w) OVER (PARTITION BY r.{by}, i1) AS z FROM {out}_r r JOIN {out}_s s ON r.{by} = s.{by} AND r.i > s.i0 AND r.i <= s.i1)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    """Columns rounded for comparison, minus zero made zero."""
    return df.select(*((F.round(c, to) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns))


def r6(*names: str, to: int = 6) -> str:
    return ", ".join(f"round({n}, {to}) + 0.0 AS {n.split('.')[-1]}" for n in names)


# Tie tables and plain metrics.


@query("tie_table", with_(VIEW, ties_sql()) + f"SELECT l_returnflag, x, n, {r6('w', 'wy', 'y')} FROM t")
def q_tie_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tie_table(scored_lineitem(spark, sf), by=FLAG), "w", "wy", "y")


@query("tie_table_weighted", with_(VIEW, ties_sql(w="weight")) + f"SELECT l_returnflag, x, n, {r6('w', 'wy', 'y')} FROM t")
def q_tie_table_weighted(spark, sf):
    return rounded(tie_table(scored_lineitem(spark, sf), weight="weight", by=FLAG), "w", "wy", "y")


BASIC = ("base_rate", "mean_prediction", "bias", "mean_calibration_error", "brier", "log_loss")
EPS = f"{S.EPS!r}"


@query(
    "basic_metrics",
    with_(VIEW6, f"q AS (SELECT *, least(greatest(score, {EPS}), 1 - {EPS}) AS c FROM v)")
    + f"SELECT l_returnflag, n, {r6(*BASIC)} FROM (SELECT l_returnflag, count(*) AS n, avg(label) AS base_rate, avg(score) AS mean_prediction, avg(score) - avg(label) AS bias, abs(avg(score) - avg(label)) AS mean_calibration_error, avg((score - label) * (score - label)) AS brier, avg(-(label * ln(c) + (1 - label) * ln(1 - c))) AS log_loss FROM q GROUP BY l_returnflag)",
)
def q_basic(spark, sf):
    return rounded(metrics.basic_metrics(scored_lineitem(spark, sf, 6), by=FLAG), *BASIC)


EDGES = ", ".join(f"{e!r}e0" for e in S.edges(10)[1:-1])
UBIN = f"len(list_filter([{EDGES}], lambda e: score >= e))"
UBINS = f"b AS (SELECT l_returnflag, {UBIN} AS bin, count(*) AS n, avg(score) AS conf, avg(label) AS acc FROM v GROUP BY ALL)"


@query("uniform_errors", with_(VIEW6, UBINS) + f"SELECT l_returnflag, {r6('ece', 'mce')} FROM (SELECT l_returnflag, sum(n * abs(conf - acc)) / sum(n) AS ece, max(abs(conf - acc)) AS mce FROM b GROUP BY l_returnflag)")
def q_uniform(spark, sf):
    return rounded(metrics.uniform_errors(scored_lineitem(spark, sf, 6), by=FLAG), "ece", "mce")


@query("calibration_curve_uniform", with_(VIEW6, UBINS) + f"SELECT l_returnflag, bin::INT AS bin, {r6('acc', 'conf')}, n FROM (SELECT g.l_returnflag, s.bin, coalesce(acc, 0) AS acc, coalesce(conf, 0) AS conf, coalesce(n, 0) AS n FROM (SELECT DISTINCT l_returnflag FROM v) g CROSS JOIN (SELECT unnest(range(10)) AS bin) s LEFT JOIN b ON b.l_returnflag = g.l_returnflag AND b.bin = s.bin)")
def q_curve_uniform(spark, sf):
    return rounded(metrics.calibration_curve(scored_lineitem(spark, sf, 6), by=FLAG), "acc", "conf")


QUANTILES = "e AS (SELECT l_returnflag, quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM v GROUP BY l_returnflag)"
QBINS = "b AS (SELECT l_returnflag, len(list_filter(q[2:10], lambda x: score >= x)) AS bin, count(*) AS n, avg(score) AS conf, avg(label) AS acc FROM v JOIN e USING (l_returnflag) GROUP BY ALL)"


@query("bce_quantile", with_(VIEW6, QUANTILES, QBINS) + f"SELECT l_returnflag, {r6('bce')}, n_bins FROM (SELECT l_returnflag, sqrt(avg((conf - acc) * (conf - acc))) AS bce, count(*) AS n_bins FROM b GROUP BY l_returnflag)")
def q_bce_quantile(spark, sf):
    return rounded(metrics.binned_calibration_error(scored_lineitem(spark, sf, 6), strategy="quantile", by=FLAG), "bce")


@query("calibration_curve_quantile", with_(VIEW6, QUANTILES, QBINS) + f"SELECT l_returnflag, bin::INT AS bin, {r6('acc', 'conf')}, n FROM b")
def q_curve_quantile(spark, sf):
    return rounded(metrics.calibration_curve(scored_lineitem(spark, sf, 6), strategy="quantile", by=FLAG), "acc", "conf")


SPAN = "e AS (SELECT l_returnflag, min(score) AS lo, max(score) AS hi FROM v GROUP BY l_returnflag)"
SBINS = "b AS (SELECT l_returnflag, len(list_filter(range(1, 10), lambda k: score >= lo + k * ((hi - lo) / 10))) AS bin, count(*) AS n, avg(score) AS conf, avg(label) AS acc FROM v JOIN e USING (l_returnflag) GROUP BY ALL)"


@query("bce_uniform", with_(VIEW6, SPAN, SBINS) + f"SELECT l_returnflag, {r6('bce')}, n_bins FROM (SELECT l_returnflag, sqrt(avg((conf - acc) * (conf - acc))) AS bce, count(*) AS n_bins FROM b GROUP BY l_returnflag)")
def q_bce_uniform(spark, sf):
    return rounded(metrics.binned_calibration_error(scored_lineitem(spark, sf, 6), by=FLAG), "bce")


# Equal-mass bins.


def mass_sql(bins: str, by: str = "l_returnflag", ties: str = "t") -> str:
    """Bin of every score: cuts at ranks floor(k n / B), moved to the end of the tie they fall in."""
    return f"""h AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY x) AS hi, sum(n) OVER (PARTITION BY {by}) AS total FROM {ties}),
k AS (SELECT *, hi - n AS lo, least({bins}, total) AS nb FROM h),
j AS (SELECT *, least(nb - 1, ((hi + 1) * nb - 1) // total) - least(nb - 1, ((lo + 1) * nb - 1) // total) AS cut FROM k),
m AS (SELECT *, coalesce(sum(CASE WHEN cut > 0 AND hi < total THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bin FROM j),
g AS (SELECT {by}, bin, sum(n) AS n, sum(x * n) / sum(n) AS conf, sum(wy) / sum(n) AS acc, any_value(total) AS total FROM m GROUP BY {by}, bin)"""


TERMS = "sum(n / total * CASE WHEN n > 1 THEN (conf - acc) * (conf - acc) - acc * (1 - acc) / (n - 1) ELSE 0 END)"


@query("equal_mass_bins", with_(VIEW, ties_sql(), mass_sql("15")) + f"SELECT l_returnflag, bin::INT AS bin, n::BIGINT AS n, {r6('conf', 'acc')} FROM g")
def q_bins(spark, sf):
    out = bin_summaries(equal_mass_bins(tie_table(scored_lineitem(spark, sf), by=FLAG), 15, FLAG), FLAG)
    return rounded(out.drop("total"), "conf", "acc")


MASS = ("plugin_l1", "plugin_l2", "debiased_squared", "debiased")


@query("equal_mass_errors", with_(VIEW6, ties_sql(), mass_sql("15"), f"s AS (SELECT l_returnflag, sum(n / total * abs(conf - acc)) AS plugin_l1, sqrt(sum(n / total * (conf - acc) * (conf - acc))) AS plugin_l2, greatest({TERMS}, 0) AS debiased_squared FROM g GROUP BY l_returnflag)") + f"SELECT l_returnflag, {r6(*MASS)} FROM (SELECT *, sqrt(debiased_squared) AS debiased FROM s)")
def q_equal_mass(spark, sf):
    return rounded(metrics.equal_mass_errors(scored_lineitem(spark, sf, 6), by=FLAG), *MASS)


MANY = "tb AS (SELECT l_returnflag, n_bins, x, n, wy FROM t CROSS JOIN (SELECT unnest(range(2, 51)) AS n_bins) b)"


@query("bin_sensitivity", with_(VIEW, ties_sql(), MANY, mass_sql("n_bins", "l_returnflag, n_bins", "tb")) + f"SELECT l_returnflag, n_bins::INT AS n_bins, {r6('plugin', 'debiased')}, occupied, monotone FROM (SELECT l_returnflag, n_bins, sum(n / total * abs(conf - acc)) AS plugin, sqrt(greatest({TERMS}, 0)) AS debiased, count(*) AS occupied, coalesce(bool_and(acc >= prior), true) AS monotone FROM (SELECT *, lag(acc) OVER (PARTITION BY l_returnflag, n_bins ORDER BY bin) AS prior FROM g) GROUP BY l_returnflag, n_bins)")
def q_sensitivity(spark, sf):
    return rounded(metrics.bin_sensitivity(scored_lineitem(spark, sf), by=FLAG), "plugin", "debiased")


SWEEP = "tb AS (SELECT l_returnflag, n_bins, x, n, wy FROM t CROSS JOIN (SELECT unnest(range(1, 400)) AS n_bins) b)"


@query(
    "sweep_error",
    with_(VIEW, ties_sql(), SWEEP, mass_sql("n_bins", "l_returnflag, n_bins", "tb"), "u AS (SELECT *, acc < lag(acc) OVER (PARTITION BY l_returnflag, n_bins ORDER BY bin) AS falls FROM g)", "p AS (SELECT l_returnflag, n_bins, coalesce(bool_or(falls), false) AS bad, sum(n / total * abs(conf - acc)) AS sweep_ece, count(*) AS sweep_bins FROM u GROUP BY l_returnflag, n_bins)", "c AS (SELECT *, bool_or(bad) OVER (PARTITION BY l_returnflag ORDER BY n_bins) AS stopped FROM p)")
    + f"SELECT l_returnflag, {r6('sweep_ece')}, sweep_bins FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n_bins DESC) AS r FROM c WHERE NOT stopped) WHERE r = 1",
)
def q_sweep(spark, sf):
    return rounded(metrics.sweep_error(scored_lineitem(spark, sf), by=FLAG), "sweep_ece")


# Kernel-smoothed error.


@query(
    "smooth_grid",
    with_(VIEW6, "s AS (SELECT score * 1000 AS place, least(greatest(floor(score * 1000), 0), 999) AS lo, score - label AS r FROM v)", "p AS (SELECT lo AS i, (1 - (place - lo)) AS s, r FROM s UNION ALL SELECT lo + 1, place - lo, r FROM s)")
    + "SELECT i::INT AS i, round(sum(r * s), 5) + 0.0 AS residual, round(sum(s), 5) + 0.0 AS mass FROM p GROUP BY i",
)
def q_grid(spark, sf):
    return rounded(metrics.smooth_grid(scored_lineitem(spark, sf, 6), 1001), "residual", "mass", to=5)


SIGMA = 0.1
SMOOTH = f"""s AS (SELECT l_returnflag, score * 1000 AS place, least(greatest(floor(score * 1000), 0), 999) AS lo, score - label AS r FROM v),
p AS (SELECT l_returnflag, lo AS i, (1 - (place - lo)) AS s, r FROM s UNION ALL SELECT l_returnflag, lo + 1, place - lo, r FROM s),
d AS (SELECT l_returnflag, i, sum(r * s) AS r, sum(s) AS m FROM p GROUP BY l_returnflag, i),
q AS (SELECT l_returnflag, i, r, m FROM d UNION ALL SELECT l_returnflag, -i, r, m FROM d WHERE i > 0 UNION ALL SELECT l_returnflag, 2000 - i, r, m FROM d WHERE i < 1000),
o AS (SELECT l_returnflag, k, sum(r * exp(-1 * pow((k - i) / 1000.0, 2) / (2 * pow({SIGMA}, 2)))) AS r, sum(m * exp(-1 * pow((k - i) / 1000.0, 2) / (2 * pow({SIGMA}, 2)))) AS m
  FROM q CROSS JOIN (SELECT unnest(range(0, 1001)) AS k) WHERE abs(k - i) <= 500 GROUP BY l_returnflag, k),
a AS (SELECT l_returnflag, j, j * 1000 / 199.0 AS place, least(floor(j * 1000 / 199.0), 999) AS k FROM (SELECT DISTINCT l_returnflag FROM v) CROSS JOIN (SELECT unnest(range(0, 200)) AS j)),
w AS (SELECT a.l_returnflag, x.r + (a.place - a.k) * (y.r - x.r) AS r, x.m + (a.place - a.k) * (y.m - x.m) AS m FROM a JOIN o x ON x.l_returnflag = a.l_returnflag AND x.k = a.k JOIN o y ON y.l_returnflag = a.l_returnflag AND y.k = a.k + 1)"""


@query("smooth_error_fixed", with_(VIEW, SMOOTH) + f"SELECT l_returnflag, round(sum(abs(r)) / (sum(m) + 200 * 1e-4 * sqrt(2 * pi()) * {SIGMA}), 6) AS smece, {SIGMA}::DOUBLE AS sigma FROM w GROUP BY l_returnflag")
def q_smooth(spark, sf):
    return rounded(metrics.smooth_error(scored_lineitem(spark, sf), SIGMA, by=FLAG), "smece")


@query("smooth_error")
def q_smooth_auto(spark, sf):
    return rounded(metrics.smooth_error(scored_lineitem(spark, sf, 6), by=FLAG), "smece")


# Ranks and distinct values.

RANKS = "r AS (SELECT l_returnflag, score, label, rank() OVER (PARTITION BY l_returnflag ORDER BY score) + (count(*) OVER (PARTITION BY l_returnflag, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY label) + (count(*) OVER (PARTITION BY l_returnflag, label) - 1) / 2.0 AS b FROM v)"


@query("spearman", with_(VIEW, RANKS) + f"SELECT l_returnflag, {r6('spearman')} FROM (SELECT l_returnflag, corr(a, b) AS spearman FROM r GROUP BY l_returnflag)")
def q_spearman(spark, sf):
    return rounded(metrics.rank_metrics(scored_lineitem(spark, sf), "score", "label", FLAG), "spearman")


@query("auc", with_(VIEW6, RANKS) + f"SELECT l_returnflag, {r6('auc')} FROM (SELECT l_returnflag, (sum(a * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc FROM r GROUP BY l_returnflag)")
def q_auc(spark, sf):
    return rounded(metrics.auc(scored_lineitem(spark, sf, 6), by=FLAG), "auc")


@query("unique_value_counts", with_(VIEW6) + "SELECT l_returnflag, count(DISTINCT score) AS n_unique, count(DISTINCT p_true) AS n_unique_original, count(DISTINCT score) / count(DISTINCT p_true) AS preservation_ratio FROM (SELECT l_returnflag, round_even(score, 2) AS score, round_even(p_true, 2) AS p_true FROM v) GROUP BY l_returnflag")
def q_unique(spark, sf):
    return metrics.unique_value_counts(scored_lineitem(spark, sf, 6), "score", "p_true", 2, FLAG)


@query("diversity_index", with_(VIEW) + f"SELECT l_returnflag, {r6('diversity', to=9)} FROM (SELECT l_returnflag, count(DISTINCT score) / count(*) AS diversity FROM v GROUP BY l_returnflag)")
def q_diversity(spark, sf):
    return rounded(metrics.diversity_index(scored_lineitem(spark, sf), by=FLAG), "diversity", to=9)


TIED = "x AS (SELECT l_returnflag, score AS o, round(score, 1) AS c, count(*) AS k FROM v GROUP BY ALL), p AS (SELECT l_returnflag, sum(k * (k - 1) / 2) AS kept, sum(k) AS n FROM x GROUP BY l_returnflag), po AS (SELECT l_returnflag, sum(k * (k - 1) / 2) AS t FROM (SELECT l_returnflag, o, sum(k) AS k FROM x GROUP BY ALL) GROUP BY l_returnflag), pc AS (SELECT l_returnflag, sum(k * (k - 1) / 2) AS t FROM (SELECT l_returnflag, c, sum(k) AS k FROM x GROUP BY ALL) GROUP BY l_returnflag)"


@query("tie_preservation", with_(VIEW, TIED) + "SELECT l_returnflag, round(greatest(0, least(1, coalesce(kept / nullif(po.t, 0), 1) - coalesce((pc.t - kept) / nullif(n * (n - 1) / 2, 0), 0))), 6) AS tie_preservation FROM p JOIN po USING (l_returnflag) JOIN pc USING (l_returnflag)")
def q_ties_kept(spark, sf):
    df = scored_lineitem(spark, sf).withColumn("calibrated", F.round("score", 1))
    return rounded(metrics.tie_preservation(df, "score", "calibrated", FLAG), "tie_preservation")


# No multiple of the scores' last decimal, so that no difference lies on the bound.
NEAR_BY = 0.0000100005
NEAR_TIES = f"""v6 AS (SELECT l_returnflag, score AS o, round(score * score, 9) AS c FROM v),
x AS (SELECT l_returnflag, o, c, count(*) AS k FROM v6 GROUP BY ALL), n AS (SELECT l_returnflag, sum(k) AS n FROM x GROUP BY l_returnflag),
w AS (SELECT l_returnflag, 'o' AS side, o AS v, sum(k) AS k FROM x GROUP BY ALL UNION ALL SELECT l_returnflag, 'c', c, sum(k) FROM x GROUP BY ALL),
e AS (SELECT *, sum(k) OVER (PARTITION BY l_returnflag, side ORDER BY v RANGE BETWEEN CURRENT ROW AND {NEAR_BY!r} FOLLOWING) - k AS more FROM w),
s AS (SELECT l_returnflag, sum(k * (k - 1) / 2 + k * more) FILTER (side = 'o') AS tied_o, sum(k * (k - 1) / 2 + k * more) FILTER (side = 'c') AS tied_c FROM e GROUP BY l_returnflag),
b AS (SELECT l_returnflag, o, c, k, floor(o / {NEAR_BY!r}) AS slot FROM x),
j AS (SELECT a.l_returnflag, sum(a.k * d.k) AS pairs FROM b a JOIN (SELECT *, slot AS at FROM b UNION ALL SELECT *, slot - 1 FROM b) d ON a.l_returnflag = d.l_returnflag AND a.slot = d.at
  AND (d.o > a.o OR (d.o = a.o AND d.c > a.c)) AND d.o - a.o <= {NEAR_BY!r} AND abs(d.c - a.c) <= {NEAR_BY!r} GROUP BY a.l_returnflag),
q AS (SELECT x.l_returnflag, sum(x.k * (x.k - 1) / 2) AS kept FROM x GROUP BY x.l_returnflag),
z AS (SELECT l_returnflag, (kept + coalesce(pairs, 0)) AS kept, tied_o, tied_c, n FROM q LEFT JOIN j USING (l_returnflag) JOIN s USING (l_returnflag) JOIN n USING (l_returnflag))"""


@query("tie_preservation_within", with_(VIEW, NEAR_TIES) + "SELECT l_returnflag, round(greatest(0, least(1, coalesce(kept / nullif(tied_o, 0), 1) - coalesce((tied_c - kept) / nullif(n * (n - 1) / 2, 0), 0))), 9) AS tie_preservation FROM z")
def q_ties_within(spark, sf):
    """Squares as the outputs, which tie low scores and part high ones."""
    df = scored_lineitem(spark, sf).withColumn("calibrated", F.round(F.col("score") * F.col("score"), 9))
    return rounded(metrics.tie_preservation(df, "score", "calibrated", FLAG, NEAR_BY), "tie_preservation", to=9)


# Isotonic curves and decompositions.


@query("corp_curve", with_(VIEW, ties_sql(), fit_sql()) + f"SELECT l_returnflag, x, {r6('cep', 'weight')} FROM (SELECT l_returnflag, x, z AS cep, w AS weight FROM f)")
def q_corp(spark, sf):
    return rounded(corp.reliability_curve(scored_lineitem(spark, sf), by=FLAG), "cep", "weight")


@query("corp_curve_weighted", with_(VIEW, ties_sql(w="weight"), fit_sql()) + f"SELECT l_returnflag, x, {r6('cep', 'weight')} FROM (SELECT l_returnflag, x, z AS cep, w AS weight FROM f)")
def q_corp_weighted(spark, sf):
    return rounded(corp.reliability_curve(scored_lineitem(spark, sf), weight="weight", by=FLAG), "cep", "weight")


PARTS = ("mean_score", "mcb", "dsc", "unc")
BASE = "b AS (SELECT l_returnflag, sum(wy) / sum(w) AS r FROM f GROUP BY l_returnflag)"
BRIER = "d AS (SELECT l_returnflag, sum(w * x * x - 2 * wy * x + wy) / sum(w) AS sx, sum(w * z * z - 2 * wy * z + wy) / sum(w) AS sc, sum(w * r * r - 2 * wy * r + wy) / sum(w) AS sr FROM f JOIN b USING (l_returnflag) GROUP BY l_returnflag)"


def _log_sum(p: str) -> str:
    c = f"least(greatest({p}, {EPS}), 1 - {EPS})"
    return f"sum(-(wy * ln({c}) + (w - wy) * ln(1 - {c}))) / sum(w)"


LOG = f"d AS (SELECT l_returnflag, {_log_sum('x')} AS sx, {_log_sum('z')} AS sc, {_log_sum('r')} AS sr FROM f JOIN b USING (l_returnflag) GROUP BY l_returnflag)"
SPLIT = f"SELECT l_returnflag, {r6(*PARTS)} FROM (SELECT l_returnflag, sx AS mean_score, sx - sc AS mcb, sr - sc AS dsc, sr AS unc FROM d)"


@query("corp_decomposition_brier", with_(VIEW, ties_sql(), fit_sql(), BASE, BRIER) + SPLIT)
def q_brier(spark, sf):
    return rounded(corp.score_decomposition(scored_lineitem(spark, sf), by=FLAG), *PARTS)


@query("corp_decomposition_log", with_(VIEW, ties_sql(), fit_sql(), BASE, LOG) + SPLIT)
def q_log(spark, sf):
    return rounded(corp.score_decomposition(scored_lineitem(spark, sf), kind="log", by=FLAG), *PARTS)


# Calibrators.

RUNS = "a AS (SELECT *, round(z, 9) AS zr FROM f), c AS (SELECT *, sum(CASE WHEN zr <> p THEN 1 ELSE 0 END) OVER (PARTITION BY l_returnflag ORDER BY x) AS block FROM (SELECT *, lag(zr) OVER (PARTITION BY l_returnflag ORDER BY x) AS p FROM a)), r AS (SELECT l_returnflag, block, min(x) AS lo, max(x) AS hi, any_value(z) AS y, sum(w * x) / sum(w) AS mid FROM c GROUP BY l_returnflag, block), e AS (SELECT *, max(block) OVER (PARTITION BY l_returnflag) AS last FROM r)"
CENTRED = "k AS (SELECT l_returnflag, CASE WHEN last = 0 THEN mid WHEN block = 0 THEN hi WHEN block = last THEN lo ELSE mid END AS x, least(greatest(y, 0), 1) AS y FROM e)"
STEPS = "k AS (SELECT DISTINCT l_returnflag, x, y FROM (SELECT l_returnflag, lo AS x, y FROM e UNION ALL SELECT l_returnflag, hi, y FROM e))"
LINES = "g AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w AS x_1 FROM k WINDOW w AS (PARTITION BY l_returnflag ORDER BY x)), o AS (SELECT t.l_returnflag, t.x, t.n, CASE WHEN t.x < g.x OR x1 IS NULL THEN g.y ELSE g.y + (y1 - g.y) * (t.x - g.x) / (x1 - g.x) END AS calibrated FROM t JOIN g ON t.l_returnflag = g.l_returnflag AND (t.x >= g.x OR x_1 IS NULL) AND (t.x < x1 OR x1 IS NULL))"
PER_SCORE = "SELECT l_returnflag, x AS score, n, round(calibrated, 9) + 0.0 AS calibrated FROM o"


def applied(model: C.Model, ties: DataFrame, to: int = 9) -> DataFrame:
    """The map's output at each distinct score: rows of one score get one output, so each score is sent through transform once."""
    return rounded(model.transform(ties.select("l_returnflag", F.col("x").alias("score"), "n")), "calibrated", to=to)


def fitted(make, to: int = 9):
    def run(spark, sf):
        df = scored_lineitem(spark, sf)
        ties = kept(tie_table(df, by=FLAG))  # one scan for the fit and its outputs
        return applied(make().fit(df, by=FLAG, ties=ties), ties, to)

    return run


query("isotonic_apply", with_(VIEW, ties_sql(), fit_sql(), RUNS, STEPS, LINES) + PER_SCORE)(fitted(lambda: C.Isotonic()))
query("centred_apply", with_(VIEW, ties_sql(), fit_sql(), RUNS, CENTRED, LINES) + PER_SCORE)(fitted(lambda: C.CentredIsotonic()))


@query("centred_knots", with_(VIEW, ties_sql(), fit_sql(), RUNS, CENTRED) + f"SELECT l_returnflag, {r6('x', 'y')} FROM k")
def q_centred_knots(spark, sf):
    return rounded(C.CentredIsotonic().fit(scored_lineitem(spark, sf), by=FLAG).knots, "x", "y")


def bounded_sql(step: str) -> str:
    """Fit with a least step: subtract the running sum, fit, add it back."""
    shift = f"ts AS (SELECT *, {step} AS l FROM t), tt AS (SELECT *, y - shift AS ys FROM (SELECT *, sum(CASE WHEN first THEN 0 ELSE l END) OVER (PARTITION BY l_returnflag ORDER BY x) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY x) = 1 AS first FROM ts)))"
    return shift + ", " + fit_sql(y="ys", ties="tt")


# Targets less a running sum of bounds are as large as that sum, which leaves fewer digits.
BOUNDED = f"SELECT l_returnflag, x AS score, n, {r6('calibrated')} FROM (SELECT *, least(greatest(z + shift, 0), 1) AS calibrated FROM f)"
query("relaxed_epsilon", with_(VIEW, ties_sql(), bounded_sql("-0.01")) + BOUNDED)(fitted(lambda: C.RelaxedIsotonic(epsilon=0.01), 6))
query("relaxed_min_slope", with_(VIEW, ties_sql(), bounded_sql("0.005")) + BOUNDED)(fitted(lambda: C.RelaxedIsotonic(min_slope=0.005), 6))

CDI = C.DecisionAwareIsotonic(thresholds=(0.3, 0.7), threshold_weights=(1.0, 2.0), window=10, bandwidth=0.1)
CDI_Z = repr(C.NormalDist().inv_cdf(0.975))
NEAR = "(1.0 * greatest(0, 1 - abs(mid - 0.3) / 0.1) + 2.0 * greatest(0, 1 - abs(mid - 0.7) / 0.1)) / (3.0 + 1e-12)"
CDI_SQL = f"""q1 AS (SELECT *, row_number() OVER o AS i, ((x + lag(x) OVER o) / 2 - min(x) OVER p) / (max(x) OVER p - min(x) OVER p) AS mid,
  sum(w) OVER (PARTITION BY l_returnflag ORDER BY x ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS wl, sum(wy) OVER (PARTITION BY l_returnflag ORDER BY x ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS yl,
  sum(w) OVER (PARTITION BY l_returnflag ORDER BY x ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS wr, sum(wy) OVER (PARTITION BY l_returnflag ORDER BY x ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS yr
  FROM t WINDOW o AS (PARTITION BY l_returnflag ORDER BY x), p AS (PARTITION BY l_returnflag)),
q2 AS (SELECT *, CASE WHEN i > 1 THEN {NEAR} END AS near, sqrt((yl + yr) / (wl + wr) * (1 - (yl + yr) / (wl + wr)) * (1 / wl + 1 / wr)) AS se FROM q1),
q3 AS (SELECT *, near / max(near) OVER (PARTITION BY l_returnflag) AS e FROM q2),
q4 AS (SELECT *, coalesce(0.15 * e * greatest(0, yr / wr - yl / wl - {CDI_Z} * se) - (1 - e) * {CDI_Z} * se, 0) AS bound FROM q3)"""


@query("cdi_bounds", with_(VIEW, ties_sql(), CDI_SQL) + "SELECT l_returnflag, x, round(bound, 6) + 0.0 AS bound FROM q4")
def q_cdi_bounds(spark, sf):
    out = CDI.bounds(tie_table(scored_lineitem(spark, sf), by=FLAG), FLAG)
    return rounded(out.select("l_returnflag", "x", "bound"), "bound")


query("cdi_apply", with_(VIEW, ties_sql(), CDI_SQL, bounded_sql("bound").replace("FROM t)", "FROM q4)", 1)) + BOUNDED.replace("calibrated, 6", "calibrated, 4"))(fitted(lambda: CDI, 4))

query("nearly_isotonic_apply")(fitted(lambda: C.NearlyIsotonic(lam=5.0)))
query("spline_apply")(fitted(lambda: C.MonotoneSpline(alpha=0.1)))
query("regularized_apply")(fitted(lambda: C.RegularizedIsotonic(alpha=1.0, link="identity")))
query("smoothed_apply")(fitted(lambda: C.SmoothedIsotonic()))
query("smoothed_adaptive_apply")(fitted(lambda: C.SmoothedIsotonic(adaptive=True)))


@query("spline_auto")
def q_spline_auto(spark, sf):
    model = C.MonotoneSpline(n_knots=10, alpha="auto").fit(scored_lineitem(spark, sf), weight="weight", by=FLAG)
    return rounded(plot_data.map_on_grid(model, 21).join(model.params["chosen"], FLAG), "y")


@query("relaxed_auto")
def q_relaxed_auto(spark, sf):
    model = C.RelaxedIsotonic(epsilon="auto", min_slope="auto").fit(scored_lineitem(spark, sf), weight="weight", by=FLAG)
    return rounded(model.knots.join(model.params["chosen"], FLAG), "y")


@query("platt")
def q_platt(spark, sf):
    a, b = C.platt(scored_lineitem(spark, sf))
    return spark.range(1).select(F.lit(round(a, 6)).alias("slope"), F.lit(round(b, 6)).alias("intercept"))


@query("out_of_fold")
def q_oof(spark, sf):
    df = scored_lineitem(spark, sf)
    out = selection.cross_val_calibrate(df, C.CentredIsotonic(), ["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(metrics.basic_metrics(out, "calibrated", by=FLAG), *BASIC)


# Plateaus.

PLATEAU = "z AS (SELECT l_returnflag, score AS x, round(score * 4) / 4 AS z, label FROM v), i AS (SELECT *, sum(CASE WHEN z <> p THEN 1 ELSE 0 END) OVER (PARTITION BY l_returnflag ORDER BY x, z ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(z) OVER (PARTITION BY l_returnflag ORDER BY x, z) AS p FROM z)), g AS (SELECT l_returnflag, run, min(x) AS x_lo, max(x) AS x_hi, any_value(z) AS value, count(*) AS width, var_pop(label) AS label_var FROM i GROUP BY l_returnflag, run)"


def _plateau_rows(spark, sf):
    return scored_lineitem(spark, sf).withColumn("calibrated", F.round(F.col("score") * 4) / 4)


@query("plateaus", with_(VIEW, PLATEAU) + "SELECT l_returnflag, (row_number() OVER (PARTITION BY l_returnflag ORDER BY run) - 1)::INT AS plateau_id, x_lo, x_hi, value, width, round(label_var, 6) AS label_var, CASE WHEN width < 5 THEN 'very_sparse' WHEN width < 10 THEN 'sparse' ELSE 'adequate' END AS density FROM g WHERE width >= 2")
def q_plateaus(spark, sf):
    return rounded(diagnostics.plateaus(_plateau_rows(spark, sf), label="label", by=FLAG), "label_var")


@query("plateau_quality", with_(VIEW, PLATEAU, "c AS (SELECT l_returnflag, count(*) * 0.1 AS tenth FROM v GROUP BY l_returnflag)") + "SELECT l_returnflag, round(avg(exp(-label_var - abs(width - tenth) / tenth)), 6) AS plateau_quality FROM g JOIN c USING (l_returnflag) WHERE width >= 2 GROUP BY l_returnflag")
def q_plateau_quality(spark, sf):
    return rounded(diagnostics.plateau_quality(_plateau_rows(spark, sf), by=FLAG), "plateau_quality")


@query("diversity_learning_curve")
def q_learning(spark, sf):
    return rounded(diagnostics.learning_curve(scored_lineitem(spark, sf), ["l_orderkey", "l_linenumber", "l_partkey"], [100, 400, 1600], 5), "diversity", "diversity_sd")


# Multiclass.

CLASSES = f"cp AS ({CLASS_PROBS}), pr AS (SELECT l_returnflag, label, p0::DOUBLE AS p0, p1::DOUBLE AS p1, round(1 - p0::DOUBLE - p1::DOUBLE, 2) AS p2 FROM cp)"
REST = "v AS (SELECT 0 AS l_returnflag, p0 AS score, (label = 0)::INT::DOUBLE AS label FROM pr UNION ALL SELECT 1, p1, (label = 1)::INT::DOUBLE FROM pr UNION ALL SELECT 2, p2, (label = 2)::INT::DOUBLE FROM pr)"


@query("classwise_decomposition", with_(CLASSES, REST, ties_sql(), fit_sql(), BASE, BRIER) + SPLIT.replace("SELECT l_returnflag", "SELECT l_returnflag AS class", 1))
def q_classwise(spark, sf):
    return rounded(multiclass.classwise_decomposition(class_probabilities(spark, sf)), *PARTS)


@query("classwise_reliability", with_(CLASSES, REST, ties_sql(), fit_sql()) + "SELECT l_returnflag AS class, x, round(z, 6) AS cep, round(w, 6) AS weight FROM f")
def q_class_curves(spark, sf):
    return rounded(multiclass.classwise_reliability(class_probabilities(spark, sf)), "cep", "weight")


DEBIASED = f"SELECT l_returnflag, sqrt(greatest({TERMS}, 0)) AS ece FROM g GROUP BY l_returnflag"


@query("classwise_ece", with_(CLASSES, REST, ties_sql(), mass_sql("15")) + f"SELECT round(avg(ece), 6) AS classwise_ece FROM ({DEBIASED})")
def q_classwise_ece(spark, sf):
    return rounded(multiclass.classwise_ece(class_probabilities(spark, sf)), "classwise_ece")


TOP = "v AS (SELECT l_returnflag, greatest(p0, p1, p2) AS score, (label = list_position([p0, p1, p2], greatest(p0, p1, p2)) - 1)::INT::DOUBLE AS label FROM pr)"


@query("top_label_ece", with_(CLASSES, TOP, ties_sql(), mass_sql("15")) + f"SELECT l_returnflag, round(ece, 6) AS top_label_ece FROM ({DEBIASED})")
def q_top_label(spark, sf):
    return rounded(multiclass.top_label_ece(class_probabilities(spark, sf), by=FLAG), "top_label_ece")


@query("miscalibration_profile", with_(CLASSES, REST, ties_sql(), fit_sql(), BASE, BRIER) + "SELECT round(mean_mcb, 6) AS mean_mcb, round(spread, 6) AS spread, CASE WHEN mean_mcb <= 1e-6 THEN 'none' WHEN spread <= 0.25 THEN 'global' ELSE 'per class' END AS reading, worst FROM (SELECT string_agg(l_returnflag::VARCHAR, ',' ORDER BY sx - sc DESC) AS worst, avg(sx - sc) AS mean_mcb, stddev_pop(sx - sc) / avg(sx - sc) AS spread FROM d)")
def q_profile(spark, sf):
    out = multiclass.miscalibration_profile(class_probabilities(spark, sf))
    return rounded(out.withColumn("worst", F.array_join(F.col("worst").cast("array<string>"), ",")), "mean_mcb", "spread")


@query("temperature_apply", with_(CLASSES, f"q AS (SELECT *, [exp(ln(greatest(p0, {EPS})) / 1.5), exp(ln(greatest(p1, {EPS})) / 1.5), exp(ln(greatest(p2, {EPS})) / 1.5)] AS e FROM pr)") + "SELECT l_returnflag, " + ", ".join(f"round(avg(e[{i + 1}] / list_sum(e)), 6) AS c{i}" for i in range(3)) + " FROM q GROUP BY l_returnflag")
def q_temperature(spark, sf):
    out = C.apply_temperature(class_probabilities(spark, sf), 1.5)
    return rounded(out.groupBy("l_returnflag").agg(*(F.avg(F.col("calibrated")[i]).alias(f"c{i}") for i in range(3))), "c0", "c1", "c2")


@query("temperature_fit")
def q_temperature_fit(spark, sf):
    return spark.range(1).select(F.lit(round(C.TemperatureScaler().fit(class_probabilities(spark, sf)), 5)).alias("temperature"))


# Reports, resampling, benchmark grid, plots, streams.


@query("calibration_report")
def q_report(spark, sf):
    out = diagnostics.calibration_report(scored_lineitem(spark, sf), by=FLAG)
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


@query("bootstrap_ci")
def q_bootstrap(spark, sf):
    return rounded(resample.bootstrap_ci(scored_lineitem(spark, sf), ["brier", "debiased_ece", "mcb"], n_resamples=200), "estimate", "lower", "upper", "bias")


@query("consistency_bands")
def q_bands(spark, sf):
    return rounded(resample.resampling_bands(scored_lineitem(spark, sf), n_resamples=200), "lower", "upper")


CELLS = "c AS (SELECT l_returnflag AS dataset, l_linestatus AS model, (l_orderkey % 10)::INT AS seed, 'raw' AS method, (score - label) * (score - label) AS s FROM v UNION ALL SELECT l_returnflag, l_linestatus, (l_orderkey % 10)::INT, 'truth', (p_true - label) * (p_true - label) FROM v), g AS (SELECT dataset, model, seed, method, avg(s) AS brier FROM c GROUP BY ALL)"


def _method_cells(spark, sf):
    v = scored_lineitem(spark, sf, 6)
    both = F.explode(F.array(F.struct(F.lit("raw").alias("method"), F.col("score").alias("p")), F.struct(F.lit("truth").alias("method"), F.col("p_true").alias("p"))))
    rows = v.select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model"), (F.col("l_orderkey") % 10).cast("int").alias("seed"), "label", both.alias("m"))
    return rows.groupBy("dataset", "model", "seed", F.col("m.method").alias("method")).agg(F.avg(S.brier(F.col("m.p"), F.col("label"))).alias("brier"))


@query("bench_summary", with_(VIEW6, CELLS) + "SELECT dataset, model, method, count(DISTINCT seed) AS n_seeds, round(avg(brier), 6) AS brier FROM g GROUP BY dataset, model, method")
def q_summary(spark, sf):
    return bench_grid.summarise(_method_cells(spark, sf), ["brier"])


@query("bench_paired_delta", with_(VIEW6, CELLS) + "SELECT m.dataset, m.model, m.seed, m.method, round(b.brier - m.brier, 6) + 0.0 AS delta FROM g m JOIN g b ON b.dataset = m.dataset AND b.model = m.model AND b.seed = m.seed WHERE b.method = 'raw' AND m.method <> 'raw'")
def q_paired(spark, sf):
    return rounded(bench_grid.against_baseline(_method_cells(spark, sf), "raw"), "delta")


@query("bench_incomplete", with_(VIEW6, CELLS) + "SELECT dataset, model, method, count(DISTINCT seed) AS n_seeds FROM g GROUP BY dataset, model, method HAVING count(DISTINCT seed) < 11 ORDER BY n_seeds, dataset, model, method LIMIT 5")
def q_incomplete(spark, sf):
    return bench_grid.incomplete(_method_cells(spark, sf), 11)


@query("bench_paired_intervals")
def q_intervals(spark, sf):
    return rounded(bench_grid.paired_intervals(bench_grid.against_baseline(_method_cells(spark, sf), "raw")), "delta", "lower", "upper")


HALVES = "v2 AS (SELECT concat_ws('|', l_returnflag, l_linestatus, seed) AS l_returnflag, l_returnflag AS dataset, l_linestatus AS model, seed::INT AS seed, score, label, p_true, (l_orderkey + seed) % 2 = 1 AS test FROM v CROSS JOIN (SELECT unnest([0, 1]) AS seed) s), vf AS (SELECT * FROM v2 WHERE NOT test)"
HELD = """kk AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY l_returnflag ORDER BY x)), lo AS (SELECT l_returnflag, arg_min(y, x) AS y0 FROM k GROUP BY l_returnflag),
hh AS (SELECT h.*, CASE WHEN kk.x IS NULL THEN lo.y0 WHEN kk.x1 IS NULL THEN kk.y ELSE kk.y + (h.score - kk.x) / (kk.x1 - kk.x) * (kk.y1 - kk.y) END AS p FROM (SELECT * FROM v2 WHERE test) h ASOF LEFT JOIN kk ON h.l_returnflag = kk.l_returnflag AND h.score >= kk.x JOIN lo ON lo.l_returnflag = h.l_returnflag),
nf AS (SELECT l_returnflag, count(*) AS n_fit FROM vf GROUP BY l_returnflag),
mm AS (SELECT *, 'isotonic' AS method FROM hh UNION ALL SELECT * REPLACE (score AS p), 'raw' FROM hh)"""


@query("bench_cells", with_(VIEW, HALVES, ties_sql(view="vf"), fit_sql(), RUNS, STEPS, HELD) + f"SELECT dataset, model, seed, method, n_fit, n_test, {r6('base_rate', 'brier', 'true_error')} FROM (SELECT dataset, model, seed, method, n_fit, count(*) AS n_test, avg(label) AS base_rate, avg((p - label) * (p - label)) AS brier, avg(abs(p - p_true)) AS true_error FROM mm JOIN nf USING (l_returnflag) GROUP BY ALL)")
def q_cells(spark, sf):
    """Isotonic maps and raw scores on both halves of every segment, as cells of two seeds."""
    v = scored_lineitem(spark, sf).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = v.select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model"), "seed", "score", "label", F.col("p_true").cast("double").alias("p_true"), ((F.col("l_orderkey") + F.col("seed")) % 2 == 1).alias("test"))
    out = bench_run.run_cells(rows, {"raw": None, "isotonic": C.Isotonic()}, measures=["brier", "true_error"], truth="p_true")
    return rounded(out.drop("seconds", "n_distinct_input"), "base_rate", "brier", "true_error")


@query("score_histogram", with_(VIEW6) + f"SELECT len(list_filter([{', '.join(f'{e!r}e0' for e in S.edges(30)[1:-1])}], lambda e: score >= e))::INT AS bin, sum(weight) AS mass FROM v GROUP BY bin")
def q_histogram(spark, sf):
    return plot_data.score_histogram(scored_lineitem(spark, sf, 6), weight="weight")


@query("resolution_frontier", with_(VIEW) + "SELECT l_returnflag, count(DISTINCT score) AS n_distinct, round(avg((score - label) * (score - label)), 6) AS brier FROM v GROUP BY l_returnflag")
def q_frontier(spark, sf):
    return rounded(plot_data.resolution_frontier(scored_lineitem(spark, sf), FLAG), "brier")


@query("docs_quality_errors", f"WITH v AS (SELECT 0 AS l_returnflag, * FROM ({SCORED_DOCS})), {UBINS} SELECT {r6('ece', 'mce')} FROM (SELECT sum(n * abs(conf - acc)) / sum(n) AS ece, max(abs(conf - acc)) AS mce FROM b)")
def q_docs(spark, sf):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)
    return rounded(metrics.uniform_errors(spark.sql(SCORED_DOCS)), "ece", "mce")


EVENTS = "SELECT ts, least(1.0, value / 100) AS score, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS label FROM events"


# Sums of scores are whole multiples of 1e-4, so millionths are rounded in whole numbers, halves up.
@query("event_windows", f"WITH v AS ({EVENTS}), b AS (SELECT date_trunc('day', ts) AS w, {UBIN} AS bin, count(*) AS n, sum(score) AS s, sum(label) AS l FROM v GROUP BY ALL), g AS (SELECT w, round(sum(abs(s - l)) * 1e4)::BIGINT AS gap, sum(n)::BIGINT AS n FROM b GROUP BY w) SELECT strftime(w, '%Y-%m-%d') AS day, (200 * gap + n) // (2 * n) AS ece_millionths, n FROM g")
def q_events(spark, sf):
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
    v = spark.sql(EVENTS).select("ts", F.col("score").cast("double").alias("score"), F.col("label").cast("double").alias("label"))
    gap = F.round(F.col("ece") * F.col("n") * 1e4).cast("long")
    out = window_errors(windowed_bins(v)).withColumn("gap", gap)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.expr("(200 * gap + n) div (2 * n)").alias("ece_millionths"), "n")


def _designs_sql() -> str:
    one = "SELECT '{d}' AS l_returnflag, {s} AS score, CASE WHEN u3 < {p} THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM u"
    parts = []
    for d, (mean, deviation, slope, shift) in DESIGNS.items():
        z = f"(sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) * {deviation} + {mean})"
        score = f"1 / (1 + exp(-({z} * {slope} + {shift})))"
        parts.append(one.format(d=d, s=f"round({score}, 2)" if d == "heavy_tie" else score, p=f"1 / (1 + exp(-{z}))"))
    parts.append(one.format(d="nonmonotone", s="u1", p="least(greatest(u1 + 0.25 * sin(2 * pi() * u1), 0.01), 0.99)"))
    return " UNION ALL ".join(parts)


@query("synthetic_designs", f"WITH u AS ({UNIFORMS}), v AS ({_designs_sql()}), q AS (SELECT *, least(greatest(score, {EPS}), 1 - {EPS}) AS c FROM v) SELECT l_returnflag AS design, n, {r6(*BASIC)} FROM (SELECT l_returnflag, count(*) AS n, avg(label) AS base_rate, avg(score) AS mean_prediction, avg(score) - avg(label) AS bias, abs(avg(score) - avg(label)) AS mean_calibration_error, avg((score - label) * (score - label)) AS brier, avg(-(label * ln(c) + (1 - label) * ln(1 - c))) AS log_loss FROM q GROUP BY l_returnflag)")
def q_synthetic(spark, sf):
    """A draw of every design for each row of lineitem."""
    rows = reduce(DataFrame.unionByName, (synthetic(spark, d, uniforms=lineitem_uniforms(spark, sf)).withColumn("design", F.lit(d)) for d in [*DESIGNS, "nonmonotone"]))
    return rounded(metrics.basic_metrics(rows, by=["design"]), *BASIC)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier decomposition by return flag."""
    return q_brier(spark, sf_dir)

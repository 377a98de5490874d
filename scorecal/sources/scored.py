"""Scored views of the test tables and synthetic designs with known truth."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecal.functions.scores import expit

#: The same text runs in Spark and in DuckDB; {dp} is the number of decimals.
SCORED_LINEITEM = """
select l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, p_true,
       round(1/(1+exp(-1.8*ln(p_true/(1-p_true)))), {dp}) as score,
       cast(case when u < p_true then 1 else 0 end as double) as label,
       cast(l_linenumber as double) as weight
from (select *, (l_extendedprice-900.0)/104200.0*0.98+0.01 as p_true,
             ((l_orderkey*2654435761 + l_linenumber*40503 + l_partkey*97) % 1000003)/1000003.0 as u
      from lineitem) q
"""


def scored_lineitem(spark: SparkSession, sf_dir: str, dp: int = 9) -> DataFrame:
    """Overconfident scores of lineitem rows; few columns reach the scan."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return spark.sql(SCORED_LINEITEM.format(dp=dp))


SCORED_DOCS = """
select d.doc_id, least(1.0, n_chars/20000.0) as score, cast(quality as double) as label
from documents d join labels l on d.doc_id = l.doc_id
"""

CLASS_PROBS = """
select l_orderkey, l_linenumber, l_partkey, l_returnflag, cast(l_partkey % 3 as int) as label,
       round((1 + (l_orderkey % 7) * 1.0) / (11 + (l_orderkey % 7) + (l_linenumber % 4) + (l_partkey % 5)), 2) as p0,
       round((4 + (l_linenumber % 4) * 1.0) / (11 + (l_orderkey % 7) + (l_linenumber % 4) + (l_partkey % 5)), 2) as p1
from lineitem
"""


def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class vectors of lineitem rows."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    df = spark.sql(CLASS_PROBS)
    p0, p1 = F.col("p0").cast("double"), F.col("p1").cast("double")
    return df.select("l_returnflag", "label", F.array(p0, p1, F.round(1 - p0 - p1, 2)).alias("probabilities"))


# Fixed values: (mean and deviation of the log-odds, slope, shift) of each synthetic design.
DESIGNS = {
    "overconfident": (0.0, 2.0, 1.8, 0.0),
    "underconfident": (0.0, 2.0, 0.6, 0.0),
    "prior_shift": (0.0, 2.0, 1.0, 0.8),
    "heavy_tie": (0.0, 2.0, 1.8, 0.0),
    "rare_event": (-4.6, 1.5, 1.6, 0.0),
    "small_n": (0.0, 2.0, 1.8, 0.0),
}


#: Three numbers in (0, 1) for each row of lineitem, the same in Spark and in DuckDB.
UNIFORMS = "SELECT " + ", ".join(f"((l_orderkey * {a} + l_linenumber * {b} + l_partkey * {c}) % 1000003 + 0.5e0) / 1000003.0e0 AS u{i}" for i, (a, b, c) in enumerate([(2654435761, 40503, 97), (1597334677, 50021, 193), (3812015801, 60013, 389)], 1)) + " FROM lineitem"


def lineitem_uniforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return spark.sql(UNIFORMS)


def synthetic(spark: SparkSession, design: str, n: int = 4000, seed: int = 0, uniforms: DataFrame | None = None) -> DataFrame:
    """(score, p_true, label) of a named design, a row for each row of ``uniforms`` (u1, u2, u3), or n seeded ones.

    Log-odds are normal by the Box-Muller formula of u1 and u2; labels compare u3.
    """
    if uniforms is None:
        n = min(n, 300) if design == "small_n" else n
        uniforms = spark.range(n).select("id", *(F.rand(seed + i).alias(f"u{i}") for i in (1, 2, 3)))
    u1, u2 = F.greatest("u1", F.lit(1e-300)), F.col("u2")
    pi = 3.141592653589793
    if design == "nonmonotone":
        rows = uniforms.withColumn("score", u1).withColumn("p_true", F.least(F.greatest(u1 + 0.25 * F.sin(2 * pi * u1), F.lit(0.01)), F.lit(0.99)))
    else:
        mean, deviation, slope, shift = DESIGNS[design]
        rows = uniforms.withColumn("_z", F.sqrt(-2 * F.ln(u1)) * F.cos(2 * pi * u2) * deviation + mean)
        score = expit(F.col("_z") * slope + shift)
        rows = rows.withColumn("score", F.round(score, 2) if design == "heavy_tie" else score).withColumn("p_true", expit(F.col("_z"))).drop("_z")
    return rows.withColumn("label", (F.col("u3") < F.col("p_true")).cast("double")).drop("u1", "u2", "u3")


RESULT_KEYS = "dataset string, model string, seed int, method string"


def read_results(spark: SparkSession, path: str, measures: list[str]) -> DataFrame:
    """Benchmark rows from CSV; a cell that is no number becomes NaN."""
    keys = [x.split()[0] for x in RESULT_KEYS.split(", ")]
    schema = RESULT_KEYS + ", " + ", ".join(f"{m} string" for m in measures)
    raw = spark.read.csv(path, header=True, schema=schema)
    return raw.select(*keys, *(F.coalesce(F.expr(f"try_cast(`{m}` as double)"), F.lit(float("nan"))).alias(m) for m in measures))


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_fixture(path: str) -> dict:
    with open(path) as f:
        return json.load(f)

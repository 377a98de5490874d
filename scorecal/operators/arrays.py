"""Small relational readings of array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.operators.ties import By, validated


def clip_to_range(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def value_groups(df: DataFrame, value: str, tolerance: float = 1e-10, by: By = ()) -> DataFrame:
    """(by, group, value, n): distinct values chained while neighbours differ by ``tolerance`` at most."""
    cells = df.groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("value")
    new = F.coalesce((F.col("value") - F.lag("value").over(w) > tolerance).cast("int"), F.lit(0))
    groups = cells.withColumn("group", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy(*by, "group").agg(F.min("value").alias("value"), F.sum("n").alias("n"))


__all__ = ["clip_to_range", "validated", "value_groups"]

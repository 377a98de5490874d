"""Segments: the columns ``by`` by which every result is split, null being a value like others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

By = Sequence[str]


def join_by(left: DataFrame, right: DataFrame, by: By, how: str = "inner") -> DataFrame:
    """Join on segment columns, whose nulls are equal; without any, every row with every row.

    The segment columns are the left side's.
    """
    named = right.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(c for c in right.columns if c not in by))
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)) if by else None
    out = left.join(named, on, how) if by else left.crossJoin(named) if how == "inner" else left.join(named, F.lit(True), how)
    return out.drop(*(f"_by_{c}" for c in by))


def ordered(by: By, *order: Column | str):
    return Window.partitionBy(*by).orderBy(*(order or ("x",)))

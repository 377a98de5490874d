"""Column expressions of scores, bins and links; they stay in generated code."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = sys.float_info.epsilon


def clipped(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def log_score(p: Column, y: Column, eps: float = EPS) -> Column:
    """Minus the log likelihood; linear in y."""
    q = clipped(p, eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


SCORES = {"brier": brier, "log": log_score}


def logit(p: Column, eps: float = EPS) -> Column:
    q = clipped(p, eps)
    return F.ln(q / (1 - q))


def expit(t: Column) -> Column:
    return 1 / (1 + F.exp(-t))


def softplus(t: Column) -> Column:
    """log(1 + exp(t)) without overflow."""
    return F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))


def edges(n_bins: int) -> list[float]:
    """Equal-width edges of [0, 1]; the last is exactly 1."""
    return [k * (1.0 / n_bins) for k in range(n_bins)] + [1.0]


def bin_index(p: Column, at: list[Column]) -> Column:
    """Index of the bin that holds p among ascending edges, clipped to the outer bins."""
    inner = [(p >= e).cast("int") for e in at[1:-1]]
    return reduce(lambda a, b: a + b, inner, F.lit(0))


def uniform_bin(p: Column, n_bins: int) -> Column:
    return bin_index(p, [F.lit(e) for e in edges(n_bins)])


def triangle(distance: Column, width: float) -> Column:
    """Triangular kernel; without width, an exact match."""
    if width <= 0:
        return (distance == 0).cast("double")
    return F.greatest(F.lit(0.0), 1 - F.abs(distance) / width)

"""Isotonic projection of tie tables, without a task that needs a segment's scores or its blocks.

Stretches of the score axis are pooled on their own, which keeps every block
boundary that the whole could have.  Where a segment is left with few blocks, one task pools them.
Otherwise groups of neighbouring stretches are pooled on their own, and in each
round the groups end amid those of the round before, until values rise over the
ends of groups as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.functions import kernels
from scorecal.operators.curves import apply_step
from scorecal.operators.keep import kept
from scorecal.operators.ranges import Stretches, running
from scorecal.operators.ties import By, join_by

MEET = 1 << 14  # blocks of a segment that may meet in one task
TOGETHER = 8  # stretches of the table, all segments together, in a task that sorts them
EVENLY = 4  # stretches of most blocks that a group can hold, so that its ends move


def _typed(df: DataFrame, by: By) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def pav_fit(ties: DataFrame, by: By = (), target: str = "y", increasing: bool = True) -> DataFrame:
    """The tie table with z, the weighted isotonic projection of ``target`` along x.

    Scores of zero weight take part as points without weight.
    """
    ties = kept(ties)
    starts = pav_blocks(ties, by, target, increasing).select(*by, F.col("x_lo").alias("x"), F.col("value").alias("y"))
    return apply_step(ties, kept(starts), "x", "z", by)


SUMS = ["n", "w", "wy", "_wv", "_wx", "_x", "_k"]
BLOCKS = "x_lo double, x_hi double, value double, n long, w double, wy double"
LOCAL = BLOCKS + ", _wv double, _wx double, _x double, _k long"


def _merged(rows: dict[str, np.ndarray], z: np.ndarray, edges: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Neighbouring rows of equal z as one, never across ``edges``; and each block's first row."""
    new = np.concatenate([[True], z[1:] != z[:-1]])
    new[edges] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(z)) - 1
    return {"x_lo": rows["x_lo"][first], "x_hi": rows["x_hi"][last], "value": z[first]} | {c: np.add.reduceat(rows[c], first) for c in SUMS}, first


def _pooled(pdf: pd.DataFrame | dict[str, np.ndarray], edges: np.ndarray, sign: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    rows = {c: np.asarray(pdf[c]) for c in ("x_lo", "x_hi", "value", *SUMS)}
    parts = zip(np.split(sign * rows["value"], edges[1:]), np.split(rows["w"], edges[1:]), strict=True)
    return _merged(rows, sign * np.concatenate([kernels.pava(v, w) for v, w in parts]), edges)


def _local_blocks(ties: DataFrame, by: By, target: str, sign: float, stretches: Stretches, weighty: bool) -> DataFrame:
    """Blocks of each stretch, or of parts of it, with _part."""
    keys, columns = [*by, "_part"], [c.split()[0] for c in LOCAL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by segment, stretch and score; each batch is pooled within segments and stretches."""
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in batch.columns[: len(keys)]])
            edges = np.concatenate([[0], 1 + np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0))])
            x, v, n, w, wy = (c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys) :])
            rows = {"x_lo": x, "x_hi": x, "value": v, "n": n, "w": w, "wy": wy, "_wv": w * v, "_wx": x * w, "_x": x, "_k": np.ones(len(x), np.int64)}
            found, first = _pooled(rows, edges, sign)
            yield pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(first)).columns, *(pa.array(found[c]) for c in columns)], [*keys, *columns])

    x, w, v = F.col("x"), F.col("w"), F.col(target)
    wy = F.col("wy") if "wy" in ties.columns else w * v
    rows = stretches.of(ties.where("w > 0") if weighty else ties, "x").select(*keys, x.cast("double").alias("x"), v.cast("double").alias("value"), F.col("n").cast("long").alias("n"), w.cast("double").alias("w"), wy.cast("double").alias("wy"))
    least = -(-len(stretches) // TOGETHER)  # tasks, as the table grows
    more = [least] if least > int(ties.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return rows.repartition(*more, *keys).sortWithinPartitions(*keys, "x").mapInArrow(run, _typed(ties, by) + f"_part int, {LOCAL}")


def _in_one_task(local: DataFrame, by: By, sign: float) -> DataFrame:
    """Blocks of segments whose local blocks are few, pooled by the same kernel."""
    keys = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x_lo")
        found, first = _pooled(pdf, np.zeros(1, int), sign)
        out = pdf[keys].iloc[first].reset_index(drop=True)
        return out.assign(block=np.arange(len(first)), last=np.full(len(first), len(first) - 1), **{c: found[c] for c in found if c != "_wv"})

    return local.groupBy(*keys).applyInPandas(run, _typed(local, by) + f"block long, last long, {BLOCKS}, _wx double, _x double, _k long")


def _in_groups(local: DataFrame, by: By, sign: float, meet: int, evenly: int) -> DataFrame:
    """Blocks of segments whose local blocks are many.

    Neighbouring stretches are pooled in groups of about as many blocks, whose
    ends lie amid the groups of the round before; it ends when no group's last
    value reaches the next one's first.
    """
    keys, types = list(by), _typed(local, by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, first = _pooled(pdf.sort_values("x_lo"), np.zeros(1, int), sign)
        taken = pdf.sort_values("x_lo")[[*keys, "_part", "_group"]].iloc[first].reset_index(drop=True)
        mean = np.divide(found["_wv"], found["w"], out=found["value"].copy(), where=(found["_k"] > 1) & (found["w"] > 0))
        return taken.assign(_at=np.arange(len(first)), **(found | {"value": mean}))

    own, over = [*by, "_group"], Window.partitionBy(*by).orderBy("_part")  # a segment's stretches
    groups = Window.partitionBy(*by).orderBy("_group")  # a segment's groups
    half, live = 0, local
    while True:
        parts = live.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
        size = max(meet, evenly * (parts.agg(F.max("_c")).first()[0] or 0), 1)
        before = F.coalesce(F.sum("_c").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        dealt = parts.select(*by, "_part", F.floor((before + half) / size).alias("_group"))
        rows = join_by(live.select(*by, "_part", *(c.split()[0] for c in LOCAL.split(", "))), dealt, [*by, "_part"])
        pooled = kept(rows.groupBy(*own).applyInPandas(run, f"{types}_part int, _group long, _at long, {LOCAL}"))
        value = F.lit(sign) * F.col("value")
        ends = pooled.groupBy(*own).agg(F.min_by(value, "_at").alias("_first"), F.max_by(value, "_at").alias("_last"), F.count("*").alias("_c"))
        ends = kept(ends.select(*own, "_c", (F.col("_last") >= F.lead("_first").over(groups)).alias("_falls")))
        if ends.where("_falls").isEmpty():
            break
        half, live = (0 if half else size // 2), pooled.drop("_group", "_at")
    starts = ends.select(*own, F.coalesce(F.sum("_c").over(groups.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), (F.sum("_c").over(Window.partitionBy(*by)) - 1).alias("last"))
    return join_by(pooled, starts, own).withColumn("block", F.col("_start") + F.col("_at"))


def pav_blocks(ties: DataFrame, by: By = (), target: str = "y", increasing: bool = True, meet: int = MEET, stretches: Stretches | None = None, evenly: int = EVENLY, weighty: bool = False) -> DataFrame:
    """Runs of equal fitted value: (by, block, last, x_lo, x_hi, value, n, w, wy, centre, scores); last is the segment's last block, ``scores`` the number of distinct ones.

    ``centre`` is the mean score by weight, or of the distinct scores where a
    block has no weight.  Up to ``meet`` blocks of a segment are pooled in one
    task, more in groups of as many, or of ``evenly`` stretches.  ``weighty`` leaves out scores without weight.
    """
    sign = 1.0 if increasing else -1.0
    ties = kept(ties)
    found = stretches or Stretches(ties.select("x"))
    local = kept(_local_blocks(ties, by, target, sign, found, weighty))
    most = local.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    blocks = _in_one_task(local, by, sign) if most <= meet else _in_groups(local, by, sign, meet, evenly)
    centre = F.when(F.col("w") > 0, F.try_divide("_wx", "w")).otherwise(F.col("_x") / F.col("_k"))
    return blocks.withColumn("centre", centre).select(*by, "block", "last", "x_lo", "x_hi", "value", "n", "w", "wy", "centre", F.col("_k").alias("scores"))


def centred_knots(runs: DataFrame, by: By = ()) -> DataFrame:
    """(by, x, y) from blocks: each at its weighted centre, the outer ones at their inner ends."""
    inner = F.when(F.col("block") == 0, F.col("x_hi")).when(F.col("block") == F.col("last"), F.col("x_lo"))
    return runs.select(*by, F.when(F.col("last") == 0, F.col("centre")).otherwise(F.coalesce(inner, "centre")).alias("x"), F.col("value").alias("y"))


def step_knots(runs: DataFrame, by: By = ()) -> DataFrame:
    """(by, x, y) from blocks: both ends of each, so that lines between them run across the gaps."""
    ends = F.explode(F.array_distinct(F.array("x_lo", "x_hi")))
    return runs.select(*by, ends.alias("x"), F.col("value").alias("y"))


def bounded_fit(ties: DataFrame, least_step: float | str, by: By = ()) -> DataFrame:
    """As ``pav_fit``, with neighbours rising by ``least_step`` (a number or a column) or more."""
    step = F.lit(float(least_step)) if not isinstance(least_step, str) else F.col(least_step)
    ties = kept(ties).withColumn("_step", step)
    first = kept(ties.groupBy(*by).agg(F.min_by("_step", "x").alias("_first")))  # small when written, so that it is sent round
    shifted = join_by(running(ties, {"_shift": F.col("_step")}, by).drop("_part"), first, by).withColumn("_shift", F.col("_shift") - F.col("_first"))
    moved = kept(shifted.withColumn("_moved", F.col("y") - F.col("_shift")))
    return pav_fit(moved, by, "_moved").withColumn("z", F.col("z") + F.col("_shift")).drop("_shift", "_moved", "_step", "_first")


def with_running_max(df: DataFrame, value: str, by: By = (), order: str = "x") -> DataFrame:
    """df with ``value`` replaced by its running maximum along ``order``."""
    out = running(kept(df), by=by, order=order, tops={"_top": F.col(value)})
    return out.withColumn(value, F.col("_top")).select(*df.columns)

"""Distributed union-find over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.llm.heap import frugal
from scorecal.llm.scratch import Scratch

EDGE = "v long, m long"


def _forest(limit: int):
    """Replace a partition's edges by stars (v -> smallest node met), flushed at ``limit`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (p := parent.get(root, root)) != root:
                root = p
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        def stars() -> pa.RecordBatch:
            v = [x for x in parent if find(x) != x]
            return pa.record_batch([pa.array(v, pa.int64()), pa.array([parent[x] for x in v], pa.int64())], ["v", "m"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    lo, hi = (a, b) if a < b else (b, a)
                    parent[hi] = lo
                    parent.setdefault(lo, lo)
            if len(parent) > limit:
                yield stars()
                parent.clear()
        yield stars()

    return run


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", edges_per_task: int = 500_000) -> DataFrame:
    """(v, m) for every node but the smallest of its component: m is that smallest node.

    ``edges`` has two long columns; a node without edges has no row.  Tasks
    first union ``edges_per_task`` edges each, so their number follows the
    edges.  Where there are several, each round links every node's larger
    neighbours to its smallest neighbour and its smaller ones likewise, until
    all edges form stars.  Hubs are handled by partial aggregation and a join,
    so no task needs a whole neighbourhood.
    """
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    given = scratch.save(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v > m"), f"{name}_edges")
    tasks = max(1, -(-given.count() // edges_per_task))
    limit, step = 2 * edges_per_task, 0
    now = scratch.save(given.coalesce(tasks).mapInArrow(frugal(_forest(limit)), EDGE), f"{name}{step}")
    scratch.drop(f"{name}_edges")
    if tasks == 1:
        return now  # one union-find has seen all edges
    while _unfinished(now):
        both = now.unionByName(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("least")).select(F.col("v").alias("u"), F.least("u", "least").alias("least"))
        large = both.join(least, both.v == least.u).where("m > u").select(F.col("m").alias("v"), F.col("least").alias("m")).where("v > m").distinct()
        large = large.mapInArrow(frugal(_forest(limit)), EDGE)
        root = large.groupBy("v").agg(F.min("m").alias("root"))
        small = large.join(root, "v")
        small = small.select("v", F.col("root").alias("m")).unionByName(small.select(F.col("m").alias("v"), F.col("root").alias("m")))
        step += 1
        now = scratch.save(small.where("v > m").distinct().mapInArrow(frugal(_forest(limit)), EDGE).distinct(), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
    return now


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two targets, or a target is itself linked on."""
    once = edges.groupBy("v").agg(F.count("*").alias("n"))
    linked = edges.select(F.col("m").alias("v")).distinct().join(edges.select("v").distinct(), "v", "left_semi")
    return not (once.where("n > 1").select("v").unionByName(linked).isEmpty())



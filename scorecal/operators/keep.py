"""Results that are used again, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_FOLDER = f"kept-{uuid.uuid4().hex}"  # of this driver


def _root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a local session uses ``/tmp/checkpoints``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{(found or '/tmp/checkpoints').rstrip('/')}/{_FOLDER}"


def _clear(spark: SparkSession, root: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(root)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


_cleared: set[str] = set()
_passing: list[list[str]] = []


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Within it, a written table's shuffle files go as soon as it is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Within it, tables are kept until its end only, unless they are ``lasting``."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            _clear(spark, path)


def kept(df: DataFrame, lasting: bool = False) -> DataFrame:
    """df computed once and written as Parquet, which cuts the lineage and tells Spark its size.

    What has been written already is returned as it is.  The files go when the
    application ends, or at the end of ``passing``.
    """
    if getattr(df, "_scorecal_kept", False):
        return df
    spark = df.sparkSession
    root = _root(spark)
    if root not in _cleared:
        _cleared.add(root)
        atexit.register(_clear, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    with without_leftovers(spark):
        df.write.parquet(path)
    if _passing and not lasting:
        _passing[-1].append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scorecal_kept = True
    return written

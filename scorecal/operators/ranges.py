"""Order without one task for all rows: stretches of an axis, sums over them, and places in a sort order."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.operators.keep import kept
from scorecal.operators.segments import By, join_by

STRETCH = 1 << 16  # rows of a stretch, about
MOST = 4096  # stretches
PLACE_BITS = 33  # of monotonically_increasing_id, which keeps the partition above them


class Stretches:
    """Cuts of an axis at approximate quantiles of the values in some tables, read once each.

    ``weights`` has how many of the quantiles fell into each stretch: 1, and
    more where a value is so frequent that a stretch cannot be cut.
    """

    def __init__(self, *values: DataFrame, rows: int = STRETCH):
        cuts = []
        for df in values:
            (name,) = df.columns
            x = F.col(name).cast("double")
            sound = df.where(x.isNotNull() & ~F.isnan(x))
            n = sound.count()
            parts = min(MOST, n // rows + 1)
            if parts > 1:
                cuts += sound.agg(F.approx_percentile(x, [k / parts for k in range(1, parts)], F.lit(10 * parts))).first()[0]
        self.cuts = sorted(set(cuts))
        held = Counter(bisect_right(self.cuts, c) for c in cuts)
        self.weights = [max(1, held[p]) for p in range(len(self.cuts) + 1)]

    @classmethod
    def of_distinct(cls, values: DataFrame, rows: int = STRETCH, each: int = 64) -> Stretches:
        """Cuts between distinct values, from those of the smallest hashes: the same however the table is laid out."""
        (name,) = values.columns
        own = cls.__new__(cls)
        parts = min(MOST, values.count() // rows + 1)
        own.cuts, own.weights = [], [1]
        if parts > 1:
            share = min(1.0, parts * each / (rows * (parts - 1)))
            some = values.where(F.pmod(F.xxhash64(F.col(name)), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
            found = sorted(float(r[0]) for r in some.collect())  # about ``each`` a stretch
            own.cuts = sorted({found[k * len(found) // parts] for k in range(1, parts)} if found else ())
            own.weights = [1] * (len(own.cuts) + 1)
        return own

    def __len__(self) -> int:
        return len(self.cuts) + 1

    def of(self, df: DataFrame, x: str, name: str = "_part") -> DataFrame:
        """df with the number of the stretch of x; NaN has the last one, null none."""
        if not self.cuts:
            return df.withColumn(name, F.lit(0))
        found = Bucketizer(splits=[float("-inf"), *self.cuts, float("inf")], inputCol="_value", outputCol="_bucket", handleInvalid="keep")
        out = found.transform(df.withColumn("_value", F.col(x).cast("double")))
        return out.withColumn(name, F.least(F.col("_bucket"), F.lit(float(len(self.cuts)))).cast("int")).drop("_value", "_bucket")


def running(df: DataFrame, sums: dict[str, Column] | None = None, by: By = (), order: str | list[str] = "x", stretches: Stretches | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """df with running sums (and maxima, of ``tops``) along ``order`` per segment, through each row, and _part.

    Two levels: within stretches of the axis, and over the stretches before,
    of which a segment has at most as many as there are.  Stretches are cut
    along the first column of ``order``, whose ties are never parted.
    """
    order = [order] if isinstance(order, str) else order
    sums, tops = sums or {}, tops or {}
    found = stretches or Stretches(df.select(order[0]))
    rows = found.of(df, order[0]).withColumns({f"_s_{k}": v for k, v in {**sums, **tops}.items()})
    own = [*by, "_part"]
    inner = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kinds = dict.fromkeys(sums, F.sum) | dict.fromkeys(tops, F.max)
    local = rows.withColumns({k: f(f"_s_{k}").over(inner) for k, f in kinds.items()}).drop(*(f"_s_{k}" for k in kinds))
    if len(found) == 1:
        return local
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*own).agg(*(f(f"_s_{k}").alias(f"_t_{k}") for k, f in kinds.items()))
    # Written, so that Spark sends it round and the sorted stretches stay where they are.
    before = kept(totals.select(*own, *(f(f"_t_{k}").over(earlier).alias(f"_before_{k}") for k, f in kinds.items())))
    out = join_by(local, before, own)
    whole = {k: F.col(k) + F.coalesce(F.col(f"_before_{k}"), F.lit(0)) for k in sums} | {k: F.greatest(k, f"_before_{k}") for k in tops}
    return out.withColumns(whole).drop(*(f"_before_{k}" for k in kinds))


def with_neighbours(df: DataFrame, value: Column, by: By = (), order: str | list[str] = "x") -> DataFrame:
    """df, which has _part, with the ``value`` of the rows before and after along ``order``, null at a segment's ends."""
    order = [order] if isinstance(order, str) else order
    own = [*by, "_part"]
    inner = Window.partitionBy(*own).orderBy(*order)
    over = Window.partitionBy(*by).orderBy("_part")  # a segment's stretches
    rows = df.withColumn("_v", value)
    place = F.struct(*order)
    ends = rows.groupBy(*own).agg(F.min_by(F.struct("_v"), place).alias("_f"), F.max_by(F.struct("_v"), place).alias("_l"))
    ends = ends.select(*own, F.lag("_l").over(over)["_v"].alias("_lb"), F.lead("_f").over(over)["_v"].alias("_fa"))
    near = rows.withColumn("_b", F.lag(F.struct("_v")).over(inner)).withColumn("_a", F.lead(F.struct("_v")).over(inner))
    out = join_by(near, ends, own)
    before = F.when(F.col("_b").isNotNull(), F.col("_b")["_v"]).otherwise(F.col("_lb"))
    after = F.when(F.col("_a").isNotNull(), F.col("_a")["_v"]).otherwise(F.col("_fa"))
    return out.withColumn("before", before).withColumn("after", after).drop("_v", "_b", "_a", "_lb", "_fa")


def in_ranges(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """df cut into sorted ranges of ``order``, with _part (rises with the key) and _at (from 0 within a range).

    The numbers hold for one evaluation: write the result before using it twice.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = ranged.select("*", F.monotonically_increasing_id().alias("_id"))
    return ranged.select(*df.columns, F.shiftright("_id", PLACE_BITS).cast("int").alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_at"))


def with_places(written: DataFrame, name: str = "place") -> DataFrame:
    """Places from 0 over all ranges of a written ``in_ranges`` table; only a row for each range is summed up and sent round."""
    sizes = sorted(written.groupBy("_part").agg((F.max("_at") + 1).alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(written.sparkSession.createDataFrame(starts, "_part int, _start long"))  # a row for each range
    return written.join(offsets, "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")

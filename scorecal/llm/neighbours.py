"""Nearest neighbours by inner product: a forest of sorted hash strings, matched by prefixes.

A tree turns a vector by a random rotation and writes down the coordinates,
with their signs, that are largest there: a string of letters, kept as a
number whose leading bits are the string's prefix.  Rows sorted by that number
are the tree's array, and all strings that share a prefix lie next to each
other in it.  A query starts at its longest match and all trees ascend
together, bit by bit, until their intervals hold enough candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.llm.heap import frugal
from scorecal.llm.scratch import Scratch

BITS = 56  # of a string at most
BLOCK = 4096  # rows of a tree's array that meet in one task, about
CELLS = 1 << 21  # inner products held at once
FOREST = ["dim", "slice"]


def letter_bits(dim: int) -> tuple[int, int, int]:
    """(coordinates, bits of a letter, letters) of the strings of vectors of this size."""
    coordinates = 1 << (min(dim + 1, 128).bit_length() - 1)
    bits = coordinates.bit_length()
    return coordinates, bits, min(BITS // bits, coordinates)


@cache
def rotation(dim: int, tree: int, seed: int) -> np.ndarray:
    """dim + 1 rows; the last one is for the coordinate that evens out norms."""
    rng = np.random.Generator(np.random.PCG64([seed, dim, tree]))
    return np.linalg.qr(rng.standard_normal((dim + 1, letter_bits(dim)[0])))[0]


def strings(turned: np.ndarray, dim: int) -> np.ndarray:
    """The hash string of each turned vector, first letter in the leading bits."""
    _, bits, letters = letter_bits(dim)
    order = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :letters]
    sign = np.take_along_axis(turned, order, axis=1) > 0
    out = np.zeros(len(turned), np.int64)
    for k in range(letters):
        out = out << bits | sign[:, k].astype(np.int64) << (bits - 1) | order[:, k]
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def _norm(v: Column) -> Column:
    """Without overflow of the squares."""
    peak = F.array_max(F.transform(v, F.abs)).cast("double")
    return peak * F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / peak) * (x / peak)))


def _classes(vectors: DataFrame, queries: Column, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Equal vectors as one row (cid, v, dim, slice, norm, members, asked), and the query rows (vec_id, v).

    cid is the smallest id, members the k + 1 smallest, asked whether one of
    all is a query.
    """
    v = F.col("embedding")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & sound).select("vec_id", v.alias("v"))
    one = scratch.save(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "rows")
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    own = one.withColumn("_r", first).where(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    asking = one.where(queries)
    asked = asking.groupBy("v").agg(F.lit(True).alias("asked"))
    both = own.join(asked, "v", "left")
    norm = _norm(F.col("v"))
    classes = both.select(F.col("members")[0].alias("cid"), "v", F.size("v").alias("dim"), F.floor(F.log2(norm) + 0.5).cast("int").alias("slice"), norm.alias("norm"), "members", F.coalesce("asked", F.lit(False)).alias("asked"))
    return scratch.save(classes, "classes"), asking


def _hashed(classes: DataFrame, sizes: DataFrame, trees: int, seed: int) -> DataFrame:
    """Adds bits, the strings of all trees, and for queries the strings to look up."""
    kind = classes.schema["v"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x, top, norm, asked = _matrix(own.column("v"), dim), *(own.column(c).to_numpy(zero_copy_only=False) for c in ("top", "norm", "asked"))
                x /= norm[:, None]
                share = np.minimum(norm / top, 1.0)
                rest = np.sqrt(np.maximum(1 - share**2, 0.0))
                held, sought = [], []
                for tree in range(trees):
                    r = rotation(dim, tree, seed)
                    turned = x @ r[:-1]
                    held.append(strings(turned * share[:, None] + rest[:, None] * r[-1], dim))
                    sought.append(strings(turned[asked], dim))
                _, bits, letters = letter_bits(dim)
                lists = lambda a, n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * trees), pa.array(np.stack(a, axis=1).ravel()))
                nulls = pa.array(np.where(asked, np.cumsum(asked) - 1, 0), mask=~asked)
                found = lists(sought, int(asked.sum())).take(nulls) if asked.any() else pa.nulls(len(asked), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("cid", *FOREST, "v")), pa.array(np.full(len(x), bits * letters, np.int32)), lists(held, len(x)), found], ["cid", *FOREST, "v", "bits", "held", "sought"])

    rows = classes.join(sizes.select(*FOREST, "top"), FOREST).select("cid", *FOREST, "v", "norm", "top", "asked")
    return rows.mapInArrow(frugal(run), f"cid long, dim int, slice int, v {kind.simpleString()}, bits int, held array<long>, sought array<long>")


def _prefix(string: str, bits: Column | str, length: Column | str) -> Column:
    """The leading bits of a string; all of them where ``length`` is more."""
    return F.call_function("shiftright", F.col(string), F.greatest(F.lit(0), F.col(bits) - F.col(length)).cast("int"))


def _levels(hashed: DataFrame, sizes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The number of strings under each prefix, and for each query and forest the longest level at which all trees together hold enough."""
    base = sizes.select(*FOREST, "depth", "budget")
    held = hashed.join(base, FOREST).select(*FOREST, "bits", F.least("depth", "bits").alias("depth"), F.posexplode("held").alias("tree", "string"))
    deep = held.groupBy(*FOREST, "tree", "depth", _prefix("string", "bits", "depth").alias("node")).agg(F.count("*").alias("n"))
    each = deep.withColumn("level", F.explode(F.sequence(F.lit(0), "depth")))
    nodes = scratch.save(each.groupBy(*FOREST, "tree", "level", _prefix("node", "depth", "level").alias("node")).agg(F.sum("n").alias("n")), "nodes")
    asked = hashed.where("sought is not null").select(F.col("cid").alias("query"), "dim", "bits", F.posexplode("sought").alias("tree", "string"))
    asked = asked.join(base, "dim").withColumn("level", F.explode(F.sequence(F.lit(0), F.least("depth", "bits"))))
    asked = asked.withColumn("node", _prefix("string", "bits", "level")).join(nodes, [*FOREST, "tree", "level", "node"])
    enough = asked.groupBy("query", *FOREST, "level").agg((F.sum("n") >= F.first("budget")).alias("enough"))
    levels = enough.groupBy("query", *FOREST).agg(F.coalesce(F.max(F.when(F.col("enough"), F.col("level"))), F.lit(0)).alias("level"))
    return nodes, scratch.save(levels, "levels")


def _best(data: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """Each query's k nearest among the rows of its interval of one block's sorted array."""
    empty = {"query": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
    if not data.num_rows or not asked.num_rows:
        return pa.table(empty)
    dim, bits = data.column("dim")[0].as_py(), data.column("bits")[0].as_py()
    string = data.column("string").to_numpy()
    order = np.argsort(string, kind="stable")
    string, ids = string[order], data.column("cid").to_numpy()[order]
    x = _matrix(data.column("v"), dim)[order]
    query, q = asked.column("query").to_numpy(), _matrix(asked.column("v"), dim)
    level = np.minimum(asked.column("level").to_numpy(), bits)
    prefix = asked.column("string").to_numpy() >> (bits - level)
    lo = np.searchsorted(string, prefix << (bits - level))
    hi = np.searchsorted(string, (prefix + 1) << (bits - level))
    out = []
    by = np.lexsort((hi, lo))
    cuts = np.flatnonzero((np.diff(lo[by]) != 0) | (np.diff(hi[by]) != 0)) + 1
    for same in np.split(by, cuts):
        a, b = lo[same[0]], hi[same[0]]
        if a == b:
            continue
        for part in np.array_split(same, -(-len(same) * (b - a) // CELLS)):
            near = q[part] @ x[a:b].T
            most = min(k + 4, b - a)  # a few more, since a matrix product rounds otherwise
            at = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < b - a else np.tile(np.arange(b - a), (len(part), 1))
            score = (x[a:b][at] * q[part][:, None, :]).sum(axis=2)
            found = ids[a:b][at]
            rank = np.lexsort((found, -score), axis=1)[:, :k]
            out.append((np.repeat(query[part], rank.shape[1]), np.take_along_axis(found, rank, 1).ravel(), np.take_along_axis(score, rank, 1).ravel()))
    if not out:
        return pa.table(empty)
    return pa.table(dict(zip(empty, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))


def _candidates(hashed: DataFrame, sizes: DataFrame, nodes: DataFrame, levels: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query, cid, score): the k best of each query in each block that it meets.

    A block is a stretch of a tree's array, the strings under one prefix.
    Where more rows or queries meet in it than a task should hold, both are
    dealt and each deal of rows meets each deal of queries.
    """
    base = sizes.select(*FOREST, "depth", "cut")
    block = [*FOREST, "tree", "node"]
    data = hashed.join(base, FOREST).select(*FOREST, "cid", "v", "bits", F.least("cut", "bits").alias("cut"), F.posexplode("held").alias("tree", "string")).withColumn("node", _prefix("string", "bits", "cut"))
    asked = hashed.where("sought is not null").select(F.col("cid").alias("query"), "dim", "v", "bits", F.posexplode("sought").alias("tree", "string"))
    asked = asked.join(levels, ["query", "dim"]).join(base, FOREST).withColumn("cut", F.least("cut", "bits"))
    own = F.least("level", "cut")
    wide = F.col("cut") - own
    start = F.call_function("shiftleft", F.call_function("shiftright", F.col("string"), (F.col("bits") - own).cast("int")), wide.cast("int"))
    asked = asked.withColumn("node", F.explode(F.sequence(start, start + F.call_function("shiftleft", F.lit(1).cast("long"), wide.cast("int")) - 1)))
    rows = nodes.join(base, FOREST).where(F.col("level") == F.col("cut")).select(*block, F.ceil(F.col("n") / (2 * BLOCK)).alias("rows"))
    meets = asked.groupBy(*block).agg(F.ceil(F.count("*") / BLOCK).alias("deals"))
    full = scratch.save(rows.join(meets, block).where("rows > 1 or deals > 1"), "full")
    deal = lambda df, key, fixed, other: df.join(full, block, "left").withColumn(fixed[1], F.coalesce(F.pmod(F.xxhash64(key), F.col(fixed[0])), F.lit(0).cast("long"))).withColumn(other[1], F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other[0], F.lit(1).cast("long")) - 1))).drop("rows", "deals")
    left = deal(data, "cid", ("rows", "i"), ("deals", "j")).select(*block, "i", "j", "bits", "cid", "v", "string")
    right = deal(asked, "query", ("deals", "j"), ("rows", "i")).select(*block, "i", "j", "query", "v", "string", "level")
    right = right.toDF(*right.columns)  # columns of its own, since both sides come from one table
    keys = [*block, "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _best(a, b, k), "query long, cid long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, trees: int = 48, budget: float = 14.0, exponent: float = 0.65, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product that the forest finds for each query.

    ``queries`` is a condition on vec_id.  The trees ascend until they hold
    budget * n ** exponent candidates, of which each may come from several
    trees; a forest of fewer rows is searched whole.  Scores are sums of
    products in double precision.

    Vectors of different sizes never meet.  Vectors are dealt to forests by
    norm, in steps of a factor 2, and within one evened out by a further
    coordinate, so that directions order inner products; a query searches all
    forests of its size.  Equal vectors are found as one and stand for all
    their rows.  Rows whose id is null, or whose vector is null, empty, zero or
    holds a null or a number that is not finite, take no part; of rows with the
    same id the smallest vector does.  Ties go to the smaller vec_id; fewer
    rows than k are all returned.  Other columns are ignored; an empty table
    gives no row.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    classes, asking = _classes(vectors, queries, k, scratch)
    n = F.count("*")
    enough = F.lit(budget) * F.pow(n, F.lit(exponent))
    sizes = classes.groupBy(*FOREST).agg(
        F.max("norm").alias("top"), enough.alias("budget"),
        F.greatest(F.lit(0), F.ceil(F.log2(n * trees / enough)) + 4).cast("int").alias("depth"),
        F.greatest(F.lit(0), F.floor(F.log2(n / BLOCK))).cast("int").alias("cut"),
    )
    sizes = scratch.save(sizes.withColumn("cut", F.least("cut", "depth")), "sizes")
    hashed = scratch.save(_hashed(classes, sizes, trees, seed), "strings")
    nodes, levels = _levels(hashed, sizes, scratch)
    found = _candidates(hashed, sizes, nodes, levels, k + 1, scratch)
    top = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    best = found.repartition("query").dropDuplicates(["query", "cid"]).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1)
    every = best.join(classes.select("cid", "members"), "cid").select("query", "score", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    every = every.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    lists = scratch.save(every.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("found")), "lists")
    # queries that share a vector share its list
    own = asking.join(classes.where("asked").select(F.col("cid").alias("vec_id")), "vec_id", "left_semi").select("vec_id", F.col("vec_id").alias("query"))
    alike = asking.join(classes.where("asked").select(F.col("cid").alias("vec_id")), "vec_id", "left_anti")
    alike = alike.join(classes.where("asked and size(members) > 1").select("v", F.col("cid").alias("query")), "v").select("vec_id", "query")
    each = own.unionByName(alike).withColumnRenamed("vec_id", "query_id").join(lists, "query")
    others = F.slice(F.filter("found", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    rows = each.select("query_id", F.posexplode(others).alias("_at", "s"))
    return rows.select(F.col("query_id").cast("long").alias("query_id"), (F.col("_at") + 1).alias("rank"), F.col("s.vec_id").cast("long").alias("vec_id"), F.col("s.score").alias("score"))

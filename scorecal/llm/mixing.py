"""Mixing sources to target weights by hierarchical budgeting.

Only DataFrame expressions.  A token budget flows down a tree (domain,
language, source): children share their parent's budget by weight, a child
that cannot use its share is filled to its capacity and what it leaves goes to
its siblings; only when a whole family is full does the rest flow to the
family's own siblings.  Each leaf takes whole epochs of its documents and then
a prefix, by tokens, of one more epoch in a seeded order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.llm.scratch import Scratch
from scorecal.llm.text import WORD

FAN = 1024  # buckets of one level of the prefix search


def n_tokens(text: Column) -> Column:
    """Words of a text, as its tokens; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def epoch_order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    own = weights.get(level, {})
    default = F.lit(int(own.get("*", 1)))
    named = [(k, v) for k, v in own.items() if k != "*"]
    if not named:
        return default
    return F.coalesce(reduce(lambda c, kv: c.when(F.col(level) == kv[0], kv[1]), named[1:], F.when(F.col(level) == named[0][0], named[0][1])), default)


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """leaves (levels, supply) with a column ``budget``: each leaf's tokens.

    Integer arithmetic throughout: a division's remainder, less than one token
    a child, is not given out.  A node of weight 0 gets nothing.
    """
    tree = leaves.withColumn("cap", F.col("supply") * max_epochs)
    for depth in range(len(levels), 0, -1):
        tree = tree.withColumn(f"w{depth}", _weight(levels[depth - 1], weights))
        own = F.when(F.col(f"w{depth}") > 0, F.col("cap") if depth == len(levels) else F.sum(f"c{depth + 1}_once").over(Window.partitionBy(*levels[:depth]))).otherwise(0)
        tree = tree.withColumn(f"c{depth}", own)
        # a node's capacity counts once among the leaves below it
        first = F.row_number().over(Window.partitionBy(*levels[:depth]).orderBy(*levels)) == 1
        tree = tree.withColumn(f"c{depth}_once", F.when(first, F.col(f"c{depth}")).otherwise(0)).withColumn(f"first{depth}", first)
    tree = tree.withColumn("b0", F.least(budget.cast("long"), F.sum("c1_once").over(Window.partitionBy())))
    for depth in range(1, len(levels) + 1):
        w, c, family = F.col(f"w{depth}"), F.col(f"c{depth}"), levels[: depth - 1]
        nodes = tree.where(f"first{depth}").select(*levels[:depth], w.alias("w"), c.alias("c"), F.col(f"b{depth - 1}").alias("b"))
        order = Window.partitionBy(*family).orderBy(F.when(F.col("w") > 0, F.col("c") / F.col("w")).otherwise(float("inf")), levels[depth - 1])
        before = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", F.col("c") * after <= (F.col("b") - before) * F.col("w"))
        rest = F.col("b") - F.sum(F.when(F.col("full"), F.col("c")).otherwise(0)).over(Window.partitionBy(*family))
        share = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(Window.partitionBy(*family))
        given = F.when(F.col("full"), F.col("c")).otherwise(F.coalesce(F.try_divide(F.col("w") * rest - F.pmod(F.col("w") * rest, F.when(share > 0, share).otherwise(1)), share), F.lit(0)).cast("long"))
        nodes = nodes.select(*levels[:depth], given.alias(f"b{depth}"))
        tree = tree.join(nodes, levels[:depth])
    return tree.select(*levels, "supply", F.col(f"b{len(levels)}").alias("budget"))


def leaf_cuts(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], scratch: Scratch, total: int | None = None, share: float = 1.0, max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """Per leaf: supply, budget, epochs (whole ones), and cut.

    docs: doc_id, the levels (strings without nulls) and tokens; a written table.
    A document is in the last, partial epoch if its ``epoch_order`` is at most
    ``cut`` (never, if cut is empty).  The cut is found by summing tokens in
    buckets of the order, three levels deep, so that no task sorts a leaf.
    """
    leaves = docs.groupBy(*levels).agg(F.sum("tokens").alias("supply"))
    supply = F.sum("supply").over(Window.partitionBy())
    wanted = F.lit(total) if total is not None else F.floor(supply * F.lit(share)).cast("long")
    leaves = leaves.withColumn("wanted", wanted)
    given = budgets(leaves, levels, weights, F.col("wanted"), max_epochs)
    whole = F.when(F.col("supply") > 0, F.col("budget") / F.col("supply")).otherwise(0)
    given = given.withColumn("epochs", F.floor(whole).cast("long"))
    given = given.withColumn("epochs", F.col("epochs") - (F.col("epochs") * F.col("supply") > F.col("budget")).cast("long"))
    given = scratch.save(given.withColumn("left", F.col("budget") - F.col("epochs") * F.col("supply")), "leaves")

    def place(depth: int) -> Column:
        """Bucket at a depth: digits of the order, 10 bits each."""
        bits = F.conv(F.substring("at", 1, 15), 16, 10).cast("long")
        return F.shiftright(bits, 60 - 10 * depth).bitwiseAND(FAN - 1)

    rows = docs.join(given.select(*levels, "epochs", "left"), levels)
    rows = rows.withColumn("at", epoch_order(seed, F.col("epochs"), F.col("doc_id"))).select(*levels, "tokens", "at", "left")
    parts = []
    for depth in (1, 2):
        own = rows.withColumn("bucket", place(depth))
        sums = own.groupBy(*levels, "bucket").agg(F.sum("tokens").alias("t"), F.max("at").alias("last"), F.first("left").alias("left"))
        w = Window.partitionBy(*levels).orderBy("bucket")
        sums = sums.withColumn("through", F.sum("t").over(w))
        parts.append(sums.where(F.col("through") <= F.col("left")).groupBy(*levels).agg(F.max("last").alias("cut")))
        edge = sums.where(F.col("through") > F.col("left")).groupBy(*levels).agg(F.min(F.struct("bucket", (F.col("left") - F.col("through") + F.col("t")).alias("left"))).alias("edge"))
        edge = scratch.save(edge.select(*levels, F.col("edge.bucket").alias("bucket"), F.col("edge.left").alias("left")), f"edge{depth}")
        rows = own.drop("left").join(edge, [*levels, "bucket"]).drop("bucket")
    w = Window.partitionBy(*levels).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    fine = rows.withColumn("through", F.sum("tokens").over(w)).where(F.col("through") <= F.col("left")).groupBy(*levels).agg(F.max("at").alias("cut"))
    cuts = reduce(DataFrame.unionByName, [*parts, fine]).groupBy(*levels).agg(F.max("cut").alias("cut"))
    out = given.join(cuts, levels, "left").select(*levels, "supply", "budget", "epochs", F.coalesce("cut", F.lit("")).alias("cut"))
    return scratch.save(out, "cuts")


def copies(seed: int) -> Column:
    """How often a document joined with its leaf's row is taken."""
    return F.col("epochs") + (epoch_order(seed, F.col("epochs"), F.col("doc_id")) <= F.col("cut")).cast("long")


def mix_sources(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, dict[str, int]],
    total: int | None = None,
    share: float = 1.0,
    max_epochs: int = 4,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents taken so that tokens follow target weights, and how often each.

    levels: names and expressions of the tree's levels, root first; a null
    value is a node named '' of its own.  weights: per level, integer weights
    by value, ``*`` for others (1 if absent).  The budget is ``total`` tokens or ``share``
    of all; no document is taken more than ``max_epochs`` times in whole epochs.

    Returns one row per input row taken at least once: doc_id, the levels,
    tokens, copies.  In a leaf the taken tokens fall short of its budget by
    less than the next document of its order.  Rows that repeat an id within a
    leaf are taken together.  Empty texts have no tokens and are taken where
    their place in the order comes up.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names = list(levels)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()), n_tokens(F.col(text_col)).alias("tokens"))
    rows = scratch.save(rows, "rows")
    cuts = leaf_cuts(rows, names, weights, scratch, total, share, max_epochs, seed)
    out = rows.join(cuts.select(*names, "epochs", "cut"), names).withColumn("copies", copies(seed))
    return out.where("copies > 0").select("doc_id", *names, "tokens", "copies")


def take_sources(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], total: int | None = None, share: float = 1.0, max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as ``mix_sources`` takes it, and its own columns."""
    scratch = Scratch(docs.sparkSession, "mixing")
    columns = docs.columns
    names = list(levels)
    keys = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()]
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    rows = scratch.save(docs.select(doc_id, *keys, n_tokens(F.col(text_col)).alias("tokens")), "rows")
    cuts = leaf_cuts(rows, names, weights, scratch, total, share, max_epochs, seed)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), doc_id, *keys)
    out = whole.join(cuts.select(*names, "epochs", "cut"), names).withColumn("copies", copies(seed)).where("copies > 0")
    if max_epochs > 1:
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*(F.col("row").getField(c).alias(c) for c in columns))

"""Components of similar sets by b-bit MinHash, banding and exact verification.

Shared by the document and the line operator.  An item is a set known by a
64-bit id and its size.  Minima form band keys; their low bits are kept as a
packed signature, from which the similarity of a candidate pair is estimated
with correction for chance collisions.

No table ever holds the pairs of a bucket; what is stored grows with the items.

1. Every member of a bucket is compared with one member (another one in each
   bucket) and each item verifies only its best such candidate.  Near copies
   fall into components by that alone.
2. In buckets that still hold several components, the members outside the
   largest one meet all others in pairs of blocks.  Pairs that the estimate finds
   plausible are not written but joined into families, as forests.
3. Within a family the same is done once more, with the texts at hand:
   plausible pairs of different components are verified on the full sets, and
   the links found come out as forests.  A plausible pair always shares its
   family, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecal.llm.graph import EDGE, connected_components
from scorecal.llm.heap import frugal
from scorecal.llm.scratch import Scratch
from scorecal.llm.text import mix, slices

B = 2  # bits kept of each minimum
LANES = 64 // B
BLOCK = 256  # members of a bucket in one block, at least
BLOCKS, WIDEST = 24, 4096  # a large bucket has about so many blocks, of as many members at most
HELD = 1 << 23  # values of the sets that a task holds at a time
_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2)
_HALF = np.uint64(0x5555555555555555)


def minima(items: np.ndarray, k: int, step: int = 2048) -> np.ndarray:
    """The k minima of a set of well-mixed 64-bit values."""
    out = np.full(k, np.uint64(2**64 - 1))
    for at in range(0, len(items), step):
        part = items[at : at + step]
        np.minimum(out, (part[None, :] * _MULTIPLY[:k, None] + _ADD[:k, None]).min(axis=1), out=out)
    return out


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each row of minima."""
    part = mins[:, : bands * rows].reshape(len(mins), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(99)), part.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ part[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(key)


def signatures(mins: np.ndarray) -> np.ndarray:
    """Low bits of the minima, packed into 64-bit words; len(mins[0]) is a multiple of LANES."""
    low = mix(mins) & np.uint64((1 << B) - 1)
    lanes = low.reshape(len(mins), -1, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(B))
    return np.bitwise_or.reduce(lanes, axis=2)


def similarity(a: list[Column], b: list[Column]) -> Column:
    """Estimated similarity from packed signatures, corrected for chance collisions."""
    differ = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(int(_HALF)))) for x in (p.bitwiseXOR(q) for p, q in zip(a, b, strict=True))), F.lit(0))
    chance = 2.0**-B
    return ((1 - differ / (LANES * len(a))) - chance) / (1 - chance)


def similarity_numpy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & _HALF).sum(axis=-1)
    chance = 2.0**-B
    return ((1 - differ / (LANES * a.shape[-1])) - chance) / (1 - chance)


def _plausible(num: int, den: int, words: int, floor: float, least: int) -> Column:
    """As ``_Plausible``, for the columns of a pair."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    ok = den * small >= num * large
    if words:
        ok = ok & ((small < least) | (similarity([F.col(f"s{i}_a") for i in range(words)], [F.col(f"s{i}_b") for i in range(words)]) >= floor))
    return ok


def _side(items: DataFrame, side: str) -> DataFrame:
    return items.select(*(F.col(c).alias(f"{c}_{side}") for c in items.columns))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(x) < len(y):
        x, y = y, x
    if not len(y):
        return 0
    place = np.searchsorted(x, y)
    place[place == len(x)] = 0
    return int(np.count_nonzero(x[place] == y))


def _verifier(sets: Callable, num: int, den: int):
    """Keep pairs with den * intersection >= num * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, min(whole.num_rows, (4 << 20) * whole.num_rows // max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                left, right = sets(batch.column("text_a")), sets(batch.column("text_b"))
                keep = []
                for x, y in zip(left, right, strict=True):
                    both = _common(x, y)
                    keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
                kept = batch.filter(pa.array(keep, pa.bool_()))
                yield pa.record_batch([kept.column("id_a"), kept.column("id_b")], ["v", "m"])

    return run


def similar_components(
    items: DataFrame,
    members: DataFrame,
    texts: Callable[[DataFrame], DataFrame],
    sets: Callable,
    scratch: Scratch,
    num: int,
    den: int,
    floor: float,
    least: int = 0,
) -> DataFrame:
    """Components of items whose sets have den * intersection >= num * union.

    items: id, n (set size) and the signature words s0, s1, ... if any.
    members: key, id - the buckets with two members or more; both are read
    more than once and should be written tables.  texts(ids) gives (id, text)
    for a table of ids, and sets(texts) a sorted distinct array for each text.
    ``floor`` is the least estimate that is verified, of sets of ``least`` and more.
    Returns (v, m) as ``connected_components`` does.
    """
    words = sum(c.startswith("s") for c in items.columns)
    plausible = _plausible(num, den, words, floor, least)
    estimate = similarity([F.col(f"s{i}_a") for i in range(words)], [F.col(f"s{i}_b") for i in range(words)]) if words else F.lit(0.0)

    spread = F.xxhash64("key", "id")
    pivot = members.groupBy("key").agg(F.min_by("id", spread).alias("id_b"))
    star = members.join(pivot, "key").select(F.col("id").alias("id_a"), "id_b").where("id_a <> id_b").distinct()
    star = star.join(_side(items, "a"), "id_a").join(_side(items, "b"), "id_b").where(plausible)
    best = star.groupBy("id_a").agg(F.max_by("id_b", F.struct(estimate, "id_b")).alias("id_b"))
    best = scratch.save(best, "best")
    text = scratch.save(texts(best.select(F.col("id_a").alias("id")).union(best.select("id_b")).distinct()), "text1")
    linked = scratch.save(_verified(best, text, sets, num, den), "linked1")
    scratch.drop("best", "text1")
    found = connected_components(linked, scratch, "first")
    scratch.drop("linked1")

    def root(df: DataFrame) -> DataFrame:
        return df.join(found, df.id == found.v, "left").select(*df.columns, F.coalesce("m", "id").alias("root"))

    now = root(members)
    by_root = now.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = by_root.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("size"), F.max("n").alias("top"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1")
    # Sizes are written: Spark broadcasts a small table, and can split a large group beside a written one.
    open_ = scratch.save(open_.select("key", "size", "top", "main"), "buckets")
    rest = now.join(open_, "key").join(items, "id")
    check = _Plausible(num, den, words, floor, least)
    forest = _blocked(rest.withColumnRenamed("key", "group"), []).mapInArrow(frugal(_family_edges(check)), EDGE)
    family = connected_components(forest, scratch, "family")
    family = scratch.save(family.select(F.col("v").alias("id"), F.col("m").alias("group")).union(family.select("m", "m").distinct()), "families")
    scratch.drop("buckets")

    now = scratch.save(root(family).join(items, "id"), "open")
    by_root = now.groupBy("group", "root").agg(F.count("*").alias("c"))
    size = by_root.groupBy("group").agg(F.sum("c").alias("size"), F.max("c").alias("top"), F.max_by("root", F.struct("c", "root")).alias("main"))
    size = scratch.save(size, "sizes")
    # Texts travel, and a run makes their sets: a set has eight bytes for each shingle.
    full = scratch.save(texts(now.select("id")).select("id", "text"), "text2")
    rest = now.join(size, "group").join(full, "id")
    more = _blocked(rest, ["text"]).mapInArrow(frugal(_links(check, sets)), EDGE)
    out = connected_components(found.union(more), scratch, "second")
    scratch.drop("families", "open", "sizes", "text2")
    return out


def _blocked(rest: DataFrame, more: list[str]) -> DataFrame:
    """Each group as pairs of blocks: those outside its main root meet one another and the main root.

    Both sides are cut into blocks of about BLOCK members by a hash, of more
    where there would be over BLOCKS, so that a large group's rows are not sent
    more often than a small one's, up to BLOCKS * WIDEST members.  Tasks get
    whole (group, pair of blocks) runs of two blocks at most: ``probe`` flags
    the first block's members, ``member`` the second's, who come first; a block
    also meets itself.  Members of the main root never meet one another.
    """
    words = [c for c in rest.columns if c.startswith("s") and c[1:].isdigit()]
    probe = F.col("root") != F.col("main")
    each = F.greatest(F.lit(BLOCK), F.least(F.ceil(F.col("size") / BLOCKS), F.lit(WIDEST)))
    first = F.ceil((F.col("size") - F.col("top")) / each)
    second = F.ceil(F.col("top") / each)
    number = F.pmod(F.xxhash64("id", "group"), F.when(probe, first).otherwise(second))
    rows = rest.withColumn("place", F.when(probe, number).otherwise(first + number)).withColumn("blocks", first + second)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(probe, F.col("blocks")).otherwise(first) - 1)))
    i, j = F.least("place", "other"), F.greatest("place", "other")
    rows = rows.select("group", (i * F.col("blocks") + j).alias("block"), "id", "root", (F.col("place") == i).alias("probe"), (F.col("place") == j).alias("member"), "n", *words, *more)
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", F.col("member").desc(), "id")


class _Plausible:
    """Sizes allow the similarity, and the estimate of large enough sets is not far below it."""

    def __init__(self, num: int, den: int, words: int, floor: float, least: int):
        self.num, self.den, self.words, self.floor, self.least = num, den, words, floor, least

    def __call__(self, n: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = self.den * small >= self.num * large
        if self.words:
            at = np.flatnonzero(ok)
            ok[at] = (small[at] < self.least) | (similarity_numpy(sig[i[at]], sig[j[at]]) >= self.floor)
        return ok


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of whole (group, block) runs; one run at most is held back."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        group, block = batch.column("group").to_numpy(), batch.column("block").to_numpy()
        last = np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield batch.slice(0, cut)
        held = batch.slice(cut)
    if held is not None:
        yield held


def _meetings(batch: pa.RecordBatch, limit: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of each probe and each member of its run, each pair once, about ``limit`` at a time."""
    group, block = batch.column("group").to_numpy(), batch.column("block").to_numpy()
    probe, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("probe", "member"))
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (block[1:] != block[:-1])
    start, run = np.flatnonzero(new), np.cumsum(new) - 1
    members = np.add.reduceat(member.astype(np.int64), start)
    row = np.flatnonzero(probe)
    count = members[run[row]]
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        n = count[at:stop]
        i = np.repeat(row[at:stop], n)
        j = np.arange(total[stop] - total[at]) - np.repeat(total[at:stop] - total[at], n) + np.repeat(start[run[row[at:stop]]], n)
        once = (j < i) | ~(member[i] & probe[j])  # a block that meets itself has both orders
        once &= i != j
        yield i[once], j[once]
        at = stop


class _Union:
    def __init__(self, names: np.ndarray):
        """Rows with the same name begin together."""
        _, first, of = np.unique(names, return_index=True, return_inverse=True)
        self.parent = first[of].tolist()

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs lie in different parts."""
        label = np.array(self.parent)
        while (label[label] != label).any():
            label = label[label]
        return label[i] != label[j]


def _signature(batch: pa.RecordBatch) -> np.ndarray:
    words = sorted((c for c in batch.schema.names if c.startswith("s") and c[1:].isdigit()), key=lambda c: int(c[1:]))
    return np.stack([batch.column(c).to_numpy().view(np.uint64) for c in words], axis=1) if words else np.zeros((batch.num_rows, 0), np.uint64)


def _edge_batch(ids: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(edges, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["v", "m"])


def _family_edges(plausible: _Plausible):
    """Forests of the plausible pairs of different roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches):
            ids, root, n, sig = (batch.column("id").to_numpy(), batch.column("root").to_numpy(), batch.column("n").to_numpy(), _signature(batch))
            union, edges = _Union(np.arange(batch.num_rows)), []
            for i, j in _meetings(batch):
                open_ = (root[i] != root[j]) & union.apart(i, j)
                i, j = i[open_], j[open_]
                ok = plausible(n, sig, i, j)
                edges.extend(pair for pair in zip(i[ok].tolist(), j[ok].tolist(), strict=True) if union.join(*pair))
            yield _edge_batch(ids, edges)

    return run


class _Sets:
    """The sets of some texts, each made when it is first asked for; about ``most`` values are held."""

    def __init__(self, texts: pa.Array, make: Callable, most: int = HELD):
        self.texts, self.make, self.most = texts, make, most
        self.held: dict[int, np.ndarray] = {}
        self.size = 0

    def __getitem__(self, i: int) -> np.ndarray:
        return self.held[i]

    def want(self, rows: np.ndarray) -> None:
        """Has the sets of all these rows at hand."""
        wanted = np.unique(rows).tolist()
        if self.size > self.most:
            self.held, self.size = {i: self.held[i] for i in wanted if i in self.held}, 0
            self.size = sum(map(len, self.held.values()))
        new = [i for i in wanted if i not in self.held]
        if not new:
            return
        batch = pa.record_batch([pa.array(new), self.texts.take(pa.array(new))], ["row", "text"])
        for part in slices([batch], "text"):
            for i, own in zip(part.column("row").to_pylist(), self.make(part.column("text")), strict=True):
                self.held[i] = own
                self.size += len(own)


def _links(plausible: _Plausible, sets: Callable):
    """Forests of the pairs that are similar on their full sets."""
    num, den = plausible.num, plausible.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches):
            ids, n, sig, full = batch.column("id").to_numpy(), batch.column("n").to_numpy(), _signature(batch), _Sets(batch.column("text"), sets)
            # rows of one root are of one part, within a run as between runs
            union, edges = _Union(batch.column("root").to_numpy()), []
            for i, j in _meetings(batch):
                open_ = union.apart(i, j)
                i, j = i[open_], j[open_]
                ok = plausible(n, sig, i, j)
                i, j = i[ok], j[ok]
                full.want(np.concatenate([i, j]))
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if union.find(a) == union.find(b):
                        continue
                    own, other = full[a], full[b]
                    both = _common(own, other)
                    if den * both >= num * (len(own) + len(other) - both):
                        union.join(a, b)
                        edges.append((a, b))
            yield _edge_batch(ids, edges)

    return run


def _verified(pairs: DataFrame, text: DataFrame, sets: Callable, num: int, den: int) -> DataFrame:
    full = pairs.select("id_a", "id_b").join(text.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
    full = full.join(text.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")), "id_a")
    return full.mapInArrow(frugal(_verifier(sets, num, den)), EDGE)

"""How the sources of a language differ in words: document frequencies, an automaton over the kept terms, sparse postings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterator
from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecal.llm.blanks import lowering, pieces
from scorecal.llm.heap import frugal
from scorecal.llm.scratch import Scratch
from scorecal.operators.ties import join_by

TABLE = lowering(b"")
HELD = 1 << 19  # entries that a task holds before it sends them on
SENT = 8 << 20  # bytes of kept terms that may go to every task
SHARD = 4 << 20  # bytes of kept terms in one automaton beyond that
SIDE, TERMS = 64, 2048  # sources on a side, and terms, of one block of pairs
GROUP = ["lang", "source"]


def _given_out(held: dict, names: list[str]) -> pa.RecordBatch:
    """{group: {term: n}} as rows of the group's columns, term and n."""
    terms, counts, sizes = [], [], []
    for own in held.values():
        terms += own.keys()
        counts += own.values()
        sizes.append(len(own))
    at = pa.array(np.repeat(np.arange(len(sizes)), np.array(sizes, int)))
    groups = [pa.array([g[i] for g in held], pa.string()).take(at) for i in range(len(names) - 2)]
    return pa.RecordBatch.from_arrays([*groups, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names)


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            own, seen = held.setdefault((lang,), Counter()), set()
            for piece in pieces(text.as_py().translate(TABLE)):
                seen.update(piece.split())
            size -= len(own)
            own.update(seen)
            size += len(own)
            if size >= HELD:
                yield _given_out(held, ["lang", "term", "n"])
                held, size = {}, 0
    yield _given_out(held, ["lang", "term", "n"])


class Recount:
    """Occurrences of kept terms, found by one automaton whose words carry a blank on either side."""

    def __init__(self, kept: dict[bytes, Collection[str]]):
        same = {}  # one set for all terms of the same languages
        self.terms, self.langs = list(kept), [same.setdefault(frozenset(x), x) for x in kept.values()]
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            self.automaton.add_word(f" {term.decode()} ", i)
        self.automaton.make_automaton()
        self.held: dict[tuple[str, str], Counter] = {}
        self.size = 0

    def add(self, lang: str, source: str, padded: bytes) -> None:
        if not self.terms:
            return
        own = self.held.setdefault((lang, source), Counter())
        self.size -= len(own)
        own.update(map(itemgetter(1), self.automaton.iter(padded.decode())))
        self.size += len(own)

    def given_out(self) -> pa.RecordBatch:
        named = {g: {self.terms[i]: n for i, n in own.items() if g[0] in self.langs[i]} for g, own in self.held.items()}
        self.held, self.size = {}, 0
        return _given_out(named, [*GROUP, "term", "n"])


COUNTED = "lang string, source string, term string, n long"


def _recount_by(kept: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Recount(kept.value)
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                for piece in pieces(text.as_py().translate(TABLE)):
                    found.add(lang, source, b" " + piece + b" ")
                    if found.size >= HELD:
                        yield found.given_out()
        yield found.given_out()

    return run


def _recount_in_shards(docs: DataFrame, kept: DataFrame, size: int, shard: int) -> DataFrame:
    """Counts where the terms are too many for one automaton.

    Terms and words are dealt to shards by CRC, so each word of a text goes to
    the one shard that may know it, and the text as a whole is sent once.  Each
    shard's text is dealt on to several tasks; the terms come first in each.
    """
    spark = docs.sparkSession
    shards = -(-size // shard)
    salts = max(1, 2 * docs.rdd.getNumPartitions() // shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                for piece in pieces(text.as_py().translate(TABLE)):
                    turn += 1
                    dealt: dict[int, list[bytes]] = {}
                    for word in piece.split():
                        dealt.setdefault(crc32(word) % shards, []).append(word)
                    rows += [(s * salts + turn % salts, 1, lang, source, b" ".join(words)) for s, words in dealt.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SENT_TYPES, strict=True)], SENT_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, each part's terms first."""
        part, terms, found = None, {}, None
        for batch in batches:
            for at, kind, lang, source, blob in zip(*(batch.column(c).to_pylist() for c in SENT_NAMES), strict=True):
                if at != part:
                    if found:
                        yield found.given_out()
                    part, terms, found = at, {}, None
                if kind == 0:
                    terms.setdefault(blob, set()).add(lang)
                    continue
                found = found or Recount(terms)
                found.add(lang, source, b" " + blob + b" ")
                if found.size >= HELD:
                    yield found.given_out()
        if found:
            yield found.given_out()

    schema = "part int, kind int, lang string, source string, blob binary"
    texts = docs.mapInArrow(frugal(deal), schema)
    every = kept.select("lang", "term", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    words = every.select((F.pmod(F.crc32("term"), F.lit(shards)) * salts + F.col("salt")).cast("int").alias("part"), F.lit(0).alias("kind"), "lang", F.lit("").alias("source"), F.col("term").cast("binary").alias("blob"))
    n = max(shards * salts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return words.union(texts).repartition(n, "part").sortWithinPartitions("part", "kind").mapInArrow(frugal(count), COUNTED)


SENT_NAMES = ["part", "kind", "lang", "source", "blob"]
SENT_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary()]


def postings(docs: DataFrame, kept: DataFrame, sent: int = SENT, shard: int = SHARD) -> DataFrame:
    """(lang, source, term, n) of the kept terms (lang, term) that occur in a group.

    Terms of at most ``sent`` bytes go to every task; more are sharded.
    """
    size = kept.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    if size <= sent:
        every = kept.groupBy(F.col("term").cast("binary").alias("term")).agg(F.collect_set("lang").alias("langs")).collect()  # of checked size
        by_term = {bytes(r["term"]): tuple(sorted(r["langs"])) for r in every}
        counts = docs.mapInArrow(frugal(_recount_by(docs.sparkSession.sparkContext.broadcast(by_term))), COUNTED)
    else:
        counts = _recount_in_shards(docs, kept, size, shard)
    return counts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"))


def _share(n: str, total: str, terms: str):
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), in whole numbers of any size."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({n} + 5 as decimal(19, 0))) div cast(greatest({total} + 5 * {terms}, 1) as decimal(19, 0))")


def _pair_sums(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, a, b, more): by how much the distance of two sources exceeds that of two groups without terms.

    groups: (lang, id, p0, terms, last); cells: (lang, id, term, p).  Sources are dealt to blocks of
    SIDE, terms to parts of about TERMS; a task takes two blocks of sources on
    one part of the terms, as a dense matrix.
    """
    block = lambda c: F.floor(F.col(c) / SIDE)
    parts = F.ceil(F.col("terms") / TERMS)
    other = F.explode(F.sequence(F.lit(0), block("last")))
    every = groups.where("terms > 0").select("lang", "id", "p0", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "last", F.explode(F.sequence(F.lit(0), parts - 1)).alias("k"))
    own = join_by(cells, groups, ["lang", "id"]).select("lang", "id", "p0", "term", "p", "last", F.pmod(F.xxhash64("term"), parts).alias("k"))
    rows = every.select("*", other.alias("o")).unionByName(own.select("*", other.alias("o")))
    mine = block("id")
    rows = rows.select("lang", "k", F.least(mine, "o").alias("i"), F.greatest(mine, "o").alias("j"), "id", "p0", "term", "p")

    def distances(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, lang = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), pdf["lang"].iloc[0]
        plain = pdf[pdf["term"].isna()].sort_values("id")
        ids, p0 = plain["id"].to_numpy(), plain["p0"].to_numpy()
        found = pdf[pdf["term"].notna()]
        code, names = pd.factorize(found["term"])
        dense = np.repeat(p0[:, None], len(names), axis=1)
        dense[np.searchsorted(ids, found["id"].to_numpy()), code] = found["p"].to_numpy()
        right = np.flatnonzero(ids // SIDE == j)
        out = []
        for a in np.flatnonzero(ids // SIDE == i):
            b = right[right > a]
            more = np.abs(dense[b] - dense[a]).sum(axis=1) - np.abs(p0[b] - p0[a]) * len(names)
            out.append(pd.DataFrame({"a": ids[a], "b": ids[b], "more": more}))
        return pd.concat(out).assign(lang=lang)[["lang", "a", "b", "more"]]

    return rows.groupBy("lang", "k", "i", "j").applyInPandas(distances, "lang string, a long, b long, more long").groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, sent: int = SENT, shard: int = SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between a language's sources, and each source's own words.

    Terms are runs of letters and characters beyond ASCII, A-Z lower-cased; a
    language keeps those of ``min_docs`` of its documents or more.  Part
    ``pair`` has the summed distance of a source's shares (of 10^9, smoothed by
    5) to each other source's; part ``term`` the ``top`` terms whose share lies
    furthest above the language's.  All arithmetic is on whole numbers.

    Null text, lang and source count as empty.  A source without kept terms
    has the shares of zero counts; without kept terms in the language all
    distances are 0.  Ties are ranked by the item's UTF-8 bytes.  Repeated rows
    are documents of their own; long texts are worked on in parts; other
    columns are ignored; an empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    frequency = rows.select("lang", "text").mapInArrow(frugal(_document_terms), "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = scratch.save(frequency.where(F.col("n") >= min_docs).select("lang", "term"), "terms")
    found = scratch.save(postings(rows, kept, sent, shard), "postings")

    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = found.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = join_by(join_by(rows.select(*GROUP).distinct(), terms, ["lang"], "left"), totals, GROUP, "left").na.fill(0, ["terms", "total"])
    lang = Window.partitionBy("lang")  # over sources
    groups = groups.withColumn("id", F.row_number().over(lang.orderBy("source")).cast("long") - 1).withColumn("last", F.count("*").over(lang) - 1)
    groups = scratch.save(groups.withColumn("p0", _share("0", "total", "terms")).withColumn("all", F.sum("total").over(lang)), "groups")

    cells = join_by(found, groups, GROUP).withColumn("p", _share("n", "total", "terms"))
    more = _pair_sums(groups.select("lang", "id", "p0", "terms", "last"), cells.select("lang", "id", "term", "p"))
    side = lambda a: groups.select("lang", *(F.col(c).alias(f"{a}_{c}") for c in ("id", "source", "p0", "terms")))
    pairs = side("a").join(side("b"), "lang").where("a_id < b_id")
    pairs = pairs.join(more.select("lang", F.col("a").alias("a_id"), F.col("b").alias("b_id"), "more"), ["lang", "a_id", "b_id"], "left")
    value = F.when(F.col("a_terms") > 0, F.abs(F.col("a_p0") - F.col("b_p0")) * F.col("a_terms") + F.coalesce("more", F.lit(0))).otherwise(0)
    both = F.explode(F.array(*(F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item")) for x, y in ("ab", "ba"))))
    pairs = pairs.select("lang", value.cast("long").alias("value"), both.alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    in_lang = F.sum("n").over(Window.partitionBy("lang", "term"))  # over sources
    above = cells.withColumn("every", in_lang).withColumn("value", F.col("p") - _share("every", "`all`", "terms")).where("value > 0")
    own = above.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(own).where(F.col("rank") <= top))


#: DuckDB SQL of the whole result.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM w) GROUP BY lang, term HAVING count(*) >= {min_docs}),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000 * (s + 5)) // (sum(s) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS s FROM p GROUP BY lang, term) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM e UNION ALL SELECT * FROM t))
SELECT * FROM x WHERE part = 'pair' OR rank <= {top}
"""

"""Repeated passages by Aho-Corasick automata over word windows.

A window is ``width`` consecutive words of one document.  A word is removed
when a window that covers it has a word sequence that also starts in a
document with a smaller id.

1. Every document gives the anchors of its windows: the least hash of the
   ``gram``-word runs in a window, which equal windows share.  Anchors met in
   two documents mark the candidates; nothing else of the corpus is shuffled
   at this step, and exact copies are settled by a digest of their words.
2. Windows with such anchors confirm recurring passages: for each window hash
   the first document and place where it starts.
3. For each document, windows that cover all its recurring passages are asked
   from the documents where they first start, as text.
4. Documents are dealt to shards; each shard compiles the passages asked for
   its documents into an automaton and streams all of its documents through
   it.  What the automaton finds word for word is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.llm.heap import frugal
from scorecal.llm.scratch import Scratch
from scorecal.llm.text import Words, sliding_min, slices

LAST = 2**63 - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SUMMARY = "doc_id long, doc long, n_words long, sha string, anchors array<long>"
WINDOWS = "h long, doc long, sha string, pos int, more binary, from_doc long, from_sha string, from_pos int"
MARKED = "doc long, sha string, anchors array<long>, text string"
ASKED = "doc long, sha string, from_doc long, from_sha string, from_pos int"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _anchors(words: Words, width: int, gram: int) -> list[np.ndarray]:
    """For each text, the anchor of each of its windows."""
    hashes, first = words.grams(gram)
    size = width - gram + 1
    return [sliding_min(hashes[a:b], size) if b - a >= size else np.zeros(0, np.uint64) for a, b in zip(first[:-1], first[1:], strict=True)]


def _summary(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words.of(batch.column("text"))
            shas = [hashlib.sha256(words.joined(i)).hexdigest() for i in range(batch.num_rows)]
            anchors = [np.unique(a) for a in _anchors(words, width, gram)]
            at = np.concatenate([[0], np.cumsum([len(a) for a in anchors])])
            flat = np.concatenate(anchors).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("doc"), pa.array(np.diff(words.first)), pa.array(shas), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], _names(SUMMARY))

    return run


def _own(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Batches of the rows whose words have the digest asked for."""
    for batch in slices(batches, "text", limit):
        words = Words.of(batch.column("text"))
        right = [hashlib.sha256(words.joined(i)).hexdigest() == sha for i, sha in enumerate(batch.column("sha").to_pylist())]
        if not all(right):
            batch = batch.filter(pa.array(right, pa.bool_()))
            words = Words.of(batch.column("text"))
        if batch.num_rows:
            yield batch, words


def _right_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _ in _own(batches):
        yield batch.select(_names(MARKED))


def _windows(width: int, gram: int, limit: int):
    """Windows with recurring anchors; those met before in the task, in a smaller document, are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, places, names = [], [], [], []
        held = 0

        def settle() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, d, p = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
            ids = np.array([n[0] for n in names], np.int64)
            shas = pa.array([n[1] for n in names])
            order = np.lexsort((p, ids[d], h))
            h, d, p = h[order], d[order], p[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            settled = ids[d] > ids[d[start]]
            # a window that a document repeats is one row, with its other places packed
            again = ~new & (d == np.concatenate([d[:1], d[:-1]])) & ~settled
            more = np.full(len(h), None, object)
            if again.any():
                lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
                at = np.flatnonzero(again)
                for head, rows in zip(*(lambda u, i: (u, np.split(at, i[1:])))(*np.unique(lead[at], return_index=True)), strict=True):
                    more[head] = p[rows].astype(np.int32).tobytes()
                keep = ~again
                renumber = np.cumsum(keep) - 1
                h, d, p, more, settled, start = h[keep], d[keep], p[keep], more[keep], settled[keep], renumber[start[keep]]
            for at in range(0, len(h), 1 << 17):
                part = slice(at, at + (1 << 17))
                none = ~settled[part]
                yield pa.record_batch(
                    [
                        pa.array(h[part].view(np.int64)),
                        pa.array(ids[d[part]]),
                        shas.take(pa.array(d[part])),
                        pa.array(p[part].astype(np.int32)),
                        pa.array(more[part], pa.binary()),
                        pa.array(ids[d[start[part]]], mask=none),
                        shas.take(pa.array(d[start[part]], mask=none)),
                        pa.array(p[start[part]].astype(np.int32), mask=none),
                    ],
                    _names(WINDOWS),
                )

        for batch in slices(batches, "text"):
            words = Words.of(batch.column("text"))
            wanted = batch.column("anchors")
            grams, first = words.grams(width)
            for i, (doc, sha, anchors) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("sha").to_pylist(), _anchors(words, width, gram), strict=True)):
                place = np.flatnonzero(np.isin(anchors, np.asarray(wanted[i].values).view(np.uint64)))
                hashes.append(grams[first[i] : first[i + 1]][place])
                docs.append(np.full(len(place), len(names), np.int32))
                places.append(place.astype(np.int32))
                names.append((doc, sha))
                held += len(place)
            if held > limit:
                yield from settle()
                hashes, docs, places, names, held = [], [], [], [], 0
        yield from settle()

    return run


def _cover(width: int):
    """From a document's recurring windows, few that cover the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, sha, found in zip(batch.column("doc").to_pylist(), batch.column("sha").to_pylist(), batch.column("found"), strict=True):
                table = found.values
                pos, source = np.asarray(table.field("pos")), np.arange(len(table))
                packed = table.field("more")
                for i in np.flatnonzero(np.asarray(packed.is_valid())):
                    places = np.frombuffer(packed[int(i)].as_py(), np.int32)
                    pos, source = np.concatenate([pos, places]), np.concatenate([source, np.full(len(places), i)])
                order = np.argsort(pos, kind="stable")
                pos, order = pos[order], source[order]
                keep, at = [], 0
                while at < len(pos):
                    keep.append(at)
                    # the last window that begins in or right after this one, else the next one
                    after = int(np.searchsorted(pos, pos[at] + width, side="right")) - 1
                    at = after if after > at else at + 1
                take = order[keep]
                f_doc, f_sha, f_pos = (table.field(c).take(pa.array(take)).to_pylist() for c in ("from_doc", "from_sha", "from_pos"))
                out.extend((doc, sha, *x) for x in zip(f_doc, f_sha, f_pos, strict=True))
                if len(out) > 50_000:
                    yield _rows(out, ASKED)
                    out = []
            yield _rows(out, ASKED)

    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(_names(schema))
    return pa.record_batch([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "), strict=True)], _names(schema))


def _passages(width: int):
    """The words asked for, out of the documents where they first start."""
    schema = "shard int, first long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, out = Words.of(batch.column("text")), []
            raw = words.data.tobytes()
            for i, (doc, asked) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                for a in asked:
                    at = words.first[i] + a["pos"]
                    span = b" ".join(raw[s:e] for s, e in zip(words.starts[at : at + width], words.ends[at : at + width], strict=True))
                    out.append((a["shard"], doc, span.decode()))
                if len(out) > 20_000:
                    yield _rows(out, schema)
                    out = []
            yield _rows(out, schema)

    return run


REMOVED = "doc long, sha string, n_removed long, kept_sha256 string, kept string"


class Automaton:
    """Passages as sequences of word numbers, with the smallest document where each starts."""

    def __init__(self):
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.numbers: dict[bytes, int] = {}
        self.size = 0

    def add(self, passage: bytes, first: int) -> None:
        key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in passage.split(b" "))
        self.trie.add_word(key, min(first, self.trie.get(key, first)))
        self.size += len(key)

    def mark(self, words: list[bytes], doc: int, covered: np.ndarray, width: int) -> None:
        """Cover the words of every passage that first starts before ``doc``."""
        get = self.numbers.get
        for end, first in self.trie.iter(tuple(get(w, 0) for w in words)):
            if first < doc:
                covered[end - width + 1 : end + 1] = True


def _stream(width: int, limit: int, with_text: bool):
    """Rows come by shard, its passages before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, machines, ready = None, [], False
        for batch in slices(batches, "text"):
            out = []
            for s, first, doc, sha, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "doc", "sha", "text")), strict=True):
                if s != shard:
                    shard, machines, ready = s, [Automaton()], False
                if doc is None:
                    if machines[-1].size > limit:
                        machines.append(Automaton())
                    machines[-1].add(text.encode(), first)
                    continue
                if not ready:
                    for m in machines:
                        m.trie.make_automaton()
                    ready = True
                words = text.encode().split()
                covered = np.zeros(len(words), bool)
                for m in machines:
                    if m.size:
                        m.mark(words, doc, covered, width)
                kept = b" ".join(w for w, c in zip(words, covered, strict=True) if not c)
                out.append((doc, sha, int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            yield _rows(out, REMOVED)

    return run


def substring_dedup(
    docs: DataFrame,
    width: int = 50,
    gram: int = 25,
    shard_docs: int = 1000,
    memory: int = 2_000_000,
    with_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Words left in each document after removing passages of ``width`` words seen in smaller ids.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Windows are judged on the input.
    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256
    (of the kept words joined by one space, UTF-8) and, with ``with_text``,
    kept_text.  Null or empty text has no words.  A null id counts as larger
    than any other.  Rows with the same id do not remove words of each other.
    Other columns are not read; an empty table gives no rows.

    ``gram`` sets the length of an anchor, ``shard_docs`` the documents of a
    shard.  ``memory`` bounds the windows that a task holds at once, and shards
    are as many as it takes for the passages that one asks for to have about
    half as many words, or those of one document.
    """
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = scratch.save(rows.mapInArrow(frugal(_summary(width, gram)), SUMMARY), "summary")

    # Rows with the same words: those after the smallest id repeat it whole.
    heads = every.where(F.col("n_words") >= width).groupBy("sha").agg(F.min("doc").alias("head"))
    heads = scratch.save(heads, "heads")
    first = every.join(heads, "sha").where(F.col("doc") == F.col("head")).dropDuplicates(["doc", "sha"])

    anchors = first.select("doc", "sha", F.explode("anchors").alias("anchor"))
    met = anchors.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("anchor")
    met = scratch.save(met, "met")  # a table, so that the join with it can be broadcast or split
    marked = anchors.join(met, "anchor").groupBy("doc", "sha").agg(F.collect_list("anchor").alias("anchors"))
    marked = scratch.save(marked, "marked")

    # The text of these documents alone takes part in what follows.
    held = scratch.save(rows.select("doc", "text").join(marked, "doc").mapInArrow(frugal(_right_rows), MARKED), "held")
    windows = held.mapInArrow(frugal(_windows(width, gram, memory)), WINDOWS)
    windows = scratch.save(windows, "windows")
    alone = windows.where("from_doc is null")
    starts = alone.groupBy("h").agg(F.min(F.struct("doc", "sha", "pos")).alias("s"), F.max("doc").alias("most")).where("s.doc < most").select("h", "s")
    far = alone.select("h", "doc", "sha", "pos", "more").join(scratch.save(starts, "starts"), "h").where("s.doc < doc")
    far = far.select("doc", "sha", "pos", "more", F.col("s.doc").alias("from_doc"), F.col("s.sha").alias("from_sha"), F.col("s.pos").alias("from_pos"))
    recurring = windows.where("from_doc is not null").select(*far.columns).unionByName(far)
    found = recurring.groupBy("doc", "sha").agg(F.collect_list(F.struct("pos", "more", "from_doc", "from_sha", "from_pos")).alias("found"))
    asked = scratch.save(found.mapInArrow(frugal(_cover(width)), ASKED), "asked")

    targets = asked.select("doc", "sha").distinct()
    n_shards = max(1, -(-targets.count() // shard_docs), -(-2 * width * asked.count() // memory))
    shards = F.pmod(F.hash("doc"), F.lit(n_shards)).cast("int")
    orders = asked.select(F.col("from_doc").alias("doc"), F.col("from_sha").alias("sha"), F.col("from_pos").alias("pos"), shards.alias("shard")).distinct()
    # the first document of a common passage is asked by every shard: 64 of them to a row
    orders = orders.groupBy("doc", "sha", F.floor(F.col("shard") / 64).alias("part")).agg(F.collect_list(F.struct("pos", "shard")).alias("asked"))
    text = held.select("doc", "sha", "text")
    passages = text.join(orders.drop("part"), ["doc", "sha"]).mapInArrow(frugal(_passages(width)), "shard int, first long, text string").distinct()
    none = F.lit(None)
    feed = passages.select("shard", "first", none.cast("long").alias("doc"), none.cast("string").alias("sha"), "text").unionByName(
        text.join(targets, ["doc", "sha"]).select(shards.alias("shard"), none.cast("long").alias("first"), "doc", "sha", "text")
    )
    streamed = feed.repartition("shard").sortWithinPartitions("shard", F.col("doc").asc_nulls_first()).mapInArrow(frugal(_stream(width, memory, with_text)), REMOVED)
    removed = scratch.save(streamed.dropDuplicates(["doc", "sha"]), "removed")
    scratch.drop("met", "marked", "held", "windows", "starts", "asked")

    out = every.drop("anchors").join(heads, "sha", "left").join(removed, ["doc", "sha"], "left")
    copy = F.col("head") < F.col("doc")
    columns = [
        F.col("doc_id"),
        F.col("n_words"),
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if not with_text:
        return out.select(*columns)
    whole = rows.select("doc", F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ").alias("whole"))
    whole = whole.withColumn("sha", F.sha2("whole", 256)).dropDuplicates(["doc", "sha"])
    return out.join(whole, ["doc", "sha"]).select(*columns, F.when(copy, F.lit("")).otherwise(F.coalesce("kept", "whole")).alias("kept_text"))

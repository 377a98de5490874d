"""Exact duplicates by Patricia-trie owners.

Every task inserts whole byte strings into compressed radix tries, one for
each (length, content hash) partition it meets; the terminal node of a string
keeps the smallest owner.  The work has two rounds.  Each input partition
first merges its own copies, so that the shuffle carries a text at most once
per input partition however many copies there are.  Those texts then meet in
(length, hash) partitions, whose tries name the owner over the whole table.
A trie that outgrows its allowance moves subtrees to a file of the task and
finishes them one at a time.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.llm.heap import frugal
from scorecal.llm.scratch import Scratch
from scorecal.llm.text import slices

LAST = 2**63 - 1


class Patricia:
    """A compressed radix trie over bytes; each terminal holds a merged value.

    ``limit`` bounds the bytes held.  Beyond it the largest subtrees under the
    root go to temporary files of this task, later keys of those branches are
    appended there, and ``items`` rebuilds one subtree at a time.
    """

    def __init__(self, merge, limit: int = 256 << 20):
        self.merge, self.limit = merge, limit
        self.root: list = [b"", {}, None]  # label, children by first byte, value
        self.held = 0
        self.spilled: dict[int, tempfile._TemporaryFileWrapper] = {}

    def insert(self, key: bytes, value) -> None:
        branch = key[0] if key else -1
        if branch in self.spilled:
            pickle.dump((key, value), self.spilled[branch])
            return
        node, at = self.root, 0
        while True:
            if at == len(key):
                node[2] = value if node[2] is None else self.merge(node[2], value)
                return
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, value]
                self.held += len(key) - at + 300
                if self.held > self.limit:
                    self._spill()
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _shared(label, key, at)
            middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = middle
            self.held += 300
            node, at = middle, at + same

    def _spill(self) -> None:
        sizes = {b: sum(len(k) + 300 for k, _ in _walk(c, b"")) for b, c in self.root[1].items()}
        for branch in sorted(sizes, key=sizes.get, reverse=True):
            if self.held <= self.limit // 2:
                break
            file = self.spilled[branch] = tempfile.TemporaryFile()
            for item in _walk(self.root[1].pop(branch), b""):
                pickle.dump(item, file)
            self.held -= sizes[branch]
        self.held = max(self.held, 0)

    def items(self) -> Iterator[tuple[bytes, object]]:
        yield from _walk(self.root, b"")
        self.root = [b"", {}, None]
        for branch, file in self.spilled.items():
            file.seek(0)
            below = Patricia(self.merge, max(self.limit, 1 << 20))
            while True:
                try:
                    key, value = pickle.load(file)
                except EOFError:
                    break
                below.insert(key[1:], value)  # one byte less, so that the next split is deeper
            file.close()
            first = bytes([branch])
            for key, value in below.items():
                yield first + key, value


def _walk(node: list, prefix: bytes) -> Iterator[tuple[bytes, object]]:
    stack = [(node, prefix)]
    while stack:
        (label, children, value), above = stack.pop()
        key = above + label
        if value is not None:
            yield key, value
        stack.extend((c, key) for c in children.values())


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:], by halving."""
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        half = (lo + hi + 1) // 2
        if label[:half] == key[at : at + half]:
            lo = half
        else:
            hi = half - 1
    return lo


def owner(a: tuple, b: tuple) -> tuple:
    """Merge b into terminal a: the smallest (-code points, doc_id, row) owns, members are added in place."""
    a[2].extend(b[2])
    return min(a[0], b[0]), a[1] + b[1], a[2]


def _key(sha: bytes, raw: bytes) -> bytes:
    return sha[:8] + len(raw).to_bytes(8, "big") + raw


LOCAL = "doc_id long, row long, class long, text_sha256 string, n_bytes long, norm string, owner_chars long, owner_id long, owner_row long, copies long"
GLOBAL = "class long, keep_id long, keep_row long, group_size long"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _batched(rows: Iterator[tuple[tuple, int]], schema: str) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row, weight in rows:
        part.append(row)
        size += weight + 64
        if size > 4 << 20:
            yield _table(part, schema)
            part, size = [], 0
    if part:
        yield _table(part, schema)


def _local_round(limit: int):
    """Merge the copies within an input partition; the first member carries the text."""

    def finish(trie: Patricia) -> Iterator[tuple[tuple, int]]:
        for key, (best, copies, members) in trie.items():
            raw = key[16:]
            sha = hashlib.sha256(raw).hexdigest()
            name = members[0][0]
            for row, doc in members:
                if row == name:
                    yield (doc, row, name, sha, len(raw), raw.decode(), *best, copies), len(raw)
                else:
                    yield (doc, row, name, sha, len(raw), None, None, None, None, None), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        trie, held = Patricia(owner, 4 * limit), 0
        for batch in slices(batches, "norm", 4 << 20):
            for doc, text, chars in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "norm", "chars")), strict=True):
                raw = text.encode()
                best = (-chars, LAST if doc is None else doc, row)
                trie.insert(_key(hashlib.sha256(raw).digest(), raw), (best, 1, [(row, doc)]))
                row += 1
                held += 200
            if trie.held + held > limit:
                yield from _batched(finish(trie), LOCAL)
                trie, held = Patricia(owner, 4 * limit), 0
        yield from _batched(finish(trie), LOCAL)

    return run


def _global_round(limit: int):
    """Merge the classes of all input partitions; every class learns its owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia(owner, limit)
        for batch in slices(batches, "norm", 4 << 20):
            columns = (batch.column(c).to_pylist() for c in ("norm", "text_sha256", "class", "owner_chars", "owner_id", "owner_row", "copies"))
            for text, sha, name, chars, doc, row, copies in zip(*columns, strict=True):
                trie.insert(_key(bytes.fromhex(sha), text.encode()), ((chars, doc, row), copies, [name]))
        yield from _batched((((name, best[1], best[2], copies), 0) for _, (best, copies, names) in trie.items() for name in names), GLOBAL)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 96 << 20) -> DataFrame:
    """Owner of every row's exact-content group.

    Texts are equal when identical after deleting every character of
    ``[\\x20\\x09-\\x0D]``.  The row with the most code points in the original
    text, then the smallest id, then the earliest row, stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256.  Null text counts as empty; empty texts are equal to each
    other.  A null id sorts after all others.  Rows with the same id are
    separate rows, of which at most one is kept per group.  Other columns of
    ``docs`` are not read; an empty table gives an empty result.

    ``memory`` bounds the bytes a task's trie holds: the first round starts a
    new trie beyond it, the second spills subtrees.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.translate(text, " \t\n\x0b\f\r", "").alias("norm"),
        F.char_length(text).cast("long").alias("chars"),
    )
    local = scratch.save(rows.mapInArrow(frugal(_local_round(memory)), LOCAL), "local")
    classes = local.where(F.col("norm").isNotNull()).drop("doc_id", "row", "n_chars")
    owners = classes.repartition("n_bytes", "text_sha256").mapInArrow(frugal(_global_round(memory)), GLOBAL)
    return (
        local.select("doc_id", "row", "class", "text_sha256")
        .join(owners, "class")
        .select(
            "doc_id",
            F.when(F.col("keep_id") != LAST, F.col("keep_id")).alias("keep_id"),
            "group_size",
            (F.col("row") == F.col("keep_row")).alias("kept"),
            "text_sha256",
        )
    )

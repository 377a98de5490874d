"""Harmonic packing of tokenised documents into fixed-length sequences.

A document is cut into pieces of the capacity C, of C/2, C/4, ... down to
``min_cut`` tokens, and one last piece below that.  A piece of more than
C/(j+1) and at most C/j tokens is of class j, and a bin of class j takes
exactly j pieces, so a bin needs no look at any other class or worker.  Pieces
of C/2^i tokens leave no room at all; the last pieces leave less than one of
their own length.  What a worker has left of all classes at its end is laid
end to end, cut at C, and the rest cut into powers of two, which need no
padding.  Nothing is shuffled.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.llm.heap import frugal
from scorecal.llm.text import same_spans, slices, span_hashes, utf8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_KINDS = [pa.int64()] * 7
_NAMES = [x.split()[0] for x in PIECES.split(", ")]

# A space before one of these bytes always begins a pre-token of the byte-level
# pattern: printable ASCII, or a lead byte under which no white space is coded.
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x21:0x7F] = True
_FOLLOWS[0xC3:0xF5] = True
_FOLLOWS[[0xE1, 0xE2, 0xE3]] = False
_SPACED = frozenset(bytes([0x20, b]) for b in np.flatnonzero(_FOLLOWS).tolist())

# Kinds of bytes between which the pattern splits wherever they meet.
_LETTER, _DIGIT, _MARK, _QUOTE, _NEWLINE = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27], _KIND[0x0A] = _QUOTE, _NEWLINE
_PLAIN = frozenset(np.flatnonzero((_KIND > 0) & (_KIND < _QUOTE)).tolist())
_APART = np.zeros((6, 6), bool)
_APART[_LETTER:_QUOTE, _LETTER:_QUOTE] = ~np.eye(3, dtype=bool)
_APART[_LETTER:_QUOTE, _NEWLINE] = True
_APART[[_LETTER, _DIGIT], _QUOTE] = True  # a quote after a mark goes on with it; letters after a quote may
RUN = 1 << 12  # bytes of chunks that are encoded end to end, about; long runs cost more a byte
SLICE = 4 << 20  # bytes of texts whose chunks are told apart together


class Encoder:
    """Ids of whole texts by a byte-level tokenizer, encoding each distinct chunk once.

    Chunks begin at texts, at spaces and between letters, digits and marks where
    the tokenizer's own pattern always splits, so the ids are those of the whole
    text.  Added tokens of the vocabulary hold no space and are not cut, so none
    lies across chunks.  Chunks that hash alike are compared byte for byte.
    """

    def __init__(self, path: str, remember: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.width[number] = len(token)  # a byte-level token has one letter for each byte
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.filed = 0
        self.flat, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.slices = np.zeros(1 << 16, np.int8)

    def _shrink(self) -> None:
        """Forget the chunks that one slice only has met; all, if that leaves too many."""
        kept = {c: n for c, n in self.known.items() if self.slices[n] > 1}
        if len(kept) > self.remember // 2:
            kept = {}
        number = np.fromiter(kept.values(), np.int64, len(kept))
        begin, met = self.at[number], self.slices[number]
        length = self.at[number + 1] - begin
        flat, out = self._ids(begin, length)
        self._forget()
        self.flat, self.at = np.append(flat, self.flat), np.append(out, self.at)
        self.slices = np.append(np.minimum(met, 2) - 1, self.slices)  # to stay again, each is met again
        self.filed = len(kept)
        self.known = dict(zip(kept, range(len(kept)), strict=True))

    def _ids(self, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filed ids of some chunks end to end, and n + 1 offsets."""
        out = np.concatenate([[0], np.cumsum(length)])
        return self.flat[np.repeat(begin - out[:-1], length) + np.arange(out[-1])], out

    def _learn(self, new: list[bytes]) -> None:
        """Encode chunks, end to end as far as that leaves their ids alone, and file the ids."""
        spaced, framed, rest = [], [], []
        for c in new:
            if c[:2] in _SPACED:
                spaced.append(c)
            elif c[0] in _PLAIN and c[-1] in _PLAIN:
                framed += (c, b"\n")  # one line end between two such chunks is a chunk itself
            else:
                rest.append(c)
        runs = [*_runs(spaced), *_runs(framed), *([c] for c in rest)]
        found = self.tokenizer.encode_batch_fast([b"".join(r).decode() for r in runs], add_special_tokens=False)
        ids = np.concatenate([np.array(f.ids, np.uint32) for f in found])
        order = [c for r in runs for c in r]
        edge = np.concatenate([[0], np.cumsum(self.width[ids])])
        ends = np.searchsorted(edge, np.cumsum(np.fromiter(map(len, order), np.int64, len(order))))
        n, used = self.filed, self.at[self.filed]
        while n + len(order) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while n + len(order) >= len(self.slices):
            self.slices = np.concatenate([self.slices, np.zeros_like(self.slices)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.at[n + 1 : n + 1 + len(order)] = used + ends
        self.filed += len(order)
        self.known.update(zip(order, range(n, self.filed), strict=True))

    @staticmethod
    def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct chunk, and which of them each chunk is."""
        _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        like, size = sample[which], ends - starts
        apart = size != size[like]
        apart[~apart] = ~same_spans(data, starts[~apart], starts[like[~apart]], size[~apart])
        for i in np.flatnonzero(apart):  # a hash that two chunks share: the second stands for itself
            which[i] = len(sample)
            sample = np.append(sample, i)
        return sample, which

    def _cuts(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin, and the end."""
        kind = _KIND[data]
        # U+00C0 to U+00FF are letters but for two
        at = np.flatnonzero(data[:-1] == 0xC3)
        at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
        kind[at] = kind[at + 1] = _LETTER
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = _APART.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
        # One line end by itself; of several before a word the pattern takes the last apart.
        cut[2:-1] |= cut[1:-2] & (kind[1:-1] == _NEWLINE) & (kind[2:] > 0) & (kind[2:] < _NEWLINE)
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                cut[at + 1 : at + len(token)] = False
                at = raw.find(token, at + 1)
        cut[:-2] |= (data[:-1] == 0x20) & _FOLLOWS[data[1:]]
        cut[offsets] = True
        return cut

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and n + 1 offsets."""
        data, offsets = utf8(column)
        raw = data.tobytes()
        edges = np.flatnonzero(self._cuts(data, raw, offsets))
        if len(edges) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends = edges[:-1], edges[1:]
        hashes = np.concatenate([span_hashes(data[s:e], s_, e_) for s, e, s_, e_ in _blocks(starts, ends)])
        sample, which = self._distinct(data, starts, ends, hashes)
        chunks = [raw[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)]
        if len(self.known) > self.remember:
            self._shrink()
        number = [self.known.get(c, -1) for c in chunks]
        if new := [i for i, n in enumerate(number) if n < 0]:
            self._learn(list(dict.fromkeys(chunks[i] for i in new)))
            for i in new:
                number[i] = self.known[chunks[i]]
        number = np.array(number, np.int64)
        self.slices[number] = np.minimum(self.slices[number], 1) + 1
        number = number[which]
        begin = self.at[number]
        ids, out = self._ids(begin, self.at[number + 1] - begin)
        return ids, out[np.searchsorted(edges, offsets)]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, which remembers chunks from task to task."""
    return Encoder(path)


def _runs(chunks: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks in lists of about RUN bytes."""
    ends, at = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))), 0
    while at < len(chunks):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN)) + 1
        yield chunks[at:stop]
        at = stop


def _blocks(starts: np.ndarray, ends: np.ndarray, size: int = 2 << 20) -> Iterator[tuple]:
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + size, side="right")))
        yield starts[at], ends[stop - 1], starts[at:stop] - starts[at], ends[at:stop] - starts[at]
        at = stop


def cuts(n: int, capacity: int, min_cut: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    size = capacity
    while size >= 2 * min_cut and not size % 2:
        size //= 2
        if rest >= size:
            out.append(size)
            rest -= size
    while rest >= size:  # a capacity that is no power of two
        out.append(size)
        rest -= size
    return out + [rest] * (rest > 0)


class Bins:
    """One worker's open bins, by class."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.out: list[tuple] = []

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        j = self.capacity // len(ids)
        held = self.open[j]
        held.append((doc, start, ids, total))
        if len(held) == j:
            self._emit(held)
            del self.open[j]

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def close(self) -> None:
        """Lay what is left end to end and cut it at C, then at powers of two."""
        left = [p for j in sorted(self.open) for p in self.open[j]]
        self.open.clear()
        tokens = sum(len(p[2]) for p in left)
        room, held = 0, []
        for doc, start, ids, total in left:
            while len(ids):
                if not room:
                    room = self.capacity if tokens >= self.capacity else 1 << (tokens.bit_length() - 1)
                n = min(room, len(ids))
                held.append((doc, start, ids[:n], total))
                start, ids, room, tokens = start + n, ids[n:], room - n, tokens - n
                if not room:
                    self._emit(held)
                    held = []

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, min_cut: int = 64, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their places in sequences of ``capacity`` tokens.

    A document's tokens are the ids of its text (null: empty) and ``end_id``.
    Returns one row per piece: doc_id, start, length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset.
    Every id lies in exactly one piece; offsets in a sequence are gapless from
    0.  A sequence is padded to the capacity unless its length is a power of
    two.  An empty text is one piece of one token.  Rows that repeat an id are
    packed as documents of their own.  Other columns are not read; an empty
    table gives no pieces.  The result depends on how the rows lie in
    partitions, so read the documents from a table where it must be
    repeatable.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = _encoder(tokenizer), Bins(capacity, TaskContext.get().partitionId() << 40)
        for batch in slices(batches, "text", SLICE):
            ids, at = encode(batch.column("text"))
            for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                whole = np.append(ids[lo:hi], np.uint32(end_id))
                start = 0
                for n in cuts(len(whole), capacity, min_cut):
                    bins.add(doc, start, whole[start : start + n], len(whole))
                    start += n
            yield bins.take()
        bins.close()
        yield bins.take()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), PIECES)

"""Vectorised word and character hashing for Arrow batches.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``.  All hashes
are 64-bit and the same on every worker.  They are chains of non-linear mixing
steps, so that no pattern within words or among them makes two collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"

_LONG = 64  # bytes of a word beyond which xxHash takes over
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_JOIN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    return mix(a * _JOIN + b)


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all slices of k values, built from slices of 1, 2, 4, ... values."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    out, have, part, width = None, 0, values, 1
    while k:
        if k & 1:
            out = part if out is None else join(out[: len(part) - have], part[have:])
            have += width
        k >>= 1
        if k:
            part = join(part[:-width], part[width:])
            width *= 2
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def byte_windows(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes; without collisions up to 8."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eights = _eights(data)
    if k <= 8:
        return mix((eights[:n] & _MASK[k]) + np.uint64(k))
    out = mix(eights[:n] + np.uint64(k))
    for at in range(8, k, 8):
        out = join(out, eights[at : at + n] & _MASK[min(k - at, 8)])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, eight bytes a step; of long spans by xxHash."""
    eights, size = _eights(data), ends - starts
    out = mix(size.astype(np.uint64) + _JOIN)
    live = np.flatnonzero(size <= _LONG)
    at, left = starts[live], size[live]
    while len(live):
        out[live] = join(out[live], eights[at] & _MASK[np.minimum(left, 8)])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, others: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of both spans of each pair, of the same size, are equal."""
    eights = _eights(data)
    out = np.ones(len(starts), bool)
    live = np.flatnonzero(starts != others)
    long = live[size[live] > _LONG]
    live = live[size[live] <= _LONG]
    a, b, left = starts[live], others[live], size[live]
    while len(live):
        mask = _MASK[np.minimum(left, 8)]
        equal = (eights[a] & mask) == (eights[b] & mask)
        out[live[~equal]] = False
        more = equal & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    for i in long:
        out[i] = np.array_equal(data[starts[i] : starts[i] + size[i]], data[others[i] : others[i] + size[i]])
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = utf8(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of some texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~inside[:-1]
        after[:-1] |= ~inside[1:]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        data = _LOWER[data] if lower else data
        parts, word = [], 0
        while word < len(self.starts):  # blocks of whole words
            origin = self.starts[word]
            stop = max(word + 1, int(np.searchsorted(self.ends, origin + BLOCK, side="right")))
            begin, end = self.starts[word:stop], self.ends[word:stop]
            parts.append(span_hashes(data[origin : end[-1]], begin - origin, end - origin))
            word = stop
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    @classmethod
    def of(cls, column: pa.Array, lower: bool = False) -> Words:
        return cls(*utf8(column), lower=lower)

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Text i's words joined by one space; ``keep`` selects among them."""
        lo, hi = self.first[i], self.first[i + 1]
        raw = self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split()
        assert len(raw) == hi - lo
        return b" ".join(raw if keep is None else [w for w, k in zip(raw, keep, strict=True) if k])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and where each text's runs begin."""
        count = np.maximum(np.diff(self.first) - (k - 1), 0)
        first = np.concatenate([[0], np.cumsum(count)])
        total = len(self.hashes)
        if total < k:
            return np.zeros(0, np.uint64), first
        parts = []
        step = 1 << 20
        for at in range(0, total - k + 1, step):
            stop = min(at + step, total - k + 1)
            parts.append(windows(self.hashes[at : stop + k - 1], k))
        every = np.concatenate(parts)
        whole = np.zeros(total - k + 1, bool)
        for lo, n in zip(self.first[:-1], count, strict=True):
            whole[lo : lo + n] = True
        return every[whole], first


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])

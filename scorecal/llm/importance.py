"""Importance resampling towards a target, from CRCs of n-grams composed of their words' CRCs.

CRC-32 is linear over GF(2): the CRC of a joined string is that of its head,
moved over the tail's length by a 32 x 32 bit matrix, xor that of its tail.
So each word is read once, and no n-gram string is ever built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.llm.blanks import lowering, pieces
from scorecal.llm.heap import frugal
from scorecal.llm.scratch import Scratch
from scorecal.operators.ranges import in_ranges, with_places

TABLE = lowering(b"0123456789")
POLYNOMIAL = 0xEDB88320  # fixed value: of CRC-32, bits reversed
SHORT = 32  # bytes up to which a move has a table of its own
WORDS = 1 << 18  # words that are worked on at once
BLANK = crc32(b" ")


def _times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The bit matrix, given as its 32 columns, times each vector."""
    out = np.zeros(len(vectors), np.uint32)
    for bit in range(32):
        out ^= np.where((vectors >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _byte_move() -> np.ndarray:
    """The matrix that moves a CRC over one zero byte."""
    bit = np.array([POLYNOMIAL, *(1 << k for k in range(31))], np.uint32)
    for _ in range(3):
        bit = _times(bit, bit)
    return bit


def _lookup(matrix: np.ndarray) -> np.ndarray:
    """The matrix as 4 tables, one for each byte of a CRC."""
    every = np.arange(256, dtype=np.uint32)
    return np.stack([_times(matrix, every << np.uint32(8 * b)) for b in range(4)])


def _moves() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for 0 to SHORT bytes, and for 1, 2, 4, ... bytes."""
    one = _byte_move()
    power, powers = one, []
    for _ in range(32):
        powers.append(_lookup(power))
        power = _times(power, power)
    now, short = np.array([1 << k for k in range(32)], np.uint32), []
    for _ in range(SHORT + 1):
        short.append(_lookup(now))
        now = _times(one, now)
    return np.stack(short), powers


MOVES, POWERS = _moves()


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & np.uint32(255)]
    for b in range(1, 4):
        out ^= table[b][(crc >> np.uint32(8 * b)) & np.uint32(255)]
    return out


def moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each CRC moved over its number of bytes."""
    near = np.minimum(size, SHORT)
    out = MOVES[near, 0, crc & np.uint32(255)]
    for b in range(1, 4):
        out ^= MOVES[near, b, (crc >> np.uint32(8 * b)) & np.uint32(255)]
    for k in np.flatnonzero(size > SHORT):
        one = crc[k : k + 1]
        for bit in range(int(size[k]).bit_length()):
            if size[k] >> bit & 1:
                one = _apply(POWERS[bit], one)
        out[k] = one[0]
    return out


def gram_crcs(crc: np.ndarray, size: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: the places of the last words and the CRCs of all runs of n words joined by a blank.

    ``place`` counts the words of a text from 0, so that no run crosses texts.
    """
    out, runs = [(np.arange(len(crc)), crc)], crc
    tail = moved(np.full(len(crc), BLANK, np.uint32), size) ^ crc  # " word"
    for n in (2, 3):
        grown = moved(runs[:-1], size[1:] + 1) ^ tail[1:]
        runs = np.concatenate([crc[:1], grown])
        last = np.flatnonzero(place >= n - 1)
        out.append((last, runs[last]))
    return out


class Features:
    """The buckets of all features of a stream of texts, given out in bounded parts."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.words: list[bytes] = []
        self.places: list[range] = []
        self.rows: list[tuple[int, int]] = []
        self.before = 0  # words at the front that have been given out as last words

    def add(self, row: int, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        place = 0
        for piece in pieces(text.translate(TABLE)):
            found = piece.split()
            self.words += found
            self.places.append(range(place, place + len(found)))
            self.rows.append((row, len(found)))
            place += len(found)
            if len(self.words) >= WORDS:
                yield self.given_out()

    def given_out(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, buckets) of the features that end in the words gathered; the last two words stay for the next part."""
        n = len(self.words)
        crc = np.fromiter(map(crc32, self.words), np.uint32, n)
        size = np.fromiter(map(len, self.words), np.int64, n)
        place = np.concatenate([np.arange(r.start, r.stop) for r in self.places] or [np.zeros(0, np.int64)])
        row = np.repeat([r for r, _ in self.rows], [k for _, k in self.rows]).astype(np.int64)
        rows, found = [], []
        for last, crcs in gram_crcs(crc, size, place) if n else []:
            new = last >= self.before
            rows.append(row[last[new]])
            found.append(crcs[new] % np.uint32(self.buckets))
        keep = min(2, n)
        self.words, self.before = self.words[n - keep :], keep
        self.places = [range(p, p + 1) for p in place[n - keep :].tolist()]
        self.rows = [(r, 1) for r in row[n - keep :].tolist()]
        return (np.concatenate(rows), np.concatenate(found)) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def bucket_counts(texts: DataFrame, buckets: int, column: str = "text") -> DataFrame:
    """(bucket, n) of all features of the texts; each task sends its sums once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, features = np.zeros(buckets, np.int64), Features(buckets)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features.add(0, text.as_py()):
                    total += np.bincount(found, minlength=buckets)
        total += np.bincount(features.given_out()[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    blob = texts.select(F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("t"))
    return blob.mapInArrow(frugal(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket from two count tables of at most ``buckets`` rows."""
    counts = []
    for table in (corpus, target):
        own = np.zeros(buckets, np.int64)
        for r in table.collect():
            own[r["bucket"]] = r["n"]
        counts.append(own.tolist())
    s, t = counts
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log(((b + 1) * all_s) / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def _gumbel(first: str) -> int:
    return math.floor(-1000 * math.log(-math.log((int(first, 16) + 0.5) / 4294967296)))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10000, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    Features are all runs of 1 to 3 words, in ``buckets`` by CRC-32.  A
    bucket's gain compares its smoothed share of the target's texts with that
    of all documents'; a document weighs the sum over its features.  Of the
    documents of ``min_words`` words, ``percent`` of a hundred are drawn without
    replacement by weight plus Gumbel noise from a hash of doc_id.

    Null and empty texts have no features and weigh 0.  A null doc_id hashes
    as an empty one.  Ties go to the smaller doc_id, null first; repeated rows
    are documents of their own, in any order among each other.  Texts of any
    length are worked on in parts.  Other columns are ignored; an empty table
    gives none.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    known = docs.sparkSession.sparkContext.broadcast(gains)  # ``buckets`` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = known.value
        for batch in batches:
            n = batch.num_rows
            weight, count, words, features = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), Features(buckets)

            def take(rows: np.ndarray, found: np.ndarray) -> None:
                if len(rows):
                    order = np.argsort(rows, kind="stable")
                    at, first = np.unique(rows[order], return_index=True)
                    weight[at] += np.add.reduceat(gain[found[order]], first)
                    count[at] += np.diff(np.append(first, len(rows)))

            for i, text in enumerate(batch.column("t")):
                for part in features.add(i, text.as_py()):
                    take(*part)
            take(*features.given_out())
            words[:] = np.where(count >= 3, (count + 3) // 3, (count + 1) // 2)  # n words: 3 n - 3 features, 1 or 3 with one or two
            score = weight + np.array([_gumbel(h) for h in batch.column("h").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (count, weight, score, words >= min_words))], ["doc_id", "n_features", "weight", "score", "_in"])

    hashed = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t"), hashed.alias("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(frugal(run), f"doc_id {kind}, n_features long, weight long, score long, _in boolean")
    written = scratch.save(scored, "scores")
    ordered = scratch.save(in_ranges(written, F.col("_in").desc(), F.col("score").desc(), F.col("doc_id").asc()), "ranges")
    drawn = percent * written.where("_in").count() // 100
    placed = with_places(ordered, "rank").withColumn("rank", F.when(F.col("_in") & (F.col("rank") < drawn), F.col("rank") + 1))
    return placed.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))

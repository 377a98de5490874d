"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecal.llm.features import byte_grams, hinge, probability, shape_grams, sigmoid_fit, word_shapes
from scorecal.llm.heap import frugal
from scorecal.llm.text import BLOCK, Words, slices

BITS = 16
SIZE = 1 << BITS


def indicators(words: Words, i: int, shapes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The features of text i: byte 2- to 4-grams, and 1- to 3-grams of word shapes.

    ``seen`` is a clean array of SIZE + 1 flags to work with; the last feature is a bias.
    """
    data = words.data[words.offsets[i] : words.offsets[i + 1]]
    for at in range(0, max(1, len(data)), BLOCK):
        seen[byte_grams(data[max(0, at - 3) : at + BLOCK], (2, 3, 4), BITS)] = True
    seen[shape_grams(shapes[words.first[i] : words.first[i + 1]], BITS)] = True
    seen[SIZE] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Log ratio of each feature's smoothed share among the two classes; 1 for the bias."""
    p, q = np.ones(SIZE + 1), np.ones(SIZE + 1)
    for at, one in zip(rows, positive, strict=True):
        (p if one else q)[at] += 1
    ratio = np.log((p / (positive.sum() + 2)) / (q / ((~positive).sum() + 2)))
    ratio[SIZE] = 1.0
    return ratio


class Constant:
    """Without labelled texts of both classes: the smoothed share of label 1 for every text."""

    def __init__(self, positive: int, n: int):
        self.share = (positive + 1) / (n + 2)

    def score(self, at: np.ndarray) -> float:
        return self.share


class QualityModel:
    """weights already hold the ratios; margin = sum of weights over indicators / norm of the scaled indicators."""

    def __init__(self, rows: list[np.ndarray], positive: np.ndarray, cost: float = 5.0, fit: bool = True):
        labels = np.where(positive, 1.0, -1.0)
        self.ratio = log_count_ratios(rows, positive)
        share = np.where(positive, positive.mean(), 1 - positive.mean())
        self.weights = hinge([(x, self._scaled(x)) for x in rows], labels, SIZE + 1, cost * 0.5 / np.maximum(share, 1e-9))
        if fit:  # to margins of two further models, each on the half of the rows that the other has learned from
            order = np.argsort(~positive, kind="stable")
            half = np.zeros(len(rows), bool)
            half[order[::2]] = True  # of either class
            margins = np.zeros(len(rows))
            for own in (half, ~half):
                other = QualityModel([rows[i] for i in np.flatnonzero(~own)], positive[~own], cost, fit=False)
                margins[own] = [other.margin(rows[i]) for i in np.flatnonzero(own)]
            self.fit = sigmoid_fit(margins, labels)

    def _scaled(self, at: np.ndarray) -> np.ndarray:
        x = self.ratio[at]
        return x / max(np.linalg.norm(x), 1e-12)

    def margin(self, at: np.ndarray) -> float:
        return float(np.dot(self.weights[at], self._scaled(at)))

    def score(self, at: np.ndarray) -> float:
        return float(probability(self.margin(at), self.fit))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(SIZE + 1, bool)
    for batch in slices(batches, "text"):
        words = Words.of(batch.column("text"))
        shapes = word_shapes(words)
        found = [indicators(words, i, shapes, seen) for i in range(batch.num_rows)]
        yield pa.record_batch([batch.column("key"), batch.column("label"), pa.array([x.astype(np.int32).tobytes() for x in found])], ["key", "label", "at"])


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | Constant:
    """Learn from about ``per_class`` labelled texts of each class among the ids where ``learn`` holds.

    ``learn`` is an expression of the column ``id``.  The bounded sample is
    the rows whose hash falls under per_class / rows; its ids, of which there
    are about 2 * per_class whatever the tables' sizes, are broadcast.  An id
    with several labels counts by the least, one with several texts by one of them.  Without texts of both classes the
    score is a constant, the smoothed share of label 1 among those drawn.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(learn & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    size = known.groupBy("label").agg(F.count("*").alias("of"))
    drawn = known.join(F.broadcast(size), "label").where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(1_000_003.0) * per_class / F.col("of"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn.select("id", "label")), "id")
    # an id counts once, by the text of its smallest hash
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("key"), "label", "text").mapInArrow(frugal(_features), "key long, label int, at binary").collect()
    rows.sort(key=lambda r: r["key"])
    positive = np.array([r["label"] == 1 for r in rows], bool)
    if not positive.any() or positive.all():
        return Constant(int(positive.sum()), len(rows))
    return QualityModel([np.frombuffer(r["at"], np.int32).astype(np.int64) for r in rows], positive)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from its whole text only.

    Labels are learned from ids whose crc32(id as text) mod 5 is not 0; the
    others are held out (a null id is not).  The score, from 0 to 1, is the
    probability of label 1; predicted is 1 where it reaches ``threshold``.
    Null and empty texts get the score of a text without n-grams.  Without labels
    of both classes all rows get one score (see ``fit_quality``).  Rows that
    repeat an id are scored each by its own text.  An empty table gives an
    empty result.
    """
    held = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(5)) == 0, F.lit(False))
    spark = docs.sparkSession
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, held_out boolean, score double, predicted int")
    model = spark.sparkContext.broadcast(fit_quality(docs, labels, ~held(F.col("id")), per_class, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = np.zeros(SIZE + 1, bool), model.value
        for batch in slices(batches, "text"):
            words = Words.of(batch.column("text"))
            shapes = word_shapes(words)
            scores = [own.score(indicators(words, i, shapes, seen)) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), "doc_id long, score double")
    return out.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

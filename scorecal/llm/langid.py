"""Language identification by family, then one-versus-one linear SVMs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecal.llm.features import counts, hinge, probability, sigmoid_fit
from scorecal.llm.heap import frugal
from scorecal.llm.text import slices, utf8

# Families of ISO 639-1 codes.  Codes not listed share families of MOST, by name.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "iranian": ["fa", "ku", "ps"],
    "semitic": ["am", "ar", "he", "mt"],
    "malayic": ["id", "jv", "ms", "tl"],
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
MOST = 12  # languages of a family of codes that are not listed
BITS = 15
ORDERS = (1, 2, 3)


def family_of(langs: list[str]) -> dict[str, str]:
    """The family of each of some distinct languages."""
    others = sorted(x for x in langs if x not in FAMILY)
    return {x: FAMILY[x] for x in langs if x in FAMILY} | {x: f"others {i // MOST}" if len(others) > MOST else f"only {x}" for i, x in enumerate(others)}


def vector(data: np.ndarray) -> np.ndarray:
    """Square roots of n-gram counts, of length 1."""
    found = np.sqrt(counts(data, ORDERS, BITS))
    return found / max(np.linalg.norm(found), 1e-12)


class Duel:
    """A linear SVM between two classes, with a probability for the first.

    The probability is fitted to margins of two further machines, each on the
    half of the rows that the other has learned from.
    """

    def __init__(self, rows: list, first: np.ndarray):
        labels = np.where(first, 1.0, -1.0)
        cost = np.where(first, 0.5 / max(first.mean(), 1e-9), 0.5 / max((~first).mean(), 1e-9)) * 10
        learn = lambda at: hinge([rows[i] for i in at], labels[at], 1 << BITS, cost[at])
        order = np.argsort(~first, kind="stable")
        half = np.zeros(len(rows), bool)
        half[order[::2]] = True  # of either class
        margins = np.zeros(len(rows))
        for own in (half, ~half):
            weights = learn(np.flatnonzero(~own))
            margins[own] = [np.dot(weights[rows[i][0]], rows[i][1]) for i in np.flatnonzero(own)]
        self.fit = sigmoid_fit(margins, labels)
        self.weights = learn(np.arange(len(rows)))


class Round:
    """All duels among some classes."""

    def __init__(self, rows: list, names: np.ndarray):
        self.names = sorted(set(names))
        self.pairs = list(combinations(range(len(self.names)), 2))
        duels = []
        for a, b in self.pairs:
            of = np.flatnonzero((names == self.names[a]) | (names == self.names[b]))
            duels.append(Duel([rows[i] for i in of], names[of] == self.names[a]))
        self.weights = np.array([d.weights for d in duels], np.float32).reshape(len(duels), 1 << BITS)
        self.fits = [d.fit for d in duels]

    def winner(self, x: np.ndarray) -> tuple[str, float]:
        """The class with most duels won, then the surest; and its least sure win."""
        if not self.pairs:
            return self.names[0], 1.0
        wins, sure = np.zeros(len(self.names)), np.zeros((len(self.names),) * 2)
        for (a, b), margin, fit in zip(self.pairs, self.weights @ x, self.fits, strict=True):
            p = probability(margin, fit)
            wins[a if p >= 0.5 else b] += 1
            sure[a, b], sure[b, a] = p, 1 - p
        best = max(range(len(self.names)), key=lambda i: (wins[i], sure[i].sum(), -i))
        return self.names[best], float(min(sure[best, j] for j in range(len(self.names)) if j != best))


class LanguageModel:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        langs = np.array(langs)
        of = family_of(sorted(set(langs)))
        family = np.array([of[x] for x in langs])
        self.families = Round(rows, family)
        self.within = {f: Round([rows[i] for i in np.flatnonzero(family == f)], langs[family == f]) for f in self.families.names}

    def predict(self, data: np.ndarray) -> tuple[str, float]:
        x = vector(data)
        family, p = self.families.winner(x)
        lang, q = self.within[family].winner(x)
        return lang, p * q


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, at = utf8(batch.column("text"))
        found = [vector(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        places = [np.flatnonzero(x) for x in found]
        yield pa.record_batch([batch.column("key"), batch.column("lang"), pa.array([p.astype(np.uint16).tobytes() for p in places]), pa.array([x[p].astype(np.float32).tobytes() for x, p in zip(found, places, strict=True)])], ["key", "lang", "at", "value"])


def fit_languages(docs: DataFrame, learn: Column, per_language: int = 600, max_languages: int = 200, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageModel | None:
    """Learn from about ``per_language`` texts of each language among the rows where ``learn`` holds.

    The sample is the rows whose hash falls under per_language / rows, so its
    size is bounded whatever the table's; repeated rows count once, and what reaches the driver is each
    text's hashed counts, of at most 2**15 features.  Of more than
    ``max_languages`` languages the most frequent ones are learned, then the
    first by name, which bounds the model: at most some 1700 duels of 128 KB.
    Without any row to learn from there is no model.
    """
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counted = usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("of"))
    size = {r["lang"]: r["of"] for r in counted.orderBy(F.col("of").desc(), "lang").limit(max_languages).collect()}
    if not size:
        return None
    share = F.create_map(*(F.lit(x) for lang, of in sorted(size.items()) for x in (lang, per_language / of)))
    drawn = usable.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    drawn = drawn.where(F.pmod("key", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    drawn = drawn.dropDuplicates(["key"])  # a repeated row counts once
    rows = sorted(drawn.mapInArrow(frugal(_vectors), "key long, lang string, at binary, value binary").collect(), key=lambda r: r["key"])
    return LanguageModel([(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float)) for r in rows], [r["lang"] for r in rows])


def _guesses(held):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        for column in texts:
            data, at = utf8(column)
            found = [("und", 0.0) if model is None or not known else model.predict(data[a:b]) for known, a, b in zip(column.is_valid().to_pylist(), at[:-1], at[1:], strict=True)]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "p"])

    return run


def predict_languages(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns, lang_pred and score.

    The whole text counts; other columns are never inputs.  A text that is
    null or has no letter is ``und`` with score 0, as is any text without a model.  Every other row gets a
    language the model has learned; the score, from 0 to 1, is the probability
    of the family times that of the language within it.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, p double")
    def guess(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return frugal(_guesses(held))(texts)

    guess = guess.asNondeterministic()  # a filter on its result would evaluate it once more
    letters = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), guess(letters).alias("guess"))
    return whole.select(*(F.col("row").getField(c).alias(c) for c in names), F.col("guess.lang").alias("lang_pred"), F.col("guess.p").alias("score"))


def identify_languages(docs: DataFrame, learn: Column | None = None, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int = 200) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; ``learn`` marks the rows to learn from.

    By default those are the rows whose crc32(id as text) mod 3 is not 1; the
    others are held out.  A null id is not held out.  Texts of any length count
    whole.  Repeated rows get the same answer each and are learned once; of
    tied votes the language that is first by name wins.  Other columns are not
    read; an empty table gives an empty result.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))
    model = fit_languages(docs, ~held_out if learn is None else learn, per_language, max_languages, lang_col, text_col, id_col)
    out = predict_languages(docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")

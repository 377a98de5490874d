import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecal.llm import features, langid, quality_model
from scorecal.llm.queries import op5_language_id, op9_quality_classifier
from scorecal.llm.quality_model import score_quality

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " 12 ?! "), (4, "é"), (4, "é"), (5, "the and of " * 30000), (None, "der die das und")]


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    lang = {r.doc_id: r.lang for r in docs}
    got = op5_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.98


def test_language_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 200 and doc_id > 5")
    rows = spark.createDataFrame([(i, t, None) for i, t in ODD], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify_languages(base.union(rows).withColumn("key", F.lit(0))).collect() if (r.doc_id or 0) <= 5}
    assert {k for k in got if k[1] == "und"} == {(1, "und"), (2, "und"), (3, "und")}
    assert {k[0] for k in got} == {1, 2, 3, 4, 5, None}
    assert langid.identify_languages(base.limit(0)).count() == 0


def test_quality_on_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op9_quality_classifier(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s, _ in held if y == 1], [s for y, s, _ in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([p == y for y, _, p in held]) > 0.9


def test_quality_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id > 5")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    got = [r for r in score_quality(base.union(rows).withColumn("label", F.lit(0)), labels, per_class=50).collect() if (r.doc_id or 0) <= 5]
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert score_quality(base.limit(0), labels).count() == 0
    few = base.limit(20)
    for known, want in ((labels.where("quality is null"), 0.5), (labels.where("quality = 1"), None)):
        scores = {r.score for r in score_quality(few, known).collect()}
        assert len(scores) == 1 and (want is None and scores.pop() > 0.5 or scores == {want})


def test_several_labels_of_an_id_count_by_the_least(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "### $$$ %%%") for i in range(1, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(i, 1) for i in range(1, 60)], "doc_id long, quality int")
    once = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in score_quality(docs, x.repartition(n)).collect()} for x, n in ((labels, 7), (once, 2)))
    assert a == b and min(a[i] for i in a if i % 2) > max(a[i] for i in a if not i % 2)


def test_hinge_reaches_the_optimum():
    """Dual coordinate descent against projected gradient ascent of the same dual, by brute force."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=40) > 0, 1.0, -1.0)
    cost = np.full(40, 0.7)
    got = features.hinge([(np.arange(6), row) for row in x], y, 6, cost, epochs=400)
    gram, a = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(40)
    for _ in range(8_000):
        a = np.clip(a + (1 - gram @ a) / np.linalg.norm(gram, 2), 0, cost)
    assert np.allclose(got, (a * y) @ x, atol=2e-3)


def test_duels_choose_by_votes():
    """``Round.winner`` against a plain count of the pairwise winners."""
    rng = np.random.default_rng(1)
    base = rng.random((4, 1 << langid.BITS)) ** 6
    texts = [(i % 4, base[i % 4] * rng.random(1 << langid.BITS)) for i in range(80)]
    rows = [(np.flatnonzero(v > 0.2), v[v > 0.2]) for _, v in texts]
    found = langid.Round(rows, np.array(["abcd"[k] for k, _ in texts]))
    for _, v in texts[:12]:
        votes = dict.fromkeys("abcd", 0)
        for (a, b), w, fit in zip(found.pairs, found.weights, found.fits, strict=True):
            votes[found.names[a] if features.probability(w @ v, fit) >= 0.5 else found.names[b]] += 1
        name, p = found.winner(v)
        assert votes[name] == max(votes.values()) and 0 <= p <= 1


def test_many_unlisted_languages_share_families(spark):
    rows = [(i, f"{chr(97 + i % 40 % 26)}{i % 40}word " * 8, f"x{i % 40:02d}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, words string, lang string")
    assert len({langid.family_of(sorted({r[2] for r in rows}))[r[2]] for r in rows}) == 4
    got = langid.identify_languages(docs, text_col="words").collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.9
    few = {r.lang_pred for r in langid.identify_languages(docs, F.lit(True), text_col="words", max_languages=3).collect()}
    assert few <= {"x00", "x01", "x02"}, "the most frequent, then the first by name"


def test_counts_over_blocks_are_those_of_the_whole(monkeypatch):
    data = np.random.default_rng(0).integers(97, 105, 1000).astype(np.uint8)
    want = features.counts(data, (1, 2, 3), 12)
    monkeypatch.setattr(features, "BLOCK", 64)
    assert (features.counts(data, (1, 2, 3), 12) == want).all()
    assert want.sum() == 1000 + 999 + 998


def test_repeated_rows_are_drawn_once(spark):
    """An id or row that is repeated 10^5 times must not fill the driver."""
    base = spark.createDataFrame([(i, ("der Hund und die Katze " if i % 2 else "the dog and the cat ") * (i % 7 + 1), "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string")
    many = base.unionByName(base.where("doc_id = 1").crossJoin(spark.range(100_000).select()))
    labels = base.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    drawn = {}

    def seen(rows, names, _held=langid.LanguageModel):
        drawn["lang"] = len(rows)
        return _held(rows, names)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "LanguageModel", seen)
        patch.setattr(quality_model, "QualityModel", lambda rows, positive: drawn.update(quality=len(rows)) or quality_model.Constant(1, 2))
        langid.fit_languages(many, F.lit(True), per_language=1_000_000)
        quality_model.fit_quality(many, labels, F.lit(True), per_class=1_000_000)
    assert drawn == {"lang": 60, "quality": 60}


def test_ratios_are_those_of_plain_counts():
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(50) < 0.2) for _ in range(30)]
    positive = rng.random(30) < 0.5
    got = quality_model.log_count_ratios(rows, positive)
    for f in range(50):
        p = 1 + sum(f in set(r.tolist()) for r, y in zip(rows, positive, strict=True) if y)
        q = 1 + sum(f in set(r.tolist()) for r, y in zip(rows, positive, strict=True) if not y)
        assert got[f] == pytest.approx(np.log((p / (positive.sum() + 2)) / (q / ((~positive).sum() + 2))))

"""The hash-prefix forest against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecal.llm import neighbours

SF = "/root/testdata"


def brute(rows, k, every=20):
    """{query: [(score, vec_id)]}; of rows with one id the smallest vector counts."""
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for i, v in kept.items():
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in kept.items() if j != i and len(w) == len(v))
            out[i] = [(-s, j) for s, j in found[:k]]
    return out


def answers(df):
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    return dict(got)


def close(got, want):
    assert set(got) == {q for q, v in want.items() if v}
    for q, own in got.items():
        assert [j for _, j in own] == [j for _, j in want[q]]
        assert np.allclose([s for s, _ in own], [s for s, _ in want[q]], rtol=1e-12, atol=0)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 3) / 1.0).tolist()) for i in range(120)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 2.0]), (280, [1.0, float("nan"), 2.0]), (300, [float("inf"), 0.0, 0.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(1000 + i, [1.0, 2.0]) for i in range(60)] + [(1100, [5.0])] + rows[:5] + [(7, [9.0, 9.0, 9.0]), (2000, [1e90, 2.0, 3.0]), (2020, [1e-90, 0.0, 1e-90])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "cid", "node", "rank", "score", "query")})
    out = neighbours.nearest(df.repartition(4), F.col("vec_id") % 20 == 0, k=20)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    close(answers(out), brute(rows, 20))
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_equal_vectors_stand_for_all_their_rows(spark):
    rows = [(i, [1.0, 1.0]) for i in range(5000)] + [(9000 + i, [1.0, float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = answers(neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=7))
    assert len(got) == 250 + 2
    assert [j for _, j in got[4980]] == [9029 - i for i in range(7)]
    assert [j for _, j in got[0]] == [9029 - i for i in range(7)]
    near = answers(neighbours.nearest(df.where("vec_id < 5000"), F.col("vec_id") % 20 == 0, k=7))
    assert [j for _, j in near[0]] == [1, 2, 3, 4, 5, 6, 7] and [j for _, j in near[4980]] == [0, 1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("norms", [False, True])
def test_recall_with_blocks_dealt_and_levels_used(spark, monkeypatch, norms):
    """Few trees and blocks of a few rows: every answer is right, and most are found."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((40, 16))
    x = centre[rng.integers(0, 40, 3000)] + 0.2 * rng.standard_normal((3000, 16))
    x[:900] = x[0] + 1e-7 * rng.standard_normal((900, 16))
    if norms:
        x *= np.exp(rng.uniform(-1.5, 1.5, (3000, 1)))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = answers(neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5, trees=20, budget=4.0))
    near = x[::20] @ x.T
    near[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    hits = 0
    for i, q in enumerate(range(0, 3000, 20)):
        assert len(got[q]) == 5 and q not in [j for _, j in got[q]]
        assert np.allclose([s for s, _ in got[q]], near[i, [j for _, j in got[q]]], rtol=1e-12)
        hits += sum(s >= np.sort(near[i])[-5] * (1 - 1e-12) for s, _ in got[q])
    assert hits >= 0.9 * 750


def test_strings_share_prefixes_with_their_neighbours():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 8))
    turned = np.vstack([x, x * (1 + 1e-9), -x]) @ neighbours.rotation(8, 0, 0)[:-1]
    _, bits, letters = neighbours.letter_bits(8)
    a, b, c = np.split(neighbours.strings(turned, 8), 3)
    assert (a == b).all() and ((a ^ c) >> (bits * letters - 1) == 1).all()
    assert a.min() >= 0 and a.max() < 1 << (bits * letters)
    assert all(neighbours.letter_bits(d)[1] * neighbours.letter_bits(d)[2] <= 56 for d in (1, 2, 3, 63, 64, 127, 128, 2000))


def test_query_recall(spark):
    from scorecal.llm.queries import op12_nearest_neighbours

    rows = spark.read.parquet(f"{SF}/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = answers(op12_nearest_neighbours(spark, f"{SF}/sf0.1"))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, own in got.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len({j for _, j in own} & set(ids[np.argsort(-score)[:20]].tolist()))
        assert len(own) == 20 and np.allclose([s for s, _ in own], [score[ids == j][0] for _, j in own], rtol=1e-12)
    assert hits >= 0.9 * 20 * len(got)

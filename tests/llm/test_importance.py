"""Importance resampling against CRCs of the n-gram strings themselves."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from scorecal.llm import importance

SF = "/root/testdata/sf0.001"


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(w), [crc32(b" ".join(w[i : i + n])) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    s, t = [0] * 10000, [0] * 10000
    found = [(i, *features(x)) for i, x in docs]
    for _, _, own in found:
        for b in own:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, words, own in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((-r[3], -1 if r[0] is None else r[0], k) for k, r in enumerate(rows) if r[4] >= 20)
    rank = {k: n for n, (_, _, k) in enumerate(order[: 5 * len(order) // 100], 1)}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(rows)), key=str)


def test_composed_crcs():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab9éü") for _ in range(rng.choice([1, 2, 7, 31, 32, 33, 300]))).encode() for _ in range(400)] + [b"x" * 5_000_000, b"end"]
    place = np.concatenate([np.arange(250), np.arange(152)])
    for n, (last, got) in enumerate(importance.gram_crcs(np.array([crc32(w) for w in words], np.uint32), np.array([len(w) for w in words]), place), 1):
        assert last.tolist() == [i for i in range(402) if place[i] >= n - 1]
        assert got.tolist() == [crc32(b" ".join(words[i - n + 1 : i + 1])) for i in last]


def test_resample(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta-Gamma", "ΔX", "7", "q9\n", "rare%d" % (i % 9)]) for _ in range(rng.randrange(60)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " ,.;"), (1003, "one"), (1004, "one Two"), (None, "w " * 25), (1005, "word " * 200_000), (1006, "z" * 3_000_000)]
    docs += [(1007, "same text of words " * 10)] * 30
    target = ["alpha beta gamma", None, "", "7 q9 7"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "rank", "h", "t", "_in", "bucket")})
    out = importance.importance_resample(df.repartition(6), spark.createDataFrame([(x,) for x in target], "text string"))
    assert {k for _, k in out.dtypes} == {"bigint"}
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, target)


def test_runs_cross_the_parts_of_a_text(monkeypatch):
    monkeypatch.setattr(importance, "WORDS", 10)
    monkeypatch.setattr(importance, "pieces", lambda text: [b" ".join(text.split()[k : k + 7]) for k in range(0, max(1, len(text.split())), 7)])
    texts = ["", "a", "a b", " ".join(map(str, range(95))), "c d e", ""]
    own = importance.Features(10000)
    parts = [p for i, x in enumerate(texts) for p in own.add(i, x.encode())] + [own.given_out()]
    got = sorted((int(r), int(b)) for rows, found in parts for r, b in zip(rows, found, strict=True))
    assert got == sorted((i, b) for i, x in enumerate(texts) for b in features(x)[1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_resample(none, none.select("text")).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, importance.importance_resample(some, none.select("text")).collect()), key=str) == brute([(1, "a b"), (2, None)], [])


def test_query(spark):
    from scorecal.llm.queries import op13_importance_resampling

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, op13_importance_resampling(spark, SF).collect()), key=str) == brute(docs, target)

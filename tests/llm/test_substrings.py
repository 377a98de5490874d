import hashlib
import random
import re

from pyspark.sql import functions as F

from scorecal.llm.substrings import substring_dedup


def brute_force(rows, width=50):
    docs = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t in rows]
    key = lambda d: float("inf") if d is None else d
    least = {}
    for d, words in docs:
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            least[w] = min(least.get(w, key(d)), key(d))
    out = []
    for d, words in docs:
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if least[tuple(words[i : i + width])] < key(d):
                gone[i : i + width] = [True] * width
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((str(d), len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def sample_rows(width, seed=0):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["é", "Ünd", " ", "a b"]
    passages = [[rng.choice(words) for _ in range(rng.randrange(width - 2, 3 * width))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            text += p[a : a + rng.randrange(width // 2, 2 * width)] if rng.random() < 0.5 else p
            text += [rng.choice(words) for _ in range(rng.randrange(width))]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [rows[3], (rows[4][0] + 1, rows[4][1]), (None, rows[5][1]), (rows[6][0], rows[7][1]), (-1, None), (-2, ""), (-3, " \n")]
    return rows + [(10**7 + i, "x " * (width + i)) for i in range(3)] + [(10**8, "y z " * 20000), (10**8 + 1, "y z " * 19000)]


def run(spark, rows, width, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).repartition(6)
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, width, **kw).collect())


def test_matches_brute_force(spark):
    rows = sample_rows(12)
    assert run(spark, rows, 12, gram=6, shard_docs=10, memory=500) == brute_force(rows, 12)


def test_wide_windows(spark):
    rows = sample_rows(50, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup(df, with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_force(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_query_matches_brute_force(spark):
    from scorecal.llm.queries import op7_substring_dedup

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op7_substring_dedup(spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_force(rows)


def test_empty(spark):
    assert run(spark, [], 50) == []

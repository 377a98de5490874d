import random
import re
import time
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scorecal.llm import minhash
from scorecal.llm import near_dedup as nd
from scorecal.llm.graph import connected_components
from scorecal.llm.scratch import Scratch


def shingle_set(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_force(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = doc if least.get(r) is None else least[r] if doc is None else min(least[r], doc)
    return sorted((str(doc), len(s), str(least[find(i)])) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(n, groups, seed, edits=4):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 40, 120]))]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randrange(edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1000003, " ".join(w.upper() if rng.random() < 0.3 else w for w in words)))
    rng.shuffle(rows)
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).repartition(4)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nd.near_dedup(df, **kw).collect())


def test_matches_brute_force(spark):
    rows = near_copies(12, 20, 1) + [(-1, None), (-2, ""), (-3, " \n"), (-4, "one"), (-5, "ONE"), (-6, "x y"), (-6, "x y"), (None, "x y"), (-7, "z " * 30000)]
    assert run(spark, rows, k=3, num=85, den=100) == brute_force(rows, 3, 85, 100)


def test_large_group_with_weak_links(spark):
    """One bucket's members need not be linked with each other, nor with its pivot."""
    rows = near_copies(150, 1, 5, edits=9) + near_copies(60, 2, 8, edits=14)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert run(spark, rows, k=3, num=85, den=100) == brute_force(rows, 3, 85, 100)


def test_runs_hold_two_blocks_and_all_pairs_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    n, main = 600, 200  # ids below ``main`` have one root, the others are apart
    rest = spark.range(n).selectExpr("id", f"if(id < {main}, -1L, id) as root", "7L as group", f"{n}L as size", f"{main}L as top", "-1L as main", "5L as n", "id as s0")
    runs = {}
    for r in minhash._blocked(rest, []).collect():
        runs.setdefault((r.group, r.block), []).append(r)
    assert max(map(len, runs.values())) <= 4 * 32, "two blocks, whose sizes vary as hashes do"
    met = set()
    for rows in runs.values():
        members = [r.id for r in rows if r.member]
        assert [r.id for r in rows[: len(members)]] == members and all(r.member or r.probe for r in rows)
        met |= {frozenset((r.id, m)) for r in rows if r.probe for m in members if m != r.id}
    assert met == {frozenset(x) for x in combinations(range(n), 2) if max(x) >= main}


def test_a_large_group_is_not_sent_more_often_as_it_grows(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    sent = {}
    for n in (1000, 4000):
        rest = spark.range(n).selectExpr("id", "id as root", "7L as group", f"{n}L as size", "1L as top", "-1L as main", "5L as n", "id as s0")
        sent[n] = minhash._blocked(rest, []).count() / n
    assert sent[1000] == sent[4000] <= minhash.BLOCKS + 1


def test_links_are_confirmed_on_sets_made_from_texts(monkeypatch):
    """A run has texts, and holds few sets at a time."""
    rows = near_copies(60, 1, 8, edits=14)
    texts, made = [t for _, t in rows], []
    sets = lambda column: made.extend(column.to_pylist()) or nd.shingles(column, 3, True)
    n = len(rows)
    columns = {"group": [1] * n, "block": [0] * n, "id": range(n), "root": range(n), "probe": [True] * n, "member": [True] * n, "n": [len(x) for x in nd.shingles(pa.array(texts), 3, True)], "text": texts}
    batch = pa.record_batch([pa.array(list(v)) for v in columns.values()], list(columns))
    monkeypatch.setattr(minhash._Sets.__init__, "__defaults__", (100,))
    monkeypatch.setattr(minhash._meetings, "__defaults__", (200,))
    found = [e for out in minhash._links(minhash._Plausible(85, 100, 0, 0.6, 0), sets)(iter([batch])) for e in zip(out["v"].to_pylist(), out["m"].to_pylist(), strict=True)]
    root = list(range(n))
    for v, m in found:
        a, b = root[v], root[m]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert sorted((str(i), len(shingle_set(t, 3)), str(root[i])) for i, t in enumerate(texts)) == brute_force(list(enumerate(texts)), 3, 85, 100)
    assert len(made) > len(set(made)), "sets were let go and made again"


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
        return {str(f) for d in dirs for f in Path(d.getPath()).glob("*/shuffle_*")}

    before = files()
    out = Scratch(spark, "t").save(spark.range(1000).repartition(7, "id"), "r")
    for _ in range(50):  # they are removed in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and out.count() == 1000


def test_small_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = near_copies(150, 1, 5, edits=9) + near_copies(60, 2, 8, edits=14)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert run(spark, rows, k=3, num=85, den=100) == brute_force(rows, 3, 85, 100)


def test_query_matches_brute_force(spark):
    from scorecal.llm.queries import op1_minhash_near_dedup

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op1_minhash_near_dedup(spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_force(rows, 3, 85, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_thue_morse_words_are_different(spark):
    from tests.llm.test_line_dedup import thue_morse

    words = [w for n in (1024, 4096) for w in thue_morse(n)]
    rows = list(enumerate([*words, *(f"{a} x {b}" for a in words for b in words)]))
    assert run(spark, rows, k=3, num=85, den=100) == brute_force(rows, 3, 85, 100)


def test_empty(spark):
    assert run(spark, []) == []


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.9):
        both = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, 2000 - len(both), dtype=np.uint64)]) for _ in range(2))
        sig = minhash.signatures(np.stack([minhash.minima(x, 1024) for x in (a, b)]))
        true = len(both) / (4000 - len(both))
        assert abs(minhash.similarity_numpy(sig[0], sig[1]) - true) < 0.06


def test_components_of_a_long_path(spark):
    n = 400
    order = list(range(n))
    random.Random(0).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (7000, 7000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    got = {r.v: r.m for r in connected_components(df, Scratch(spark, "t"), edges_per_task=5).collect()}
    assert got == {i: 0 for i in range(1, n)} | {1001: 1000}
    assert {r.v: r.m for r in connected_components(df, Scratch(spark, "t")).collect()} == got

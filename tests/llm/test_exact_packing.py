import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorecal.llm import packing
from scorecal.llm.exact_dedup import Patricia, exact_dedup, owner
from scorecal.llm.packing import cuts, pack
from scorecal.llm.queries import tokenizer_path

ODD = [(1, "a b\tc"), (2, "abc"), (3, " a b c "), (4, None), (5, ""), (6, " \n"), (7, "é x"), (7, "é x"), (None, "abc"), (8, "w " * 40000), (9, "<|endoftext|>   a\n  b  c")]


def test_exact_dedup_brute_force(spark):
    rows = ODD * 2 + [(100 + i, "same text " + "x" * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1)).repartition(5)
    got = exact_dedup(df, memory=2000).collect()
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc, text))
    want = sorted((str(d), str(min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2]), len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, _, d, _ in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_exact_dedup_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_spills_by_subtree():
    rng = np.random.default_rng(0)
    keys = [bytes(rng.integers(0, 4, rng.integers(0, 12))) for _ in range(4000)]
    small, want = Patricia(owner, limit=3000), defaultdict(list)
    for i, k in enumerate(keys):
        small.insert(k, ((0, i, i), 1, [i]))
        want[k].append(i)
    assert small.spilled
    assert {k: (v[0][1], v[1], sorted(v[2])) for k, v in small.items()} == {k: (v[0], len(v), v) for k, v in want.items()}


def check_packing(pieces, docs, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for doc, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(p.length for p in pieces)


def test_packing_of_thue_morse_words(spark):
    from tests.llm.test_line_dedup import thue_morse

    docs = list(enumerate(f"{a} {b}" for n in (512, 1024, 4096) for a, b in (thue_morse(n), thue_morse(n)[::-1])))
    check_packing(pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), tokenizer_path(), 2048, 16).collect(), docs, 2048)


def test_chunks_that_hash_alike_are_told_apart(monkeypatch):
    from scorecal.llm import packing

    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = pa.array(["some words of the same length: cats dogs birds", "dogs cats cows dogs", None, "x" * 200 + " " + "y" * 200])
    encode = packing.Encoder(tokenizer_path())
    ids, at = encode(texts)
    want = [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_round_trip(spark, capacity):
    docs = [(i, t) for i, (_, t) in enumerate(ODD)] + [(100 + i, "Ünï word's  x\n\n y 12 ### " * (i % 90)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit(1)).repartition(3)
    assert check_packing(pack(df, tokenizer_path(), capacity, 16).collect(), docs, capacity) < 0.2


def test_packing_query(spark):
    from scorecal.llm.queries import op3_harmonic_packing

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(op3_harmonic_packing(spark, sf).collect(), docs, 2048) < 0.01


def test_packing_empty_and_cuts(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
    assert cuts(2048 * 2 + 1024 + 65, 2048, 64) == [2048, 2048, 1024, 64, 1]
    for capacity in (100, 2048):
        assert all(sum(cuts(n, capacity, 10)) == n for n in range(1, 500))


def test_chunks_meet_in_runs_and_slices_with_the_ids_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    texts = ["one two\u00a0three  four\n five", "", " lone", "\u3042 \u3044 two two", None] + [f"word{i} w{i % 7} \u00e9{i}" for i in range(300)]
    monkeypatch.setattr(packing, "RUN", 64)
    encode, plain = packing.Encoder(path), Tokenizer.from_file(path)
    for part in (texts[:200], texts[100:]):  # chunks known and new
        ids, at = encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in part]
    assert packing.SLICE > 2 << 20  # fewer slices meet a chunk again


def test_words_are_learnt_once_whatever_marks_follow_and_stay_known():
    import random

    rng = random.Random(5)
    bits = ["a", "b", "re", "'", "'s", "\n", "\n", " ", "  ", "\t", ".", "!", "_", "<|endoftext|>", "<|", "|>", "é", "×", "÷", "ß", "́", " ", "あ", "12", "٣", "²", " ", "\x00", "’"]
    encode = packing.Encoder(tokenizer_path(), remember=50)
    for _ in range(6):
        texts = ["".join(rng.choices(bits, k=rng.choice([1, 2, 5, 40]))) for _ in range(200)]
        ids, at = encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encode = packing.Encoder(tokenizer_path(), remember=8)
    for i in range(4):
        encode(pa.array([f"x cats. cats, cats!\ncats\nDogs (cats) new{'abcd'[i]}"]))
    assert {b" cats", b"cats", b"Dogs", b"\n", b"."} <= set(encode.known) and b" cats." not in encode.known
    assert b" newa" not in encode.known  # met in one slice only, and too many are known
    assert packing._encoder(tokenizer_path()) is packing._encoder(tokenizer_path())

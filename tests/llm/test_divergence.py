"""Source divergence against a plain count in Python, and its SQL."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from scorecal.llm import divergence
from scorecal.llm.blanks import lowering, pieces

SF = "/root/testdata/sf0.001"


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        seen[lang].update(set(words))
        count[lang, source].update(words)
    kept = {lang: {w for w, n in c.items() if n >= min_docs} for lang, c in seen.items()}
    out = []

    def shares(own, lang):
        total, v = sum(own[w] for w in kept[lang]), len(kept[lang])
        return {w: 1 + 1000000000 * (own[w] + 5) // (total + 5 * v) for w in kept[lang]}

    for lang in seen:
        groups = {s: shares(c, lang) for (k, s), c in count.items() if k == lang}
        every = shares(sum((c for (k, _), c in count.items() if k == lang), Counter()), lang)
        pairs, terms = defaultdict(list), defaultdict(list)
        for a, b in permutations(groups, 2):
            pairs[a].append((-sum(abs(p - groups[b][w]) for w, p in groups[a].items()), b.encode()))
        for s, own in groups.items():
            terms[s] = [(every[w] - p, w.encode()) for w, p in own.items() if count[lang, s][w] and p > every[w]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for s, items in found.items():
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(sorted(items)[:most], 1)]
    return sorted(out)


ROWS = [("en", f"s{i % 5}", f"Common ÄPFEL word{i % 7} x{i} don't A1B " + "rare " * (i % 3)) for i in range(60)]
ROWS += [("en", "hot", "same words here")] * 200 + [(None, None, None), ("", "a", ""), ("fr", "a", None), ("fr", "b", "\x00!9\x7f"), ("en", None, "common"), ("en", "long", "common tail" + " pad-pad" * 200_000), ("en", "one", "z" * 3_000_000)]


@pytest.mark.parametrize("how", [{}, {"sent": 0, "shard": 40}, {"sent": 0, "shard": 1 << 20}])
def test_divergence(spark, how):
    df = spark.createDataFrame(ROWS, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("term", "n", "part", "kind", "id", "value")})
    out = divergence.source_divergence(df.repartition(5), 3, 4, **how)
    assert dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    assert sorted(map(tuple, out.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(ROWS, 3, 4)


def test_many_sources_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SIDE", 3)
    monkeypatch.setattr(divergence, "TERMS", 4)
    rows = [("en", f"s{i % 8}", f"aa b{i % 13} c{i % 3} d{i * i % 11}".replace("1", "x")) for i in range(90)]
    out = divergence.source_divergence(spark.createDataFrame(rows, "lang string, source string, text string"), 2, 3)
    assert sorted(map(tuple, out.collect())) == brute(rows, 2, 3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(df).count() == 0


def test_no_kept_term_leaves_distances_of_zero(spark):
    df = spark.createDataFrame([("en", "b", "x"), ("en", "a", "y"), ("en", "c", None)], "lang string, source string, text string")
    got = sorted(map(tuple, divergence.source_divergence(df).collect()))
    assert got == brute([("en", "b", "x"), ("en", "a", "y"), ("en", "c", None)], 30, 50) and {r[4] for r in got} == {0}


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, v = 10**12 - 7, 3 * 10**15 + 1, 10**7 + 3
    got = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("total"), F.lit(v).alias("v")).select(divergence._share("n", "total", "v")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_query_matches_sql(spark):
    from scorecal.llm.queries import ORACLE_SQL, op11_source_divergence

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLE_SQL["op11_source_divergence"]).df().sort_values(["lang", "source", "part", "rank"]).reset_index(drop=True)
    got = op11_source_divergence(spark, SF).toPandas().sort_values(["lang", "source", "part", "rank"]).reset_index(drop=True)
    assert got[want.columns].equals(want)


def test_pieces_keep_words_whole():
    text = b"ab cdef " * 50 + b"g" * 90 + b" h"
    parts = list(pieces(text, 20))
    assert b"".join(parts) == text and b" ".join(b" ".join(p.split()) for p in parts if p.split()) == b" ".join(text.split()) and len(parts) > 20
    assert "Äb9-Z\n".encode().translate(lowering(b"9")).decode() == "Äb9 z "

"""Operators of DataFrame expressions: licences, mixing, quality rules."""

import hashlib
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from scorecal.llm import licenses, mixing, quality_rules, sql

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "x y z x y z"), (5, "w " * 30000)]


def python_side(df):
    text = df._jdf.queryExecution().toString()
    return re.search("Python|Pandas|Arrow|mapIn", text)


MIT = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
       "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
       "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."]


def test_licenses(spark):
    texts = {
        10: ("Words.\nLicensed under the Apache License, Version 2.0.\nMore", "Apache-2.0", "Apache-2.0"),
        11: ("Released under the MIT License. All rights reserved.", "MIT,LicenseRef-Reserved", "MIT"),
        12: ("\n".join(MIT), "MIT", "MIT"),
        13: ("\n".join(MIT[::-1]), "", "none"),
        14: (MIT[0] + " In between. " + MIT[1] + "\n\n" + MIT[2], "MIT", "MIT"),
        15: ("I like the Apache license version 2.0 a lot.", "", "none"),
        16: ("Licensed under CC BY-NC 4.0. " + "pad " * 50000, "CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    }
    df = spark.createDataFrame(ODD + [(k, v[0]) for k, v in texts.items()], "doc_id long, text string").withColumn("ids", F.lit(1))
    out = licenses.scan_licenses(df)
    assert not python_side(out)
    got = {r.doc_id: r for r in out.collect()}
    assert {k: (got[k].licenses, got[k].license) for k in texts} == {k: v[1:] for k, v in texts.items()}
    assert all(got[d].license == "none" and got[d].n_license_sentences == 0 for d, _ in ODD)
    assert out.count() == len(ODD) + len(texts) and licenses.scan_licenses(df.limit(0)).count() == 0


APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


@pytest.mark.parametrize("leader", ["", "# ", " * ", "// ", ";; ", "! ", "dnl ", '.\\" '])
def test_wrapped_licenses(spark, leader):
    texts = {
        "Apache-2.0": APACHE,
        "MIT": "\n\n".join("\n".join(textwrap.wrap(x, 76)) for x in MIT),
        "GPL-3.0-or-later": GPL.format(":", ",", 3),
        "GPL-2.0-or-later": GPL.format(";", ";", 2),
        "BSD-2-Clause,LicenseRef-Reserved": BSD,
        "BSD-3-Clause,LicenseRef-Reserved": BSD + NAMES,
        "ISC": ISC,
        "MPL-2.0": MPL,
    }
    for end in ("\n", "\r\n"):
        rows = [(i, end.join((leader + line).rstrip() for line in t.split("\n"))) for i, t in enumerate(texts.values())]
        got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [r.licenses for r in sorted(got, key=lambda r: r.doc_id)] == list(texts)


def test_license_sql_sees_wrapped_texts(spark):
    texts = [APACHE, GPL.format(":", ",", 3), BSD, BSD + NAMES, ISC, MPL, "é all rights reserved", "x.\n\nAll  rights reserved...", "Use v. 2.0 ..5"]
    rows = [(i, end.join(lead + line for line in t.split("\n"))) for i, (t, lead, end) in enumerate((t, lead, end) for t in texts for lead in ("", "# ", " * ", "dnl ") for end in ("\n", "\r\n"))]
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, (_, t) in enumerate(ODD)], "doc_id long, text string")
    pdf = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM pdf")
    got = sorted(map(tuple, licenses.scan_licenses(df).collect()))
    assert got == sorted(con.execute(sql.license_scan(licenses.SENTENCES, licenses.RULES)).fetchall())
    assert {r[3] for r in got if r[0] in (48, 49)} == {""}  # a word of another script before the sentence
    assert licenses.wider_rules([("A", "x", ["a", "b", "c"]), ("B", "x", ["a", "c"]), ("C", "x", ["c", "a"])]) == [[], [0], []]


def test_license_hint_follows_known_sentences(spark):
    df = spark.createDataFrame([(1, "Use it\nfreely, friend."), (2, "Use it\n\nfreely, friend.")], "doc_id long, text string")
    got = licenses.scan_licenses(df, {"use it freely friend": "free"}, [("Free", "open", ["free"])]).collect()
    assert {r.doc_id: r.license for r in got} == {1: "Free", 2: "none"}


def test_license_scan_of_long_runs(spark):
    odd = ["\n" * 200_000, "license " + "\n * " * 100_000, "license" + ". " * 100_000, "license" + ";" * 300_000, "license." + "." * 300_000]
    df = spark.createDataFrame([(i, x + "\nReleased under the MIT License.") for i, x in enumerate(odd)], "doc_id long, text string")
    assert [r.license for r in licenses.scan_licenses(df).collect()] == ["MIT"] * len(odd)


def brute_mix(rows, weights, share, max_epochs, seed):
    """The same rule, by water filling with repeated passes and a sorted walk."""
    def split(budget, children):  # children: {name: (weight, cap)}
        given, open_ = {n: 0 for n in children}, {n for n, (w, _) in children.items() if w > 0}
        while open_:
            total = sum(children[n][0] for n in open_)
            full = {n for n in open_ if children[n][1] * total <= budget * children[n][0]}
            if not full:
                return given | {n: children[n][0] * budget // total for n in open_}
            for n in full:
                given[n] = children[n][1]
                budget -= children[n][1]
            open_ -= full
        return given

    weight = lambda level, v: weights.get(level, {}).get(v, weights.get(level, {}).get("*", 1))
    supply = Counter()
    for r in rows:
        supply[r[1:4]] += r[4]
    caps = defaultdict(int)
    for (a, b, c), s in supply.items():
        if weight("l3", c) > 0:
            caps[a, b, c] = s * max_epochs
    for (a, b, c) in supply:
        if weight("l2", b) > 0:
            caps[a, b] += caps[a, b, c]
    for a, b in {k[:2] for k in supply}:
        if weight("l1", a) > 0:
            caps[a,] += caps[a, b]
    names = {k[0] for k in supply}
    budget = {(): min(int(sum(supply.values()) * share), sum(caps[a,] for a in names))}
    for depth, level in enumerate(("l1", "l2", "l3")):
        for parent in list({k[:depth] for k in supply}):
            kids = {k[depth] for k in supply if k[:depth] == parent}
            got = split(budget[parent], {v: (weight(level, v), caps[(*parent, v)]) for v in kids})
            budget |= {(*parent, v): b for v, b in got.items()}
    out = []
    for leaf, s in supply.items():
        epochs = budget[leaf] // s if s else 0
        left = budget[leaf] - epochs * s
        own = defaultdict(list)
        for r in rows:
            if r[1:4] == leaf:
                own[hashlib.md5(f"{seed}:{epochs}:{'' if r[0] is None else r[0]}".encode()).hexdigest()].append(r)
        cum, prefix = 0, True
        for k in sorted(own):
            cum += sum(r[4] for r in own[k])
            prefix = prefix and cum <= left
            out += [(*r, epochs + prefix) for r in own[k] if epochs + prefix]
    return sorted(map(str, out))


@pytest.mark.parametrize("share", [0.05, 0.6, 1.7])
def test_mixing(spark, share):
    rng = random.Random(int(share * 100))
    docs = [(i % 900, rng.choice("ABC"), rng.choice(["en", "de", None]), "s%d" % min(rng.randrange(6), rng.randrange(6)), "w " * rng.choice([0, 3, 10, 200])) for i in range(1000)]
    docs += [(d, None, None, None, t) for d, t in ODD]
    df = spark.createDataFrame(docs, "doc_id long, dom string, lang string, source string, text string").withColumn("tokens", F.lit(1)).repartition(7)
    weights = {"l1": {"A": 5, "B": 1}, "l2": {"en": 3, "*": 2}, "l3": {"s0": 7, "s5": 0}}
    levels = {"l1": F.col("dom"), "l2": F.col("lang"), "l3": F.col("source")}
    out = mixing.mix_sources(df, levels, weights, share=share, max_epochs=2, seed=3)
    assert not python_side(out)
    rows = [(d, a or "", b or "", c or "", len((t or "").split())) for d, a, b, c, t in docs]
    assert sorted(str(tuple(r)) for r in out.collect()) == brute_mix(rows, weights, share, 2, 3)
    taken = mixing.take_sources(df, levels, weights, share=share, max_epochs=2, seed=3)
    assert taken.columns == df.columns and taken.count() == out.agg(F.sum("copies")).first()[0]
    assert mixing.mix_sources(df.limit(0), levels, weights).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 1, 0.3), (0, 300, 0.01), (2, 300, 0.02), (40, 1000, 0.05), (49, 1000, 0.05), (60, 1000, 0.05), (4700, 100_000, 0.05)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = 1.0 if k >= n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert got == pytest.approx(want, rel=1e-8)
    huge = spark.range(1).select(quality_rules.binomial_tail(F.lit(49_900_000).cast("long"), F.lit(10**9).cast("long"), 0.05)).first()[0]
    assert 0 < huge < 1e-40


def quality_rows(seed=0, n=4000):
    rng = random.Random(seed)
    vocabulary = ["word%d" % i for i in range(500)] + ["é", "#tag"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([10, 55, 70]))]
        bad = i % 4 == 0
        if bad and i % 8:
            words = [w + "$%" for w in words]
        if bad and not i % 8:
            words = words[:20] * 3
        text = "".join(w + rng.choice([" ", " ", "\n", "\t"]) for w in words)
        rows.append((i, text, rng.choice(["en", None]), 0 if bad else 1))
    return rows


def test_quality_rules(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([r[:3] for r in rows] + [(10**6 + (d or 0), t, "en") for d, t in ODD], "doc_id long, text string, lang string").withColumn("stratum", F.lit("x"))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    out = quality_rules.apply_quality_rules(docs, labels)
    assert not python_side(out)
    got = out.toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    want = con.execute(sql.quality_rules(quality_rules.RULES, 0.04, 0.05)).df()
    key = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).itertuples(index=False, name=None)))
    assert key(got) == key(want)
    assert (got.rejected_by == "symbols").sum() > 100, "some cutoffs are certified"
    good = got[got.doc_id.isin([r[0] for r in rows if r[3]])]
    assert (good.rejected_by != "").mean() <= 0.04
    assert quality_rules.apply_quality_rules(docs.limit(0), labels).count() == 0


def test_repeated_words_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab c de".split()) for _ in range(rng.randrange(40)))) for i in range(200)] + ODD

    def brute(text):
        w = (text or "").split()
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(tri)
        return len({i + d for i, t in enumerate(tri) if count[t] > 1 for d in range(3)})

    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    got = df.select("text", quality_rules.base_columns(text)["counted"].alias("c")).collect()
    assert [r.c.n_repeat_words for r in got] == [brute(r.text) for r in got]

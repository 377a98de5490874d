"""Licence recognition by sentence rules, in DataFrame expressions only.

A text is normalised with marks where sentences end or may end, known sentences
between marks become identifiers, and the identifiers in their order are matched
against ordered rules.  Text never leaves its row and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of known sentences, as normalised (lower case, runs
# of characters other than letters, digits and dots within numbers as one blank).
SENTENCES = {
    "licensed under the apache license version 2.0": "apache2-line",
    "licensed under the apache license version 2.0 the license": "apache2-grant",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "spdx license identifier apache 2.0": "apache2-spdx",
    "this work is licensed under the gnu general public license version 3": "gpl3-line",
    "licensed under the gnu general public license version 3": "gpl3-line",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "spdx license identifier gpl 3.0 only": "gpl3-spdx",
    "spdx license identifier gpl 2.0 only": "gpl2-spdx",
    "released under the mit license": "mit-line",
    "licensed under the mit license": "mit-line",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-asis",
    "spdx license identifier mit": "mit-spdx",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "licensed under cc by 4.0": "ccby4-line",
    "licensed under cc by sa 4.0": "ccbysa4-line",
    "licensed under cc by nc 4.0": "ccbync4-line",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4-line",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "ccbysa4-line",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "ccbync4-line",
    "this work has been dedicated to the public domain": "cc0-line",
    "licensed under cc0 1.0": "cc0-line",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl2-line",
    "all rights reserved": "reserved",
}

# Fixed values: (licence, kind, sentences that follow one another in this order,
# with others between them or not).  Earlier rules take precedence.
RULES = [
    ("Apache-2.0", "open", ["apache2-grant", "apache2-comply", "apache2-asis"]),
    ("Apache-2.0", "open", ["apache2-spdx"]),
    ("Apache-2.0", "open", ["apache2-line"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3-later-grant", "gpl-hope"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-later-grant", "gpl-hope"]),
    ("GPL-3.0-only", "copyleft", ["gpl3-spdx"]),
    ("GPL-2.0-only", "copyleft", ["gpl2-spdx"]),
    ("GPL-3.0-only", "copyleft", ["gpl3-line"]),
    ("MIT", "open", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", "open", ["mit-spdx"]),
    ("MIT", "open", ["mit-line"]),
    ("BSD-3-Clause", "open", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", "open", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", "open", ["isc-grant"]),
    ("MPL-2.0", "copyleft", ["mpl2-line"]),
    ("CC-BY-NC-4.0", "noncommercial", ["ccbync4-line"]),
    ("CC-BY-SA-4.0", "copyleft", ["ccbysa4-line"]),
    ("CC-BY-4.0", "open", ["ccby4-line"]),
    ("CC0-1.0", "open", ["cc0-line"]),
    ("LicenseRef-Reserved", "reserved", ["reserved"]),
]


# Marks put into a text: a sentence's certain end, and a place where it may end or go on.
END, MAYBE = "\x01", "\x02"
_WHITE = r"\x20\x09-\x0D"


def marked(text: Column) -> Column:
    """Words of a text, parted by blanks and marks.

    Words are lower-case letters of any script and digits, and dots before digits.  Blank
    lines and . ! ? that white space follows end a sentence.  At other line
    ends and after ; : it may end or go on, so that wrapped sentences are found
    as well as lines.  Comment leaders go with the line end before them.
    """
    x = F.concat(F.lit("\n"), F.translate(F.lower(text), END + MAYBE, "  "), F.lit("\n\n"))
    x = F.regexp_replace(x, r"\n[^\p{L}\p{N}]*\n", END + "\n")
    x = F.regexp_replace(x, r"\n[^\p{L}\p{N}.\n]*(?:\.[^\p{L}\p{N}.\n]+)?(?:(?:dnl|rem)[\x20\x09]+)?", MAYBE)
    x = F.regexp_replace(x, rf"\bv\.[{_WHITE}{MAYBE}]+(?=[0-9])", "v" + MAYBE)
    x = F.regexp_replace(x, rf"[.!?][{_WHITE}{MAYBE}]+", END)
    x = F.regexp_replace(x, rf"[;:][{_WHITE}{MAYBE}]+", MAYBE)
    x = F.regexp_replace(x, r"\.(?![0-9])", " ")
    return F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}.{END}{MAYBE}]+", " ")


def known_pattern(known: dict[str, str]) -> str:
    """Matches a mark and a known sentence, the longest, that another mark follows."""
    longest = sorted(known, key=lambda s: (-len(s), s))
    parts = (f"[ {MAYBE}]+".join(map(re.escape, s.split(" "))) for s in longest)
    return f"[{END}{MAYBE}] *({'|'.join(parts)})(?= *[{END}{MAYBE}])"


def hint_pattern(known: dict[str, str]) -> str:
    """Matches every lower-case text that holds a known sentence: each has one of these words."""
    left, words = {s: set(s.split(" ")) for s in known}, []
    while left:
        count = Counter(w for own in left.values() for w in own)
        words.append(max(count, key=lambda w: (len(w) > 5, count[w], len(w), w)))
        left = {s: own for s, own in left.items() if words[-1] not in own}
    return "|".join(map(re.escape, words))


def rule_pattern(parts: list[str]) -> str:
    """Matches ',a,b,c,' where the parts appear in this order."""
    return "," + ",([^,]+,)*".join(re.escape(p).replace("\\-", "-") for p in parts) + ","


def wider_rules(rules: list) -> list[list[int]]:
    """For each rule the earlier ones that have all its sentences in their order, and more."""

    def within(few: list[str], many: list[str]) -> bool:
        rest = iter(many)
        return len(few) < len(many) and all(any(x == y for y in rest) for x in few)

    return [[i for i in range(j) if within(rules[j][2], rules[i][2])] for j in range(len(rules))]


def scan_licenses(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences that each document's sentences declare.

    Returns one row per input row: doc_id, n_license_sentences, sentence_ids
    (in text order, joined by commas), licenses (names of the matching rules,
    by precedence, each once, joined by commas), license (the first of them),
    kind (of that rule).  Without a match license is ``none`` and kind ``none``;
    null and empty texts have no sentences.  Repeated rows each get a row; an
    empty table gives none; other columns are not read.

    A rule does not count where an earlier one that has all its sentences and
    more matches.  A sentence may be wrapped over lines, with comment leaders; a blank line ends it.

    ``known`` maps normalised sentences to identifiers and ``rules`` lists
    (licence, kind, identifiers in order).
    """
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.regexp_extract_all(marked(text), F.lit(known_pattern(known)), F.lit(1))
    ids = F.transform(found, lambda s: table[F.regexp_replace(s, f"[ {MAYBE}]+", " ")])
    ids = F.when(F.lower(text).rlike(hint_pattern(known)), ids).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("ids"))
    joined = F.array_join("ids", ",")
    wrapped = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_license_sentences"), joined.alias("sentence_ids"))
    match = [wrapped.rlike(rule_pattern(parts)) for _, _, parts in rules]
    own = [reduce(lambda a, i: a & ~match[i], wider, match[j]) for j, wider in enumerate(wider_rules(rules))]
    hits = F.array_distinct(F.filter(F.array(*(F.when(own[j], F.lit(f"{name}|{kind}")) for j, (name, kind, _) in enumerate(rules))), lambda x: x.isNotNull()))
    rows = rows.withColumn("hits", F.when(F.col("n_license_sentences") > 0, hits).otherwise(F.array().cast("array<string>")))
    first = F.try_element_at("hits", F.lit(1))
    return rows.select(
        "doc_id",
        "n_license_sentences",
        "sentence_ids",
        F.array_join(F.transform("hits", lambda x: F.substring_index(x, "|", 1)), ",").alias("licenses"),
        F.coalesce(F.substring_index(first, "|", 1), F.lit("none")).alias("license"),
        F.coalesce(F.substring_index(first, "|", -1), F.lit("none")).alias("kind"),
    )

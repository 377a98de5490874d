"""DuckDB SQL for the queries that SQL can express."""

from scorecal.llm.licenses import wider_rules

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS pos,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, pos = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_scan(known: dict[str, str], rules: list) -> str:
    """SQL of the licence scan; the sentence and rule tables are the operator's parameters.

    Marks 1 (a sentence's end) and 2 (perhaps one) stand twice, since a match
    takes the mark behind it.
    """
    table = ", ".join(f"({_text(a)}, {_text(b)})" for a, b in known.items())
    match = [f"regexp_matches(w, {_text(',' + ',([^,]+,)*'.join(parts) + ',')})" for _, _, parts in rules]
    own = [" AND NOT ".join([match[j], *(match[i] for i in wider)]) for j, wider in enumerate(wider_rules(rules))]
    cases = ", ".join(f"CASE WHEN {own[j]} THEN {_text(name + '|' + kind)} END" for j, (name, kind, _) in enumerate(rules))
    longest = sorted(known, key=lambda x: (-len(x), x))
    sentences = "|".join(r"[ \x02]+".join(w.replace(".", r"\.") for w in x.split(" ")) for x in longest)
    whole = rf"[\x01\x02] *({sentences}) *[\x01\x02]"
    white = r"\x20\x09-\x0D"
    steps = [
        (r"\n[^\p{L}\p{N}]*\n", "chr(1) || chr(10)"),
        (r"\n[^\p{L}\p{N}.\n]*(?:\.[^\p{L}\p{N}.\n]+)?(?:(?:dnl|rem)[\x20\x09]+)?", "chr(2)"),
        (rf"\bv\.[{white}\x02]+([0-9])", r"'v' || chr(2) || '\1'"),
        (rf"[.!?][{white}\x02]+", "chr(1)"),
        (rf"[;:][{white}\x02]+", "chr(2)"),
        (r"\.([^0-9]|$)", r"' \1'"),
        (r"\.([^0-9]|$)", r"' \1'"),
        (r"[^\p{L}\p{N}.\x01\x02]+", "' '"),
        (r"([\x01\x02])", r"'\1\1'"),
    ]
    x = "chr(10) || translate(lower(coalesce(text, '')), chr(1) || chr(2), '  ') || chr(10) || chr(10)"
    for pattern, by in steps:
        x = f"regexp_replace({x}, {_text(pattern)}, {by}, 'g')"
    return rf"""
WITH known(sentence, id) AS (VALUES {table}),
m AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({x}, {_text(whole)}, 1) AS found FROM documents),
n AS (SELECT r, unnest(list_transform(found, lambda s: trim(regexp_replace(s, '[ \x02]+', ' ', 'g')))) AS sentence, generate_subscripts(found, 1) AS pos FROM m),
f AS (SELECT r, count(*) AS k, string_agg(id, ',' ORDER BY pos) AS ids FROM n JOIN known USING (sentence) GROUP BY r),
d AS (SELECT doc_id, coalesce(k, 0) AS k, coalesce(ids, '') AS ids, ',' || coalesce(ids, '') || ',' AS w FROM m LEFT JOIN f USING (r)),
h AS (SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL) AS hits FROM d),
u AS (SELECT *, list_filter(hits, lambda x, i: list_position(hits, x) = i) AS first_hits FROM h)
SELECT doc_id, k AS n_license_sentences, ids AS sentence_ids,
       array_to_string(list_transform(first_hits, lambda x: split_part(x, '|', 1)), ',') AS licenses,
       coalesce(split_part(first_hits[1], '|', 1), 'none') AS license,
       coalesce(split_part(first_hits[1], '|', 2), 'none') AS kind
FROM u
"""


def mixing(domain: str, weights: dict[str, dict[str, int]], share: float, max_epochs: int, seed: int) -> str:
    """SQL of the mix by domain, lang and source of ``documents``."""
    levels = ["domain", "lang", "source"]

    def weight(level: str) -> str:
        own = weights.get(level, {})
        cases = "".join(f" WHEN {_text(k)} THEN {v}" for k, v in own.items() if k != "*")
        other = own.get("*", 1)
        return f"CASE {level}{cases} ELSE {other} END" if cases else str(other)

    parts = [
        f"""WITH rows AS (
  SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents)""",
        f"""n3 AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply, {weight("source")} AS w,
  CASE WHEN {weight("source")} > 0 THEN sum(tokens)::BIGINT * {max_epochs} ELSE 0 END AS c FROM rows GROUP BY ALL)""",
        f"n2 AS (SELECT domain, lang, {weight('lang')} AS w, CASE WHEN {weight('lang')} > 0 THEN sum(c)::BIGINT ELSE 0 END AS c FROM n3 GROUP BY domain, lang)",
        f"n1 AS (SELECT domain, {weight('domain')} AS w, CASE WHEN {weight('domain')} > 0 THEN sum(c)::BIGINT ELSE 0 END AS c FROM n2 GROUP BY domain)",
        f"a0 AS (SELECT least(floor((SELECT sum(tokens) FROM rows) * {share})::BIGINT, (SELECT sum(c) FROM n1)::BIGINT) AS b)",
    ]
    for depth in (1, 2, 3):
        family, keys = ", ".join(levels[: depth - 1]), ", ".join(levels[:depth])
        over = f"PARTITION BY {family}" if family else ""
        using = f"JOIN a{depth - 1} USING ({family})" if family else "CROSS JOIN a0"
        parts.append(
            f"""o{depth} AS (SELECT {keys}, w, c, b,
  c * sum(w) OVER ({over} ORDER BY CASE WHEN w > 0 THEN c / w ELSE 1e300 END, {levels[depth - 1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (b - coalesce(sum(c) OVER ({over} ORDER BY CASE WHEN w > 0 THEN c / w ELSE 1e300 END, {levels[depth - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS filled
  FROM n{depth} {using})"""
        )
        parts.append(
            f"""a{depth} AS (SELECT {keys}, (CASE WHEN filled THEN c ELSE coalesce(
  (w * (b - sum(CASE WHEN filled THEN c ELSE 0 END) OVER ({over}))) // nullif(sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({over}), 0), 0) END)::BIGINT AS b FROM o{depth})"""
        )
    parts.append("leaf AS (SELECT domain, lang, source, supply, b, CASE WHEN supply > 0 THEN b // supply ELSE 0 END AS epochs FROM n3 JOIN a3 USING (domain, lang, source))")
    parts.append(
        f"""taken AS (SELECT doc_id, domain, lang, source, tokens, epochs,
  sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= b - epochs * supply AS more
  FROM rows JOIN leaf USING (domain, lang, source))"""
    )
    return ",\n".join(parts) + "\nSELECT doc_id, domain, lang, source, tokens, (epochs + CASE WHEN more THEN 1 ELSE 0 END)::BIGINT AS copies FROM taken WHERE epochs > 0 OR more"


def quality_rules(rules: dict, risk: float, delta: float) -> str:
    """SQL of the quality rules with language strata."""
    tests = ", ".join(f"({_text(r)}, {i}, {c}::DOUBLE)" for r, (_, _, cuts) in rules.items() for i, c in enumerate(cuts))
    value = "CASE rule " + " ".join(f"WHEN {_text(r)} THEN coalesce({a}::DOUBLE / nullif({b}, 0), 0)" for r, (a, b, _) in rules.items()) + " END"
    order = ", ".join(f"({_text(r)}, {i})" for i, r in enumerate(rules))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM w)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([p, p + 1, p + 2]) AS p FROM twice) GROUP BY r),
s AS (
  SELECT doc_id, stratum, t, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines)::BIGINT AS n_lines, d.r
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)
), tests(rule, i, cutoff) AS (VALUES {tests}), ranks(rule, pos) AS (VALUES {order}),
good AS (SELECT min(r) AS r FROM s WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) GROUP BY stratum, t),
h AS (SELECT stratum, r, i, bool_or({value} >= cutoff) AS hit FROM s JOIN good USING (r) CROSS JOIN tests GROUP BY stratum, r, i),
k AS (SELECT stratum, i, count(*) AS n, count(*) FILTER (WHERE hit) AS k FROM h GROUP BY stratum, i),
f AS (
  SELECT *, (CASE WHEN k < n * {risk} THEN list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) ELSE 1 END)
    <= {delta} / (SELECT count(DISTINCT stratum) FROM k) AS passed FROM k
), best AS (
  SELECT stratum, max(i) AS i FROM (SELECT *, bool_and(passed) OVER (PARTITION BY stratum ORDER BY i) AS ok FROM f) WHERE ok GROUP BY stratum
), hit AS (
  SELECT r, string_agg(rule, ',' ORDER BY pos) AS rejected_by FROM s JOIN best USING (stratum) JOIN tests USING (i) JOIN ranks USING (rule) WHERE {value} >= cutoff GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rejected_by IS NULL AS kept,
       coalesce(rejected_by, '') AS rejected_by
FROM s LEFT JOIN hit USING (r)
"""

"""SQL of the text queries for DuckDB, where SQL can say them on whole tables.

None for op2, op5, op6, op8, op9, op10 and the pipeline: trained weights, seeded
permutations, merges by rank, bins and content-defined chunks have no SQL; tests/llm
holds those queries against brute force, round trips and the libraries named.
"""

from __future__ import annotations

import math

from viamark.llm.license_scan import NOTICES, PHRASES, THRESHOLD, size_classes
from viamark.llm.quality import ALPHA, LADDER, MAX_FALSE, STRATA

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def license_sql() -> str:
    """Phrases by position, and every notice compared with every block, without filters."""
    phrases = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        test = " AND ".join(f"w[i + {k}] = {_quoted(x)}" for k, x in enumerate(words))
        phrases.append(f"SELECT r, i - 1 AS pos, {_quoted(label)} AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t WHERE list_contains(w, {_quoted(words[0])})) WHERE {test}")
    blocks, notices = [], []
    for span, group in size_classes(NOTICES).items():
        blocks.append(f"SELECT r, {span} AS span, k, list_distinct(w[k * {span} + 1 : k * {span} + {2 * span}]) AS b FROM (SELECT r, w, unnest(range(0, greatest(0, (len(w) - {span} - 1) // {span}) + 1)) AS k FROM t)")
        for n, (label, words, must) in enumerate(group):
            own = list(dict.fromkeys(words))
            notices.append(f"({span}, {n}, {_quoted(label)}, [{', '.join(map(_quoted, own))}], {math.ceil(THRESHOLD * len(own) - 1e-9)}, [{', '.join(map(_quoted, must))}])")
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS w FROM documents
), p AS ({' UNION ALL '.join(phrases)}
), base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM p GROUP BY r
), block AS ({' UNION ALL '.join(blocks)}
), notice(span, n, label, words, least, must) AS (VALUES {', '.join(notices)}
), hit AS (
  SELECT r, CASE WHEN list_has_all(b, must) THEN label ELSE 'unnamed' END AS label, len(list_intersect(b, words)) AS c, len(words) AS size
  FROM block JOIN notice USING (span) WHERE len(list_intersect(b, words)) >= least
), found AS (SELECT r, CASE WHEN count(*) FILTER (label <> 'unnamed') > 0 THEN list(DISTINCT label) FILTER (label <> 'unnamed') ELSE ['unnamed'] END AS labels, max(c / size) AS share FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
FROM t LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""


EXACT = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(length(text), 0) AS n, sha256(translate(coalesce(text, ''), {_BLANKS}, '')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST, r)"""

#: All pairs of texts that share a shingle, then the smallest doc_id that links reach.
NEAR = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM t WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
), reach AS (SELECT doc_id AS v, doc_id AS u FROM t UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.u)
SELECT v AS doc_id, min(u) AS class_id, (SELECT count(*) FROM link WHERE link.a = v) AS n_links FROM reach GROUP BY v"""


def quality_sql() -> str:
    """The counts, the cutoffs by the exact binomial tail, and the verdict."""
    rules = {
        "symbol_share": "n_symbols / greatest(word_chars, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)", "upper_share": "n_upper / greatest(word_chars, 1)", "digit_share": "n_digits / greatest(word_chars, 1)",
    }
    count = lambda chars: f"length(x) - length(translate(x, '{chars}', ''))"
    level, part = math.log(ALPHA / (len(STRATA) + 1)), MAX_FALSE
    worst = f"greatest({', '.join(rules.values())})"
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x, CASE WHEN lang IN ({', '.join(map(_quoted, STRATA))}) THEN lang ELSE 'other' END AS stratum,
    list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda z: z <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda z: length(translate(z, {_BLANKS}, '')) > 0) AS l FROM documents
), g AS (SELECT r, k, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM t WHERE len(w) > 4)
), again AS (SELECT r, k FROM g QUALIFY count(*) OVER (PARTITION BY r, s) > 1
), covered AS (SELECT r, count(DISTINCT k + o) AS n FROM again, range(0, 5) z(o) GROUP BY r
), m AS (
  SELECT t.r, doc_id, stratum, sha256(translate(x, {_BLANKS}, '')) AS d, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(x, {_BLANKS}, '')) AS BIGINT) AS word_chars,
    CAST({count('#*$%&|<>')} AS BIGINT) AS n_symbols, {count(_UP)} AS n_upper, {count('0123456789')} AS n_digits, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN covered ON covered.r = t.r
), good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1
), b AS (SELECT *, {worst} AS v, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), cut(cutoff) AS (VALUES {', '.join(f'({c})' for c in LADDER)}
), held AS (SELECT stratum, d, max(v) AS v FROM b JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY ALL
), seen AS (
  SELECT stratum, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k FROM held, cut GROUP BY ALL
), tail AS (
  SELECT stratum, cutoff, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({part}) + (n - j) * ln(1 - {part}))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM seen WHERE k <= {part} * n) GROUP BY ALL
), chosen AS (SELECT stratum, min(cutoff) AS cutoff FROM tail WHERE ln(p) <= {level} GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (cutoff IS NULL OR v <= cutoff) AS kept FROM b LEFT JOIN chosen USING (stratum)"""


def collocation_sql() -> str:
    """All phrases of one to three words as strings, counted, cut, compared with longer ones."""
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), (VALUES (1), (2), (3)) AS s(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT f.lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 :], ' ') AS y FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f) AS f),
s AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, 1000000 * c.a::HUGEINT * c.a::HUGEINT // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM c JOIN f AS l ON l.lang = c.lang AND l.phrase = x JOIN f AS r ON r.lang = c.lang AND r.phrase = y),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1 : 2], ' '), array_to_string(string_split(phrase, ' ')[2 : 3], ' ')]) AS phrase FROM f WHERE m = 3) GROUP BY ALL),
left_over AS (SELECT low.* FROM low LEFT JOIN o USING (lang, phrase) WHERE o.a IS NULL OR 100 * o.a < 50 * low.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over) JOIN n USING (lang) WHERE rank <= 2000
"""


def leak_sql() -> str:
    """Every window as a string, against every stretch of as many words of every document."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
v AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT m FROM v) WHERE i + m - 1 <= len(w)),
h AS (SELECT r, i, m, item FROM g JOIN v USING (m, s)),
n AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM h, range(0, 10) z(o) WHERE o < m GROUP BY r),
k AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)"""


#: All anchors against all rows.
NEGATIVES = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT r, o, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, p.o ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3"""


ORACLE = {
    "op1_license_scan": license_sql(), "op3_exact_dedup": EXACT, "op4_ngram_join": NEAR, "op7_quality_rules": quality_sql(),
    "op11_collocations": collocation_sql(), "op12_decontaminate": leak_sql(), "op13_hard_negatives": NEGATIVES,
}

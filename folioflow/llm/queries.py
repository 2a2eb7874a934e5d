"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from folioflow.llm.exact import op2_exact_dedup
from folioflow.llm.html import op3_html_extraction
from folioflow.llm.jaccard import op4_ngram_jaccard
from folioflow.llm.language import op10_language_id
from folioflow.llm.lempelziv import op9_substring_dedup
from folioflow.llm.merges import op6_sentencepiece
from folioflow.llm.merkle import op13_merkle_manifest
from folioflow.llm.packing import op5_packing
from folioflow.llm.phrases import op12_phrase_collocation
from folioflow.llm.pii import op8_pii
from folioflow.llm.quality import op1_quality_rules
from folioflow.llm.suffixes import op7_suffix_array_dedup
from folioflow.llm.warc import op11_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_packing": op5_packing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_pii": op8_pii,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_warc": op11_warc,
    "op12_phrase_collocation": op12_phrase_collocation,
    "op13_merkle_manifest": op13_merkle_manifest,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def merkle_sql(levels: int = 5, top: int = 3) -> str:
    """SQL of operator 13 for sources of up to 16 ** levels rows, up to 16 ** top of them. ``n`` and ``s`` are the levels of the sources' trees and
    of the one above, with the number of nodes of each; ``r`` their runs; ``q`` what a row's path has made of it up to a level."""
    coded = [f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", "n_chars")]
    text = f"translate(text, '{UPPER}', '{LOWER}')"
    leaf, lower = (f"sha256({' || '.join(coded)} || coalesce(strlen({x}) || ':' || {x}, '-'))" for x in ("text", text))
    bits = "flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(doc_id::VARCHAR, '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    out = [f"d AS (SELECT doc_id, source, {leaf} AS h, CASE WHEN {crc} % 5 = 0 THEN {lower} ELSE {leaf} END AS changed FROM documents)"]
    out.append("n0 AS (SELECT doc_id, changed, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, h, count(*) OVER (PARTITION BY source) AS c FROM d)")
    out.append("q0 AS (SELECT doc_id, h AS leaf, source, i, changed AS node, '' AS proof FROM n0)")

    def climb(n: str, q: str, depth: int, start: int) -> None:
        for k in range(depth):
            own = f"64 * ({q}{start + k}.i % 16)"
            before, behind = f"substr(hs, 1, {own})", f"substr(hs, {own} + 65)"
            out.append(f"r{n}{k} AS (SELECT source, i // 16 AS i, string_agg(h, '' ORDER BY i) AS hs FROM {n}{k} WHERE c > 1 GROUP BY 1, 2)")
            out.append(f"{n}{k + 1} AS (SELECT source, i, sha256(hs) AS h, count(*) OVER (PARTITION BY source) AS c FROM r{n}{k})")
            out.append(
                f"{q}{start + k + 1} AS (SELECT doc_id, leaf, {q}{start + k}.source AS source, {q}{start + k}.i // 16 AS i, CASE WHEN hs IS NULL THEN node ELSE sha256({before} || node || {behind}) END AS node, "
                f"proof || coalesce({before} || {behind}, '') AS proof FROM {q}{start + k} LEFT JOIN r{n}{k} ON r{n}{k}.source IS NOT DISTINCT FROM {q}{start + k}.source AND r{n}{k}.i = {q}{start + k}.i // 16)"
            )

    climb("n", "q", levels, 0)
    out.append("u AS (" + " UNION ALL ".join(f"SELECT source, h FROM n{k} WHERE c = 1" for k in range(levels + 1)) + ")")
    out.append("v AS (SELECT source AS of, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM u)")
    out.append("s0 AS (SELECT 0 AS source, place AS i, subroot AS h, count(*) OVER () AS c FROM v)")
    out.append(f"p0 AS (SELECT doc_id, leaf, 0 AS source, place AS i, node, proof, v.of AS of FROM q{levels} JOIN v ON v.of IS NOT DISTINCT FROM q{levels}.source)")
    climb("s", "p", top, 0)
    roots = " UNION ALL ".join(f"SELECT h AS root FROM s{k} WHERE c = 1" for k in range(top + 1))
    # a row is told apart by its leaf and proof, which carry its source and place
    out.append(f"z AS (SELECT doc_id, leaf, proof, node, (SELECT root FROM ({roots})) AS root FROM p{top})")
    out.append("y AS (SELECT DISTINCT ON (leaf) p0.leaf, v.subroot FROM p0 JOIN v ON v.of IS NOT DISTINCT FROM p0.of)")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM z JOIN y USING (leaf)"


ORACLE = {
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS k FROM documents),
w AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM w
""",
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 4 ELSE 0 END + CASE WHEN 100 * n_symbols > 25 * n_words THEN 8 ELSE 0 END
             + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words) THEN 16 ELSE 0 END
             + CASE WHEN n_words = 0 THEN 32 ELSE 0 END + CASE WHEN 100 * n_upper > 60 * n_letters THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
""",
    # words of up to five, then pairs by shared shingles, then all that links reach
    "op4_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p, len(w) AS m FROM d),
f AS (SELECT doc_id, m, p, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
e AS (SELECT DISTINCT doc_id, g FROM f WHERE p <= m - 4 OR (m < 5 AND p = 1)),
n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN e USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
""",
    # strings of bytes as hexadecimal digits; runs of removed bytes by their starts
    "op7_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, k, substr(h, 2000 * k + 1, 2098) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM d)),
w AS (SELECT doc_id, 1000 * k + j AS i, substr(g, 2 * j + 1, 100) AS t FROM (SELECT *, unnest(range(0, least(1000, len(g) // 2 - 49))) AS j FROM b)),
f AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t HAVING count(DISTINCT doc_id) > 1),
k AS (SELECT doc_id, i, first FROM w JOIN f USING (t)),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM g GROUP BY doc_id, run),
o AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS z FROM r),
a AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS e, string_agg(substr(h, 2 * z + 1, 2 * (s - z)), '' ORDER BY s) AS kept FROM o JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * e + 1) END)) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
""",
    "op9_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p, len(w) AS m FROM d),
x AS (SELECT doc_id, p AS i, m, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), ' ') AS t FROM e),
k AS (SELECT doc_id, i, min({{'d': doc_id, 'i': i}}) OVER (PARTITION BY t) AS first FROM x WHERE i <= m - 19),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM k WHERE first < {{'d': doc_id, 'i': i}}),
a AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS stays FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN stays = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(stays, page_id) AS refers_to FROM d
""",
    "op12_phrase_collocation": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
f AS (SELECT lang, w[i : i + m - 1] AS p, count(*) AS a FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 5) AS m(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
c AS (SELECT lang, p, a FROM f WHERE len(p) > 1 AND a >= 30),
h AS (SELECT lang, p[i : i + m - 1] AS p, max(a) AS most FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS i FROM c), range(2, 4) AS m(m) WHERE i + m - 1 <= len(p) AND m < len(p) GROUP BY ALL),
e AS (SELECT c.lang, c.p, c.a, unnest(range(1, len(c.p))) AS k FROM c LEFT JOIN h USING (lang, p) WHERE most IS NULL OR 100 * most < 80 * c.a),
s AS (SELECT e.lang, e.p, e.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * e.a) // (x.a + y.a))::BIGINT AS score
      FROM e JOIN f x ON x.lang = e.lang AND x.p = e.p[1 : k] JOIN f y ON y.lang = e.lang AND y.p = e.p[k + 1 :]),
b AS (SELECT DISTINCT ON (lang, p) lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM s ORDER BY lang, p, score, k),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
""",
    "op13_merkle_manifest": merkle_sql(),
}

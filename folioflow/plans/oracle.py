"""SQL for DuckDB that gives the rows of the registered queries."""

from __future__ import annotations

from folioflow.functions import scoring as S
from folioflow.functions import text as T
from folioflow.operators import evaluate as E
from folioflow.plans.registry import DIM, GLOSSARY

NOTES = r"""
n0 AS (SELECT doc_id, lang, source, text AS raw, source || '/' || doc_id || '.md' AS path,
         E'---\ntags: [' || lang || ', ' || source || E']\nkeywords: k' || (doc_id % 5) || E', extra words\naliases:\n  - ' || source || E'\n---\n' AS front,
         '# Note ' || doc_id || E'\n\n## Body\n\n' AS head, replace(text, chr(10), E'\n\n') AS body, E'\n\n### Links\n\nSee ' AS links,
         '[[Note|label]] and [site](http://x.y/z) #tag' || (doc_id % 7) || E'\n\n%%a comment%%\n![[pic.png]] ![alt](pic.png)\n\n#### Deep\n\nDeep text' AS links_raw,
         CASE WHEN doc_id % 6 = 0 THEN E'\n\n# Excalidraw Data\n\nsecret' ELSE '' END AS drawing
       FROM documents),
notes AS (SELECT *, front || head || body || links || links_raw || drawing AS text, doc_id || ' - Note ' || doc_id AS title FROM n0)"""
DOCS = "docs AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, 'Note ' || doc_id AS title, text, lang FROM documents)"
ASKED = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
SPACE = r"[ \t\n\x0B\f\r\x1C-\x1F\x85\xA0]"
KEYS = "|".join(T.METADATA_KEYS)
NOISE = rf"""(regexp_matches(lower(x), '^({KEYS})') OR regexp_matches(x, '^[A-Za-z0-9+/=]{{30,}}$') OR (regexp_matches(x, '%[0-9A-Fa-f]{{2}}%[0-9A-Fa-f]{{2}}') AND length(x) > 30)
 OR regexp_matches(x, '^[:|\-\s*>`%]+$'))"""
#: Comments, embeds and links, in the order in which they go: a comment that opens in the body may take a link with it.
LINKED = "head || body || links || links_raw"
for _pattern, _into in ((r"%%.*?%%", ""), (r"!\[\[.*?\]\]", ""), (r"!\[.*?\]\(.*?\)", ""), (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"https?://\S+", "")):
    LINKED = f"regexp_replace({LINKED}, '{_pattern}', '{_into}', '{'gs' if _pattern.startswith('%%') else 'g'}')"
#: The notes' cleaned text, whose first two headings and last section are known.
CLEAN = rf"""
c00 AS (SELECT *, {LINKED} AS linked FROM notes),
c0 AS (SELECT *, CASE WHEN contains(linked, '#tag') THEN 'tag' || (doc_id % 7) END AS tag FROM c00),
c1 AS (SELECT *, trim(regexp_replace(list_aggregate(list_filter(list_transform(string_split(linked, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]{{2,}}', ' ', 'g'), E' \t\r')),
       lambda x: x = '' OR NOT {NOISE}), 'string_agg', chr(10)), '\n{{3,}}', E'\n\n', 'g'), E' \n') AS clean_text FROM c0)"""
VECTORS = f"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM docs),
buck AS (SELECT doc_id, (('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM}) AS b, count(*)::DOUBLE AS v FROM tok GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM buck GROUP BY 1),
dv AS (SELECT doc_id, b, v / n AS v FROM buck JOIN dn USING (doc_id)),
qtok AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS t FROM asked),
qbuck AS (SELECT query_id, (('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM}) AS b, count(*)::DOUBLE AS v FROM qtok GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qbuck GROUP BY 1),
qv AS (SELECT query_id, b, v / n AS v FROM qbuck JOIN qn USING (query_id)),
sim AS (SELECT query_id, doc_id, round(sum(qv.v * dv.v), 6) + 0.0 AS similarity FROM qv JOIN dv USING (b) GROUP BY ALL)"""
WORDS = f"""
parts AS (SELECT query_id, query, unnest(regexp_split_to_array(query, '[\\s.,、。!?！？_/()（）「」『』【】]+')) AS p FROM asked),
kw0 AS (SELECT query_id, unnest(list_concat(list_filter(regexp_extract_all(p, '{S.HYPHENATED}'), lambda k: length(k) >= 3), regexp_extract_all(p, '[a-zA-Z0-9]{{2,}}'))) AS k FROM parts),
kw AS (SELECT query_id, list(k ORDER BY length(k) DESC, k) AS keywords FROM (SELECT DISTINCT query_id, k FROM kw0) GROUP BY 1)"""


def vectors(rows: str, key: str, text: str, name: str, dim: int = DIM) -> str:
    """Unit vectors of a text column as table ``name``: key, b (bucket), v."""
    return f"""
{name}_b AS (SELECT {key}, (('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}) AS b, count(*)::DOUBLE AS v FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {rows}) GROUP BY ALL),
{name} AS (SELECT {key}, b, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}_b)"""


def plain(x: str) -> str:
    """Markdown as plain sentences."""
    for pattern, into in (
        (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[\[[^\]]+\]\]", ""), (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", r"\1"), (r"https?://[^\s)>]+", ""), (r"\|", " "),
        (r"(?m)^#+\s*", ""), (r"(?m)^\s*[-*+]\s+|^\s*[0-9]+\.\s+", ""), (r"[*_`~]", ""), (r"[ \t]+", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{into}', 'g')"
    return f"trim({x}, E' \\n\\t\\r')"


def candidate_sentences(x: str) -> str:
    """The first eight sentences of a text that read like some. The tables hold no Japanese text."""
    pieces = f"string_split(regexp_replace({plain(x)}, '([。！？.?!])', E'\\\\1\\n', 'g'), chr(10))"
    bare = f"list_transform({pieces}, lambda y: trim(regexp_replace(trim(y, E' \\n\\t\\r'), '^[\\s#\\-*|>`()\\[\\]]+|[\\s#\\-*|>`()\\[\\]]+$', '', 'g'), E' \\n\\t\\r'))"
    good = f"length(y) >= 8 AND len(regexp_extract_all(y, '[\\p{{L}}\\p{{M}}\\p{{N}}_]')) >= 6 AND NOT regexp_matches(lower(y), '\\.({'|'.join(T.FILE_NAME_MARKS)})')"
    return f"list_filter({bare}, lambda y: {good})[1:8]"


def best_sentence(rows: str, key: str, text: str, q: str) -> str:
    """Table best: key, salient_sentence, of the sentences of ``rows`` closest to the vectors ``q`` (key, b, v)."""
    return f"""
sen AS (SELECT {key}, unnest(x) AS s, unnest(range(0, len(x))) AS place FROM (SELECT {key}, {candidate_sentences(text)} AS x FROM {rows})),{vectors('sen', f'{key}, place', 's', 'sv')},
sc AS (SELECT {key}, place, s, coalesce(round(sum(sv.v * q.v), 6), 0.0) + 0.0 AS score FROM sen LEFT JOIN sv USING ({key}, place) LEFT JOIN {q} q USING ({key}, b) GROUP BY ALL),
best AS (SELECT {key}, s AS salient_sentence FROM sc QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, place) = 1 AND score >= 0.55)"""


def base(x: str, floor: str = "0.7", exponent: str = "1.6", width: str = "0.23") -> str:
    return f"(CASE WHEN {x} < {floor} THEN greatest(0.0, ({x} - 0.45) / 1.8) ELSE 0.15 + 0.67 * pow(least(greatest(({x} - {floor}) / {width}, 0.0), 1.0), {exponent}) END)"


def ranked(top: int, fetch: int, more: str = "", min_score: float = 0.0) -> str:
    """Hits of ``search_documents`` as table hits."""
    keep = f"WHERE score >= {min_score}" if min_score else ""
    return f"""{VECTORS},{WORDS},
raw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS raw_rank FROM sim QUALIFY raw_rank <= {fetch}),
m AS (SELECT raw.*, docs.path, docs.title, docs.text, docs.lang, coalesce(keywords, []) AS kws, lower(text) AS lt,
        list_transform(coalesce(keywords, []), lambda k: lower(k)) AS low FROM raw JOIN docs USING (doc_id) LEFT JOIN kw USING (query_id)),
m2 AS (SELECT *, len(low) AS total,
        len(list_filter(low, lambda k: contains(lower(title), k) OR contains(path, k) OR contains(lt, k) OR k = doc_id::VARCHAR)) AS matched,
        len(list_filter(low, lambda k: contains(lower(title), k) OR contains(path, k))) AS in_title, list_contains(low, doc_id::VARCHAR) AS is_stem FROM m),
m3 AS (SELECT *, CASE WHEN total = 0 THEN round(least({base('similarity')}, 0.98), 4)
        ELSE round(least(greatest({base('similarity')} + matched / total * 0.12 + CASE WHEN is_stem THEN 0.08 ELSE least(in_title * 0.03, 0.06) END, 0.0), 0.98), 4) END AS score FROM m2),
m4 AS (SELECT * FROM m3 {keep}),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_rank) AS rank,
         CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM m4 QUALIFY rank <= {top}){more}"""


BM25 = """
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM docs),
stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_length FROM words),
terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS term FROM asked),
tf AS (SELECT doc_id, len(w) AS length, t.term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM words) t WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score
       FROM tf JOIN df USING (term) JOIN terms USING (term), stats GROUP BY ALL)"""


def bm25(limit: int) -> str:
    return f"{BM25}, kh AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= {limit})"


def fused(score: str, digits: int, keep: str = "true") -> str:
    return f"""{DOCS}, {ASKED},{ranked(40, 160)}, {bm25(40)},
v AS (SELECT query_id, path, rank AS vector_rank, score AS vector_score FROM hits),
k AS (SELECT query_id, docs.path, rank AS keyword_rank, CASE WHEN score = 0 THEN 1.0 ELSE score END AS keyword_score FROM kh JOIN docs USING (doc_id) WHERE {keep}),
most AS (SELECT query_id, greatest(1.0, max(keyword_score)) AS most FROM k GROUP BY 1),
b AS (SELECT *, coalesce(vector_rank, keyword_rank + 1000000) AS first_at FROM v FULL JOIN k USING (query_id, path) LEFT JOIN most USING (query_id)),
s AS (SELECT *, round({score}, {digits}) AS hybrid_score, CASE WHEN vector_rank IS NULL THEN 'keyword_only' WHEN keyword_rank IS NULL THEN 'vector_only' ELSE 'both' END AS match_type FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, first_at) AS rank FROM s QUALIFY rank <= 20)"""


RRF = "coalesce(0.5 * (1.0 / (60 + vector_rank)), 0.0) + coalesce(0.5 * (1.0 / (60 + keyword_rank)), 0.0)"
FUSED = "query_id, rank::INT AS rank, path, hybrid_score, match_type, vector_rank::INT AS vector_rank, keyword_rank::INT AS keyword_rank"
HTML = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
JUDGED = """
held AS (SELECT query_id, min({'p': path, 'l': lang}) AS m FROM asked JOIN docs ON contains(docs.text, asked.query) GROUP BY 1),
judged AS (SELECT query_id, query, coalesce(m.p, 'none') AS expected, coalesce(m.l, 'none') AS category FROM asked LEFT JOIN held USING (query_id))"""
RANKS = """
ranks AS (SELECT judged.query_id, category, min(CASE WHEN contains(lower(path), lower(expected)) THEN rank END) AS r, max(CASE WHEN rank = 1 THEN score END) AS top FROM judged LEFT JOIN hits USING (query_id) GROUP BY ALL)"""
METRICS = """round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5,
round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr, round(avg(CASE WHEN coalesce(top, 0) >= 0.9999 THEN 1.0 ELSE 0.0 END), 6) AS saturation, round(coalesce(stddev_pop(top), 0.0), 5) AS score_std, round(avg(coalesce(top, 0.0)), 4) AS mean_score, count(*) AS total"""


def topk_sql(queries: str, k: int, more: str = "") -> str:
    return f"""WITH q AS ({queries}), s AS (SELECT q.query_id, e.vec_id, round(list_sum(list_transform(range(1, {DIM} + 1), lambda i: q.v[i]::DOUBLE * e.embedding[i]::DOUBLE)), 6) + 0.0 AS score FROM q, embeddings e),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= {k}) SELECT * FROM t {more}"""


SELF = "SELECT vec_id AS query_id, embedding AS v FROM embeddings"
ALTERED = """docs AS (SELECT source || '/' || doc_id || '.md' AS path, doc_id, sha256(text) AS sha FROM documents),
b AS (SELECT path, doc_id, CASE WHEN doc_id % 10 = 1 THEN 'created' WHEN doc_id % 10 = 3 THEN 'deleted' WHEN doc_id % 10 = 2 THEN 'updated' ELSE 'skipped' END AS status FROM docs)"""
LOG = "log AS (SELECT 'u/' || user_id || '.md' AS path, CASE WHEN event_id % 5 = 0 THEN 'deleted' ELSE 'upsert' END AS op, event_id AS batch_id, ts FROM events)"
GLOSS = "gl AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {list(s)!r}::VARCHAR[], '{d}')" for i, t, s, d in GLOSSARY) + ") AS g(entry_id, term, synonyms, description))"
DETECTED = r""",
va AS (SELECT entry_id, unnest(list_concat([term], synonyms)) AS v, unnest(range(0, len(synonyms) + 1)) AS place FROM gl),
vk AS (SELECT *, lower(v) AS lv, regexp_replace(lower(v), '[\s\-_ー−―]+', '', 'g') AS k FROM va),
tx AS (SELECT id, lower(t) AS lt, regexp_replace(lower(t), '[\s\-_ー−―]+', '', 'g') AS nt FROM texts),
fo AS (SELECT id, entry_id, min(CASE WHEN length(v) >= 2 AND contains(lt, lv) THEN [0, -length(v), entry_id, place] ELSE [1, 0, entry_id, place] END) AS r
       FROM tx JOIN vk ON (length(v) >= 2 AND contains(lt, lv)) OR (length(k) >= 2 AND contains(nt, k)) GROUP BY ALL),
de AS (SELECT id, entry_id, row_number() OVER (PARTITION BY id ORDER BY r)::INT AS place FROM fo)"""
DETECT = GLOSS + DETECTED
PARTS = "gl AS (SELECT p_partkey::INT AS entry_id, p_name || ' ' || p_partkey AS term, ['P-' || p_partkey, p_brand || ' no ' || p_partkey] AS synonyms, p_type AS description FROM part)"
GRID = "grid AS (SELECT * FROM (SELECT unnest([{}]) AS noise_floor), (SELECT unnest([{}]) AS exponent), (SELECT unnest([{}]) AS lexical_weight), (SELECT unnest([{}]) AS stem_bonus))".format(
    *(", ".join(f"{x}::DOUBLE" for x in v) for v in (E.NOISE_FLOORS, E.EXPONENTS, E.LEXICAL_WEIGHTS, E.STEM_BONUSES))
)
BUNDLE = r""",
sel AS (SELECT row_number() OVER (ORDER BY query_id) AS n, expected AS path FROM judged WHERE expected <> 'none'),
b AS (SELECT n, title, doc_id % 3 = 0 AS has, '![' || CASE WHEN doc_id % 3 = 0 THEN '](data:image/png;base64,' || to_base64(encode(lang || doc_id)) || ')' ELSE '[img ' || doc_id || '.png]]' END || chr(10) || text AS body,
             n = max(n) OVER () AS ends FROM sel JOIN docs USING (path)),
content AS (SELECT 0 AS section, 0::BIGINT AS number, E'# Notes\n\nRead this.\n\n' AS content
  UNION ALL SELECT 1, n, n || '. ' || title || CASE WHEN ends THEN E'\n\n' ELSE chr(10) END FROM b
  UNION ALL SELECT 2, n, '## ' || n || '. ' || title || E'\n\n' || body || CASE WHEN ends THEN '' ELSE E'\n\n' END FROM b),
parts AS (SELECT *, octet_length(encode(content))::BIGINT AS n_bytes FROM content)"""
CONTEXT_LINES = "string_split(trim(coalesce(nullif(preview, ''), ''), E' \\n\\r\\t'), chr(10))"
PACK = r"""
x AS (SELECT *, '] [Tags: #' || lang || ' #' || source || coalesce(' #' || tag, '') || '] [Aliases: ' || source || '] [Keywords: extra k' || (doc_id % 5) || ' words]' AS meta, '[' || title || ' > Note ' || doc_id || ' > Body' AS crumbs,
        contains(clean_text, E'\n### Links') AS has_links, split_part(clean_text, '## Body', 2) AS rest FROM c1),
s AS (SELECT *, crumbs || meta AS ctx, crumbs || ' > Links' || meta AS last_ctx, crumbs || CASE WHEN has_links THEN ' > Links > Deep' ELSE ' > Deep' END AS deep_crumbs,
        trim(split_part(CASE WHEN has_links THEN split_part(rest, '### Links', 1) ELSE rest END, '#### Deep', 1), E' \n') AS main, CASE WHEN has_links THEN trim(split_part(split_part(rest, '### Links', 2), '#### Deep', 1), E' \n') END AS tail FROM x),
p AS (SELECT *, CASE WHEN main = '' THEN [] WHEN length(main) <= 600 THEN [main] ELSE string_split(list_reduce(list_filter(list_transform(regexp_split_to_array(main, '\n\s*\n'), lambda x: trim(x, E' \n\t\r')), lambda x: x <> ''),
        lambda a, x: CASE WHEN a = '' THEN x WHEN length(string_split(a, chr(1))[-1]) + length(x) + 2 <= 600 THEN a || E'\n\n' || x
          ELSE a || chr(1) || CASE WHEN length(string_split(a, chr(1))[-1]) > 80 THEN right(a, 80) || E'\n\n' || x ELSE x END END, ''), chr(1)) END AS parts FROM s),
k AS (SELECT doc_id, path, list_concat(list_transform(parts, lambda x: trim(ctx || E'\n' || x, E' \n')), list_filter([last_ctx || E'\n' || tail, deep_crumbs || meta || E'\nDeep text'], lambda y: y IS NOT NULL)) AS chunks FROM p),
ch AS (SELECT doc_id, path, unnest(chunks) AS chunk_text, unnest(range(0, len(chunks)))::INT AS chunk_index FROM k)"""

#: Hits of ``search_chunks`` as table hits.
CHUNK_HITS = f"""{NOTES},{CLEAN},{PACK}, {ASKED},{WORDS},
docs AS (SELECT doc_id * 100000 + chunk_index AS chunk_id, doc_id, chunk_index, path, title, chunk_text, split_part(chunk_text, chr(10), 1) AS header FROM ch JOIN (SELECT doc_id, title FROM notes) USING (doc_id)),
{vectors('docs', 'chunk_id', 'chunk_text', 'dv')},{vectors('asked', 'query_id', 'query', 'qv')},
sim AS (SELECT query_id, chunk_id, round(sum(qv.v * dv.v), 6) + 0.0 AS similarity FROM qv JOIN dv USING (b) GROUP BY ALL),
raw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS raw_rank FROM sim QUALIFY raw_rank <= 80),
m AS (SELECT raw.*, docs.*, coalesce(keywords, []) AS kws, list_transform(coalesce(keywords, []), lambda k: lower(k)) AS low FROM raw JOIN docs USING (chunk_id) LEFT JOIN kw USING (query_id)),
m2 AS (SELECT *, len(low) AS total, len(list_filter(low, lambda k: contains(lower(title), k) OR contains(path, k) OR contains(lower(chunk_text), k) OR k = doc_id::VARCHAR)) AS matched,
         len(list_filter(low, lambda k: contains(lower(title), k) OR contains(path, k))) AS in_title, len(list_filter(low, lambda k: contains(lower(header), k))) AS in_header, list_contains(low, doc_id::VARCHAR) AS is_stem FROM m),
m3 AS (SELECT *, CASE WHEN total = 0 THEN round(least({base('similarity')}, 0.98), 4) ELSE round(least(greatest({base('similarity')} + matched / total * 0.12
         + CASE WHEN is_stem THEN 0.08 ELSE least(in_title * 0.03, 0.06) END + least(in_header * 0.04, 0.08), 0.0), 0.98), 4) END AS score FROM m2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw_rank)::INT AS rank FROM m3 QUALIFY rank <= 20)"""

SQL = {
    "path_parts": r"""SELECT page_id, regexp_extract(url, '(?s)^(.*)[/\\][^/\\]*$', 1) AS parent, regexp_extract(url, '([^/]*)/*$', 1) AS name,
  lower(regexp_replace(regexp_replace(url, '/(\.?/)+', '/', 'g'), '(.)/\.?$', '\1')) AS key,
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[/\\]+$', ''), '([^/]*)$', 1), '[^a-zA-Z0-9_\-.]', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS model_id,
  regexp_replace(regexp_replace(trim(url), '[\\/:*?"<>|]', '_', 'g'), '\s+', '_', 'g') AS slug,
  CASE WHEN starts_with(url, 'https://www.') THEN regexp_replace(substr(url, 13), '^[/\\]+', '') ELSE url END AS relative, url_decode(regexp_extract(url, '^([^?#]*)', 1)) AS decoded FROM pages""",
    "asset_resolve": """SELECT source || '/' || doc_id || '.md' AS path, 'img%20' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.PNG' ELSE '' END AS reference,
  CASE WHEN doc_id % 11 <> 0 THEN CASE doc_id % 3 WHEN 0 THEN source || '/' WHEN 1 THEN '' ELSE 'other/' END || 'img ' || doc_id || '.png' END AS asset_path FROM documents""",
    "context_bundle": f"""WITH {DOCS}, {ASKED},{JUDGED}{BUNDLE}
SELECT section, number, (coalesce(sum(n_bytes) OVER (ORDER BY section, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", n_bytes, sha256(content) AS sha256 FROM parts""",
    "bundle_totals": f"WITH {DOCS}, {ASKED},{JUDGED}{BUNDLE} SELECT (SELECT count(*) FROM b) AS n_documents, (SELECT count(*) FILTER (WHERE has) FROM b) AS n_assets, sum(n_bytes)::BIGINT AS n_bytes FROM parts",
    "search_chunk_ranks": f"WITH {CHUNK_HITS} SELECT query_id, rank, chunk_id, score, similarity FROM hits",
    "search_chunks": f"""WITH {CHUNK_HITS}, asking AS (SELECT chunk_id, query_id, chunk_text FROM hits WHERE raw_rank <= 3), hq AS (SELECT asking.chunk_id, query_id, b, v FROM asking JOIN qv USING (query_id)),{best_sentence('asking', 'query_id, chunk_id', 'chunk_text', 'hq')},
beside AS (SELECT chunk_id, lag(chunk_index) OVER w AS prev, lead(chunk_index) OVER w AS next FROM docs WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))
SELECT query_id, rank, doc_id, chunk_index, score, similarity, prev, next, salient_sentence FROM hits JOIN beside USING (chunk_id) LEFT JOIN best USING (query_id, chunk_id)""",
    "salient_sentence": f"WITH {DOCS},{vectors('docs', 'doc_id', 'text', 'dv')},{best_sentence('docs', 'doc_id', 'text', 'dv')} SELECT doc_id, salient_sentence FROM best",
    "model_compare": f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS ta, b.text AS tb FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
{", ".join(f"{vectors('p', 'conv_id, turn', t, f'{t}{d}', d)}" for t in ("ta", "tb") for d in (64, 16))},
s AS (SELECT 'hash_64' AS model, conv_id, turn, round(sum(x.v * y.v), 6) AS s FROM ta64 x JOIN tb64 y USING (conv_id, turn, b) GROUP BY ALL UNION ALL SELECT 'hash_16', conv_id, turn, round(sum(x.v * y.v), 6) FROM ta16 x JOIN tb16 y USING (conv_id, turn, b) GROUP BY ALL)
SELECT model, count(*) AS n, round(avg(coalesce(s, 0.0)), 4) AS mean FROM (SELECT m.model, p.conv_id, p.turn FROM p, (VALUES ('hash_64'), ('hash_16')) AS m(model)) LEFT JOIN s USING (model, conv_id, turn) GROUP BY 1""",
    "search_documents": f"WITH {DOCS}, {ASKED},{ranked(20, 80)} SELECT query_id, rank::INT AS rank, doc_id, score, similarity, preview FROM hits",
    "overfetch_rerank": f"WITH {DOCS}, {ASKED},{ranked(5, 20, min_score=0.3)} SELECT query_id, rank::INT AS rank, doc_id, score, raw_rank::INT AS raw_rank FROM hits",
    "title_extract": f"WITH {NOTES} SELECT path, title FROM notes",
    "content_fingerprint": "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size FROM documents",
    "frontmatter_tags": f"WITH {NOTES},{CLEAN} SELECT path, concat_ws('|', lang, source, tag) AS tags, source AS aliases, 'extra|k' || (doc_id % 5) || '|words' AS keywords FROM c0",
    "clean_text": f"WITH {NOTES},{CLEAN} SELECT path, clean_text FROM c1",
    "plain_text_view": f"WITH {NOTES} SELECT path, {plain('text')} AS plain FROM notes",
    "line_filters": rf"""WITH {NOTES}, l AS (SELECT path, trim(unnest(string_split(text, chr(10))), E' \t\r') AS x FROM notes)
SELECT path, count(*) AS n_lines, count(*) FILTER (WHERE {NOISE}) AS n_noise FROM l WHERE x <> '' GROUP BY 1""",
    "chunk_pack": f"WITH {NOTES},{CLEAN},{PACK} SELECT path, chunk_index, chunk_text FROM ch",
    "chunk_stats": f"WITH {NOTES},{CLEAN},{PACK} SELECT count(DISTINCT path) AS document_count, count(*) AS chunk_count, sum(length(chunk_text))::BIGINT AS n_chars FROM ch",
    "section_breadcrumbs": f"""WITH {NOTES},{CLEAN},{PACK} SELECT path, crumbs || ']' AS context, length(main)::INT AS n_chars FROM s WHERE main <> ''
UNION ALL SELECT path, crumbs || ' > Links]', length(tail)::INT FROM s WHERE has_links UNION ALL SELECT path, deep_crumbs || ']', 9 FROM s""",
    "metadata_prefix": f"WITH {NOTES},{CLEAN},{PACK} SELECT path, substr(meta, 3) AS prefix FROM x",
    "model_prefix": "WITH h AS (SELECT doc_id, left(text, 2000) AS head FROM documents) SELECT doc_id, '検索文書: ' || head AS ruri, 'query: ' || head AS e5, head AS plain FROM h",
    "highlight": "SELECT doc_id, regexp_replace(text, '(that|the|le)', '<mark>\\1</mark>', 'gi') AS marked FROM documents",
    "snippets": """WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '<mark>' || left(text, 5) || '</mark>' || text ELSE text END AS f FROM documents),
y AS (SELECT *, regexp_replace(f, '<[^>]+>', '', 'g') AS b FROM x) SELECT doc_id, CASE WHEN length(b) > 200 THEN left(b, 200) || '...' ELSE f END AS snippet FROM y""",
    "query_keywords": f"WITH {ASKED},{WORDS} SELECT query_id, array_to_string(coalesce(keywords, []), '|') AS keywords, CASE WHEN keywords IS NULL THEN query ELSE array_to_string(keywords, ' OR ') END AS keyword_query FROM asked LEFT JOIN kw USING (query_id)",
    "html_escape": f"SELECT page_id, {HTML('html')} AS escaped FROM pages",
    "drawing_notes": f"WITH {NOTES} SELECT path, doc_id % 5 = 0 OR strpos(text, '# Excalidraw') BETWEEN 1 AND 2989 AS drawing FROM notes",
    "export_body": f"WITH {NOTES} SELECT path, trim(head || body || links || links_raw, E' \\n') AS body FROM notes",
    "corpus_diff": f"WITH {ALTERED} SELECT count(*) FILTER (WHERE status <> 'deleted') AS total, count(*) FILTER (WHERE status = 'created') AS created, count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'deleted') AS deleted FROM b",
    "diff_status": f"WITH {ALTERED} SELECT path, status FROM b",
    "deleted_paths": f"WITH {ALTERED} SELECT path FROM b WHERE status = 'deleted'",
    "current_version": f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY batch_id DESC) AS n FROM log) SELECT path, batch_id FROM r WHERE n = 1 AND op <> 'deleted'",
    "recent_changes": f"WITH {LOG} SELECT path, op, batch_id FROM log ORDER BY ts DESC, batch_id DESC LIMIT 8",
    "corpus_scan": f"""WITH {NOTES}, m AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '_' ELSE '' END AS mark FROM notes)
SELECT source || '/' || mark || doc_id || '.md' AS relative_path, mark || title AS title, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256 FROM m""",
    "glossary_load": "SELECT p_partkey::INT AS entry_id, 'part ' || p_partkey AS term, 'p-' || p_partkey || '|P_' || p_partkey AS synonyms, 'about, \"this\" ' || p_partkey AS description FROM part",
    "model_stats": "SELECT CASE WHEN vec_id % 3 = 0 THEN 'small' ELSE 'large' END AS model_id, count(DISTINCT vec_id % 100) AS document_count, count(*) AS chunk_count, max(len(embedding))::INT AS dim, sum(len(embedding) * 4)::BIGINT AS vector_bytes FROM embeddings GROUP BY 1",
    "stored_chunks": f"""WITH packed AS (WITH {NOTES},{CLEAN},{PACK} SELECT path, chunk_index, chunk_text FROM ch), n AS (WITH {NOTES} SELECT path, title, text FROM notes)
SELECT path, chunk_index, chunk_text, title AS doc_title, octet_length(encode(text))::BIGINT AS size, {DIM}::INT AS embedding_dim FROM packed JOIN n USING (path) WHERE path NOT LIKE '%3.md'""",
    "stored_vectors": f"""WITH {NOTES}, heads AS (SELECT path, left(text, 2000) AS head FROM notes WHERE path NOT LIKE '%3.md'),{vectors("heads", "path", "head", "dv")}
SELECT path, b::INT AS b, round(v, 6) AS v FROM dv""",
    "index_update": "SELECT source || '/' || doc_id || '.md' AS path, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size, CASE WHEN doc_id % 10 IN (1, 2) THEN 2 ELSE 1 END::BIGINT AS batch_id FROM documents WHERE doc_id % 10 <> 3",
    "stream_index": "SELECT source || '/' || doc_id || '.md' AS path, sha256(CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE text END) AS sha256 FROM documents WHERE doc_id % 4 <> 1",
    "unit_norm": "WITH n AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, round(n, 6) AS norm, round(list_max(list_transform(e, lambda x: x::DOUBLE / n)), 6) AS largest FROM n",
    "vector_topk": topk_sql(SELF, 10),
    "vector_topk_min_score": topk_sql(SELF, 10, "WHERE score >= 0.4"),
    "near_copy_topk": f"""WITH mx AS (SELECT a.vec_id AS query_id, list_transform(range(1, {DIM} + 1), lambda i: 3 * a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE) AS m FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
nm AS (SELECT query_id, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS n FROM mx), q AS (SELECT query_id, list_transform(m, lambda x: x / n) AS v FROM nm),
s AS (SELECT q.query_id, e.vec_id, round(list_sum(list_transform(range(1, {DIM} + 1), lambda i: q.v[i] * e.embedding[i]::DOUBLE)), 6) + 0.0 AS score FROM q, embeddings e),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5) SELECT *, round({base('score')}, 4) AS calibrated FROM t""",
    "neighbour_context": "SELECT conv_id, turn, lag(text) OVER w AS prev, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "glossary_detect": f"WITH texts AS (SELECT doc_id AS id, text AS t FROM documents), {DETECT} SELECT id AS doc_id, entry_id, place FROM de",
    "glossary_detect_parts": f"""WITH {PARTS}, c AS (SELECT count(*) AS n FROM part),
texts AS (SELECT doc_id AS id, coalesce(text, '') || ' uses ' || x.term || ' and ' || y.synonyms[1] || '.' AS t
          FROM documents, c, gl x, gl y WHERE x.entry_id = doc_id * 7 % n AND y.entry_id = doc_id * 3 % n){DETECTED} SELECT id AS doc_id, entry_id, place FROM de""",
    "detected_report": f"WITH texts AS (SELECT doc_id AS id, text AS t FROM documents), {DETECT}, ag AS (SELECT id, string_agg(term || ':' || array_to_string(synonyms, ','), ';' ORDER BY place) AS terms FROM de JOIN gl USING (entry_id) GROUP BY 1) SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN ag ON id = doc_id",
    "glossary_lookup": f"""WITH {ASKED}, w AS (SELECT query_id, unnest(x) AS word, unnest(range(0, len(x)))::INT AS place FROM (SELECT query_id, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+') AS x FROM asked)), {GLOSS},
vk AS (SELECT max(entry_id) AS entry_id, k FROM (SELECT entry_id, regexp_replace(lower(unnest(list_concat([term], synonyms))), '[\\s\\-_ー−―]+', '', 'g') AS k FROM gl) GROUP BY k)
SELECT query_id, place, word, entry_id, term FROM w JOIN vk ON k = word JOIN gl USING (entry_id)""",
    "enriched_query": f"""WITH {ASKED}, texts AS (SELECT query_id AS id, query AS t FROM asked), {DETECT},
i AS (SELECT id, place, term || ' => ' || array_to_string(list_slice(list_concat(list_filter(list_concat([term], synonyms), lambda v: NOT contains(query, v)), CASE WHEN description <> '' THEN [description] ELSE [] END), 1, 4), ', ') AS info,
  len(list_filter(list_concat([term], synonyms), lambda v: NOT contains(query, v))) + CASE WHEN description <> '' THEN 1 ELSE 0 END AS n FROM de JOIN gl USING (entry_id) JOIN asked ON query_id = id),
a AS (SELECT id, string_agg(info, '; ' ORDER BY place) AS infos FROM i WHERE n > 0 GROUP BY 1)
SELECT query_id, CASE WHEN infos IS NULL THEN query ELSE '[関連用語: ' || infos || '] ' || query END AS enriched FROM asked LEFT JOIN a ON id = query_id""",
    "chunk_enrichment": f"""WITH {NOTES},{CLEAN}, texts AS (SELECT path AS id, linked AS t FROM c1), {DETECT},
al AS (SELECT id, v FROM (SELECT id, unnest(list_concat([term], synonyms)) AS v FROM de JOIN gl USING (entry_id)) UNION SELECT path, source FROM notes),
ag AS (SELECT id, string_agg(v, '|' ORDER BY v) AS aliases FROM al GROUP BY 1), nt AS (SELECT id, string_agg(DISTINCT term || ': ' || description, '|' ORDER BY term || ': ' || description) AS notes FROM de JOIN gl USING (entry_id) WHERE description <> '' GROUP BY 1)
SELECT ag.id AS path, aliases, coalesce(notes, '') AS notes FROM ag LEFT JOIN nt USING (id)""",
    "keyword_bm25": f"WITH {DOCS}, {ASKED},{bm25(50)} SELECT query_id, doc_id, score, rank::INT AS rank FROM kh",
    "rrf_fusion": f"WITH {fused(RRF, 6)} SELECT {FUSED} FROM f",
    "weighted_fusion": f"WITH {fused('0.6 * coalesce(vector_score, 0.0) + 0.4 * (coalesce(keyword_score, 0.0) / coalesce(most, 1.0))', 4)} SELECT {FUSED} FROM f",
    "hybrid_search": f"WITH {fused(RRF, 6)} SELECT {FUSED} FROM f",
    "hybrid_fallback": f"""WITH {fused(RRF, 6, 'query_id % 2 = 0')} SELECT {FUSED} FROM f WHERE query_id IN (SELECT query_id FROM k)
UNION ALL SELECT query_id, rank::INT, path, score, 'vector_only', rank::INT, NULL FROM hits WHERE rank <= 20 AND query_id NOT IN (SELECT query_id FROM k)""",
    "three_way_compare": f"""WITH {fused(RRF, 6)}, r AS (SELECT query_id, vector_rank AS rank, path, 'v' AS s FROM f WHERE vector_rank <= 10 UNION ALL SELECT query_id, rank, path, 'h' FROM f WHERE rank <= 10 UNION ALL SELECT query_id, keyword_rank, path, 'k' FROM f WHERE keyword_rank <= 10)
SELECT query_id, rank::INT AS rank, min(path) FILTER (WHERE s = 'v') AS vector, min(path) FILTER (WHERE s = 'h') AS hybrid, min(path) FILTER (WHERE s = 'k') AS keyword FROM r GROUP BY query_id, rank""",
    "rag_context_xml": f"""WITH {DOCS}, {ASKED},{ranked(20, 80)}, b AS (SELECT query_id, string_agg('  <document index="' || rank || '" title="' || title || '" path="' || path || '" score="' || printf('%.4f', score) || E'">\\n' || array_to_string(list_transform({CONTEXT_LINES}, lambda x: '    ' || {HTML('x')}), chr(10)) || E'\\n  </document>', chr(10) ORDER BY rank) AS t FROM hits WHERE rank <= 5 GROUP BY 1)
SELECT query_id, '<context query="' || {HTML('query')} || E'">\\n' || coalesce(t, '  <!-- 関連コンテキストは見つかりませんでした -->') || E'\\n</context>' AS context FROM asked LEFT JOIN b USING (query_id)""",
    "rag_context_md": f"""WITH {DOCS}, {ASKED},{ranked(20, 80)}, b AS (SELECT query_id, string_agg('### [' || rank || '] ' || title || ' (Score: ' || printf('%.4f', score) || ', Path: `' || path || E'`)\\n' || array_to_string(list_transform({CONTEXT_LINES}, lambda x: CASE WHEN x = '' THEN '>' ELSE '> ' || x END), chr(10)), E'\\n\\n' ORDER BY rank) AS t FROM hits WHERE rank <= 5 GROUP BY 1)
SELECT query_id, CASE WHEN t IS NULL THEN '## 参考コンテキスト (クエリ: ' || query || E')\\n*関連するコンテキストは見つかりませんでした。*' ELSE E'## 参考コンテキスト\\nユーザーの質問: `' || query || E'`\\n\\n' || t END AS context FROM asked LEFT JOIN b USING (query_id)""",
    "relevance_tiers": f"WITH {DOCS}, {ASKED},{ranked(20, 80)} SELECT CASE WHEN score >= 0.7 THEN 'High' WHEN score >= 0.4 THEN 'Medium' ELSE 'Low' END AS tier, count(*) AS n FROM hits GROUP BY 1",
    "eval_metrics": f"WITH {DOCS}, {ASKED},{ranked(20, 80)},{JUDGED},{RANKS} SELECT {METRICS} FROM ranks",
    "eval_by_category": f"WITH {DOCS}, {ASKED},{ranked(20, 80)},{JUDGED},{RANKS} SELECT category, {METRICS} FROM ranks GROUP BY category UNION ALL SELECT NULL, {METRICS} FROM ranks",
    "grid_search": f"""WITH {DOCS}, {ASKED},{ranked(40, 40)},{JUDGED}, {GRID},
g AS (SELECT query_id, raw_rank, path, noise_floor, exponent, lexical_weight, stem_bonus, round(least(greatest({base('similarity', 'noise_floor', 'exponent', '(0.93 - noise_floor)')} + CASE WHEN total > 0 THEN matched / total ELSE 0.0 END * lexical_weight + CASE WHEN is_stem THEN stem_bonus ELSE least(matched * 0.03, 0.06) END, 0.0), 0.98), 6) AS s FROM m2, grid),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id, noise_floor, exponent, lexical_weight, stem_bonus ORDER BY s DESC, raw_rank) AS pos FROM g),
gm AS (SELECT query_id, noise_floor, exponent, lexical_weight, stem_bonus, min(CASE WHEN contains(lower(path), lower(expected)) THEN pos END) AS r FROM gr JOIN judged USING (query_id) GROUP BY ALL)
SELECT noise_floor, exponent, lexical_weight, stem_bonus, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3 FROM gm GROUP BY ALL""",
    "calibrated_score_grid": f"""WITH {DOCS}, a AS (SELECT *, round(0.4 + (doc_id % 60) / 100.0, 6)::DOUBLE AS similarity, lower(text) AS lt FROM docs),
m AS (SELECT *, 2 + CASE WHEN contains(lt, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lt, 'le') THEN 1 ELSE 0 END + CASE WHEN contains(path, 'src1') OR contains(lt, 'src1') THEN 1 ELSE 0 END AS matched FROM a)
SELECT doc_id, similarity, round(least(greatest({base('similarity')} + matched / 5 * 0.12 + 0.08, 0.0), 0.98), 4) AS score, round(least({base('similarity')}, 0.98), 4) AS bare FROM m""",
    "embedded_tables": f"""WITH {NOTES}, said AS (SELECT path, doc_id, replace(left(raw, 120), '`', '''') || ', note: "x"]; {{a: 1,}}' AS excerpt FROM notes)
SELECT path, "row", name, excerpt, 'a|b' AS tags FROM said, (VALUES (0, 'json'), (1, 'json'), (2, 'script')) AS r("row", name) UNION ALL SELECT path, 3, 'x' || doc_id, excerpt, NULL FROM said""",
    "document_resolve": f"WITH {DOCS} SELECT doc_id AS position, path AS doc_path FROM docs",
}

#: Keywords of the queries themselves, and of the glossary terms found in them.
TERM_WORDS = WORDS.replace("FROM asked)", "FROM asked0)").replace("\nkw AS (", "\nown AS (") + f""",
texts AS (SELECT query_id AS id, query AS t FROM asked0), {DETECT},
more AS (SELECT id AS query_id, flatten(list(list_concat(list_filter(list_concat([term], synonyms), lambda v: length(v) >= 2), regexp_extract_all(description, '[a-zA-Z0-9]{{2,}}')))) AS more FROM de JOIN gl USING (entry_id) GROUP BY 1),
kw AS (SELECT query_id, list_distinct(list_concat(coalesce(keywords, []), coalesce(more, []))) AS keywords FROM asked0 LEFT JOIN own USING (query_id) LEFT JOIN more USING (query_id))"""
SQL["ab_delta"] = f"""WITH enriched AS ({SQL["enriched_query"]}),
a AS (WITH {DOCS}, {ASKED.replace("asked AS", "asked0 AS")}, asked AS (SELECT query_id, enriched AS query FROM enriched),{ranked(20, 80).replace(WORDS, TERM_WORDS)} SELECT query_id, score FROM hits WHERE rank = 1),
b AS (WITH {DOCS}, {ASKED},{ranked(20, 80)} SELECT query_id, score FROM hits WHERE rank = 1)
SELECT round(avg(a.score - b.score), 6) AS delta, count(*) AS n_queries FROM a JOIN b USING (query_id)"""

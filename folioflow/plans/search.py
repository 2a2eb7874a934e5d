"""Search jobs over an index, for tables of queries (query_id, query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import scoring as S
from folioflow.functions import text as T
from folioflow.operators import glossary as G
from folioflow.operators.encode import Encoder, encode_column
from folioflow.operators.fusion import fuse
from folioflow.operators.vector import neighbours, topk
from folioflow.storage import written

SENTENCES = 8
SALIENT_HITS = 3
SALIENT_SCORE = 0.55
#: Hits that are broadcast at most, where their rows are looked up; more are joined by shuffle.
BROADCAST_HITS = 1 << 18


def looked_up(hits: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """``hits`` with the columns of their rows. Hits are stored first; up to ``BROADCAST_HITS`` of them go to the rows, so that no
    text is shuffled but those of hits."""
    stored = written(hits, "hits")
    return (F.broadcast(stored) if stored.count() <= BROADCAST_HITS else stored).join(rows, row_id)


def prepared_queries(queries: DataFrame, encoder: Encoder, glossary: DataFrame | None = None) -> DataFrame:
    """query_id, query, keywords, embedding: with a glossary, the query is enriched before it is encoded, and the spellings
    and the words of the descriptions of its terms join the keywords."""
    out = queries.select("query_id", "query").withColumn("keywords", S.query_keywords(F.col("query"))).withColumn("_encoded", F.col("query"))
    if glossary is not None:
        more = G.enriched_queries(queries.select("query_id", "query"), glossary)
        spelled = F.filter(F.flatten(F.transform("terms", lambda t: F.concat(F.concat(F.array(t["term"]), t["synonyms"]), S.query_keywords(t["description"])))), lambda v: F.length(v) >= 2)
        more = more.select("query_id", F.col("enriched").alias("_encoded"), spelled.alias("_more"))
        out = out.drop("_encoded").join(more, "query_id").withColumn("keywords", S.merged(F.col("keywords"), F.col("_more"))).drop("_more")
    return encode_column(out, "_encoded", encoder, True).drop("_encoded")


def reranked(queries: DataFrame, rows: DataFrame, row_id: str, text: str, top_k: int, min_score: float, keyword_boost: bool, vectors: DataFrame | None = None) -> DataFrame:
    """Raw top 4k of each query, scored again with its keywords, filtered and cut to ``top_k``: the columns of both
    sides with similarity, raw_rank, score and rank. Ties in score keep the raw order. ``vectors`` (row_id, embedding): those of ``rows``, if they
    lie in a table of their own."""
    raw = topk(queries, rows if vectors is None else vectors, 4 * top_k, corpus_key=row_id).withColumnRenamed("score", "similarity").withColumnRenamed("rank", "raw_rank")
    both = looked_up(raw, rows.drop("embedding"), row_id).repartition("query_id").join(queries.select("query_id", "keywords", F.col("embedding").alias("query_vector")), "query_id")
    matches = S.keyword_matches(F.col("keywords"), F.col("title"), F.col(text), F.col("path"))
    both = both.withColumn("score", S.calibrated(F.col("similarity"), matches, keyword_boost))
    if min_score > 0:
        both = both.filter(F.col("score") >= min_score)
    both = both.withColumn("accepted", F.row_number().over(Window.partitionBy("query_id").orderBy("raw_rank")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "raw_rank")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def salient_sentences(hits: DataFrame, encoder: Encoder, key: tuple[str, ...], text: str, vector: str = "query_vector", least: float = SALIENT_SCORE) -> DataFrame:
    """(key, salient_sentence): of the first sentences that read like some, the one closest to the query, if close enough."""
    good = F.slice(F.filter(F.transform(T.sentences(T.plain(F.coalesce(F.col(text), F.lit("")))), T.edge_marks_gone), T.is_candidate_sentence), 1, SENTENCES)
    each = hits.select(*key, F.col(vector).alias("_q"), F.posexplode_outer(good).alias("_at", "_s")).filter("_at IS NOT NULL")
    scored = encode_column(each, "_s", encoder, into="_v").withColumn("_score", S.inner(F.col("_v"), F.col("_q")))
    best = scored.groupBy(*key).agg(F.max_by(F.struct("_s", "_score"), F.struct("_score", -F.col("_at"))).alias("_b"))
    return best.filter(F.col("_b._score") >= least).select(*key, F.col("_b._s").alias("salient_sentence"))


def search_chunks(queries: DataFrame, chunks: DataFrame, encoder: Encoder, top_k: int = 20, min_score: float = 0.0, keyword_boost: bool = True, glossary: DataFrame | None = None) -> DataFrame:
    """Ranked chunks with their neighbours (context) and, for the first hits, the sentence that answers best.

    ``chunks``: chunk_id, doc_id, path, title, chunk_index, chunk_text, embedding.
    """
    asked = prepared_queries(queries, encoder, glossary)
    hits = reranked(asked, chunks, "chunk_id", "chunk_text", top_k, min_score, keyword_boost)
    docs = hits.select("path").distinct()
    beside = neighbours(chunks.select("path", "chunk_id", "chunk_index", "chunk_text").join(docs, "path", "left_semi"), "path", "chunk_index", "chunk_id", "chunk_text")
    salient = salient_sentences(hits.filter(F.col("accepted") <= SALIENT_HITS), encoder, ("query_id", "chunk_id"), "chunk_text")
    return (
        hits.join(beside.select("chunk_id", F.struct(F.struct("chunk_index", "chunk_id", "chunk_text").alias("current"), "prev", "next").alias("context")), "chunk_id")
        .join(salient, ["query_id", "chunk_id"], "left")
        .select("query_id", "rank", "doc_id", "path", F.col("path").alias("full_path"), F.coalesce(F.nullif("title", F.lit("")), T.file_name(F.col("path"))).alias("title"), "score", "similarity", "raw_rank", "chunk_id", "chunk_index", F.col("chunk_text").alias("hit_text"), "context", "salient_sentence")
    )


def search_documents(queries: DataFrame, documents: DataFrame, encoder: Encoder, top_k: int = 20, min_score: float = 0.0, keyword_boost: bool = True, glossary: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Ranked documents with a preview. ``documents``: doc_id, path, title, text, embedding; the last may lie in ``vectors`` (doc_id,
    embedding)."""
    hits = reranked(prepared_queries(queries, encoder, glossary), documents, "doc_id", "text", top_k, min_score, keyword_boost, vectors)
    return hits.select("query_id", "rank", "doc_id", "path", F.col("path").alias("full_path"), F.coalesce(F.nullif("title", F.lit("")), T.file_name(F.col("path"))).alias("title"), "score", "similarity", "raw_rank", T.preview(F.col("text")).alias("preview"))


def around(text: Column, words: Column, n: int = 400, before: int = 60) -> Column:
    """``n`` characters of a text around the first place that has any of the words."""
    low = F.lower(text)
    places = F.filter(F.transform(words, lambda w: F.instr(low, w)), lambda p: p > 0)
    return F.substr(text, F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - before, F.lit(1)), F.lit(n))


def as_keyword_hits(hits: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """BM25 hits in the shape of an outside service's, with a marked snippet and the score as utility."""
    words = queries.select("query_id", T.tokens(F.col("query")).alias("_words"))
    both = looked_up(hits, documents.select("doc_id", "path", "title", "text"), "doc_id").repartition("query_id").join(words, "query_id")
    return both.select("query_id", "rank", F.col("doc_id").alias("file_id"), F.col("path").alias("full_path"), F.lit(None).cast("string").alias("target_path"), F.col("title").alias("file_name"), T.preview(T.highlighted(around(F.col("text"), F.col("_words")), F.col("_words"))).alias("snippet"), F.col("score").alias("utility_score"), F.lit(None).cast("double").alias("click_count"))


def search_hybrid(queries: DataFrame, vector_hits: DataFrame, keyword_hits: DataFrame, method: str = "rrf", vector_weight: float = 0.5, keyword_weight: float = 0.5, top_k: int = 20, k: int = 60, dedup: str = "last") -> DataFrame:
    """Fused ranking. A query without keyword hits keeps its vector ranking and scores."""
    fused = fuse(vector_hits, keyword_hits, method, k, vector_weight, keyword_weight, top_k, dedup)
    bare = vector_hits.join(keyword_hits.select("query_id").distinct(), "query_id", "left_anti").filter(F.col("rank") <= top_k)
    alone = bare.select("query_id", F.col("score").alias("hybrid_score"), F.lit("vector_only").alias("match_type"), F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"), "doc_id", "path", "full_path", "title", "rank", *(c for c in ("chunk_id", "chunk_index", "hit_text", "preview", "salient_sentence") if c in bare.columns))
    return fused.join(bare.select("query_id").distinct(), "query_id", "left_anti").unionByName(alone, allowMissingColumns=True)


def response(queries: DataFrame, hits: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """One row per query: keywords, keyword_query, both contexts and the detected terms."""
    from folioflow.operators.context import render_context

    out = queries.select("query_id", "query").withColumn("keywords", S.query_keywords(F.col("query"))).withColumn("keyword_query", S.or_query(F.col("keywords"), F.col("query")))
    for fmt in ("xml", "md"):
        out = out.join(render_context(queries, hits, fmt).withColumnRenamed("context", f"context_{fmt}"), "query_id", "left")
    return out if glossary is None else out.join(G.detected_report(queries, glossary, "query_id", "query"), "query_id", "left")

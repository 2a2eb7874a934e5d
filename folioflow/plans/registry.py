"""The registered queries: each applies operators of this package to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import scoring as S
from folioflow.functions import text as T
from folioflow.operators import chunking as C
from folioflow.operators import context as X
from folioflow.operators import evaluate as E
from folioflow.operators import glossary as G
from folioflow.operators import index as I
from folioflow.operators.encode import HashEncoder, encode_column
from folioflow.operators.fusion import fuse, three_way
from folioflow.operators.keyword import search_keyword
from folioflow.operators.passages import holders
from folioflow.operators.vector import neighbours, topk
from folioflow.plans import search as P
from folioflow.sources import corpus, tree
from folioflow.storage import scratch, written
from folioflow.streaming import changes as ST

DIM = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of texts, whose work is CPU: dealt out where it lies in fewer files than there are cores, as the rows of one
    row group are one task however it is split."""
    rows, cores = table(spark, sf, name), spark.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores)


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown notes with all that a note may hold: path, title, text, raw."""
    docs = texts(spark, sf, "documents")
    n, body = F.col("doc_id").cast("string"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    part = lambda k: (F.col("doc_id") % k).cast("string")
    text = F.concat(
        F.lit("---\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\nkeywords: k"), part(5), F.lit(", extra words\naliases:\n  - "), "source", F.lit("\n---\n# Note "), n,
        F.lit("\n\n## Body\n\n"), body, F.lit("\n\n### Links\n\nSee [[Note|label]] and [site](http://x.y/z) #tag"), part(7),
        F.lit("\n\n%%a comment%%\n![[pic.png]] ![alt](pic.png)\n\n#### Deep\n\nDeep text"), F.when(F.col("doc_id") % 6 == 0, "\n\n# Excalidraw Data\n\nsecret").otherwise(""),
    )
    out = docs.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"), F.col("text").alias("raw"), "lang")
    return out.withColumn("title", T.title(F.col("text"), T.stem_of(F.col("path"))))


def documents(spark: SparkSession, sf: str, dealt: bool = True) -> DataFrame:
    """Documents as an index has them: doc_id, path, title, text, lang. ``dealt``: out to all cores; a scan that only looks rows up does
    without."""
    docs = texts(spark, sf, "documents") if dealt else table(spark, sf, "documents")
    return docs.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Note "), F.col("doc_id").cast("string")).alias("title"), "text", "lang")


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return encode_column(documents(spark, sf), "text", HashEncoder(DIM))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunked(spark: SparkSession, sf: str) -> DataFrame:
    out = C.chunk_documents(notes(spark, sf).select("doc_id", "path", "title", "text"), 600, 80)
    return out.withColumn("chunk_id", F.col("doc_id") * 100000 + F.col("chunk_index"))


GLOSSARY = [
    (1, "that", ["than", "thst"], "a common word"),
    (2, "Éauouon", ["eauou"], ""),
    (3, "der", ["und", "ein-e"], "article"),
    (4, "que", ["qui"], "pronoun"),
    (5, "the", [], "article"),
]


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY, "entry_id int, term string, synonyms array<string>, description string")


def joined(c, sep="|"):
    return F.array_join(c, sep)


# Text


def title_extract(spark, sf):
    return notes(spark, sf).select("path", "title")


def content_fingerprint(spark, sf):
    docs = texts(spark, sf, "documents")
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def frontmatter_tags(spark, sf):
    out = C.extract_metadata(notes(spark, sf))
    return out.select("path", joined("tags").alias("tags"), joined("aliases").alias("aliases"), joined("keywords").alias("keywords"))


def clean_text(spark, sf):
    return C.extract_metadata(notes(spark, sf)).select("path", "clean_text")


def plain_text_view(spark, sf):
    return notes(spark, sf).select("path", T.plain(F.col("text")).alias("plain"))


def line_filters(spark, sf):
    lines = notes(spark, sf).select("path", F.explode(T.lines(F.col("text"))).alias("line")).withColumn("line", T.strip(F.col("line"))).filter("line <> ''")
    return lines.groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(T.is_noise(F.col("line"))).alias("n_noise"))


def section_breadcrumbs(spark, sf):
    out = C.extract_metadata(notes(spark, sf)).withColumn("s", F.explode(C.sections(F.col("clean_text"), C.base_title(F.col("title")), F.lit(""))))
    return out.select("path", F.col("s.context").alias("context"), F.length("s.body").alias("n_chars"))


def chunk_pack(spark, sf):
    return chunked(spark, sf).select("path", "chunk_index", "chunk_text")


def chunk_stats(spark, sf):
    return chunked(spark, sf).agg(F.count_distinct("path").alias("document_count"), F.count("*").alias("chunk_count"), F.sum(F.length("chunk_text")).alias("n_chars"))


def metadata_prefix(spark, sf):
    out = C.extract_metadata(notes(spark, sf))
    return out.select("path", C.metadata_prefix(F.col("tags"), F.col("aliases"), F.col("keywords"), F.col("context_notes")).alias("prefix"))


def path_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.parent_folder(url).alias("parent"), T.file_name(url).alias("name"), T.path_key(url).alias("key"), T.model_id(url).alias("model_id"), T.slug(url).alias("slug"), T.relative_to(url, F.lit("https://www.")).alias("relative"), T.url_decoded(url).alias("decoded"))


def model_prefix(spark, sf):
    docs = texts(spark, sf, "documents").withColumn("head", F.substring("text", 1, 2000))
    c = F.col("head")
    return docs.select("doc_id", T.with_model_prefix(c, "ruri", False).alias("ruri"), T.with_model_prefix(c, "e5", True).alias("e5"), T.with_model_prefix(c, None, True).alias("plain"))


def highlight(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", T.highlighted(F.col("text"), F.array(F.lit("that"), F.lit("the"), F.lit("e"), F.lit("le"))).alias("marked"))


def snippets(spark, sf):
    docs = texts(spark, sf, "documents")
    some = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<mark>"), F.substring("text", 1, 5), F.lit("</mark>"), F.col("text")))
    return docs.select("doc_id", T.snippet(some, F.when(F.col("doc_id") % 3 == 1, F.lit("")), F.col("text")).alias("snippet"))


def query_keywords(spark, sf):
    both = asked(spark, sf).withColumn("keywords", S.query_keywords(F.col("query")))
    return both.select("query_id", joined("keywords").alias("keywords"), S.or_query(F.col("keywords"), F.col("query")).alias("keyword_query"))


def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_escaped(F.col("html")).alias("escaped"))


def drawing_notes(spark, sf):
    out = notes(spark, sf).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("#excalidraw\n"), "text")).otherwise(F.col("text")))
    return out.select("path", X.is_drawing(F.col("path"), F.col("text")).alias("drawing"))


def export_body(spark, sf):
    return notes(spark, sf).select("path", X.export_body(F.col("text")).alias("body"))


# Index


def _altered(spark, sf):
    docs = documents(spark, sf).withColumn("sha256", F.sha2("text", 256))
    stored = docs.filter("doc_id % 10 <> 1").withColumn("sha256", F.when(F.col("doc_id") % 10 == 2, F.lit("old")).otherwise(F.col("sha256")))
    return docs.filter("doc_id % 10 <> 3"), stored


def corpus_diff(spark, sf):
    return I.run_summary(I.diff_corpus(*_altered(spark, sf)))


def diff_status(spark, sf):
    return I.diff_corpus(*_altered(spark, sf))


def deleted_paths(spark, sf):
    return I.deleted_paths(*_altered(spark, sf))


def _event_log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("event_id") % 5 == 0, "deleted").otherwise("upsert").alias("op"), F.col("event_id").alias("batch_id"), "ts")


def current_version(spark, sf):
    return I.current_version(_event_log(spark, sf)).select("path", "batch_id")


def recent_changes(spark, sf):
    return _event_log(spark, sf).orderBy(F.desc("ts"), F.desc("batch_id")).limit(8).select("path", "op", "batch_id")


def corpus_scan(spark, sf):
    """Notes written as files, a third of them with names that begin with an underscore, and scanned again."""
    root = scratch(spark, "notes")
    name = F.regexp_replace("path", "/", F.when(F.col("doc_id") % 3 == 0, "/_").otherwise("/"))
    tree.write_tree(notes(spark, sf).select(name.alias("path"), "text"), root)
    return corpus.scan_corpus(spark, root).select("relative_path", "title", "size", "sha256")


def glossary_load(spark, sf):
    """A glossary made from the parts table, written as CSV and read again."""
    parts = table(spark, sf, "part")
    made = parts.select(F.col("p_partkey").cast("int").alias("entry_id"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("term"), F.array(F.concat(F.lit("p-"), F.col("p_partkey").cast("string")), F.concat(F.lit("P_"), F.col("p_partkey").cast("string"))).alias("synonyms"), F.concat(F.lit("about, \"this\" "), F.col("p_partkey").cast("string")).alias("description"))
    path = scratch(spark, "glossary")
    G.save_glossary(made, path)
    return G.load_glossary(spark, path).select("entry_id", "term", joined("synonyms").alias("synonyms"), "description")


def model_stats(spark, sf):
    e = table(spark, sf, "embeddings")
    both = e.select(F.when(F.col("vec_id") % 3 == 0, "small").otherwise("large").alias("model_id"), F.concat(F.lit("d"), (F.col("vec_id") % 100).cast("string")).alias("path"), "embedding")
    return I.model_stats(both)


def index_update(spark, sf):
    """Two runs over a changed corpus: the index then holds what a scan of the second would give."""
    docs = documents(spark, sf).withColumns({"mtime": F.lit("2024-01-01").cast("timestamp"), "size": F.octet_length("text").cast("long")})
    first = docs.filter("doc_id % 10 <> 1").withColumn("text", F.when(F.col("doc_id") % 10 == 2, F.lit("old")).otherwise(F.col("text"))).withColumn("sha256", F.sha2("text", 256)).drop("doc_id")
    second = docs.filter("doc_id % 10 <> 3").withColumn("sha256", F.sha2("text", 256)).drop("doc_id")
    where = scratch(spark, "index")
    for scanned in (first, second):
        I.update_index(scanned, where, "hash_64", HashEncoder(DIM))
    return I.documents(spark, where, "hash_64").select("path", "sha256", "size", "batch_id")


def _stored(spark, sf):
    """An index of notes after two runs: of an earlier corpus by a narrower model, then of the corpus as it is, with which everything
    is chunked and encoded again, as the width has changed; what was deleted in between is gone, and so are its files."""
    whole = notes(spark, sf).withColumns({"mtime": F.lit("2024-01-01").cast("timestamp"), "size": F.octet_length("text").cast("long"), "sha256": F.sha2("text", 256)}).drop("doc_id", "raw", "lang")
    hour = F.regexp_extract("path", r"([0-9])\.md$", 1)
    first = whole.filter(hour != "1").withColumn("text", F.when(hour == "2", F.lit("# Old\n\nold text")).otherwise(F.col("text"))).withColumn("sha256", F.sha2("text", 256))
    where = scratch(spark, "index")
    I.update_index(first, where, "hash", HashEncoder(DIM // 2))
    I.update_index(whole.filter(hour != "3"), where, "hash", HashEncoder(DIM))
    I.compact(spark, where)
    return where


def stored_chunks(spark, sf):
    """The chunks that an index holds, with the title and size of their documents."""
    return I.chunk_rows(spark, _stored(spark, sf), "hash").select("path", "chunk_index", "chunk_text", "doc_title", "size", "embedding_dim")


def stored_vectors(spark, sf):
    """The vectors that an index holds of its documents, entry by entry."""
    docs = I.embedded_documents(spark, _stored(spark, sf), "hash")
    return docs.select("path", F.posexplode("embedding").alias("b", "v")).filter("v <> 0").select("path", "b", F.round("v", 6).alias("v"))


def stream_index(spark, sf):
    """Documents as a feed of events in many files, applied by a stream that is stopped and begun again between two sets of them."""
    docs = documents(spark, sf)
    event = lambda op, content, day: docs.select("path", F.lit(op).alias("op"), content.alias("content"), F.lit(day).cast("timestamp").alias("mtime"), "doc_id")
    feed, where = scratch(spark, "feed"), scratch(spark, "index")
    first = event("updated", F.col("text"), "2024-01-01")
    second = event("updated", F.lit("new"), "2024-01-02").filter("doc_id % 4 = 0").union(event("deleted", F.lit(None).cast("string"), "2024-01-02").filter("doc_id % 4 = 1")).union(event("updated", F.lit("stale"), "2023-01-01").filter("doc_id % 4 = 2"))
    for events in (first, second):
        events.drop("doc_id").repartition(4).write.mode("append").parquet(feed)
        query = ST.stream_index(spark, ST.read_changes(spark, feed), where, "hash_64", HashEncoder(DIM), f"{where}/state")
        query.awaitTermination()
    return I.documents(spark, where, "hash_64").select("path", "sha256")


# Vectors and search


def _mixed(spark, sf):
    """Query vectors: the mean of each vector and the next one, scaled to length one."""
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = F.zip_with("embedding", "other", lambda a, b: 3 * a.cast("double") + b.cast("double"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("query_id"), S.unit(mixed).alias("embedding"))


def unit_norm(spark, sf):
    e = table(spark, sf, "embeddings").filter(F.size("embedding") == DIM)
    return e.select("vec_id", F.round(S.l2_norm(F.col("embedding")), 6).alias("norm"), F.round(F.array_max(S.unit(F.col("embedding"))), 6).alias("largest"))


def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return topk(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, 10)


def vector_topk_min_score(spark, sf):
    e = table(spark, sf, "embeddings")
    return topk(e.select(F.col("vec_id").alias("query_id"), "embedding"), e, 10, min_score=0.4)


def near_copy_topk(spark, sf):
    hits = topk(_mixed(spark, sf), table(spark, sf, "embeddings"), 5)
    return hits.withColumn("calibrated", F.round(S.base_score(F.col("score")), 4))


def calibrated_score_grid(spark, sf):
    """Calibrated scores of every document, over a range of similarities and with keywords of its own."""
    docs = documents(spark, sf)
    words = F.array(F.lit("the"), F.lit("note"), F.lit("le"), F.col("doc_id").cast("string"), F.lit("src1"))
    m = S.keyword_matches(words, F.col("title"), F.col("text"), F.col("path"))
    similarity = 0.4 + (F.col("doc_id") % 60) / 100.0
    return docs.select("doc_id", F.round(similarity, 6).alias("similarity"), S.calibrated(similarity, m).alias("score"), S.calibrated(similarity, m, False).alias("bare"))


def _hits(spark, sf, **kw):
    return P.search_documents(asked(spark, sf), documents(spark, sf, False), HashEncoder(DIM), vectors=embedded(spark, sf).select("doc_id", "embedding"), **kw)


def search_documents(spark, sf):
    return _hits(spark, sf).select("query_id", "rank", "doc_id", "score", "similarity", "preview")


def overfetch_rerank(spark, sf):
    return _hits(spark, sf, top_k=5, min_score=0.3).select("query_id", "rank", "doc_id", "score", "raw_rank")


def indexed_chunks(spark, sf):
    """Chunks with their vectors, written once as an index has them."""
    return written(encode_column(chunked(spark, sf), "chunk_text", HashEncoder(DIM)), "chunks")


def search_chunks(spark, sf):
    chunks = indexed_chunks(spark, sf)
    return P.search_chunks(asked(spark, sf), chunks, HashEncoder(DIM)).select("query_id", "rank", "doc_id", "chunk_index", "score", "similarity", F.col("context.prev.chunk_index").alias("prev"), F.col("context.next.chunk_index").alias("next"), "salient_sentence")


def search_chunk_ranks(spark, sf):
    """The ranking of ``search_chunks`` alone."""
    chunks = indexed_chunks(spark, sf)
    hits = P.reranked(P.prepared_queries(asked(spark, sf), HashEncoder(DIM)), chunks, "chunk_id", "chunk_text", 20, 0.0, True)
    return hits.select("query_id", "rank", "chunk_id", "score", "similarity")


def neighbour_context(spark, sf):
    t = neighbours(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return t.select("conv_id", "turn", F.col("prev.text").alias("prev"), F.col("next.text").alias("next"))


def salient_sentence(spark, sf):
    """The sentence of every document that is closest to the document itself."""
    return P.salient_sentences(embedded(spark, sf), HashEncoder(DIM), ("doc_id",), "text", "embedding")


def _glossary_texts(spark, sf):
    return documents(spark, sf).select("doc_id", "text")


def glossary_detect(spark, sf):
    return G.detect_terms(_glossary_texts(spark, sf), terms(spark), "doc_id", "text")


def _parts_glossary(spark, sf):
    """Every part as an entry with three spellings, many of which lie in each other."""
    n = F.col("p_partkey").cast("string")
    other = F.array(F.concat(F.lit("P-"), n), F.concat("p_brand", F.lit(" no "), n))
    return table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("entry_id"), F.concat("p_name", F.lit(" "), n).alias("term"), other.alias("synonyms"), F.col("p_type").alias("description"))


def glossary_detect_parts(spark, sf):
    """Documents that name parts, against a glossary of all parts."""
    parts = _parts_glossary(spark, sf)
    n = parts.count()
    named = lambda k, c: parts.select((F.col("entry_id")).alias(f"part{k}"), c.alias(f"name{k}"))
    docs = texts(spark, sf, "documents").select("doc_id", "text")
    # names first meet ids alone, so that texts are shuffled once
    ids = docs.select("doc_id").distinct().withColumns({"part1": (F.col("doc_id") * 7 % n).cast("int"), "part2": (F.col("doc_id") * 3 % n).cast("int")})
    names = ids.join(named(1, F.col("term")), "part1").join(named(2, F.col("synonyms")[0]), "part2").select("doc_id", "name1", "name2")
    named_in = docs.join(names, "doc_id").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" uses "), "name1", F.lit(" and "), "name2", F.lit(".")).alias("text"))
    return G.detect_terms(named_in, parts, "doc_id", "text")


def detected_report(spark, sf):
    out = G.detected_report(_glossary_texts(spark, sf), terms(spark), "doc_id", "text")
    return out.select("doc_id", F.array_join(F.transform("terms", lambda t: F.concat(t["term"], F.lit(":"), F.array_join(t["synonyms"], ","))), ";").alias("terms"))


def glossary_lookup(spark, sf):
    """Words of the benchmark passages looked up by their normalised key."""
    words = asked(spark, sf).select("query_id", F.posexplode(T.tokens(F.col("query"))).alias("place", "word"))
    found = G.find_by_term(words, terms(spark), "word").filter("entry_id IS NOT NULL")
    return found.select("query_id", "place", "word", "entry_id", "term")


def enriched_query(spark, sf):
    return G.enriched_queries(asked(spark, sf), terms(spark)).select("query_id", "enriched")


def chunk_enrichment(spark, sf):
    out = G.enrich_documents(terms(spark))(C.extract_metadata(notes(spark, sf)))
    return out.select("path", joined("aliases").alias("aliases"), joined("context_notes").alias("notes"))


def keyword_bm25(spark, sf):
    return search_keyword(asked(spark, sf), documents(spark, sf))


def _two(spark, sf):
    """The rankings of both sides, each written once, as a fusion reads them more than once."""
    q, docs = asked(spark, sf), documents(spark, sf, False)
    vector = written(_hits(spark, sf, top_k=40), "vector-hits")
    return vector, written(P.as_keyword_hits(search_keyword(q, documents(spark, sf), 40), q, docs), "keyword-hits")


FUSED = ("query_id", "rank", "path", "hybrid_score", "match_type", "vector_rank", "keyword_rank")


def rrf_fusion(spark, sf):
    v, k = _two(spark, sf)
    return fuse(v, k).select(*FUSED)


def weighted_fusion(spark, sf):
    v, k = _two(spark, sf)
    return fuse(v, k, method="weighted", vector_weight=0.6, keyword_weight=0.4).select(*FUSED)


def hybrid_search(spark, sf):
    v, k = _two(spark, sf)
    return P.search_hybrid(asked(spark, sf), v, k).select(*FUSED)


def hybrid_fallback(spark, sf):
    """Queries with an odd id have no keyword hits."""
    v, k = _two(spark, sf)
    return P.search_hybrid(asked(spark, sf), v, k.filter("query_id % 2 = 0")).select(*FUSED)


def three_way_compare(spark, sf):
    v, k = _two(spark, sf)
    return three_way(fuse(v, k))


def rag_context_xml(spark, sf):
    return X.render_context(asked(spark, sf), _hits(spark, sf))


def rag_context_md(spark, sf):
    return X.render_context(asked(spark, sf), _hits(spark, sf), "md")


def relevance_tiers(spark, sf):
    return _hits(spark, sf).groupBy(T.relevance_tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"))


def _judgments(spark, sf):
    """A passage expects the first document that holds it word for word."""
    q, docs = asked(spark, sf), documents(spark, sf)
    found = holders(q, docs.select("path", "lang", "text"))
    first = found.groupBy("query_id", "query").agg(F.min(F.struct("path", "lang")).alias("m"))
    return q.join(first.select("query_id", "m"), "query_id", "left").select("query_id", "query", F.coalesce(F.col("m.path"), F.lit("none")).alias("expected"), F.coalesce(F.col("m.lang"), F.lit("none")).alias("category"))


def eval_metrics(spark, sf):
    return E.evaluate(_hits(spark, sf), _judgments(spark, sf))


def eval_by_category(spark, sf):
    return E.evaluate(_hits(spark, sf), _judgments(spark, sf), by="category")


def ab_delta(spark, sf):
    with_terms = _hits(spark, sf, glossary=terms(spark))
    return E.ab_delta(with_terms, _hits(spark, sf))


def grid_search(spark, sf):
    q = P.prepared_queries(asked(spark, sf), HashEncoder(DIM))
    docs = embedded(spark, sf)
    raw = topk(q, docs, 40, corpus_key="doc_id")
    rows = raw.join(docs.drop("embedding"), "doc_id").join(q.select("query_id", "keywords"), "query_id")
    rows = rows.select("query_id", "rank", F.col("score").alias("similarity"), "path", S.keyword_matches(F.col("keywords"), F.col("title"), F.col("text"), F.col("path")).alias("matches"))
    return E.grid_search(rows, _judgments(spark, sf), E.parameter_grid(spark))


def model_compare(spark, sf):
    t = table(spark, sf, "conversations")
    pairs = t.select("conv_id", "turn", F.col("text").alias("text_a")).join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b")), ["conv_id", "turn"])
    out = E.model_similarities(pairs, {"hash_64": HashEncoder(64), "hash_16": HashEncoder(16)})
    return out.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 4).alias("mean"))


# Context bundles


def embedded_tables(spark, sf):
    """Each note holds a list in JSON, one as a script has it, and a table call; their strings hold raw text, quotes, brackets and colons."""
    n = F.col("doc_id").cast("string")
    said = F.concat(F.replace(F.substring("raw", 1, 120), F.lit("`"), F.lit("'")), F.lit(', note: "x"]; {a: 1,}'))
    quoted = F.regexp_extract(F.to_json(F.struct(said.alias("e"))), r'(?s)^\{"e":(.*)\}$', 1)
    row = F.struct(F.concat(F.lit("p"), n).alias("path"), F.lit("json").alias("name"), F.array(F.lit("a"), F.lit("b")).alias("tags"), said.alias("excerpt"))
    block = F.concat(
        F.lit("```dataviewjs\nconst noteListRows = "), F.to_json(F.array(row, row)), F.lit(";\nlet rows = [{path: \"p"), n, F.lit("\", title: 'script', tags: [\"a\", \"b\",], excerpt: "), quoted,
        F.lit(",},];\n```\n```dataviewjs\ndv.table([\"h\"], [[\"x"), n, F.lit("\", "), quoted, F.lit("]])\n```"),
    )
    return X.embedded_tables(notes(spark, sf).withColumn("text", F.concat(block, F.lit("\n"), "text"))).select("path", "row", "name", "excerpt", joined("tags").alias("tags"))


def asset_resolve(spark, sf):
    """References of every note to images that lie beside it, at the root or elsewhere."""
    docs = documents(spark, sf)
    n = F.col("doc_id")
    refs = docs.select("path", F.concat(F.lit("img%20"), n.cast("string"), F.when(n % 2 == 0, ".PNG").otherwise("")).alias("reference"))
    place = F.when(n % 3 == 0, F.concat(T.parent_folder(F.col("path")), F.lit("/"))).when(n % 3 == 1, "").otherwise("other/")
    assets = docs.filter("doc_id % 11 <> 0").select(F.concat(place, F.lit("img "), n.cast("string"), F.lit(".png")).alias("asset_path"))
    return X.resolve_assets(refs, assets)


def document_resolve(spark, sf):
    docs = documents(spark, sf)
    n = F.col("doc_id")
    how = F.when(n % 4 == 0, F.concat(F.lit("/vault/"), "path")).when(n % 4 == 1, F.col("path")).when(n % 4 == 2, F.concat(F.lit("vault/"), "path")).otherwise(F.concat(F.lit("x\\y\\"), T.file_name(F.col("path"))))
    return X.resolve_documents(docs.select(n.alias("position"), how.alias("path")), docs, "/vault").select("position", "doc_path")


def _bundle(spark, sf):
    """The judged documents in the order of their passages, with the images they embed where those are found."""
    chosen = _judgments(spark, sf).filter("expected <> 'none'").select(F.col("query_id").alias("position"), F.col("expected").alias("path"))
    image = F.concat(F.lit("img "), F.col("doc_id").cast("string"), F.lit(".png"))
    docs = documents(spark, sf).withColumn("text", F.concat(F.lit("![["), image, F.lit("]]\n"), "text"))
    assets = docs.filter("doc_id % 3 = 0").select(F.concat(T.parent_folder(F.col("path")), F.lit("/"), image).alias("asset_path"), F.concat("lang", F.col("doc_id").cast("string")).cast("binary").alias("content"))
    return X.bundle(chosen, docs, assets, prompt="Read this.", title="Notes")


def context_bundle(spark, sf):
    """A bundle as its parts."""
    return _bundle(spark, sf).select("section", "number", "offset", "n_bytes", F.sha2("content", 256).alias("sha256"))


def bundle_totals(spark, sf):
    return X.bundle_totals(_bundle(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        search_documents, title_extract, content_fingerprint, frontmatter_tags, clean_text, plain_text_view, line_filters, section_breadcrumbs, chunk_pack, chunk_stats,
        metadata_prefix, path_parts, model_prefix, highlight, snippets, query_keywords, html_escape, drawing_notes, export_body, corpus_diff, diff_status, deleted_paths,
        current_version, recent_changes, corpus_scan, glossary_load, model_stats, index_update, stored_chunks, stored_vectors, stream_index, unit_norm, vector_topk, vector_topk_min_score, near_copy_topk,
        calibrated_score_grid, overfetch_rerank, search_chunks, search_chunk_ranks, neighbour_context, salient_sentence, glossary_detect, glossary_detect_parts, detected_report, glossary_lookup,
        enriched_query, chunk_enrichment, keyword_bm25, rrf_fusion, weighted_fusion, hybrid_search, hybrid_fallback, three_way_compare, rag_context_xml, rag_context_md,
        relevance_tiers, eval_metrics, eval_by_category, ab_delta, grid_search, model_compare, embedded_tables, asset_resolve, document_resolve, context_bundle, bundle_totals,
    )
}

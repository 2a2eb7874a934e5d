"""Fusion of a vector ranking with a keyword ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import scoring as S
from folioflow.functions import text as T

VECTOR_FIELDS = ("doc_id", "path", "full_path", "title", "chunk_id", "chunk_index", "hit_text", "preview", "salient_sentence")


def _with(df: DataFrame, *names: tuple[str, str]) -> DataFrame:
    """``df`` with null columns where it has none of a name."""
    return df.withColumns({n: F.lit(None).cast(kind) for n, kind in names if n not in df.columns})


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, method: str = "rrf", k: int = 60, vector_weight: float = 0.5, keyword_weight: float = 0.5, top_k: int = 20, dedup: str = "last") -> DataFrame:
    """One ranking per query from two, joined on the lower-case path.

    ``rrf`` adds weight / (k + rank) of each side; ``weighted`` adds the vector score and the keyword score over
    the query's largest. Of several rows with one path on the vector side, ``dedup`` keeps the worst ranked
    ("last") or the best ("best"); ties in score go to the first place in the lists, vector before keyword.
    Rows without a path are passed over. Both sides need a rank; sides count to 2 * top_k.
    """
    v = _with(vector_hits, ("full_path", "string"), ("chunk_id", "long"), ("chunk_index", "int"), ("hit_text", "string"), ("preview", "string"), ("salient_sentence", "string"), ("title", "string"))
    q = _with(keyword_hits, ("target_path", "string"), ("file_name", "string"), ("snippet", "string"), ("utility_score", "double"), ("click_count", "double"), ("file_id", "long"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    v = v.filter(F.col("rank") <= 2 * top_k).withColumn("key", T.path_key(F.coalesce(blank("full_path"), F.col("path")))).filter("key <> ''")
    q = q.filter(F.col("rank") <= 2 * top_k).withColumn("key", T.path_key(F.coalesce(blank("full_path"), F.col("target_path"), F.lit("")))).filter("key <> ''")
    pick = F.max_by if dedup == "last" else F.min_by
    v = v.groupBy("query_id", "key").agg(pick(F.struct(*VECTOR_FIELDS, F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank")), "rank").alias("v"), F.min("rank").alias("v_first"))
    utility = F.coalesce(F.nullif(F.col("utility_score"), F.lit(0.0)), F.lit(1.0))
    most = q.groupBy("query_id").agg(F.greatest(F.lit(1.0), F.max(utility)).alias("most"))
    q = q.groupBy("query_id", "key").agg(
        F.min_by(F.struct("file_id", "full_path", "target_path", "file_name"), "rank").alias("k"),
        pick(F.struct(F.col("rank").alias("keyword_rank"), S.keyword_score(F.col("utility_score"), F.col("click_count")).alias("keyword_score")), "rank").alias("ks"),
        F.min_by(F.coalesce("snippet", F.lit("")), "rank").alias("first_snippet"),
        F.min_by(blank("snippet"), F.when(blank("snippet").isNotNull(), F.col("rank"))).alias("some_snippet"),
        F.min("rank").alias("k_first"),
    )
    both = v.join(q, ["query_id", "key"], "full_outer").join(most, "query_id", "left")
    score = S.rrf(F.col("v.vector_rank"), F.col("ks.keyword_rank"), vector_weight, keyword_weight, k) if method == "rrf" else S.weighted(F.col("v.vector_score"), F.col("ks.keyword_score"), F.coalesce("most", F.lit(1.0)), vector_weight, keyword_weight)
    only = F.col("v").isNull()
    k_path = T.relative_to(F.col("k.full_path"), F.col("k.target_path"))
    out = both.select(
        "query_id", "key", score.alias("hybrid_score"), S.match_type(F.col("v.vector_rank"), F.col("ks.keyword_rank")).alias("match_type"),
        "v.vector_rank", "v.vector_score", "ks.keyword_rank", "ks.keyword_score",
        F.when(only, F.col("k.file_id")).otherwise(F.col("v.doc_id")).alias("doc_id"),
        F.when(only, F.coalesce(F.nullif(k_path, F.lit("")), F.col("k.full_path"))).otherwise(F.col("v.path")).alias("path"),
        F.when(only, F.col("k.full_path")).otherwise(F.coalesce(F.nullif(F.col("v.full_path"), F.lit("")), F.col("v.path"))).alias("full_path"),
        F.when(only, F.coalesce(F.nullif(F.col("k.file_name"), F.lit("")), T.file_name(F.col("k.full_path")))).otherwise(F.col("v.title")).alias("title"),
        "v.chunk_id", "v.chunk_index", "v.hit_text", "v.salient_sentence",
        F.when(only, F.col("first_snippet")).otherwise(F.col("v.preview")).alias("preview"),
        F.when(only, F.col("first_snippet")).otherwise(F.col("some_snippet")).alias("snippet"),
        F.coalesce(F.col("v_first").cast("long"), F.col("k_first") + F.lit(1 << 32)).alias("_first"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "_first")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).drop("_first", "key")


def three_way(fused: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, rank, vector, hybrid, keyword): the paths at each rank of the three rankings."""
    ranked = fused.select("query_id", F.explode(F.array(
        F.struct(F.lit("vector").alias("source"), F.col("vector_rank").cast("int").alias("rank"), "path"),
        F.struct(F.lit("hybrid").alias("source"), F.col("rank").cast("int").alias("rank"), "path"),
        F.struct(F.lit("keyword").alias("source"), F.col("keyword_rank").cast("int").alias("rank"), "path"),
    )).alias("x")).select("query_id", "x.*").filter(F.col("rank").isNotNull() & (F.col("rank") <= top))
    return ranked.groupBy("query_id", "rank").pivot("source", ["vector", "hybrid", "keyword"]).agg(F.min("path"))

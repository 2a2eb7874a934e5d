"""A corpus from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; its result is written and read
again before the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import exact, jaccard, language, packing, pii
from folioflow.llm.repeats import row_id, text_hash
from folioflow.llm.shared import written

#: A document whose best cosine is lower is rejected; so is one without letters.
MIN_LANGUAGE_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: null, without a letter, or unlike every profile."""
    profiles = language.prototypes(docs.filter(~language.held_out()))
    found = language.identify(docs.select(F.struct("*").alias("row"), "text"), profiles)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def kept_rows(keyed: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The ``row`` of ``keyed`` (row, keys) for which ``verdicts`` (keys, kept, every: each of its rows stays) has a kept one. Of several
    rows with one key, which are then alike, one stays. Keys may be null."""
    stays = verdicts.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count_if(~F.col("every")).alias("_n"), F.max("kept").alias("_kept")).filter("_kept")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    left = keyed.hint("merge").join(stays, same)
    return left.filter("_n <= 1").unionByName(left.filter("_n > 1").dropDuplicates(keys)).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest, then the one with the smallest id."""
    verdicts = written(exact.duplicates(docs).select("doc_id", "text_sha256", "n_points", "kept", F.lit(False).alias("every")), "pipeline-verdicts")
    sha, n = F.sha2(exact.normalised(F.col("text")), 256), F.length(F.coalesce("text", F.lit(""))).cast("long")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), sha.alias("text_sha256"), n.alias("n_points"))
    return kept_rows(keyed, verdicts, ["doc_id", "text_sha256", "n_points"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates: the one with the smallest id, null ids after all others. A row without
    words is a component of its own, also when it repeats."""
    verdicts = jaccard.near_duplicates(docs).select("doc", "th", "kept", (F.col("n_shingles") == 0).alias("every"))
    keyed = docs.select(F.struct("*").alias("row"), row_id("doc_id").alias("doc"), text_hash("text").alias("th"))
    return kept_rows(keyed, verdicts, ["doc", "th"])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text."""
    out = pii.redact(docs.select(F.struct("*").alias("row"), "text"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast("long"))
    return out.select(row.alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of 1024 ids: one row per piece."""
    return packing.pack(docs).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("PII", redact),
    ("packing", pack),
]

#: SQL cannot express the trained stages; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

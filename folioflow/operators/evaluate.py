"""Offline evaluation of rankings and a search over scoring parameters."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import scoring as S
from folioflow.functions import text as T

SATURATED = 0.9999
# The grid that is searched.
NOISE_FLOORS = (0.68, 0.70, 0.72)
EXPONENTS = (1.3, 1.5, 1.6, 1.8)
LEXICAL_WEIGHTS = (0.12, 0.15, 0.18, 0.22)
STEM_BONUSES = (0.04, 0.08, 0.12)


def is_expected(path: Column, expected: Column) -> Column:
    """The expected name is in the path, or is its last part; case aside."""
    return F.contains(F.lower(path), F.lower(expected)) | (F.lower(T.file_name(path)) == F.lower(expected))


def match_ranks(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """``judgments`` with the rank of the first expected hit (null: none) and the top score; with the query's ``seconds``, if ``hits`` have them."""
    timed = ["seconds"] if "seconds" in hits.columns else []
    both = judgments.join(hits.select("query_id", "rank", "path", "score", *timed), "query_id", "left")
    return both.groupBy(*judgments.columns).agg(*(F.max(c).alias(c) for c in timed), F.min(F.when(is_expected(F.col("path"), F.col("expected")), F.col("rank"))).alias("match_rank"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"))


def measures(ranks: DataFrame) -> list[Column]:
    """hit_1, hit_3, hit_5, mrr, saturation, score_std, mean_score, total and, for timed hits, mean_seconds, as aggregates."""
    hit = lambda k: F.round(F.avg(F.when(F.col("match_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}")
    top = F.coalesce("top_score", F.lit(0.0))
    return [
        hit(1), hit(3), hit(5), F.round(F.avg(F.coalesce(1.0 / F.col("match_rank"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(top >= SATURATED, 1.0).otherwise(0.0)), 6).alias("saturation"),
        F.round(F.coalesce(F.stddev_pop("top_score"), F.lit(0.0)), 5).alias("score_std"), F.round(F.avg(top), 4).alias("mean_score"), F.count("*").alias("total"),
        *([F.round(F.avg("seconds"), 6).alias("mean_seconds")] if "seconds" in ranks.columns else []),
    ]


def metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """``measures`` by group or over all."""
    return ranks.groupBy(*by).agg(*measures(ranks))


def evaluate(search: Callable[[DataFrame], DataFrame] | DataFrame, judgments: DataFrame, by: str | None = None) -> DataFrame:
    """Metrics of a search function (queries to ranked hits), or of hits; with ``by``, per group and for all (null), in one
    pass by grouping sets. Queries without a group are in the row for all alone."""
    hits = search(judgments.select("query_id", "query")) if callable(search) else search
    ranks = match_ranks(hits, judgments)
    if by is None:
        return metrics(ranks)
    # of rolled-up rows, the one over all is told from a group that is null by its level
    return ranks.rollup(by).agg(*measures(ranks), F.grouping_id().alias("_level")).filter(F.col(by).isNotNull() | (F.col("_level") == 1)).drop("_level")


def ab_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean difference of top scores of two runs over the queries that both have."""
    top = lambda t, n: t.filter("rank = 1").select("query_id", F.col("score").alias(n))
    return top(a, "a").join(top(b, "b"), "query_id").agg(F.round(F.avg(F.col("a") - F.col("b")), 6).alias("delta"), F.count("*").alias("n_queries"))


def parameter_grid(spark) -> DataFrame:
    rows = [(float(a), float(b), float(c), float(d)) for a, b, c, d in itertools.product(NOISE_FLOORS, EXPONENTS, LEXICAL_WEIGHTS, STEM_BONUSES)]
    return spark.createDataFrame(rows, "noise_floor double, exponent double, lexical_weight double, stem_bonus double")


def grid_search(candidates: DataFrame, judgments: DataFrame, grid: DataFrame) -> DataFrame:
    """Metrics per parameter row, best first by mrr, then hit_1. ``candidates``: query_id, candidate rank, similarity, path and
    ``matches``. The grid is broadcast: it has some hundred rows, made in code."""
    params = grid.columns
    scored = candidates.join(judgments.select("query_id", "expected"), "query_id").crossJoin(F.broadcast(grid))
    score = S.grid_score(F.col("similarity"), F.col("matches"), *(F.col(c) for c in params))
    w = Window.partitionBy("query_id", *params).orderBy(F.desc("score"), "rank")
    ranked = scored.withColumn("score", F.round(score, 6)).withColumn("at", F.row_number().over(w))
    ranks = ranked.groupBy("query_id", *params).agg(F.min(F.when(is_expected(F.col("path"), F.col("expected")), F.col("at"))).alias("match_rank"))
    hit = lambda k: F.round(F.avg(F.when(F.col("match_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}")
    return ranks.groupBy(*params).agg(F.round(F.avg(F.coalesce(1.0 / F.col("match_rank"), F.lit(0.0))), 6).alias("mrr"), hit(1), hit(3)).orderBy(F.desc("mrr"), F.desc("hit_1"), *params)


def best_parameters(rows: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best rows of ``grid_search``."""
    return rows.orderBy(F.desc("mrr"), F.desc("hit_1"), "noise_floor", "exponent", "lexical_weight", "stem_bonus").limit(n)


def judged_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """Several judged sets (query_id, query, expected, category) as one, with the name of each as judged_set."""
    out = None
    for name, rows in sets.items():
        rows = rows.select("query_id", "query", "expected", "category", F.lit(name).alias("judged_set"))
        out = rows if out is None else out.unionByName(rows)
    return out


def model_similarities(pairs: DataFrame, encoders: dict) -> DataFrame:
    """(model, text_a, text_b, similarity) of each pair of texts under each encoder."""
    from folioflow.operators.encode import encode_column

    out = None
    for name, encoder in encoders.items():
        both = encode_column(encode_column(pairs, "text_a", encoder, True, "_a"), "text_b", encoder, False, "_b")
        rows = both.select(F.lit(name).alias("model"), "text_a", "text_b", S.inner(F.col("_a"), F.col("_b")).alias("similarity"))
        out = rows if out is None else out.unionByName(rows)
    return out

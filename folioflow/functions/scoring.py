"""Query keywords and scores as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import stem_of

# Words that say nothing about a query's subject.
STOP_WORDS = (
    "について", "に関する", "の基礎", "とは", "概要", "詳細", "まとめ", "方法",
    "どう", "なに", "なぜ", "これ", "それ", "あれ", "どこ", "だれ", "ので",
    "から", "たい", "です", "ます", "ある", "いる", "する", "こと", "もの",
)
SPLITTERS = r"(?U)[\s.,、。!?！？_/()（）「」『』【】]+"
RUNS = r"[一-鿿]+|[゠-ヿ]{2,}|[a-zA-Z0-9]{2,}"
HYPHENATED = r"[a-zA-Z0-9]+-[a-zA-Z0-9]+(?:-[a-zA-Z0-9]+)*"


def by_length(a: Column, b: Column) -> Column:
    """Longest first, then alphabetical."""
    return F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)


def query_keywords(query: Column) -> Column:
    """Distinct words of a query: runs of one script and hyphenated words, without stop words."""
    parts = F.split(F.coalesce(query, F.lit("")), SPLITTERS)
    whole = F.filter(F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(HYPHENATED), 0))), lambda k: F.length(k) >= 3)
    runs = F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(RUNS), 0)))
    runs = F.filter(runs, lambda k: (F.length(k) >= 2) & ~k.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.concat(whole, runs)), by_length)


def or_query(keywords: Column, query: Column) -> Column:
    return F.when(F.size(keywords) > 0, F.array_join(keywords, " OR ")).otherwise(query)


def merged(*lists: Column) -> Column:
    """Union without repeats, in order."""
    return F.array_distinct(F.concat(*lists))


def base_score(similarity: Column, floor: Column | float = 0.70, exponent: Column | float = 1.6) -> Column:
    """Similarity with the noise floor taken out: under it at most about 0.14, above it 0.15 to 0.82."""
    low = F.greatest(F.lit(0.0), (similarity - 0.45) / 1.8)
    width = 0.23 if isinstance(floor, float) and floor == 0.70 else 0.93 - floor
    share = F.least(F.greatest((similarity - floor) / width, F.lit(0.0)), F.lit(1.0))
    return F.when(similarity < floor, low).otherwise(0.15 + 0.67 * F.pow(share, F.lit(exponent) if isinstance(exponent, float) else exponent))


META_HEADER = r"(?i)^\[.*?\](?:\s*\[Tags:.*?\])?(?:\s*\[Aliases:.*?\])?(?:\s*\[Keywords:.*?\])?"


def keyword_matches(keywords: Column, title: Column, text: Column, path: Column) -> Column:
    """Struct of counts: matched, in title or path, in the metadata header; and whether one is the file's stem."""
    t, x, p = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, text, path))
    stem, header = F.lower(stem_of(F.coalesce(path, F.lit("")))), F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), META_HEADER, 0))
    low = F.transform(keywords, F.lower)
    in_title = lambda k: F.contains(t, k) | F.contains(p, k)
    in_header = lambda k: (header != "") & F.contains(header, k)
    return F.struct(
        F.size(F.filter(low, lambda k: (k == stem) | in_title(k) | in_header(k) | F.contains(x, k))).alias("matched"),
        F.size(F.filter(low, in_title)).alias("in_title"),
        F.size(F.filter(low, in_header)).alias("in_header"),
        F.exists(low, lambda k: (k == stem) & (stem != "")).alias("is_stem"),
        F.size(keywords).alias("total"),
    )


def calibrated(similarity: Column, matches: Column, keyword_boost: bool = True) -> Column:
    """Dense score plus shares for matched keywords, title and tags, at most 0.98, four digits."""
    base = base_score(similarity)
    alone = F.round(F.least(base, F.lit(0.98)), 4)
    if not keyword_boost:
        return alone
    title = F.when(matches["is_stem"], 0.08).otherwise(F.least(matches["in_title"] * 0.03, F.lit(0.06)))
    tags = F.least(matches["in_header"] * 0.04, F.lit(0.08))
    share = matches["matched"] / matches["total"] * 0.12
    full = F.round(F.least(F.greatest(base + share + title + tags, F.lit(0.0)), F.lit(0.98)), 4)
    return F.when(matches["total"] > 0, full).otherwise(alone)


def grid_score(similarity: Column, matches: Column, floor: Column, exponent: Column, lexical: Column, stem_bonus: Column) -> Column:
    """The scorer of the parameter search: every matched keyword counts for the title, tags do not count."""
    ratio = F.when(matches["total"] > 0, matches["matched"] / matches["total"]).otherwise(0.0)
    title = F.when(matches["is_stem"], stem_bonus).otherwise(F.least(matches["matched"] * 0.03, F.lit(0.06)))
    return F.least(F.greatest(base_score(similarity, floor, exponent) + ratio * lexical + title, F.lit(0.0)), F.lit(0.98))


def keyword_score(utility: Column, clicks: Column) -> Column:
    """Utility, else clicks, else 1; zero counts as missing."""
    zero = F.lit(0.0)
    return F.coalesce(F.nullif(utility, zero), F.nullif(clicks, zero), F.lit(1.0))


def rrf(vector_rank: Column, keyword_rank: Column, vector_weight: float, keyword_weight: float, k: int) -> Column:
    side = lambda rank, w: F.when(rank.isNotNull() & F.lit(w > 0), w * (1.0 / (k + rank))).otherwise(0.0)
    return F.round(side(vector_rank, vector_weight) + side(keyword_rank, keyword_weight), 6)


def weighted(vector_score: Column, keyword_raw: Column, most: Column, vector_weight: float, keyword_weight: float) -> Column:
    return F.round(vector_weight * F.coalesce(vector_score, F.lit(0.0)) + keyword_weight * (F.coalesce(keyword_raw, F.lit(0.0)) / most), 4)


def match_type(vector_rank: Column, keyword_rank: Column) -> Column:
    return F.when(vector_rank.isNotNull() & keyword_rank.isNotNull(), "both").when(vector_rank.isNotNull(), "vector_only").otherwise("keyword_only")


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector divided by its norm; a zero vector stays."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def inner(a: Column, b: Column) -> Column:
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), 6)



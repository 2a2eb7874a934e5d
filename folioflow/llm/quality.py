"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; policies are versioned masks applied to that integer, and ablations (what a policy
would keep without one of its rules) come from a count per mask, so changing a policy never reads
a text again. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurement columns; ``bit`` never changes once published."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(3, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words)"),
    Rule(5, "no_words", "n_words = 0"),
    Rule(6, "capitals", "100 * n_upper > 60 * n_letters"),
)

#: Masks by version. A published version keeps its mask.
POLICIES = {
    "base": 0b000011,
    "v1": 0b111111,
    "v2": 0b1111111,
}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurement columns; a null text counts as empty. A column of ``docs`` by the name of a measurement is replaced,
    as are fail_bits, policy and kept below; names that start with _ are taken on the way.

    A word is a run of characters other than space and \\t..\\r. Work stays inside one row, so
    nothing is shuffled. Three-word windows are compared by a 64-bit hash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = (
        docs.withColumn("_t", body)
        .withColumn("_w", F.filter(F.split("_t", SPACE), lambda w: w != ""))
        .withColumn("_l", F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace("_t", SPACE, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_letters", F.length(F.regexp_replace("_t", r"\P{L}+", "")).cast("long"))
        .withColumn("n_upper", F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long"))
        .withColumn("n_lines", F.size("_l").cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn(
            "_h",
            F.expr("CASE WHEN size(_w) < 3 THEN array() ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) END"),
        )
    )
    ordered = "sort_array(transform(_h, (h, i) -> struct(h, i)))"
    repeated = f"""
        transform(array({ordered}), s -> sort_array(filter(
            transform(s, (x, i) -> CASE WHEN (i > 0 AND s[greatest(i - 1, 0)].h = x.h)
                                          OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].h = x.h) THEN x.i END),
            p -> p IS NOT NULL)))[0]"""
    covered = f"""
        CASE WHEN size(_h) = size(array_distinct(_h)) THEN 0L
        ELSE transform(array({repeated}), r -> aggregate(
            transform(r, (p, i) -> CASE WHEN i = 0 THEN 3 ELSE least(3, p - r[greatest(i - 1, 0)]) END),
            0L, (a, x) -> a + x))[0] END"""
    return out.withColumn("n_repeat_words", F.expr(covered)).drop("_t", "_w", "_l", "_h")


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``: bit b is set when the rule of bit b fails."""
    bits: Column = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, text).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, version: str = "v1", policies: dict[str, int] = POLICIES) -> DataFrame:
    """``book`` with ``policy`` and ``kept``: no rule of the policy's mask failed."""
    return book.withColumn("policy", F.lit(version)).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policies[version])) == 0)


def ablation(book: DataFrame, version: str = "v1", rules: tuple[Rule, ...] = RULES, policies: dict[str, int] = POLICIES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that would be
    kept without it. The ledger is first counted by mask (at most 2^rules rows)."""
    mask = policies[version]
    counts = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    table = book.sparkSession.createDataFrame([(r.name, r.bit, 1 << r.bit) for r in rules if mask >> r.bit & 1], "rule string, bit int, one long")
    hit = F.col("bits").bitwiseAND(F.col("one")) != 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return (
        counts.join(F.broadcast(table))
        .groupBy("rule", "bit")
        .agg(
            total(hit).alias("n_failed"),
            total(F.col("bits") == F.col("one")).alias("n_failed_alone"),
            total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("one"))) == 0).alias("n_kept_without"),
        )
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """One row per document: the base measurements, the base verdict and the policy's verdict, from the stored ledger.

    A null or empty text has no words and fails; repeated rows are judged one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    book = apply_policy(written(ledger(docs).drop("text"), "quality-ledger"), "v2")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"])) != 0).alias("base_failed"),
        "kept", "fail_bits",
    )

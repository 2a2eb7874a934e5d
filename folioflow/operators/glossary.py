"""Glossary terms: loading, detection in texts, and enrichment of queries and notes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.numbering import numbered
from folioflow.operators.patterns import PART, occurrences

# What a header cell says about its column.
TERM_HEADERS = ("専門用語", "代表語", "term", "単語", "用語")
SYNONYM_HEADERS = ("類似語", "同義語", "略称", "別名", "synonym", "alias")
DESCRIPTION_HEADERS = ("意味", "解説", "説明", "description", "備考", "詳細")
SEPARATORS = r"[,、，\n\t]+"

#: The column of a saved glossary that holds its ids.
ENTRY = "entry_id"


def nfkc(c: Column) -> Column:
    """Unicode compatibility form, which Spark has no function for."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return run(c)


def term_key(c: Column) -> Column:
    return T.term_key(nfkc(F.coalesce(c, F.lit(""))))


def column_roles(header: list[str]) -> tuple[int, int, int]:
    """Places of term, synonyms (-1: none) and description."""
    term, synonyms, description = 0, -1, 1 if len(header) <= 2 else 2
    for i, name in enumerate(header):
        name = (name or "").strip().lower()
        if any(k in name for k in TERM_HEADERS):
            term = i
        elif any(k in name for k in SYNONYM_HEADERS):
            synonyms = i
        elif any(k in name for k in DESCRIPTION_HEADERS):
            description = i
    return term, synonyms, description


def parse_glossary(table: DataFrame) -> DataFrame:
    """entry_id, term, synonyms, description from a table whose header names the columns' roles. The term cell may hold a list; rows
    without a term are dropped. Entry ids are those of a column ``entry_id`` if there is one, as in files that were saved here, else
    they follow the order of files and of rows in them: a prefix sum over partitions numbers them."""
    cells = table.columns
    named = [c for c in cells if c != ENTRY]
    term, synonyms, description = column_roles(named)
    cell = lambda i: F.coalesce(F.col(f"`{named[i]}`").cast("string"), F.lit("")) if 0 <= i < len(named) else F.lit("")
    listed = lambda c: F.array_distinct(T.listed(c, SEPARATORS))
    rows = table.select(listed(cell(term)).alias("terms"), listed(cell(synonyms)).alias("more"), T.strip(cell(description)).alias("description"), *([F.col(ENTRY).cast("int").alias("entry_id")] if ENTRY in cells else []))
    rows = rows.filter(F.size("terms") > 0)
    entries = rows.select(
        *(["entry_id"] if ENTRY in cells else []),
        F.col("terms")[0].alias("term"),
        F.array_remove(F.array_distinct(F.concat(F.slice("terms", 2, F.size("terms")), "more")), F.col("terms")[0]).alias("synonyms"),
        "description",
    )
    out = entries if ENTRY in cells else numbered(entries, "entry_id").withColumn("entry_id", F.col("entry_id").cast("int"))
    return out.select("entry_id", "term", "synonyms", "description")


def load_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A glossary from CSV with a header, quoted cells and line breaks in them."""
    return parse_glossary(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8"))


def save_glossary(glossary: DataFrame, path: str) -> None:
    """All spellings and the description, as many files as the table has ranges of entries, each in order; an id beside them keeps
    entries what they are. Blank rows are left out."""
    rows = glossary.filter(F.coalesce(F.col("term"), F.lit("")) != "").repartitionByRange("entry_id").sortWithinPartitions("entry_id")
    columns = [F.array_join(F.concat(F.array("term"), "synonyms"), ", ").alias("専門用語"), F.col("description").alias("意味・解説"), F.col("entry_id").alias(ENTRY)]
    rows.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def variants(glossary: DataFrame) -> DataFrame:
    """(entry_id, place, variant, norm_key): every spelling of every entry."""
    each = glossary.select("entry_id", F.posexplode(F.array_distinct(F.concat(F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>"))))).alias("place", "variant"))
    return each.filter("variant <> ''").withColumn("norm_key", term_key(F.col("variant")))


def matches_filter(glossary: DataFrame, query: str) -> DataFrame:
    """Entries with a text in their spellings or description, case aside."""
    low = query.lower()
    return glossary.filter(F.exists(F.concat(F.array("term"), "synonyms"), lambda v: F.contains(F.lower(v), F.lit(low))) | F.contains(F.lower("description"), F.lit(low)))


def detect_terms(texts: DataFrame, glossary: DataFrame, key: str, text: str, part_size: int = PART) -> DataFrame:
    """(key, entry_id, place from 1): the entries that occur in each text, each once.

    First those with a spelling of two characters or more in the text, case aside, longest spelling first;
    then those whose normalised key is in the normalised text, in entry order. Nested terms all count. Spellings and keys are
    looked for all at once (``occurrences``), so a text is read once however many there are.
    """
    low = texts.select(F.col(key).alias("key"), F.lower(F.coalesce(text, F.lit(""))).alias("low"), term_key(F.col(text)).alias("norm"))
    spelled = variants(glossary).select("entry_id", "place", "variant", "norm_key", F.length("variant").alias("n"))
    sides = (
        spelled.filter("n >= 2").select("entry_id", "place", F.lower("variant").alias("pattern"), "n", F.lit(0).alias("side"))
        .unionByName(spelled.filter(F.length("norm_key") >= 2).select("entry_id", "place", F.col("norm_key").alias("pattern"), "n", F.lit(1).alias("side")))
    )
    found = occurrences(low, sides, part_size).repartition("key")
    best = found.groupBy("key", "entry_id").agg(F.min(F.struct("by", "n", "entry_id", "place")).alias("rank"))
    return best.select(F.col("key").alias(key), "entry_id", F.row_number().over(Window.partitionBy("key").orderBy("rank")).alias("place"))


def find_by_term(terms: DataFrame, glossary: DataFrame, term: str) -> DataFrame:
    """``terms`` with the entry of their normalised key, null without one; of entries with one key the last."""
    last = variants(glossary).filter("norm_key <> ''").groupBy("norm_key").agg(F.max("entry_id").alias("entry_id"))
    return terms.withColumn("_key", term_key(F.col(term))).join(last, F.col("_key") == F.col("norm_key"), "left").drop("_key", "norm_key").join(glossary, "entry_id", "left")


def detected_report(texts: DataFrame, glossary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms): array of (term, synonyms, description), in order of detection; empty without any."""
    found = detect_terms(texts, glossary, key, text).join(glossary, "entry_id")
    terms = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term", "synonyms", "description"))), lambda x: F.struct(x["term"].alias("term"), x["synonyms"].alias("synonyms"), x["description"].alias("description"))).alias("terms"))
    return texts.select(key).distinct().join(terms, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<term:string,synonyms:array<string>,description:string>>")))


def enriched_queries(queries: DataFrame, glossary: DataFrame, key: str = "query_id", query: str = "query") -> DataFrame:
    """``queries`` with ``enriched``: for each detected term up to four of its other spellings and its
    description stand before the query; without any, the query itself."""
    report = detected_report(queries, glossary, key, query)
    both = queries.join(report, key, "left")

    def info(t: Column) -> Column:
        absent = F.filter(F.array_distinct(F.concat(F.array(t["term"]), t["synonyms"])), lambda v: (v != "") & ~F.contains(F.col(query), v))
        parts = F.slice(F.concat(absent, F.when(F.coalesce(t["description"], F.lit("")) != "", F.array(t["description"])).otherwise(F.array().cast("array<string>"))), 1, 4)
        return F.when(F.size(parts) > 0, F.concat(t["term"], F.lit(" => "), F.array_join(parts, ", ")))

    infos = F.array_compact(F.transform("terms", info))
    return both.withColumn("enriched", F.when(F.size(infos) > 0, F.concat(F.lit("[関連用語: "), F.array_join(infos, "; "), F.lit("] "), F.col(query))).otherwise(F.col(query)))


def enrich_documents(glossary: DataFrame, key: str = "path"):
    """For ``chunk_documents``: the spellings of detected entries join the aliases, ``term: description`` the notes."""

    def run(docs: DataFrame) -> DataFrame:
        report = detected_report(docs, glossary, key, "link_text")
        spelled = F.flatten(F.transform("terms", lambda t: F.concat(F.array(t["term"]), t["synonyms"])))
        notes = F.transform(F.filter("terms", lambda t: F.coalesce(t["description"], F.lit("")) != ""), lambda t: F.concat(t["term"], F.lit(": "), t["description"]))
        return (
            docs.join(report, key, "left")
            .withColumn("aliases", F.array_sort(F.array_distinct(F.concat("aliases", F.coalesce(spelled, F.array().cast("array<string>"))))))
            .withColumn("context_notes", F.array_sort(F.array_distinct(F.concat("context_notes", F.coalesce(notes, F.array().cast("array<string>"))))))
            .drop("terms")
        )

    return run

"""Markdown notes to chunks with heading breadcrumbs. Everything happens inside one row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T


def extract_metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with clean_text, tags, aliases, keywords (sorted, distinct), context_notes (empty) and
    link_text, the body before its lines are cleaned, in which glossary terms are looked for."""
    out = docs.withColumn("_f", T.frontmatter(F.col(text))).withColumn("_front", F.col("_f.front")).withColumn("link_text", T.without_links(T.without_drawing(F.col("_f.body"))))
    listed = lambda *c: F.array_sort(F.array_distinct(F.concat(*c)))
    return (
        out.withColumn("tags", listed(T.frontmatter_list(F.col("_front"), "tags"), T.hashtags(F.col("link_text"))))
        .withColumn("aliases", listed(T.frontmatter_list(F.col("_front"), "aliases")))
        .withColumn("keywords", listed(T.frontmatter_keywords(F.col("_front"))))
        .withColumn("context_notes", F.array().cast("array<string>"))
        .withColumn("clean_text", T.clean_lines(F.col("link_text")))
        .drop("_front", "_f")
    )


def metadata_prefix(tags: Column, aliases: Column, keywords: Column, notes: Column) -> Column:
    """``[Tags: #a #b] [Aliases: …] [Keywords: …] [Context: …]``, of what there is; three notes at most."""
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"[{name}: "), F.array_join(c, " "), F.lit("]")))
    return F.concat_ws(" ", part("Tags", F.transform(tags, lambda t: F.concat(F.lit("#"), t))), part("Aliases", aliases), part("Keywords", keywords), part("Context", F.slice(notes, 1, 3)))


def base_title(title: Column) -> Column:
    return T.strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"\.[a-zA-Z0-9]+\z", ""))


def sections(clean: Column, base: Column, prefix: Column) -> Column:
    """array<struct<context, body>>: text below each heading, with the headings above it. A heading ends those
    of its level or deeper; the title is above them all. Lines are looked at once: a section is a slice of them."""
    crumb = "array<struct<level:int,name:string>>"
    root = F.when(base != "", F.array(F.struct(F.lit(0).alias("level"), base.alias("name")))).otherwise(F.array()).cast(crumb)
    level = lambda x: F.length(F.regexp_extract(x, r"(?U)^(#{1,6})\s+.+", 1))
    name = lambda x: T.strip(F.regexp_extract(x, r"(?U)^#{1,6}\s+(.+)", 1))

    def with_headings(rows: Column) -> Column:
        at = F.filter(F.transform(rows, lambda x, i: F.when(x.startswith("#") & (level(x) > 0), i)), lambda i: i.isNotNull())
        return T.let(F.struct(rows.alias("rows"), at.alias("at"), root.alias("root")), with_crumbs)

    def with_crumbs(z: Column) -> Column:
        heads = F.transform(z["at"], lambda i: F.struct(level(z["rows"][i]).alias("level"), name(z["rows"][i]).alias("name")))
        zero = F.struct(F.array(z["root"]).alias("out"), z["root"].alias("now")).cast(f"struct<out:array<{crumb}>,now:{crumb}>")

        def step(s: Column, h: Column) -> Column:
            above = F.concat(F.filter(s["now"], lambda c: c["level"] < h["level"]), F.array(h))
            return F.struct(F.concat(s["out"], F.array(above)).alias("out"), above.alias("now"))

        crumbs = F.aggregate(heads, zero, step, lambda s: s["out"])
        starts, ends = F.concat(F.array(F.lit(-1)), z["at"]), F.concat(z["at"], F.array(F.size(z["rows"])))
        return T.let(F.struct(z["rows"].alias("rows"), crumbs.alias("crumbs"), starts.alias("starts"), ends.alias("ends")), cut)

    def cut(z: Column) -> Column:
        context = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x["name"]), " > "), F.lit("]"), F.when(prefix != "", F.concat(F.lit(" "), prefix)).otherwise(""))
        body = lambda i: T.strip(F.array_join(F.slice(z["rows"], z["starts"][i] + 2, z["ends"][i] - z["starts"][i] - 1), "\n"))
        return F.transform(z["crumbs"], lambda c, i: F.struct(context(c).alias("context"), body(i).alias("body")))

    return F.filter(T.let(T.lines(clean), with_headings), lambda s: s["body"] != "")


def packed(body: Column, size: int, overlap: int) -> Column:
    """Paragraphs packed greedily up to ``size`` characters; the next chunk starts with the last ``overlap``
    characters of the one before. A paragraph that is too long stays whole."""
    paragraphs = F.filter(F.transform(F.split(body, r"(?U)\n\s*\n"), T.strip), lambda p: p != "")
    state = "struct<out:array<string>,buffer:string>"
    zero = F.struct(F.array().alias("out"), F.lit("").alias("buffer")).cast(state)

    def step(s: Column, p: Column) -> Column:
        buffer = s["buffer"]
        tail = F.when((F.lit(overlap) > 0) & (F.length(buffer) > overlap), F.concat(F.right(buffer, F.lit(overlap)), F.lit("\n\n"), p)).otherwise(p)
        return (
            F.when(buffer == "", F.struct(s["out"], p).cast(state))
            .when(F.length(buffer) + F.length(p) + 2 <= size, F.struct(s["out"], F.concat(buffer, F.lit("\n\n"), p)).cast(state))
            .otherwise(F.struct(F.concat(s["out"], F.array(buffer)), tail).cast(state))
        )

    return F.aggregate(paragraphs, zero, step, lambda s: F.when(s["buffer"] != "", F.concat(s["out"], F.array(s["buffer"]))).otherwise(s["out"]))


def chunk_documents(docs: DataFrame, chunk_size: int = 600, overlap: int = 80, text: str = "text", title: str = "title", enrich=None) -> DataFrame:
    """One row per chunk: the columns of ``docs`` but ``text``, with chunk_index from 0 and chunk_text.

    ``enrich`` takes the documents with their metadata and returns them with more aliases and context notes
    (see ``glossary.enrich_documents``). A note without text gives its title and metadata, if any.
    """
    out = extract_metadata(docs, text)
    if enrich is not None:
        out = enrich(out)
    out = (
        out.withColumn("_base", base_title(F.col(title)))
        .withColumn("_prefix", metadata_prefix(F.col("tags"), F.col("aliases"), F.col("keywords"), F.col("context_notes")))
        .withColumn("_head", T.strip(F.concat(F.lit("["), F.col("_base"), F.lit("] "), F.col("_prefix"))))
        .withColumn("_sections", F.when(F.col("clean_text").rlike(r"(?dmU)^#{1,6}\s+") | (F.length("clean_text") > chunk_size), sections(F.col("clean_text"), F.col("_base"), F.col("_prefix"))))
    )
    whole = F.array(F.concat(F.col("_head"), F.lit("\n"), F.col("clean_text")))
    split = F.flatten(F.transform("_sections", lambda s: F.transform(
        F.when(F.length(s["body"]) <= chunk_size, F.array(s["body"])).otherwise(packed(s["body"], chunk_size, overlap)), lambda b: T.strip(F.concat(s["context"], F.lit("\n"), b))
    )))
    pieces = (
        F.when((F.col("clean_text") == "") & (F.col("_base") == "") & (F.col("_prefix") == ""), F.array().cast("array<string>"))
        .when(F.col("clean_text") == "", F.array("_head"))
        .when(F.size(F.coalesce("_sections", F.array().cast("array<struct<context:string,body:string>>"))) == 0, whole)
        .otherwise(split)
    )
    keep = [c for c in docs.columns if c != text]
    # the outer form: for the plain one Spark would compute all of the above a second time, in a filter
    return out.withColumn("_pieces", pieces).select(*keep, F.posexplode_outer("_pieces").alias("chunk_index", "chunk_text")).filter("chunk_index IS NOT NULL")

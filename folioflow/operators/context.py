"""Context for language models: ranked hits as text, and bundles of chosen documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions.rowtables import row_tables
from folioflow.operators.numbering import numbered, running_totals
from folioflow.storage import written

# Texts of the two formats.
EMPTY_XML = "  <!-- 関連コンテキストは見つかりませんでした -->"
EMPTY_MD = "*関連するコンテキストは見つかりませんでした。*"
TITLE_MD, QUESTION_MD = "## 参考コンテキスト", "ユーザーの質問: "
# Endings tried for a reference without one, in order.
ASSET_SUFFIXES = ("", ".png", ".svg", ".jpg", ".jpeg", ".webp", ".gif", ".excalidraw.svg", ".excalidraw.png", ".drawio.svg")
MIME_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def render_context(queries: DataFrame, hits: DataFrame, fmt: str = "xml", top: int = 5) -> DataFrame:
    """(query_id, context): the best hits of each query as one text; a notice for queries without hits.

    Content is the hit text, else the preview. XML values are escaped.
    """
    have = set(hits.columns)
    sources = [F.nullif(F.col(c), F.lit("")) for c in ("hit_text", "snippet", "preview") if c in have]
    body = T.lines(T.strip(F.coalesce(*sources, F.lit(""))))
    score = F.format_string("%.4f", F.col("score"))
    rank = F.col("rank").cast("string")
    if fmt == "xml":
        e = T.html_escaped
        block = F.concat(
            F.lit('  <document index="'), rank, F.lit('" title="'), e(F.col("title")), F.lit('" path="'), e(F.col("path")), F.lit('" score="'), score, F.lit('">\n'),
            F.array_join(F.transform(body, lambda x: F.concat(F.lit("    "), e(x))), "\n"), F.lit("\n  </document>"),
        )
    else:
        block = F.concat(
            F.lit("### ["), rank, F.lit("] "), F.col("title"), F.lit(" (Score: "), score, F.lit(", Path: `"), F.col("path"), F.lit("`)\n"),
            F.array_join(F.transform(body, lambda x: F.when(x == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n"),
        )
    blocks = hits.filter(F.col("rank") <= top).select("query_id", "rank", block.alias("block")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]).alias("blocks"))
    out = queries.select("query_id", "query").join(blocks, "query_id", "left")
    some = F.size(F.coalesce("blocks", F.array().cast("array<string>"))) > 0
    if fmt == "xml":
        text = F.concat(F.lit('<context query="'), T.html_escaped(F.col("query")), F.lit('">\n'), F.when(some, F.array_join("blocks", "\n")).otherwise(EMPTY_XML), F.lit("\n</context>"))
    else:
        full = F.concat(F.lit(f"{TITLE_MD}\n{QUESTION_MD}`"), F.col("query"), F.lit("`\n\n"), F.array_join("blocks", "\n\n"))
        text = F.when(some, T.strip(full)).otherwise(F.concat(F.lit(f"{TITLE_MD} (クエリ: "), F.col("query"), F.lit(f")\n{EMPTY_MD}")))
    return out.select("query_id", text.alias("context"))


def write_context(contexts: DataFrame, path: str) -> None:
    """One text file per partition, contexts separated by line ends."""
    contexts.select("context").write.mode("overwrite").text(path)


def _first_match(candidates: DataFrame, listing: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Of (keys, priority, candidate) rows that ``listing`` (target, low) has, the one with the lowest priority."""
    found = candidates.join(listing, F.lower("candidate") == F.col("low"))
    return found.groupBy(*keys).agg(F.min(F.struct("priority", F.col(target).alias("found"))).alias("m")).select(*keys, F.col("m.found").alias(target))


def resolve_assets(references: DataFrame, assets: DataFrame) -> DataFrame:
    """``references`` (path of the note, reference) with ``asset_path``, null when nothing fits.

    The decoded reference is tried with every usual ending in the note's folder, the root, the folder above and
    then, by its name alone, anywhere; the first that the listing ``assets`` (asset_path) has wins.
    """
    name = T.url_decoded(F.col("reference"))
    folder = T.parent_folder(F.col("path"))
    join = lambda a, b: F.regexp_replace(F.regexp_replace(F.concat(a, F.lit("/"), b), r"/+", "/"), r"^/|\./", "")
    places = F.array(join(folder, name), F.regexp_replace(name, r"^(?:\./)?/*", ""), join(T.parent_folder(folder), name))
    endings = F.array(*(F.lit(s) for s in ASSET_SUFFIXES))
    n = len(ASSET_SUFFIXES)
    refs = references.select("path", "reference").distinct()
    exact = refs.select("path", "reference", F.posexplode(F.flatten(F.transform(places, lambda p: F.transform(endings, lambda s: F.concat(p, s))))).alias("priority", "candidate"))
    anywhere = refs.select("path", "reference", F.posexplode(F.transform(endings, lambda s: F.concat(T.file_name(name), s))).alias("priority", "candidate")).withColumn("priority", F.col("priority") + 3 * n)
    listing = assets.select("asset_path").distinct()
    by_path = _first_match(exact, listing.withColumn("low", F.lower("asset_path")), ["path", "reference"], "asset_path")
    by_name = _first_match(anywhere, listing.withColumn("low", F.lower(T.file_name(F.col("asset_path")))), ["path", "reference"], "asset_path").withColumnRenamed("asset_path", "elsewhere")
    return references.join(by_path, ["path", "reference"], "left").join(by_name, ["path", "reference"], "left").withColumn("asset_path", F.coalesce("asset_path", "elsewhere")).drop("elsewhere")


def resolve_documents(selection: DataFrame, documents: DataFrame, root: str = "") -> DataFrame:
    """``selection`` (position, path) with ``doc_path``: the document meant by an absolute, relative, prefixed or bare name.

    Tried in this order: the path below ``root``, the path itself, the path without its first folder, the name alone.
    """
    asked = F.regexp_replace(F.col("path"), r"\\", "/")
    below = T.relative_to(asked, F.lit(root))
    options = F.array(below, F.regexp_replace(asked, "^/+", ""), F.regexp_replace(F.regexp_replace(asked, "^/+", ""), "^[^/]+/", ""))
    rows = selection.select("position", F.posexplode(options).alias("priority", "candidate"))
    listing = documents.select(F.col("path").alias("doc_path")).distinct()
    by_path = _first_match(rows, listing.withColumn("low", F.lower("doc_path")), ["position"], "doc_path")
    names = selection.select("position", F.lit(9).alias("priority"), T.file_name(asked).alias("candidate"))
    by_name = _first_match(names, listing.withColumn("low", F.lower(T.file_name(F.col("doc_path")))), ["position"], "doc_path").withColumnRenamed("doc_path", "elsewhere")
    return selection.join(by_path, "position", "left").join(by_name, "position", "left").withColumn("doc_path", F.coalesce("doc_path", "elsewhere")).drop("elsewhere")


def mime_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]+)\z", 1))
    out = F.lit("application/octet-stream")
    for k, v in MIME_TYPES.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


EMBED = r"!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]|!\[[^\]]*\]\(([^)]+)\)"


def embeds(text: Column) -> Column:
    """References of embedded files, in both notations."""
    first, second = (F.regexp_extract_all(text, F.lit(EMBED), i) for i in (1, 2))
    return F.filter(F.zip_with(first, second, lambda a, b: T.strip(F.when(a != "", a).otherwise(b))), lambda r: r != "")


def export_body(text: Column) -> Column:
    """A note without frontmatter (whatever stands between its first two rules) and drawing data."""
    bare = T.let(F.split(text, "---", 3), lambda parts: F.when(text.startswith("---") & (F.size(parts) == 3), T.strip(F.get(parts, F.lit(2)))).otherwise(text))
    return T.without_drawing(bare)


def is_drawing(path: Column, text: Column) -> Column:
    """A note that holds a drawing, by its name or by marks in its first 3000 characters."""
    head = F.substring(text, 1, 3000)
    return F.lower(path).endswith(".excalidraw.md") | head.rlike(r"(?i)excalidraw-plugin\s*:") | head.rlike(r"(?im)^tags:.*excalidraw|#excalidraw\b") | head.rlike(r"(?im)^#+\s*excalidraw\b")


PART = "section int, number long, offset long, n_bytes long, n_assets long, content string"


def bundle(selection: DataFrame, documents: DataFrame, assets: DataFrame | None = None, prompt: str = "", title: str = "Context", include_raw: bool = True) -> DataFrame:
    """The parts (PART) of one text: a head (section 0), a list of the documents (1) and the documents (2). Each part ends with what parts it
    from the next one and says at which byte of the whole it begins, so parts can be written, served and checked one by one.

    Documents keep the order of ``selection`` (position, path), of equal positions that of their paths, and are numbered; embedded files found in
    ``assets`` (asset_path, content) are inlined as data URLs. Numbers and offsets are prefix sums, so no task holds the whole text.
    An empty selection gives the head alone.
    """
    chosen = resolve_documents(selection, documents).filter(F.col("doc_path").isNotNull()).select("position", "doc_path")
    docs = chosen.join(documents.select(F.col("path").alias("doc_path"), "title", "text"), "doc_path").withColumn("body", export_body(F.col("text")))
    docs = docs.repartitionByRange("position", "doc_path").sortWithinPartitions("position", "doc_path").select("position", "doc_path", "title", "body")
    docs = numbered(docs, "number")
    n_assets = F.lit(0)
    if assets is not None:
        refs = docs.select("number", F.col("doc_path").alias("path"), F.explode(embeds(F.col("body"))).alias("reference")).distinct()
        found = resolve_assets(refs, assets).filter(F.col("asset_path").isNotNull()).join(assets.select("asset_path", "content"), "asset_path")
        urls = found.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("reference", T.data_url(F.col("content"), mime_type(F.col("asset_path"))).alias("url")))).alias("urls"))
        docs = docs.join(urls, "number", "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<struct<reference:string,url:string>>")))
        wiki = lambda b, u: F.replace(b, F.concat(F.lit("![["), u["reference"], F.lit("]]")), F.concat(F.lit("![]("), u["url"], F.lit(")")))
        link = lambda b, u: F.replace(b, F.concat(F.lit("]("), u["reference"], F.lit(")")), F.concat(F.lit("]("), u["url"], F.lit(")")))
        docs, n_assets = docs.withColumn("body", F.aggregate("urls", F.col("body"), lambda b, u: link(wiki(b, u), u))), F.size("urls")
    spark, last = documents.sparkSession, docs.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    entry = F.concat(F.col("number").cast("string"), F.lit(". "), "title")
    block = F.concat(F.lit("## "), entry, F.lit("\n\n"), F.col("body" if include_raw else "title"))
    ends = F.col("number") == F.col("last")
    parts = written(docs.crossJoin(F.broadcast(last)).select(
        "number", n_assets.cast("long").alias("n_assets"), F.concat(entry, F.when(ends, "\n\n").otherwise("\n")).alias("entry"),
        F.concat(block, F.when(ends, "").otherwise("\n\n")).alias("block"),
    ), "bundle-parts")
    head = "\n\n".join([f"# {title}", *([prompt] if prompt else [])]) + "\n\n"
    sizes = parts.select("number", F.octet_length("entry").cast("long").alias("entry"), F.octet_length("block").cast("long").alias("block"))
    placed = running_totals(sizes, "number", "entry", "block").select("number", "before_entry", "before_block")
    listed, n_head = sizes.agg(F.coalesce(F.sum("entry"), F.lit(0)).alias("listed")), len(head.encode())
    rows = parts.join(placed, "number").crossJoin(F.broadcast(listed))
    each = lambda section, offset, n, content: F.struct(F.lit(section).alias("section"), "number", offset.alias("offset"), F.octet_length(content).cast("long").alias("n_bytes"), n.alias("n_assets"), F.col(content).alias("content"))
    both = F.array(each(1, F.col("before_entry") + n_head, F.lit(0).cast("long"), "entry"), each(2, F.col("before_block") + F.col("listed") + n_head, F.col("n_assets"), "block"))
    return spark.createDataFrame([(0, 0, 0, n_head, 0, head)], PART).unionByName(rows.select(F.explode(both).alias("p")).select("p.*"))


def bundle_totals(parts: DataFrame) -> DataFrame:
    """One row: n_documents, n_assets, n_bytes."""
    return parts.agg(F.count_if(F.col("section") == 2).alias("n_documents"), F.sum("n_assets").alias("n_assets"), F.sum("n_bytes").alias("n_bytes"))


def save_bundle(parts: DataFrame, path: str) -> None:
    """The text as files in the order of their names, each a range of parts; one behind the other they are the whole, and a line end."""
    rows = parts.repartitionByRange("section", "number").sortWithinPartitions("section", "number")
    rows.select(F.regexp_replace("content", r"\n\z", "")).write.mode("overwrite").option("lineSep", "\n").text(path)


def embedded_tables(notes: DataFrame, text: str = "text") -> DataFrame:
    """(path, row, name, tags, excerpt, ctime, mtime): rows of the arrays that ``dataviewjs`` blocks of a note assign to a list, and of
    their ``dv.table(headers, rows)`` calls. An array is read as JSON; only one that is none is repaired, outside its strings."""
    return notes.select("path", F.posexplode(row_tables(F.col(text))).alias("row", "r")).select("path", "row", "r.name", "r.tags", "r.excerpt", "r.ctime", "r.mtime")

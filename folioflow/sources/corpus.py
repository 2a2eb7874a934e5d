"""Reading a tree of notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.sources.tree import opened, read_tree

# What is no note.
EXCLUDED_DIRS = (".obsidian", ".git", ".vector_search", ".trash", ".agents", "node_modules", ".venv", "__pycache__")
EXCLUDED_SUFFIXES = (".excalidraw.md", ".excalidraw", ".canvas", ".drawio.svg", ".drawio")
DEFAULT_EXTENSIONS = (".md", ".markdown", ".txt")

#: Names that a targeted scan tells the file listing at most.
NAMED = 10_000


def normalised_extensions(extensions: str | list[str] | None) -> list[str]:
    """Lower case with a dot; a string is split at commas, semicolons and blanks; nothing means the usual ones."""
    if isinstance(extensions, str):
        extensions = extensions.replace(",", " ").replace(";", " ").split()
    found = [e.strip().lower() for e in extensions or () if e and e.strip()]
    return [e if e.startswith(".") else f".{e}" for e in found] or list(DEFAULT_EXTENSIONS)


def is_wanted(relative: Column, extensions: list[str]) -> Column:
    """A path with a wanted ending, outside the excluded and the hidden folders."""
    low = F.lower(relative)
    folders = F.split(T.parent_folder(relative), "/")
    hidden = F.exists(folders, lambda d: d.startswith(".") | d.isin(*EXCLUDED_DIRS))
    excluded = F.lit(False)
    for s in EXCLUDED_SUFFIXES:
        excluded = excluded | low.endswith(s)
    return F.regexp_extract(low, r"(?<=[^/])(\.[^./]*)\z", 1).isin(*extensions) & ~excluded & ~hidden


def scan_corpus(spark: SparkSession, root: str, extensions: str | list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """path, relative_path, title, mtime, size, sha256, text of every note below ``root``. Bytes that are no UTF-8 are
    replaced; a root that is not there raises. With ``names``, only files with one of these names are read. In a file system that
    pyarrow does not open, Spark's file source reads, which does not see names that begin with an underscore or a dot."""
    if opened(root) is not None:
        files = read_tree(spark, root, names)
        path = F.col("path")
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if names is not None:
            reader = reader.option("pathGlobFilter", "{" + ",".join(re.sub(r"([\\{}\[\],*?])", r"\\\1", x) for x in names) + "}")
        bare = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:(?://[^/]*)?/*", "/")
        path, base = bare(F.col("path")), F.regexp_replace(bare(F.lit(root)), r"/+\z", "")
        files = reader.load(root).withColumn("relative_path", F.regexp_replace(F.substr(path, F.length(base) + 1), "^/+", ""))
    wanted = files.filter(is_wanted(F.col("relative_path"), normalised_extensions(extensions)))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return wanted.select(
        path.alias("path"), "relative_path", T.title(text, T.stem_of(F.col("relative_path"))).alias("title"), F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), text.alias("text"),
    )


def scan_files(spark: SparkSession, root: str, requested: DataFrame, extensions: str | list[str] | None = None) -> DataFrame:
    """The notes at the relative paths of ``requested``, with nulls for those that are missing or cannot be seen. Only files by the
    requested names are read; a request for more than NAMED of them reads every file."""
    names = [r["name"] for r in requested.select(T.file_name(F.col("relative_path")).alias("name")).distinct().limit(NAMED + 1).collect()]
    found = scan_corpus(spark, root, extensions, [n for n in names if n] if len(names) <= NAMED else None)
    return requested.select("relative_path").join(found, "relative_path", "left")


def keyword_hits(spark: SparkSession, path: str) -> DataFrame:
    """Ranked keyword hits from JSON lines."""
    from folioflow.schemas import KEYWORD_HITS

    return spark.read.schema(KEYWORD_HITS).json(path)

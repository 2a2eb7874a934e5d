"""The index: an append-only change log of documents with their chunks, one Parquet tree per table.

A batch is one partition, so writing it again replaces it; what is current is the last version of each path. ``compact`` copies what
is current to a generation of its own, which a small file then names, so that documents and chunks change together.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import stem_of
from folioflow.functions.text import title as title_of
from folioflow.operators.chunking import chunk_documents
from folioflow.operators.encode import Encoder, HashEncoder, embed_index

LOG = "doc_id long, path string, op string, title string, mtime timestamp, size long, sha256 string, text string, embedding array<double>, model_id string, batch_id long"
CHUNK_LOG = "chunk_id long, doc_id long, path string, title string, chunk_index int, chunk_text string, embedding array<double>, embedding_dim int, sha256 string, model_id string, batch_id long"


#: The file that names the generation that is read and written; without it the tables lie in the index folder itself.
CURRENT = "CURRENT"


def generation(index_dir: str) -> str:
    """The name of the current generation, empty for the first."""
    system, inner = fs.FileSystem.from_uri(index_dir)
    path = f"{inner.rstrip('/')}/{CURRENT}"
    if system.get_file_info(path).type != fs.FileType.File:
        return ""
    with system.open_input_stream(path) as file:
        return file.read().decode()


def tables(index_dir: str) -> str:
    """Where the tables of the current generation lie."""
    return f"{index_dir.rstrip('/')}/{generation(index_dir)}".rstrip("/")


def read_table(spark: SparkSession, index_dir: str, name: str) -> DataFrame:
    """A table of the index; empty before its first batch."""
    schema = LOG if name == "documents" else CHUNK_LOG
    try:
        return spark.read.schema(schema).parquet(f"{tables(index_dir)}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def current_version(log: DataFrame, key: str = "path", order: tuple[str, ...] = ("batch_id",), op: str = "op", partition: tuple[str, ...] = ()) -> DataFrame:
    """The last version of each path, without the deleted ones."""
    w = Window.partitionBy(*partition, key).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) & (F.col(op) != "deleted")).drop("_n")


def documents(spark: SparkSession, index_dir: str, model: str) -> DataFrame:
    return current_version(read_table(spark, index_dir, "documents").filter(F.col("model_id") == model))


def chunks(spark: SparkSession, index_dir: str, model: str) -> DataFrame:
    """Chunks of the current versions: those of a path's earlier or deleted versions fall out."""
    live = documents(spark, index_dir, model).select("path", "batch_id")
    return read_table(spark, index_dir, "chunks").filter(F.col("model_id") == model).join(live, ["path", "batch_id"], "left_semi")


def embedded_documents(spark: SparkSession, index_dir: str, model: str) -> DataFrame:
    """doc_id, path, title, text, embedding of the current documents that have a vector."""
    return documents(spark, index_dir, model).filter(F.col("embedding").isNotNull()).select("doc_id", "path", "title", "text", "embedding")


def chunk_rows(spark: SparkSession, index_dir: str, model: str) -> DataFrame:
    """The current chunks, each with its document's row: doc_title, mtime, size and doc_text beside the chunk's own columns."""
    docs = documents(spark, index_dir, model).select("path", "batch_id", F.col("title").alias("doc_title"), "mtime", "size", F.col("text").alias("doc_text"))
    return read_table(spark, index_dir, "chunks").filter(F.col("model_id") == model).join(docs, ["path", "batch_id"])


def point_lookup(docs: DataFrame, path: str | None = None, doc_id: int | None = None) -> DataFrame:
    return docs.filter(F.col("path") == path if path is not None else F.col("doc_id") == doc_id)


def diff_corpus(current: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(path, status): created, updated, skipped or deleted, by the content's digest alone."""
    both = current.select("path", F.col("sha256").alias("_new")).join(stored.select("path", F.col("sha256").alias("_old")), "path", "full_outer")
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when((F.col("_new") == F.col("_old")) & ~F.lit(force), "skipped").otherwise("updated")
    return both.select("path", status.alias("status"))


def deleted_paths(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.select("path").join(current.select("path"), "path", "left_anti")


def run_summary(status: DataFrame) -> DataFrame:
    """One row: total (of files that are there), created, updated, skipped, deleted."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return status.agg(F.count_if(F.col("status") != "deleted").alias("total"), n("created"), n("updated"), n("skipped"), n("deleted"))


def write_batch(spark: SparkSession, index_dir: str, model: str, batch_id: int, changed: DataFrame, gone: DataFrame, encoder: Encoder, chunk_size: int = 600, overlap: int = 80, enrich=None) -> None:
    """Append one batch: new versions of ``changed`` (path, text, mtime, size, sha256, title) with their chunks, and tombstones
    for ``gone`` (path). Only what changed is chunked and encoded. Writing a batch again replaces it."""
    tagged = lambda t: t.withColumn("model_id", F.lit(model)).withColumn("batch_id", F.lit(batch_id).cast("long"))
    docs = changed.withColumn("doc_id", F.xxhash64("path"))
    pieces = chunk_documents(docs.select("doc_id", "path", "title", "text", "sha256"), chunk_size, overlap, enrich=enrich)
    docs, pieces = embed_index(docs, pieces.withColumn("chunk_id", F.xxhash64("path", "chunk_index")), encoder)
    null = {c: F.lit(None) for c in ("title", "mtime", "size", "sha256", "text", "embedding")}
    rows = docs.withColumn("op", F.lit("upsert")).unionByName(gone.select("path").withColumn("doc_id", F.xxhash64("path")).withColumn("op", F.lit("deleted")).withColumns(null), allowMissingColumns=True)
    # documents last: they make the batch visible, and what is cached from their table is then read anew
    for table, name, schema in ((pieces, "chunks", CHUNK_LOG), (rows, "documents", LOG)):
        fields = [x.strip().split(" ") for x in schema.split(", ")]
        out = tagged(table).select(*(F.col(c).cast(kind).alias(c) for c, kind in fields))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id", "batch_id").parquet(f"{tables(index_dir)}/{name}")


def next_batch(spark: SparkSession, index_dir: str) -> int:
    return (read_table(spark, index_dir, "documents").agg(F.max("batch_id")).first()[0] or 0) + 1


def update_index(scanned: DataFrame, index_dir: str, model: str, encoder: Encoder, chunk_size: int = 600, overlap: int = 80, force: bool = False, batch_id: int | None = None, enrich=None) -> DataFrame:
    """Bring a model's index to a scanned corpus and return the run's summary. A forced run, or one whose encoder has
    another width than the stored vectors, encodes everything again."""
    spark = scanned.sparkSession
    stored = documents(spark, index_dir, model)
    width = read_table(spark, index_dir, "chunks").filter(F.col("model_id") == model).agg(F.max_by("embedding_dim", "batch_id")).first()[0]
    status = diff_corpus(scanned, stored, force or (width is not None and width != encoder.dim))
    status = status.persist()
    summary = run_summary(status)
    row = summary.first()
    work = scanned.join(status.filter("status IN ('created', 'updated')"), "path", "left_semi")
    gone = status.filter("status = 'deleted'").select("path")
    if row["created"] or row["updated"] or row["deleted"]:
        write_batch(spark, index_dir, model, batch_id or next_batch(spark, index_dir), work, gone, encoder, chunk_size, overlap, enrich)
    status.unpersist()
    return spark.createDataFrame([row], summary.schema)


def index_totals(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("document_count")).crossJoin(pieces.agg(F.count("*").alias("chunk_count")))


def model_stats(pieces: DataFrame, doc: str = "path", vector: str = "embedding") -> DataFrame:
    """(model_id, document_count, chunk_count, dim, vector_bytes): four bytes for each component."""
    return pieces.groupBy("model_id").agg(F.count_distinct(doc).alias("document_count"), F.count("*").alias("chunk_count"), F.max(F.size(vector)).alias("dim"), F.sum(F.size(vector) * 4).cast("long").alias("vector_bytes"))


def statistics(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """``model_stats`` with documents counted from their own table (model_id, path), so that those without chunks count too."""
    count = docs.groupBy("model_id").agg(F.count("*").alias("document_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return count.join(model_stats(pieces).drop("document_count"), "model_id", "full_outer").select("model_id", zero("document_count"), zero("chunk_count"), "dim", zero("vector_bytes"))


def reset(spark: SparkSession, index_dir: str, model: str) -> int:
    """Empty one model's index by a batch of tombstones, and return how many documents it held. Other models stay as they are; the
    model's next run encodes everything again."""
    held = documents(spark, index_dir, model).select("path").persist()
    n = held.count()
    if n:
        nothing = read_table(spark, index_dir, "documents").filter("false").select("path", "title", "text", "mtime", "size", "sha256")
        write_batch(spark, index_dir, model, next_batch(spark, index_dir), nothing, held, HashEncoder(1))
    held.unpersist()
    return n


def compact(spark: SparkSession, index_dir: str) -> None:
    """Keep what is current and remove all other files: earlier versions, deleted paths, models that were reset.

    The rows of every model are written as its last batch into a new generation; naming that generation is one small file that is
    moved into place, and makes documents and chunks visible together. The old generation is deleted after that. A run that fails
    before changes nothing; one that fails after leaves files that the next one removes. Not to be run beside a writer.
    """
    log = read_table(spark, index_dir, "documents")
    last = log.groupBy("model_id").agg(F.max("batch_id").alias("last"))
    docs = current_version(log, partition=("model_id",))
    pieces = read_table(spark, index_dir, "chunks").join(docs.select("model_id", "path", "batch_id"), ["model_id", "path", "batch_id"], "left_semi")
    old, new = generation(index_dir), f"generation-{uuid.uuid4().hex}"
    for table, name, schema in ((pieces, "chunks", CHUNK_LOG), (docs, "documents", LOG)):
        whole = table.drop("batch_id").join(last, "model_id").withColumnRenamed("last", "batch_id").select(*(x.strip().split(" ")[0] for x in schema.split(", ")))
        whole.write.partitionBy("model_id", "batch_id").parquet(f"{index_dir.rstrip('/')}/{new}/{name}")
    system, inner = fs.FileSystem.from_uri(index_dir)
    inner = inner.rstrip("/")
    with system.open_output_stream(f"{inner}/{CURRENT}.{new}") as file:
        file.write(new.encode())
    system.move(f"{inner}/{CURRENT}.{new}", f"{inner}/{CURRENT}")
    for info in system.get_file_info(fs.FileSelector(inner)):
        dead = info.base_name in ("documents", "chunks") if not old else False
        if info.type == fs.FileType.Directory and (dead or info.base_name.startswith("generation-") and info.base_name != new):
            system.delete_dir(info.path)


def prepared(changes: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Documents of changed files: title, size and digest from the content."""
    text = F.coalesce(F.col(content), F.lit(""))
    return changes.select(F.col(path).alias("path"), title_of(text, stem_of(F.col(path))).alias("title"), "mtime", F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"), text.alias("text"))


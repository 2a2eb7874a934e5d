"""A stored inverted index with block maxima, and exact ranked retrieval that passes over blocks.

Documents are dealt into blocks of ``BLOCK`` as they lie in the scan. A row of the index is one term in one block: the
documents that have it with their counts and lengths, and, for a bound, the shortest length of each count. A query first
adds up the bounds of its terms by block; the blocks with the largest sums are scored and give the score that a document
must reach; only blocks whose bound reaches it are scored after that. A frequent term is as many rows as there are blocks, dealt by
(term, block), so no task holds the whole list of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.storage import written

K1, B = 1.2, 0.75
#: Documents of a block, and documents and bytes of words that are put in order before they are cut into blocks.
BLOCK = 32
REORDERED, REORDERED_BYTES = 1 << 14, 64 << 20
#: Blocks of each query that are scored before the bound is known, besides those that ``limit`` documents need.
AHEAD = 3
#: Distinct terms of all queries that are broadcast at most; more are joined by shuffle.
BROADCAST_TERMS = 1 << 17
#: Scores are rounded to six digits, so bounds give way by as much.
SLACK = 2e-6


def alike(table: pa.Table) -> np.ndarray:
    """An order of documents (words, length) that puts like beside like, which makes the bounds of a block tight: by the word that is
    most frequent in a document, then by length."""
    words = table.column("words").combine_chunks()
    coded = words.flatten().dictionary_encode()
    sizes = np.asarray(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    spread = len(coded.dictionary) + 1
    keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * spread + coded.indices.to_numpy(), return_counts=True)
    owner = keys // spread
    best = np.lexsort((keys % spread, -counts, owner))
    first = best[np.flatnonzero(np.diff(owner[best], prepend=-1))]
    most = np.full(len(sizes), -1, np.int64)
    most[owner[first]] = keys[first] % spread
    return np.lexsort((sizes, most))


def _postings(kind: pa.DataType, size: int):
    schema = pa.schema([
        ("term", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("levels", pa.list_(pa.int32())), ("shortest", pa.list_(pa.int32())),
        ("docs", pa.list_(kind)), ("counts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("total", pa.int64()), ("measured", pa.int32()),
    ])

    def lists(values, offsets) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    def rows(block: int, docs: pa.Array, words: pa.ListArray, lengths: pa.Array) -> pa.RecordBatch:
        """The terms of a block, and a row without a term that measures its documents."""
        sizes = np.asarray(lengths.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        coded = words.flatten().dictionary_encode()
        owner = np.repeat(np.arange(len(docs)), np.asarray(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64))
        # a posting for each term and document, in this order
        keys, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * len(docs) + owner, return_counts=True)
        term, at = keys // len(docs), keys % len(docs)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        # the shortest document of each term and count
        order = np.lexsort((sizes[at], counts, term))
        level = np.flatnonzero(np.diff(term[order], prepend=-1) | np.diff(counts[order], prepend=-1))
        bounds = np.append(np.searchsorted(term[order][level], term[starts]), len(level))
        ends = np.append(starts, len(keys))
        n = len(starts) + 1
        empty = lambda values, offsets: lists(values, np.append(offsets, offsets[-1]))  # noqa: E731  the last row holds none
        taken = docs.take(pa.array(at))
        arrays = [
            pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]), pa.array(np.full(n, block)), pa.array(np.append(np.diff(ends), len(docs)), pa.int32()),
            empty(pa.array(counts[order][level], pa.int32()), bounds), empty(pa.array(sizes[at][order][level], pa.int32()), bounds),
            empty(taken, ends), empty(pa.array(counts, pa.int32()), ends), empty(pa.array(sizes[at], pa.int32()), ends),
            pa.array([0] * (n - 1) + [int(sizes.sum())], pa.int64()), pa.array([0] * (n - 1) + [len(docs) - lengths.null_count], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, held, n = 0, TaskContext.get().partitionId(), [], 0
        for batch in (*batches, None):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if not n or batch is not None and n < REORDERED and sum(b.nbytes for b in held) < REORDERED_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
            for rest in table.take(pa.array(alike(table))).combine_chunks().to_batches(max_chunksize=size):
                yield rows(part << 32 | number, *(rest.column(c) for c in ("doc", "words", "length")))
                number += 1

    return partition


def build(documents: DataFrame, doc: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """The index of ``documents``, one row for each term of a block and one without a term that counts the block's documents; no
    shuffle. A document without words has no posting but counts. Documents may repeat; each row is one of its own."""
    words = documents.select(F.col(doc).alias("doc"), T.tokens(F.col(text)).alias("words")).withColumn("length", F.size("words"))
    kind = documents.schema[doc].dataType
    schema = (
        f"term string, block long, n int, levels array<int>, shortest array<int>, docs array<{kind.simpleString()}>, counts array<int>, lengths array<int>, "
        "total long, measured int"
    )
    from pyspark.sql.pandas.types import to_arrow_type

    return words.mapInArrow(_postings(to_arrow_type(kind), size), schema)


def store(index: DataFrame, path: str) -> None:
    """Written in the order of terms within each file, so that a search reads the row groups of its terms alone."""
    index.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def share(count: Column, length: Column, mean: Column) -> Column:
    """What a term adds to a document's score, before its weight. Grows with the count, falls with the length."""
    return count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))


class Search:
    """A set of queries against an index: ``bounds`` (key, block, bound), ``least`` (key, least: the score to reach) and
    ``visited`` (key, block), all stored, and ``hits``."""

    def __init__(self, queries: DataFrame, index: DataFrame, limit: int, query: str = "query", key: str = "query_id", doc: str = "doc_id"):
        terms = queries.select(key, F.explode(F.array_distinct(T.tokens(F.col(query)))).alias("term"))
        wanted = terms.select("term").distinct()
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
        self.key, self.doc, self.limit = key, doc, limit
        self.postings = index.join(wanted, "term", "left_semi")
        corpus = index.filter("term IS NULL").agg(F.sum("n").alias("n_docs"), (F.sum("total") / F.sum("measured")).alias("mean"))
        df = self.postings.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(corpus))
        idf = df.select("term", "mean", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        self.terms = written(terms.join(idf, "term"), "keyword-terms")
        heads = self.postings.select("term", "block", "levels", "shortest").join(F.broadcast(corpus.select("mean")))
        best = F.array_max(F.zip_with("levels", "shortest", lambda c, n: share(c, n, F.col("mean"))))
        heads = heads.select("term", "block", best.alias("best"))
        self.bounds = written(heads.join(self.terms.select(key, "term", "idf"), "term").groupBy(key, "block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound")), "keyword-bounds")
        first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("bound"), "block"))
        ahead = self.bounds.withColumn("_n", first).filter(F.col("_n") <= -(-limit // BLOCK) + AHEAD).select(key, "block")
        reached = self._ranked(ahead).groupBy(key).agg(F.count("*").alias("_n"), F.min("score").alias("least"))
        self.least = written(reached.filter(F.col("_n") >= limit).select(key, "least"), "keyword-least")
        open_ = F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))
        self.visited = written(self.bounds.join(self.least, key, "left").filter(open_).select(key, "block"), "keyword-visited")

    def _ranked(self, blocks: DataFrame) -> DataFrame:
        """The best documents of (key, block), scored in full."""
        rows = blocks.join(self.terms, self.key).join(self.postings.select("term", "block", "docs", "counts", "lengths"), ["term", "block"])
        each = rows.select(self.key, "idf", "mean", F.explode(F.arrays_zip("docs", "counts", "lengths")).alias("p"))
        added = F.col("idf") * share(F.col("p.counts"), F.col("p.lengths"), F.col("mean"))
        scored = each.groupBy(self.key, F.col("p.docs").alias(self.doc)).agg(F.round(F.sum(added), 6).alias("score"))
        order = Window.partitionBy(self.key).orderBy(F.desc("score"), self.doc)
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.limit)

    def hits(self) -> DataFrame:
        """(key, doc, score, rank): the same rows as scoring every document. Equal scores: the smaller document first."""
        return self._ranked(self.visited).select(self.key, self.doc, "score", "rank")

    def passed_over(self) -> DataFrame:
        """(key, blocks, visited): how many blocks have a term of the query, and how many of them were scored in the end."""
        return self.bounds.groupBy(self.key).agg(F.count("*").alias("blocks")).join(self.visited.groupBy(self.key).agg(F.count("*").alias("visited")), self.key, "left").fillna(0, ["visited"])

"""Ranked keyword retrieval for a table of queries in one reading of the documents, without an index.

Of each document only the queries' own words are kept, as numbers with their counts; that table is stored, a small part of the
texts. Each task that wrote it adds a row of sums, from which the weights of the words follow. Then documents are scored against all queries
in tasks that keep the best rows of each query, so that no more than ``limit`` rows for each task and query are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.functions import text as T
from folioflow.operators.inverted import B, K1
from folioflow.storage import scratch

#: Queries and words of queries that a task holds at most; larger sets need an index.
QUERIES, ENTRIES = 8192, 1 << 20
#: Scores, and words of documents times their queries, that a task works out at once.
AT_ONCE = 1 << 20


def _read(path: str) -> pa.Table:
    system, inner = fs.FileSystem.from_uri(path)
    return ds.dataset(inner, filesystem=system, format="parquet").to_table()


def _kept(path: str, kind: pa.DataType):
    """Documents by the numbers of the words at ``path`` (term, number) and their counts; a last row has the number of documents (n), of
    their words (total), and how many documents have each word."""
    schema = pa.schema([("doc", kind), ("length", pa.int32()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("n", pa.int64()), ("total", pa.int64())])
    lists = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _read(path)
        known, number = wanted.column("term").combine_chunks(), wanted.column("number").to_numpy()
        held = np.zeros(len(known), np.int64)
        n = total = 0
        for batch in batches:
            words = batch.column("words")
            sizes = words.value_lengths().to_numpy()
            n, total = n + len(sizes), total + int(sizes.sum())
            place = pc.index_in(words.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)[place >= 0]
            pairs, counts = np.unique(owner * max(1, len(known)) + number[place[place >= 0]], return_counts=True)
            owner, terms = pairs // max(1, len(known)), pairs % max(1, len(known))
            held += np.bincount(terms, minlength=len(held))
            own, starts = np.unique(owner, return_index=True)
            if len(own):
                ends = np.append(starts, len(pairs))
                null = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(own)), pa.array(sizes[own], pa.int32()), lists(terms, ends), lists(counts, ends), null, null], schema=schema)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int32()), lists(some, [0, len(some)]), lists(held[some], [0, len(some)]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], schema=schema)

    return partition


class _Best:
    """The best ``k`` documents of each query among those met so far, which come in order; of equal scores the earlier one is better."""

    def __init__(self, queries: int, k: int, kind: pa.DataType):
        self.k, self.met = k, 0
        self.least = np.full(queries, -np.inf)
        self.query, self.score, self.place = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.docs = pa.nulls(0, kind)

    def meet(self, docs: pa.Array, sums: np.ndarray) -> None:
        """``sums``: a row for each document and a column for each query, zero where they have no word in common."""
        scores = np.round(sums, 6)
        row, query = np.nonzero((sums > 0) & (scores > self.least))
        if len(row):
            query, score, place = np.concatenate([self.query, query]), np.concatenate([self.score, scores[row, query]]), np.concatenate([self.place, self.met + row])
            order = np.lexsort((place, -score, query))
            first = np.searchsorted(query[order], query[order])
            order = order[np.arange(len(order)) - first < self.k]
            self.docs = pa.concat_arrays([self.docs, docs.take(pa.array(row))]).take(pa.array(order))
            self.query, self.score, self.place = query[order], score[order], place[order]
            last = np.flatnonzero(np.arange(len(order)) - np.searchsorted(self.query, self.query) == self.k - 1)
            self.least[self.query[last]] = self.score[last]
        self.met += len(docs)


def _scored(path: str, limit: int, key: pa.DataType, doc: pa.DataType):
    """The best documents of each query by the weights at ``path`` (key, number, idf, mean). Documents come in order; equal ones are one."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _read(path)
        if not len(weights):
            return
        coded = weights.column("key").combine_chunks().dictionary_encode()
        number = weights.column("number").to_numpy()
        order = np.argsort(number, kind="stable")
        query, idf, number, mean = coded.indices.to_numpy()[order], weights.column("idf").to_numpy()[order], number[order], weights.column("mean")[0].as_py()
        starts = np.searchsorted(number, np.arange(number[-1] + 2))
        n = len(coded.dictionary)
        best = _Best(n, limit, doc)
        last: tuple[pa.Array, np.ndarray] | None = None  # the last document, which may go on in the next rows

        def sums(part: pa.RecordBatch) -> np.ndarray:
            sizes = part.column("terms").value_lengths().to_numpy()
            terms, counts = part.column("terms").flatten().to_numpy(), part.column("counts").flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            length = part.column("length").to_numpy()[row]
            share = counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / mean))
            # each word of a document meets the queries that have it
            each = starts[terms + 1] - starts[terms]
            cuts = np.searchsorted(np.cumsum(each), np.arange(AT_ONCE, each.sum() + 1, AT_ONCE))
            out = np.zeros(len(sizes) * n)
            for some in np.split(np.arange(len(terms)), cuts):
                own = each[some]
                at = np.repeat(starts[terms[some]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                out += np.bincount(np.repeat(row[some], own) * n + query[at], np.repeat(share[some], own) * idf[at], len(out))
            return out.reshape(-1, n)

        for batch in batches:
            for begin in range(0, len(batch), max(1, AT_ONCE // n)):
                part = batch.slice(begin, max(1, AT_ONCE // n))
                docs, found = part.column("doc"), sums(part)
                if last is not None:
                    docs, found = pa.concat_arrays([last[0], docs]), np.concatenate([last[1], found])
                same = docs.dictionary_encode(null_encoding="encode").indices.to_numpy()
                first = np.flatnonzero(np.diff(same, prepend=-1))
                docs, found = docs.take(pa.array(first)), np.add.reduceat(found, first)
                best.meet(docs[:-1], found[:-1])
                last = docs[-1:], found[-1:]
        if last is not None:
            best.meet(*last)
        if len(best.query):
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(best.query)), best.docs, pa.array(best.score)], names=["key", "doc", "score"])

    return partition


def search(terms: DataFrame, documents: DataFrame, limit: int, key: str, doc: str, text: str) -> DataFrame:
    """(key, doc, score, rank) for the words of queries, ``terms`` (key, term): ``limit`` documents each by BM25. Ties go to the smaller
    document id; rows of one id add up."""
    spark = documents.sparkSession
    kind, key_kind = documents.schema[doc].dataType, terms.schema[key].dataType
    words, kept, weights = (scratch(spark, f"keyword-{x}") for x in ("words", "kept", "weights"))
    numbers = terms.select("term").distinct().select("term", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1).alias("number"))
    numbers.coalesce(1).write.parquet(words)
    named = spark.read.schema("term string, number int").parquet(words)
    schema = f"doc {kind.simpleString()}, length int, terms array<int>, counts array<int>, n long, total long"
    tokens = documents.select(F.col(doc).alias("doc"), T.tokens(F.col(text)).alias("words"))
    tokens.mapInArrow(_kept(words, to_arrow_type(kind)), schema).write.option("compression", "zstd").parquet(kept)
    rows = spark.read.schema(schema).parquet(kept)
    told = rows.filter("n IS NOT NULL")
    corpus = told.agg(F.sum("n").alias("n_docs"), (F.sum("total") / F.sum("n")).alias("mean"))
    df = told.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("number")).agg(F.sum("x.counts").alias("df"))
    idf = df.crossJoin(F.broadcast(corpus)).select("number", "mean", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = terms.filter(F.col(key).isNotNull()).join(F.broadcast(named), "term").join(F.broadcast(idf), "number")
    weighted.groupBy(F.col(key).alias("key"), "number").agg(F.sum("idf").alias("idf"), F.first("mean").alias("mean")).coalesce(1).write.parquet(weights)
    dealt = rows.filter("n IS NULL").select("doc", "length", "terms", "counts").repartition("doc").sortWithinPartitions("doc")
    best = dealt.mapInArrow(_scored(weights, limit, to_arrow_type(key_kind), to_arrow_type(kind)), f"key {key_kind.simpleString()}, doc {kind.simpleString()}, score double")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "doc")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(F.col("key").alias(key), F.col("doc").alias(doc), "score", "rank")

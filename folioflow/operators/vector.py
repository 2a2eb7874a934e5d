"""Exact nearest neighbours for tables of queries.

Vectors of both sides are packed into blocks; every block of queries meets every block of the corpus once. Within a block of
the corpus vectors that are alike lie side by side, in leaves, each with a centre and a radius: no vector of a leaf has a
larger product with a query than its centre has, plus radius times the query's length. A query first meets the leaf of the
largest bound, then only leaves whose bound reaches its k-th best score so far. A task keeps the best k rows of each
query over all the blocks it sees, so that no more than k rows for each task and query are shuffled. A window then takes
the best k. Leaves are made inside a task, so the corpus is not shuffled, and a value that many vectors share is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block; vectors of the corpus in one, if they take no more than so many bytes; vectors in a leaf.
BLOCK, ROWS, BLOCK_BYTES, LEAF = 1024, 4096, 8 << 20, 64
#: Queries that are broadcast at most; more are dealt out with the corpus.
BROADCAST_QUERIES = 8192
#: Blocks of queries whose best rows a task holds at once; those of the one seen longest ago are sent before another is held.
HELD_BLOCKS = 16
#: What a bound is raised by: scores are rounded to six digits, and products are not exact.
SLACK, RELATIVE_SLACK = 1e-6, 1e-9


def alike(v: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of ``v`` and the sizes of the leaves, at most ``leaf`` rows each, that follow each other in it. A larger
    part is split between two of its rows that lie far apart, with at least a sixteenth on each side."""
    out, todo = [], [np.arange(len(v))] if len(v) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        some = v[rows]
        far = lambda x: some[np.square(some - x).sum(1).argmax()]
        one = far(some.mean(0))
        other = far(one)
        along = some @ (other - one)
        near = int((along < (one + other) @ (other - one) / 2).sum())
        cut = min(max(near, len(rows) // 16, 1), len(rows) - max(1, len(rows) // 16))
        by = np.argpartition(along, cut - 1)
        todo += [rows[by[cut:]], rows[by[:cut]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.array([len(x) for x in out], np.int64)


def _blocks(rows: DataFrame, key: str, vector: str, name: str, n: int, leaf: int = 0) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), n):
                some = batch.iloc[at : at + n]
                v = np.stack(some["v"].to_numpy()).astype(np.float64)
                use = np.flatnonzero(np.isfinite(v).all(1))
                order, sizes = alike(v[use], leaf) if leaf else (np.arange(len(use)), np.zeros(0, np.int64))
                use = use[order]
                if len(use):
                    yield pd.DataFrame({f"{name}_ids": [some["id"].to_numpy(np.int64)[use].tobytes()], f"{name}_v": [v[use].tobytes()], f"{name}_n": [sizes.tobytes()]})

    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(pack, f"{name}_ids binary, {name}_v binary, {name}_n binary")


class Best:
    """The best ``k`` rows of each query of a block, over the blocks of the corpus it has met; a place not taken has score -inf."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.length = np.sqrt(np.square(q).sum(1))
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(q), k), -np.inf)
        self.seen = self.pairs = 0

    def _take(self, use: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        self.seen += len(use)
        scores = np.round(self.q[use] @ v.T, 6) + 0.0
        hit, at = np.nonzero(scores >= self.scores[use, -1:])
        if not len(hit):
            return
        own, row = np.unique(hit, return_inverse=True)
        some = use[own]
        row = np.concatenate([np.repeat(np.arange(len(own)), self.k), row])
        ids = np.concatenate([self.ids[some].ravel(), ids[at]])
        scores = np.concatenate([self.scores[some].ravel(), scores[hit, at]])
        order = np.lexsort((ids, -scores, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.ids[some], self.scores[some] = ids[order].reshape(-1, self.k), scores[order].reshape(-1, self.k)

    def meet(self, ids: np.ndarray, v: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of the corpus, in leaves of ``sizes``."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        centre = np.add.reduceat(v, starts) / sizes[:, None]
        radius = np.sqrt(np.maximum.reduceat(np.square(v - np.repeat(centre, sizes, 0)).sum(1), starts))
        reach = np.sqrt(np.square(centre).sum(1)) + radius
        bound = self.q @ centre.T + self.length[:, None] * (radius + RELATIVE_SLACK * reach) + SLACK
        self.pairs += bound.size
        first = bound.argmax(1)
        for only_first in (True, False):
            for i, (at, end) in enumerate(zip(starts, ends)):
                use = np.flatnonzero((first == i) == only_first)
                use = use[bound[use, i] >= self.scores[use, -1]]
                if len(use):
                    self._take(use, ids[at:end], v[at:end])


def _found(queries: DataFrame, corpus: DataFrame, k: int | None, dim: int | None, query_key: str, corpus_key: str, vector: str) -> DataFrame:
    """(q, c, score) of each task's best rows, and a row (seen, pairs) of each block of queries it had: leaves that queries met, of all."""
    k = 20 if k is None else k
    if dim is None:
        first = queries.filter(F.col(vector).isNotNull()).select(F.size(vector)).first()
        dim = first[0] if first else 0
    good = lambda t: t.filter(F.col(vector).isNotNull() & (F.size(vector) == dim))
    queries = good(queries)
    q = _blocks(queries, query_key, vector, "q", BLOCK)
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        q = F.broadcast(q)
    rows = max(LEAF, min(ROWS, BLOCK_BYTES // (8 * max(1, dim))))
    pairs = _blocks(good(corpus), corpus_key, vector, "c", rows, LEAF).crossJoin(q)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, Best] = {}  # by block of queries

        def rows(q_ids: bytes) -> pd.DataFrame:
            b = held.pop(q_ids)
            row, place = np.nonzero(b.scores > -np.inf)
            out = pd.DataFrame({"q": np.frombuffer(q_ids, np.int64)[row], "c": b.ids[row, place], "score": b.scores[row, place]}).astype({"q": "Int64", "c": "Int64"})
            counts = pd.DataFrame({"seen": [b.seen], "pairs": [b.pairs]}, dtype="Int64")
            return pd.concat([out, counts])[["q", "c", "score", "seen", "pairs"]]

        for batch in batches:
            for r in batch.itertuples():
                if r.q_ids not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield rows(next(iter(held)))
                    held[r.q_ids] = Best(np.frombuffer(r.q_v).reshape(len(r.q_ids) // 8, -1), k)
                else:
                    held[r.q_ids] = held.pop(r.q_ids)
                ids = np.frombuffer(r.c_ids, np.int64)
                held[r.q_ids].meet(ids, np.frombuffer(r.c_v).reshape(len(ids), -1), np.frombuffer(r.c_n, np.int64))
        for q_ids in list(held):
            yield rows(q_ids)

    return pairs.mapInPandas(best, "q long, c long, score double, seen long, pairs long")


def topk(queries: DataFrame, corpus: DataFrame, k: int | None = None, dim: int | None = None, query_key: str = "query_id", corpus_key: str = "vec_id", vector: str = "embedding", min_score: float | None = None) -> DataFrame:
    """(query_key, corpus_key, score, rank): the ``k`` corpus rows with the largest inner product of each query.

    Scores have six digits; ties go to the smaller id. Rows without a vector, with another width than ``dim`` (by default
    the queries'), or with an entry that is null or not finite, are passed over; an empty side gives no rows.
    """
    found = _found(queries, corpus, k, dim, query_key, corpus_key, vector).filter("pairs IS NULL")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("rank") <= (20 if k is None else k))
    if min_score is not None and min_score > 0:
        ranked = ranked.filter(F.col("score") >= min_score)
    return ranked.select(F.col("q").alias(query_key), F.col("c").alias(corpus_key), "score", "rank")


def visits(queries: DataFrame, corpus: DataFrame, k: int | None = None, dim: int | None = None, query_key: str = "query_id", corpus_key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row (seen, pairs): how many leaves the queries of ``topk`` multiply with, and how many they would without bounds."""
    found = _found(queries, corpus, k, dim, query_key, corpus_key, vector)
    return found.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def neighbours(chunks: DataFrame, doc: str = "path", index: str = "chunk_index", *columns: str) -> DataFrame:
    """``chunks`` with ``prev`` and ``next``, the rows beside each in its document, as structs."""
    w = Window.partitionBy(doc).orderBy(index)
    row = F.struct(F.col(index), *columns)
    return chunks.withColumn("prev", F.lag(row).over(w)).withColumn("next", F.lead(row).over(w))

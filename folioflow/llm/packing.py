"""Packing documents into fixed windows by non-negative least squares.

Documents are tokenised once and their ids written. Whole windows are cut off long documents; the
lengths of what remains form a histogram of at most ``window`` counts, over all documents. Every
combination of up to three lengths that fills a window is a strategy, and least squares with
non-negative repeat counts says how often each should be used. Blocks of documents use each strategy
for their share of its count, rounded, as far as their own remainders allow, and pack the residual greedily: end to
end, cut at the window; the end of the last window is cut into powers of two, so that nothing needs padding.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import small_batches, written
from folioflow.llm.words import mix

#: Ids a block holds in memory at once, at least.
BLOCK_IDS = 1 << 22
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(2)
def _encoder(path: str | None):
    """One per worker process. text -> ids of a ``tokenizers`` file. The ranks beside it, where present, give the same ids
    about three times as fast; texts that hold a special token's string take the slow way."""
    import base64
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    plain = lambda x: slow.encode(x, add_special_tokens=False).ids
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return plain, slow.get_vocab_size()
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return (lambda x: plain(x) if any(s in x for s in special) else fast.encode_ordinary(x)), slow.get_vocab_size()


def tokenised(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, n (ids with ``end_id``), ids (uint16 or uint32, little-endian); null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, size = _encoder(path)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                ids = [np.array([*encode(x or ""), end_id], kind) for x in some["text"]]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "n": [len(x) for x in ids], "wide": kind == "<u4", "ids": [x.tobytes() for x in ids]})

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, n long, wide boolean, ids binary")


def strategies(histogram: np.ndarray, window: int, rounds: int = 400) -> list[tuple[tuple[int, ...], float]]:
    """Length combinations that fill a window, with the least-squares repeat counts over 0.5, most
    frequent first. ``histogram[n]``: how many remainders have n ids, 0 < n < window."""
    have = np.flatnonzero(histogram)
    if not len(have):
        return []
    present = np.zeros(window + 1, bool)
    present[have] = True
    a, b = np.meshgrid(have, have, indexing="ij")
    c = window - a - b
    two = (a <= b) & (c == 0)
    three = (a <= b) & (b <= c) & present[np.clip(c, 0, window)]
    sets = np.concatenate([np.stack([a[two], b[two], 0 * a[two]], 1), np.stack([a[three], b[three], c[three]], 1)])
    if not len(sets):
        return []
    h = histogram.astype(float)
    h[0] = 0
    times = lambda x: np.bincount(sets.ravel(), np.repeat(x, 3), minlength=window + 1) * (np.arange(window + 1) > 0)
    back = lambda r: np.where(sets > 0, r[sets], 0.0).sum(1)
    v = np.ones(len(sets))
    for _ in range(20):
        v = back(times(v))
        v /= (norm := np.linalg.norm(v))
    x = np.zeros(len(sets))
    y, t = x, 1.0
    for _ in range(rounds):  # accelerated projected gradient
        new = np.maximum(0.0, y - back(times(y) - h) / (1.01 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    order = [i for i in np.argsort(-x, kind="stable") if x[i] > 0.5]
    return [(tuple(int(n) for n in sets[i] if n), float(x[i])) for i in order]


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def rounded(times: np.ndarray, share: float, key: int) -> np.ndarray:
    """Each block's part of the repeat counts as whole numbers: down or up by a hash of block and strategy, so that over all blocks
    the parts add up to the counts."""
    h = mix(np.arange(len(times), dtype=np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15))
    return (times * share + (h >> np.uint64(11)).astype(float) / (1 << 53)).astype(np.int64)


def _block(lengths: np.ndarray, plan: list[tuple[tuple[int, ...], float]], share: float, window: int, key: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; documents by index, sequences from 0."""
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    rest: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        for k in range(n // window):
            out.append((i, k * window, window, seq, 0))
            seq += 1
        if n % window:
            rest.setdefault(n % window, []).append(i)
    start = lambda i: int(lengths[i]) // window * window
    for (combo, _), planned in zip(plan, rounded(np.array([x for _, x in plan]), share, key).tolist()):
        room = min(len(rest.get(n, ())) // combo.count(n) for n in set(combo)) if planned else 0
        for _ in range(min(room, planned)):
            offset = 0
            for n in combo:
                out.append((i := rest[n].pop(), start(i), n, seq, offset))
                offset += n
            seq += 1
    left = [(i, start(i), n) for n in sorted(rest, reverse=True) for i in rest[n]]
    total = sum(x[2] for x in left)
    room = [window] * (total // window) + _powers(total % window)
    at, used = 0, 0
    for i, begin, n in left:
        while n:
            take = min(n, room[at] - used)
            out.append((i, begin, take, seq + at, used))
            begin, n, used = begin + take, n - take, used + take
            if used == room[at]:
                at, used = at + 1, 0
    return out


def pack(docs: DataFrame, window: int = 1024, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (uint32, little-endian), doc_tokens,
    sequence_id, offset. No row of ``docs`` is left out: an empty or null text holds ``end_id`` alone, repeated rows are packed one
    by one, texts of any length whole. Other columns of ``docs`` are not read, so their names do not matter. Sequences are full, or a power of two at a block's end."""
    ids = written(tokenised(docs, id_col, text, path, end_id), "packing-ids")
    counts = ids.groupBy((F.col("n") % window).alias("rest")).agg(F.count("*").alias("k")).collect()  # at most `window` rows
    histogram = np.zeros(window + 1, np.int64)
    for r in counts:
        histogram[r["rest"]] = r["k"]
    histogram[0] = 0
    plan, total = strategies(histogram, window), max(1, int(sum(r["k"] for r in counts)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, block, held = TaskContext.get().partitionId(), 0, []

        def packed() -> Iterator[pd.DataFrame]:
            nonlocal block
            rows = pd.concat(held, ignore_index=True)
            held.clear()
            n = rows["n"].to_numpy()
            pieces = np.array(_block(n, plan, len(n) / total, window, task << 20 | block), np.int64).reshape(-1, 5)
            data, wide, doc = rows["ids"].tolist(), rows["wide"].tolist(), rows["doc_id"]
            base = (task << 40) + (block << 28)
            block += 1
            for at in range(0, len(pieces), 5000):
                i, begin, size, seq, offset = pieces[at : at + 5000].T
                yield pd.DataFrame({
                    "doc_id": doc.iloc[i].array, "start": begin, "length": size,
                    "ids": [np.frombuffer(data[d], "<u4" if wide[d] else "<u2", k, b * (4 if wide[d] else 2)).astype("<u4").tobytes() for d, b, k in zip(i, begin, size)],
                    "doc_tokens": n[i], "sequence_id": base + seq, "offset": offset,
                })

        n_ids = 0
        for batch in batches:
            for at in range(0, len(batch), 1000):
                held.append(some := batch.iloc[at : at + 1000])
                if (n_ids := n_ids + int(some["n"].sum())) >= BLOCK_IDS:
                    yield from packed()
                    n_ids = 0
        if held:
            yield from packed()

    return ids.mapInPandas(run, PIECES)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with the checksum of its ids."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Finding repeated windows of tokens (bytes or words) without shuffling every window.

A window's minimiser is the k-gram in it with the smallest hash, so equal windows have equal
minimisers in the same place. Only minimisers (anchors) are exchanged at first: one entry for each
distinct anchor and document, packed into blobs by range of the hash. An anchor that two documents
(or two places) share makes its windows suspects, and only those are looked at closely. Within a
batch an anchor is sent once however many documents have it, since those are known to share it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import small_batches
from folioflow.llm.words import mix


#: Stands for a null id: after all others.
NULL_ID = (1 << 63) - 1
#: Text bytes handled at once in a task.
CHUNK = 1 << 19
#: Bits of an anchor's hash that are left out: fewer bytes to send, and two anchors that look alike only cost a closer look.
SPARED = np.uint64(16)
#: Anchors, or stretches, that a task remembers to have sent, so that one that is in most chunks goes to its owner about once a task.
REMEMBERED = 1 << 16
#: Window starts looked at together, and the bits that hold a place among them.
SEGMENT = 1 << 17
PLACE = np.uint64((1 << 18) - 1)


def compressed(text: str) -> Column:
    """UTF-8 text, compressed for its way through a shuffle."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            yield pd.Series([c.compress((x or "").encode()) for x in batch], dtype=object)

    return run(F.col(text))


def expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def row_id(id_col: str) -> Column:
    """The id, or NULL_ID."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def numbered(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc (the id, or NULL_ID), th (hash of the text: repeated ids with other texts stay apart), text."""
    return small_batches(docs).select(row_id(id_col).alias("doc"), text_hash(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def chunks(batches: Iterator[pd.DataFrame], column: str, n_bytes: int = CHUNK) -> Iterator[pd.DataFrame]:
    """Rows in chunks of about ``n_bytes``; a longer document makes a chunk of its own."""
    for batch in batches:
        size = np.cumsum([len(x) for x in batch[column]])
        part = size // n_bytes
        for _, some in batch.groupby(part, sort=False):
            yield some


def slices(batches: Iterator[pd.DataFrame], n: int = 512) -> Iterator[pd.DataFrame]:
    """Batches of ``n`` rows at most."""
    for batch in batches:
        for at in range(0, len(batch), n):
            yield batch.iloc[at : at + n]


def minimisers(hashes: np.ndarray, ends: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): places of the anchors, and of the first and last window start each is
    the minimiser of. ``hashes``: of the k-grams at every place of a chunk (garbage across
    documents' ends); ``ends``: for each place, the end of its document."""
    out = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, len(hashes), SEGMENT):
        stop = at + SEGMENT + window - 1
        out.append(tuple(x + at for x in _minimisers(hashes[at:stop], ends[at:stop] - at, k, window)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _minimisers(hashes: np.ndarray, ends: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(hashes)
    width = window - k + 1
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    low = (hashes & ~PLACE) | np.arange(n, dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    low = low[:SEGMENT]
    starts = np.flatnonzero(np.arange(window, len(low) + window) <= ends[: len(low)])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    anchor = (low[starts] & PLACE).astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    return anchor[cut], starts[cut], starts[np.append(cut[1:], len(starts)) - 1]


def buckets_for(docs: DataFrame) -> int:
    """Exchange buckets: as many as shuffle partitions, more where a bucket would hold over 8 MB of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) >> 23)


def narrow(values: np.ndarray) -> bytes:
    """64-bit integers as distances from the smallest one, in as few bytes each as all of them need."""
    base = values.min()
    gaps = (values - base).astype("<u8")
    width = (int(gaps.max()).bit_length() + 7) // 8
    return base.tobytes() + bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + len(values).to_bytes(4, "little")


def widen(blob: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(blob[-4:], "little"), blob[8]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, 9).reshape(n, width)
    return np.frombuffer(blob[:8], kind) + out.view("<u8").ravel().astype(kind)


def bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets of anchors. Their hashes are the smallest of a window each, so they are mixed once more."""
    return ((mix(hashes) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def suspect_anchors(docs: DataFrame, anchors: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], n_buckets: int, within: bool, hot: int = 0) -> DataFrame:
    """Replies for ``with_suspects``: by document, the hashes of its anchors that another document has too, or, with
    ``within``, that occur twice in it. ``anchors`` gives for a chunk the (hash, row) of every anchor. An anchor that is shared in a
    chunk is not sent again by the same task, unless chunks are to be counted: its documents know already, and its owner too.
    Rows with ``hot`` hold no documents but the (hash, count) of anchors that ``hot`` chunks or more have."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = np.zeros(0, np.uint64)  # shared anchors that this task has sent
        for some in chunks(batches, "text"):
            hashes, rows = anchors(some)
            if not len(hashes):
                continue
            ids = some["doc"].to_numpy(np.int64)[rows]
            order = np.lexsort((ids, hashes))
            hashes, ids = hashes[order], ids[order]
            new_hash = np.diff(hashes, prepend=hashes[0] ^ np.uint64(1)) != 0
            new = new_hash | (np.diff(ids, prepend=ids[0]) != 0)
            group = np.cumsum(new_hash) - 1
            shared = np.bincount(group, new) > 1  # in two documents of this chunk
            if within:
                shared |= np.bincount(group) > 1
            first = np.flatnonzero(new_hash)
            old = np.isin(hashes[first], told)
            local = new & (shared | old)[group]
            known = packed(ids[local], np.zeros(local.sum(), np.int64), {"hashes": hashes[local]}, n_buckets)
            yield known.assign(bucket=-1 - known.pop("part"))
            if not hot:
                told = np.concatenate([hashes[first[old]], hashes[first[shared & ~old]], told[~np.isin(told, hashes[first[old]])]])[:REMEMBERED]
            first = first[~old]
            if not len(first):
                continue
            bucket = bucket_of(hashes[first], n_buckets)
            by = np.argsort(bucket, kind="stable")
            bucket, first = bucket[by], first[by]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            ids, hashes = ids[first], hashes[first]
            out = [(bucket[a], narrow(ids[a:b]), None, narrow(hashes[a:b])) for a, b in zip(at, np.append(at[1:], len(first)))]
            yield pd.DataFrame(out, columns=["bucket", "keys", "who", "hashes"])

    def own(key, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return rows[["keys", "who", "hashes"]].assign(part=-1 - key[0], hot=None)
        hashes = np.concatenate([widen(x, np.uint64) for x in rows["hashes"]])
        ids = np.concatenate([widen(x, np.int64) for x in rows["keys"]])
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], ids[order]
        group = np.cumsum(np.diff(hashes, prepend=hashes[0] ^ np.uint64(1)) != 0) - 1
        if within:
            twice = np.bincount(group) > 1
        else:
            least, most = np.full(group[-1] + 1, NULL_ID), np.full(group[-1] + 1, -NULL_ID - 1)
            np.minimum.at(least, group, ids)
            np.maximum.at(most, group, ids)
            twice = least < most
        hit = twice[group]
        out = [packed(ids[hit], np.zeros(hit.sum(), np.int64), {"hashes": hashes[hit]}, n_buckets).assign(hot=None)]
        count = np.bincount(group)
        if hot and count.max() >= hot:
            frequent = np.flatnonzero(count >= hot)
            pairs = np.stack([hashes[np.searchsorted(group, frequent)], count[frequent].astype(np.uint64)], 1)
            out.append(pd.DataFrame({"part": None, "keys": None, "who": None, "hashes": None, "hot": [x.tobytes() for x in pairs]}))
        return pd.concat(out)

    sent = docs.mapInPandas(send, "bucket long, keys binary, who binary, hashes binary")
    return sent.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(own, "part long, keys binary, who binary, hashes binary, hot binary")


def packed(docs: np.ndarray, ths: np.ndarray, columns: dict[str, np.ndarray], n_parts: int) -> pd.DataFrame:
    """One row for each part of the documents (id modulo n_parts) with what belongs to them: keys, the
    distinct (doc, th); who, for each entry its key; and the entries' values."""
    part = docs % n_parts
    order = np.lexsort((ths, docs, part))
    docs, ths, part = docs[order], ths[order], part[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (ths[1:] != ths[:-1])
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(docs))):
        first = a + np.flatnonzero(new[a:b])
        who = (np.cumsum(new[a:b]) - 1).astype("<u4")
        out.append((part[a], np.stack([docs[first], ths[first]], 1).tobytes(), who.tobytes(), *(x[order[a:b]].tobytes() for x in columns.values())))
    return pd.DataFrame(out, columns=["part", "keys", "who", *columns])


def gathered(replies: DataFrame, columns: dict[str, str], n_parts: int) -> DataFrame:
    """(doc, th, columns as binary): one row per document, from the rows of ``packed``. ``columns``: NumPy types."""

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        keys, who, values, n = [], [], {c: [] for c in columns}, 0
        for r in rows.to_dict("records"):
            keys.append(np.frombuffer(r["keys"], np.int64).reshape(-1, 2))
            who.append(np.frombuffer(r["who"], "<u4").astype(np.int64) + n)
            n += len(keys[-1])
            for c, kind in columns.items():
                values[c].append(np.frombuffer(r[c], kind))
        unique, inverse = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
        doc = inverse.reshape(-1)[np.concatenate(who)]
        order = np.argsort(doc, kind="stable")
        edges = np.searchsorted(doc[order], np.arange(len(unique) + 1))
        out = {"doc": unique[:, 0], "th": unique[:, 1]}
        for c in columns:
            x = np.concatenate(values[c])[order]
            out[c] = [x[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        return pd.DataFrame(out)

    return replies.repartition(n_parts, "part").groupBy("part").applyInPandas(gather, "doc long, th long, " + ", ".join(f"{c} binary" for c in columns))


def with_suspects(docs: DataFrame, replies: DataFrame, n_parts: int) -> DataFrame:
    """(doc, th, z, hashes) of the documents that have suspect anchors."""
    suspects = gathered(replies.filter("part IS NOT NULL"), {"hashes": "u8"}, n_parts).drop("th")
    return docs.select("doc", "th", compressed("text").alias("z")).hint("merge").join(suspects, "doc")


def wanted(rows: pd.DataFrame, hashes: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Which anchors (hash, row) of a chunk are among their row's suspect hashes."""
    out = np.zeros(len(hashes), bool)
    edges = np.searchsorted(row_of, np.arange(len(rows) + 1))
    for i, own in enumerate(rows["hashes"]):
        a, b = edges[i], edges[i + 1]
        if b > a:
            out[a:b] = np.isin(hashes[a:b], np.frombuffer(own, np.uint64))
    return out


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Mask over n tokens of those within a window at one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change[:n]) > 0

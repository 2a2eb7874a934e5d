"""Repeated byte strings by a sorted suffix array, spread over range partitions.

Suffixes that start at anchors (see ``repeats``) and are shared by documents are range-partitioned by
their leading bytes at sampled splitters. A bucket sorts its suffixes by multikey quicksort, eight
bytes at a time and only where they still tie, and takes the common prefix lengths of neighbours; the
bytes before an anchor are sorted the same way, from right to left. A window around an anchor occurs
in two documents when both its parts lie in the same runs. Equal leading bytes never lie in two
buckets; the leading bytes that are too frequent for one bucket are split by more context on either
side, so that windows across a boundary are still compared. Every comparison is on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.repeats import NULL_ID, SPARED, buckets_for, chunks, compressed, covered, expand, gathered, minimisers, mix, numbered, packed, slices, suspect_anchors, wanted, with_suspects
from folioflow.llm.shared import written

K = 16
#: Chunks of texts that hold an anchor before its suffixes are split by 17 more bytes. Of such anchors the most frequent ones are
#: told to all tasks, so that any other has at most one in HOT_LISTED of all entries.
HOT_SUFFIXES = 4096
HOT_LISTED = 1 << 16
#: About how many documents, chosen by hash, give the splitters. This bounds balance, not results.
SPLITTER_DOCS = 2000
#: Of a context: its document among those of its sheet, and its place there; how far its anchor is in, and how many windows it has.
NUMBERS = np.dtype([("who", "<u4"), ("place", "<i4"), ("left", "<u2"), ("n", "<u2")])


def _bytes_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with padding behind, offsets, end of its document for each byte)."""
    size = np.array([len(x) for x in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    return np.frombuffer(b"".join(texts) + b"\0" * 64, np.uint8), offsets, np.repeat(offsets[1:], size)


def _anchors(texts, window: int):
    data, offsets, ends = _bytes_of(texts)
    n = len(ends)
    word = np.ndarray((n + 56,), "<u8", data, strides=(1,))
    hashes = mix(word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(word[8 : n + 8]))
    anchor, first, last = minimisers(hashes, ends, K, window)
    row = np.searchsorted(offsets, anchor, "right") - 1
    return data, offsets, hashes[anchor] >> SPARED, row, anchor, first, last


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of big-endian 64-bit words: each word sorts only what still ties."""
    n, width = words.shape
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # of the place in the order
    open_ = np.arange(n)  # places whose group has more than one row
    for j in range(width):
        if not len(open_):
            break
        rows, g = order[open_], group[open_]
        by = np.lexsort((words[rows, j], g))
        order[open_] = rows = rows[by]
        w = words[rows, j]
        new = (np.diff(g, prepend=-1) != 0) | np.concatenate([[True], w[1:] != w[:-1]])
        sub = open_[np.flatnonzero(new)][np.cumsum(new) - 1]  # a group is named by its first place
        group[open_] = sub
        sizes = np.diff(np.append(np.flatnonzero(new), len(new)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
    return order


def _runs(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For byte rows of one width: their order, and the common prefix length with the row before."""
    padded = np.zeros((len(rows), -(-size // 8) * 8), np.uint8)
    padded[:, :size] = rows
    order = multikey_order(np.ascontiguousarray(padded).view(">u8").astype(np.uint64))
    ranked = padded[order]
    differs = np.ones((len(rows), size + 1), bool)
    differs[1:, :size] = ranked[1:, :size] != ranked[:-1, :size]
    common = differs.argmax(1)
    common[0] = 0
    return order, common


def repeated_windows(docs: DataFrame, window: int = 50, hot: int = HOT_SUFFIXES) -> DataFrame:
    """(doc, th, starts, counts): runs of window starts whose bytes also start in a document with a smaller id."""
    spark = docs.sparkSession
    n_buckets = buckets_for(docs)

    def anchors(some: pd.DataFrame):
        _, _, hashes, row, _, _, _ = _anchors([x.encode() for x in some["text"]], window)
        return hashes, row

    suspects = written(suspect_anchors(docs, anchors, n_buckets, within=False, hot=hot), "suffix-suspects")

    def leads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in chunks(batches, "text"):
            data, _, _, _, anchor, _, _ = _anchors([x.encode() for x in some["text"]], window)
            yield pd.DataFrame({"lead": np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))[anchor[::16]].astype(np.uint64).view(np.int64)})

    every = max(1, docs.count() // SPLITTER_DOCS)
    some = docs.filter(F.pmod(F.xxhash64("doc", "th"), F.lit(every)) == 0).select("text").limit(4 * SPLITTER_DOCS)  # a bound where rows repeat
    sample = some.mapInPandas(leads, "lead long").toPandas()["lead"].to_numpy(np.int64).view(np.uint64)
    splitters = np.unique(np.quantile(np.sort(sample), np.arange(1, n_buckets) / n_buckets, method="nearest")) if len(sample) else np.zeros(0, np.uint64)
    told = suspects.filter("hot IS NOT NULL").orderBy(F.desc(F.reverse(F.substring("hot", 9, 8))), "hot").limit(HOT_LISTED).collect()
    hot_hashes = np.sort(np.array([int.from_bytes(r["hot"][:8], "little") for r in told], np.uint64))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            for some in chunks(iter([batch.assign(text=[expand(z) for z in batch["z"]])]), "text"):
                data, offsets, hashes, row, anchor, first, last = _anchors(some["text"].tolist(), window)
                use = wanted(some, hashes, row)
                hashes, row, anchor, first, last = hashes[use], row[use], anchor[use], first[use], last[use]
                lead = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))[anchor].astype(np.uint64)
                bucket = np.searchsorted(splitters, lead, "right")
                is_hot = np.isin(hashes, hot_hashes)
                if is_hot.any():  # windows that start 17 bytes or more before the anchor, and the others
                    far = np.flatnonzero(is_hot & (first <= anchor - 17))
                    near = np.flatnonzero(is_hot & (last > anchor - 17))
                    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
                    spread = lambda i, a: (mix(word[a] ^ mix(word[a + 8]) ^ mix(word[a + 16] + word[a + 25])) % np.uint64(n_buckets)).astype(np.int64)
                    cold = np.flatnonzero(~is_hot)
                    pick = np.concatenate([cold, far, near])
                    bucket = np.concatenate([bucket[cold], spread(far, anchor[far] - 17), spread(near, anchor[near])])
                    first, last = (np.concatenate([x[cold], y, z]) for x, y, z in ((first, first[far], np.maximum(first[near], anchor[near] - 16)), (last, np.minimum(last[far], anchor[far] - 17), last[near])))
                    row, anchor = row[pick], anchor[pick]
                raw = data.tobytes()
                body = [raw[a:b] for a, b in zip(first.tolist(), (last + window).tolist())]
                ids, ths = some["doc"].to_numpy(np.int64)[row], some["th"].to_numpy(np.int64)[row]
                place, left = first - offsets[row], anchor - first
                # of equal contexts only the smallest id's is compared elsewhere; the others repeat it
                out = pd.DataFrame({"bucket": bucket, "row": row, "doc": ids, "th": ths, "place": place, "left": left, "n": last - first + 1, "body": body})
                least = out.groupby(["body", "left"], sort=False)["doc"].transform("min")
                known = out["doc"].to_numpy() > least.to_numpy()
                yield from _sheets(out[~known], False)
                yield from _sheets(out[known].assign(bucket=-1 - out["doc"][known] % n_buckets), True)

    def compare(key, sheets: pd.DataFrame) -> pd.DataFrame:
        parts = [_unsheet(r) for r in sheets.itertuples()]
        ids, ths, place, left, n = (np.concatenate([p[i] for p in parts]) for i in range(5))
        if key[0] < 0:
            return _intervals(ids, ths, place, n, n_buckets)
        body = np.frombuffer(b"".join(p[5] for p in parts) + b"\0" * 128, np.uint8)
        size = n + window - 1
        at = np.cumsum(size) - size
        anchor, right = at + left, size - left
        reach = window - K
        columns = np.arange(window)
        suffix = np.where(columns < right[:, None], body[anchor[:, None] + np.minimum(columns, right[:, None])], 0)
        columns = np.arange(reach)
        before = np.where(columns < left[:, None], body[np.maximum(anchor[:, None] - 1 - columns, 0)], 0)
        s_order, s_common = _runs(suffix, window)
        b_order, b_common = _runs(before, reach)
        hits: list[tuple[np.ndarray, int]] = []
        run, back = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        run[s_order], back[b_order] = np.cumsum(s_common < window), np.cumsum(b_common < reach)
        whole, least = _first_of((run << 32) | back, left * 64 + right, ids)
        known = whole[ids[whole] > least]  # all of the context is in a smaller document
        rest = np.setdiff1d(np.arange(len(ids)), known, assume_unique=True)
        for o in range(reach + 1):  # the window that starts o bytes before the anchor
            rows = rest[(left[rest] >= o) & (left[rest] - o < n[rest])]
            if len(rows) < 2:
                continue
            run[s_order] = np.cumsum(s_common < window - o)
            back[b_order] = np.cumsum(b_common < o) if o else 0
            by, least = _first_of((run[rows] << 32) | back[rows], None, ids[rows])
            hits.append((rows[by][ids[rows[by]] > least], o))
        rows = np.concatenate([known, *(d for d, _ in hits)])
        start = np.concatenate([place[known], *(place[d] + left[d] - o for d, o in hits)])
        return _intervals(ids[rows], ths[rows], start, np.concatenate([n[known], np.ones(len(rows) - len(known), np.int64)]), n_buckets)

    sheets = with_suspects(docs, suspects, n_buckets).mapInPandas(contexts, "bucket long, known boolean, keys binary, numbers binary, body binary")
    return gathered(sheets.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(compare, "part long, keys binary, who binary, starts binary, counts binary"), {"starts": "<i4", "counts": "<i4"}, n_buckets)


def _first_of(key: np.ndarray, more: np.ndarray | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key (and ``more``), then id; and for each place in it the smallest id of its key."""
    order = np.lexsort((ids, key) if more is None else (ids, more, key))
    head = np.ones(len(order), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    if more is not None:
        head[1:] |= more[order][1:] != more[order][:-1]
    return order, ids[order][np.flatnonzero(head)[np.cumsum(head) - 1]]


def _sheets(rows: pd.DataFrame, known: bool) -> Iterator[pd.DataFrame]:
    """Rows packed into one blob of numbers and one of bytes per bucket."""
    if rows.empty:
        return
    rows = rows.iloc[np.argsort(rows["bucket"].to_numpy(), kind="stable")]
    bucket, body, row = rows["bucket"].to_numpy(), rows["body"].tolist(), rows["row"].to_numpy()
    keys = rows[["doc", "th"]].to_numpy(np.int64)
    numbers = np.empty(len(rows), NUMBERS)
    for c in ("place", "left", "n"):
        numbers[c] = rows[c]
    at, out = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), []
    for a, b in zip(at, np.append(at[1:], len(bucket))):
        _, first, numbers["who"][a:b] = np.unique(row[a:b], return_index=True, return_inverse=True)
        out.append((bucket[a], known, keys[a:b][first].tobytes(), numbers[a:b].tobytes(), b"" if known else b"".join(body[a:b])))
    yield pd.DataFrame(out, columns=["bucket", "known", "keys", "numbers", "body"])


def _unsheet(r) -> tuple:
    numbers = np.frombuffer(r.numbers, NUMBERS)
    keys = np.frombuffer(r.keys, np.int64).reshape(-1, 2)[numbers["who"]]
    return keys[:, 0], keys[:, 1], *(numbers[c].astype(np.int64) for c in ("place", "left", "n")), r.body


def _intervals(ids: np.ndarray, ths: np.ndarray, start: np.ndarray, n: np.ndarray, n_parts: int) -> pd.DataFrame:
    """Packed by document: runs (start, count) of window starts, neighbours joined."""
    order = np.lexsort((start, ths, ids))
    ids, ths, start, end = ids[order], ths[order], start[order], (start + n)[order]
    cut = np.ones(len(ids), bool)
    cut[1:] = (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(cut)
    size = np.maximum.reduceat(end, first) - start[first] if len(first) else first
    return packed(ids[first], ths[first], {"starts": start[first].astype("<i4"), "counts": size.astype("<i4")}, n_parts)


def starts_of(starts: bytes, counts: bytes) -> np.ndarray:
    start, n = (np.frombuffer(x, "<i4").astype(np.int64) for x in (starts, counts))
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def deduplicated(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text: str = "text", hot: int = HOT_SUFFIXES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every row of ``docs``.

    A byte goes when a string of ``window`` bytes over it also starts in a document with a smaller id.
    Null texts are empty; rows with one id are never compared with each other; a null id is after all. Other columns
    of ``docs`` are not read, so their names do not matter; texts of any length count whole.
    """
    rows = numbered(docs, id_col, text)
    found = written(repeated_windows(rows, window, hot), "suffix-windows")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            out = []
            for doc, z, starts, counts in zip(batch["doc"], batch["z"], batch["starts"], batch["counts"]):
                data = expand(z)
                if starts is None:
                    out.append((doc, len(data), 0, 0, data))
                    continue
                gone = covered(starts_of(starts, counts), window, len(data))
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((doc, len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    texts = rows.select("doc", "th", compressed("text").alias("z")).hint("merge").join(found, ["doc", "th"], "left").drop("th")
    return texts.mapInPandas(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary").select(
        F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept"
    )


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that an earlier document has."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

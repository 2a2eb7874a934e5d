"""Repeated word sequences by relative Lempel-Ziv parsing.

The reference is the corpus itself, dealt into blocks by content: a block gets, for each shared anchor (see
``repeats``) it owns, the stretches of words around it, so equal windows always lie in one block. A block
indexes where each window of its stretches starts first, and factors every stretch greedily against that:
a factor starts at the next window that the index knows from an earlier place, and is extended word by word as
far as that place goes on. The windows across a factor's end are looked up next, so nothing between two
factors is lost. Factors of a window's length or more are duplicate spans, and their words go. Words are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import words
from folioflow.llm.repeats import NULL_ID, REMEMBERED, SPARED, bucket_of, buckets_for, chunks, compressed, expand, gathered, minimisers, numbered, packed, slices, suspect_anchors, wanted, with_suspects
from folioflow.llm.shared import written
from folioflow.llm.words import mix

K = 8
P = np.uint64(words.ODD[0])
#: Stretches factored side by side.
TOGETHER = 1 << 15
FOUND = {"starts": "<i4", "sizes": "<i4", "ref_docs": "<i8", "ref_starts": "<i4"}
DEALT = "bucket long, keys binary, who binary, spans binary, words binary, starts binary, sizes binary, ref_docs binary, ref_starts binary"
REPLIES = "part long, keys binary, who binary, starts binary, sizes binary, ref_docs binary, ref_starts binary"


class Prints:
    """Hashes of any stretch of a sequence of word hashes."""

    def __init__(self, word: np.ndarray):
        up, self.down = words.powers(0, len(word) + 1)
        self.sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * up[: len(word)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size, np.int64).astype(np.uint64))


def _anchors(texts: list[bytes], window: int):
    (word,), offsets = words.hashes(texts)
    grams = np.zeros(len(word), np.uint64)
    padded = np.concatenate([word, np.zeros(K, np.uint64)])
    for j in range(K):
        grams = grams * P + padded[j : j + len(word)]
    grams = mix(grams)
    anchor, first, last = minimisers(grams, np.repeat(offsets[1:], np.diff(offsets)), K, window)
    return word, offsets, grams[anchor] >> SPARED, np.searchsorted(offsets, anchor, "right") - 1, first, last


def _earliest(prints, docs, starts) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the first one of its print by place, and whether that one is at an earlier place."""
    order = np.lexsort((starts, docs, prints))
    p = prints[order]
    head = np.concatenate([np.ones(min(1, len(p)), bool), p[1:] != p[:-1]])
    ref = np.empty(len(p), np.int64)
    ref[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(p) else order
    return ref, (docs[ref] < docs) | ((docs[ref] == docs) & (starts[ref] < starts))


def _answers(docs, ths, starts, sizes, ref_docs, ref_starts, n_parts: int) -> pd.DataFrame:
    """Packed by document: its factors."""
    return packed(docs, ths, {c: x.astype(kind) for (c, kind), x in zip(FOUND.items(), (starts, sizes, ref_docs, ref_starts))}, n_parts)


def parse(word: np.ndarray, docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Factors of stretches of words against each other: (stretch, first word in its document, length, reference
    stretch, first word in that one's document). ``word``: the stretches' words, one after the other."""
    ends = np.cumsum(sizes)
    base = ends - sizes
    n = sizes - window + 1  # windows
    of = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = base[of] + inside
    ref, known = _earliest(Prints(word).of(at, window), docs[of], starts[of] + inside)
    # for each window the next known one of its stretch, or none
    upcoming = np.where(known, np.arange(len(of)), len(of))
    upcoming = np.minimum.accumulate(upcoming[::-1])[::-1] if len(of) else upcoming
    last = np.cumsum(n)  # the window after the stretch's last one
    found = []
    for a in range(0, len(n), TOGETHER):
        stretch = np.arange(a, min(len(n), a + TOGETHER))
        here = (last - n)[stretch]
        while len(stretch):
            here = np.where(here < last[stretch], upcoming[np.minimum(here, len(of) - 1)], len(of))
            go = here < last[stretch]
            stretch, here = stretch[go], here[go]
            if not len(stretch):
                break
            there = ref[here]
            own, other = at[here], at[there]
            room = np.minimum(ends[stretch] - own, ends[of[there]] - other)
            step = np.arange(room.max())
            same = (step < room[:, None]) & (word[np.minimum(own[:, None] + step, len(word) - 1)] == word[np.minimum(other[:, None] + step, len(word) - 1)])
            size = np.where(same.all(1), len(step), same.argmin(1))
            good = size >= window  # a window of another text with an equal print is no factor
            found.append(np.stack([stretch, starts[stretch] + own - base[stretch], size, of[there], starts[of[there]] + other - base[of[there]]])[:, good])
            here = here + np.where(good, size - window + 1, 1)
    return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, np.int64),) * 5


def repeated(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc, th, starts, sizes, ref_docs, ref_starts): by document, factors that also start at an earlier place, and that place."""
    n_buckets = buckets_for(docs)

    def anchors(some: pd.DataFrame):
        _, _, hashes, row, _, _ = _anchors([x.encode() for x in some["text"]], window)
        return hashes, row

    suspects = written(suspect_anchors(docs, anchors, n_buckets, within=True), "lz-suspects")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealt = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # stretches this task has sent: print, document, start
        for batch in slices(batches):
            for some in chunks(iter([batch.assign(text=[expand(z) for z in batch["z"]])]), "text"):
                word, offsets, hashes, row, first, last = _anchors(some["text"].tolist(), window)
                use = wanted(some, hashes, row)
                hashes, row, first, size = hashes[use], row[use], first[use], (last - first)[use] + window
                if not len(row):
                    continue
                docs_, ths = some[["doc", "th"]].to_numpy(np.int64)[row].T
                starts = first - offsets[row]
                # of equal stretches only the first is factored elsewhere; the others, also than one sent before, are one factor each
                prints, n = Prints(word).of(first, size), len(row)
                all_prints, all_docs, all_starts = (np.concatenate(x) for x in zip((prints, docs_, starts), dealt))
                ref, known = (x[:n] for x in _earliest(all_prints, all_docs, all_starts))
                later = np.flatnonzero(known)
                recent = np.concatenate([np.unique(ref[ref >= n]), np.flatnonzero(~known)])
                recent = np.concatenate([recent, np.setdiff1d(np.arange(n, len(all_prints)), recent)])[:REMEMBERED]
                dealt = all_prints[recent], all_docs[recent], all_starts[recent]
                if len(later):
                    told = _answers(docs_[later], ths[later], starts[later], size[later], all_docs[ref[later]], all_starts[ref[later]], n_buckets)
                    yield told.assign(bucket=-1 - told.pop("part"), spans=None, words=None)
                sent = np.flatnonzero(~known)
                bucket = bucket_of(hashes[sent], n_buckets)
                by = np.lexsort((starts[sent], row[sent], bucket))
                sent, bucket = sent[by], bucket[by]
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                out = []
                for a, b in zip(at, np.append(at[1:], len(sent))):
                    part = sent[a:b]
                    who, local = np.unique(row[part], return_inverse=True)
                    keys = some[["doc", "th"]].to_numpy(np.int64)[who]
                    length = size[part]
                    place = np.repeat(first[part] - np.cumsum(length) + length, length) + np.arange(length.sum())
                    out.append((bucket[a], keys.tobytes(), local.astype("<u4").tobytes(), np.stack([starts[part], length]).astype("<i4").tobytes(), word[place].tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "keys", "who", "spans", "words"]).assign(**dict.fromkeys(FOUND))

    def block(key, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return rows[["keys", "who", *FOUND]].assign(part=-1 - key[0])
        parts = []
        for r in rows.itertuples():
            who = np.frombuffer(r.keys, np.int64).reshape(-1, 2)[np.frombuffer(r.who, "<u4")]
            parts.append((who[:, 0], who[:, 1], *np.frombuffer(r.spans, "<i4").astype(np.int64).reshape(2, -1)))
        ids, ths, starts, sizes = map(np.concatenate, zip(*parts))
        word = np.frombuffer(b"".join(rows["words"]), np.uint64)
        own, start, size, other, ref_start = parse(word, ids, starts, sizes, window)
        return _answers(ids[own], ths[own], start, size, ids[other], ref_start, n_buckets)

    dealt = with_suspects(docs, suspects, n_buckets).mapInPandas(deal, DEALT).repartition(n_buckets, "bucket")
    return gathered(dealt.groupBy("bucket").applyInPandas(block, REPLIES), FOUND, n_buckets)


def joined(starts: np.ndarray, sizes: np.ndarray, ref_docs: np.ndarray, ref_starts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Factors of one document, in order: (start, length in words, reference document, its start). Overlapping
    factors that go on at the same place are one."""
    order = np.lexsort((-sizes, starts))
    out: list[tuple[int, int, int, int]] = []
    for s, n, d, r in zip(*(x[order].tolist() for x in (starts, sizes, ref_docs, ref_starts))):
        if out and s <= out[-1][0] + out[-1][1]:
            s0, n0, d0, r0 = out[-1]
            if d == d0 and r - r0 == s - s0:
                out[-1] = (s0, max(n0, s + n - s0), d0, r0)
                continue
            if s + n <= s0 + n0:
                continue
        out.append((s, n, d, r))
    return out


def deduplicated(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (words that stay, joined by one space), factors.

    A word goes when a window of ``window`` words over it also starts earlier: in a document with a smaller id,
    or earlier in its own. Null texts have no words; rows with one id count as one document; a null id is after
    all others. Other columns of ``docs`` are not read; texts of any length count whole.
    """
    rows = numbered(docs, id_col, text)
    found = written(repeated(rows, window), "lz-factors")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            out = []
            for r in batch.itertuples():
                each = expand(r.z).split()
                if r.starts is None:
                    out.append((r.doc, len(each), 0, b" ".join(each), []))
                    continue
                spans = joined(*(np.frombuffer(getattr(r, c), kind).astype(np.int64) for c, kind in FOUND.items()))
                kept, at = [], 0
                for start, size, _, _ in spans:
                    kept += each[at : max(at, start)]
                    at = max(at, start + size)
                kept += each[at:]
                out.append((r.doc, len(each), len(each) - len(kept), b" ".join(kept), [dict(zip(("start", "length", "ref_doc", "ref_start"), x)) for x in spans]))
            yield pd.DataFrame(out, columns=["doc", "n_words", "n_removed", "kept", "factors"])

    texts = rows.select("doc", "th", compressed("text").alias("z")).hint("merge").join(found, ["doc", "th"], "left").drop("th")
    schema = "doc long, n_words long, n_removed long, kept binary, factors array<struct<start:long,length:long,ref_doc:long,ref_start:long>>"
    return texts.mapInPandas(cut, schema).select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "n_words", "n_removed", "kept", "factors")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the 20-word sequences that start earlier."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

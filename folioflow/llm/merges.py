"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Symbols start as characters; the agenda holds the neighbours whose concatenation is a piece, best score
first, leftmost on ties. When a merge's turn comes, it is skipped for good if a hash keyed by the seed, the
document's id, the word's place and the merge's place falls below the dropout rate, so every occurrence of a word
is segmented by itself, and every run with one seed agrees. Words (runs of
blanks with what follows) are independent of each other, so the words of many documents are merged side by
side, each by its own agenda; very long words take a heap. Characters without a piece become bytes, and so does
a literal U+2581, which stands for a blank in pieces; decoding gives back every text as it was.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.repeats import chunks, mix
from folioflow.llm.shared import small_batches

BLANK = "▁"
#: Occurrences of words that are segmented side by side.
TOGETHER = 1 << 17
#: Longer words are merged one by one.
SHORT = 48
#: Stands for a literal U+2581 among the characters of a word; no text holds it, as it is no character.
LITERAL = "\udfff"
NO_MERGE = np.int32(1 << 30)
SLOT_BITS, SLOT_FACTOR = 20, 0x9E3779B97F4A7C15


class Pieces:
    """Lookup tables of a SentencePiece model."""

    def __init__(self, path: str | None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        self.text_of = [bytes([byte_of[i]]) if i in byte_of else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        order = sorted(plain, key=lambda i: -model.get_score(i))
        self.rank = np.zeros(n, np.int64)
        self.rank[order] = np.arange(len(order))
        letters = sorted({c for p in self.ids for c in p} - set(self.ids))
        self.symbols = self.ids | {c: n + i for i, c in enumerate(letters)}
        pairs = {}
        for text, i in self.ids.items():
            for cut in range(1, len(text)):
                a, b = self.symbols.get(text[:cut]), self.symbols.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.merge = pairs
        self.by_rank = np.array(order, np.int64)
        self.slot_key, self.slot_id, self.probes = self._slots(pairs)
        self.symbol_at = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.symbol_at[ord(c)] = i

    @staticmethod
    def _slots(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Open addressing with linear probes."""
        keys, ids, most = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, -1, np.int32), 1
        for key, i in pairs.items():
            at, tries = (key * SLOT_FACTOR & (1 << 64) - 1) >> (64 - SLOT_BITS), 1
            while keys[at] >= 0:
                at, tries = (at + 1) & ((1 << SLOT_BITS) - 1), tries + 1
            keys[at], ids[at], most = key, i, max(most, tries)
        return keys, ids, most

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merge, -1 where there is none."""
        key = left.astype(np.int64) << 20 | right
        at = (key.view(np.uint64) * np.uint64(SLOT_FACTOR) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.where(self.slot_key[at] == key, self.slot_id[at], np.int32(-1))
        open_ = np.flatnonzero((out < 0) & (self.slot_key[at] >= 0) & (left >= 0) & (right >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << SLOT_BITS) - 1)
            found = self.slot_key[at[open_]]
            same = found == key[open_]
            out[open_[same]] = self.slot_id[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return np.where((left >= 0) & (right >= 0), out, np.int32(-1))

    def of_character(self, c: str, symbol: int) -> list[int]:
        """Ids of a symbol that is left as a character."""
        if 0 <= symbol < len(self.pieces):
            return [symbol]
        return [self.bytes[b] for b in (BLANK if c == LITERAL else c).encode("utf-8", "replace")]


@functools.lru_cache(2)
def pieces(path: str | None = None) -> Pieces:
    """One per worker process."""
    return Pieces(path)


def _skipped(key, start, end, limit: int):
    """Whether the merge of the characters from start to end is skipped."""
    return mix(key ^ (start.astype(np.uint64) << np.uint64(32) | end.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) < np.uint64(limit)


def _one(word: str, key: int, limit: int, table: Pieces) -> list[int]:
    """Agenda of one word with a heap."""
    n = len(word)
    symbol = [table.symbols.get(c, -1) for c in word]
    start, end, after, before = list(range(n)), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []

    def propose(i: int) -> None:
        j = after[i]
        if j < n and symbol[i] >= 0 and symbol[j] >= 0 and (m := table.merge.get(symbol[i] << 20 | symbol[j])) is not None:
            heapq.heappush(heap, (int(table.rank[m]), i, end[j], m))

    for i in range(n - 1):
        propose(i)
    while heap:
        _, i, stop, m = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop or table.merge.get(symbol[i] << 20 | symbol[j]) != m:
            continue
        if limit and _skipped(np.array([key], np.uint64), np.array([start[i]]), np.array([stop]), limit)[0]:
            continue
        symbol[i], end[i], after[i], alive[j] = m, stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
        propose(i)
        if before[i] >= 0:
            propose(before[i])
    return [x for i in range(n) if alive[i] for x in ([symbol[i]] if end[i] - start[i] > 1 else table.of_character(word[start[i]], symbol[i]))]


def segment(words: list[str], keys: np.ndarray, limit: int, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids, one after the other, and each word's number of ids. All short words go through
    their agendas together, one merge a round each."""
    length = np.array([len(w) for w in words], np.int64)
    short, long = np.flatnonzero(length <= SHORT), np.flatnonzero(length > SHORT)
    ids, counts = _together([words[i] for i in short.tolist()], length[short], keys[short], limit, table)
    if not len(long):
        return ids, counts
    alone = [_one(words[i], int(keys[i]), limit, table) for i in long.tolist()]
    n = np.zeros(len(words), np.int64)
    n[short], n[long] = counts, [len(x) for x in alone]
    out = np.empty(n.sum(), np.int32)
    is_long = np.repeat(length > SHORT, n)
    out[~is_long], out[is_long] = ids, np.concatenate(alone)
    return out, n


def _together(words: list[str], size: np.ndarray, key: np.ndarray, limit: int, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    text = "".join(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = table.symbol_at[points]
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    base = np.cumsum(size) - size
    start = (np.arange(len(points)) - np.repeat(base, size)).astype(np.int32)
    end = start + np.int32(1)
    done: list[tuple] = []

    def ranked(at: np.ndarray) -> np.ndarray:
        """Of each symbol in ``at``, the rank and place of its merge with the next one of its word."""
        to = np.minimum(at + 1, len(word) - 1)
        m = np.where((to > at) & (word[to] == word[at]), table.look_up(symbol[at], symbol[to]), np.int32(-1))
        can = np.flatnonzero(m >= 0)
        if limit:
            can = can[~_skipped(key[word[at[can]]], start[at[can]], end[to[can]], limit)]
        out = np.full(len(at), NO_MERGE, np.int32)
        out[can] = table.rank[m[can]] << 6 | start[at[can]]
        return out

    rank = ranked(np.arange(len(word)))
    while len(word):
        heads = np.flatnonzero(np.diff(word, prepend=np.int32(-1)))
        best = np.minimum.reduceat(rank, heads)
        lengths = np.diff(np.append(heads, len(word)))
        open_ = best < NO_MERGE
        if not open_.all():  # words without a merge are ready
            rows = np.repeat(open_, lengths)
            done.append((word[~rows], symbol[~rows], start[~rows], (end - start)[~rows]))
            word, symbol, start, end, rank = word[rows], symbol[rows], start[rows], end[rows], rank[rows]
            if not len(word):
                break
            best, lengths = best[open_], lengths[open_]
        at = np.flatnonzero(rank == np.repeat(best, lengths))  # one a word: ranks hold the place
        symbol[at], end[at] = table.by_rank[best >> 6], end[at + 1]
        keep = np.ones(len(word), bool)
        keep[at + 1] = False
        at -= np.arange(len(at))
        word, symbol, start, end, rank = word[keep], symbol[keep], start[keep], end[keep], rank[keep]
        near = np.zeros(len(word), bool)
        near[at] = True
        near[np.maximum(at - 1, 0)] = True
        near = np.flatnonzero(near)
        rank[near] = ranked(near)
    word, symbol, start, n = (np.concatenate(x) for x in zip(*done))
    first_point = base[word] + start
    order = np.argsort(first_point, kind="stable")
    word, symbol, first_point = word[order], symbol[order], first_point[order]
    loose = np.flatnonzero((symbol < 0) | (symbol >= len(table.pieces)))  # characters without a piece
    if len(loose):
        each = [table.of_character(text[p], -1) for p in first_point[loose].tolist()]
        times = np.ones(len(word), np.int64)
        times[loose] = [len(x) for x in each]
        at = np.repeat(np.arange(len(word)), times)
        is_loose = np.zeros(len(word), bool)
        is_loose[loose] = True
        word, symbol, is_loose = word[at], symbol[at], is_loose[at]
        symbol[is_loose] = np.concatenate(each)
    return symbol.astype(np.int32), np.bincount(word, minlength=len(words))


WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def encode_texts(texts: list[str], ids: np.ndarray, seed: int, dropout: float, table: Pieces, together: int = TOGETHER) -> list[np.ndarray]:
    """Piece ids of each text. The first word has a blank before it, as the model expects; an empty text has none."""
    lists = [WORD.findall(BLANK + x.replace(BLANK, LITERAL).replace(" ", BLANK)) if x else [] for x in texts]
    size = np.array([len(x) for x in lists], np.int64)
    flat = [w for x in lists for w in x]
    if not flat:
        return [np.zeros(0, np.int32) for _ in texts]
    limit = int(dropout * (1 << 64)) if dropout < 1 else (1 << 64) - 1
    if limit:
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        salt = np.uint64((seed * 0xD6E8FEB86659FD93 + 1) & ((1 << 64) - 1))
        keys = mix(mix(np.repeat(ids.astype(np.int64).view(np.uint64), size) ^ salt) + place.astype(np.uint64))
        parts = [segment(flat[a : a + together], keys[a : a + together], limit, table) for a in range(0, len(flat), together)]
        every, count = (np.concatenate(x) for x in zip(*parts))
    else:  # all occurrences of a word are alike
        words = np.empty(len(flat), object)
        words[:] = [w.encode("utf-8", "surrogatepass") for w in flat]
        inverse, distinct = pd.factorize(words)
        pool, n = segment([w.decode("utf-8", "surrogatepass") for w in distinct], np.zeros(len(distinct), np.uint64), limit, table)
        begin = np.cumsum(n) - n
        count = n[inverse]
        every = pool[np.repeat(begin[inverse] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(size)])]
    return [every[a:b] for a, b in zip(ends, ends[1:])]


def decode_ids(ids: np.ndarray, table: Pieces) -> str:
    """The text: pieces joined, byte pieces as UTF-8, blanks restored, the first one dropped."""
    text_of = table.text_of
    return b"".join([text_of[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, seed: int = 0, dropout: float = 0.1, text: str = "text", id_col: str = "doc_id", into: str = "ids", path: str | None = None, decode: bool = False) -> DataFrame:
    """``docs`` with the piece ids of its texts (int32, little-endian). Null and empty texts have none;
    repeated rows are encoded alike; without dropout these are the model's own ids. With ``decode``, also ``decoded``, the
    text that the ids give back. Columns of ``docs`` by these names, or _encoded, are replaced, all others stay; texts of any length count whole."""

    @F.pandas_udf("struct<ids: binary, decoded: string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = pieces(path)
        for texts, ids in batches:
            out = []
            for some in chunks(iter([pd.DataFrame({"text": texts.fillna(""), "id": ids})]), "text"):
                for x in encode_texts(some["text"].tolist(), some["id"].to_numpy(np.int64), seed, dropout, table):
                    out.append((x.astype("<i4").tobytes(), decode_ids(x, table) if decode else None))
            yield pd.DataFrame(out, columns=["ids", "decoded"])

    both = small_batches(docs).withColumn("_encoded", run(F.col(text), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)))).withColumn(into, F.col("_encoded.ids"))
    return (both.withColumn("decoded", F.col("_encoded.decoded")) if decode else both).drop("_encoded")


def decoded(ids: str, path: str | None = None) -> Column:
    """The text of a column of piece ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = pieces(path)
        for batch in batches:
            yield pd.Series([decode_ids(np.frombuffer(x, "<i4"), table) for x in batch], dtype=object)

    return run(F.col(ids))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids under merge-dropout, as count and checksum, and the digest of their decoding."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, decode=True)
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )

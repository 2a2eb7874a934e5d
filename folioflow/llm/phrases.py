"""Phrase collocations from an FM-index per shard.

1. Each task cuts its documents into shards of about ``SHARD_BYTES``, whose words become numbers of the shard's own vocabulary
   (a word of another language is another symbol; 0 ends a piece). Shards are stored with their vocabularies.
2. Vocabularies add up to word counts. Frequent words get numbers; a shard is told those of its own, all other words end pieces.
3. A shard becomes a bidirectional index: the Burrows-Wheeler transforms of its numbers and of their reverse. A phrase is an
   interval in both; extending it to the right is a step in the second, which splits the first by the counts of
   the smaller extensions, and the other way round to the left. Suffixes are sorted by ``DEPTH`` words only, which is as far
   as phrases go. Pairs are counted this way in every shard; owners of pairs get their keys as one Golomb-coded list a shard, with counts.
4. Owners sum pairs and answer with a bitmap a list: which are frequent over all. Those are extended to the left to three words and to the right to
   four; an extension lives only if its outer pair is frequent as well. Counts are summed again.

Every part of a phrase is at least as frequent as the phrase, so nothing that reaches the threshold is lost. A word or pair is sent
once by each shard that has it, so the most frequent one costs its owner one number a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import rice
from folioflow.llm.shared import small_batches, written
from folioflow.llm.words import mix
from folioflow.operators.numbering import numbered

DEPTH = 4
#: Text of a shard. A longer piece without punctuation is a shard of its own.
SHARD_BYTES = 8 << 20
LEAST, TOP, SCALE = 30, 2000, 2_000_000
#: Shards for each owner of pairs: some 500,000 pairs each.
OWNED = 4
#: Frequent words that are broadcast at most, about 50 MB.
FEW = 1 << 19
#: Candidates of a language that one task ranks before the best of each task meet.
RANKED = 1 << 19

PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
SHARDS = "kind string, shard long, symbols binary, symbol int, lang string, word string, n long"
SHARD_ROWS = pa.schema([
    ("kind", pa.string()), ("shard", pa.int64()), ("symbols", pa.binary()), ("symbol", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()),
])
OWN = "of long, symbols binary, ids binary"
OWN_ROWS = pa.schema([("of", pa.int64()), ("symbols", pa.binary()), ("ids", pa.binary())])
#: Of a shard its frequent words, and for each owner of pairs the sorted keys of those that it owns (Golomb-coded) and their counts.
SENT = "kind string, shard long, owner int, words binary, sequence binary, pairs binary, counts binary"
SENT_ROWS = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("owner", pa.int32()), *((c, pa.binary()) for c in ("words", "sequence", "pairs", "counts"))])
#: An owner's frequent pairs, and its answers: a bit for each pair of a message.
TOLD = "kind string, w1 int, w2 int, n long, shard long, owner int, bits binary"
TOLD_ROWS = pa.schema([("kind", pa.string()), ("w1", pa.int32()), ("w2", pa.int32()), ("n", pa.int64()), ("shard", pa.int64()), ("owner", pa.int32()), ("bits", pa.binary())])
#: Longer phrases travel as two numbers, of two words each.
GRAM_ROWS = pa.schema([("head", pa.int64()), ("tail", pa.int64()), ("n", pa.int32())])
GRAMS = "head long, tail long, n int"
IDS = ["w1", "w2", "w3", "w4"]

ENDS = np.zeros(256, bool)
ENDS[list(PIECE_ENDS)] = True
GAPS = ENDS.copy()
GAPS[list(BLANKS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def narrow(x: np.ndarray) -> bytes:
    """Numbers in one to four bytes each, as the largest needs; the first byte says how many."""
    size = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([size]) + np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size]).tobytes()


def wide(data: bytes) -> np.ndarray:
    held = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    out = np.zeros((len(held), 4), np.uint8)
    out[:, : data[0]] = held
    return out.view("<u4").ravel().astype(np.int64)


def numbered_words(texts: list[bytes], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """The symbols of texts, one behind the other (words from 1, a 0 between pieces), and of each symbol the language, the word and its count."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    word = ~GAPS[data]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    closed = np.cumsum(ENDS[data], dtype=np.int32)[first]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    lang = langs[np.searchsorted(starts, first, side="right") - 1]
    offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[word].tobytes())]).dictionary_encode()
    spread = int(lang.max()) + 1
    key = coded.indices.to_numpy().astype(np.int64) * spread + lang
    if len(coded.dictionary) * spread <= 8 * len(key):
        seen = np.bincount(key)
        keys = np.flatnonzero(seen)
        counts, place = seen[keys], np.zeros(len(seen), np.int64)
        place[keys] = np.arange(len(keys))
        symbol = place[key]
    else:
        keys, symbol, counts = np.unique(key, return_inverse=True, return_counts=True)
    breaks = np.flatnonzero(np.diff(closed))
    symbols = np.insert(symbol.astype(np.int64) + 1, breaks + 1, 0)
    return symbols, keys % spread, coded.dictionary.take(pa.array(keys // spread)), counts


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts of about ``size`` bytes, cut where pieces end. A piece is never cut."""
    at = 0
    while len(text) - at > size:
        data = np.frombuffer(text, np.uint8, offset=at)
        behind = np.flatnonzero(ENDS[data[:size]])
        if len(behind):
            end = at + int(behind[-1]) + 1
        else:
            ahead = np.flatnonzero(ENDS[data[size:]])
            end = at + size + int(ahead[0]) + 1 if len(ahead) else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def _shards(size: int):
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        total, number, part = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for piece in cut(memoryview(text.as_buffer()).tobytes(), size):
                    held.append((lang, piece))
                    total += len(piece)
                    if total >= size:
                        yield from shard(held, part << 32 | number)
                        held, total, number = [], 0, number + 1
        if held:
            yield from shard(held, part << 32 | number)

    def shard(held: list[tuple[str, bytes]], name: int) -> Iterator[pa.RecordBatch]:
        names = sorted({x for x, _ in held})
        code = {x: i for i, x in enumerate(names)}
        symbols, lang, words, counts = numbered_words([x for _, x in held], np.array([code[x] for x, _ in held]))
        n = len(counts)
        none = lambda k, t: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays([pa.array(["shard"]), pa.array([name]), pa.array([narrow(symbols)], pa.binary()), none(1, pa.int32()), none(1, pa.string()), none(1, pa.string()), none(1, pa.int64())], schema=SHARD_ROWS)
        for a in range(0, n, 1 << 15):
            b = min(n, a + (1 << 15))
            yield pa.RecordBatch.from_arrays([
                pa.array(["word"] * (b - a)), pa.array(np.full(b - a, name)), none(b - a, pa.binary()), pa.array(np.arange(a + 1, b + 1, dtype=np.int32)),
                pa.array([names[i] for i in lang[a:b]], pa.string()), words.slice(a, b - a).cast(pa.string()), pa.array(counts[a:b].astype(np.int64)),
            ], schema=SHARD_ROWS)

    return partition


def sorted_places(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several columns of numbers below 2 ** 32, the first one first; a radix sort of 16 bits at a time."""
    order = None
    for key in reversed(keys):
        for shift in (0, 16) if int(key.max(initial=0)) >> 16 else (0,):
            digit = ((key >> shift) & 0xFFFF).astype(np.uint16)
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return order


def transform(s: np.ndarray) -> np.ndarray:
    """The symbol before each suffix of ``s`` (cyclic), suffixes in the order of their first ``DEPTH`` symbols, then of their places."""
    padded = np.concatenate([s, np.zeros(DEPTH, s.dtype)])
    return s[sorted_places([padded[i : i + len(s)] for i in range(DEPTH)]) - 1]


class Index:
    """The two transforms of a shard's words (a 0 last). Phrases are rows of three arrays: lo (interval in the one of the text), ol (interval in that of
    the reversed text) and n (the length of both)."""

    def __init__(self, words: np.ndarray, n_words: int):
        self.bwt, self.twb = transform(words), transform(np.concatenate([words[:-1][::-1], [0]]))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=n_words + 1))])
        self.steps = [self._steps(x) for x in (self.bwt, self.twb)]

    @staticmethod
    def _steps(x: np.ndarray) -> np.ndarray:
        """Where each place of a transform goes when its symbol is put in front: the symbol's start and its rank."""
        to = np.empty(len(x), np.int64)
        to[sorted_places([x])] = np.arange(len(x))
        return to

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo = self.starts[1:-1]
        return lo, lo, np.diff(self.starts)[1:]

    @staticmethod
    def _extended(transform: np.ndarray, to: np.ndarray, near: np.ndarray, far: np.ndarray, n: np.ndarray):
        """All extensions of intervals ``near`` of a transform by one word: of each the phrase it extends, the word, its intervals and count."""
        own = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(near, n)
        symbol = transform[at]
        spread = int(symbol.max(initial=0)) + 1
        keys, where, count = np.unique(own * spread + symbol, return_index=True, return_counts=True)
        of, word = keys // spread, keys % spread
        before = np.cumsum(count) - count
        inside = before - (np.cumsum(n) - n)[of]  # smaller extensions of the same phrase, the end of a piece among them
        live = word > 0
        return of[live], word[live], to[at[where]][live], (far[of] + inside)[live], count[live]

    def right(self, lo, ol, n):
        of, word, near, far, count = self._extended(self.twb, self.steps[1], ol, lo, n)
        return of, word, far, near, count

    def left(self, lo, ol, n):
        return self._extended(self.bwt, self.steps[0], lo, ol, n)


def marked(size: int, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """True at the places of the intervals."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n, -1)
    return np.cumsum(edge)[:size] > 0


def pairs_of(index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of words of a shard, in a fixed order: first word, second word, intervals, counts."""
    first, second, lo, ol, n = index.right(*index.words())
    return first + 1, second, lo, ol, n


def _table(schema: pa.Schema, *columns) -> pa.Table:
    return pa.table([pa.nulls(len(columns[0]), f.type) if x is None else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _own_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (of, symbol, id) as lists, one for each shard in a batch."""
    for batch in batches:
        of, symbol, ids = (batch.column(c).to_numpy() for c in ("of", "symbol", "id"))
        order = np.argsort(of, kind="stable")
        names, starts = np.unique(of[order], return_index=True)
        lists = [[narrow(x[order][a:b]) for a, b in zip(starts, [*starts[1:], len(of)])] for x in (symbol, ids)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(x, pa.binary()) for x in lists)], schema=OWN_ROWS)


def _listed(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(wide(x) for x in column.to_pylist())])


def owner_of(keys: np.ndarray, owners: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(owners)).astype(np.int64)


def _indexed(n_words: int, owners: int):
    """The index of a shard over its frequent words, and a message with its pairs for each owner. A pair's key is the number of its first word
    times ``n_words`` and that of its second; words are in the order of their numbers, so keys ascend with slots."""

    def run(key: tuple, shard: pa.Table, own: pa.Table) -> pa.Table:
        symbols = wide(shard.column("symbols")[0].as_py()) if shard.num_rows else np.zeros(0, np.int64)
        if not len(symbols) or not own.num_rows:
            return _table(SENT_ROWS, *[[]] * len(SENT_ROWS))
        local, ids = _listed(own.column("symbols")), _listed(own.column("ids"))
        order = np.argsort(ids)
        to = np.zeros(int(symbols.max()) + 1, np.int64)
        to[local[order]] = np.arange(1, len(ids) + 1)
        s = np.append(to[symbols], 0)
        s = s[(s > 0) | (np.concatenate([[0], s[:-1]]) > 0)]  # one end of a piece is as good as many
        words = np.concatenate([[0], ids[order]])
        first, second, _, _, n = pairs_of(Index(s, len(ids)))
        keys, name = words[first] * n_words + words[second], key[0].as_py()
        owner = owner_of(keys, owners)
        order = np.argsort(owner, kind="stable")
        present, starts = np.unique(owner[order], return_index=True)
        parts = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
        index = _table(SENT_ROWS, ["index"], [name], None, [narrow(words)], [narrow(s)], None, None)
        pairs = [rice.encode(keys[x].astype(np.uint64)) for x in parts]
        sent = _table(SENT_ROWS, ["pairs"] * len(parts), [name] * len(parts), present, None, None, pairs, [narrow(n[x]) for x in parts])
        return pa.concat_tables([index, sent])

    return run


def _owned(n_words: int, least: int):
    """One owner: sums of its pairs over all shards, and which pairs of each message are frequent."""

    def run(key: tuple, messages: pa.Table) -> pa.Table:
        lists = [rice.decode(x).astype(np.int64) for x in messages.column("pairs").to_pylist()]
        keys, counts = np.concatenate(lists), _listed(messages.column("counts"))
        order = np.argsort(keys, kind="stable")
        every, starts = np.unique(keys[order], return_index=True)
        sums = np.add.reduceat(counts[order], starts)
        live = sums >= least
        frequent = every[live]
        found = _table(TOLD_ROWS, ["pair"] * len(frequent), frequent // n_words, frequent % n_words, sums[live], None, None, None)
        bits = [np.packbits(np.isin(x, frequent, assume_unique=True)).tobytes() for x in lists]
        told = _table(TOLD_ROWS, ["answer"] * len(bits), None, None, None, messages.column("shard").to_pylist(), messages.column("owner").to_pylist(), bits)
        return pa.concat_tables([found, told])

    return run


def longer(index: Index, frequent: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Phrases of three words and of four, as columns of words and counts, whose pairs are all among the ``frequent`` slots of ``pairs_of``."""
    first, second, lo, ol, n = (x[frequent] for x in pairs_of(index))
    starts, ends = marked(len(index.bwt), lo, n), marked(len(index.twb), ol, n)
    of, word, lo3, ol3, n3 = index.left(lo, ol, n)
    live = starts[lo3]  # the first two words
    three = [word[live], first[of[live]], second[of[live]], n3[live]]
    of, word, lo4, ol4, n4 = index.right(lo3[live], ol3[live], n3[live])
    live = ends[ol4]  # the last two
    return three, [*(x[of[live]] for x in three[:3]), word[live], n4[live]]


def _longer(n_words: int, owners: int):
    def run(key: tuple, shard: pa.Table, answers: pa.Table) -> pa.Table:
        if not shard.num_rows or not answers.num_rows:
            return _table(GRAM_ROWS, *[[]] * len(GRAM_ROWS))
        words, sequence = (wide(shard.column(c)[0].as_py()) for c in ("words", "sequence"))
        index = Index(sequence, len(words) - 1)  # made again: a shard's words are half as large as its two transforms
        first, second, *_ = pairs_of(index)
        owner = owner_of(words[first] * n_words + words[second], owners)
        order = np.argsort(owner, kind="stable")
        present, starts = np.unique(owner[order], return_index=True)
        at, frequent = dict(zip(present.tolist(), zip(starts, [*starts[1:], len(order)]))), np.zeros(len(order), bool)
        for o, bits in zip(answers.column("owner").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            a, b = at[o]
            frequent[order[a:b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        three, four = longer(index, np.flatnonzero(frequent))
        three = [*three[:3], np.zeros(len(three[3]), np.int64), three[3]]
        columns = [np.concatenate(x) for x in zip(three, four, strict=True)]
        w1, w2, w3, w4 = (words[x] for x in columns[:4])
        return _table(GRAM_ROWS, w1 << 32 | w2, w3 << 32 | w4, columns[4])

    return run


def _met(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``few``, a stored table, which is broadcast up to ``FEW`` rows (counted first)."""
    return rows.join(F.broadcast(few) if few.count() <= FEW else few, keys)


def counted(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, size: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (id, lang, word, n) and phrases of two to four of them (w1 to w4, 0 for none, and n) that occur ``least`` times or more in
    their language, and all words of each language (lang, total)."""
    narrowed = small_batches(docs).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    book = written(narrowed.mapInArrow(_shards(size), SHARDS), "phrases-shards", "kind")
    vocabulary = book.filter("kind = 'word'").select("shard", "symbol", "lang", "word", "n")
    sums = written(vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrases-sums")
    words = written(numbered(sums.filter(F.col("n") >= least), "id").withColumn("id", F.col("id").cast("int")), "phrases-words")
    own = _met(vocabulary.select("shard", "symbol", "lang", "word"), words.select("lang", "word", "id"), ["lang", "word"])
    own = own.select(F.col("shard").alias("of"), "symbol", "id").mapInArrow(_own_ids, OWN)
    shards = book.filter("kind = 'shard'").select("shard", "symbols")
    n_words, owners = words.count() + 1, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards.count() // OWNED)
    sent = written(shards.groupBy("shard").cogroup(own.groupBy("of")).applyInArrow(_indexed(n_words, owners), SENT), "phrases-index", "kind")
    messages = sent.filter("kind = 'pairs'").select("shard", "owner", "pairs", "counts")
    told = written(messages.groupBy("owner").applyInArrow(_owned(n_words, least), TOLD), "phrases-pairs", "kind")
    pairs = told.filter("kind = 'pair'").select("w1", "w2", "n")
    answers = told.filter("kind = 'answer'").select(F.col("shard").alias("of"), "owner", "bits")
    blobs = sent.filter("kind = 'index'").select("shard", "words", "sequence")
    found = blobs.groupBy("shard").cogroup(answers.groupBy("of")).applyInArrow(_longer(n_words, owners), GRAMS)
    totals = found.groupBy("head", "tail").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    halves = lambda c: (F.shiftright(c, 32).cast("int"), F.col(c).bitwiseAND(0xFFFFFFFF).cast("int"))
    grams = totals.select(*(x.alias(name) for x, name in zip((*halves("head"), *halves("tail")), IDS, strict=True)), "n")
    zero = F.lit(0).cast("int")
    phrases = written(pairs.select("w1", "w2", zero.alias("w3"), zero.alias("w4"), "n").unionByName(grams), "phrases-counts")
    return words, phrases, sums.groupBy("lang").agg(F.sum("n").alias("total"))


def scored(words: DataFrame, phrases: DataFrame, least: int = LEAST) -> DataFrame:
    """The phrases that no longer one stands for: w1 to w4, a, l, r and score.

    A cut after k words scores floor(SCALE * a / (l + r)); the lowest counts, the shortest first part among equal ones. A phrase that
    a one word longer one holds in 80 of 100 occurrences goes; no more needs to be looked at, since what holds it in a
    phrase two words longer does so in one of those between, which is as frequent at least.
    """
    key = lambda *c: F.concat_ws(" ", *(F.when(F.col(x) > 0, F.col(x)) for x in c))
    named = phrases.select(*IDS, F.col("n").alias("a"), key(*IDS).alias("key"), (2 + (F.col("w3") > 0).cast("int") + (F.col("w4") > 0).cast("int")).alias("d"))
    parts = phrases.filter("w4 = 0").select(key(*IDS).alias("key"), "n").unionByName(words.select(F.col("id").cast("string").alias("key"), "n"))
    cuts = [F.struct(F.lit(k).alias("k"), key(*IDS[:k]).alias("left"), key(*IDS[k:]).alias("right")) for k in (1, 2, 3)]
    cut_ = named.select("key", "a", F.explode(F.filter(F.array(*cuts), lambda c: c["k"] < F.col("d"))).alias("cut")).select("key", "a", "cut.*")
    both = (
        cut_.join(parts.select(F.col("key").alias("left"), F.col("n").alias("l")), "left")
        .join(parts.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
        .withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) div (CAST(l AS DECIMAL(20, 0)) + r)"))
    )
    best = both.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    held = (
        named.filter("d > 2").select(F.col("a").alias("most"), F.explode(F.array(
            F.when(F.col("d") == 3, key("w1", "w2")).otherwise(key("w1", "w2", "w3")), F.when(F.col("d") == 3, key("w2", "w3")).otherwise(key("w2", "w3", "w4")),
        )).alias("key")).groupBy("key").agg(F.max("most").alias("most"))
    )
    stands = named.join(held, "key", "left").filter(f"most IS NULL OR CAST(most AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * 80 OR most < {int(least)}")
    return stands.join(best, "key").select("key", *IDS, "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, size: int = SHARD_BYTES, ranked: int = RANKED) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Null text is empty, a null language ``und``; documents are not told apart by id, so repeated rows count again. A text without words gives
    nothing, very long ones are spread over shards. Equal scores are ordered by a, then by the phrase's bytes. Other columns are not read. An empty
    table gives no row.
    """
    words, phrases, totals = counted(docs, lang, text, least, size)
    found = written(scored(words, phrases, least), "phrases-scored")
    at = found.select("key", F.posexplode(F.filter(F.array(*IDS), lambda x: x > 0)).alias("pos", "id"))
    spelled = (
        at.join(words.select("id", "lang", "word"), "id").groupBy("key")
        .agg(F.first("lang").alias("lang"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])).alias("phrase"))
    )
    rows = found.join(spelled, "key")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    buckets = found.count() // ranked + 1
    if buckets > 1:  # the best of each bucket first
        near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


def op12_phrase_collocation(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Documents whose sets of word n-grams have a high Jaccard similarity, by vertical partitioning.

The n-grams have one global order, by hash, and the order is cut into fragments. Every count of common
n-grams is made in the fragments separately, each seeing only its own part of the sets, and then summed.

1. Which documents can link at all: each fragment's owner gets Golomb-Rice coded lists of the n-grams that
   chunks of documents hold, and answers with bitmaps of those that others hold too. Summed over the fragments,
   a document has s shared n-grams out of n. A link needs 4n/5 of them, so nearly all documents are done here.
2. The rest become classes of equal sets. Their n-grams are counted exactly, those that one class alone holds
   go, and so do the classes with too few left. What stays is sorted, rare n-grams first; two sets that link
   share an n-gram in a short prefix (s - ceil(4n/5) + 1 of the longer one, s - ceil(8n/9) + 1 of the shorter).
3. Pairs proposed by prefixes are counted by partial overlaps in every fragment, summed by pair.

Components need no more than a spanning set of links. So that a large group of near copies does not yield
all of its pairs, prefix n-grams first propose one pair per document, with the most central document that
shares them; documents in one component then need no pair any more. What is left between components, and
only that, is joined pair by pair. No bound on candidates: every pair that could link two components is counted.
N-grams are compared as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import rice, words
from folioflow.llm.components import components
from folioflow.llm.repeats import NULL_ID, chunks, numbered
from folioflow.llm.shared import by_group, written
from folioflow.llm.words import mix

WORDS = 5
#: Text bytes a task looks at together, and for which there is one more owner of n-grams.
CHUNK, OWNED = 1 << 20, 1 << 23
#: Fragments of the global order in which pairs are counted.
FRAGMENTS = 8
#: Rounds with one central document per n-gram, before pairs between components are joined.
ROUNDS = 2
#: Pairs that meet one copy of a central document's fragment.
SHARE = 512
FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)
BOOK = "kind string, chunk long, owner long, keys binary, coded binary"
ROWS = "rid long, doc long, th long, n long, s1 long, s2 long, core boolean"
LINKS = "9 * common >= 4 * size"  # 100 * intersection >= 80 * union; size: of both sets


def ngram_sets(texts: list[bytes], n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each text, A-Z in lower case, sorted by row and hash."""
    (word,), offsets = words.hashes(texts, lower=True)
    size = np.diff(offsets)
    grams = np.zeros(max(0, len(word) - n_words + 1), np.uint64)
    for j in range(n_words):
        grams = grams * FACTOR + word[j : j + len(grams)]
    grams = mix(grams)
    sets = []
    for a, n in zip(offsets[:-1].tolist(), size.tolist()):
        if n >= n_words:
            s = grams[a : a + n - n_words + 1]
            s.sort()
            sets.append(s[np.diff(s, prepend=~s[:1]) != 0])
        else:  # fewer words are one n-gram, all of them
            g = n
            for w in word[a : a + n].tolist():
                g = (g * int(FACTOR) + w) & 0xFFFFFFFFFFFFFFFF
            sets.append(mix(np.array([g] * (n > 0), np.uint64)))
    row = np.repeat(np.arange(len(texts)), [len(s) for s in sets])
    return row, np.concatenate(sets) if sets else grams


def _book(n_words: int, owners: int, bits: int):
    """For each chunk of texts one row about its documents, and for each owner a list of the chunk's n-grams, cut to ``bits``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, done, number = TaskContext.get().partitionId() << 33, 0, 0
        for some in chunks(batches, "text", CHUNK):
            row, grams = ngram_sets([x.encode() for x in some["text"]], n_words)
            n = np.bincount(row, minlength=len(some))
            edges = np.concatenate([[0], np.cumsum(n)])
            sums = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[edges]).view(np.int64)
            s1, s2 = sums(mix(grams)), sums(mix(grams ^ FACTOR))
            order = np.argsort(grams)
            short = grams[order] >> np.uint64(64 - bits)
            new = np.diff(short, prepend=~short[:1]) != 0
            slot = np.empty(len(grams), np.uint64)
            slot[order] = np.cumsum(new) - 1
            short = short[new]
            rid = base + done + np.arange(len(some))
            done += len(some)
            keys = np.stack([rid, some["doc"].to_numpy(np.int64), some["th"].to_numpy(np.int64), n, s1, s2])
            # slots rise within a document, and documents follow each other
            slots = np.array([len(short)], np.int64).tobytes() + rice.encode(slot + row.astype(np.uint64) * np.uint64(len(short)))
            owner = ((short >> np.uint64(bits - 32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.diff(owner, prepend=-1))
            lists = [rice.encode(short[a:b]) for a, b in zip(at, np.append(at[1:], len(short)))]
            yield pd.DataFrame({
                "kind": ["set"] + ["list"] * len(at), "chunk": base + number, "owner": [-1, *owner[at]],
                "keys": [keys.tobytes()] + [None] * len(at), "coded": [slots, *lists],
            })
            number += 1

    return run


def _answers(lists: pd.DataFrame) -> pd.DataFrame:
    """One owner: a bitmap for each chunk's list, set where another chunk has the n-gram too."""
    each = [rice.decode(x) for x in lists["coded"]]
    size = [len(x) for x in each]
    every = np.concatenate(each)
    order = np.argsort(every)
    every = every[order]
    twice = np.concatenate([[False], every[1:] == every[:-1], [False]])
    shared = np.empty(len(every), bool)
    shared[order] = twice[1:] | twice[:-1]
    maps = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(size)[:-1])]
    return pd.DataFrame({"chunk": lists["chunk"], "owner": lists["owner"], "n": size, "bits": maps})


def _summed(sets: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The documents of a chunk, and whether enough of their n-grams are shared for a link."""
    out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("rid", "doc", "th", "n", "s1", "s2")}).assign(core=False)]
    answers = answers.sort_values("owner")
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for n, b in zip(answers["n"], answers["bits"])]
    for keys, coded in zip(sets["keys"], sets["coded"]):
        rid, doc, th, n, s1, s2 = np.frombuffer(keys, np.int64).reshape(6, -1)
        width = int(np.frombuffer(coded[:8], np.int64)[0])
        row = np.repeat(np.arange(len(n)), n)
        slot = (rice.decode(coded[8:]) - row.astype(np.uint64) * np.uint64(width)).astype(np.int64)
        shared = np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool) | (np.bincount(slot, minlength=width) > 1)
        s = np.bincount(row, shared[slot], minlength=len(n))
        out.append(pd.DataFrame({"rid": rid, "doc": doc, "th": th, "n": n, "s1": s1, "s2": s2, "core": (n > 0) & (5 * s >= 4 * n)}))
    return pd.concat(out)


def judged(rows: DataFrame, n_words: int = WORDS) -> DataFrame:
    """Every row of ``rows`` (doc, th, text): rid, doc, th, n (set size), s1, s2 (digest of the set) and core: whether it
    may have a link. Rows without a link may be core; rows with one always are."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // OWNED)
    bits = min(64, max(32, math.ceil(math.log2(total / 4 + 1)) + 8))  # so that few n-grams look shared by chance
    book = written(rows.mapInPandas(_book(n_words, owners, bits), BOOK), "jaccard-book", "kind")
    lists = book.filter("kind = 'list'").select("chunk", "owner", "coded").repartition(owners, "owner")
    answers = lists.groupBy("owner").applyInPandas(_answers, "chunk long, owner long, n long, bits binary")
    sets = book.filter("kind = 'set'").select("chunk", "keys", "coded")
    return written(sets.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_summed, ROWS), "jaccard-rows")


def _exploded(n_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in chunks(batches, "text", CHUNK):
            row, grams = ngram_sets([x.encode() for x in some["text"]], n_words)
            yield pd.DataFrame({"rid": some["rid"].to_numpy()[row], "n": some["n"].to_numpy()[row], "gram": grams.view(np.int64)})

    return run


def linkable(heads: DataFrame, rows: DataFrame, n_words: int) -> DataFrame:
    """(rid, n, s, score, grams) of the classes ``heads`` (rid, doc, th, n): n-grams that other classes hold too, rare ones
    first, of classes with enough of them for a link. score: how common they are."""
    texts = rows.hint("merge").join(heads, ["doc", "th"]).groupBy("rid", "n").agg(F.any_value("text").alias("text"))  # a row may repeat
    grams = written(texts.mapInPandas(_exploded(n_words), "rid long, n long, gram long"), "jaccard-grams")
    held = grams.groupBy("gram").agg(F.count("*").alias("held")).filter("held > 1")
    own = grams.hint("merge").join(held, "gram").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("own"))
    own = own.withColumn("s", F.size("own")).filter("5 * s >= 4 * n")
    score = F.expr("aggregate(own, 0D, (a, x) -> a + x.held) / n")
    return written(own.select("rid", "n", "s", score.alias("score"), F.expr("own.gram").alias("grams")), "jaccard-core")


def _fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(rid, f, n, part): the n-grams of a set that lie in each fragment, sorted."""
    cuts = np.array([i * (1 << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)
    for batch in batches:
        for at in range(0, len(batch), 256):
            out = []
            for rid, n, grams in zip(*(batch[c].iloc[at : at + 256] for c in ("rid", "n", "grams"))):
                grams = np.sort(np.asarray(grams, np.int64).view(np.uint64))
                for f, part in enumerate(np.split(grams, np.searchsorted(grams, cuts))):
                    out.append((rid, f, n, part.tobytes()))
            yield pd.DataFrame(out, columns=["rid", "f", "n", "part"])


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Overlap of each pair in one fragment."""
    for batch in batches:
        common = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(batch["px"], batch["py"])]
        yield pd.DataFrame({"x": batch["x"], "y": batch["y"], "common": common, "size": batch["nx"] + batch["ny"]})


def overlaps(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(x, y, common, size) of ``pairs`` (x, y): shared n-grams and the sum of both set sizes. A set y with many
    pairs comes in several copies, so that no task gets them all."""
    many = pairs.groupBy("y").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("copies"))
    y = fragments.join(many, F.col("rid") == F.col("y")).select("y", "f", F.col("n").alias("ny"), F.col("part").alias("py"), F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"))
    x = pairs.join(many, "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("copies")).cast("int").alias("copy"))
    x = x.join(fragments.select(F.col("rid").alias("x"), "f", F.col("n").alias("nx"), F.col("part").alias("px")), "x")
    parts = x.join(y, ["y", "f", "copy"]).mapInPandas(_partial, "x long, y long, common long, size long")
    return parts.groupBy("x", "y").agg(F.sum("common").alias("common"), F.max("size").alias("size"))


def may_link(x: str, y: str) -> str:
    """SQL on two postings of one n-gram: sizes, shared n-grams and places leave room for a link, and the n-gram is in
    the prefix that the shorter set needs."""
    return f"""5 * least({x}.n, {y}.n) >= 4 * greatest({x}.n, {y}.n)
        AND 9 * least({x}.s, {y}.s) >= 4 * ({x}.n + {y}.n)
        AND CASE WHEN {x}.n > {y}.n OR {x}.n = {y}.n AND {x}.rid > {y}.rid THEN {y}.short ELSE {x}.short END
        AND 9 * (least({x}.place, {y}.place) + least({x}.s - {x}.place, {y}.s - {y}.place)) >= 4 * ({x}.n + {y}.n)"""


def near_enough(k: int) -> str:
    """SQL on two postings whose common n-grams with their central set of round k are known: if it is one and the same set, each
    n-gram that both hold is in it for both, or outside it for both, which leaves room for a link."""
    at_most = f"least(o.common{k}, m.common{k}) + least(o.s - o.common{k}, m.s - m.common{k})"
    return f"coalesce(o.hub{k} <> m.hub{k} OR 9 * ({at_most}) >= 4 * (o.n + m.n), true)"


def hub_pairs(at: DataFrame, turn) -> DataFrame:
    """(x, y): for each set the most central one of another component that its prefix shares the most n-grams with."""
    hubs = at.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("score", turn.alias("turn"), "rid", "n", "s", "root")).alias("hub")).filter("lo < hi")
    near = at.join(hubs.select("gram", "hub"), "gram").filter(
        "root <> hub.root AND 5 * least(n, hub.n) >= 4 * greatest(n, hub.n) AND 9 * least(s, hub.s) >= 4 * (n + hub.n)"
    )
    near = near.groupBy(F.col("rid").alias("x"), F.col("hub.rid").alias("y")).agg(F.count("*").alias("shared"), F.max("hub.score").alias("score"))
    return near.groupBy("x").agg(F.max(F.struct("shared", "score", "y"))["y"].alias("y"))


def between_components(at: DataFrame, counted: list[DataFrame]) -> DataFrame:
    """(x, y): every pair of different components that could link. An n-gram's postings in the component that has the most
    of them meet the others, never each other. ``counted``: by round, common n-grams of sets x with a central set y."""
    for k, c in enumerate(counted):
        at = at.join(c.select(F.col("x").alias("rid"), F.col("y").alias(f"hub{k}"), F.col("common").alias(f"common{k}")), "rid", "left")
    near = " AND ".join(["true", *map(near_enough, range(len(counted)))])
    sizes = at.groupBy("gram", "root").agg(F.count("*").alias("k"))
    main = sizes.groupBy("gram").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root"))["root"].alias("main")).filter("roots > 1")
    some = written(at.join(main.select("gram", "main"), "gram"), "jaccard-between")
    few = some.filter("root <> main")
    pairs = few.alias("o").join(some.alias("m"), F.expr(f"o.gram = m.gram AND o.root <> m.root AND (m.root = m.main OR o.rid > m.rid) AND {may_link('o', 'm')} AND {near}"))
    return pairs.select(F.greatest("o.rid", "m.rid").alias("x"), F.least("o.rid", "m.rid").alias("y")).distinct()


def rooted(core: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """(node, root) of the sets that link, by component; None where no two of them share a prefix."""
    fragments = written(core.select("rid", "n", "grams").mapInPandas(_fragments, "rid long, f int, n long, part binary"), "jaccard-fragments")
    prefix = F.posexplode(F.expr("slice(grams, 1, CAST(s - ceil(4 * n / 5) + 1 AS int))")).alias("place", "gram")
    posted = core.select("rid", "n", "s", "score", prefix).withColumn("short", F.expr("place < s - ceil(8 * n / 9) + 1"))
    posted = written(posted, "jaccard-postings")
    edges, tried, roots, counted = None, None, None, []
    for k in range(rounds + 1):
        at = posted.withColumn("root", F.col("rid"))
        if roots is not None:
            at = posted.join(roots, F.col("rid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rid")).drop("node")
        pairs = between_components(at, counted) if k == rounds else hub_pairs(at, F.xxhash64(F.lit(k), "rid"))
        if tried is not None:
            pairs = pairs.join(tried, F.expr("greatest(x, y) = a AND least(x, y) = b"), "left_anti")
        pairs = written(pairs, "jaccard-pairs")
        if pairs.isEmpty():
            if k == rounds:
                break
            continue
        counted.append(written(overlaps(pairs, fragments), "jaccard-counted"))
        found = counted[-1].filter(LINKS).select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = found if edges is None else edges.union(found)
        done = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        tried = done if tried is None else tried.union(done)
        roots = written(components(edges), "jaccard-roots")
    return roots


def near_duplicates(docs: DataFrame, n_words: int = WORDS, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, doc, th, kept of every row of ``docs``: documents link at a Jaccard similarity of
    0.8 or more, and component_id is the smallest id that links reach. A text with fewer words is one n-gram;
    a null text, or one without words, links with nothing. Rows are judged one by one, also those that repeat an id.
    ``numbered`` gives doc and th, the key of a row; kept is true for one row of each component, the first by id and key.
    Columns of ``docs`` other than the two named are not read, so their names do not matter; texts of any length count whole.
    """
    rows = numbered(docs, id_col, text)
    every = judged(rows, n_words)
    classes = every.filter("core").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc", "th", "rid")).alias("least"), F.count("*").alias("size"))
    classes = written(classes, "jaccard-classes")
    heads = classes.select("least.rid", "least.doc", "least.th", "n")
    roots = rooted(linkable(heads, rows, n_words), rounds)
    named = classes.select("s1", "s2", "n", "size", "least", F.col("least").alias("first"))
    if roots is not None:
        named = classes.join(roots, F.col("least.rid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "least.rid"))
        first = named.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members"))
        named = by_group(named, written(first, "jaccard-first"), ["root"], "members").select("s1", "s2", "n", "size", "first")
    linked = by_group(every.filter("core"), written(named.select("s1", "s2", "n", "size", "first"), "jaccard-named"), ["s1", "s2", "n"], "size")
    alone = every.filter("NOT core").withColumn("first", F.struct("doc", "th", "rid"))
    columns = ("doc", "th", "rid", "n", "first")
    return linked.select(*columns).unionByName(alone.select(*columns)).select(
        F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("first.doc", F.lit(NULL_ID)).alias("component_id"),
        "doc", "th", (F.col("first.rid") == F.col("rid")).alias("kept"),
    )


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document with the component of near duplicates it belongs to."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")

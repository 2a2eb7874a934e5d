"""Merkle manifest of a dataset by checkpoint and recompute.

Leaves are hashes of rows. Within a group (a source) they ascend by id, and every ``ARITY`` consecutive nodes become
one node of the next level until one is left; the groups' roots form a tree of their own in the same way. Only every
third level is stored: the leaves, the nodes above 4096 leaves, the nodes above 4096 of those, and so on. A block is an
aligned subtree of up to 4096 stored nodes. Proofs come from above: a block gets the path from its own node to the
root, makes the two levels in between again from its stored nodes, emits the siblings of each node and forgets them.

Every exchange is by (group, block), so a group that holds a third of all rows is as many blocks as others, and a task
holds one block at a time. Positions in a group are a prefix sum over sorted partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.shared import written

ARITY = 16
#: Levels from one stored level to the next, and the stored nodes of an aligned subtree.
STEP = 3
BLOCK = ARITY**STEP
#: Rows of a batch that goes back to Spark.
BATCH = 4096

NODE = "grp string, pos long, digest binary"
PLACED = "grp string, item long, digest binary, changed binary, part int, first boolean, pos long"
PATHS = "grp string, block long, head binary"
PROOFS = "doc_id long, leaf binary, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def coded(value):
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id, source, lang, n_chars, text):
    """Digest of a row: 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(coded(x) for x in (doc_id, source, lang, n_chars, text))), 256))


def tampered(doc_id):
    """Rows of the tampering test: those with an id whose CRC is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each sorted row in this partition's run of its group; ``first`` marks the run that an earlier partition may have begun."""
    part, group, place, run = TaskContext.get().partitionId(), None, 0, -1
    for batch in batches:
        firsts, places = [], []
        for g in batch.column("grp").to_pylist():
            if run < 0 or g != group:
                group, place, run = g, 0, run + 1
            firsts.append(run == 0)
            places.append(place)
            place += 1
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("grp", "item", "digest", "changed")), pa.array([part] * n, pa.int32()), pa.array(firsts, pa.bool_()), pa.array(places, pa.int64())],
            names=["grp", "item", "digest", "changed", "part", "first", "pos"],
        )


def positioned(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` (grp, item, digest, changed, order columns) with pos, 0 and up within grp, in ``order``; stored as the lowest level.

    Rows are sorted into ranges, so a large group spans many. Only a range's first group can have begun earlier, so there is one
    offset for each range at most, and that table is broadcast.
    """
    by = ["grp", *order]
    dealt = nodes.repartitionByRange(*by).sortWithinPartitions(*by).select("grp", "item", "digest", "changed")
    stored = written(dealt.mapInArrow(_places, PLACED), "merkle-level")
    runs = stored.groupBy("grp", "part", "first").agg(F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("offset", F.sum("n").over(before)).filter("first AND offset > 0").select(F.col("part").alias("of_part"), "offset")
    joined = stored.join(F.broadcast(offsets), (F.col("part") == F.col("of_part")) & F.col("first"), "left")
    return joined.select("grp", "item", "digest", "changed", (F.col("pos") + F.coalesce("offset", F.lit(0))).alias("pos"))


def digest(text: bytes) -> bytes:
    """SHA-256 as hexadecimal text."""
    return hashlib.sha256(text).hexdigest().encode()


def interior(nodes: list[bytes], block: int) -> list[list[bytes]]:
    """The levels of an aligned subtree from its stored nodes (hexadecimal) to its own node. A group's only block ends where one
    node is left; the blocks of a larger group always take ``STEP`` levels, also when the last one holds a single node."""
    levels = [nodes]
    for _ in range(STEP):
        below = levels[-1]
        if len(below) == 1 and block == 0 and len(nodes) < BLOCK:
            break
        levels.append([digest(b"".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[bytes]], i: int) -> list[tuple[int, bytes]]:
    """For each level below the subtree's own node, the place of node ``i``'s ancestor in its run and the others of that run."""
    found = []
    for level in levels[:-1]:
        own, run = i % ARITY, b"".join(level[i - i % ARITY : i - i % ARITY + ARITY])
        found.append((own, run[: 64 * own] + run[64 * own + 64 :]))
        i //= ARITY
    return found


def folded(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """What a node and the siblings on its path make of the root."""
    for own, others in path:
        node = digest(others[: 64 * own] + node + others[64 * own :])
    return node


def packed(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes((own, len(others) // 64)) + bytes.fromhex(others.decode()) for own, others in path)


def unpacked(data: bytes) -> list[tuple[int, bytes]]:
    path, at = [], 0
    while at < len(data):
        own, n = data[at], data[at + 1]
        path.append((own, data[at + 2 : at + 2 + 32 * n].hex().encode()))
        at += 2 + 32 * n
    return path


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """The rows of one block after the other; positions are gapless, so a block begins where they are divisible by its size. A row
    at -1 belongs to the block behind it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            pos = row[1]
            if held and (pos < 0 or (pos % BLOCK == 0 and held[-1][1] >= 0)):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of each block."""
    out: list[tuple] = []
    for rows in _blocks(batches, ["grp", "pos", "digest"]):
        block = rows[0][1] // BLOCK
        out.append((rows[0][0], block, bytes.fromhex(interior([r[2].hex().encode() for r in rows], block)[-1][0].decode())))
        if len(out) >= BATCH:
            yield _batch(out, ["grp", "pos", "digest"], [pa.string(), pa.int64(), pa.binary()])
            out = []
    if out:
        yield _batch(out, ["grp", "pos", "digest"], [pa.string(), pa.int64(), pa.binary()])


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


#: A head is the group's root, the root of all and the path between a block's node and the latter.
HEAD = 64


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A head for every stored node, from the head of its block."""
    out, types = [], [pa.string(), pa.int64(), pa.binary()]
    for rows in _blocks(batches, ["grp", "pos", "digest", "head"]):
        (grp, _, _, head), nodes = rows[0], rows[1:]
        levels = interior([r[2].hex().encode() for r in nodes], nodes[0][1] // BLOCK)
        for i, r in enumerate(nodes):
            out.append((grp, r[1], head[:HEAD] + packed(siblings(levels, i)) + head[HEAD:]))
            if len(out) >= BATCH:
                yield _batch(out, ["grp", "block", "head"], types)
                out = []
    if out:
        yield _batch(out, ["grp", "block", "head"], types)


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proof and verification of every leaf, from the head of its block."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    out, types = [], [pa.int64(), pa.binary(), *[pa.string()] * 4, pa.bool_()]
    for rows in _blocks(batches, ["grp", "pos", "digest", "head", "item", "changed"]):
        head, nodes = rows[0][3], rows[1:]
        subroot, root, upper = head[:32].hex(), head[32:HEAD].hex(), unpacked(head[HEAD:])
        above = b"".join(others for _, others in upper)
        levels = interior([r[2].hex().encode() for r in nodes], nodes[0][1] // BLOCK)
        whole = folded(levels[-1][0], upper)  # what every leaf that folds to the block's node goes on to
        for i, (_, _, own, _, item, changed) in enumerate(nodes):
            path = siblings(levels, i)
            node = folded((own if changed is None else changed).hex().encode(), path)
            node = whole if node == levels[-1][0] else folded(node, upper)
            proof = digest(b"".join(others for _, others in path) + above)
            out.append((item, own, subroot, root, proof.decode(), node.decode(), node.decode() == root))
            if len(out) >= BATCH:
                yield _batch(out, names, types)
                out = []
    if out:
        yield _batch(out, names, types)


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _with_heads(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes by block, each block behind its head."""
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    both = nodes.withColumn("block", block).unionByName(heads.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)
    return both.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def stored_levels(lowest: DataFrame) -> list[DataFrame]:
    """``lowest`` and every stored level above it; the last one has a single node for each group."""
    levels, last = [lowest], lowest.agg(F.max("pos")).first()[0]
    while len(levels) == 1 or last:
        levels.append(written(_by_block(levels[-1].select("grp", "pos", "digest")).mapInArrow(_above, NODE), "merkle-level"))
        last = (last or 0) // BLOCK
    return levels


def _descend(levels: list[DataFrame], heads: DataFrame) -> DataFrame:
    """Heads of the blocks of ``levels[0]``, from those of the highest nodes (block 0 of each group)."""
    for nodes in reversed(levels[1:-1]):
        heads = _with_heads(nodes.select("grp", "pos", "digest"), heads).mapInArrow(_below, PATHS)
    return heads


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (digests as hexadecimal text).

    A row is hashed over doc_id, source, lang, n_chars and text; other columns are not read, so their names do not matter. Nulls
    in any column count as such: a null source is a group, which comes first; null ids come first in their group and
    are never tampered with. Rows that repeat an id are ordered by their digests; rows equal in everything are leaves
    of their own, in any order, which makes no difference to a digest. Texts of any length are hashed whole. An empty table
    gives an empty result.
    """
    c = {x: F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")}
    lower = F.translate(c["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = docs.select(
        c["source"].cast("string").alias("grp"), c["doc_id"].cast("long").alias("item"), leaf(**c).alias("digest"),
        F.when(tampered(c["doc_id"]), leaf(**c | {"text": lower})).alias("changed"),
    )
    lowest = positioned(written(leaves, "merkle-leaves"), "item", "digest")
    levels = stored_levels(lowest)
    one, empty = F.lit("").alias("grp"), F.lit(None).cast("binary").alias("changed")
    groups = levels[-1].select(one, F.col("grp").alias("source"), "digest")
    # groups carry their place as the item; their names come back by it
    named = written(groups.repartitionByRange("source").sortWithinPartitions("source").withColumn("item", F.monotonically_increasing_id()), "merkle-groups")
    top = stored_levels(positioned(named.select("grp", "item", "digest", empty), "item"))
    start = top[-1].select("grp", F.lit(0).cast("long").alias("block"), F.concat("digest", "digest").alias("head"))
    lowest_heads = _descend(top, start)
    of_groups = _with_heads(top[0].select("grp", "pos", "digest"), lowest_heads).mapInArrow(_below, PATHS)
    places = top[0].select("item", F.col("pos").alias("block"))
    heads = (
        named.select("item", "source", F.col("digest").alias("subroot")).join(places, "item").join(of_groups.select("block", "head"), "block")
        .select(F.col("source").alias("grp"), F.lit(0).cast("long").alias("block"), F.expr("concat(subroot, substr(head, 33))").alias("head"))
    )
    found = _with_heads(lowest.select("grp", "pos", "digest", "item", "changed"), _descend(levels, heads)).mapInArrow(_proofs, PROOFS)
    return found.withColumn("leaf", F.lower(F.hex("leaf")))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its leaf, its roots, its proof and whether it stands up to tampering."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Exact duplicates by a Golomb-coded exchange of fingerprints.

1. Each partition, in blocks of rows, fingerprints its documents (64 bits of the SHA-256 of the normalised text),
   sorts the distinct fingerprints and sends each owner of a fingerprint range one Golomb-Rice coded list.
2. An owner answers with one bitmap per list: which of these fingerprints other blocks have too.
   A fingerprint is sent once per block however often it occurs there, so a group of copies
   that holds a third of all rows costs an owner no more than one entry per block.
3. Of each block the fingerprints and the suspects among them (whose fingerprint occurs twice) are stored as a list and a bitmap.
   A second scan reads those of its own partition; texts that are no suspects go no further than the scan, suspects
   are shuffled with their texts and counted by their bytes, and those counts decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import rice
from folioflow.llm.shared import by_group, small_batches, written
from folioflow.storage import scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Fingerprints an owner gets on average, at most.
OWNED = 1 << 20
#: Rows of a block: about 60 bytes each, without their texts.
BLOCK_ROWS = 1 << 19

#: Partitions of the scan whose marks are one file.
TOGETHER = 64

JUDGED = "kind string, block long, slot long, doc_id long, n_points long, sha binary, suspect boolean, seq long, prints binary, bits binary"
LEDGER = "kind string, block long, slot long, doc_id long, n_points long, sha binary, local boolean, owner long, payload binary"


def normalised(text):
    """Without the characters \\x20 and \\x09 to \\x0D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _ledger(owners: int):
    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = [], 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                held.append(batch.iloc[at : at + BLOCK_ROWS])
                if sum(map(len, held)) >= BLOCK_ROWS:
                    yield from block_of(pd.concat(held, ignore_index=True), number)
                    held, number = [], number + 1
        if held:
            yield from block_of(pd.concat(held, ignore_index=True), number)

    def block_of(rows: pd.DataFrame, number: int) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32 | number
        head = np.frombuffer(b"".join(x[:8] for x in rows["sha"]), ">u8").astype(np.uint64)
        prints, slot, count = np.unique(head, return_inverse=True, return_counts=True)
        yield rows.assign(kind="row", block=block, slot=slot.astype(np.int64), local=count[slot] > 1, owner=0, payload=None)
        owner = ((prints >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(starts[1:], len(prints))
        yield pd.DataFrame({
            "kind": "message", "block": block, "slot": starts, "doc_id": None, "n_points": 0, "sha": None, "local": False,
            "owner": owner[starts], "payload": [rice.encode(prints[a:b]) for a, b in zip(starts, ends)],
        })

    return partition


def _answers(messages: pd.DataFrame) -> pd.DataFrame:
    """One owner: a bitmap for each list, set where another partition has the fingerprint too."""
    lists = [rice.decode(x) for x in messages["payload"]]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    maps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"block": messages["block"], "slot": messages["slot"], "n": [len(x) for x in lists], "bits": maps})


def _suspects(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """One block's rows, those with a duplicate here or elsewhere marked, and its marks: fingerprints with a bit for each."""
    n = int(rows["slot"].max()) + 1 if len(rows) else 0
    hit, prints, slot = np.zeros(n, bool), np.zeros(n, np.uint64), rows["slot"].to_numpy(np.int64)
    for first, count, bits in zip(answers["slot"], answers["n"], answers["bits"]):
        hit[first : first + count] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)
    prints[slot] = np.frombuffer(b"".join(x[:8] for x in rows["sha"]), ">u8")
    hit[slot[rows["local"].to_numpy(bool)]] = True
    own = rows[["block", "slot", "doc_id", "n_points", "sha", "seq"]].assign(kind="row", suspect=hit[slot], prints=None, bits=None)
    marks = {"kind": "marks", "block": key[0], "slot": 0, "doc_id": None, "n_points": 0, "sha": None, "seq": 0, "suspect": False, "prints": rice.encode(prints), "bits": np.packbits(hit).tobytes()}
    return pd.concat([own.astype({"doc_id": object}), pd.DataFrame([marks], dtype=object)])[[x.split(" ")[0] for x in JUDGED.split(", ")]] if n else own


def _marked(path: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the blocks that the first scan made of a partition, sorted, and which are suspects."""
    system, inner = fs.FileSystem.from_uri(f"{path}/bundle={part // TOGETHER}")
    found = [(np.zeros(0, np.uint64), np.zeros(0, bool))]
    if system.get_file_info(inner).type != fs.FileType.NotFound:
        rows = ds.dataset(inner, filesystem=system, format="parquet").to_table(columns=["prints", "bits"], filter=ds.field("part") == part)
        for prints, bits in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            own = rice.decode(prints)
            found.append((own, np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)))
    prints, hit = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(prints, kind="stable")
    return prints[order], hit[order]


def suspects_of(docs: DataFrame, marks: str):
    """Column condition over a fingerprint (long): false only for one that a block of this task's partition has and that occurs nowhere else. A
    document that lies in another partition than in the first scan is not found, and counts as a suspect: that costs a shuffle, no result."""

    @F.pandas_udf("boolean")
    def suspect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        prints, hit = _marked(marks, TaskContext.get().partitionId())
        for batch in batches:
            own = batch.to_numpy(np.int64).view(np.uint64)
            at = np.searchsorted(prints, own)
            there = np.zeros(len(own), bool)
            inside = at < len(prints)
            there[inside] = prints[at[inside]] == own[inside]
            there[there] = ~hit[at[there]]
            yield pd.Series(~there)

    return suspect


def store_marks(book: DataFrame) -> str:
    """Where the marks of ``book`` lie, by partition of the first scan."""
    path, part = scratch(book.sparkSession, "exact-marks"), F.shiftright("block", 32)
    marks = book.filter("kind = 'marks'").select(part.alias("part"), "prints", "bits", F.floor(part / TOGETHER).cast("long").alias("bundle"))
    marks.repartition("bundle").sortWithinPartitions("bundle", "part").write.partitionBy("bundle").parquet(path)
    return path


def suspect_texts(docs: DataFrame, marks: str, text: str = "text") -> DataFrame:
    """The normalised texts (``norm``) of suspects, each row, from a scan of ``docs``."""
    norm = small_batches(docs).select(normalised(F.col(text)).alias("norm"))
    print_ = F.conv(F.substring(F.sha2("norm", 256), 1, 16), 16, -10).cast("long")
    return norm.withColumn("print", print_).filter(suspects_of(docs, marks)(F.col("print"))).select("norm")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_points (code points of the text).

    Texts are equal when they are after deleting white space (``normalised``). The row with the most
    code points stays, then the smallest id. Empty and null texts are equal to each other. A repeated id is
    a row of its own (of equal rows one has kept = true); a null id comes after all others. Other columns of
    ``docs`` are not read, so their names do not matter; texts of any length count whole.
    """
    spark = docs.sparkSession
    n_rows = docs.select(id_col).count()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // OWNED + 1)
    norm = normalised(F.col(text))
    narrow = small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"),
        F.unhex(F.sha2(norm, 256)).alias("sha"),
    )
    book = written(narrow.mapInPandas(_ledger(owners), LEDGER), "exact-ledger", "kind")
    # seq tells repeated rows of one block apart
    rows = book.filter("kind = 'row'").select("block", "slot", "doc_id", "n_points", "sha", "local", F.monotonically_increasing_id().alias("seq"))
    answers = (
        book.filter("kind = 'message'").select("block", "slot", "owner", "payload")
        .groupBy("owner").applyInPandas(_answers, "block long, slot long, n long, bits binary")
    )
    book = written(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_suspects, JUDGED), "exact-suspects", "kind")
    judged = book.filter("kind = 'row'").select("doc_id", "n_points", "sha", "suspect", "seq")
    suspects = judged.filter("suspect")
    texts = suspect_texts(docs, store_marks(book), text)
    equal = texts.groupBy("norm").agg(F.count("*").alias("group_size")).select(F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    best = suspects.groupBy("sha").agg(
        F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg"), (-F.col("seq")).alias("neg_seq"))).alias("best")
    )
    groups = written(equal.join(best, "sha").select("sha", "group_size", "best"), "exact-groups")
    out = by_group(suspects, groups, ["sha"], "group_size").select(
        "doc_id", (-F.col("best.neg")).alias("keep_id"), "group_size", (F.col("seq") == -F.col("best.neg_seq")).alias("kept"), "sha", "n_points"
    )
    alone = judged.filter("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "n_points")
    return out.unionByName(alone).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "n_points")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_points")

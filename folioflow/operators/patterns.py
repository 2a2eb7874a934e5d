"""Many fixed spellings found in many texts at once: each text is read once, by an automaton or, of very many spellings, by a sieve."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.sieve import sifted
from folioflow.storage import scratch

#: Spellings of one automaton at most, about 100 MB; more are looked for by a sieve and a join.
PART = 1 << 17

STORED = pa.schema([("side", pa.int32()), ("pattern", pa.string()), ("entry_id", pa.int32()), ("n", pa.int32()), ("place", pa.int32())])

#: The automata that this worker has built, by table; the last ones only.
_BUILT: dict[str, tuple] = {}


def _automata(path: str) -> tuple:
    """The automata of spellings as they are and of normalised keys, each from string to (entry, by, n, place)."""
    if path not in _BUILT:
        _BUILT.clear()
        system, inner = fs.FileSystem.from_uri(path)
        rows = ds.dataset(inner, STORED, filesystem=system, format="parquet").to_table(columns=STORED.names)
        found: tuple[dict, dict] = ({}, {})
        for side, pattern, entry, n, place in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            found[side].setdefault(pattern, []).append((entry, side, n, place))
        out = []
        for patterns in found:
            machine = ahocorasick.Automaton()
            for pattern, entries in patterns.items():
                machine.add_word(pattern, (pattern, entries))
            machine.make_automaton()
            out.append(machine if patterns else None)
        _BUILT[path] = tuple(out)
    return _BUILT[path]


def _search(path: str):
    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = _automata(path)
        for batch in batches:
            rows, places = [], []
            for i, texts in enumerate(zip(batch.column("low").to_pylist(), batch.column("norm").to_pylist(), strict=True)):
                best: dict[int, tuple] = {}
                for machine, text in zip(machines, texts, strict=True):
                    if machine is None or not text:
                        continue
                    for entries in {p: e for _, (p, e) in machine.iter(text)}.values():
                        for entry, *rank in entries:
                            best[entry] = min(best.get(entry, (2, 0, 0)), tuple(rank))
                places += [i] * len(best)
                rows += [(entry, *rank) for entry, rank in best.items()]
            if rows:
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(places)), *columns], names=["key", "entry_id", "by", "n", "place"])

    return partition


def occurrences(texts: DataFrame, patterns: DataFrame, part_size: int = PART) -> DataFrame:
    """(key, entry_id, by, n, place): for each text the entries that occur in it, with the least (by, n, place) of their spellings in it
    among the rows of an entry.

    ``texts``: key, low, norm; ``patterns``: entry_id, place, pattern, n, side (0: looked for in low, 1: in norm). Up to ``part_size``
    patterns are an automaton that every worker holds. Of more, a table of bits (``sieve``) tells which stretches of a text may be one, and
    only those are joined with the patterns, so a text is read once however many there are, and none leaves its task. Empty texts and an
    empty table of patterns give nothing; patterns may repeat and lie in each other.
    """
    spark = texts.sparkSession
    whole = [F.col(c).cast("int").alias(c) for c in ("side", "entry_id", "place")]
    rank = F.when(F.col("side") == 0, -F.col("n")).otherwise(0).cast("int").alias("n")
    path = scratch(spark, "patterns")
    patterns.select(*whole, rank, "pattern").write.parquet(path)
    stored = spark.read.schema("side int, entry_id int, place int, n int, pattern string").parquet(path)
    if stored.count() > part_size:
        return sifted(texts, stored).join(stored, ["side", "pattern"]).select("key", "entry_id", F.col("side").alias("by"), "n", "place")
    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "low", "norm").mapInArrow(_search(path), f"key {kind}, entry_id int, by int, n int, place int")

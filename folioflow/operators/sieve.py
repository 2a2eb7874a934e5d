"""A bit table of very many spellings, which sorts out the stretches of a text that may be one of them.

The table has bits for every spelling, for its head (its first four bytes, or all of a shorter one) and for its first 8, 16, 32 ... bytes. A
place of a text is looked at further only while the table has what stands there, so that most places end at their head, and
the time does not depend on how many spellings there are. What passes may still be wrong: it is joined with the spellings themselves.
The table has a largest size; beyond it more stretches pass, but none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.storage import scratch

#: Bits for each spelling, of the whole table at least and at most (128 MB), of the heads, and of a part that is made by itself (1 MB).
EACH, LEAST, MOST, HEADS, PART = 24, 1 << 20, 1 << 30, 1 << 24, 1 << 23
#: Bits of each entry.
PROBES = 3
#: Places of a text that are looked at together; bits that a task holds before it sends them.
STRETCH, HELD = 1 << 20, 1 << 21

#: The table that this worker has read last, by its path.
_READ: dict[str, np.ndarray] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _first(n: int) -> np.uint64:
    """A mask for the first ``n`` bytes of a word."""
    return np.uint64((1 << 8 * min(n, 8)) - 1)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of strings, the eight bytes from each of its places as a number, and where strings begin (and the last ends)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    if len(raw) > 8:
        raw[:-8] = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return raw, np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)), offsets - offsets[0]


def _heads(words: np.ndarray, side: int, n: int) -> np.ndarray:
    """The bits of the first ``n`` bytes, four at most."""
    return (_mixed((words & _first(n)) ^ np.uint64((8 * side + n) << 40)) & np.uint64(HEADS - 1)).astype(np.int64)


def _hashed(words: np.ndarray, at: np.ndarray, side: int, n: int, whole: bool) -> np.ndarray:
    """Of the ``n`` bytes from each of these places, as a spelling or as the beginning of one."""
    h = _mixed(np.full(1, 4 * n + 2 * side + whole, np.uint64))
    for step in [0] if n <= 8 else [*range(0, n - 8, 8), n - 8]:
        h = _mixed(h ^ (words[at + step] & _first(n)))
    return h


def _probes(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield HEADS + (((h >> np.uint64(32)) + np.uint64(i) * (h | np.uint64(1))) & np.uint64(size - 1)).astype(np.int64)


def _has(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _passing(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``h`` of the entries that the table may have."""
    at = np.arange(len(h))
    for bit in _probes(h, 8 * len(table) - HEADS):
        at = at[_has(table, bit[at])]
    return at


def _bits(size: int):
    """(part, bits) of batches of (side, pattern)."""
    schema = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held += of(batch)
            if held and (batch is None or sum(map(len, held)) >= HELD):
                yield rows(np.unique(np.concatenate(held)))
                held = []

    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        _, words, offsets = _words(batch.column("pattern"))
        sides, sizes = batch.column("side").to_numpy(), np.diff(offsets)
        for side, n in {*zip(sides.tolist(), sizes.tolist())}:
            at = offsets[:-1][(sides == side) & (sizes == n)]
            yield _heads(words[at], side, min(n, 4))
            yield from _probes(_hashed(words, at, side, n, True), size)
            for level in _levels(n):
                yield from _probes(np.unique(_hashed(words, at, side, level, False)), size)

    def rows(bits: np.ndarray) -> pa.RecordBatch:
        parts, starts = np.unique(bits // PART, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([x.astype(np.uint32).tobytes() for x in np.split(bits % PART, starts[1:])], pa.binary())], schema=schema)

    return partition


def _levels(n: int) -> list[int]:
    """The beginnings of a spelling of ``n`` bytes that the table has: 8, 16, 32 ... bytes."""
    return [1 << k for k in range(3, n.bit_length())]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of the table, of rows in order of the part."""
    part, table = None, np.zeros(0, bool)
    out = lambda: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())})
    for batch in batches:
        for k, bits in zip(batch.column("part").to_pylist(), batch.column("bits")):
            if k != part:
                if part is not None:
                    yield out()
                part, table = k, np.zeros(PART, bool)
            table[np.frombuffer(bits.as_buffer(), np.uint32)] = True
    if part is not None:
        yield out()


def _table(path: str, size: int) -> np.ndarray:
    """The table, read once in a worker."""
    if path not in _READ:
        _READ.clear()
        system, inner = fs.FileSystem.from_uri(path)
        table = np.zeros((HEADS + size) // 8, np.uint8)
        for batch in ds.dataset(inner, filesystem=system, format="parquet").to_batches(columns=["part", "bits"], batch_size=8):
            for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits")):
                at = part * (PART // 8)
                some = np.frombuffer(bits.as_buffer(), np.uint8)[: len(table) - at]
                table[at : at + len(some)] = some
        _READ[path] = table
    return _READ[path]


def _search(path: str, size: int, lengths: dict[int, list[int]]):
    def places(table: np.ndarray, words: np.ndarray, begin: int, end: int, side: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(places, length, hashes) of what the table has among the stretches that begin in a part of the text."""

        def passed(at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
            h = _hashed(words, at := at[at + n <= len(words) - 1], side, n, True)
            if len(ok := _passing(table, h)):
                yield at[ok], n, h[ok]

        own = lengths.get(side, [])
        for n in sorted({min(x, 4) for x in own}):
            at = begin + np.flatnonzero(_has(table, _heads(words[begin:end], side, n)))
            for x in own:
                if x == n or n == 4 <= x < 8:
                    yield from passed(at, x)
        if not own or own[-1] < 8:
            return
        for level in _levels(own[-1]):
            at = at[at + level <= len(words) - 1]
            at = at[_passing(table, _hashed(words, at, side, level, False))]
            for x in own:
                if level <= x < 2 * level:
                    yield from passed(at, x)

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path, size)
        for batch in batches:
            for side, name in enumerate(("low", "norm")):
                raw, words, offsets = _words(batch.column(name))
                for begin in range(0, len(words) - 1, STRETCH):
                    found = list(places(table, words, begin, min(begin + STRETCH, len(words) - 1), side))
                    if not found:
                        continue
                    at, h = np.concatenate([x[0] for x in found]), np.concatenate([x[2] for x in found])
                    n = np.repeat([x[1] for x in found], [len(x[0]) for x in found])
                    text = np.searchsorted(offsets, at, "right") - 1
                    # whole characters of one text
                    ok = np.flatnonzero((at + n <= offsets[text + 1]) & (raw[at] & 0xC0 != 0x80) & (raw[at + n] & 0xC0 != 0x80))
                    order = ok[np.lexsort((n[ok], h[ok], text[ok]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (np.diff(text[order]) != 0) | (np.diff(h[order]) != 0) | (np.diff(n[order]) != 0)
                    if len(order := order[new]):
                        some = [raw[a : a + k].tobytes().decode() for a, k in zip(at[order].tolist(), n[order].tolist())]
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(text[order])), pa.array([side] * len(some), pa.int32()), pa.array(some, pa.string())], names=["key", "side", "pattern"])

    return partition


def sifted(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, side, pattern): stretches of each text that may be a pattern, with all that are one, mostly once for each text.

    ``texts``: key, low, norm; ``patterns``: pattern, side (0: looked for in low, 1: in norm), stored, not empty.
    """
    known = patterns.select("side", "pattern").filter("pattern <> ''")
    lengths: dict[int, list[int]] = {}
    total = 0
    for side, n, count in known.groupBy("side", F.octet_length("pattern").alias("n")).count().orderBy("side", "n").collect():
        lengths.setdefault(side, []).append(n)
        total += count
    size = min(MOST, max(LEAST, 1 << (EACH * total).bit_length()))
    bits = known.mapInArrow(_bits(size), "part int, bits binary").repartition("part").sortWithinPartitions("part")
    path = scratch(texts.sparkSession, "sieve")
    bits.mapInArrow(_merged, "part int, bits binary").write.parquet(path)
    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "low", "norm").mapInArrow(_search(path, size, lengths), f"key {kind}, side int, pattern string")

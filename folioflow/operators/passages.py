"""Which texts hold a passage word for word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a passage's first window; a shorter passage takes the largest power of two that it holds.
WINDOW = 32
FACTOR, SPREAD = np.array([0x9E3779B97F4A7C15], np.uint64), np.uint64(0xD6E8FEB86659FD93)
FLAG_BITS = 20


def window_keys(text: bytes, sizes: set[int]) -> Iterator[np.ndarray]:
    """For each of ``sizes`` (0 or powers of two), the key of the window at every place of ``text``."""
    if 0 in sizes:
        yield np.zeros(1, np.uint64)
    at, size, power = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), 1, FACTOR
    while len(at):
        if size in sizes:
            yield (at + np.uint64(size)) * SPREAD
        if size >= max(sizes):
            return
        at = at[:-size] * power + at[size:]
        size, power = 2 * size, power * power


def first_window(passage: str) -> tuple[int, int]:
    """(key, size) of a passage's first window."""
    head = passage.encode()
    size = min(WINDOW, 1 << len(head).bit_length() >> 1)
    return (int(next(window_keys(head[:size], {size}))[0].view(np.int64)), size)


def holders(passages: DataFrame, docs: DataFrame, passage: str = "query", text: str = "text") -> DataFrame:
    """Every pair of a row of ``passages`` and a row of ``docs`` whose text contains the passage, wherever it starts.

    The keys of the passages' first windows (16 bytes a passage) go to all tasks; a text that has such a window at any
    place becomes a candidate, and ``contains`` decides. Null texts and passages have no pairs.
    """

    @F.pandas_udf("struct<key: long, size: int>")
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(None, None) if x is None else first_window(x) for x in batch], columns=["key", "size"]).astype("Int64")

    keyed = passages.withColumn("_first", first(F.col(passage))).withColumn("_key", F.col("_first.key"))
    known = keyed.select("_key", "_first.size").distinct().filter("_key IS NOT NULL").toPandas()
    told = passages.sparkSession.sparkContext.broadcast((np.sort(known["_key"].to_numpy(np.int64).view(np.uint64)), {int(x) for x in known["size"]}))

    @F.pandas_udf("array<long>")
    def shared(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys, sizes = told.value
        flags = np.zeros(1 << FLAG_BITS, bool)
        flags[keys >> np.uint64(64 - FLAG_BITS)] = True

        def of(x: str | None) -> np.ndarray:
            found = [np.zeros(0, np.uint64)]
            for own in window_keys(x.encode(), sizes) if x is not None and sizes else ():
                own = own[flags[own >> np.uint64(64 - FLAG_BITS)]]
                found.append(own[np.isin(own, keys)] if len(own) else own)
            return np.unique(np.concatenate(found)).view(np.int64)

        for batch in batches:
            yield pd.Series([of(x) for x in batch], dtype=object)

    each = docs.withColumn("_keys", shared(F.col(text))).withColumn("_key", F.explode_outer("_keys")).drop("_keys").filter("_key IS NOT NULL")
    return each.join(keyed.drop("_first"), "_key").filter(F.contains(F.col(text), F.col(passage))).drop("_key")

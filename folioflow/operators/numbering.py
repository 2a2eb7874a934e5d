"""Consecutive numbers for rows without one task that sees them all: a prefix sum over partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.storage import written

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
PLACE_BITS = 33


def numbered(rows: DataFrame, into: str, start: int = 1) -> DataFrame:
    """``rows`` with ``into``: start, start + 1, ... in the order of partitions and of rows within them.

    The rows are written once with their partition and place; one count for each partition (as many rows as there
    are partitions, which bounds the window and the broadcast) then gives every partition its offset. An empty table
    stays empty; equal rows get numbers of their own.
    """
    placed = written(rows.withColumn(into, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(into, PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col(into).bitwiseAND((1 << PLACE_BITS) - 1)
    return placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn(into, place + F.col("_offset") + start).drop("_part", "_offset")


def running_totals(rows: DataFrame, number: str, *values: str, size: int = 1 << 16) -> DataFrame:
    """``rows`` (consecutive numbers in ``number``) with, for each of ``values``, ``before_`` and its name: the sum over all smaller numbers.

    Stretches of ``size`` numbers are summed first, and one row a stretch is summed up and broadcast; within a stretch a window
    does the rest. Give it narrow rows: they are dealt out once by stretch.
    """
    stretch = F.floor(F.col(number) / size).cast("long")
    placed = rows.withColumn("_stretch", stretch)
    sums = placed.groupBy("_stretch").agg(*(F.sum(v).alias(v) for v in values))
    whole = Window.partitionBy(F.lit(0)).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_stretch", *(F.coalesce(F.sum(v).over(whole), F.lit(0)).alias(f"_before_{v}") for v in values))
    own = Window.partitionBy("_stretch").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "_stretch")
    for v in values:
        out = out.withColumn(f"before_{v}", F.coalesce(F.sum(v).over(own), F.lit(0)) + F.col(f"_before_{v}"))
    return out.drop("_stretch", *(f"_before_{v}" for v in values))

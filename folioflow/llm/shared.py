"""What the operators share: tables written to cut lineage, and joins that split large groups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.storage import written  # noqa: F401

#: Bytes of a batch that a Python worker gets at once, which Spark lets be 64 MB.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Groups that one side of ``by_group`` may hold more than this share of the rows each, at most so many of them.
LARGE = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on gives Python workers batches of BATCH_BYTES at most, however long its texts are."""
    conf = df.sparkSession.conf
    held = re.fullmatch(r"(\d+)b?", str(conf.get(BATCH_CONF)))
    if held is None or int(held[1]) > BATCH_BYTES:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def by_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` inner joined with ``groups`` (one row for each of ``keys``, ``size``: its rows). Groups with more than a thousandth of
    all rows, fewer than a thousand, are broadcast, so that no task gets the rows of one group; the others meet by their keys."""
    least = (groups.agg(F.sum(size)).first()[0] or 0) // LARGE
    large = groups.filter(F.col(size) > max(least, 1))
    split = rows.join(F.broadcast(large), keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(groups.filter(F.col(size) <= max(least, 1)).hint("merge"), keys)
    return split.unionByName(rest)

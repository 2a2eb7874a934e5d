"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of ``edges`` (a, b long).

    Each round takes the least label among a node and its neighbours, then the label of that label, and
    is written to the shared folder, so a lost executor costs one round. Only a count reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "components-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "components")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("root").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("at")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("onto"))
        labels = written(
            moved.join(jump, F.col("root") == F.col("via"), "left").select("node", F.least("root", F.coalesce("onto", "root")).alias("root"), "was"), "components"
        )
        if not labels.filter("root <> was").limit(1).count():
            return labels.select("node", "root")
        labels = labels.select("node", "root")

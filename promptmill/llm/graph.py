"""Connected components through joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of each node's component, for the nodes of ``edges`` (columns ``a`` and ``b``).

    Each round every node takes the least label around it and then that label's own label, so labels travel along paths in
    steps that double. A round moves one row per edge and node, combined before the shuffle; nothing but the number of changed
    labels reaches the driver. Self-loops and repeated edges are allowed; null ends are left out."""
    both = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = (labels.join(around, labels.node == around.a, "left")
                .select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        step = materialize(step)
        up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        following = materialize(step.join(up, "label", "left").select(
            "node", F.least("label", "above").alias("label"), "old"))
        changed = following.filter("label <> old").count()
        labels = following.select("node", "label")
        if not changed:
            return labels

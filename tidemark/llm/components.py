"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``component``, the least node it is linked to, from links ``a`` and ``b``.

    Each round, every node takes the least label among itself and its neighbours,
    and then the label of that label, so paths shrink by more than half.  Rounds
    are stored; a node of any degree is only aggregated, never gathered.  Nodes
    without a link are not in the result.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_near")), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        taken = labels.join(least, "node").select("node", "label", F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_jump"))
        moved = stored(
            taken.join(jump, "_new", "left").select(
                "node", F.least("_new", F.coalesce("_jump", "_new")).alias("label"), F.col("label").alias("_old")
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("label != _old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))

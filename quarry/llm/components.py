"""Connected components without gathering links, nodes or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (src, dst); component: its smallest node.

    Each round takes the smallest label among neighbours, then follows the label's own
    label (pointer jumping), so the rounds grow with the logarithm of the diameter.
    A hub (many links of one node, or one component's many nodes) is hot in a join only,
    and each join stands alone between an exchange of both sides and a checkpoint, so
    that a hot side is split; what is counted by node is reduced before its exchange.
    Rounds are cut by reliable checkpoints.
    """
    both = settle(links.select(F.col("src"), F.col("dst")).union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src != dst").distinct())
    labels = settle(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component"), F.lit(True).alias("moved")))
    while not labels.filter("moved").isEmpty():
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").select(F.col("src").alias("node"), F.col("component").alias("c"), F.lit(None).cast("long").alias("was"))
        own = labels.select("node", F.col("component").alias("c"), F.col("component").alias("was"))
        step = settle(near.union(own).groupBy("node").agg(F.min("c").alias("c"), F.max("was").alias("was")))
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("jump"))
        labels = settle(step.join(jump, "c").select("node", F.least("c", "jump").alias("component"), (F.least("c", "jump") != F.col("was")).alias("moved")))
    return labels.select("node", "component")

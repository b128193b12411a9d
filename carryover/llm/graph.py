"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``links`` (a, b).

    Each round takes the smallest label next door, then the label of that label, so chains
    shorten to half per round. Every round is written down: a lost executor costs its
    own tasks only. Minima combine map-side, so a node with many links is no hot key.
    """
    both = materialise(links.select(F.col("a"), F.col("b")).union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(both.a.alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = materialise(lower.join(jump, "label", "left")
                            .select("node", "before", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        if not after.where("before <> label").limit(1).count():
            return after.select("node", "label")
        labels = after.select("node", "label")

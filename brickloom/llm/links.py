"""Connected components of a table of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, component: the least node that each linked node reaches.

    Every round takes the least label among a node's neighbours and then the label of that label, so chains halve. Rounds end
    when nothing changes; no more than the count of changes reaches the driver.
    """
    both = stored(
        links.select(F.col("a").alias("node"), F.col("b").alias("peer"))
        .union(links.select(F.col("b").alias("node"), F.col("a").alias("peer")))
        .distinct()
    )
    labels = stored(both.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("component")))
    while True:
        seen = labels.select(F.col("node").alias("peer"), F.col("component").alias("theirs"))
        pulled = both.join(seen, "peer").groupBy("node").agg(F.min("theirs").alias("pulled"))
        near = labels.join(pulled, "node").withColumn("next", F.least("component", "pulled"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        step = stored(
            near.join(jump, "next", "left").select(
                "node", F.least("next", F.coalesce("beyond", "next")).alias("component"), F.col("component").alias("old")
            )
        )
        labels = step.select("node", "component")
        if step.filter("component <> old").limit(1).count() == 0:
            return labels

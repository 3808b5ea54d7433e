"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few_or_many


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``links`` (a long, b long): comp is the least node that it reaches.

    Each round takes the least label among neighbours, then that label's own label. All steps are joins and grouped
    minima with pre-aggregation; each round is written, so a lost executor costs one round at most. Only a count of
    changes reaches the driver. No links give no rows.
    """
    both = cut(
        links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(),
        "edges",
    )
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")), "labels")
    nodes = labels.count()
    while True:
        labels = few_or_many(labels, nodes)
        near = both.join(labels.select(F.col("node").alias("u"), F.col("comp").alias("c")), "u").groupBy("v").agg(F.min("c").alias("c"))
        lower = labels.join(near, labels["node"] == near["v"]).select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("at"), F.col("comp").alias("to"))
        # a label is a node's own name or that of a node it reaches, so it has a row in labels
        after = lower.join(jump, lower["comp"] == jump["at"]).select("node", "old", F.least("comp", "to").alias("comp"))
        after = cut(after, "labels")
        changed = after.where("comp < old").limit(1).count()
        labels = after.select("node", "comp")
        if not changed:
            return labels

"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import stored
from panelmill.runtime import release


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the long pairs ``a, b``; a component is called by its smallest node.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label, so the distance a label travels doubles.  Labels
    are stored after each round, and those of the round before are removed; the
    loop ends with the first round that changes none.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stored(ends.union(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("component").alias("offer"))
        offers = both.join(of_other, "other").groupBy("node").agg(F.min("offer").alias("offer"))
        near = labels.join(offers, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "offer").alias("near")
        )
        far = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        moved = stored(near.join(far, "near").select("node", "old", F.least("near", "far").alias("component")), "labels")
        release(labels)
        labels = moved.select("node", "component")
        if not moved.where("old <> component").take(1):
            release(both)
            return labels

"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import BROADCAST_ROWS, stash


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a long, b long) -> (node long, comp long): the smallest node that each node can reach.

    Labels go to neighbours, then labels of labels are followed (pointer jumping), so the rounds grow with the
    logarithm of a component's width. Each round is written to the shared folder; the driver sees one count. Hot
    nodes only widen partial aggregates and joins that can be split. No links: an empty result.
    """
    both = links.select("a", "b").filter("a <> b")
    edges = stash(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stash(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("comp")), "labels")
    small = labels.count() <= BROADCAST_ROWS  # the number of labels is that of nodes in every round
    side = F.broadcast if small else lambda df: df
    for _ in range(max_rounds):
        near = edges.join(side(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = near.join(side(labels), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        step = stash(hooked.join(side(jump), "via").select("node", "old", F.least("via", "far").alias("comp")), "labels")
        labels = step.select("node", "comp")
        if not step.filter("old <> comp").limit(1).count():
            return labels
    raise RuntimeError(f"components still changed after {max_rounds} rounds")

"""Least-cost routes to a target by min-plus rounds: labels of all places at once, one round for each hop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.scratch import stash


def least_routes(edges: DataFrame, target, hops: int) -> DataFrame:
    """place, cost, hops, route: the cheapest way from each place to the target over at most `hops` edges (a, b, cost).

    In each round a place takes the least of its own label and of cost plus label over its edges; ties go to fewer
    hops, then to the route that is first as text. Labels are one row a place, edges meet them by equality, and a
    place with a third of all edges is pre-aggregated before the shuffle. Rounds stop early when no label changes.
    Costs must not be negative. Places that can't reach the target in so many hops have no row; neither has anything in
    an empty table but the target itself.
    """
    edges = stash(edges.filter("a <> b and cost is not null").groupBy("a", "b").agg(F.min("cost").alias("cost")), "route-edges")
    kind = dict(edges.dtypes)
    start = edges.sparkSession.range(1).select(F.lit(target).cast(kind["a"]).alias("place"), F.lit(0).cast(kind["cost"]).alias("cost"), F.lit(0).cast("long").alias("hops"), F.lit(target).cast("string").alias("route"))
    labels = start
    for _ in range(hops):
        onward = edges.join(labels.withColumnsRenamed({"place": "b", "cost": "rest"}), "b")
        step = onward.select(F.col("a").alias("place"), (F.col("cost") + F.col("rest")).cast(kind["cost"]).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat(F.col("a").cast("string"), F.lit(">"), "route").alias("route"))
        best = labels.unionByName(step).groupBy("place").agg(F.min(F.struct("cost", "hops", "route")).alias("l")).select("place", "l.*")
        found = stash(best, "route-labels")
        changed = found.join(labels.select("place", F.col("route").alias("old")), "place", "left").filter("old is null or old <> route").limit(1).count()
        labels = found
        if not changed:
            break
    return labels

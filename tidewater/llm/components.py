"""Connected components of an edge table, as an iterative Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round hooks every node to the smallest root among its neighbours' roots and then
    jumps pointers, so chains shrink by a constant factor a round. All steps are joins and
    aggregates; only a count of the rows that still change reaches the driver. Null nodes
    and loops are ignored; an empty table gives no rows. Raises if ``rounds`` don't suffice
    (they do for chains of any length that occurs: the need grows with its logarithm).
    """
    edges = materialise(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    both = edges.union(edges.select("b", "a"))
    # large-star / small-star on the edges themselves
    current = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(rounds):
        sym = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # written, as it is read three times: the driver would hold and re-plan its joins as often
        large = materialise(sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small-star: a node's smaller neighbours and itself meet at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = materialise(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        # done when the edges are stars whose centres have no smaller neighbour
        ends = after.selectExpr("u AS node", "1 AS up", "0 AS down").union(after.selectExpr("v AS node", "0 AS up", "1 AS down"))
        unsettled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count()
        current = after
        if not unsettled:
            nodes = both.select(F.col("a").alias("node")).distinct()
            return nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")

"""Connected components of a link table by alternating star operations.

All work is joins and partial aggregates over the links, which only shrink to
stars; nothing is gathered per component. Both sides of the join at a node are
written tables, so adaptive execution may split the links of a hub over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Rounds grow with the logarithm of the longest chain, so no table comes near this many.
ROUNDS = 60


def components(links: DataFrame, ws: Workspace, name: str = "stars") -> DataFrame:
    """Links (a, b) to (id, component): the smallest id reachable, for ids with a link to another id.

    Raises when ``ROUNDS`` rounds leave anything but stars, instead of giving half a result.
    """
    edges = ws.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    for k in range(1, ROUNDS + 1):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = ws.save(both.groupBy("x").agg(F.least("x", F.min("y")).alias("m")), f"{name}-least-{k}")
        # large star: neighbours above a node go to its least neighbour
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = ws.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        ws.drop(f"{name}-least-{k}")
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # stars are left when every id has one link up or is a head
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components are not complete after {ROUNDS} rounds")
    heads = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(heads)

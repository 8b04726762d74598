"""Connected components by alternating large-star and small-star rounds on an edge table.

Every round is a min aggregate and a join on narrow rows; the edges are written to the shared folder, so a
lost executor costs only its tasks. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.llm.shared import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): hooks neighbours to the smallest id next to u, or u itself."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        sides = materialize(sides.distinct(), "star-sides")
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star-least")
    hooked = sides.join(least, "u").filter("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        hooked = hooked.unionByName(least.select("u", F.col("m").alias("v")))
    return hooked.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (u long, v long); component is the smallest id reachable. No edges: no rows."""
    edges = materialize(edges.select("u", "v").filter("u <> v").distinct(), "star-edges")
    seen = None
    while True:
        total, check = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not total:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        if (total, check) == seen:
            break
        seen = total, check
        edges = materialize(_star(_star(edges, large=True), large=False), "star-edges")
    leaves = edges.select(F.greatest("u", "v").alias("id"), F.least("u", "v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("id"), "component").distinct())

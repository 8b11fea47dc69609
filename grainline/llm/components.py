"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Links that one task takes. Fewer tasks than partitions write each exchange, so that
#: a round over few links doesn't leave partitions squared of nearly empty blocks.
LINKS_A_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (any order, repeats allowed) -> ``node, component`` (smallest node reachable).

    Each round points the larger neighbours of a node at its smallest neighbour
    (large star), then the smaller ones (small star); links per node only fall,
    and rounds grow with the logarithm of a component. Only a count and a
    checksum of the links reach the driver.
    """
    links = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = (links.count(), None)
    while True:
        tasks = -(-max(seen[0], 1) // LINKS_A_TASK)
        links = links.coalesce(tasks)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select("u", "v", "m").coalesce(tasks)
        # a node keeps its smallest neighbour, which its others are pointed at
        links = settle(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().coalesce(tasks))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = links.select(F.col("v").alias("node")).distinct().join(links.select(F.col("u").alias("node")), "node", "left_anti")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))

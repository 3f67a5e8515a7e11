"""Connected components of an edge table, by alternating star contractions.

Every round rewrites the edges with two aggregations; after a logarithmic
number of rounds each component is a star around its smallest node.  A node's
neighbours are never gathered in one place: a round needs only the smallest
of them, which is aggregated map-side first.  Rounds are cut by tables in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is its component's smallest node."""
    now = table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large star: every neighbour above a node moves to its smallest neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = table(large, "edges")
        # small star: neighbours below a node, and itself, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = table(small, "edges")
        drop_table(large)
        # a fixed point: every upper node has one edge, and no root is an upper node
        up, uppers = small.agg(F.count("*"), F.countDistinct("u")).first()
        chained = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        drop_table(now)
        now = small
        if up == uppers and not chained:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

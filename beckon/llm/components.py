"""Connected components of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beckon.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node of each component) from links ``a, b``.

    Large-star and small-star steps in turn, each a grouped minimum and a join, until
    nothing changes; every round is written to the shared folder.  A node with very
    many links is summed where they are and its join is split by AQE.  Nodes without a
    link to another do not appear.
    """
    edges = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # Every edge now points from the larger to the smaller node.
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(below.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = stored(small, "links")
        # Stars are stable; a change moves the count or the sum of the hashes.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads).distinct()

"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node that each node of ``links`` (``a``, ``b``; no nulls) can reach.

    Large-star and small-star steps in turn: every node tells its larger, then its smaller neighbours its least neighbour.
    Links only ever get replaced by as many or fewer, so a hub's links stay spread over their other ends; least neighbours
    come from map-side combined aggregates. Each round is settled; rounds end when no link changes, after
    about the logarithm of the longest path. Nothing but counts reaches the driver.
    """
    links = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.*")
        links = settle(small.where("a != b").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # Stable links are stars around each component's least node.
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

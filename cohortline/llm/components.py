"""Connected components of links by large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortline.session import cut


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (large: the greater ones; small: the smaller ones and itself) to its least neighbour."""
    ways = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = ways.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b): root is the least node that can be reached.

    Each round keeps the components and brings nodes nearer to their root; it ends when a round changes nothing. Only a
    count and a sum of hashes come to the driver. A node with very many links is grouped by partial minima and joined by
    adaptive skew splits.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = cut(_stars(_stars(now, True), False))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def star_forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, v``: every node but a component's least one, with that least node.

    ``edges`` has ``u > v``. Each half step is a grouped minimum and a join, so a node
    with very many neighbours is pre-aggregated and its rows can be split; each round is
    written, and the rounds end when one changes nothing. Rounds grow with the logarithm
    of the longest path.
    """
    now, before = scratch.save(edges.select("u", "v").distinct()), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            return now
        before = seen
        after = scratch.save(_small_star(_large_star(now)))
        scratch.drop(now)
        now = after

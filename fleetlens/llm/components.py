"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin


def _state(edges: DataFrame) -> tuple[DataFrame, tuple]:
    kept = pin(edges)
    return kept, tuple(kept.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links(a, b)`` that is not its own root.

    The root is the smallest node that can be reached. Each step is a minimum per node (combined
    before the shuffle) and one equi-join, so the links of a hub are never gathered. The number of
    rounds grows with the logarithm of the largest component. Null ends and loops are left out; an
    empty table gives an empty one.
    """
    edges, seen = _state(links.where("a <> b").select("a", "b").distinct())
    while True:
        edges, now = _state(_small_star(_large_star(edges)))
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now

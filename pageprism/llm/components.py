"""Connected components of a table of links, by alternating star contraction.

Each round first points every larger neighbour of a node at the smallest node
around it, then every smaller one; both are grouped minima and a join, so a
hub with a third of all links is one partial result per task and its join is
split by adaptive execution. Rounds are few (logarithmic in practice); each is
cut off from its history by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageprism.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = materialize(least, "least")  # so that the join can be split at a hub
    return both.filter("b > a").join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``a > b`` in every row."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def connected(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node) of every node in ``links`` (``a``, ``b``).

    Nodes are bigints. Links of a node with itself, repeated links and links
    with a null end count for nothing; no links give an empty table.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    before = _print(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "links")
        now = _print(edges)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

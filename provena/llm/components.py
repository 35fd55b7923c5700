"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least node near it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, least node of its component) for every node in the links (u, v).

    Each round is written in the shared folder; rounds grow with the logarithm of the longest path.
    Nulls and loops are left out. Large neighbourhoods are aggregated before they are shuffled,
    and their joins can be split.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    sign = None
    while True:
        n, h = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, h) == sign:
            break
        sign = (n, h)
        if not n:
            break
        edges = written(_small(_large(edges)), "edges")
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), "v").distinct())

"""Connected components of an edge list, by alternating large and small stars.

Each round is two aggregations and two joins on edges; no neighbour list is ever
collected, so a hub of any degree is a row in a minimum. The number of rounds grows with
the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugebook.session import stage


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _pairs(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return _pairs(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node of its component) for every node of `links` (u, v longs)."""
    edges = stage(_pairs(links.select("u", "v")), "edges")
    seen = _mark(edges)
    while seen[0]:
        edges = stage(_small(_large(edges)), "edges")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """`comp` (node, comp; unlisted nodes are alone) after more links. Only components that
    these links join go through rounds again, each as one node."""
    name = {c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp")) for c in "uv"}
    between = links.select("u", "v").join(name["u"], "u", "left").join(name["v"], "v", "left").select(
        F.coalesce("u_comp", "u").alias("u"), F.coalesce("v_comp", "v").alias("v"))
    above = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    moved = comp.join(above, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    alone = above.select(F.col("comp").alias("node"), F.col("top").alias("comp")).join(comp, "node", "left_anti")
    return stage(moved.unionByName(alone), "components")

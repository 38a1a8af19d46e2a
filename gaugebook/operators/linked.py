"""Parts of a graph that no link connects, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugebook.session import release, stage


def parts(links: DataFrame) -> DataFrame | None:
    """`node` and `part` of every node of `links` (u, v: bigints); None without links.

    Each round maps a node to the least of itself and its neighbours and carries the links
    over, which keeps what is connected. Nodes get new random numbers in each round, so
    about half of them vanish whatever the shape: a chain takes rounds in the logarithm of
    its length. A hub is one minimum, combined before the shuffle. Two nodes may meet in one
    number by chance (64 bits), which merges their parts and never splits one.
    Links of earlier rounds are removed: a round needs those of the last one only.
    """
    steps: list[DataFrame] = []
    edges = stage(links.filter("u <> v").distinct(), "links")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v"))
        step = stage(
            least.select(F.col("u").alias("node"), F.xxhash64(F.least("u", "v"), F.lit(len(steps))).alias("part")),
            "contraction",
        )
        steps.append(step)
        u = step.select(F.col("node").alias("u"), F.col("part").alias("u_part"))
        v = step.select(F.col("node").alias("v"), F.col("part").alias("v_part"))
        moved = edges.join(u, "u").join(v, "v").select(F.col("u_part").alias("u"), F.col("v_part").alias("v"))
        last, edges = edges, stage(moved.filter("u <> v").distinct(), "links")
        release(last)
    if not steps:
        return None
    found = steps.pop()
    for step in reversed(steps):  # from the smallest table back to the nodes
        later = found.select(F.col("node").alias("part"), F.col("part").alias("later"))
        found = step.join(later, "part", "left").select("node", F.coalesce("later", "part").alias("part"))
    return found

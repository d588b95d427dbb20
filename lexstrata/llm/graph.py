"""Connected components by alternating large-star and small-star rounds, over DataFrames only.

Each round is a pair of minimum aggregations joined back to the edges; nothing is collected, and
every round is written to shared storage. Hub nodes are pre-aggregated before the shuffle, and the
joins back are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); the component is its smallest node.

    Self loops and repeated edges count for nothing; no edges give no rows.
    """
    current = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        current = stored(_small_star(_large_star(current)), "edges")
        # converged when every node points at a node that points nowhere else: a forest of stars
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == tuple(state):
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not converge")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

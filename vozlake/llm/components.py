"""Connected components of an edge table by alternating large-star and small-star steps.

Each step points neighbours of a node at the smallest of them, with combinable minima and joins only, so a hub with a third
of all edges is split by the skew join. Steps are stored in the shared folder; the loop ends when no edge changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vozlake.durable import cut


def components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Null ends, loops and repeated edges are ignored."""
    both = F.col(source).isNotNull() & F.col(target).isNotNull()
    pairs = edges.filter(both & (F.col(source) != F.col(target))).select(
        F.greatest(source, target).alias("u"), F.least(source, target).alias("v")).distinct()
    now = cut(pairs, "edges")
    state = _state(now)
    while state[0]:
        now = cut(_small_star(cut(_large_star(now), "edges")), "edges")
        new = _state(now)
        if new == state:
            break
        state = new
    # a star per component: each node points at its smallest
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest of its neighbours and itself."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to the smallest of them. Here u > v on each edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.filter(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()

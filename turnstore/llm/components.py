"""Connected components of a link table by alternating star contraction.

Every step is a grouped minimum and a join, so a node with a third of all links is
split like any other; labels are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnstore.runtime import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked with the least of it and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return (near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of *edges* (u, v): root is the least node it reaches.

    Loops, repeated links and either direction are allowed; no links, no rows.
    """
    edges = cut_lineage(edges.where("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        # A round that changes nothing leaves every node linked with its root.
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                               F.bit_xor(F.xxhash64("v", "u"))).first())
        if mark == seen:
            break
        seen = mark
        edges = cut_lineage(_small_star(_large_star(edges)))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

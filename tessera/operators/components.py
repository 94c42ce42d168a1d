"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node with an edge to another; component: its smallest node.

    Edges may repeat and point either way; self-loops and nulls are left out. Every round
    is written to the shared folder, which cuts the lineage. The rounds stop when the
    edges are stars, after about log(nodes)^2 of them at most.
    """
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    mark, was = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), None
    while True:
        # a round leaves at most the edges and one more for each of their ends
        edges = settle(_small_star(_large_star(edges)), "components", was and 3 * was["n"])
        now = edges.select(mark.alias("s")).first()["s"]
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        was = now

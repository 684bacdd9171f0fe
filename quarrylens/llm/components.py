"""Connected components of a graph of long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.shared import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(down).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, component: the smallest id that each end of an edge (u, v) can reach. Every round is written to the shared
    folder; the rounds are logarithmic in the length of the longest path."""
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = None
    while True:
        before, edges = edges, staged(_small_star(_large_star(edges)), "stars")
        discard(before)
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == tuple(row):
            break
        sign = tuple(row)
    # Converged: every edge leads from a node to the root of its component.
    return edges.select("u", F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, forget


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node that has an edge to another, with the smallest node it is joined to, itself included.

    Each step sends every node's neighbours to the smallest of them; a node never meets all its edges in one task, as the least
    neighbour is aggregated first and joined back. The steps end when the edges stay the same.
    """
    now = cut(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))  # tables of their own, so that Spark can split a hub's rows in the joins
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        root = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(root, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, cut(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
        last, state = state, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        forget(before, least, large, root)
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select("v", "v").distinct().toDF("node", "component"))

"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterscale.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of ``a, b``: the smallest node reachable.

    Each round links the larger neighbours of a node, then the node and its smaller
    neighbours, to the smallest of them, and is written to the shared folder. The number of
    rounds grows with the logarithm of the longest path; a round moves as many rows as there
    are edges, and ends the loop when the edges are stars that no longer change. Self-links
    name lone nodes. Runs jobs when called.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = stars.union(stars.select("v", "u").where("u <> v"))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.union(stars.where("u = v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).where("u >= v")
        stars = written(small.distinct(), "small")
        # the sum of the targets falls with every change; modulo 2^64 it is compared together with the count
        now = stars.where("u <> v").agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return stars.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component"))

"""Connected components of large edge lists, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heapscope.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """v and c, the least node that v is linked to, for every node of edges (a, b longs). Each step is written to the shared folder."""
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    sign = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count("*")
    before = None
    while True:  # rounds grow with the logarithm of the longest chain
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = staged(small.select("x.u", "x.v").filter("u != v").distinct(), "edges")
        now = tuple(e.agg(*sign).first())
        if now == before:
            break
        before = now
    # Now every node has one edge, to its component's least node.
    return e.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(e.select(F.col("v"), F.col("v").alias("c")).distinct())

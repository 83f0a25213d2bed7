"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every end of the links (x, y); a label is the smallest end of its component.

    Edges are re-hung to ever smaller neighbours until nothing moves; the number of rounds grows with the logarithm of
    the longest chain.  A round writes at most two edges a vertex beyond the links themselves.
    """
    edges = cut(links.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before = None
    own = Window.partitionBy("u")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(own), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.distinct().withColumn("m", F.min("v").over(own))
        small = least.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, cut(small.where("u != v").distinct(), "edges")
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("v"), F.col("v").alias("label"))
    roots = edges.select(F.col("v"), F.col("v").alias("label")).distinct()
    return found.unionByName(roots)

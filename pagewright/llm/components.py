"""Connected components of links, by alternating stars (large-star and small-star steps), all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed

MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free checksums of the edges: one row to the driver."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def components(links: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``links`` (a, b: longs), ``component`` being its component's least vertex.

    A step replaces each vertex's neighbours by links to the least of them; the number of links never grows. A vertex
    with many neighbours is a partial aggregate and one side of a join, which adaptive execution splits if skewed.
    """
    ordered = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    edges = checkpointed(ordered.distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        now = _digest(edges)
        if now == seen:
            break
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = checkpointed(small)
    else:
        raise RuntimeError("links did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "v").unionByName(edges.select(F.col("v"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.scratch import stored


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): for every node with an edge, the smallest node it can reach.

    Rounds grow with the logarithm of the graph's width. Each round's edges are written to the shared folder,
    so that lineage stays short; only a row count and a checksum reach the driver. Null nodes and self-loops
    have no effect; an empty edge table gives an empty result.
    """
    pairs = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    pairs = stored(pairs.where("a is not null and b is not null and a <> b").distinct(), "edges")
    seen = None
    while True:
        both = pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(pairs.select("b", "a"))
        lowest = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(lowest, "v").where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.inline(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))))
        pairs = stored(small.where("a <> b").distinct(), "edges")
        mark = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if tuple(mark) == seen or not mark.n:
            break
        seen = tuple(mark)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)

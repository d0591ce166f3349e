"""Connected components of a distributed edge list, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.cluster import held


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half-step of the alternating star contraction.

    Every node u finds the least of its neighbours and itself, m(u). In the large step each
    neighbour above u is tied to m(u), in the small step each neighbour not above u. The minimum
    is an aggregate with partial sums and the join is by shuffle, so a node with very many
    neighbours is split by adaptive skew handling rather than gathered.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v <= u")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        rest = tied.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.where("u != m").select("u", F.col("m").alias("v"))
        out = rest.unionByName(own)
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(u, v)``; component: its least node."""
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = held(edges)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        now = held(_stars(_stars(now, True), False))
    own = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)

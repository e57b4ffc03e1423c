"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for the nodes of ``edges`` (u, v).

    Every step keeps the components and moves edges towards their smallest node;
    the work is joins and minima on node keys, nothing is gathered. Loops,
    repeated and reversed edges may occur; nodes without an edge to another node
    are not returned.
    """
    pairs = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or tuple(state) == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v")).distinct()
        before = tuple(state)
        # Large star: a node's larger neighbours move to its smallest neighbour.
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        pairs = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        pairs = durable(pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct())

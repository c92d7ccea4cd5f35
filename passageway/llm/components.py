"""Connected components by joins and minima only: no neighbour list is ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageway.llm.common import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); component is the smallest node that can be reached.

    Alternates large stars (all larger neighbours of a node point to the smallest neighbour) and small stars (all
    smaller ones do) until every node points to its component. A node's smallest neighbour is a minimum with map-side
    combination, and edges meet it in a join, whose hot keys Spark splits. Each round is written to the shared
    folder, so lineage stays short. Edges number at most as many as at the start in each round.
    """
    edges = written(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

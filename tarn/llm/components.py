"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in an edge the smallest id that links reach from it.

    Each step links the neighbours of a node to its smallest neighbour, so long chains halve
    per round and every row is an edge: no group is gathered. Minima are pre-aggregated before
    the shuffle and a hub's edges are only joined to its minimum, a join that Spark can split.
    Self-links and nulls are ignored; no edges give an empty table.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges, before = cut(edges), None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y")).where("x > y")
        edges = cut(small.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            ids = edges.groupBy("u").agg(F.min("v").alias("component"))
            return ids.select(F.col("u").alias("id"), "component").unionByName(ids.select(F.col("component").alias("id"), "component").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

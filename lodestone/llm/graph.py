"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fan_join, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component), component the smallest reachable node; nodes without an edge don't occur.

    Each half step sends every node's neighbours to the smallest of them: an aggregate, partial within each task, and a join
    in which a hub with very many neighbours is dealt out to several tasks. It ends when all that is left are stars.
    Null ends and loops are dropped; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialise(e, "edges")
    while not _stars(e):
        # large star: neighbours above a node move to the smallest neighbour (or the node itself)
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.sum(F.when(F.col("v") > F.col("u"), 1).otherwise(0)).alias("asked")), "least")
        large = fan_join(both.where("v > u"), low, ["u"], "asked", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "edges")
        # small star: a node and its lower neighbours move to the smallest of them
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("asked")), "least")
        small = fan_join(large, low, ["u"], "asked", "v")
        e = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = materialise(e, "edges")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionAll(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))


def _stars(e: DataFrame) -> bool:
    """Whether every node hangs on one other at most and nothing hangs on a node that itself hangs on one."""
    ends = e.select("u", F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(e.select(F.col("v").alias("u"), F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()

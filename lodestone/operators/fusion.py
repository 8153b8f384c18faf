"""Reciprocal rank fusion and its diagnostics, for any number of ranked sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(sources: dict[str, DataFrame], k: int = 60, limit: int | None = None) -> DataFrame:
    """Sources (query_id, rank, id, score) -> query_id, rank, id, rrf, min_rank, component_ranks, component_scores.

    rrf sums 1 / (k + rank) over the sources that hold the id, by each row's own rank. Order: rrf, best component rank, id. An id twice in a source
    or a rank under 1 raises.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    tagged = [df.select("query_id", "id", "rank", "score", F.lit(name).alias("source"), F.lit(i).alias("at")) for i, (name, df) in enumerate(sources.items())]
    rows = reduce(DataFrame.unionByName, tagged)
    part = F.when(F.col("rank") >= 1, 1.0 / (k + F.col("rank"))).otherwise(F.raise_error(F.lit("ranks start at 1")).cast("double"))
    g = rows.groupBy("query_id", "id").agg(
        F.sum(part).alias("rrf"), F.min("rank").alias("min_rank"), F.sort_array(F.collect_list(F.struct("at", "source", "rank", "score"))).alias("c"), F.count("*").alias("n"), F.count_distinct("at").alias("m")
    )
    g = g.withColumn("rrf", F.when(F.col("n") == F.col("m"), F.col("rrf")).otherwise(F.raise_error(F.lit("an id occurs twice in one source")).cast("double")))
    entries = lambda f: F.map_from_entries(F.transform("c", lambda x: F.struct(x["source"], x[f])))
    w = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "min_rank", "id")
    out = g.withColumn("rank", F.row_number().over(w))
    if limit is not None:
        out = out.where(F.col("rank") <= limit)
    return out.select("query_id", "rank", "id", "rrf", "min_rank", entries("rank").alias("component_ranks"), entries("score").alias("component_scores"))


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = 60) -> tuple[DataFrame, DataFrame]:
    """(the k best fused rows, diagnostics per query: sizes of both sources, their union and intersection)."""
    fused = fuse({"dense": dense, "bm25": sparse}, rrf_k)
    has = lambda s: F.map_contains_key("component_ranks", s).cast("int")
    diagnostics = fused.groupBy("query_id").agg(
        F.sum(has("dense")).alias("dense_n"), F.sum(has("bm25")).alias("bm25_n"), F.count("*").alias("union_n"), F.sum(has("dense") * has("bm25")).alias("both_n")
    )
    return fused.where(F.col("rank") <= k), diagnostics

"""Windowed reranking of retrieved candidates, all questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .models import Scorer, cross_score, overlap_scorer

LEAST_BODY = 32


@dataclass(frozen=True)
class RerankConfig:
    max_length: int = 512
    overlap: int = 64
    special: int = 3
    token: str = r"\S+"


def candidate_windows(candidates: DataFrame, config: RerankConfig = RerankConfig()) -> DataFrame:
    """candidates (question_id, query, rank, chunk_id, header, text) -> the same with window, window_text, input_tokens, truncated.

    A pair that fits is one window of header and text. Else the text alone is cut into overlapping windows, each with the header, which is left out where it would
    leave under LEAST_BODY tokens; a query that leaves nothing gives one whole window.
    """
    n = lambda c: F.size(F.regexp_extract_all(c, F.lit(config.token), F.lit(0)))
    full = F.concat("header", "text")
    c = candidates.withColumn("_pieces", F.regexp_extract_all("text", F.lit(rf"[\s\S]*?(?:{config.token})"), F.lit(0)))
    c = c.withColumn("input_tokens", n(F.col("query")) + n(full) + config.special).withColumn("truncated", F.col("input_tokens") > config.max_length)
    budget = F.lit(config.max_length) - n(F.col("query")) - config.special
    with_head = budget - n(F.col("header"))
    c = c.withColumn("_head", F.when(with_head >= LEAST_BODY, F.col("header")).otherwise("")).withColumn("_body", F.when(with_head >= LEAST_BODY, with_head).otherwise(budget))
    split = F.col("truncated") & (F.col("_body") > 0) & (F.size("_pieces") > 0)
    step = F.greatest(F.lit(1), F.col("_body") - F.least(F.lit(config.overlap), F.col("_body") - 1))
    count = F.when(split, F.when(F.size("_pieces") <= F.col("_body"), 1).otherwise(F.ceil((F.size("_pieces") - F.col("_body")) / step).cast("int") + 1)).otherwise(1)
    c = c.withColumn("_split", split).withColumn("_step", step).withColumn("window", F.explode(F.sequence(F.lit(0), count - 1)))
    part = strip(F.array_join(F.slice("_pieces", (F.col("window") * F.col("_step") + 1).cast("int"), F.greatest("_body", F.lit(0))), ""))
    return c.withColumn("window_text", F.when(F.col("_split"), strip(F.concat("_head", part))).otherwise(full)).drop("_pieces", "_head", "_body", "_split", "_step")


def rerank(candidates: DataFrame, k: int = 5, scorer: Scorer = overlap_scorer, config: RerankConfig = RerankConfig()) -> DataFrame:
    """(question_id, rank, chunk_id, score, first_rank, best_window, window_count, truncated): candidates by their best window; ties to the first window, then
    to the first-stage rank, then to the chunk id."""
    w = candidate_windows(candidates, config).withColumn("score", cross_score(F.col("query"), F.col("window_text"), scorer))
    best = w.groupBy("question_id", "chunk_id", F.col("rank").alias("first_rank"), "truncated").agg(F.max(F.struct("score", -F.col("window"))).alias("b"), F.count("*").alias("window_count"))
    best = best.select("question_id", "chunk_id", "first_rank", F.col("b.score").alias("score"), (-F.col("b.col2")).alias("best_window"), "window_count", "truncated")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "first_rank", "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "rank", "chunk_id", "score", "first_rank", "best_window", "window_count", "truncated")

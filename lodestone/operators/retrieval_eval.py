"""Scores of retrieved chunks against gold pages, and where a gold page was lost on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import enforce, ranks_valid


def checked_ranks(retrieved: DataFrame, most: int = 5) -> DataFrame:
    """retrieved, in which a question with more than `most` chunks, or whose ranks are not 1..n once each, raises."""
    enforce(ranks_valid(retrieved, "question_id", "rank", most))
    return retrieved


def checked_gold(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """gold, in which a question without a gold page raises."""
    lost = questions.select("question_id").distinct().join(gold.where("page_ref is not null").select("question_id"), "question_id", "left_anti").limit(5).collect()
    if lost:
        raise ValueError("questions without gold pages: " + ", ".join(str(r[0]) for r in lost))
    return gold


def score_questions(retrieved: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """retrieved (question_id, rank, page_ref), gold (question_id, page_ref) -> per gold question hit_at_1/3/k, recall_at_k, mrr_at_k and counts.

    Hits and reciprocal rank go by chunk rank, recall by distinct pages. A question without retrieved chunks is a miss.
    """
    pages = gold.select("question_id", "page_ref").distinct()
    flagged = retrieved.where(F.col("rank") <= k).join(pages.withColumn("is_gold", F.lit(True)), ["question_id", "page_ref"], "left")
    got = flagged.groupBy("question_id").agg(
        F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first_gold_rank"), F.count("*").alias("retrieved_chunk_count"), F.count_distinct("page_ref").alias("retrieved_unique_page_count"),
        F.count_distinct(F.when(F.col("is_gold"), F.col("page_ref"))).alias("gold_pages_retrieved"),
    )
    n = pages.groupBy("question_id").agg(F.count("*").alias("gold_page_count"))
    hit = lambda at: F.coalesce((F.col("first_gold_rank") <= at).cast("int"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return n.join(got, "question_id", "left").select(
        "question_id", "gold_page_count", zero("retrieved_chunk_count"), zero("retrieved_unique_page_count"), zero("gold_pages_retrieved"), "first_gold_rank", hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"), hit(k).alias(f"hit_at_{k}"),
        (F.coalesce("gold_pages_retrieved", F.lit(0)) / F.col("gold_page_count")).alias(f"recall_at_{k}"), F.coalesce(1 / F.col("first_gold_rank"), F.lit(0.0)).alias(f"mrr_at_{k}"),
    )


def summarise(scores: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Plain means over all questions of each architecture."""
    mean = [F.avg(c).alias(c) for c in ("hit_at_1", "hit_at_3", f"hit_at_{k}", f"recall_at_{k}", f"mrr_at_{k}")]
    return scores.groupBy(by).agg(F.count("*").alias("question_count"), *mean, F.sum((F.col("retrieved_chunk_count") == 0).cast("int")).alias("no_result_count"))


def stage_diagnostics(stages: DataFrame, gold: DataFrame) -> DataFrame:
    """stages (question_id, stage in union, pre, final; page_ref) and gold (question_id, page_ref) -> per gold question the stage at which gold was lost."""
    pages = gold.select("question_id", "page_ref").distinct()
    f = stages.join(pages.withColumn("g", F.lit(1)), ["question_id", "page_ref"], "left")
    at = lambda s, c: F.coalesce(F.max(F.when(F.col("stage") == s, c)), F.lit(0))
    g = f.groupBy("question_id").agg(*[at(s, F.coalesce("g", F.lit(0))).alias(f"{s}_hit") for s in ("union", "pre", "final")], *[F.sum((F.col("stage") == s).cast("int")).alias(f"{s}_n") for s in ("union", "pre", "final")])
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("union_hit", "pre_hit", "final_hit", "union_n", "pre_n", "final_n")]
    out = pages.select("question_id").distinct().join(g, "question_id", "left").select("question_id", *zero)
    why = (
        F.when(F.col("final_n") == 0, "empty_retrieval").when(F.col("union_hit") == 0, "gold_page_absent_candidate_union").when(F.col("pre_hit") == 0, "gold_page_lost_before_pre_final")
        .when(F.col("final_hit") == 0, "gold_page_lost_at_final_selection").otherwise("final_gold_page_hit")
    )
    return out.withColumn("diagnostic_category", why)

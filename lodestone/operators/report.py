"""Report tables and plot-ready frames; drawing is left to whoever reads them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import with_quantiles


def configuration(answers: DataFrame) -> DataFrame:
    """answers (architecture, experiment_parameters) -> one row per architecture with what its records say they were run with; what a stage lacks is null. Records of one
    architecture that disagree raise."""
    p = F.col("experiment_parameters")
    named = {"dense_k": "dense_candidate_k", "sparse_k": "sparse_candidate_k", "rrf_k": "rrf_k", "fusion_k": "fusion_candidate_k", "reranker_k": "reranker_candidate_k", "final_k": "final_context_k"}
    one = F.when(F.count_distinct(F.to_json(F.map_entries(p))) == 1, F.first(p)).otherwise(F.raise_error(F.lit("records of one architecture have different parameters")).cast("map<string,string>"))
    g = answers.groupBy("architecture").agg(F.count("*").alias("question_count"), one.alias("p"))
    return g.select("architecture", "question_count", *[F.col("p")[k].cast("int").alias(c) for c, k in named.items()], F.map_contains_key("p", "reranker_candidate_k").alias("reranked"))


def overall(frames: list[DataFrame], key: str = "architecture") -> DataFrame:
    """Summaries side by side; an architecture that one lacks keeps its row."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), frames)


def with_count(value: Column, n: Column, digits: int = 3) -> Column:
    """'0.850 (85)'; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f (%d)", value, n))


def matrix(df: DataFrame, rows: str, columns: str, value: str, values: list[str]) -> DataFrame:
    """A category by architecture matrix for a heat map."""
    return df.groupBy(rows).pivot(columns, values).agg(F.first(value))


def case_study(question_id, frames: dict[str, DataFrame]) -> DataFrame:
    """Everything known of one question, per architecture; names are prefixed by their table."""
    parts = []
    for name, df in frames.items():
        parts.append(df.where(F.col("question_id") == question_id).select("architecture", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in ("architecture", "question_id")]))
    return overall(parts)


def inspect(answers: DataFrame, width: int = 120) -> DataFrame:
    from ..functions.text import compact_text

    return answers.select("architecture", "question_id", compact_text(F.col("question"), width).alias("question"), compact_text(F.col("generated_answer"), width).alias("answer"), F.coalesce(F.size("retrieved_chunks"), F.lit(0)).alias("chunks"))


def compact(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def titled(df: DataFrame, title: str, run_id: str, fields: list[str]) -> DataFrame:
    """A published table: its title, its run, and the fields in their order; what df lacks is null."""
    return df.select(F.lit(title).alias("table_title"), F.lit(run_id).alias("run_id"), *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])


def bars(df: DataFrame, by: str, metrics: list[str], digits: int = 6) -> DataFrame:
    """Plot-ready bars: (by, metric, value, n) of plain means over the rows that have the metric; a metric that nobody has is left out."""
    long = df.unpivot([by], metrics, "metric", "value").where("value is not null")
    return long.groupBy(by, "metric").agg(F.round(F.avg("value"), digits).alias("value"), F.count("*").alias("n"))


def shares(df: DataFrame, by: str, label: str, labels: list[str], digits: int = 9) -> DataFrame:
    """Plot-ready stacked bars: (by, label, n, share), a row for every label, also those of no row."""
    spine = df.select(by).distinct().withColumn(label, F.explode(F.array(*map(F.lit, labels))))
    n = df.groupBy(by, label).agg(F.count("*").alias("n"))
    total = df.groupBy(by).agg(F.count("*").alias("_t"))
    out = spine.join(n, [by, label], "left").join(total, by)
    return out.select(by, label, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("_t"), digits).alias("share"))


def boxes(df: DataFrame, by: str, value: str, digits: int = 6) -> DataFrame:
    """Plot-ready boxes: least, quartiles and most of each group."""
    there = df.where(F.col(value).isNotNull())
    g = with_quantiles(there.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")), there, [by], value, [0.25, 0.5, 0.75])
    at = lambda c: F.round(c, digits)
    return g.select(by, at("low").alias("low"), at(F.col("q")[0]).alias("q1"), at(F.col("q")[1]).alias("median"), at(F.col("q")[2]).alias("q3"), at("high").alias("high"), "n")


def points(df: DataFrame, by: str, x: str, y: str, digits: int = 6) -> DataFrame:
    """Plot-ready scatter: mean x and y of each group over the rows that have both."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(F.round(F.avg(x), digits).alias("x"), F.round(F.avg(y), digits).alias("y"), F.count("*").alias("n"))


def comparison_matrix(long: DataFrame, by: str, reference: str, digits: int = 4) -> DataFrame:
    """(metric, by, value) -> per metric and architecture its value, the reference's, and their difference; an architecture that lacks the metric has no row."""
    base = long.where(F.col(by) == reference).select("metric", F.col("value").alias("reference_value"))
    return long.join(base, "metric", "left").select("metric", by, F.round("value", digits).alias("value"), F.round("reference_value", digits).alias("reference_value"), F.round(F.col("value") - F.col("reference_value"), digits).alias("difference"))

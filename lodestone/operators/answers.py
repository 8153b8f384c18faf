"""Answer metrics: exact match, token F1, numeric overlap, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.multiset import overlap
from ..functions.numeric import numeric_entities
from ..functions.text import answer_tokens


def exact_match(gold: Column, generated: Column) -> Column:
    return (answer_tokens(gold) == answer_tokens(generated)).cast("int")


def token_f1(gold: Column, generated: Column) -> Column:
    """Twice the shared tokens over all, with repeats; 1 if both are empty."""
    def f1(x: Column) -> Column:
        n = F.size(x["a"]) + F.size(x["b"])
        return F.when(n == 0, 1.0).otherwise(2.0 * overlap(x["a"], x["b"]) / n)

    return F.transform(F.array(F.struct(answer_tokens(gold).alias("a"), answer_tokens(generated).alias("b"))), f1)[0]


def numeric_scores(df: DataFrame, gold: str = "gold_answer", generated: str = "generated_answer", question: str = "question") -> DataFrame:
    """Adds the numeric counts and scores. Accuracy is recall: null if gold has no number. Precision is 0 if only the answer lacks numbers, null if both do."""
    d = df.withColumn("_g", numeric_entities(F.col(gold), F.col(question))).withColumn("_a", numeric_entities(F.col(generated), F.col(question)))
    d = d.withColumn("gold_numeric_count", F.size("_g")).withColumn("generated_numeric_count", F.size("_a")).withColumn("matched_numeric_count", overlap(F.col("_g"), F.col("_a")))
    return rates(d).drop("_g", "_a")


def rates(d: DataFrame) -> DataFrame:
    """Scores from gold_numeric_count, generated_numeric_count and matched_numeric_count."""
    g, a, m = (F.col(f"{x}_numeric_count") for x in ("gold", "generated", "matched"))
    return (
        d.withColumn("numeric_accuracy", F.when(g > 0, m / g)).withColumn("numeric_precision", F.when(a > 0, m / a).when(g > 0, 0.0))
        .withColumn("numeric_recall", F.when(g > 0, m / g)).withColumn("numeric_f1", F.when(g + a > 0, 2 * m / (g + a)))
    )


def summarise(scores: DataFrame, by: str) -> DataFrame:
    """exact_match and token_f1 over all rows, numeric means over rows whose gold answer has numbers only."""
    has = F.col("gold_numeric_count") > 0
    numeric = [F.avg(F.when(has, F.col(c))).alias(c) for c in ("numeric_accuracy", "numeric_precision", "numeric_recall", "numeric_f1")]
    return scores.groupBy(by).agg(F.count("*").alias("question_count"), F.sum(has.cast("int")).alias("numeric_applicable_count"), F.avg("exact_match").alias("exact_match"), F.avg("token_f1").alias("token_f1"), *numeric)

"""Ranks, medians and quartiles of groups of any size: no task sees all values of a group, and none is buffered.

Equal values become one row with their count before anything moves. The rows are dealt to ranges of (group, value); each range counts within itself, and the
sums of the ranges before it, a row per range and group, are added on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialise
from .sparse import small


def same(left: list[str], right: list[str]) -> Column:
    """Equality of columns in which nulls are equal too."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)], F.lit(True))


def ranked_values(rows: DataFrame, by: list[str], value: str, **sums: Column) -> DataFrame:
    """rows -> one row per group (by) and value: n rows, `before` rows of smaller value in the group, `total` rows of the group, and the sums. Nulls in `by` are a group."""
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    dealt = materialise(counted.repartitionByRange(*by, value).withColumn("_r", F.spark_partition_id()), "ranges")
    smaller = Window.partitionBy("_r", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("_c", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    ranges = dealt.groupBy("_r", *by).agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select(F.col("_r").alias("_range"), *[F.col(c).alias(f"_{c}") for c in by], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b"), F.sum("_n").over(Window.partitionBy(*by)).alias("total"))
    out = within.join(small(base), same(["_r", *by], ["_range", *[f"_{c}" for c in by]]))
    return out.select(*by, value, "n", (F.col("_b") + F.col("_c")).alias("before"), "total", *sums)


def quantiles(rows: DataFrame, by: list[str], columns: list[str], at: list[float]) -> DataFrame:
    """by, column, q (array, one value per share of `at`): exact quantiles with linear interpolation of each column's values that are there."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_x")).select(*by, "_x.column", "_x.value").where("value is not null")
    r = ranked_values(long, [*by, "column"], "value")
    place = [F.lit(q) * (F.col("total") - 1) for q in at]
    holds = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
    ends = [F.max(F.when(holds(f(p)), F.col("value"))).alias(f"_{name}{k}") for k, p in enumerate(place) for name, f in (("lo", F.floor), ("hi", F.ceil))]
    g = r.groupBy(*by, "column").agg(F.max("total").alias("total"), *ends)

    def between(k: int, p: Column) -> Column:
        lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        return F.when(lo == hi, lo).otherwise(lo * (F.ceil(p) - p) + hi * (p - F.floor(p)))

    return g.select(*by, "column", F.array(*[between(k, p) for k, p in enumerate(place)]).alias("q"))


def with_quantiles(grouped: DataFrame, rows: DataFrame, by: list[str], column: str, at: list[float], name: str = "q") -> DataFrame:
    """grouped (one row per group) with the quantiles of a column of its rows, null where no value is there."""
    q = quantiles(rows, by, [column], at).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("q").alias(name))
    return grouped.join(small(q), same(by, [f"_{c}" for c in by]), "left").drop(*[f"_{c}" for c in by])

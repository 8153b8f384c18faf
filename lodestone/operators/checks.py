"""Integrity rules. Each gives a frame of violations (rule, key, detail); enforce() raises if there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollups import nunique


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def _violations(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def missing_columns(frames: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """Columns that frames lack, by the frame's name: what require_columns() would raise for each."""
    spark = next(iter(frames.values())).sparkSession
    rows = [("missing_column", name, c) for name, columns in required.items() for c in sorted(set(columns) - set(frames[name].columns))]
    return spark.createDataFrame(rows, "rule string, key string, detail string")


def duplicate_keys(df: DataFrame, keys: list[str], rule: str = "duplicate_key") -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return _violations(g, rule, F.concat_ws("|", *keys), F.col("n"))


def coverage(df: DataFrame, expected: DataFrame, keys: list[str], rule: str = "coverage") -> DataFrame:
    """Keys that are expected and missing, or there and unexpected."""
    a = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    b = df.select(*keys).distinct().withColumn("_f", F.lit(1))
    g = a.join(b, keys, "full_outer").where("_e is null or _f is null")
    return _violations(g, rule, F.concat_ws("|", *keys), F.when(F.col("_f").isNull(), "missing").otherwise("unexpected"))


def order_equality(df: DataFrame, expected: DataFrame, position: str, key: str, rule: str = "order") -> DataFrame:
    g = df.select(position, F.col(key).alias("_a")).join(expected.select(position, F.col(key).alias("_b")), position, "full_outer").where("not (_a <=> _b)")
    return _violations(g, rule, F.col(position), F.concat_ws(" / ", F.coalesce(F.col("_a").cast("string"), F.lit("none")), F.coalesce(F.col("_b").cast("string"), F.lit("none"))))


def functional_dependency(df: DataFrame, key: str, columns: list[str], rule: str = "functional_dependency") -> DataFrame:
    """Keys with more than one value, null counted as one, in a column that they should determine."""
    g = df.groupBy(key).agg(F.concat_ws(",", *[F.when(nunique(c) > 1, F.lit(c)) for c in columns]).alias("d")).where("d <> ''")
    return _violations(g, rule, F.col(key), F.col("d"))


def predicate(df: DataFrame, ok: Column, key: Column, rule: str) -> DataFrame:
    """Rows for which ok is false or null."""
    return _violations(df.where(~F.coalesce(ok, F.lit(False))), rule, key, F.lit("predicate"))


def counts_equal(df: DataFrame, by: str, declared: DataFrame, count: str, rule: str = "declared_count") -> DataFrame:
    g = df.groupBy(by).agg(F.count("*").alias("_n")).join(declared.select(by, F.col(count).alias("_d")), by, "full_outer").where("not (_n <=> _d)")
    return _violations(g, rule, F.col(by), F.concat_ws("/", F.coalesce("_n", F.lit(0)), F.coalesce("_d", F.lit(0))))


def values_agree(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12, rule: str = "published_value") -> DataFrame:
    j = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns]).join(b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns]), keys, "full_outer")
    far = [F.when(~F.coalesce(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) <= tolerance, F.col(f"_a_{c}").isNull() & F.col(f"_b_{c}").isNull()), F.lit(c)) for c in columns]
    g = j.withColumn("_d", F.concat_ws(",", *far)).where("_d <> ''")
    return _violations(g, rule, F.concat_ws("|", *keys), F.col("_d"))


def ranks_valid(df: DataFrame, by: str, rank: str = "rank", most: int = 5, rule: str = "ranks") -> DataFrame:
    """Ranks must be 1..n without repeats and n at most `most`."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(rank).alias("m"), F.min(rank).alias("lo"), F.max(rank).alias("hi")).where(f"n > {most} or n <> m or lo <> 1 or hi <> n")
    return _violations(g, rule, F.col(by), F.concat_ws("/", "n", "m", "lo", "hi"))


def nested(df: DataFrame, by: list[str], inner: str, outer: str, stage: str = "stage", rule: str = "stage_nesting") -> DataFrame:
    """Members of the inner stage that the outer stage lacks."""
    a = df.where(F.col(stage) == inner).select(*by).distinct()
    return _violations(a.join(df.where(F.col(stage) == outer).select(*by).distinct(), by, "left_anti"), rule, F.concat_ws("|", *by), F.lit(f"{inner} not in {outer}"))


def together(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def enforce(violations: DataFrame, show: int = 10) -> None:
    """Raises with the first violations, if any."""
    found = violations.limit(show).collect()
    if found:
        raise ValueError("; ".join(f"{r.rule} {r.key}: {r.detail}" for r in found))

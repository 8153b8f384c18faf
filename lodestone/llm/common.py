"""Helpers that all operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import kept, materialise, scratch, shared_dir

__all__ = ["BROADCAST_BYTES", "PER_SALT", "batch", "bound_batches", "fan_join", "kept", "materialise", "maybe_broadcast", "scratch", "shared_dir", "table", "wide_rows"]

#: A side is broadcast only after its rows were counted and it takes at most so many bytes.
BROADCAST_BYTES = 64 << 20
#: Rows that ask for one row in one task of fan_join(); a row that more ask for is dealt out several times.
PER_SALT = 256


#: Bytes of an Arrow batch, which the JVM, the pipe and a worker each hold a copy of.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's spark.sql.execution.arrow.maxBytesPerBatch to BATCH_BYTES at most, so what a worker holds at once follows neither rows nor their length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 8) -> Iterator[None]:
    """Inside, tables whose single rows take megabytes are read a few rows at a time; only for what is executed inside."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the counted rows fit the limit; otherwise Spark shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fan_join(ask: DataFrame, rows: DataFrame, on: list[str], asked: str, spread: str) -> DataFrame:
    """ask joined with rows, stored and one row per `on`; asked counts the rows of ask for each of rows. What very many ask for is dealt out to
    several tasks, the asking rows by the hash of their column spread."""
    salts = F.ceil(F.col(asked) / PER_SALT).cast("int")
    wide = rows.where(salts > 1).select(*on, salts.alias("salts"))
    n = wide.count()
    if not n:
        return ask.join(rows.drop(asked), on)
    wide = F.broadcast(wide) if n * 64 <= BROADCAST_BYTES else wide
    ask = ask.join(wide, on, "left").withColumn("salt", F.pmod(F.xxhash64(spread), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    dealt = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), salts) - 1))).drop(asked)
    return ask.join(dealt, [*on, "salt"]).drop("salt")


def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

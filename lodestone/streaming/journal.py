"""Resumable ingestion: new files are taken up by a stream, each key is judged once, results are appended."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that a checkpoint belongs to; it lies in the checkpoint and goes with it."""
    at, fs = _path(spark, f"{checkpoint}/journal-run")
    if fs.exists(at):
        return spark.read.text(f"{checkpoint}/journal-run").first()[0]
    run = uuid.uuid4().hex
    out = fs.create(at, False)
    out.write(bytearray(run.encode()))
    out.close()
    return run


def read_journal(spark: SparkSession, journal: str) -> DataFrame:
    """What all runs have appended."""
    return spark.read.parquet(journal).drop("run", "batch")


def ingest(spark: SparkSession, source: str, schema: str, keys: list[str], work: Callable[[DataFrame], DataFrame], journal: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Reads what is new under source, drops keys that were read before, applies work and appends; stops when all is read.

    Which keys a run has read is the stream's own keyed state (on disk, in RocksDB), so a batch costs what its rows cost, however long the journal is. A batch is written to a
    place of its own and replaces what a killed attempt left there, so nothing is appended twice. Keys that other runs left in the journal (their checkpoints are gone) are
    looked up there; this run's own rows never are.
    """
    run = _run_of(spark, checkpoint)
    at, fs = _path(spark, journal)
    others = fs.exists(at) and any(x.getPath().getName() not in (f"run={run}", "_SUCCESS") for x in fs.listStatus(at))
    before = spark.read.parquet(journal).where(F.col("run") != run).select(*keys) if others else None

    def batch(df: DataFrame, number: int) -> None:
        fresh = df if before is None else df.join(before, keys, "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{journal}/run={run}/batch={number}")

    was = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source).dropDuplicates(keys)
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, was)  # a query keeps the settings it was started with


def windowed_latency(events: DataFrame, time: str, by: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and maximum per window; rows later than the watermark don't count."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))

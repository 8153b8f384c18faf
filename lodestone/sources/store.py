"""The folder that driver and executors share, and tables written to it between steps."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session, as in tests, uses a folder of its own
    machine; on a cluster that would be another folder on each machine, so there it raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


#: Paths that materialise() has written in the innermost scratch() that is open.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


#: For tables whose single rows take megabytes: pages and row groups end by their bytes, not after a hundred rows.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.block.size": str(16 << 20)}


def materialise(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Cut lineage: write df once to the shared folder and read it back, so a lost executor costs no recomputation. With `by`, a folder for each value of that column,
    so that who asks for one value reads its rows only. options are the writer's."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, partitionBy=by)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialise() writes inside is removed at the end: for steps of which nothing reads the tables afterwards."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result of make(), written; the tables that it wrote on its way are removed once the result stands."""
    outer = _MADE.get()
    with scratch(spark):
        made = make()
        inner = _MADE.set(outer)
        try:
            return materialise(made, name)
        finally:
            _MADE.reset(inner)

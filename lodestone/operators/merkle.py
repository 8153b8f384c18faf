"""Order-sensitive digests of tables of any size, as trees: a leaf is a range of places, and two trees name the ranges that differ.

A node's digest is that of its children's, in order, so a task gathers FAN digests at most, and what has not changed need not be read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialise
from .ranks import same
from .sparse import small

#: Places of a leaf, and children of a node.
FAN = 1024


def row_digest(*columns: str):
    """SHA-256 over columns as text, each with its length, so neighbours can't be mistaken for one another; a null is told from an empty text."""
    part = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat(*part), 256)


def places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, their position from 0 in the order of the columns, which must tell all rows apart. Ranges are numbered within and shifted by the rows of the ranges before."""
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_r", F.spark_partition_id()), "ranges")
    numbered = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_r").orderBy(*order)))
    ranges = dealt.groupBy("_r").agg(F.count("*").alias("_n"))
    base = ranges.select(F.col("_r").alias("_range"), (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_b"))  # a row per range
    return numbered.join(small(base), F.col("_r") == F.col("_range")).withColumn("place", F.col("_b") + F.col("_k") - 1).drop("_r", "_k", "_b", "_range")


def _level(nodes: DataFrame, by: list[str], level: int) -> DataFrame:
    """Nodes (by, node, first_place, last_place, rows, digest) rolled up by FAN."""
    g = nodes.groupBy(*by, F.floor(F.col("node") / FAN).alias("up")).agg(
        F.min("first_place").alias("first_place"), F.max("last_place").alias("last_place"), F.sum("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("x")
    )
    return g.select(F.lit(level).alias("level"), *by, F.col("up").alias("node"), "first_place", "last_place", "rows", F.sha2(F.array_join(F.transform("x", lambda v: v["digest"]), ""), 256).alias("digest"))


def tree(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """rows (by, place, digest) -> level, by, node, first_place, last_place, rows, digest: leaves at level 0, one root per group at the highest. Places tell a group's rows apart."""
    by = list(by)
    level = materialise(_level(rows.select(*by, F.col("place").alias("node"), F.col("place").alias("first_place"), F.col("place").alias("last_place"), F.lit(1).alias("rows"), "digest"), by, 0), "tree")
    levels = [level]
    while len(levels) == 1 or not level.where("node > 0").isEmpty():
        level = materialise(_level(level, by, len(levels)), "tree")
        levels.append(level)
    return reduce(DataFrame.unionAll, levels)


def roots(made: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, rows, digest of each group's root."""
    top = made.agg(F.max("level").alias("_top"))
    return made.join(F.broadcast(top), F.col("level") == F.col("_top")).select(*by, "rows", "digest")


def changes(was: DataFrame, now: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, node, first_place, last_place, status of the leaves that differ: changed (with the places they had), added or removed."""
    by = list(by)
    cols = ["node", "first_place", "last_place", "digest"]
    a = was.where("level = 0").select(*by, *cols)
    b = now.where("level = 0").select(*[F.col(c).alias(f"_{c}") for c in [*by, *cols]])
    j = a.join(b, same([*by, "node"], [f"_{c}" for c in [*by, "node"]]), "full").where(~F.col("digest").eqNullSafe(F.col("_digest")))
    status = F.when(F.col("_digest").isNull(), "removed").when(F.col("digest").isNull(), "added").otherwise("changed")
    there = F.col("digest").isNotNull()
    pick = [F.when(there, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in [*by, "node", "first_place", "last_place"]]
    return j.select(*pick, status.alias("status"))

"""Indices on disk, with what is needed to refuse a stale one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dense import block_index
from ..operators.merkle import places, roots, row_digest, tree
from ..operators.sparse import SparseIndex
from ..schemas import INDEX_VERSION


def corpus_digest(docs: DataFrame, id_col: str, text_col: str) -> str:
    """Digest of (id, text) over all rows in order of the ids: the root of a tree, so nothing is gathered and the order of ids counts. Ids are unique."""
    rows = docs.select(F.col(id_col).alias("id"), row_digest(id_col, text_col).alias("digest"))
    root = roots(tree(places(rows, ["id"]))).first()
    return f"{root.rows}:{root.digest}" if root else "0:"


def _meta(spark: SparkSession, path: str, kind: str, digest: str | None, **also) -> None:
    row = {"kind": kind, "version": INDEX_VERSION, "digest": digest, **{k: str(v) for k, v in also.items()}}
    spark.createDataFrame([row], ", ".join(f"{k} {'int' if k == 'version' else 'string'}" for k in row)).coalesce(1).write.json(f"{path}/meta")


def stale(spark: SparkSession, path: str, kind: str, digest: str | None = None, **expected) -> list[tuple[str, str, str]]:
    """(rule, what, found/expected) of all that an index was not made as expected with: kind, version, corpus digest, and whatever is named, such as dim, rows, prefix, tokenizer, token_budget."""
    meta = spark.read.json(f"{path}/meta").first().asDict()
    want = {"kind": kind, "version": INDEX_VERSION, **({"digest": digest} if digest else {}), **{k: str(v) for k, v in expected.items()}}
    return [("stale_index", k, f"{meta.get(k)}/{v}") for k, v in want.items() if meta.get(k) != v]


def _check(spark: SparkSession, path: str, kind: str, digest: str | None, **also) -> None:
    if wrong := stale(spark, path, kind, digest, **also):
        raise ValueError("stale index: " + "; ".join(f"{k} {detail}" for _, k, detail in wrong))


def save_sparse(index: SparseIndex, path: str, digest: str) -> None:
    """Tables first, meta last: an index without meta is none."""
    for name in ("rows", "terms", "stats"):
        getattr(index, name).write.parquet(f"{path}/{name}")
    _meta(index.rows.sparkSession, path, "sparse", digest)


def load_sparse(spark: SparkSession, path: str, digest: str | None = None) -> SparseIndex:
    _check(spark, path, "sparse", digest)
    return SparseIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("rows", "terms", "stats")))


def save_dense(vectors: DataFrame, path: str, digest: str, dim: int, prefix: str = "", keep: list[str] | None = None, **said) -> None:
    """vectors (id, v, *keep) as blocks that a search can pass over. Every row must have `dim` components. said: what else they were made with (tokenizer, token_budget, ...), which
    loading may ask for."""
    spark = vectors.sparkSession
    block_index(vectors, keep, dim).write.parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors").agg(F.sum(F.size("ids"))).first()[0] or 0
    _meta(spark, path, "dense", digest, dim=dim, prefix=prefix, rows=rows, **said)


def load_dense(spark: SparkSession, path: str, digest: str | None = None, **expected) -> DataFrame:
    """The blocks, for search_blocks()."""
    _check(spark, path, "dense", digest, **expected)
    return spark.read.parquet(f"{path}/vectors")

"""Projections, samples, splits and strict values of evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What answer records and diagnostics keep of a chunk, in this order.
RESULT_FIELDS = (
    "chunk_id", "doc_name", "page", "company", "fiscal_year", "document_type", "text", "rank", "score", "dense_score", "dense_rank", "sparse_score", "sparse_rank", "rrf_score",
    "reranker_score", "first_stage_score", "retrieval_method", "reranker_input_tokens", "reranker_input_truncated", "reranker_window_count", "reranker_best_window_index",
    "reranker_best_window_tokens", "component_scores", "component_ranks",
)
DIAGNOSTIC_FIELDS = (
    "chunk_id", "doc_name", "page", "company", "fiscal_year", "rank", "dense_rank", "dense_score", "sparse_rank", "sparse_score", "rrf_rank", "rrf_score", "reranker_rank", "reranker_score",
    "reranker_input_tokens", "reranker_input_truncated", "reranker_window_count", "reranker_best_window_index", "reranker_best_window_tokens",
)


def slim(chunks: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """What an answer record keeps of a chunk: the fields that there are, in their fixed order."""
    return chunks.select(*also, *[c for c in RESULT_FIELDS if c in chunks.columns])


def compact(chunks: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """What diagnostics keep: no text."""
    return chunks.select(*also, *[c for c in DIAGNOSTIC_FIELDS if c in chunks.columns])


def split_by_ids(df: DataFrame, ids: DataFrame, key: str, inside: str = "dev", outside: str = "heldout") -> DataFrame:
    """df with part: `inside` where ids has the key, else `outside`; a null key is outside. The ids must all be there, else it raises."""
    known = ids.select(F.col(key)).distinct()
    lost = known.join(df.select(key), key, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"ids that are not there: {', '.join(str(r[0]) for r in lost)}")
    return df.join(known.withColumn("_in", F.lit(True)), key, "left").withColumn("part", F.when(F.col("_in"), inside).otherwise(outside)).drop("_in")


def hash_ordered(df: DataFrame, key: str, prefix: str, n: int) -> DataFrame:
    """The first n rows in the order of sha256(prefix + key), ties by key: a sample that anyone can draw again."""
    return df.orderBy(F.sha2(F.concat(F.lit(prefix), F.col(key).cast("string")), 256), key).limit(n)


def first_by_position(df: DataFrame, position: str, n: int) -> DataFrame:
    """Rows at positions under n; positions start at 0. A plain filter, so nothing is sorted."""
    return df.where(F.col(position) < n)


def even_positions(df: DataFrame, n: int) -> DataFrame:
    """position: n places spread evenly over df's rows, first and last included, halves to even."""
    if n < 2:
        raise ValueError("an even spread needs two places at least")
    return df.agg(F.count("*").alias("rows")).select("rows", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(F.bround(F.col("i") * (F.col("rows") - 1) / float(n - 1)).cast("long").alias("position"))


def tagged(df: DataFrame, column: str, tag: str) -> DataFrame:
    """Rows whose comma-separated column names the tag."""
    return df.where(F.array_contains(F.transform(F.split(column, ","), lambda x: F.trim(x)), tag))


def page_refs(refs: Column) -> Column:
    """Compact JSON of array<struct<doc_name, page>>; a reference without a document or with a negative page raises."""
    ok = F.forall(refs, lambda r: (F.length(F.coalesce(r["doc_name"], F.lit(""))) > 0) & (F.coalesce(r["page"], F.lit(-1)) >= 0))
    return F.when(ok, F.to_json(F.transform(refs, lambda r: F.struct(r["doc_name"].alias("doc_name"), r["page"].alias("page"))))).otherwise(F.raise_error(F.lit("invalid page reference")))


def canonical(columns: list[str]) -> Column:
    """JSON of the columns with sorted keys, no blanks, and nulls written."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprint(columns: list[str]) -> Column:
    return F.sha2(canonical(columns), 256)


def flag(c: Column) -> Column:
    """Boolean of 0 and 1; anything else raises."""
    return F.when(c.isin(0, 1), c == 1).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("boolean"))


def required_text(c: Column) -> Column:
    """Without blanks around; null and blank raise."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    return F.when(t != "", t).otherwise(F.raise_error(F.lit("text must not be blank")))


def temperature(c: Column) -> Column:
    """A number from 0 to 2; 'none' and blank are null; anything else raises."""
    x = F.expr("1.0d") * F.try_to_number(F.trim(c), F.lit("9.99999")).cast("double")
    blank = F.lower(F.trim(c)).isin("", "none") | c.isNull()
    return F.when(blank, F.lit(None).cast("double")).when((x >= 0) & (x <= 2), x).otherwise(F.raise_error(F.concat(F.lit("not a temperature: "), c)).cast("double"))


def milliseconds(c: Column) -> Column:
    """'1234.5 ms'; null is 'n/a'."""
    return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.1f ms", c.cast("double")))

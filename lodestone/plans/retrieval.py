"""Queries over the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import dense, fusion, sparse
from .common import query, table

TOKENS = "regexp_extract_all(coalesce(text, ''), '[$£€]?[A-Za-z0-9]+(?:[&./-][A-Za-z0-9]+)*%?')"
BM25 = f"""
t AS (SELECT doc_id, list_transform({TOKENS}, lambda x: lower(x)) AS t FROM documents),
l AS (SELECT doc_id, len(t) AS dl FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, s),
m AS (SELECT avg(raw) AS avg_idf FROM r),
i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg_idf ELSE raw END AS idf FROM r, m),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_transform({TOKENS}, lambda x: lower(x))) AS term FROM benchmark) GROUP BY 1, 2),
z AS (SELECT q.item_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM q JOIN i USING (term) JOIN p USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2)"""


def _bm25(spark, sf_dir, k):
    index = sparse.build_index(table(spark, sf_dir, "documents"))
    return sparse.search(index, sparse.query_terms(table(spark, sf_dir, "benchmark")), k)


@query(f"WITH {BM25} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM s, m")
def bm25_index_stats(spark, sf_dir):
    return sparse.build_index(table(spark, sf_dir, "documents")).stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


@query(f"WITH {BM25} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM i")
def bm25_term_idf(spark, sf_dir):
    return sparse.build_index(table(spark, sf_dir, "documents")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


_TOP = "SELECT item_id, CAST(rank AS INT) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {src}) WHERE rank <= {k}"


@query(f"WITH {BM25}, e AS (SELECT a.item_id, l.doc_id, coalesce(z.score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM q) a CROSS JOIN l LEFT JOIN z ON z.item_id = a.item_id AND z.doc_id = l.doc_id) " + _TOP.format(src="e", k=5))
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 5).select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    f"WITH {BM25}, f AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS lang FROM benchmark), e AS (SELECT a.item_id, x.doc_id, coalesce(z.score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM q) a JOIN f USING (item_id) JOIN documents x ON x.lang = f.lang LEFT JOIN z ON z.item_id = a.item_id AND z.doc_id = x.doc_id) "
    + _TOP.format(src="e", k=5)
)
def bm25_topk_filtered(spark, sf_dir):
    """Each query sees one language's documents; statistics stay those of all."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = sparse.build_index(docs, keep=["lang"])
    wanted = items.select(F.col("item_id").alias("query_id"), F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.pmod("item_id", F.lit(4)) + 1).cast("int")).alias("lang"))
    found = sparse.search(index, sparse.query_terms(items), 5, wanted)
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    rows = v.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    return rows, rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")


_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_DENSE = "SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, " + _DOT + " AS score FROM embeddings a JOIN embeddings b ON {on} WHERE a.vec_id % 50 = 0)) WHERE rank <= 10"


@query(_DENSE.format(on="true"))
def dense_topk(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return dense.exact_top_k(rows, asked, 10).withColumn("score", F.round("score", 6))


@query(_DENSE.format(on="a.label = b.label"))
def dense_topk_filtered(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return dense.exact_top_k(rows, asked, 10, on=["label"]).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5)) AS unit FROM embeddings")
def dense_normalise(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.transform(dense.normalise(F.col("embedding")), lambda x: rounded(x, 5)).alias("unit"))


#: The second source ranks by the number of distinct terms shared.
_OVERLAP = "o AS (SELECT q.item_id, p.doc_id, CAST(count(*) AS DOUBLE) AS score FROM q JOIN p USING (term) GROUP BY 1, 2)"
_TWO = f"{BM25}, {_OVERLAP}, a AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM z QUALIFY rank <= 10), b AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM o QUALIFY rank <= 10)"
_FUSED = "f AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS min_rank, max(CASE WHEN s = 1 THEN rank END) AS overlap_rank, max(CASE WHEN s = 2 THEN rank END) AS bm25_rank FROM (SELECT *, 2 AS s FROM a UNION ALL SELECT *, 1 AS s FROM b) GROUP BY 1, 2)"


def _two(spark, sf_dir, k=10):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index, terms = sparse.build_index(docs), sparse.query_terms(items)
    return tuple(found.where("score > 0") for found in (sparse.shared_terms(index, terms, k), sparse.search(index, terms, k)))


@query(f"WITH {_TWO}, {_FUSED} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, min_rank, doc_id) AS INT) AS rank, doc_id, round(rrf, 9) AS rrf, CAST(min_rank AS INT) AS min_rank, CAST(overlap_rank AS INT) AS overlap_rank, CAST(bm25_rank AS INT) AS bm25_rank FROM f QUALIFY rank <= 5")
def rrf_fusion(spark, sf_dir):
    overlap, bm25 = _two(spark, sf_dir)
    f = fusion.fuse({"overlap": overlap, "bm25": bm25}, 60, 5)
    return f.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("rrf", 9).alias("rrf"), "min_rank", F.col("component_ranks")["overlap"].alias("overlap_rank"), F.col("component_ranks")["bm25"].alias("bm25_rank"))


@query(f"WITH {_TWO}, {_FUSED} SELECT item_id, CAST(count(overlap_rank) AS BIGINT) AS dense_n, CAST(count(bm25_rank) AS BIGINT) AS bm25_n, CAST(count(*) AS BIGINT) AS union_n, CAST(count(*) FILTER (overlap_rank IS NOT NULL AND bm25_rank IS NOT NULL) AS BIGINT) AS both_n FROM f GROUP BY 1")
def hybrid_diagnostics(spark, sf_dir):
    overlap, bm25 = _two(spark, sf_dir)
    return fusion.hybrid(overlap, bm25, 5)[1].withColumnRenamed("query_id", "item_id")

"""Whole retrieval of the architectures over questions that filter by company and year or not, on vectors that are read from a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pipelines
from .common import query, table
from .retrieval import TOKENS

_TOKENS = TOKENS.replace("text", "{0}")
_BASE = f"""n AS (SELECT count(*) AS n FROM embeddings),
c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id, coalesce(text, '') AS text, 'Company: ' || lang || chr(10) || 'Document: ' || source || chr(10) || chr(10) AS header, lang AS company, CAST(2015 + doc_id % 9 AS INT) AS fy FROM documents),
v AS (SELECT chunk_id, company, fy, CAST(embedding AS DOUBLE[]) AS v FROM c, n, embeddings WHERE vec_id = doc_id % n),
q AS (SELECT CAST(item_id AS VARCHAR) AS question_id, text AS query, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' END AS company, CASE WHEN item_id % 2 = 0 THEN CAST(2015 + item_id % 9 AS INT) END AS fy, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
ok AS (SELECT question_id, chunk_id, list_inner_product(q.v, v.v) AS dot FROM q JOIN v ON (q.company IS NULL OR q.company = v.company) AND (q.fy IS NULL OR q.fy = v.fy)),
de AS (SELECT question_id, chunk_id, dot AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(dot, 9) DESC, chunk_id) AS rank FROM ok)"""
_WORDS = f"""t AS (SELECT chunk_id, list_transform({_TOKENS.format('(header || text)')}, lambda x: lower(x)) AS t FROM c),
l AS (SELECT chunk_id, len(t) AS dl FROM t), s AS (SELECT count(*) AS m, avg(dl) AS avgdl FROM l),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM t) GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT term, ln(m - df + 0.5) - ln(df + 0.5) AS raw FROM d, s), a AS (SELECT avg(raw) AS mean FROM r),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM r, a),
qt AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest(list_transform({_TOKENS.format('query')}, lambda x: lower(x))) AS term FROM q) GROUP BY 1, 2),
z AS (SELECT question_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN i USING (term) JOIN p USING (term) JOIN l USING (chunk_id), s GROUP BY 1, 2),
sp AS (SELECT question_id, chunk_id, coalesce(z.score, 0.0) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(coalesce(z.score, 0.0), 9) DESC, chunk_id) AS rank FROM ok LEFT JOIN z USING (question_id, chunk_id))"""
_FUSED = """fu AS (SELECT question_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(rank) AS least FROM (SELECT question_id, chunk_id, rank FROM de WHERE rank <= {k} UNION ALL SELECT question_id, chunk_id, rank FROM sp WHERE rank <= {k}) GROUP BY 1, 2),
fr AS (SELECT question_id, chunk_id, rrf, row_number() OVER (PARTITION BY question_id ORDER BY round(rrf, 12) DESC, least, chunk_id) AS rank FROM fu)"""
_SAID = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_RERANKED = rf"""k AS (SELECT question_id, chunk_id, rank, query, header, text, regexp_extract_all(text, '\s*\S+') AS x, len(regexp_extract_all(query, '\S+')) AS qn, len(regexp_extract_all(header, '\S+')) AS hn, len(regexp_extract_all(header || text, '\S+')) AS fn FROM fr JOIN c USING (chunk_id) JOIN q USING (question_id) WHERE rank <= 20),
b AS (SELECT *, qn + fn + 3 > 512 AS cut, CASE WHEN 512 - qn - 3 - hn >= 32 THEN header ELSE '' END AS head, CASE WHEN 512 - qn - 3 - hn >= 32 THEN 512 - qn - 3 - hn ELSE 512 - qn - 3 END AS body FROM k),
w AS (SELECT *, greatest(1, body - least(64, body - 1)) AS step FROM b),
y AS (SELECT *, unnest(range(0, CASE WHEN cut AND body > 0 AND len(x) > body THEN CAST(ceil((len(x) - body) / CAST(step AS DOUBLE)) AS BIGINT) + 1 ELSE 1 END)) AS win FROM w),
u AS (SELECT question_id, chunk_id, rank, query, win, CASE WHEN cut AND body > 0 AND len(x) > 0 THEN head || array_to_string(x[win * step + 1:win * step + body], '') ELSE header || text END AS txt FROM y),
o AS (SELECT question_id, chunk_id, rank, max(CASE WHEN len({_SAID.format('query')}) > 0 THEN len(list_intersect({_SAID.format('query')}, {_SAID.format('txt')})) / len({_SAID.format('query')}) ELSE 0.0 END) AS score FROM u GROUP BY 1, 2, 3)"""


def _retrieved(spark, sf_dir, architecture):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    n = vectors.count()
    header = F.concat(F.lit("Company: "), "lang", F.lit("\nDocument: "), "source", F.lit("\n\n"))
    text = F.coalesce("text", F.lit(""))
    chunks = docs.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("doc_name"), F.lit(0).alias("page"), text.alias("text"), F.concat(header, text).alias("retrieval_text"), F.col("lang").alias("company"), (2015 + F.col("doc_id") % 9).cast("int").alias("fiscal_year"))
    v = chunks.select(F.col("chunk_id").alias("id"), (F.col("doc_id") % n).alias("vec_id")).join(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id")
    corpus = pipelines.build_corpus(chunks.drop("doc_id"), vectors=v)
    item = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").join(vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v")), "item_id")
    company = F.when(item % 4 == 0, "en").when(item % 4 == 1, "fr").when(item % 4 == 2, "de")
    asked = asked.select(item.cast("string").alias("question_id"), F.col("text").alias("retrieval_query"), "v", company.alias("company"), F.when(item % 2 == 0, (2015 + item % 9).cast("int")).alias("fiscal_year"))
    return pipelines.retrieve(architecture, corpus, asked).select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BASE} SELECT question_id, CAST(rank AS INT) AS rank, chunk_id, round(score, 6) AS score FROM de WHERE rank <= 5")
def retrieval_p1(spark, sf_dir):
    return _retrieved(spark, sf_dir, "P1")


@query(f"WITH {_BASE}, {_WORDS}, {_FUSED.format(k=10)} SELECT question_id, CAST(rank AS INT) AS rank, chunk_id, round(rrf, 6) AS score FROM fr WHERE rank <= 5")
def retrieval_p2(spark, sf_dir):
    return _retrieved(spark, sf_dir, "P2")


@query(f"WITH {_BASE}, {_WORDS}, {_FUSED.format(k=20)}, {_RERANKED} SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank, chunk_id) AS INT) AS rank, chunk_id, round(score, 6) AS score FROM o QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank, chunk_id) <= 5")
def retrieval_p3(spark, sf_dir):
    return _retrieved(spark, sf_dir, "P3")

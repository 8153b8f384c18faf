"""Queries over text functions, chunks, evidence and retrieval scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evidence, retrieval_eval, sparse
from .common import query, table
from .retrieval import BM25, _bm25

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\x00', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {_CLEAN} AS clean FROM (SELECT doc_id, replace(text, '. ', '.  ' || chr(13) || chr(10)) || '  ' AS x FROM documents)")
def clean_text(spark, sf_dir):
    x = F.concat(F.replace("text", F.lit(". "), F.lit(".  \r\n")), F.lit("  "))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(x).alias("clean"))


@query("SELECT item_id, list_transform(regexp_extract_all(text, '[$£€]?[A-Za-z0-9]+(?:[&./-][A-Za-z0-9]+)*%?'), lambda x: lower(x)) AS tokens FROM benchmark")
def financial_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.financial_tokens(F.col("text")).alias("tokens"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS company_key FROM customer")
def company_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.company_key(F.col("c_name")).alias("company_key"))


@query("SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(trim(s_name || ' / ' || s_suppkey), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS safe_id FROM supplier")
def safe_ids(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.safe_identifier(F.concat_ws(" / ", "s_name", "s_suppkey")).alias("safe_id"))


@query("""SELECT s_suppkey, replace('ACME_' || s_suppkey || '_CO', '_', ' ') AS company, CAST(2010 + s_suppkey % 10 AS INT) AS fiscal_year, CASE WHEN s_suppkey % 2 = 0 THEN '10-K' ELSE '10-Q' END AS document_type,
 'Company: ACME ' || s_suppkey || ' CO' || chr(10) || 'Fiscal year: ' || (2010 + s_suppkey % 10) || chr(10) || 'Document type: ' || CASE WHEN s_suppkey % 2 = 0 THEN '10-K' ELSE '10-Q' END || chr(10) || 'Document: ' || 'ACME_' || s_suppkey || '_CO_' || (2010 + s_suppkey % 10) || CASE WHEN s_suppkey % 2 = 0 THEN '_10K' ELSE 'Q3_10Q' END || chr(10) || 'Page: 0' || chr(10) || chr(10) AS header FROM supplier""")
def document_headers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("ACME_"), "s_suppkey", F.lit("_CO_"), 2010 + F.col("s_suppkey") % 10, F.when(F.col("s_suppkey") % 2 == 0, "_10K").otherwise("Q3_10Q"))
    null = F.lit(None).cast("string")
    d = s.select("s_suppkey", name.alias("n")).withColumn("m", T.document_metadata(F.col("n"), null, null, null))
    return d.select("s_suppkey", "m.company", "m.fiscal_year", "m.document_type", T.retrieval_header(F.col("m"), F.col("n"), F.lit(0)).alias("header"))


_Q = """'Assume that you are an analyst. What was the FY' || (2010 + CAST(o_orderkey % 12 AS INT)) || ' capex of NATION-' || (o_orderkey % 30) || ' in the balance sheet? Answer in USD millions.'"""


@query(f"""WITH q AS (SELECT o_orderkey, {_Q} AS q FROM orders),
c AS (SELECT o_orderkey, list_sort(list(DISTINCT regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g'))) AS k FROM q, nation
 WHERE regexp_matches(q, '(?i)(^|[^A-Za-z0-9])' || regexp_replace(n_name, '[^A-Za-z0-9]+', '[^A-Za-z0-9]*', 'g') || '($|[^A-Za-z0-9])') OR contains(regexp_replace(lower(q), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g')) GROUP BY 1)
SELECT q.o_orderkey, CASE WHEN len(k) = 1 THEN k[1] END AS company, CAST(2010 + o_orderkey % 12 AS INT) AS fiscal_year,
 'What was the FY' || (2010 + CAST(o_orderkey % 12 AS INT)) || ' capex of NATION-' || (o_orderkey % 30) || ' in the balance sheet? USD millions consolidated balance sheet capital expenditure capital spending purchases of property plant and equipment ' || (2010 + CAST(o_orderkey % 12 AS INT)) AS retrieval_query
FROM q LEFT JOIN c USING (o_orderkey)""")
def query_processing(spark, sf_dir):
    """Questions with a year, boilerplate and a company of which more than one may match."""
    from ..operators.query_processing import process_queries

    q = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.format_string("Assume that you are an analyst. What was the FY%d capex of NATION-%d in the balance sheet? Answer in USD millions.", 2010 + F.pmod("o_orderkey", F.lit(12)), F.pmod("o_orderkey", F.lit(30))).alias("question")
    )
    return process_queries(q, table(spark, sf_dir, "nation").select(F.col("n_name").alias("company")), "o_orderkey").select("o_orderkey", "company", "fiscal_year", "retrieval_query")


_PAGES = "pg AS (SELECT source AS doc_name, CAST(doc_id AS INT) AS page, text FROM documents)"
_CHUNKS = r"""pc AS (SELECT *, regexp_extract_all(coalesce(text, ''), '\s*\S+') AS pieces FROM pg),
ck AS (SELECT doc_name, page, k AS chunk_index, k * 458 AS token_start, least(len(pieces), k * 458 + 508) AS token_end, pieces FROM (SELECT *, unnest(range(0, CASE WHEN len(pieces) <= 508 THEN 1 ELSE CAST(ceil((len(pieces) - 508) / 458.0) AS BIGINT) + 1 END)) AS k FROM pc WHERE len(pieces) > 0)),
cc AS (SELECT *, array_to_string(pieces[token_start + 1:token_end], '') AS raw, length(array_to_string(pieces[1:token_start], '')) AS before FROM ck),
ch AS (SELECT *, regexp_replace(raw, '^\s+', '') AS body FROM cc)"""


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_name"), F.col("doc_id").cast("int").alias("page"), "text")


@query(f"WITH {_PAGES}, {_CHUNKS} SELECT doc_name, page, CAST(chunk_index AS INT) AS chunk_index, doc_name || '_p' || page || '_c' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') AS chunk_id, sha256(body) AS text_sha256, CAST(token_start AS INT) AS token_start, CAST(token_end AS INT) AS token_end, CAST(before + length(raw) - length(body) AS INT) AS char_start, CAST(before + length(raw) AS INT) AS char_end FROM ch")
def chunk_token_windows(spark, sf_dir):
    c = chunking.chunk_pages(_pages(spark, sf_dir))
    return c.select("doc_name", "page", "chunk_index", "chunk_id", F.sha2("text", 256).alias("text_sha256"), "token_start", "token_end", "char_start", "char_end")


@query(f"WITH {_PAGES} SELECT doc_name, page FROM pg WHERE page % 17 = 0 AND trim(text) <> ''")
def chunk_coverage_check(spark, sf_dir):
    """Every 17th page has lost its chunks."""
    pages = _pages(spark, sf_dir)
    return chunking.uncovered_pages(pages, chunking.chunk_pages(pages).where("page % 17 <> 0"))


@query(f"WITH {_PAGES}, {_CHUNKS} SELECT doc_name, page, CAST(chunk_index AS INT) AS chunk_index, CAST(row_number() OVER (ORDER BY doc_name, page, chunk_index) - 1 AS BIGINT) AS ordinal FROM ch")
def chunk_ordinals(spark, sf_dir):
    return chunking.with_ordinal(chunking.chunk_pages(_pages(spark, sf_dir)).select("doc_name", "page", "chunk_index")).select("doc_name", "page", "chunk_index", "ordinal")


_NORM = "array_to_string(regexp_extract_all(replace(lower(coalesce({x}, '')), ',', ''), '[a-z0-9]+(?:[.,][0-9]+)*%?'), ' ')"
_SHARED = f"""ev AS (SELECT item_id, item_id % 20 AS page, {_NORM.format(x='text')} AS e FROM benchmark),
cn AS (SELECT doc_id, doc_id % 20 AS page, {_NORM.format(x='text')} AS c FROM documents),
"""
_PART = "CASE doc_id % 4 WHEN 0 THEN substr(text, 51, 400) WHEN 1 THEN regexp_replace(substr(text, 1, 600), '[0-9A-Za-z]{7,}', 'x', 'g') WHEN 2 THEN 'Before ' || text || ' behind' ELSE substr(text, 5, 7) END"
_OWN = f"""ev AS (SELECT doc_id AS item_id, coalesce(source, '') || '/' || doc_id // 64 AS page, {_NORM.format(x=_PART)} AS e FROM documents WHERE doc_id % 3 = 0
 UNION ALL SELECT -1 - item_id, 'src' || item_id % 20 || '/' || item_id % 16, {_NORM.format(x='text')} FROM benchmark),
cn AS (SELECT doc_id, coalesce(source, '') || '/' || doc_id // 64 AS page, {_NORM.format(x='text')} AS c FROM documents),
"""
_MAPPED = """et AS (SELECT item_id, page, t, count(*) AS n FROM (SELECT item_id, page, unnest(string_split(e, ' ')) AS t FROM ev) WHERE t <> '' GROUP BY ALL),
ct AS (SELECT doc_id, page, t, count(*) AS n FROM (SELECT doc_id, page, unnest(string_split(c, ' ')) AS t FROM cn) WHERE t <> '' GROUP BY ALL),
mm AS (SELECT item_id, doc_id, sum(least(et.n, ct.n)) AS m FROM et JOIN ct USING (page, t) GROUP BY ALL),
sc AS (SELECT ev.item_id, ev.page, cn.doc_id, e, c <> '' AND e <> '' AND (contains(c, e) OR (len(string_split(c, ' ')) >= 8 AND contains(e, c))) AS exact, CASE WHEN e <> '' AND c <> '' THEN coalesce(m, 0) / len(string_split(e, ' ')) ELSE 0 END AS score FROM ev LEFT JOIN cn USING (page) LEFT JOIN mm ON mm.item_id = ev.item_id AND mm.doc_id = cn.doc_id),
bs AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS best, bool_or(exact) OVER (PARTITION BY item_id) AS any_exact FROM sc),
mp AS (SELECT item_id, any_value(page) AS page, any_value(e) AS e, bool_or(exact) AS any_exact, max(score) AS best_score, count(doc_id) AS candidates, list_sort(coalesce(list(doc_id) FILTER (doc_id IS NOT NULL AND e <> '' AND CASE WHEN any_exact THEN exact ELSE score >= 0.35 AND score >= 0.8 * best END), [])) AS matched FROM bs GROUP BY item_id)"""


def _evidence(spark, sf_dir):
    """Items are parts of documents, changed or not, and passages, each with the page it is to be found on."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("")).alias("doc_name"), F.floor(F.col("doc_id") / 64).alias("page"), "text")
    text = (
        F.when(F.col("chunk_id") % 4 == 0, F.substring("text", 51, 400)).when(F.col("chunk_id") % 4 == 1, F.regexp_replace(F.substring("text", 1, 600), "[0-9A-Za-z]{7,}", "x"))
        .when(F.col("chunk_id") % 4 == 2, F.concat(F.lit("Before "), "text", F.lit(" behind"))).otherwise(F.substring("text", 5, 7))
    )
    parts = docs.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("question_id"), "doc_name", "page", text.alias("text"))
    item = F.col("item_id")
    passages = table(spark, sf_dir, "benchmark").select((-1 - item).alias("question_id"), F.concat(F.lit("src"), item % 20).alias("doc_name"), (item % 16).alias("page"), "text")
    items = parts.unionAll(passages).withColumn("item", F.lit(0))
    return evidence.map_evidence(evidence.match_texts(items).drop("text"), evidence.match_texts(docs).drop("text"))


def _evidence_on_shared_pages(spark, sf_dir):
    """All documents on 20 pages: many items and chunks each."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.lit(0).alias("item"), F.lit("d").alias("doc_name"), F.pmod("item_id", F.lit(20)).alias("page"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("d").alias("doc_name"), F.pmod("doc_id", F.lit(20)).alias("page"), "text")
    return evidence.map_evidence(evidence.match_texts(items).drop("text"), evidence.match_texts(docs).drop("text"))


_METHODS = "SELECT item_id, CASE WHEN e = '' THEN 'no_evidence_text' WHEN any_exact THEN 'normalized_exact_containment' WHEN len(matched) > 0 THEN 'token_containment' ELSE 'page_only_no_strict_chunk_match' END AS method, matched, round(best_score, 9) AS best_score, CAST(candidates AS BIGINT) AS candidates FROM mp"
_SUMMARY = "SELECT item_id, CAST(1 AS INT) AS item_count, matched AS gold_chunk_ids, {doc} AS gold_doc, len(matched) > 0 AS mapping_complete FROM mp"


def _methods(mapped):
    return mapped.select(F.col("question_id").alias("item_id"), "method", "matched", F.round("best_score", 9).alias("best_score"), "candidates")


@query(f"WITH {_OWN}{_MAPPED} {_METHODS}")
def evidence_mapping(spark, sf_dir):
    return _methods(_evidence(spark, sf_dir))


@query(f"WITH {_SHARED}{_MAPPED} {_METHODS}")
def evidence_mapping_shared_pages(spark, sf_dir):
    return _methods(_evidence_on_shared_pages(spark, sf_dir))


@query(f"WITH {_OWN}{_MAPPED} " + _SUMMARY.format(doc="split_part(page, '/', 1)"))
def evidence_summary(spark, sf_dir):
    return evidence.summarise(_evidence(spark, sf_dir)).select(F.col("question_id").alias("item_id"), "item_count", "gold_chunk_ids", "gold_doc", "mapping_complete")


@query(f"WITH {_SHARED}{_MAPPED} " + _SUMMARY.format(doc="'d'"))
def evidence_summary_shared_pages(spark, sf_dir):
    return evidence.summarise(_evidence_on_shared_pages(spark, sf_dir)).select(F.col("question_id").alias("item_id"), "item_count", "gold_chunk_ids", "gold_doc", "mapping_complete")


_GOLD = "gd AS (SELECT item_id, CAST(doc_id % 50 AS BIGINT) AS page_ref FROM benchmark JOIN documents ON doc_id % 97 = item_id % 97), rt AS (SELECT item_id, doc_id, CAST(doc_id % 50 AS BIGINT) AS page_ref, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM z WHERE score > 0 QUALIFY rank <= 20)"
_SCORED = "gp AS (SELECT DISTINCT item_id, page_ref FROM gd), gc AS (SELECT item_id, count(*) AS gold_page_count FROM gp GROUP BY 1), fl AS (SELECT rt.*, gp.page_ref IS NOT NULL AS g FROM rt LEFT JOIN gp ON gp.item_id = rt.item_id AND gp.page_ref = rt.page_ref WHERE rank <= 5), ag AS (SELECT item_id, min(rank) FILTER (g) AS first_gold_rank, count(*) AS rc, count(DISTINCT page_ref) AS ru, count(DISTINCT page_ref) FILTER (g) AS gr FROM fl GROUP BY 1), qs AS (SELECT item_id, CAST(gold_page_count AS BIGINT) AS gold_page_count, CAST(coalesce(rc, 0) AS BIGINT) AS retrieved_chunk_count, CAST(coalesce(ru, 0) AS BIGINT) AS retrieved_unique_page_count, CAST(coalesce(gr, 0) AS BIGINT) AS gold_pages_retrieved, CAST(first_gold_rank AS INT) AS first_gold_rank, CAST(coalesce(first_gold_rank <= 1, false) AS INT) AS hit_at_1, CAST(coalesce(first_gold_rank <= 3, false) AS INT) AS hit_at_3, CAST(coalesce(first_gold_rank <= 5, false) AS INT) AS hit_at_5, round(coalesce(gr, 0) / gold_page_count, 9) AS recall_at_5, round(coalesce(1.0::DOUBLE / first_gold_rank, 0), 9) AS mrr_at_5 FROM gc LEFT JOIN ag USING (item_id))"


def _retrieved(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    index = sparse.build_index(docs)
    found = sparse.search(index, sparse.query_terms(items), 20).where("score > 0")
    gold = items.withColumn("m", F.pmod("item_id", F.lit(97))).join(docs.withColumn("m", F.pmod("doc_id", F.lit(97))), "m").select(F.col("item_id").alias("question_id"), F.pmod("doc_id", F.lit(50)).alias("page_ref"))
    return found.select(F.col("query_id").alias("question_id"), "rank", "id", F.pmod("id", F.lit(50)).alias("page_ref")), gold


@query(f"WITH {BM25}, {_GOLD}, {_SCORED} SELECT * FROM qs")
def retrieval_metrics(spark, sf_dir):
    found, gold = _retrieved(spark, sf_dir)
    return retrieval_eval.score_questions(found, gold).withColumnRenamed("question_id", "item_id").withColumn("recall_at_5", F.round("recall_at_5", 9)).withColumn("mrr_at_5", F.round("mrr_at_5", 9))


@query(f"WITH {BM25}, {_GOLD}, {_SCORED} SELECT CAST(item_id % 3 AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS question_count, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_3), 6) AS hit_at_3, round(avg(hit_at_5), 6) AS hit_at_5, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(mrr_at_5), 6) AS mrr_at_5, CAST(count(*) FILTER (retrieved_chunk_count = 0) AS BIGINT) AS no_result_count FROM qs GROUP BY 1")
def retrieval_summary(spark, sf_dir):
    found, gold = _retrieved(spark, sf_dir)
    out = retrieval_eval.summarise(retrieval_eval.score_questions(found, gold).withColumn("part", F.pmod("question_id", F.lit(3))), "part")
    return out.select("part", "question_count", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_3", "hit_at_5", "recall_at_5", "mrr_at_5")], "no_result_count")


@query(f"""WITH {BM25}, {_GOLD}, gp AS (SELECT DISTINCT item_id, page_ref FROM gd), fl AS (SELECT gp.item_id, max(CASE WHEN rank <= 20 AND rt.page_ref = gp.page_ref THEN 1 ELSE 0 END) AS union_hit, max(CASE WHEN rank <= 10 AND rt.page_ref = gp.page_ref THEN 1 ELSE 0 END) AS pre_hit, max(CASE WHEN rank <= 5 AND rt.page_ref = gp.page_ref THEN 1 ELSE 0 END) AS final_hit FROM gp LEFT JOIN rt USING (item_id) GROUP BY 1),
n AS (SELECT item_id, count(*) AS union_n, count(*) FILTER (rank <= 10) AS pre_n, count(*) FILTER (rank <= 5) AS final_n FROM (SELECT item_id, rank FROM rt) GROUP BY 1)
SELECT item_id, CAST(union_hit AS BIGINT) AS union_hit, CAST(pre_hit AS BIGINT) AS pre_hit, CAST(final_hit AS BIGINT) AS final_hit, CAST(coalesce(union_n, 0) AS BIGINT) AS union_n, CAST(coalesce(pre_n, 0) AS BIGINT) AS pre_n, CAST(coalesce(final_n, 0) AS BIGINT) AS final_n,
 CASE WHEN coalesce(final_n, 0) = 0 THEN 'empty_retrieval' WHEN union_hit = 0 THEN 'gold_page_absent_candidate_union' WHEN pre_hit = 0 THEN 'gold_page_lost_before_pre_final' WHEN final_hit = 0 THEN 'gold_page_lost_at_final_selection' ELSE 'final_gold_page_hit' END AS diagnostic_category FROM fl LEFT JOIN n USING (item_id)""")
def stage_diagnostics(spark, sf_dir):
    found, gold = _retrieved(spark, sf_dir)
    stage = lambda name, k: found.where(F.col("rank") <= k).select("question_id", "page_ref", F.lit(name).alias("stage"))
    out = retrieval_eval.stage_diagnostics(stage("union", 20).unionAll(stage("pre", 10)).unionAll(stage("final", 5)), gold)
    return out.withColumnRenamed("question_id", "item_id")


_TOP3 = "t3 AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM z WHERE score > 0) WHERE rank <= 3)"


@query(f"WITH {BM25}, {_TOP3} SELECT b.item_id, 'Use only the supplied context to answer the financial question.' || chr(10) || 'If the answer cannot be determined from the supplied context, say:' || chr(10) || '\"Insufficient evidence in the retrieved context.\"' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[Context ' || rank || ']' || chr(10) || 'Document: ' || d.source || chr(10) || 'Page (zero-indexed): 0' || chr(10) || 'Chunk ID: ' || d.doc_id || chr(10) || trim(d.text), chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question:' || chr(10) || trim(b.text) || chr(10) || chr(10) || 'Answer:' AS prompt FROM t3 JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) GROUP BY b.item_id, b.text")
def prompts_rendered(spark, sf_dir):
    from ..operators.prompts import rag_prompt

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = _bm25(spark, sf_dir, 3).withColumnRenamed("id", "doc_id")
    chunks = found.join(docs, "doc_id").select("query_id", F.struct("rank", F.col("source").alias("doc_name"), F.lit(0).alias("page"), F.col("doc_id").cast("string").alias("chunk_id"), "text").alias("c"))
    g = chunks.groupBy("query_id").agg(F.sort_array(F.collect_list("c")).alias("chunks"))
    return items.join(g, F.col("item_id") == F.col("query_id")).select("item_id", rag_prompt(F.col("text"), F.col("chunks")).alias("prompt"))

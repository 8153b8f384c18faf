"""Queries over projections, complete joins, rules between stages, the table of tests and report frames."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, dense, report, rollups, selection, sparse, stats, support, validation
from ..sources import indices, io
from ..sources.store import shared_dir
from .common import query, table
from .evaluation import _GRID, _LONG, _grid
from .retrieval import _DENSE, _TOP, BM25, _vectors



def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("n_chars", "text", F.lit("bm25").alias("retrieval_method"), (F.col("doc_id") % 7).alias("rank"), F.col("source").alias("doc_name"), F.col("doc_id").alias("chunk_id"))


@query("SELECT doc_id AS chunk_id, source AS doc_name, text, doc_id % 7 AS rank, 'bm25' AS retrieval_method FROM documents")
def slim_chunks(spark, sf_dir):
    return selection.slim(_chunks(spark, sf_dir))


@query("SELECT doc_id AS chunk_id, source AS doc_name, doc_id % 7 AS rank FROM documents")
def compact_chunks(spark, sf_dir):
    return selection.compact(_chunks(spark, sf_dir))


@query("SELECT item_id FROM benchmark WHERE item_id < 12")
def first_questions(spark, sf_dir):
    return selection.first_by_position(table(spark, sf_dir, "benchmark"), "item_id", 12).select("item_id")


@query("SELECT p_partkey, p_type FROM (SELECT p_partkey, p_type, CASE p_partkey % 3 WHEN 0 THEN 'H0,H1' WHEN 1 THEN 'H0' ELSE 'H10' END AS h FROM part) WHERE p_partkey % 3 = 0")
def tagged_rows(spark, sf_dir):
    h = F.when(F.col("p_partkey") % 3 == 0, "H0,H1").when(F.col("p_partkey") % 3 == 1, "H0").otherwise("H10")
    return selection.tagged(table(spark, sf_dir, "part").withColumn("h", h), "h", "H1").select("p_partkey", "p_type")


@query("""SELECT n_nationkey, '[{"doc_name":"' || n_name || '","page":' || n_regionkey || '}]' AS refs FROM nation""")
def page_reference_json(spark, sf_dir):
    r = F.array(F.struct(F.col("n_name").alias("doc_name"), F.col("n_regionkey").cast("int").alias("page")))
    return table(spark, sf_dir, "nation").select("n_nationkey", selection.page_refs(r).alias("refs"))


@query("""SELECT conv_id, turn, sha256('{"role":"' || role || '","size":' || CASE WHEN turn = 0 THEN 'null' ELSE CAST(length(text) AS VARCHAR) END || ',"turn":' || turn || '}') AS fingerprint FROM conversations""")
def canonical_fingerprints(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("size", F.when(F.col("turn") != 0, F.length("text")))
    return c.select("conv_id", "turn", selection.fingerprint(["turn", "size", "role"]).alias("fingerprint"))


@query("SELECT doc_id, toxic = 1 AS toxic, quality = 1 AS quality FROM labels")
def strict_flags(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", selection.flag(F.col("toxic")).alias("toxic"), selection.flag(F.col("quality")).alias("quality"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 20) / 10.0::DOUBLE END AS temperature, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE printf('%.1f ms', o_orderkey / 2.0::DOUBLE) END AS took FROM orders")
def settings_read(spark, sf_dir):
    o = F.col("o_orderkey")
    said = F.when(o % 3 == 0, "None").otherwise(F.format_string(" %.1f ", (o % 20) / 10.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", selection.temperature(said).alias("temperature"), selection.milliseconds(F.when(o % 5 != 0, o / 2.0)).alias("took"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(coalesce(text, '') || ' fine 12% 1⁄2 k'), ',', ''), '[a-z0-9]+(?:[.,][0-9]+)*%?'), ' ') AS norm FROM documents")
def compatibility_forms(spark, sf_dir):
    """A ligature, full-width digits, a vulgar fraction and a Kelvin sign stand as their plain forms."""
    from ..operators.evidence import match_texts

    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" ﬁne １２％ ½ K")).alias("text"))
    return match_texts(d).select("doc_id", "norm")


@query("SELECT conv_id, turn, '[' || conv_id || ', turn ' || turn || ']' || chr(10) || text AS passage FROM conversations WHERE role = 'assistant'")
def numbered_passages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("chunks", F.array(F.struct("conv_id", "turn", "text")))
    p = T.numbered_passages(F.col("chunks"), lambda x: F.concat(x["conv_id"].cast("string"), F.lit(", turn "), x["turn"].cast("string")), lambda x: x["text"])
    return c.select("conv_id", "turn", F.explode(p).alias("p")).where("p.evidence_id = 'E1'").select("conv_id", "turn", "p.text").withColumnRenamed("text", "passage")


# Evidence meets pages: the pages of a source are its documents in order of doc_id; some evidence names pages that are not there.
_PAGED = "pg AS (SELECT source AS doc_name, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS page, text FROM documents), ev AS (SELECT item_id, 'src' || (item_id % 22) AS doc_name, CAST(item_id % 60 AS INT) AS page FROM benchmark)"


def _paged(spark, sf_dir):
    from pyspark.sql import Window

    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_name"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("page"), "text")
    i = F.col("item_id")
    items = table(spark, sf_dir, "benchmark").select(i.alias("question_id"), F.lit(0).alias("item"), F.concat(F.lit("src"), i % 22).alias("doc_name"), (i % 60).cast("int").alias("page"))
    return items, pages


@query(f"WITH {_PAGED} SELECT item_id, doc_name, page, pg.text IS NOT NULL AS found, CAST(length(pg.text) AS INT) AS chars FROM ev LEFT JOIN pg USING (doc_name, page)")
def evidence_page_join(spark, sf_dir):
    items, pages = _paged(spark, sf_dir)
    return validation.evidence_pages(items, pages).select(F.col("question_id").alias("item_id"), "doc_name", "page", "found", F.length("page_text").alias("chars"))


@query(f"WITH {_PAGED} SELECT 'missing_page' AS rule, item_id || '|0' AS key, doc_name || ':' || page AS detail FROM ev WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.doc_name = ev.doc_name AND pg.page = ev.page)")
def missing_evidence_pages(spark, sf_dir):
    return validation.missing_pages(*_paged(spark, sf_dir))


_MANIFEST = "mf AS (SELECT s_name AS doc_name, CASE WHEN s_suppkey % 7 = 0 THEN 'failed' WHEN s_suppkey % 2 = 0 THEN 'downloaded' ELSE 'skipped_existing' END AS download_status, s_suppkey FROM supplier), rq AS (SELECT s_name AS doc_name FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'Nowhere')"


def _manifest(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    manifest = s.select(F.col("s_name").alias("doc_name"), F.when(k % 7 == 0, "failed").when(k % 2 == 0, "downloaded").otherwise("skipped_existing").alias("download_status"), "s_suppkey")
    return s.where(k % 3 == 0).select(F.col("s_name").alias("doc_name")), manifest


@query(f"WITH {_MANIFEST} SELECT 'not_on_disk' AS rule, doc_name AS key, download_status AS detail FROM mf WHERE download_status = 'failed' AND doc_name IN (SELECT doc_name FROM rq) UNION ALL SELECT 'not_in_manifest', 'Nowhere', 'missing'")
def manifest_violations(spark, sf_dir):
    required, manifest = _manifest(spark, sf_dir)
    return validation.manifest_violations(required.unionAll(spark.createDataFrame([("Nowhere",)], "doc_name string")), manifest)


@query(f"WITH {_MANIFEST} SELECT doc_name, download_status, s_suppkey FROM mf WHERE s_suppkey % 3 = 0 AND s_suppkey % 7 <> 0")
def manifest_documents(spark, sf_dir):
    required, manifest = _manifest(spark, sf_dir)
    return validation.corpus_manifest(required.join(manifest.where("s_suppkey % 7 <> 0"), "doc_name", "left_semi"), manifest)


_EXTRACTED = "pp AS (SELECT source AS doc_name, CASE WHEN length(text) < 200 THEN 'empty' ELSE 'ok' END AS extraction_status FROM documents), mf AS (SELECT doc_name, count(*) + CASE WHEN doc_name = 'src3' THEN 1 ELSE 0 END AS pdf_pages FROM pp GROUP BY 1)"


def _extracted(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_name"), F.col("doc_id").alias("page"), F.when(F.length("text") < 200, "empty").otherwise("ok").alias("extraction_status"), "text")
    manifest = pages.groupBy("doc_name").agg(F.count("*").alias("pdf_pages")).withColumn("pdf_pages", F.col("pdf_pages") + (F.col("doc_name") == "src3").cast("int"))
    return manifest, pages


@query(f"WITH {_EXTRACTED} SELECT 'page_count' AS rule, doc_name AS key, pdf_pages || '/' || (pdf_pages - 1) AS detail FROM mf WHERE doc_name = 'src3' UNION ALL SELECT 'no_pages', 'gone', '0'")
def extraction_violations(spark, sf_dir):
    manifest, pages = _extracted(spark, sf_dir)
    return validation.extraction_violations(manifest.unionAll(spark.createDataFrame([("gone", None)], "doc_name string, pdf_pages long")), pages)


@query(f"WITH {_EXTRACTED} SELECT CAST(count(DISTINCT doc_name) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (extraction_status = 'empty') AS BIGINT) AS empty_text_pages, CAST(count(*) FILTER (extraction_status <> 'empty') AS BIGINT) AS nonempty_text_pages FROM pp")
def extraction_summary(spark, sf_dir):
    return validation.extraction_summary(*_extracted(spark, sf_dir))


@query(f"WITH {_EXTRACTED} SELECT d.source AS doc_name, doc_id AS page, CASE WHEN length(text) < 200 THEN 'empty' ELSE 'ok' END AS extraction_status, 'downloaded' AS download_status, CAST(pdf_pages AS BIGINT) AS pdf_pages FROM documents d JOIN mf ON mf.doc_name = d.source WHERE source IN ('src1', 'src2')")
def extracted_corpus(spark, sf_dir):
    manifest, pages = _extracted(spark, sf_dir)
    required = spark.createDataFrame([("src1",), ("src2",)], "doc_name string")
    return validation.extract_corpus(required, manifest.withColumn("download_status", F.lit("downloaded")), pages).select("doc_name", "page", "extraction_status", "download_status", "pdf_pages")


_JUDGED = f"{_GRID}, j AS (SELECT *, CASE question_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'correct' ELSE 'incorrect' END AS label FROM g)"


def _judged(spark, sf_dir):
    g = _grid(spark, sf_dir)
    k = F.col("question_id") % 4
    j = g.select("architecture", "question_id", F.when(k == 0, None).when(k == 1, "correct").otherwise("incorrect").alias("label"), F.when(k != 0, F.col("quality")).alias("completeness"), F.when(k != 0, "why").alias("rationale"), F.when(k == 0, "timeout").alias("judge_error"))
    return g.select("architecture", "question_id", "latency_ms"), j, g.select("architecture", "question_id", F.col("quality").alias("f1"))


@query(f"WITH {_JUDGED} SELECT architecture, question_id, round(latency_ms, 6) AS latency_ms, coalesce(label, 'judge_error') AS label, CASE WHEN label IS NOT NULL THEN round(quality, 6) END AS completeness, CASE WHEN label IS NULL THEN 'timeout' ELSE 'why' END AS rationale, round(quality, 6) AS f1 FROM j")
def quality_assembly(spark, sf_dir):
    d = validation.assemble_quality(*_judged(spark, sf_dir))
    return d.select("architecture", "question_id", F.round("latency_ms", 6).alias("latency_ms"), "label", F.round("completeness", 6).alias("completeness"), "rationale", F.round("f1", 6).alias("f1"))


_SOURCES = [f"src{i}" for i in range(20)]
_CATS = "ct AS (SELECT 'lang' AS grouping, CASE WHEN lang = 'es' AND source = 'src1' THEN 'es, other' ELSE lang END AS category, source AS architecture, CASE WHEN lang = 'fr' THEN count(*) ELSE 5 END AS question_count FROM documents GROUP BY lang, source)"
_ALL_SOURCES = ",".join(sorted(_SOURCES))


@query(f"WITH {_CATS}, a AS (SELECT grouping, category, string_agg(DISTINCT architecture, ',' ORDER BY architecture) AS a, count(DISTINCT question_count) AS m FROM ct GROUP BY 1, 2), n AS (SELECT sum(question_count) AS n FROM ct WHERE architecture = 'src0') SELECT 'incomplete_category' AS rule, grouping || '|' || category AS key, a AS detail FROM a WHERE a <> '{_ALL_SOURCES}' UNION ALL SELECT 'unequal_counts', grouping || '|' || category, CAST(m AS VARCHAR) FROM a WHERE m <> 1 UNION ALL SELECT 'category_coverage', 'lang', '3/' || CAST(n AS BIGINT) FROM n WHERE n <> 3")
def category_violations(spark, sf_dir):
    """All sources and languages; one language of one source is filed under a category of its own."""
    category = F.when((F.col("lang") == "es") & (F.col("source") == "src1"), "es, other").otherwise(F.col("lang"))
    c = table(spark, sf_dir, "documents").groupBy(F.lit("lang").alias("grouping"), category.alias("category"), F.col("source").alias("architecture"), "lang").agg(F.count("*").alias("question_count"))
    c = c.withColumn("question_count", F.when(F.col("lang") == "fr", F.col("question_count")).otherwise(5)).drop("lang")
    return validation.category_violations(c, _SOURCES, spark.createDataFrame([("lang", 3)], "grouping string, question_count long"))


@query(f"WITH {_GRID} SELECT 'abstention_counts' AS rule, architecture AS key, CASE architecture WHEN 'view' THEN 'exact_abstention_count' ELSE 'question_count,gold_scored_count' END AS detail FROM (SELECT DISTINCT architecture FROM g) WHERE architecture IN ('view', 'click')")
def abstention_violations(spark, sf_dir):
    """A summary that is wrong by one for views, and in two counts for clicks."""
    g = _grid(spark, sf_dir)
    a = F.col("architecture")
    summary = g.groupBy("architecture").agg(F.count("*").alias("question_count"), F.sum("abstained").alias("exact_abstention_count"), F.count("support").alias("context_scored_count"), F.count("quality").alias("gold_scored_count"))
    off = lambda c, name: (F.col(c) + (a == name).cast("int")).alias(c)
    summary = summary.select("architecture", off("question_count", "click"), off("exact_abstention_count", "view"), "context_scored_count", off("gold_scored_count", "click"))
    return validation.abstention_violations(summary, g.select("architecture", "abstained", F.col("support").alias("context_score"), F.col("quality").alias("gold_score")))


@query("SELECT 'another_run' AS rule, CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 10 = 0 THEN 'old' ELSE 'null' END AS detail FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey % 11 = 0")
def run_violations(spark, sf_dir):
    k = F.col("s_suppkey")
    d = table(spark, sf_dir, "supplier").withColumn("run_id", F.when(k % 10 == 0, "old").when(k % 11 != 0, "run-1"))
    return validation.another_run(d, "run-1", k)


@query("""WITH j AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN 'v3' ELSE 'v4' END AS protocol, CASE WHEN turn % 5 = 4 THEN sha256(text || '!') ELSE sha256(text) END AS digest, text FROM conversations)
SELECT 'journal_protocol' AS rule, conv_id || '|' || turn AS key, 'protocol' AS detail FROM j WHERE protocol <> 'v4' UNION ALL SELECT 'journal_source', conv_id || '|' || turn, 'digest' FROM j WHERE digest <> sha256(text)""")
def journal_violations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    j = c.select("conv_id", "turn", F.when(F.col("conv_id") % 9 == 0, "v3").otherwise("v4").alias("protocol"), F.when(F.col("turn") % 5 == 4, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("digest"))
    return validation.journal_violations(j, ["conv_id", "turn"], {"protocol": "v4"}, c.select("conv_id", "turn", F.sha2("text", 256).alias("digest")), ["digest"])


_STAGES = """d AS (SELECT source, doc_id, CASE WHEN doc_id % 35 = 5 THEN -1 ELSE doc_id END AS outer_rank, lang FROM documents),
i AS (SELECT source, doc_id, doc_id AS rank, CASE WHEN doc_id % 15 = 0 THEN lang || '?' ELSE lang END AS lang, CASE WHEN doc_id % 10 <> 0 THEN outer_rank END AS outer_rank, lang AS outer_lang FROM d WHERE doc_id % 5 = 0)"""


def _stages(spark, sf_dir):
    """Final chunks of which some are not among the candidates, some carry another language there and some stand in another order."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").alias("rank"), "lang")
    final = d.where("doc_id % 5 = 0").withColumn("stage", F.lit("final")).withColumn("lang", F.when(F.col("doc_id") % 15 == 0, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")))
    union = d.where("doc_id % 10 <> 0").withColumn("rank", F.when(F.col("doc_id") % 35 == 5, -1).otherwise(F.col("rank")))
    return final.unionByName(union.withColumn("stage", F.lit("union")))


@query(f"""WITH {_STAGES}, o AS (SELECT *, coalesce(outer_rank < max(outer_rank) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS back FROM i)
SELECT 'stage_identity' AS rule, source || '|' || doc_id AS key, CASE WHEN outer_rank IS NULL THEN 'absent' ELSE concat_ws(',', CASE WHEN lang <> outer_lang THEN 'lang' END, CASE WHEN back THEN 'order' END) END AS detail FROM o WHERE outer_rank IS NULL OR lang <> outer_lang OR back""")
def stage_violations(spark, sf_dir):
    return validation.stage_identity(_stages(spark, sf_dir), ["source"], "doc_id", "final", "union", ["lang"])


@query("""WITH s AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, doc_id, lang FROM documents), f AS (SELECT source, rank, CASE WHEN rank = 3 AND source = 'src2' THEN doc_id + 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END AS lang FROM s WHERE rank <= 5 AND NOT (rank = 5 AND source = 'src3')),
j AS (SELECT source, rank, s.doc_id AS d, f.doc_id AS e, s.lang AS l, f.lang AS m FROM (SELECT * FROM s WHERE rank <= 5) s FULL JOIN f USING (source, rank))
SELECT 'saved_selection' AS rule, source || '|' || rank AS key, CASE WHEN e IS NULL THEN 'not_in_final' WHEN d IS NULL THEN 'not_selected' ELSE concat_ws(',', CASE WHEN d <> e THEN 'doc_id' END, CASE WHEN l <> m THEN 'lang' END) END AS detail FROM j WHERE e IS NULL OR d IS NULL OR d <> e OR l <> m""")
def selection_violations(spark, sf_dir):
    """Final contexts that are not the first five of what was saved as the selection."""
    s = rollups.first_per_group(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"], 5)
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    final = s.where("not (rank = 5 and source = 'src3')").withColumns({"doc_id": F.expr("if(rank = 3 and source = 'src2', doc_id + 1, doc_id)"), "lang": F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang"))})
    both = s.withColumn("stage", F.lit("selection")).unionByName(final.withColumn("stage", F.lit("final")))
    return validation.saved_selection(both, ["source"], ["doc_id", "lang"], "selection", "final", 5)


_UNITS = f"u AS (SELECT architecture, question_id, abstained, CASE WHEN architecture = 'click' AND question_id % 5 <> 0 THEN NULL WHEN abstained = 1 AND question_id % 3 <> 0 THEN NULL ELSE question_id % 6 END AS n, CASE WHEN architecture = 'click' AND question_id % 5 <> 0 THEN NULL WHEN abstained = 1 AND question_id % 3 <> 0 THEN NULL WHEN question_id % 17 = 0 THEN 7 ELSE question_id % 6 // 2 END AS s FROM g), v AS (SELECT *, CASE WHEN n > 0 THEN s / n WHEN question_id % 4 = 0 AND n = 0 THEN 0.0::DOUBLE END AS support FROM u), w AS (SELECT *, CASE WHEN question_id % 11 = 0 THEN support ELSE 1 - support END AS proxy FROM v)"


@query(f"""WITH {_GRID}, {_UNITS}, y AS (SELECT *, CASE WHEN architecture = 'click' THEN CASE WHEN n IS NOT NULL OR s IS NOT NULL OR support IS NOT NULL OR proxy IS NOT NULL THEN 'not_applicable' END
 WHEN n IS NULL AND s IS NULL AND support IS NULL AND proxy IS NULL AND abstained = 1 THEN NULL WHEN n IS NULL OR s IS NULL OR s > n OR (abstained = 1 AND n > 0) THEN 'unit_counts'
 WHEN n = 0 THEN CASE WHEN support IS NOT NULL OR proxy IS NOT NULL THEN 'scores_without_units' END WHEN abs(proxy - (1 - support)) > 1e-12 THEN 'support_disagrees' END AS why FROM w)
SELECT 'context_support' AS rule, architecture || '|' || question_id AS key, why AS detail FROM y WHERE why IS NOT NULL""")
def support_rule_violations(spark, sf_dir):
    """Counts of units and scores, some where they do not apply, some that cannot be, some that disagree."""
    q, skip = F.col("question_id"), (F.col("architecture") == "click") & (F.col("question_id") % 5 != 0) | (F.col("abstained") == 1) & (F.col("question_id") % 3 != 0)
    g = _grid(spark, sf_dir).select("architecture", "question_id", "abstained", F.when(~skip, q % 6).alias("context_claim_count"), F.when(~skip, F.when(q % 17 == 0, 7).otherwise(F.floor(q % 6 / 2))).alias("context_supported_count"))
    n = F.col("context_claim_count")
    g = g.withColumn("support", F.when(n > 0, F.col("context_supported_count") / n).when((q % 4 == 0) & (n == 0), 0.0)).withColumn("proxy", F.when(q % 11 == 0, F.col("support")).otherwise(1 - F.col("support")))
    return validation.support_rules(g, "context", "support", "proxy", F.concat_ws("|", "architecture", q.cast("string")), ["click"])


_REPORT = f"""g2 AS (SELECT *, CASE architecture WHEN 'click' THEN 'P0' WHEN 'purchase' THEN 'P1' WHEN 'view' THEN 'P2' ELSE 'P3' END AS a FROM g WHERE architecture IN ('click', 'purchase', 'view', 'signup')),
an AS (SELECT a, avg(quality) AS q FROM g2 GROUP BY 1), tr AS (SELECT a, avg(quality) + CASE WHEN a = 'P2' THEN 1e-6 ELSE 0 END AS q, avg(latency_ms) AS ms FROM g2 GROUP BY 1)"""


@query(f"""WITH {_GRID}, {_REPORT}
SELECT 'cross_stage' AS rule, 'P2' AS key, 'answers.quality_mean/tradeoffs.quality_mean' AS detail FROM an JOIN tr USING (a) WHERE a = 'P2'
UNION ALL SELECT 'architecture_rows', 'retrieval|P0', 'unexpected' FROM tr WHERE a = 'P0'
UNION ALL SELECT 'another_run', 'retrieval|P3', 'old' FROM tr WHERE a = 'P3'
UNION ALL SELECT 'no_total_latency', 'P3', 'total' FROM tr WHERE a = 'P3'
UNION ALL SELECT 'row_count', 'statistics', '21/' || count(*) FROM tr HAVING count(*) <> 21
UNION ALL SELECT 'incomplete_category', 'user|' || c, string_agg(DISTINCT a, ',' ORDER BY a) FROM (SELECT question_id % 7 AS c, a FROM g2) GROUP BY c HAVING count(DISTINCT a) <> 4
UNION ALL SELECT 'unequal_counts', 'user|' || c, CAST(count(DISTINCT n) AS VARCHAR) FROM (SELECT question_id % 7 AS c, a, count(*) AS n FROM g2 GROUP BY 1, 2) GROUP BY c HAVING count(DISTINCT n) <> 1
UNION ALL SELECT 'category_coverage', 'user', '1/' || count(*) FROM g2 WHERE a = 'P0' HAVING count(*) <> 1""")
def report_input_violations(spark, sf_dir):
    """Tables of one evaluation put together with faults of every kind: all rules between stages at once."""
    g = _grid(spark, sf_dir).where("architecture in ('click', 'purchase', 'view', 'signup')")
    name = F.when(F.col("architecture") == "click", "P0").when(F.col("architecture") == "purchase", "P1").when(F.col("architecture") == "view", "P2").otherwise("P3")
    g = g.withColumn("architecture", name).withColumn("run_id", F.lit("run-1"))
    means = g.groupBy("run_id", "architecture").agg(F.avg("quality").alias("quality_mean"), F.avg("latency_ms").alias("latency_mean"))
    tradeoffs = means.withColumn("quality_mean", F.col("quality_mean") + F.when(F.col("architecture") == "P2", 1e-6).otherwise(0.0))
    retrieval = means.withColumn("run_id", F.when(F.col("architecture") == "P3", "old").otherwise(F.col("run_id")))
    latency = means.select("run_id", "architecture", F.when(F.col("architecture") != "P3", "total").otherwise("generation").alias("component"), F.col("latency_mean").alias("mean_ms"))
    categories = g.groupBy("run_id", F.lit("user").alias("grouping"), (F.col("question_id") % 7).cast("string").alias("category"), "architecture").agg(F.count("*").alias("question_count"))
    names = ["P0", "P1", "P2", "P3"]
    return validation.stage_inputs(
        "run-1", {"answers": (means, names), "tradeoffs": (tradeoffs, names), "retrieval": (retrieval, names[1:])}, latency, categories, names, spark.createDataFrame([("user", 1)], "grouping string, question_count long"),
        {"statistics": (means, 21)}, [("answers", "quality_mean", "tradeoffs", "quality_mean"), ("latency", "mean_ms", "tradeoffs", "latency_mean")],
    )


@query("SELECT 'question_record' AS rule, CASE WHEN item_id % 6 = 0 THEN 'null' ELSE CAST(item_id AS VARCHAR) END AS key, CASE WHEN item_id % 6 = 0 AND item_id % 4 = 0 THEN 'question_id,question' WHEN item_id % 6 = 0 THEN 'question_id' ELSE 'question' END AS detail FROM benchmark WHERE item_id % 6 = 0 OR item_id % 4 = 0")
def question_record_violations(spark, sf_dir):
    i = F.col("item_id")
    return validation.question_records(table(spark, sf_dir, "benchmark").select(F.when(i % 6 != 0, i).alias("question_id"), F.when(i % 4 == 0, " \n").otherwise(F.col("text")).alias("question")))


@query("SELECT 'order' AS rule, CAST(n_nationkey AS VARCHAR) AS key, n_name || ' / ' || coalesce(lead(n_name) OVER (ORDER BY n_nationkey), 'none') AS detail FROM nation")
def order_violations(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), "n_name")
    return checks.order_equality(n, n.select((F.col("position") - 1).alias("position"), "n_name").where("position >= 0"), "position", "n_name")


@query("SELECT 'declared_count' AS rule, source AS key, n || '/' || (n + 1) AS detail FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) WHERE source IN ('src4', 'src5')")
def declared_count_violations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source")
    declared = d.groupBy("source").agg(F.count("*").alias("n")).withColumn("n", F.col("n") + F.col("source").isin("src4", "src5").cast("int"))
    return checks.counts_equal(d, "source", declared, "n")


@query("WITH r AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS m, min(turn) + 1 AS lo, max(turn) + 1 AS hi FROM conversations GROUP BY 1) SELECT 'ranks' AS rule, CAST(conv_id AS VARCHAR) AS key, n || '/' || m || '/' || lo || '/' || hi AS detail FROM r WHERE n > 5 OR n <> m OR lo <> 1 OR hi <> n")
def rank_violations(spark, sf_dir):
    return checks.ranks_valid(table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("rank")), "conv_id")


@query(f"WITH {_GRID} SELECT 'support_without_answer' AS rule, architecture || '|' || question_id AS key, 'predicate' AS detail FROM g WHERE abstained = 0 AND support < 0.3")
def support_violations(spark, sf_dir):
    ok = (F.col("abstained") == 1) & F.col("support").isNull() | (F.col("abstained") == 0) & (F.col("support") >= 0.3)
    return checks.predicate(_grid(spark, sf_dir), ok, F.concat_ws("|", F.col("architecture"), F.col("question_id").cast("string")), "support_without_answer")


@query("SELECT conv_id % 4 AS part, CAST(count(*) AS BIGINT) AS keys, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) AS mean FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) GROUP BY 1")
def dataset_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("part", F.col("conv_id") % 4)
    return rollups.spread(c, "conv_id", "part").withColumn("mean", F.round("mean", 6))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (n_chars <> length(text)) AS BIGINT) AS n_chars, CAST(count(*) FILTER (lang <> 'en') AS BIGINT) AS english FROM documents")
def consistency_counts(spark, sf_dir):
    return rollups.mismatches(table(spark, sf_dir, "documents"), {"n_chars": F.col("n_chars") == F.length("text"), "english": F.col("lang") == "en"})


@query("SELECT conv_id, turn, CAST(1 AS INT) AS claim_count, CAST(conv_id % 2 AS INT) AS supported_count, CAST(conv_id % 2 AS DOUBLE) AS score, CAST(1 - conv_id % 2 AS DOUBLE) AS hallucination, CAST(1 - conv_id % 2 AS INT) AS guard_override_count FROM conversations WHERE role = 'assistant' AND conv_id % 3 <> 0 UNION ALL SELECT conv_id, turn, 0, 0, NULL, NULL, 0 FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0")
def claim_scores(spark, sf_dir):
    ok = F.col("conv_id") % 2 == 1
    c = F.array(F.struct(ok.alias("supported"), F.when(ok, "").otherwise("missing_unit_assessment").alias("guard_reason")))
    d = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, F.slice(c, 1, 0)).otherwise(c).alias("claims"))
    return support.claim_scores(d).drop("claims")


@query("SELECT conv_id, turn, 'failure_to_answer' AS correctness_label, 0.0::DOUBLE AS completeness, CAST(0 AS INT) AS semantic_correctness FROM conversations WHERE turn % 4 = 1")
def exact_abstentions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 1, "Insufficient evidence.").otherwise(F.concat(F.lit("It says "), "text")).alias("generated_answer"))
    return support.split_exact_abstentions(c)[1].select("conv_id", "turn", "correctness_label", "completeness", "semantic_correctness")


@query("""WITH x AS (SELECT conv_id, turn, conv_id % 4 AS k FROM conversations) SELECT conv_id, turn, CASE WHEN k = 3 THEN 'label_conflict' END AS error, CASE k WHEN 0 THEN 'correct' WHEN 1 THEN 'partially_correct' WHEN 2 THEN 'failure_to_answer' END AS correctness_label,
 CASE k WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.0::DOUBLE END AS completeness FROM x""")
def answer_judgments(spark, sf_dir):
    """Answered and missing units in four ways, the last with a label that does not follow from them."""
    k = F.col("conv_id") % 4
    status = lambda unit, s: F.struct(F.lit(unit).alias("unit_id"), s.alias("status"))
    first, second = F.when(k == 2, "missing").otherwise("answered"), F.when(k.isin(1, 2), "missing").otherwise("answered")
    label = F.when(k == 0, "correct").when(k == 1, "partially_correct").when(k == 2, "failure_to_answer").otherwise("incorrect")
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.lit("U1"), F.lit("U2")).alias("units"), F.array(status("U1", first), status("U2", second)).alias("statuses"), (k != 2).alias("attempted"), F.lit(False).alias("contradiction"), label.alias("label"))
    return support.judge_answers(d).select("conv_id", "turn", "error", "correctness_label", "completeness")


_STUDY = {"exact_match": "CAST(quality > 0.2 AS INT)", "token_f1": "quality", "numeric_accuracy": "CASE WHEN question_id % 3 <> 0 THEN quality END", "gold_evidence_support": "support", "context_faithfulness": "CASE WHEN architecture <> 'P0' THEN support END",
          "hit_at_5": "CASE WHEN architecture <> 'P0' THEN CAST(question_id % 2 AS INT) END", "recall_at_5": "CASE WHEN architecture <> 'P0' THEN quality / 2 END", "total_latency_ms": "latency_ms"}
_AS_STUDY = "CASE architecture WHEN 'click' THEN 'P0' WHEN 'purchase' THEN 'P1' WHEN 'view' THEN 'P2' ELSE 'P3' END"
_STUDY_ROWS = f"gs AS (SELECT * REPLACE ({_AS_STUDY} AS architecture) FROM g WHERE architecture IN ('click', 'purchase', 'view', 'signup')), ms AS (" + " UNION ALL ".join(f"SELECT question_id, architecture, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM gs" for m, x in _STUDY.items()) + ")"


def _study(spark, sf_dir):
    g = _grid(spark, sf_dir).where("architecture in ('click', 'purchase', 'view', 'signup')").withColumn("architecture", F.expr(_AS_STUDY))
    return g.select("question_id", "architecture", *[F.expr(f"cast({x} as double)").alias(m) for m, x in _STUDY.items()]).unpivot(["question_id", "architecture"], list(_STUDY), "metric", "value")


@query(f"""WITH {_GRID}, {_STUDY_ROWS}, t AS (SELECT * FROM (VALUES {", ".join(repr(r) for r in stats.PLANNED)}) t(hypothesis, architecture_a, architecture_b, metric, source, population)),
p AS (SELECT a.architecture AS architecture_a, b.architecture AS architecture_b, a.metric, count(*) AS n, avg(a.value) AS ma, avg(b.value) AS mb FROM ms a JOIN ms b USING (question_id, metric) WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT architecture, metric, count(value) AS n FROM ms GROUP BY 1, 2)
SELECT t.*, CAST(coalesce(p.n, 0) AS BIGINT) AS pair_count, CAST(coalesce(x.n, 0) - coalesce(p.n, 0) AS BIGINT) AS unpaired_a, CAST(coalesce(y.n, 0) - coalesce(p.n, 0) AS BIGINT) AS unpaired_b, round(ma, 6) AS mean_a_paired, round(mb, 6) AS mean_b_paired
FROM t LEFT JOIN p USING (architecture_a, architecture_b, metric) LEFT JOIN c x ON x.architecture = architecture_a AND x.metric = t.metric LEFT JOIN c y ON y.architecture = architecture_b AND y.metric = t.metric""")
def planned_comparisons(spark, sf_dir):
    """The prespecified comparisons with the pairs that the metric rows have for each."""
    made = stats.planned_pairs(_study(spark, sf_dir), stats.planned_comparisons(spark))
    return made.withColumns({c: F.round(c, 6) for c in ("mean_a_paired", "mean_b_paired")})


_TESTS = [("H1", "click", "purchase", "latency_ms", "all"), ("H1", "click", "purchase", "abstained", "all"), ("H2", "purchase", "view", "support", "scored"), ("H2", "purchase", "view", "abstained", "all")]


def _tests(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("abstained", F.col("abstained").cast("double"))
    long = g.unpivot(["question_id", "architecture"], ["latency_ms", "support", "abstained"], "metric", "value")
    comparisons = spark.createDataFrame(_TESTS, "hypothesis string, architecture_a string, architecture_b string, metric string, population string")
    return stats.evaluate(long, comparisons, "run-1", table(spark, sf_dir, "events").select("user_id").distinct().count(), ("abstained",))


@query()
def hypothesis_table(spark, sf_dir):
    """With intervals and signed-rank p-values, which have no SQL form; hypothesis_counts holds the rest to SQL."""
    return _tests(spark, sf_dir)


_VALUES = ", ".join(repr(r) for r in _TESTS)


@query(f"""WITH {_LONG}, t AS (SELECT * FROM (VALUES {_VALUES}) t(hypothesis, architecture_a, architecture_b, metric, population)), n AS (SELECT count(DISTINCT user_id) AS n FROM events),
p AS (SELECT t.*, a.value AS x, b.value AS y FROM t JOIN l a ON a.architecture = architecture_a AND a.metric = t.metric JOIN l b ON b.architecture = architecture_b AND b.metric = t.metric AND b.question_id = a.question_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL)
SELECT 'run-1' AS run_id, hypothesis, architecture_a, architecture_b, metric, population, CASE WHEN metric = 'abstained' THEN 'McNemar exact, two-sided' ELSE 'Wilcoxon signed-rank, two-sided' END AS test, CAST(count(*) AS BIGINT) AS pair_count, CAST(any_value(n) - count(*) AS BIGINT) AS excluded_pair_count,
 round(avg(x), 6) AS mean_a_paired, round(avg(y), 6) AS mean_b_paired, round(avg(y - x), 6) AS mean_difference_b_minus_a, CASE WHEN metric = 'abstained' THEN CAST(count(*) FILTER (x = 1 AND y = 0) AS BIGINT) END AS a_only_success, CASE WHEN metric = 'abstained' THEN CAST(count(*) FILTER (x = 0 AND y = 1) AS BIGINT) END AS b_only_success
FROM p, n GROUP BY hypothesis, architecture_a, architecture_b, metric, population""")
def hypothesis_counts(spark, sf_dir):
    d = _tests(spark, sf_dir)
    near = [F.round(c, 6).alias(c) for c in ("mean_a_paired", "mean_b_paired", "mean_difference_b_minus_a")]
    return d.select("run_id", "hypothesis", "architecture_a", "architecture_b", "metric", "population", "test", "pair_count", "excluded_pair_count", *near, "a_only_success", "b_only_success")


@query(f"WITH {_GRID} SELECT 'Table 3' AS table_title, 'run-1' AS run_id, architecture, CAST(count(*) AS BIGINT) AS question_count, CAST(NULL AS VARCHAR) AS note FROM g GROUP BY 3")
def titled_table(spark, sf_dir):
    n = _grid(spark, sf_dir).groupBy("architecture").agg(F.count("*").alias("question_count"))
    return report.titled(n, "Table 3", "run-1", ["architecture", "question_count", "note"])


@query(f"WITH {_LONG} SELECT architecture, metric, round(avg(value), 6) AS value, CAST(count(value) AS BIGINT) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2")
def figure_bars(spark, sf_dir):
    return report.bars(_grid(spark, sf_dir).withColumn("abstained", F.col("abstained").cast("double")), "architecture", ["latency_ms", "support", "abstained"])


@query("WITH s AS (SELECT unnest(['en', 'fr', 'de', 'es', 'it']) AS lang), n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, count(*) AS t FROM documents GROUP BY 1) SELECT t.source, s.lang, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / t, 9) AS share FROM t CROSS JOIN s LEFT JOIN n ON n.source = t.source AND n.lang = s.lang")
def figure_shares(spark, sf_dir):
    return report.shares(table(spark, sf_dir, "documents"), "source", "lang", ["en", "fr", "de", "es", "it"])


@query("SELECT event_type, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS high, CAST(count(*) AS BIGINT) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def figure_boxes(spark, sf_dir):
    return report.boxes(table(spark, sf_dir, "events"), "event_type", "value")


@query(f"WITH {_GRID} SELECT architecture, round(avg(latency_ms), 6) AS x, round(avg(support), 6) AS y, CAST(count(*) AS BIGINT) AS n FROM g WHERE support IS NOT NULL AND latency_ms IS NOT NULL GROUP BY 1")
def figure_points(spark, sf_dir):
    return report.points(_grid(spark, sf_dir), "architecture", "latency_ms", "support")


@query(f"WITH {_LONG}, b AS (SELECT architecture, metric, avg(value) AS value FROM l WHERE value IS NOT NULL GROUP BY 1, 2) SELECT b.metric, b.architecture, round(b.value, 4) AS value, round(r.value, 4) AS reference_value, round(b.value - r.value, 4) AS difference FROM b LEFT JOIN b r ON r.metric = b.metric AND r.architecture = 'click'")
def comparison_matrix(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumn("abstained", F.col("abstained").cast("double"))
    long = g.unpivot(["architecture"], ["latency_ms", "support", "abstained"], "metric", "value").where("value is not null").groupBy("architecture", "metric").agg(F.avg("value").alias("value"))
    return report.comparison_matrix(long, "architecture", "click")


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    """Written with fixed columns and read with empty cells as null."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation")
    schema = ", ".join(f"{c} {k}" for c, k in n.select("n_nationkey", "n_name", "n_regionkey").dtypes)
    io.write_csv(n.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("n_regionkey")), path, ["n_nationkey", "n_name", "n_regionkey"])
    return io.read_csv(spark, path, schema)


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    """A snapshot that is written once, then read strictly; a second snapshot changes nothing."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    io.snapshot(c, path)
    io.snapshot(c.limit(0), path)
    return io.read_strict_jsonl(spark, path, "conv_id long, turn long, role string, text string", ["conv_id", "turn"])


@query("SELECT n_nationkey, n_name FROM nation")
def published_tables(spark, sf_dir):
    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    io.publish({"nation": table(spark, sf_dir, "nation").select("n_nationkey", "n_name")}, path, {"run": "run-1"})
    return spark.read.parquet(f"{path}/nation")


@query(f"WITH {BM25}, e AS (SELECT a.item_id, l.doc_id, coalesce(z.score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM q) a CROSS JOIN l LEFT JOIN z ON z.item_id = a.item_id AND z.doc_id = l.doc_id) " + _TOP.format(src="e", k=10))
def stored_sparse_index(spark, sf_dir):
    """Search over an index that was written, checked against its corpus and read back."""
    path, docs = f"{shared_dir(spark)}/sparse-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    digest = indices.corpus_digest(docs, "doc_id", "text")
    indices.save_sparse(sparse.build_index(docs), path, digest)
    found = sparse.search(indices.load_sparse(spark, path, digest), sparse.query_terms(table(spark, sf_dir, "benchmark")), 10)
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _dense_index(spark, sf_dir):
    path = f"{shared_dir(spark)}/dense-{uuid.uuid4().hex}"
    rows, asked = _vectors(spark, sf_dir)
    indices.save_dense(rows, path, "d", len(rows.first()["v"]), "passage: ", ["label"], tokenizer="words", token_budget=508)
    return path, asked


@query(_DENSE.format(on="true"))
def stored_dense_index(spark, sf_dir):
    """Search over blocks that were written; a query passes over those that cannot hold any of its best."""
    path, asked = _dense_index(spark, sf_dir)
    return dense.search_blocks(indices.load_dense(spark, path, "d", prefix="passage: "), asked, 10).withColumn("score", F.round("score", 6))


@query(_DENSE.format(on="a.label = b.label"))
def stored_dense_index_filtered(spark, sf_dir):
    path, asked = _dense_index(spark, sf_dir)
    return dense.search_blocks(indices.load_dense(spark, path, "d"), asked, 10, on=["label"]).withColumn("score", F.round("score", 6))


@query("SELECT 'stale_index' AS rule, k AS key, d AS detail FROM (SELECT 'rows' AS k, count(*) || '/' || count(*) + 1 AS d FROM embeddings UNION ALL SELECT 'dim', max(len(embedding)) || '/' || max(len(embedding)) * 2 FROM embeddings UNION ALL VALUES ('digest', 'd/e'), ('prefix', 'passage: /query: '), ('tokenizer', 'words/pieces'), ('token_budget', '508/512'))")
def stale_index_rules(spark, sf_dir):
    """All that an index over the table fails when it is expected to have been made otherwise."""
    path, _ = _dense_index(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings")
    n, dim = v.agg(F.count("*"), F.max(F.size("embedding"))).first()
    wrong = indices.stale(spark, path, "dense", "e", rows=n + 1, dim=2 * dim, prefix="query: ", tokenizer="pieces", token_budget=512)
    return spark.createDataFrame(wrong, "rule string, key string, detail string")

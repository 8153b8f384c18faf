"""Queries over sources, streams, whole pipelines and report tables."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, pipelines, report, rollups
from ..sources import io, pdf
from ..sources.store import materialise, shared_dir
from .common import query, table
from .corpus import _CLEAN
from .evaluation import _GRID, _grid


_SOURCES = [f"src{i}" for i in range(20)]


@query("SELECT lang, " + ", ".join(f"CAST(count(*) FILTER (source = '{s}') AS BIGINT) AS {s}" for s in _SOURCES) + " FROM documents GROUP BY 1")
def category_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return report.matrix(d, "lang", "source", "n", _SOURCES).select("lang", *[F.coalesce(s, F.lit(0)).alias(s) for s in _SOURCES])


@query(f"WITH {_GRID}, a AS (SELECT architecture, round(avg(support), 6) AS support, count(support) AS n FROM g GROUP BY 1), b AS (SELECT architecture, round(avg(abstained), 6) AS abstention_rate FROM g WHERE architecture <> 'view' GROUP BY 1) SELECT architecture, printf('%.3f (%d)', support, n) AS support_with_n, abstention_rate FROM a LEFT JOIN b USING (architecture)")
def overall_results(spark, sf_dir):
    g = _grid(spark, sf_dir)
    a = g.groupBy("architecture").agg(F.round(F.avg("support"), 6).alias("support"), F.count("support").alias("n"))
    b = g.where("architecture <> 'view'").groupBy("architecture").agg(F.round(F.avg("abstained"), 6).alias("abstention_rate"))
    return report.overall([a, b]).select("architecture", report.with_count(F.col("support"), F.col("n")).alias("support_with_n"), "abstention_rate")


@query(f"WITH {_GRID} SELECT architecture, CAST(abstained AS INT) AS flags_abstained, round(latency_ms, 6) AS times_latency_ms FROM g WHERE question_id = 7")
def case_study(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return report.case_study(7, {"flags": g.select("question_id", "architecture", "abstained"), "times": g.select("question_id", "architecture", F.round("latency_ms", 6).alias("latency_ms"))})


@query("SELECT doc_id, CASE WHEN length(x) <= 60 THEN x ELSE rtrim(substr(x, 1, 57)) || '...' END AS compact FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)")
def compact_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.compact_text(F.col("text"), 60).alias("compact"))


@query("SELECT source || '-' || doc_id AS doc_name, CASE WHEN n_chars % 2 = 1 AND substr(text, 1, 5) <> '%PDF-' THEN 'failed' WHEN lang = 'en' THEN 'skipped_existing' ELSE 'downloaded' END AS download_status FROM documents")
def manifest_status(spark, sf_dir):
    """Rows of a manifest: what a file begins with, and whether it was there before."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("doc_name"), (F.col("lang") == "en").alias("existing"), F.when(F.col("n_chars") % 2 == 0, "%PDF-").otherwise(F.substring("text", 1, 5)).alias("head"))
    return io.download_status(d).select("doc_name", "download_status")


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 3 <> 0")
def resume_anti_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return io.still_to_do(c, c.where("(conv_id + turn) % 3 = 0"), ["conv_id", "turn"])


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 2")
def first_per_group(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("m", -F.col("n_chars"))
    return rollups.first_per_group(d, ["source"], ["m", "doc_id"], 2).select("source", "doc_id")


@query("SELECT conv_id, turn, 'Question:' || chr(10) || trim(text) || chr(10) || chr(10) || 'Answer:' AS prompt FROM conversations WHERE role = 'user' AND trim(text) <> ''")
def closed_book_prompts(spark, sf_dir):
    from ..operators.prompts import closed_book_prompt

    c = table(spark, sf_dir, "conversations").where("role = 'user' and trim(text) <> ''")
    return c.select("conv_id", "turn", closed_book_prompt(F.col("text")).alias("prompt"))


@query("SELECT window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, value FROM events) GROUP BY 1, 2")
def windowed_latency(spark, sf_dir):
    from ..streaming.journal import windowed_latency as windows

    w = windows(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


@query(f"WITH r AS (SELECT source, doc_id // 640 AS part, CAST(row_number() OVER (PARTITION BY source, doc_id // 640 ORDER BY doc_id) - 1 AS INT) AS page, CASE WHEN doc_id % 10 = 0 THEN '' ELSE coalesce(text, '') END AS x FROM documents), c AS (SELECT source, part, page, {_CLEAN} AS t FROM r) SELECT source || '-' || part AS doc_name, page, sha256(t) AS text_sha256, CASE WHEN t = '' THEN 'empty' ELSE 'ok' END AS extraction_status FROM c UNION ALL SELECT 'broken', NULL, NULL, 'error:ValueError: no cross-reference'")
def pdf_pages(spark, sf_dir):
    """Documents written as PDF files, some pages blank, one file no PDF, and their pages read back, a task for each range of pages."""
    root = f"{shared_dir(spark)}/pdf-{uuid.uuid4().hex}"

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        name, rows = f"{rows['source'].iloc[0]}-{rows['part'].iloc[0]}", rows.sort_values("doc_id")
        pdf.create(f"{root}/{name}.pdf", pdf.write_pdf(["" if i % 10 == 0 else t or "" for i, t in zip(rows["doc_id"], rows["text"], strict=True)], compressed=rows["part"].iloc[0] % 2 == 0))
        return pd.DataFrame({"name": [name]})

    docs = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 640).alias("part"), "doc_id", "text")
    docs.groupBy("source", "part").applyInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    pdf.create(f"{root}/broken.pdf", b"no such thing")
    return pdf.read_pages(spark, root).select("doc_name", "page", F.sha2("text", 256).alias("text_sha256"), "extraction_status")


def _html_sql() -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    t = f"regexp_replace(html, {lit(T.COMMENT)}, '', 'g')"
    for name in T.HIDDEN:
        t = f"regexp_replace({t}, {lit(T.HIDDEN_ELEMENT.format(name))}, '', 'g')"
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, {lit(T.SPACES)}, ' ', 'g'), {lit(T.BLOCK_TAG)}, chr(10), 'g'), {lit(T.ANY_TAG)}, '', 'g')"
    known = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in T.REFERENCES.items()) + "}"
    name = f"regexp_extract(x, {lit(T.REFERENCE)}, 1)"
    code = f"CASE WHEN lower(substr({name}, 2, 1)) = 'x' THEN CAST('0x' || substr({name}, 3) AS INT) ELSE CAST(substr({name}, 2) AS INT) END"
    value = f"CASE WHEN starts_with({name}, '#') THEN CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) ELSE chr(65533) END ELSE k[{name}] END"
    piece = f"CASE WHEN i = 1 THEN x WHEN {name} <> '' AND {value} IS NOT NULL THEN {value} || substr(x, length({name}) + 2) ELSE '&' || x END"
    lines = f"list_filter(list_transform(string_split(array_to_string(list_transform(string_split(t, '&'), lambda x, i: {piece}), ''), chr(10)), lambda y: trim(regexp_replace(y, {lit(T.SPACES)}, ' ', 'g'))), lambda y: y <> '')"
    return f"SELECT page_id, CASE WHEN html IS NOT NULL THEN array_to_string({lines}, chr(10)) END AS text FROM (SELECT page_id, html, {t} AS t, {known} AS k FROM pages)"


@query(_html_sql())
def html_to_text(spark, sf_dir):
    return io.html_to_text(table(spark, sf_dir, "pages")).select("page_id", "text")


def _corpus(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_name"), F.col("doc_id").cast("int").alias("page"), "text")
    corpus = pipelines.build_corpus(chunking.chunk_pages(pages))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"), F.col("text").alias("retrieval_query"), F.col("text").alias("gold_answer"))
    return corpus, q


def _answers(spark, sf_dir, architecture):
    a = pipelines.answer(architecture, *_corpus(spark, sf_dir))
    return a.select("question_id", "architecture", "generated_answer", F.coalesce(F.transform("retrieved_chunks", lambda c: c["chunk_id"]), F.array().cast("array<string>")).alias("chunk_ids"))


def _records(spark, sf_dir):
    """The answer records of all architectures, stored as a run would store them."""
    corpus, q = _corpus(spark, sf_dir)
    made = [pipelines.answer(a, corpus, q).select("question_id", "architecture", "generated_answer", "retrieved_chunks.chunk_id", *_TIMES, *_TOKENS, "llm_model", "generation_parameters", "experiment_parameters") for a in ("P0", "P1", "P2", "P3")]
    return materialise(reduce(DataFrame.unionByName, made), "records")


_TIMES, _TOKENS = ("retrieval_latency_ms", "reranking_latency_ms", "generation_latency_ms", "total_latency_ms"), ("input_tokens", "output_tokens", "total_tokens")
_RUNS = "r AS (SELECT * FROM benchmark, (VALUES ('P0', NULL, NULL, NULL, NULL, NULL, 0), ('P1', 5, NULL, NULL, NULL, NULL, 5), ('P2', 10, 10, 60, 5, NULL, 5), ('P3', 20, 20, 60, 20, 20, 5)) t(architecture, dense_k, sparse_k, rrf_k, fusion_k, reranker_k, final_k))"


@query(f"WITH {_RUNS} SELECT architecture, count(*) AS question_count, CAST(dense_k AS INT) AS dense_k, CAST(sparse_k AS INT) AS sparse_k, CAST(rrf_k AS INT) AS rrf_k, CAST(fusion_k AS INT) AS fusion_k, CAST(reranker_k AS INT) AS reranker_k, CAST(final_k AS INT) AS final_k, reranker_k IS NOT NULL AS reranked FROM r GROUP BY ALL")
def architecture_configuration(spark, sf_dir):
    """What the records of a run over all benchmark questions say that they were made with."""
    return report.configuration(_records(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT CAST(item_id AS VARCHAR) AS question_id, architecture, CAST(final_k AS INT) AS chunks, architecture <> 'P0' AS retrieved, architecture = 'P3' AS reranked, true AS times_add_up, true AS tokens_add_up, 'echo_generator' AS llm_model, CAST(final_k AS VARCHAR) AS final_context_k FROM r")
def answer_records(spark, sf_dir):
    a = _records(spark, sf_dir)
    parts = F.coalesce("retrieval_latency_ms", F.lit(0.0)) + F.coalesce("reranking_latency_ms", F.lit(0.0)) + F.col("generation_latency_ms")
    sound = (F.abs(F.col("total_latency_ms") - parts) < 1e-6) & (F.col("generation_latency_ms") >= 0)
    tokens = (F.col("input_tokens") + F.col("output_tokens") == F.col("total_tokens")) & (F.col("input_tokens") > 0) & (F.col("output_tokens") > 0)
    return a.select(
        "question_id", "architecture", F.coalesce(F.size("chunk_id"), F.lit(0)).alias("chunks"), F.col("retrieval_latency_ms").isNotNull().alias("retrieved"), F.col("reranking_latency_ms").isNotNull().alias("reranked"),
        sound.alias("times_add_up"), tokens.alias("tokens_add_up"), "llm_model", F.col("experiment_parameters")["final_context_k"].alias("final_context_k"),
    )


@query(f"WITH {_RUNS}, c AS (SELECT * FROM r, (VALUES ('retrieval_latency_ms'), ('reranking_latency_ms'), ('generation_latency_ms'), ('total_latency_ms')) t(component)) SELECT architecture, component, count(*) AS n, true AS ordered FROM c WHERE component IN ('generation_latency_ms', 'total_latency_ms') OR (component = 'retrieval_latency_ms' AND architecture <> 'P0') OR (component = 'reranking_latency_ms' AND architecture = 'P3') GROUP BY 1, 2")
def answer_latency(spark, sf_dir):
    """The latency summary of the engine's own records."""
    s = rollups.latency_summary(_records(spark, sf_dir), "architecture", list(_TIMES), {"retrieval_latency_ms": ["P1", "P2", "P3"], "reranking_latency_ms": ["P3"]})
    return s.select("architecture", "component", "n", ((F.col("min") <= F.col("median")) & (F.col("median") <= F.col("max")) & (F.col("std") >= 0)).alias("ordered"))


@query()
def pipeline_p0(spark, sf_dir):
    return _answers(spark, sf_dir, "P0")


@query()
def pipeline_p1(spark, sf_dir):
    return _answers(spark, sf_dir, "P1")


@query()
def pipeline_p2(spark, sf_dir):
    return _answers(spark, sf_dir, "P2")


@query()
def pipeline_p3(spark, sf_dir):
    return _answers(spark, sf_dir, "P3")


@query("SELECT conv_id, turn, role FROM conversations")
def stream_ingest_journal(spark, sf_dir):
    """Conversations written as JSON lines, taken up by a stream and appended to a journal once each."""
    from ..streaming.journal import ingest, read_journal

    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    c.unionAll(c.where("turn = 0")).write.json(f"{root}/in")
    ingest(spark, f"{root}/in", "conv_id long, turn long, role string", ["conv_id", "turn"], lambda df: df, f"{root}/journal", f"{root}/state").awaitTermination()
    return read_journal(spark, f"{root}/journal")

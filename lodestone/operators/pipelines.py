"""The four retrieval architectures, each over a whole question set."""

from __future__ import annotations

import time
from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialise
from . import dense, fusion, rerank, sparse
from .models import Generator, Scorer, echo_generator, embed, generate, overlap_scorer
from .prompts import closed_book_prompt, rag_prompt
from .query_processing import chunk_filters
from .selection import slim


@dataclass(frozen=True)
class Settings:
    """Candidates per stage of each architecture."""

    p1_dense: int = 5
    p2_dense: int = 10
    p2_sparse: int = 10
    p2_fused: int = 5
    p3_dense: int = 20
    p3_sparse: int = 20
    p3_fused: int = 20
    final: int = 5
    rrf_k: int = 60

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise ValueError(f"{f.name} must be positive")
        if self.final > min(self.p1_dense, self.p2_fused, self.p3_fused):
            raise ValueError("the final context is larger than what a stage before it keeps")


FILTERS = ["company", "fiscal_year"]


@dataclass(frozen=True)
class Corpus:
    """chunks (chunk_id, doc_name, page, text, retrieval_text), vectors (id, v, company, fiscal_year), what retrieval filters by, and a sparse index
    that is made when an architecture first asks for it, all keyed by chunk_id."""

    chunks: DataFrame
    vectors: DataFrame
    filters: DataFrame

    @cached_property
    def index(self) -> sparse.SparseIndex:
        return sparse.build_index(chunk_filters(self.chunks, keep=["retrieval_text"]), "id", "retrieval_text", keep=FILTERS)


def word_count(c: Column) -> Column:
    """Tokens of a model that counts words."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))


def build_corpus(chunks: DataFrame, encoder=None, vectors: DataFrame | None = None) -> Corpus:
    """Chunks are kept once, as every part reads them. vectors (id, v) replace the encoder's where they are there already."""
    chunks = materialise(chunks, "chunks")
    filters = chunk_filters(chunks)
    if vectors is None:
        vectors = chunk_filters(chunks.withColumn("v", embed(F.col("retrieval_text"), encoder, "passage: ")), keep=["v"])
    else:
        vectors = vectors.select("id", "v").join(filters, "id")
    return Corpus(chunks, vectors, filters)


def metadata(architecture: str, s: Settings = Settings(), rerank_config: rerank.RerankConfig = rerank.RerankConfig()) -> dict[str, str]:
    """What an architecture was run with; what it lacks is not named."""
    out = {"architecture": architecture, "final_context_k": s.final if architecture != "P0" else 0}
    if architecture != "P0":
        out |= {"query_filter_policy": "company and unambiguous year of the question alone", "query_expansion_policy": "fixed expansions", "generation_context_policy": "chunk text as stored"}
    if architecture == "P1":
        out |= {"dense_candidate_k": s.p1_dense}
    if architecture in ("P2", "P3"):
        kd, ks, kf = (s.p2_dense, s.p2_sparse, s.p2_fused) if architecture == "P2" else (s.p3_dense, s.p3_sparse, s.p3_fused)
        out |= {"dense_candidate_k": kd, "sparse_candidate_k": ks, "fusion_candidate_k": kf, "rrf_k": s.rrf_k}
    if architecture == "P3":
        out |= {"reranker_candidate_k": s.p3_fused, "reranker_max_length": rerank_config.max_length, "reranker_window_overlap": rerank_config.overlap, "reranker_query_policy": "the first stage's query"}
    return {k: str(v) for k, v in out.items()}


def first_stage(architecture: str, corpus: Corpus, questions: DataFrame, settings: Settings = Settings(), encoder=None) -> DataFrame:
    """questions (question_id, retrieval_query, and v where queries are encoded already) -> (question_id, rank, chunk_id, score): what is retrieved before any reranking."""
    s = settings
    if architecture not in ("P1", "P2", "P3"):
        raise ValueError(f"unknown architecture {architecture}")
    on = [c for c in FILTERS if c in questions.columns]
    name = lambda df, score: df.select(F.col("query_id").alias("question_id"), "rank", F.col("id").alias("chunk_id"), F.col(score).alias("score"))
    v = F.col("v") if "v" in questions.columns else embed(F.col("retrieval_query"), encoder, "query: ")
    asked = materialise(questions.select(F.col("question_id").alias("query_id"), v.alias("v"), *on), "asked")
    dense_ = lambda k: dense.exact_top_k(corpus.vectors, asked, k, on)
    if architecture == "P1":
        return name(dense_(s.p1_dense), "score")
    kd, ks, kf = (s.p2_dense, s.p2_sparse, s.p2_fused) if architecture == "P2" else (s.p3_dense, s.p3_sparse, s.p3_fused)
    words = sparse.search(corpus.index, sparse.query_terms(questions, "question_id", "retrieval_query"), ks, asked.select("query_id", *on) if on else None)
    return name(fusion.hybrid(dense_(kd), words, kf, s.rrf_k)[0], "rrf")


def final_context(architecture: str, found: DataFrame, corpus: Corpus, questions: DataFrame, settings: Settings = Settings(), scorer: Scorer = overlap_scorer) -> DataFrame:
    """first_stage() -> the final context: its first chunks, reranked before where the architecture does that."""
    if architecture != "P3":
        return found.where(F.col("rank") <= settings.final)
    # the header is what the retrieval text has before the chunk's own
    header = F.expr("left(retrieval_text, greatest(0, length(retrieval_text) - length(text)))").alias("header")
    c = found.join(corpus.chunks.select("chunk_id", "text", header), "chunk_id").join(questions.select("question_id", F.col("retrieval_query").alias("query")), "question_id")
    return rerank.rerank(c, settings.final, scorer).select("question_id", "rank", "chunk_id", "score")


def retrieve(architecture: str, corpus: Corpus, questions: DataFrame, settings: Settings = Settings(), encoder=None, scorer: Scorer = overlap_scorer) -> DataFrame:
    """questions (question_id, retrieval_query, and v where queries are encoded already) -> (question_id, rank, chunk_id, score) of the final context.

    If questions have company (collapsed key) and fiscal_year, as process_queries() gives them, dense and sparse retrieval see only chunks that equal them; null asks for nothing."""
    if architecture == "P0":
        return questions.sparkSession.createDataFrame([], "question_id string, rank int, chunk_id string, score double")
    return final_context(architecture, first_stage(architecture, corpus, questions, settings, encoder), corpus, questions, settings, scorer)


def _timed(make, name: str) -> tuple[DataFrame, float]:
    """A stage's result, written, and the milliseconds that took."""
    began = time.perf_counter()
    out = materialise(make(), name)
    return out, (time.perf_counter() - began) * 1000


def answer(
    architecture: str, corpus: Corpus, questions: DataFrame, settings: Settings = Settings(), generator: Generator = echo_generator, encoder=None, scorer: Scorer = overlap_scorer,
    model: dict[str, str] | None = None, count_tokens=word_count, experiment: dict[str, str] | None = None,
) -> DataFrame:
    """questions (question_id, question, retrieval_query, gold_answer) -> answer records; prompts carry the question as asked and chunks as stored.

    Questions are answered together, so a question's retrieval_latency_ms and reranking_latency_ms are its share of the whole set's (null where the architecture lacks the
    stage), as generation_latency_ms is of its batch's; total_latency_ms is their sum. model (provider, model, max_output_tokens, temperature, ...) becomes llm_provider,
    llm_model and generation_parameters; experiment is added to the architecture's metadata() as experiment_parameters. Tokens are those of count_tokens.
    """
    model = {"provider": "local", "model": generator.__name__, **(model or {})}
    n = max(1, questions.count())
    retrieval_ms = reranking_ms = None
    if architecture == "P0":
        found = retrieve(architecture, corpus, questions)
    else:
        found, took = _timed(lambda: first_stage(architecture, corpus, questions, settings, encoder), "first")
        retrieval_ms = took / n
        if architecture == "P3":
            found, took = _timed(lambda: final_context(architecture, found, corpus, questions, settings, scorer), "final")
            reranking_ms = took / n
        else:
            found = final_context(architecture, found, corpus, questions, settings, scorer)
    chunks = slim(found.join(corpus.chunks.drop("rank", "score"), "chunk_id"), ("question_id",))
    fields = [c for c in chunks.columns if c not in ("question_id", "rank")]
    g = chunks.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("retrieved_chunks"))
    d = questions.join(g, "question_id", "left").withColumn("architecture", F.lit(architecture))
    prompt = closed_book_prompt(F.col("question")) if architecture == "P0" else rag_prompt(F.col("question"), F.col("retrieved_chunks"))
    made = generate(d.withColumn("prompt", prompt), "prompt", generator).drop("retrieval_query", "v", *FILTERS)
    ms = lambda x: F.lit(x).cast("double")
    parameters = lambda m: F.create_map(*[F.lit(str(x)) for pair in sorted(m.items()) for x in pair])
    said, asked = count_tokens(F.coalesce("generated_answer", F.lit(""))), count_tokens(F.col("prompt"))
    return made.withColumns({
        "retrieval_latency_ms": ms(retrieval_ms), "reranking_latency_ms": ms(reranking_ms), "total_latency_ms": ms((retrieval_ms or 0.0) + (reranking_ms or 0.0)) + F.col("generation_latency_ms"), "llm_provider": F.lit(model["provider"]),
        "llm_model": F.lit(model["model"]), "input_tokens": asked, "output_tokens": said, "total_tokens": asked + said, "generation_parameters": parameters({k: v for k, v in model.items() if k != "provider"}),
        "experiment_parameters": parameters(metadata(architecture, settings) | (experiment or {})),
    })

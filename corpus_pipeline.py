"""A training-corpus pipeline over documents: each stage works on what its predecessor kept, and its decisions take effect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, kept, materialise, maybe_broadcast, shared_dir, table
from lodestone.llm.decontaminate import contamination
from lodestone.llm.language_id import accepted_only, train
from lodestone.llm.near_dedup import near_duplicates
from lodestone.llm.packing import pack
from lodestone.llm.pii import redact

#: Near copies link from this similarity on, in hundredths.
SIMILARITY = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose language is rejected go: null texts, texts without a letter (empty ones too), and texts unlike all
    texts of the languages learned. Rows are judged one by one, so repeated ids and rows without an id are as others; no rows give no rows."""
    bound_batches(spark)
    return accepted_only(docs, train(docs, fold="true"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group stays, that with the smallest doc_id. Rows without an id stay, as do texts without words, which
    are linked with nothing. Rows of one doc_id are one document: one of them stays, the same whatever the partitions (that of the least hash
    of all columns). No rows give no rows."""
    bound_batches(spark)
    judged = kept(spark, "judged", lambda: near_duplicates(docs, percent=SIMILARITY))
    gone = judged.where("not kept and doc_id is not null").select("doc_id").distinct()
    left = docs.join(maybe_broadcast(gone, 16), "doc_id", "left_anti").select(*docs.columns)
    twice = judged.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        return left
    twice = maybe_broadcast(materialise(twice, "twice"), 16)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # a minimum within each task first, so an id that very many rows share is not gathered
    one = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("r")).select(*[F.col("r").getField(c).alias(c) for c in docs.columns])
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold benchmark windows over the share that counts as contaminated go. Each text is judged by itself and goes
    wherever it stands, with an id or without; other rows of its id stay. Null and empty texts have no words and stay. No rows give no rows."""
    text = F.xxhash64("text")  # 64 bits: that a clean text shares them with one of m contaminated ones has a probability of m / 2^64
    judge = lambda: contamination(docs.select(text.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated")
    judged = kept(spark, "contaminated", lambda: judge().select(F.col("doc_id").alias("_text")).distinct())
    return docs.join(maybe_broadcast(judged, 16), text == F.col("_text"), "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data in texts is replaced by its kind; n_chars follows the text. All rows stay; null texts stay null, with a null n_chars."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the place of each document's pieces in sequences of 1024 tokens; null and empty texts are the end id alone, repeated rows are packed each."""
    bound_batches(spark)
    return pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", private), ("packing", packing)]

#: Language models, tokenizers and the pattern graph have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{k}-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

"""Readers and writers with the strictness that evaluation runs need."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import html_text
from ..operators import checks, validation


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str] = ()) -> DataFrame:
    """JSON lines of a declared schema; a malformed line fails the read, blank lines don't count."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return checks.require_columns(df, list(required))


def read_strict_jsonl(spark: SparkSession, path: str, schema: str, required: list[str] = (), show: int = 5) -> DataFrame:
    """read_jsonl(), but what is wrong raises at once and is named: malformed lines by file and line number, required fields that are null or missing,
    and input without any record. The lines are parsed once to check and again by whoever uses the result; nothing is gathered but the first faults."""
    df = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    columns = [c for c in df.columns if c != "_bad"]
    checks.require_columns(df, list(required))
    lack = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required]) if required else F.lit("")
    kept = df.select(F.col("_bad"), lack.alias("lack"), F.col("_metadata.file_path").alias("file"), F.col(columns[0]).cast("string").alias("first"))  # Spark refuses to read the faults alone
    wrong = kept.where("_bad is not null or lack <> ''").limit(show).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.file}{_line(spark, r.file, r._bad)}: " + ("malformed JSON" if r._bad is not None else f"missing {r.lack}") for r in wrong))
    if kept.isEmpty():
        raise ValueError(f"no records in {path}")
    return df.select(*columns)


def _line(spark: SparkSession, file: str, text: str | None) -> str:
    """':7' for a malformed line, looked up only when a read has failed: lines are counted in the order of the file, split by split."""
    if text is None:
        return ""
    found = spark.read.text(file).rdd.map(lambda r: r[0]).zipWithIndex().filter(lambda x: x[0] == text).map(lambda x: x[1]).take(1)
    return f":{found[0] + 1}" if found else ""


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines; one without an id or with a blank text, an id that is there twice, or an empty file raises."""
    df = read_strict_jsonl(spark, path, schemas.QUESTION)
    checks.enforce(checks.together(validation.question_records(df), checks.duplicate_keys(df.where("question_id is not null"), ["question_id"])))
    return df


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON lines; a page that is there twice raises."""
    df = read_strict_jsonl(spark, path, schemas.PAGE, ["doc_name", "page"])
    checks.enforce(checks.duplicate_keys(df, ["doc_name", "page"]))
    return df


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return checks.require_columns(read_csv(spark, path, schemas.MANIFEST), ["doc_name", "download_status"])


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer records from JSON lines; a question that an architecture answered twice raises."""
    df = read_strict_jsonl(spark, path, schemas.ANSWER, ["question_id", "architecture"])
    checks.enforce(checks.duplicate_keys(df, ["architecture", "question_id"]))
    return df


def load_chunks(spark: SparkSession, path: str, schema: str = schemas.CHUNK, required: list[str] = ("chunk_id", "doc_name", "page", "text", "retrieval_text")) -> DataFrame:
    """Chunks from JSON lines; a missing field, an id that is there twice, a blank text or an empty file raises."""
    df = read_strict_jsonl(spark, path, schema)
    checks.require_columns(df, list(required))
    checks.enforce(validation.chunk_records(df, list(required)))
    return df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, in which an empty cell is null: not applicable, never 0."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Columns in this order and no others; existing output is refused."""
    extra = sorted(set(df.columns) - set(fields))
    if extra:
        raise ValueError(f"columns that are not fields: {', '.join(extra)}")
    df.select(*fields).write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def snapshot(df: DataFrame, path: str) -> None:
    """JSON lines once: what is there stays."""
    df.write.mode("ignore").json(path)


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def still_to_do(expected: DataFrame, journal: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows without a journal entry, so a stopped run goes on where it was."""
    return expected.join(journal.select(*keys).distinct(), keys, "left_anti")


def publish(frames: dict[str, DataFrame], path: str, manifest: dict) -> None:
    """All or nothing: everything is written to a staging folder and moved; the manifest comes last. Works on any store that Spark reaches."""
    spark = next(iter(frames.values())).sparkSession
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(f"{path}/manifest.json")):
        raise FileExistsError(f"{path} is published")
    staging = f"{path}/.staging-{uuid.uuid4().hex}"
    for name, df in frames.items():
        df.write.parquet(f"{staging}/{name}")
    for name in frames:
        if not fs.rename(at(f"{staging}/{name}"), at(f"{path}/{name}")):
            raise OSError(f"{name} could not be moved")
    fs.delete(at(staging), True)
    out = fs.create(at(f"{path}/manifest.json"), False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True, ensure_ascii=False).encode()))
    out.close()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files; each file is one row, so one file fits a task."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, payload, path: str, replace: bool = False) -> None:
    """One small JSON document, written aside and then moved, so a reader sees all of it or nothing. Existing ones are refused unless replace."""
    at, fs = _hadoop(spark, path)
    if fs.exists(at(path)) and not replace:
        raise FileExistsError(path)
    aside = f"{path}.tmp-{uuid.uuid4().hex}"
    out = fs.create(at(aside), False)
    out.write(bytearray((json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    out.close()
    if replace:
        # the store's own replacing move: a reader sees the old document or the new one, and a failure leaves the old one
        jvm = spark.sparkContext._jvm
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(at(aside), at(path), _overwrite(spark))
        return
    if not fs.rename(at(aside), at(path)):
        raise OSError(f"{path} could not be moved")


def _overwrite(spark: SparkSession):
    """The option of a move, as the array that its signature asks for."""
    gateway = spark.sparkContext._gateway
    kind = gateway.jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    return options


def read_json(spark: SparkSession, path: str):
    rows = spark.read.text(path, wholetext=True).collect()  # one small document
    return json.loads(rows[0][0])


def archive(spark: SparkSession, path: str, archive_dir: str) -> str | None:
    """A copy of what is at path, under archive_dir by the time of day; None where there is nothing."""
    at, fs = _hadoop(spark, path)
    if not fs.exists(at(path)):
        return None
    target = f"{archive_dir}/{datetime.now(timezone.utc).strftime('%Y%m%dT%H%M%S%fZ')}-{path.rstrip('/').rsplit('/', 1)[-1]}"
    fs.mkdirs(at(archive_dir))
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at(path), fs, at(target), False, spark.sparkContext._jsc.hadoopConfiguration())
    return target


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file; of a folder, of its files' names and digests in order of name."""
    files = sorted((r.path.rsplit("/", 1)[-1], r.sha256) for r in file_digests(spark, path).collect())  # a row per file
    if not files:
        raise FileNotFoundError(path)
    return files[0][1] if len(files) == 1 else hashlib.sha256("".join(f"{n}:{d}\n" for n, d in files).encode()).hexdigest()


def write_provenance(spark: SparkSession, path: str, title: str, run_manifest: str, inputs: dict[str, str], parameters: dict, outputs: dict[str, str]) -> dict:
    """The sidecar of a result: what it was made from, each with its digest, and of which run."""
    payload = {
        "title": title, "created_at_utc": datetime.now(timezone.utc).isoformat(), "run_manifest": run_manifest, "run_manifest_sha256": digest(spark, run_manifest),
        "inputs": {n: {"path": p, "sha256": digest(spark, p)} for n, p in inputs.items()}, "parameters": parameters, "outputs": dict(outputs),
    }
    write_json(spark, payload, path, replace=True)
    return payload


def verify_provenance(spark: SparkSession, path: str, run_manifest: str | None = None) -> list[str]:
    """What no longer holds of a sidecar: 'run_manifest' if it (or the one given) has another digest, and the names of inputs that changed or are gone."""
    said, wrong = read_json(spark, path), []

    def same(p: str, want: str) -> bool:
        try:
            return digest(spark, p) == want
        except Exception as e:  # a path that is gone, by whichever store
            if isinstance(e, FileNotFoundError) or "PATH_NOT_FOUND" in str(e):
                return False
            raise

    if not same(run_manifest or said["run_manifest"], said["run_manifest_sha256"]):
        wrong.append("run_manifest")
    return wrong + [n for n, x in said["inputs"].items() if not same(x["path"], x["sha256"])]


def pages_from_binary(spark: SparkSession, path: str, reader) -> DataFrame:
    """Page rows of documents in binary files. reader(content: bytes) yields the text of each page, blank ones too; a file that it can't read gives one row with the error as status."""
    def run(batches):
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                name = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    for k, text in enumerate(reader(bytes(content))):
                        rows.append((name, k, text, "ok" if text.strip() else "empty"))
                except Exception as e:
                    rows.append((name, None, None, f"error:{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_name", "page", "text", "extraction_status"]).astype({"page": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc_name string, page int, text string, extraction_status string")


def html_to_text(df: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """Visible text of HTML, lines per block, by html_text()."""
    return df.withColumn(out, html_text(F.col(column)))


def download_status(df: DataFrame) -> DataFrame:
    """Status of manifest rows from what is on disk and what was fetched: present files are skipped, files that aren't PDF fail. Fetching itself needs a network and is not done here."""
    ok = F.col("head") == "%PDF-"
    status = F.when(F.col("existing") & ok, "skipped_existing").when(~F.col("existing") & ok, "downloaded").otherwise("failed")
    return df.withColumn("download_status", status)

"""Queries over files, sidecars, refusals and model calls: what was written is read back and compared with the tables it came from."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators import checks, chunking, models
from ..sources import io
from ..sources.store import shared_dir
from .common import query, table
from .corpus import _CHUNKS, _PAGES, _pages


def _files(spark, sf_dir):
    """A text file with its name for each region: (key, name, path)."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    out = []
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect():  # a handful
        path = f"{root}/region-{r.r_regionkey}"
        spark.createDataFrame([(r.r_name,)], "value string").coalesce(1).write.text(path)
        out.append((r.r_regionkey, r.r_name, path))
    return root, out


@query("SELECT 'region-' || r_regionkey AS folder, CAST(octet_length(encode(r_name)) + 1 AS BIGINT) AS length, sha256(r_name || chr(10)) AS sha256 FROM region")
def file_digests(spark, sf_dir):
    root, _ = _files(spark, sf_dir)
    return io.file_digests(spark, f"{root}/*/part-*").select(F.element_at(F.split("path", "/"), -2).alias("folder"), "length", "sha256")


@query("SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'changed' WHEN r_regionkey = 3 THEN 'gone' ELSE 'same' END AS status, 'region-' || r_regionkey AS input FROM region WHERE r_regionkey % 2 = 0 OR r_regionkey = 3")
def provenance_changes(spark, sf_dir):
    """Inputs of a sidecar of which some are written anew and one is removed afterwards."""
    root, made = _files(spark, sf_dir)
    sidecar, manifest = f"{root}/provenance.json", f"{root}/run.json"
    io.write_json(spark, {"run": "run-1"}, manifest)
    io.write_provenance(spark, sidecar, "regions", manifest, {f"region-{k}": path for k, _, path in made}, {}, {})
    for k, name, path in made:
        if k % 2 == 0:
            spark.createDataFrame([(f"{name}!",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    at, fs = io._hadoop(spark, root)
    fs.delete(at(f"{root}/region-3"), True)
    gone = {f"region-{k}" for k, _, path in made if not fs.exists(at(path))}
    rows = [("gone" if name in gone else "changed", name) for name in io.verify_provenance(spark, sidecar)]
    return spark.createDataFrame(rows, "status string, input string")


@query("SELECT r_regionkey, r_name, CASE WHEN r_regionkey % 2 = 1 THEN 2 ELSE 1 END AS version FROM region")
def json_documents(spark, sf_dir):
    """A document for each region; those of odd keys are replaced, the others refuse it."""
    _, made = _files(spark, sf_dir)
    rows = []
    for k, name, path in made:
        document = f"{path}.json"
        io.write_json(spark, {"name": name, "version": 1}, document)
        try:
            io.write_json(spark, {"name": name, "version": 2}, document, replace=k % 2 == 1)
        except FileExistsError:
            pass
        said = io.read_json(spark, document)
        rows.append((k, said["name"], said["version"]))
    return spark.createDataFrame(rows, f"r_regionkey {dict(table(spark, sf_dir, 'region').dtypes)['r_regionkey']}, r_name string, version int")


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 'refused' ELSE 'written' END AS second FROM nation")
def refused_outputs(spark, sf_dir):
    """Nations written by region, and the archive of one region's; writing a region that is there already is refused and leaves it as it was."""
    root, made = _files(spark, sf_dir)
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    kind = f"n_nationkey {dict(n.dtypes)['n_nationkey']}, n_name string"
    parts = []
    for k, _, _ in made:
        path, mine = f"{root}/nations-{k}", n.where(F.col("n_regionkey") == k).select("n_nationkey", "n_name")
        io.write_csv(mine, path, ["n_nationkey", "n_name"])
        second = "written"
        if k == 2:
            try:
                io.write_csv(mine.limit(0), path, ["n_nationkey", "n_name"])
            except AnalysisException:
                second = "refused"
            path = io.archive(spark, path, f"{root}/archive")
        parts.append(io.read_csv(spark, path, kind).withColumn("second", F.lit(second)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_PAGES}, {_CHUNKS} SELECT doc_name || '_p' || page || '_c' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') AS chunk_id, doc_name, page, sha256(body) AS text_sha256 FROM ch")
def chunk_files(spark, sf_dir):
    """Chunks written as JSON lines and loaded with all that is asked of them."""
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    chunking.chunk_pages(_pages(spark, sf_dir)).write.json(path)
    return io.load_chunks(spark, path).select("chunk_id", "doc_name", "page", F.sha2("text", 256).alias("text_sha256"))


_REQUIRED = {"documents": ["doc_id", "text", "page"], "nation": ["n_name", "n_zip"], "events": ["user_id"], "labels": ["quality", "toxic", "judge"]}


@query("SELECT 'missing_column' AS rule, t AS key, c AS detail FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in _REQUIRED.items() for c in cs) + ") v(t, c) WHERE NOT EXISTS (SELECT 1 FROM duckdb_columns() WHERE table_name = t AND column_name = c)")
def missing_columns(spark, sf_dir):
    return checks.missing_columns({t: table(spark, sf_dir, t) for t in _REQUIRED}, _REQUIRED)


@query("SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN 'said ' || turn END AS response, CASE WHEN turn % 5 = 4 THEN 3 WHEN turn % 2 = 1 THEN 2 ELSE 1 END AS parse_attempts, CASE WHEN turn % 5 = 4 THEN 'nothing said' END AS model_error FROM conversations")
def structured_calls(spark, sf_dir):
    """A model that answers some turns only when it is told what was wrong, and some never."""

    def model(prompt: str) -> str:
        turn = int(prompt.split("|")[0])
        return "" if turn % 5 == 4 or (turn % 2 == 1 and "rejected: nothing said" not in prompt) else f"said {turn}"

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("|", F.col("turn").cast("string"), F.coalesce("text", F.lit(""))).alias("prompt"))
    return models.call_each(c, "prompt", model, lambda said: None if said else "nothing said").select("conv_id", "turn", "response", F.col("parse_attempts").cast("int").alias("parse_attempts"), "model_error")

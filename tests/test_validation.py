import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, evidence, models, retrieval_eval, rollups, selection, stats, validation
from lodestone.sources import io


def test_strict_records_are_named_by_file_and_line(spark, tmp_path):
    good, bad, gap, none = (str(tmp_path / f"{n}.jsonl") for n in ("good", "bad", "gap", "none"))
    (tmp_path / "good.jsonl").write_text('{"k": 1, "t": "a"}\n\n{"k": 2, "t": "b"}\n')
    (tmp_path / "bad.jsonl").write_text('{"k": 1, "t": "a"}\n\n{"k": 2, "t": \n')
    (tmp_path / "gap.jsonl").write_text('{"k": 1}\n')
    (tmp_path / "none.jsonl").write_text("\n\n")
    read = lambda p: io.read_strict_jsonl(spark, p, "k long, t string", ["k", "t"])
    assert sorted(map(tuple, read(good).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match=r"bad\.jsonl:3: malformed JSON"):
        read(bad)
    with pytest.raises(ValueError, match=r"gap\.jsonl: missing t"):
        read(gap)
    with pytest.raises(ValueError, match="no records"):
        read(none)


def test_chunks_are_refused_unless_whole(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "retrieval_text": "x"}\n{"chunk_id": "a", "retrieval_text": " "}\n{"retrieval_text": "y"}\n')
    with pytest.raises(ValueError) as e:
        io.load_chunks(spark, str(tmp_path / "c.jsonl"), "chunk_id string, retrieval_text string", ["chunk_id", "retrieval_text"])
    assert all(x in str(e.value) for x in ("missing_field null: chunk_id", "duplicate_chunk a: 2", "blank_text a"))


def test_provenance_tells_what_has_changed(spark, tmp_path):
    for n in ("run.json", "in.csv"):
        (tmp_path / n).write_text(n)
    side = str(tmp_path / "side.json")
    made = io.write_provenance(spark, side, "Stage", str(tmp_path / "run.json"), {"in": str(tmp_path / "in.csv")}, {"k": 5}, {"out": "o"})
    assert io.read_json(spark, side) == made and io.verify_provenance(spark, side) == []
    (tmp_path / "in.csv").write_text("other")
    assert io.verify_provenance(spark, side) == ["in"]
    (tmp_path / "in.csv").unlink()
    (tmp_path / "run.json").write_text("other")
    assert io.verify_provenance(spark, side) == ["run_manifest", "in"]
    copy = io.archive(spark, side, str(tmp_path / "old"))
    assert io.read_json(spark, copy) == made and io.archive(spark, str(tmp_path / "nowhere"), str(tmp_path / "old")) is None
    with pytest.raises(FileExistsError):
        io.write_json(spark, {}, side)


def test_complete_joins_raise(spark):
    e = spark.createDataFrame([(1, 0, "d", 1), (2, 0, "d", 9), (3, 0, None, None)], "question_id long, item int, doc_name string, page int")
    p = spark.createDataFrame([("d", 1, "text"), ("d", 2, "a")], "doc_name string, page int, text string")
    assert [r.page_text for r in validation.require_pages(e.where("question_id = 1"), p).collect()] == ["text"]
    with pytest.raises(ValueError, match="missing_page"):
        validation.require_pages(e, p)
    with pytest.raises(ValueError, match="duplicate_page"):
        validation.require_pages(e.where("question_id = 1"), p.unionAll(p))
    a = spark.createDataFrame([("P0", 1), ("P0", 2)], "architecture string, question_id long")
    j = a.selectExpr("*", "'correct' as label", "'r' as rationale", "cast(null as string) as judge_error")
    assert validation.assemble_quality(a, j, a.withColumn("f1", F.lit(1.0))).count() == 2
    with pytest.raises(ValueError, match="similarity_coverage P0|2: missing"):
        validation.assemble_quality(a, j, a.where("question_id = 1").withColumn("f1", F.lit(1.0)))
    with pytest.raises(ValueError, match="not_on_disk"):
        validation.corpus_manifest(spark.createDataFrame([("d",)], "doc_name string"), spark.createDataFrame([("d", None)], "doc_name string, download_status string"))


def test_a_manifest_with_wrong_page_counts_stops_extraction(spark):
    manifest = spark.createDataFrame([("d", "downloaded", 2, "Acme"), ("e", "downloaded", None, None)], "doc_name string, download_status string, pdf_pages long, company string")
    pages = spark.createDataFrame([("d", 0, "a", "ok"), ("d", 1, "", "empty"), ("e", 0, "b", "ok"), ("other", 0, "c", "ok")], "doc_name string, page int, text string, extraction_status string")
    need = manifest.select("doc_name")
    got = validation.extract_corpus(need, manifest, pages)
    assert sorted((r.doc_name, r.page, r.company) for r in got.collect()) == [("d", 0, "Acme"), ("d", 1, "Acme"), ("e", 0, None)]
    assert validation.extraction_summary(manifest, pages).first().asDict() == {"documents": 2, "pages": 3, "empty_text_pages": 1, "nonempty_text_pages": 2}
    with pytest.raises(ValueError, match="page_count d: 2/1"):
        validation.extract_corpus(need, manifest, pages.where("page = 0")).collect()
    with pytest.raises(ValueError, match="no_pages e"):
        validation.extract_corpus(need, manifest, pages.where("doc_name <> 'e'"))


def test_strict_values_raise(spark):
    d = spark.createDataFrame([(2, "3.5", " ")], "f int, t string, s string")
    for c, match in ((selection.flag(F.col("f")), "not a flag: 2"), (selection.temperature(F.col("t")), "not a temperature"), (selection.required_text(F.col("s")), "blank"), (selection.page_refs(F.array(F.struct(F.lit("").alias("doc_name"), F.lit(0).alias("page")))), "page reference")):
        with pytest.raises(Exception, match=match):
            d.select(c).collect()
    with pytest.raises(ValueError, match="not there: 7"):
        selection.split_by_ids(d, spark.createDataFrame([(7,)], "f int"), "f")
    with pytest.raises(Exception, match="does not apply to P0"):
        rollups.latency_summary(spark.createDataFrame([("P0", 1.0)], "architecture string, rerank double"), "architecture", ["rerank"], {"rerank": ["P3"]}).collect()
    with pytest.raises(ValueError, match="without gold"):
        retrieval_eval.checked_gold(spark.createDataFrame([(1,)], "question_id long"), spark.createDataFrame([], "question_id long, page_ref long"))
    with pytest.raises(ValueError, match="ranks 1"):
        retrieval_eval.checked_ranks(spark.createDataFrame([(1, 2, 5)], "question_id long, rank int, page_ref long"))


def test_compatibility_forms_match(spark):
    e = evidence.match_texts(spark.createDataFrame([(1, 0, "d", 1, "the ﬁnancial ﬁgure of １２")], "question_id long, item int, doc_name string, page int, text string"))
    c = evidence.match_texts(spark.createDataFrame([("c", "d", 1, "so The Financial figure of 12, again")], "chunk_id string, doc_name string, page int, text string"))
    assert [(r.method, r.matched) for r in evidence.map_evidence(e, c).collect()] == [("normalized_exact_containment", ["c"])]


def test_the_table_of_tests_is_put_together(spark):
    rng = np.random.default_rng(2)
    x = {("P0", "token_f1"): rng.random(30), ("P1", "token_f1"): rng.random(30) + 0.2, ("P0", "exact_match"): rng.integers(0, 2, 30), ("P1", "exact_match"): rng.integers(0, 2, 30)}
    rows = [(q, a, m, float(v)) for (a, m), vs in x.items() for q, v in enumerate(vs) if not (m == "token_f1" and a == "P0" and q < 4)]
    plan = spark.createDataFrame([("H0", "P0", "P1", "token_f1", "all"), ("H0", "P0", "P1", "exact_match", "all")], "hypothesis string, architecture_a string, architecture_b string, metric string, population string")
    long = spark.createDataFrame(rows, "question_id long, architecture string, metric string, value double")
    got = {r.metric: r for r in stats.evaluate(long, plan, "run", 30).collect()}
    d = x["P1", "token_f1"][4:] - x["P0", "token_f1"][4:]
    f1, em = got["token_f1"], got["exact_match"]
    assert (f1.pair_count, f1.excluded_pair_count, em.pair_count) == (26, 4, 30)
    assert f1.mean_difference_b_minus_a == pytest.approx(d.mean()) and f1.p_value_two_sided == pytest.approx(stats.signed_rank_p(d)) and f1.difference_ci95_low < d.mean() < f1.difference_ci95_high
    a, b = x["P0", "exact_match"], x["P1", "exact_match"]
    assert (em.a_only_success, em.b_only_success) == (((a == 1) & (b == 0)).sum(), ((a == 0) & (b == 1)).sum()) and f1.a_only_success is None and em.rank_biserial_b_minus_a is None
    p = sorted([f1.p_value_two_sided, em.p_value_two_sided])
    assert sorted([f1.holm_p_value, em.holm_p_value]) == pytest.approx([min(1, 2 * p[0]), max(min(1, 2 * p[0]), p[1])]) and f1.significant_holm == int(f1.holm_p_value < 0.05)
    with pytest.raises(ValueError, match="no complete pairs"):
        stats.evaluate(long, plan.withColumn("metric", F.lit("other")), "run", 30)
    planned = stats.planned_comparisons(spark)
    assert planned.count() == 21 and planned.where("hypothesis = 'H0,H1'").count() == 1 and planned.where("source = 'latency'").count() == 4


def tokenizers():
    """Words; and one whose pieces may have more tokens than they had inside: a text's first word is cut into letters."""

    def words(text):
        return [m.span() for m in re.finditer(r"\S+", text)]

    def first_in_letters(text):
        s = words(text)
        return [(k, k + 1) for k in range(*s[0])] + s[1:] if s else []

    return words, first_in_letters


def test_any_tokenizer_cuts_pages(spark):
    spans, wordy = tokenizers()
    rng = np.random.default_rng(5)
    pages = [("d", k, "".join(rng.choice(["a", "bb ", "\n", " ccc", "é "], rng.integers(0, 120)))) for k in range(12)] + [("e f", 0, None), ("e f", 1, " \n")]
    config = chunking.ChunkConfig(size=24, overlap=5)
    d = spark.createDataFrame(pages, "doc_name string, page int, text string")
    key = lambda df: sorted((r.doc_name, r.page, r.chunk_index, r.chunk_id, r.text, r.retrieval_text, r.token_start, r.token_end, r.char_start, r.char_end, r.content_capacity) for r in df.collect())
    assert key(chunking.chunk_pages_with(d, spans, config, F.lit("h "))) == key(chunking.require_unique(chunking.chunk_pages(d, config, F.lit("h "))))
    long = spark.createDataFrame([("d", 0, " ".join(f"word{k}" for k in range(60)))], "doc_name string, page int, text string")
    got = chunking.chunk_pages_with(long, wordy, config).orderBy("chunk_index").collect()
    assert all(len(wordy(r.text)) <= config.capacity for r in got) and [r.chunk_index for r in got] == list(range(len(got)))
    assert got[0].token_start == 0 and got[-1].token_end == len(wordy(long.first().text))
    assert all(b.token_start == max(a.token_start + 1, a.token_end - 5) for a, b in zip(got, got[1:], strict=False))
    with pytest.raises(ValueError, match="duplicate_chunk"):
        chunking.require_unique(spark.createDataFrame([("a",), ("a",)], "chunk_id string"))


def test_models_are_asked_again_with_what_was_wrong(spark):
    def model(prompt):
        if "silent" in prompt:
            raise TimeoutError("no answer")
        return "7" if "rejected: not a number" in prompt or "good" in prompt else "seven"

    d = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "silent")], "k long, prompt string")
    got = {r.k: r for r in models.call_each(d, "prompt", model, lambda x: None if x.isdigit() else "not a number", attempts=2, concurrency=2).collect()}
    assert [(got[k].response, got[k].parse_attempts, got[k].model_error) for k in (1, 2, 3)] == [("7", 1, None), ("7", 2, None), (None, 2, "TimeoutError: no answer")]
    assert got[3].latency_ms > 90 > got[1].latency_ms >= 0


def test_records_load_under_their_schemas(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question_id": "a", "question": "why?"}\n{"question_id": "b", "question": " "}\n')
    with pytest.raises(ValueError, match="question_record b: question"):
        io.load_questions(spark, str(tmp_path / "q.jsonl"))
    (tmp_path / "p.jsonl").write_text('{"doc_name": "d", "page": 0, "text": "t"}\n')
    assert io.load_pages(spark, str(tmp_path / "p.jsonl")).first().text == "t"
    (tmp_path / "a.jsonl").write_text('{"question_id": "a", "architecture": "P0"}\n' * 2)
    with pytest.raises(ValueError, match="duplicate_key P0|a: 2"):
        io.load_answers(spark, str(tmp_path / "a.jsonl"))
    (tmp_path / "m.csv").write_text("doc_name,company,doc_type,doc_period,source_url,local_path,download_status,resolved_url,download_source,http_status,file_size_bytes,sha256,pdf_pages,error\nd,,,,,,downloaded,,,,,,3,\n")
    assert io.load_manifest(spark, str(tmp_path / "m.csv")).first().pdf_pages == 3

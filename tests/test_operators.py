import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answers, checks, chunking, dense, evidence, fusion, models, pipelines, query_processing, rerank, retrieval_eval, rollups, sparse, stats, support


def test_bm25_ranks_all_documents(spark):
    docs = spark.createDataFrame([(0, "apple banana"), (1, "apple apple cherry"), (2, "durian"), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "apple apple"), (2, "nothing"), (3, "")], "item_id long, text string")
    got = sparse.search(sparse.build_index(docs), sparse.query_terms(items), 3).collect()
    by = {q: [(r.id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 3)}
    assert [i for i, _ in by[2]] == [0, 1, 2] and all(s == 0 for _, s in by[2]) and by[3] == []
    assert {i for i, _ in by[1][:2]} <= {0, 1, 2} and len(by[1]) == 3


def test_bm25_negative_idf_is_floored(spark):
    docs = spark.createDataFrame([(i, "common" + (" rare" if i == 0 else f" u{i}")) for i in range(6)], "doc_id long, text string")
    t = {r.term: r.idf for r in sparse.build_index(docs).terms.collect()}
    raw = {w: math.log(6 - n + 0.5) - math.log(n + 0.5) for w, n in {"common": 6, **{f"u{i}": 1 for i in range(1, 6)}, "rare": 1}.items()}
    assert t["common"] == pytest.approx(0.25 * np.mean(list(raw.values()))) and t["rare"] == pytest.approx(raw["rare"])


def test_bm25_filters_keep_corpus_statistics(spark):
    docs = spark.createDataFrame([(0, "apple"), (1, "apple pear"), (2, "fig"), (3, "plum"), (4, "plum fig")], "doc_id long, text string")
    index, q = sparse.build_index(docs), sparse.query_terms(spark.createDataFrame([(1, "apple")], "item_id long, text string"))
    free = {r.id: r.score for r in sparse.search(index, q, 5).collect()}
    kept = {r.id: r.score for r in sparse.search(index, q, 5, spark.createDataFrame([(1, "x")], "query_id long, tag string"), spark.createDataFrame([(0, "y"), (1, "x"), (2, "x"), (3, None), (4, "y")], "id long, tag string")).collect()}
    assert kept == {1: pytest.approx(free[1]), 2: 0.0}


def bm25(docs, queries):
    """{(query, document): score} by the formula, for documents and queries as lists of tokens."""
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for t in docs.values() for w in set(t))
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    return {(q, d): sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in words) for q, words in queries.items() for d, t in docs.items()}


@pytest.mark.parametrize("block, terms", [(256, 200_000), (3, 10)])
def test_search_in_blocks_and_slices_equals_brute_force(spark, monkeypatch, block, terms):
    """Blocks that bounds skip, queries in many slices, terms in every document, ties, repeated terms, string ids, queries of unknown terms."""
    monkeypatch.setattr(sparse, "BLOCK", block)
    monkeypatch.setattr(sparse, "SLICE_TERMS", terms)
    rng = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(60)])
    share = 1 / (1 + np.arange(60))
    docs = {f"d{i:03d}": ["all", *rng.choice(words, rng.integers(1, 30), p=share / share.sum())] for i in range(300)}
    docs |= {f"e{i:03d}": docs["d007"] for i in range(9)} | {"none": []}
    asked = {j: list(rng.choice(words, rng.integers(1, 6))) for j in range(25)} | {90: ["all"], 91: ["unknown"], 92: ["w3", "w3", "all"]}
    index = sparse.build_index(spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id string, text string").repartition(3))
    got = {}
    for r in sparse.search(index, sparse.query_terms(spark.createDataFrame([(i, " ".join(t)) for i, t in asked.items()], "item_id int, text string")), 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    scores = bm25(docs, asked)
    for q in asked:
        want = sorted((-round(scores[q, d], 9), d) for d in docs)[:7]
        assert [got[q][k + 1][0] for k in range(7)] == [d for _, d in want], q
        assert [got[q][k + 1][1] for k in range(7)] == pytest.approx([-x for x, _ in want], abs=1e-8)


def test_bound_holds_for_every_row_of_a_block(spark):
    rng = np.random.default_rng(2)
    term, query, weight = rng.integers(0, 9, 40), rng.integers(0, 5, 40), rng.normal(size=40)
    order = np.lexsort((query, term))
    q = sparse.Asked(list(range(5)), None, np.searchsorted(term[order], np.arange(10)), query[order], weight[order], [])
    hits, rows, value = np.sort(rng.integers(0, 9, 30)), rng.integers(0, 6, 30), rng.random(30)
    s = sparse._scores(q, hits, rows, value, np.arange(5), 6)
    known = {(t, r): v for t, r, v in zip(hits, rows, value, strict=True)}
    if len(known) == len(hits):
        assert (s <= sparse._bound(q, hits, value)[:, None] + 1e-12).all()
    some = sparse._scores(q, hits, rows, value, np.array([1, 4]), 6)
    assert np.array_equal(some, s[[1, 4]])


def test_filtered_search_equals_brute_force(spark):
    """Every combination of filters, asked for or not, in one batch; documents without a shared term fill up at 0, smallest ids first."""
    rng = np.random.default_rng(4)
    words = ["apple", "pear", "fig", "plum", "kiwi"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 5))), ["a", "b", None][i % 3], [2019, 2020][i % 2]) for i in range(40)]
    asked = [(100 + j, " ".join(rng.choice(words, 2)), c, y) for j, (c, y) in enumerate([(None, None), ("a", None), (None, 2020), ("b", 2019), ("none", None), ("a", 2020)])]
    d = spark.createDataFrame(docs, "doc_id long, text string, company string, fiscal_year int")
    q = spark.createDataFrame(asked, "item_id long, text string, company string, fiscal_year int")
    index = sparse.build_index(d)
    got = {}
    for r in sparse.search(index, sparse.query_terms(q), 12, q.select(F.col("item_id").alias("query_id"), "company", "fiscal_year"), d.select(F.col("doc_id").alias("id"), "company", "fiscal_year")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, round(r.score, 9))
    scores = bm25({i: t.split() for i, t, _, _ in docs}, {i: t.split() for i, t, _, _ in asked})
    for i, _, c, y in asked:
        seen = [k for k, _, a, b in docs if (c is None or a == c) and (y is None or b == y)]
        want = sorted(((-round(scores.get((i, k), 0.0), 9) + 0.0, k) for k in seen))[:12]
        assert got.get(i, {}) == {n + 1: (k, -x + 0.0) for n, (x, k) in enumerate(want)}


def test_filtered_dense_search_equals_brute_force(spark):
    x = np.random.default_rng(1).standard_normal((60, 5))
    tags = [("a", 1), ("b", 2), (None, 1)]
    d = spark.createDataFrame([(f"c{i:02d}", v.tolist(), *tags[i % 3]) for i, v in enumerate(x)], "id string, v array<double>, company string, year int").repartition(3)
    asks = [("q0", x[0], None, None), ("q1", x[1], "a", None), ("q2", x[2], None, 1), ("q3", x[3], "b", 1), ("q4", x[4], "b", 2)]
    got = {}
    for r in dense.exact_top_k(d, spark.createDataFrame([(i, v.tolist(), c, y) for i, v, c, y in asks], "query_id string, v array<double>, company string, year int"), 7, ["company", "year"]).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for i, v, c, y in asks:
        seen = [k for k in range(60) if (c is None or tags[k % 3][0] == c) and (y is None or tags[k % 3][1] == y)]
        want = sorted(seen, key=lambda k: (-round(float(x[k] @ v), 9), k))[:7]
        assert got.get(i, {}) == {n + 1: f"c{k:02d}" for n, k in enumerate(want)}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_dense_equals_brute_force_for_any_partitioning(spark, parts):
    x = np.random.default_rng(0).standard_normal((80, 6))
    x[50:60] = x[3]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(parts)
    got = dense.exact_top_k(d, d.where("id % 10 = 0").withColumnRenamed("id", "query_id"), 8).collect()
    for q in range(0, 80, 10):
        s = np.round(x @ x[q], 9)
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(80), -s))[:8].tolist()


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, id string, score double")


def test_fusion(spark):
    a = ranked(spark, [(1, 1, "x", 9.0), (1, 2, "y", 8.0), (1, 3, "z", 7.0)])
    b = ranked(spark, [(1, 1, "y", 0.5), (1, 2, "w", 0.4)])
    got = fusion.fuse({"dense": a, "bm25": b}).orderBy("rank").collect()
    assert [r.id for r in got] == ["y", "x", "w", "z"]
    assert got[0].rrf == pytest.approx(1 / 62 + 1 / 61) and got[0].component_ranks == {"dense": 2, "bm25": 1}
    top, info = fusion.hybrid(a, b, 2)
    assert [r.id for r in top.orderBy("rank").collect()] == ["y", "x"] and tuple(info.collect()[0]) == (1, 3, 2, 4, 1)
    with pytest.raises(Exception, match="twice"):
        fusion.fuse({"a": ranked(spark, [(1, 1, "x", 1.0), (1, 2, "x", 1.0)])}).collect()
    with pytest.raises(Exception, match="ranks start"):
        fusion.fuse({"a": ranked(spark, [(1, 0, "x", 1.0)])}).collect()
    with pytest.raises(ValueError):
        fusion.fuse({"a": a}, -1)


def test_chunks_equal_the_loop(spark):
    rng = random.Random(1)
    config = chunking.ChunkConfig(size=24, overlap=5, special=2, prefix=2)
    pages = [("d", p, " " * rng.randint(0, 2) + " \n".join(f"w{i}" for i in range(n)) + "  ") for p, n in enumerate([0, 1, 19, 20, 21, 35, 36, 200])]
    got = {}
    for r in chunking.chunk_pages(spark.createDataFrame(pages, "doc_name string, page int, text string"), config).collect():
        got.setdefault(r.page, []).append(r)
    for _, p, text in pages:
        words, start, want = text.split(), 0, []
        while start < len(words):
            end = min(start + 20, len(words))
            want.append((start, end))
            if end == len(words):
                break
            start = max(start + 1, end - 5)
        rows = sorted(got.get(p, []), key=lambda r: r.chunk_index)
        assert [(r.token_start, r.token_end) for r in rows] == want
        assert all(text[r.char_start : r.char_end] == r.text and r.text.split() == words[r.token_start : r.token_end] for r in rows)
    assert got[1][0].chunk_id == "d_p1_c000"
    with pytest.raises(ValueError):
        chunking.ChunkConfig(size=10, overlap=8)
    with pytest.raises(Exception, match="no room"):
        chunking.chunk_pages(spark.createDataFrame(pages, "doc_name string, page int, text string"), config, F.lit("h " * 16)).collect()


def test_processed_queries_and_their_chunks(spark):
    companies = spark.createDataFrame([("ACME CORP",), ("BETA",), ("BETAX",)], "company string")
    q = spark.createDataFrame([(1, "What did Acme-Corp earn in FY2020?"), (2, "BETAX revenue?"), (3, "Who?")], "question_id long, question string")
    got = {r.question_id: (r.company, r.fiscal_year) for r in query_processing.process_queries(q, companies).collect()}
    assert got == {1: ("acmecorp", 2020), 2: (None, None), 3: (None, None)}
    p = spark.createDataFrame([(1, "acmecorp", 2020), (2, "acmecorp", None), (3, None, 2020), (4, None, None), (5, "acmecorp", 1999)], "query_id long, company string, fiscal_year int")
    c = spark.createDataFrame([("a", "Acme Corp", None, "2020"), ("b", "ACME CORP", 2021, "2020"), ("c", "Beta", 2020, None)], "chunk_id string, company string, fiscal_year int, doc_period string")
    v = query_processing.chunk_filters(c.withColumn("v", F.array(F.lit(1.0))), keep=["v"])
    pairs = {(r.query_id, r.id) for r in dense.exact_top_k(v, p.withColumn("v", F.array(F.lit(1.0))), 5, ["company", "fiscal_year"]).collect()}
    assert pairs == {(1, "a"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "a"), (4, "b"), (4, "c")}


def test_evidence_methods(spark):
    e = spark.createDataFrame([(1, 0, "d", 1, "net sales were 12 in 2020"), (1, 1, "d", 1, "alpha beta gamma delta"), (1, 2, "d", 1, "nothing alike"), (2, 0, "d", 1, ""), (3, 0, "d", 9, "no page")], "question_id long, item int, doc_name string, page int, norm string")
    c = spark.createDataFrame([("c1", "d", 1, "the net sales were 12 in 2020 and more"), ("c2", "d", 1, "alpha beta gamma x"), ("c3", "d", 1, "alpha beta y"), ("c4", "d", 2, "alpha beta gamma delta")], "chunk_id string, doc_name string, page int, norm string")
    m = evidence.map_evidence(e, c)
    got = {(r.question_id, r.item): (r.method, r.matched) for r in m.collect()}
    assert got[1, 0] == ("normalized_exact_containment", ["c1"]) and got[1, 1] == ("token_containment", ["c2"])
    assert got[1, 2] == ("page_only_no_strict_chunk_match", []) and got[2, 0] == ("no_evidence_text", []) and got[3, 0][1] == []
    s = {r.question_id: r for r in evidence.summarise(m).collect()}
    assert s[1].gold_chunk_ids == ["c1", "c2"] and not s[1].mapping_complete and s[1].gold_doc == "d"


def test_retrieval_scores(spark):
    gold = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p9"), (3, "p1")], "question_id long, page_ref string")
    got = spark.createDataFrame([(1, 1, "x"), (1, 2, "p1"), (1, 3, "p1"), (1, 4, "p2"), (3, 1, "y"), (3, 2, "z"), (3, 3, "y"), (3, 4, "p1")], "question_id long, rank int, page_ref string")
    r = {x.question_id: x for x in retrieval_eval.score_questions(got, gold).collect()}
    assert (r[1].hit_at_1, r[1].hit_at_3, r[1].recall_at_5, r[1].mrr_at_5) == (0, 1, 1.0, 0.5) and r[1].retrieved_unique_page_count == 3
    assert (r[2].hit_at_5, r[2].recall_at_5, r[2].mrr_at_5, r[2].retrieved_chunk_count) == (0, 0.0, 0.0, 0)
    assert (r[3].hit_at_3, r[3].hit_at_5, r[3].mrr_at_5) == (0, 1, 0.25)


def test_numeric_scores(spark):
    rows = [("$1.5 billion", "$1,500 million"), ("none", "5"), ("5", "none"), ("none", "none"), ("5 and 5", "5")]
    d = spark.createDataFrame([(i, "", g, a) for i, (g, a) in enumerate(rows)], "i int, question string, gold_answer string, generated_answer string")
    r = [tuple(x) for x in answers.numeric_scores(d).orderBy("i").select("numeric_accuracy", "numeric_precision", "numeric_f1").collect()]
    assert r == [(1.0, 1.0, 1.0), (None, 0.0, 0.0), (0.0, 0.0, 0.0), (None, None, None), (0.5, 1.0, pytest.approx(2 / 3))]


def test_rerank_windows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    c = spark.createDataFrame([(1, "w3 w99", 1, "a", "head er\n", text), (1, "w3 w99", 2, "b", "", "w3 w99"), (1, "w3 w99", 3, "c", "", "zzz")], "question_id long, query string, rank int, chunk_id string, header string, text string")
    config = rerank.RerankConfig(max_length=45, overlap=10, special=3)
    w = rerank.candidate_windows(c, config).where("chunk_id = 'a'").orderBy("window").collect()
    body, start, want = 45 - 2 - 3 - 2, 0, []
    while True:
        want.append((start, min(100, start + body)))
        if want[-1][1] == 100:
            break
        start = want[-1][1] - 10
    assert [x.window_text for x in w] == ["head er\n" + " ".join(f"w{i}" for i in range(a, b)) for a, b in want]
    got = rerank.rerank(c, 3, config=config).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and got[1].best_window == 0 and got[1].truncated


def test_mcnemar_holm_and_signed_ranks(spark):
    pairs = [("m", float(x), float(y)) for x, y, n in ((1, 0, 2), (0, 1, 8), (1, 1, 5)) for _ in range(n)] + [("big", 1.0, 0.0)] * 900 + [("big", 0.0, 1.0)] * 1000 + [("same", 1.0, 1.0)]
    got = {r.k: r.p_value for r in stats.mcnemar(spark.createDataFrame(pairs, "k string, a double, b double"), ["k"]).collect()}
    assert got["m"] == pytest.approx(0.109375) and got["same"] == 1.0
    assert got["big"] == pytest.approx(min(1.0, 2 * sum(math.comb(1900, i) for i in range(901)) / 2**1900))
    p = spark.createDataFrame([("a", 0.04), ("b", 0.001), ("c", 0.03)], "name string, p double")
    assert {r.name: round(r.holm_p, 9) for r in stats.holm(p, "p", "name").collect()} == {"a": 0.06, "b": 0.003, "c": 0.06}
    assert stats.signed_rank_p(np.zeros(4)) == 1.0
    d = np.array([1.0, 2.0, 3.0, 4.0, 5.0, -6.0])
    sums = [sum(r for r, s in zip(range(1, 7), range(6), strict=True) if m >> s & 1) for m in range(64)]
    assert stats.signed_rank_p(d) == pytest.approx(min(1, 2 * np.mean([s <= 6 for s in sums])))
    t = np.array([1.0, 1.0, -1.0, 2.0])
    assert 0 < stats.signed_rank_p(t) <= 1 and stats.signed_rank_p(-t) == stats.signed_rank_p(t)


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    rows = [(i, "A", "B", "m", float(i % 7), float(i % 5)) for i in range(60)]
    d = spark.createDataFrame(rows, "question_id long, architecture_a string, architecture_b string, metric string, a double, b double")
    by = ["architecture_a", "architecture_b", "metric"]
    one, two = (stats.wilcoxon_and_bootstrap(d.repartition(n), by, "r").collect() for n in (1, 5))
    assert one == two
    lo, hi = stats.bootstrap_ci(np.array([b - a for *_, a, b in rows]), 5)
    assert lo < np.mean([b - a for *_, a, b in rows]) < hi


def test_pareto(spark):
    s = spark.createDataFrame([("A", 0.5, 10.0), ("B", 0.6, 10.0), ("C", 0.6, 12.0), ("D", 0.4, 5.0)], "architecture string, q_mean double, total_latency_mean_ms double")
    got = {r.architecture: (r.pareto_nondominated, r.dominated_by) for r in rollups.pareto(s, ["q"]).collect()}
    assert got == {"A": (0, "B"), "B": (1, ""), "C": (0, "B"), "D": (1, "")}


def test_bounds_and_single_value_deviation(spark):
    d = spark.createDataFrame([("x", "correct"), ("x", "judge_error"), ("y", None)], "g string, label string")
    assert {r.g: (r.correct_lower, r.correct_upper) for r in rollups.correctness_bounds(d, ["g"], "label").collect()} == {"x": (0.5, 1.0), "y": (None, None)}
    one = rollups.latency_summary(spark.createDataFrame([("a", 5.0, None)], "architecture string, total double, rerank double"), "architecture", ["total", "rerank"]).collect()
    assert len(one) == 1 and one[0].std == 0.0
    with pytest.raises(Exception, match="negative"):
        rollups.latency_summary(spark.createDataFrame([("a", -1.0)], "architecture string, total double"), "architecture", ["total"]).collect()


def test_guards(spark):
    units = [("U1", "Sales were $5 million."), ("U2", "It is good."), ("U3", "It rose 7%.")]
    passages = [("E1", "sales of $5 million"), ("E2", "up from 10 to 12")]
    a = [("U2", False, True, "direct", ["E1"], ""), ("U3", True, True, "arithmetic", ["E2"], "10 - 12 = 2"), ("U9", True, True, "direct", ["E1"], ""), ("U3", True, False, "direct", [], "")]
    d = spark.createDataFrame([(units, passages, a)], "units array<struct<unit_id:string,text:string>>, passages array<struct<evidence_id:string,text:string>>, assessments " + support.ASSESSMENTS)
    r = support.claim_scores(support.guard_claims(d)).collect()[0]
    assert [(c.unit_id, c.supported, c.guard_reason) for c in r.claims] == [("U1", False, "missing_unit_assessment"), ("U3", True, "")]
    assert r.nonfactual_unit_ids == ["U2"] and r.unknown_or_duplicate_unit_ids == ["U9", "U3"] and (r.claim_count, r.score) == (2, 0.5)


def test_answer_judgments(spark):
    rows = [
        (["U1", "U2"], [("U1", "answered"), ("U2", "answered")], True, False, "correct"), (["U1", "U2"], [("U1", "answered"), ("U2", "missing")], True, False, "partially_correct"), (["U1"], [("U1", "missing")], False, False, "failure_to_answer"),
        (["U1"], [("U1", "answered")], True, True, "incorrect"), (["U1"], [("U1", "answered")], True, False, "incorrect"), (["U1"], [("U2", "answered")], True, False, "correct"), (["U1"], [("U1", "answered")], False, False, "correct"),
    ]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, units array<string>, statuses array<struct<unit_id:string,status:string>>, attempted boolean, contradiction boolean, label string")
    r = support.judge_answers(d).orderBy("i").collect()
    assert [x.error for x in r] == [None, None, None, None, "label_conflict", "unit_ids", "substantive_unit_not_attempted"]
    assert [x.completeness for x in r[:4]] == [1.0, 0.5, 0.0, 1.0] and r[0].semantic_correctness == 1


def test_checks(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "k int, v string")
    assert [r.key for r in checks.duplicate_keys(d, ["k"]).collect()] == ["1"]
    assert [(r.key, r.detail) for r in checks.functional_dependency(d, "k", ["v"]).collect()] == [("1", "v")]
    assert {(r.key, r.detail) for r in checks.coverage(d, spark.createDataFrame([(1,), (4,)], "k int"), ["k"]).collect()} == {("4", "missing"), ("2", "unexpected"), ("3", "unexpected")}
    assert [r.key for r in checks.ranks_valid(spark.createDataFrame([("q", 1), ("q", 3), ("p", 1), ("p", 2)], "q string, rank int"), "q").collect()] == ["q"]
    with pytest.raises(ValueError, match="duplicate_key 1"):
        checks.enforce(checks.duplicate_keys(d, ["k"]))
    with pytest.raises(ValueError, match="missing columns: z"):
        checks.require_columns(d, ["k", "z"])


def test_whole_pipelines(spark):
    pages = spark.createDataFrame([("acme_2020_10K", 0, "Acme sold many anvils in the year."), ("acme_2020_10K", 1, "The balance sheet shows cash of $5 million."), ("beta", 0, "Beta makes rope.")], "doc_name string, page int, text string")
    corpus = pipelines.build_corpus(chunking.chunk_pages(pages))
    q = spark.createDataFrame([("1", "How much cash?", "cash on the balance sheet", "$5 million")], "question_id string, question string, retrieval_query string, gold_answer string")
    for arch in ("P1", "P2", "P3"):
        a = pipelines.answer(arch, corpus, q).collect()[0]
        assert a.retrieved_chunks[0].chunk_id == "acme_2020_10K_p1_c000" and a.generated_answer.startswith("The balance sheet"), arch
    assert pipelines.answer("P0", corpus, q).collect()[0].generated_answer.startswith("Insufficient")
    with pytest.raises(ValueError):
        pipelines.Settings(final=6)


def test_generation_retries_and_reports(spark):
    def broken(prompts):
        raise RuntimeError("down")

    r = models.generate(spark.createDataFrame([("p",)], "prompt string"), "prompt", broken, 2).collect()[0]
    assert r.generated_answer is None and r.generation_error == "RuntimeError: down"
    s = spark.createDataFrame([("a b c", "a b c"), ("", "x")], "c string, r string").select(models.soft_match(F.col("c"), F.col("r")).alias("s")).collect()
    assert s[0].s.f1 == pytest.approx(1.0) and s[1].s.f1 == 0.0


def test_soft_match_scores_whole_texts(spark):
    same, other = " ".join(["cash", "debt"] * 350), " ".join(["tax"] * 700)
    d = spark.createDataFrame([(1, f"{same} {other}", same), (2, same, f"{same} {other}")], "i int, c string, r string").orderBy("i")
    got = [r.s for r in d.select("i", models.soft_match(F.col("c"), F.col("r")).alias("s")).collect()]
    x, y = (models.hashing_encoder()(t.split()) for t in (same, f"{same} {other}"))
    best = float((y @ x.T).max(axis=1).mean())
    assert best < 0.99 and got[0].precision == pytest.approx(best) == got[1].recall and got[0].recall == pytest.approx(1.0)
    assert [(g.candidate_tokens, g.reference_tokens, g.truncated) for g in got] == [(1400, 700, 0), (700, 1400, 0)]
    cut = d.select("i", models.soft_match(F.col("c"), F.col("r"), limit=512).alias("s")).collect()
    assert all(r.s.truncated == 1 and r.s.f1 == pytest.approx(1.0) for r in cut)


def test_rubrics_and_exact_abstentions(spark):
    good = '{"essential_units": [{"unit_id": "U1", "requirement": " cash "}, {"unit_id": "U2", "requirement": "debt"}], "rationale": "r"}'
    bad = [good.replace("U2", "U3"), good.replace("debt", "CASH"), good.replace('"r"', '" "'), "{}", "no json"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate([good, *bad])], "i int, x string").orderBy("i").select(support.parse_rubric(F.col("x"))).collect()]
    assert got == [["cash", "debt"], *[None] * 5]
    judged, exact = support.split_exact_abstentions(spark.createDataFrame([("I do not know.",), ("5",), (None,)], "generated_answer string"))
    assert judged.count() == 2 and exact.collect()[0].correctness_label == "failure_to_answer"
    assert stats.planned_comparisons(spark).count() == 21


def test_claims_are_made_once(spark):
    d = spark.createDataFrame([(1, "It cost $5 million. It is blue.", "Cost: $6 million"), (2, "", "x")], "i int, a string, p string")
    d = d.select("i", T.answer_units(F.col("a")).alias("units"), F.array(F.struct(F.lit("E1").alias("evidence_id"), F.col("p").alias("text"))).alias("passages"))
    judged = F.transform("units", lambda u: F.struct(u["unit_id"].alias("unit_id"), F.lit(True).alias("factual"), F.lit(True).alias("supported"), F.lit("direct").alias("support_type"), F.array(F.lit("E1")).alias("evidence_ids"), F.lit("").alias("derivation")))
    rows = support.claim_rows(support.guard_claims(d.withColumn("assessments", judged)), ["i"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T.SENTENCE_END) == 1 and plan.count("financial_number_absent_from_passage") == 1
    assert [(r.i, r.unit_id, r.supported, r.guard_reason) for r in rows.collect()] == [(1, "U1", False, "financial_number_absent_from_passage"), (1, "U2", True, "")]


def test_ordinals_deal_rows_once(spark):
    d = spark.range(0, 20000, 1, 8).select(F.concat(F.lit("d"), F.col("id") % 37).alias("doc_name"), (F.hash("id") % 100000).alias("page"), F.lit(0).alias("chunk_index"), F.repeat(F.lit("x"), 200).alias("text"))
    out = chunking.with_ordinal(d)
    assert "RepartitionByExpression" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.select("doc_name", "page", "ordinal").collect()
    assert sorted(r.ordinal for r in rows) == list(range(20000))
    assert [(r.doc_name, r.page) for r in sorted(rows, key=lambda r: r.ordinal)] == sorted((r.doc_name, r.page) for r in rows)


def test_pareto_keeps_architectures_without_a_value(spark):
    s = spark.createDataFrame([("A", None, 10.0), ("B", 0.6, 10.0), ("C", 0.5, 12.0)], "architecture string, q_mean double, total_latency_mean_ms double")
    got = {r.architecture: (r.quality_mean, r.pareto_nondominated, r.dominated_by) for r in rollups.pareto(s, ["q"]).collect()}
    assert got == {"A": (None, 1, ""), "B": (0.6, 1, ""), "C": (0.5, 0, "B")}

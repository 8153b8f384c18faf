"""Operators whose groups may be of any size, against direct computations."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, dense, evidence, merkle, models, pipelines, query_processing, ranks, report, rollups, stats, validation
from lodestone.operators.query_processing import Mentions, collapsed, process_queries


def test_ranked_values_and_quantiles_of_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][i % 3], float(rng.integers(0, 40)) if i % 5 else None, float(rng.normal())) for i in range(900)] + [("one", 7.5, None)]
    d = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    q = {(r.g, r.column): r.q for r in ranks.quantiles(d, ["g"], ["x", "y"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for g in ("a", "b", None, "one"):
        for k, c in ((1, "x"), (2, "y")):
            values = [r[k] for r in rows if r[0] == g and r[k] is not None]
            assert ((g, c) in q) == bool(values)
            if values:
                assert q[g, c] == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.9, 1]))
    for r in ranks.ranked_values(d.where("x is not null"), ["g"], "x").collect():
        values = [v for g, v, _ in rows if g == r.g and v is not None]
        assert (r.n, r.before, r.total) == (values.count(r.x), sum(v < r.x for v in values), len(values))
    assert ranks.quantiles(d.where("false"), ["g"], ["x"], [0.5]).collect() == []
    assert rollups.describe(d.where("false"), "x").first().p50 is None and rollups.describe(d.where("g = 'one'"), "x").first().p25 == 7.5


def test_signed_ranks_over_ranges_equal_the_direct_ones(spark):
    rng = np.random.default_rng(3)
    cases = {"tied": rng.integers(-6, 9, 400).astype(float), "plain": rng.normal(0.1, 1, 300), "small": np.array([1.5, -2.0, 3.0, 4.0, 5.5]), "few ties": np.array([1.0, 1.0, -1.0, 2.0, 0.0]), "zero": np.zeros(4), "half": rng.integers(-2, 3, 30).astype(float)}
    rows = [(c, i, 0.0, float(x)) for c, d in cases.items() for i, x in enumerate(d)]
    pairs = spark.createDataFrame(rows, "k string, question_id long, a double, b double").repartition(5)
    got = stats.signed_ranks(pairs, ["k"])
    p = {r.k: r.wilcoxon_p for r in stats.wilcoxon(got, ["k"]).collect()}
    sums = {r.k: r for r in got.collect()}
    for c, d in cases.items():
        d = d[d != 0]
        if not len(d):
            assert c not in p
            continue
        size = np.abs(d)
        rank = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
        assert (sums[c].n, sums[c].w_plus, sums[c].w_minus) == (len(d), rank[d > 0].sum(), rank[d < 0].sum())
        assert p[c] == pytest.approx(stats.signed_rank_p(d), rel=1e-12)
    effect = {r.k: r.effect for r in stats.rank_biserial(pairs, ["k"]).collect()}
    assert effect["zero"] == 0.0 and effect["small"] == pytest.approx((15 - 2 * 2) / 15)
    assert {r.k: r.wilcoxon_p for r in stats.wilcoxon_and_bootstrap(pairs.withColumn("question_id", F.col("question_id")), ["k"], "r").collect()}["zero"] == 1.0


def test_exact_mcnemar_of_large_counts(spark):
    counts = [(0, 0), (0, 1), (0, 60), (3, 9), (15, 16), (16, 400), (900, 1000), (49_000, 51_000), (10_000_000, 10_000_000), (9_995_000, 10_005_000), (9_990_000, 10_010_000)]
    d = spark.createDataFrame([(k, n) for k, n in counts], "k long, n long")
    got = {(r.k, r.n): r.p for r in d.where("n > 0").withColumn("p", stats.binomial_half(F.least("k", "n"), F.col("k") + F.col("n"))).collect()}
    for k, m in counts[1:]:
        n = k + m
        if n < 200_000:
            want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1)) if n > 3000 else sum(math.comb(n, i) for i in range(k + 1)) / 2**n
            assert got[k, m] == pytest.approx(want, rel=1e-8 if n > 3000 else 1e-12)
        else:  # the normal form with its first correction
            z = (k + 0.5 - n / 2) / math.sqrt(n / 4)
            assert got[k, m] == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-5)


def splitmix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def test_mergeable_resamples_are_those_of_the_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "A", "B", "m", 0.0, float(rng.normal())) for i in range(700)]
    pairs = spark.createDataFrame(rows, "question_id long, architecture_a string, architecture_b string, metric string, a double, b double").repartition(6)
    by = ["architecture_a", "architecture_b", "metric"]
    means = {r.replicate: r.mean for r in stats.resampled_means(pairs, by, "run", replicates=9).collect()}
    upto = np.floor(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)]) * 65536)
    for rep in range(9):
        total = n = 0
        for i, *_, b in rows:
            h = int.from_bytes(hashlib.sha256(f"run:A:B:m:{i}".encode()).digest()[:8], "big")
            u = (splitmix((h + (rep // 4 + 1) * 0x9E3779B97F4A7C15) % 2**64) >> 16 * (rep % 4)) & 65535
            times = int((u >= upto).sum())
            total, n = total + times * b, n + times
        assert means[rep] == pytest.approx(total / n, rel=1e-12)
    counts = stats.resample_counts(np.arange(40, dtype=np.uint64) * np.uint64(77777), 4000)
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02
    exact = stats.bootstrap(pairs, by, "run").first()
    merged = stats.bootstrap(pairs, by, "run", most=10).first()
    width = exact.ci_high - exact.ci_low
    assert abs(exact.ci_low - merged.ci_low) < 0.05 * width and abs(exact.ci_high - merged.ci_high) < 0.05 * width


def test_resamples_do_not_depend_on_the_size_of_blocks(monkeypatch):
    d = np.random.default_rng(1).normal(size=37)
    want = stats.bootstrap_ci(d, 11, 500)
    monkeypatch.setattr(stats, "BLOCK_BYTES", 37 * 8 * 13)
    assert stats.bootstrap_ci(d, 11, 500) == want


def by_the_predicate(names, question):
    """Every name against the question, by the pattern of its words and by its collapsed key."""
    out = set()
    for name in names:
        words, key = re.findall("[A-Za-z0-9]+", name), collapsed(name)
        pattern = r"(?<![A-Za-z0-9])" + r"[\W_]*".join(words) + r"(?![A-Za-z0-9])"
        if (words and re.search(pattern, question, re.IGNORECASE)) or (len(key) >= 3 and key in collapsed(question)):
            out.add(key)
    return out


def test_mentions_equal_the_predicate(spark, monkeypatch):
    names = ["3M", "GE", "G E", "AT&T", "Amcor plc", "Amcor", "U.S. Steel", "Steel", "A", "Ünited Co", "Best_Buy", "Kroger", "7-Eleven", "---", "Foot Locker", "k s"]
    parts = ["3m", "3 M", "GE", "g-e", "gem", "at & t", "AT&T's", "AMCOR", "amcorplc", "us steel", "U.S.  Steel", "a", "united co", "ünited_co", "best buy", "bestbuy,", "Kroger", "7 eleven", "footlocker", "xGE", "GEx", "éGEé", "k_ſ", "and", "?"]
    rng = random.Random(6)
    asked = [" ".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(400)] + ["", "?"]
    found = Mentions.of(names)
    for q in asked:
        want = by_the_predicate(names, q)
        got = found.keys(q)
        assert (set(got) == want) if len(want) < 2 else (len(got) == 2 and set(got) <= want), (q, got, want)
    d = spark.createDataFrame([(i, f"What of {q} in FY2020?") for i, q in enumerate(asked)], "question_id long, question string")
    c = spark.createDataFrame([(n,) for n in names] + [(None,), ("",)], "company string")
    one = {r.question_id: r.company for r in process_queries(d, c).collect()}
    monkeypatch.setattr(query_processing, "SLICE_BYTES", 20)
    many = {r.question_id: r.company for r in process_queries(d, c).collect()}
    for i, q in enumerate(asked):
        want = by_the_predicate(names, f"What of {q} in FY2020?")
        assert one[i] == many[i] == (next(iter(want)) if len(want) == 1 else None), q
    assert process_queries(d, c.where("false")).where("company is not null").isEmpty()


def test_mention_predicate_of_columns_is_the_same(spark):
    names, asked = ["3M", "GE", "AT&T", "Amcor", "Best_Buy"], ["3m up", "the ge's", "att", "best-buy x", "gem", "amcorp"]
    d = spark.createDataFrame([(q, n) for q in asked for n in names], "q string, n string")
    for r in d.select("q", "n", T.mentions_company(F.col("q"), F.col("n")).alias("m")).collect():
        assert r.m == (collapsed(r.n) in by_the_predicate([r.n], r.q))


def test_trees_name_what_changed(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FAN", 4)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(90)] + [(1000, None), (1001, "")], "id long, text string").repartition(5)
    made = merkle.tree(merkle.places(docs.select("id", merkle.row_digest("id", "text").alias("digest")), ["id"]))
    assert made.agg(F.max("level")).first()[0] == 3 and made.where("level = 0").count() == 23 and merkle.roots(made).first().rows == 92

    def roll(x):
        return [hashlib.sha256("".join(x[i : i + 4]).encode()).hexdigest() for i in range(0, len(x), 4)]

    level = [hashlib.sha256((f"{len(str(i))}:{i}" + ("-" if t is None else f"{len(t)}:{t}")).encode()).hexdigest() for i, t in sorted(map(tuple, docs.collect()))]
    while len(level) > 1:
        level = roll(level)
    assert merkle.roots(made).first().digest == level[0]
    other = docs.withColumn("text", F.when(F.col("id") == 17, "new").otherwise(F.col("text"))).where("id <> 1001")
    now = merkle.tree(merkle.places(other.select("id", merkle.row_digest("id", "text").alias("digest")), ["id"]))
    assert sorted((r.node, r.first_place, r.last_place, r.status) for r in merkle.changes(made, now).collect()) == [(4, 16, 19, "changed"), (22, 88, 91, "changed")]
    assert merkle.changes(made, made).collect() == []
    assert merkle.roots(merkle.tree(docs.where("false").selectExpr("id as place", "text as digest"))).first() is None


@pytest.mark.parametrize("slices", [1 << 20, 200])
def test_evidence_equals_the_comparison_of_all_pairs(spark, monkeypatch, slices):
    monkeypatch.setattr(evidence, "SLICE_BYTES", slices)
    rng = random.Random(2)
    words = ["a", "ab", "b", "12", "1.5%", "sales", "net", "cash", "of", "x1", "year", "bab"]
    text = lambda n: " ".join(rng.choices(words, k=rng.randint(0, n)))
    chunks = [(f"c{i:02d}", rng.choice("de"), rng.randint(0, 2), text(25)) for i in range(60)] + [("none", None, 1, "a b"), ("z", "d", None, "a b")]
    items = [(q, k, rng.choice("de"), rng.randint(0, 3), text(12)) for q in range(30) for k in range(2)]
    items += [(100 + i, 0, c[1], c[2], c[3][3:-2].strip()) for i, c in enumerate(chunks[:30])] + [(200, 0, None, 1, "a b"), (201, 0, "d", None, "a"), (202, 0, "q", 1, "a")]
    e = spark.createDataFrame(items, "question_id long, item int, doc_name string, page int, norm string")
    c = spark.createDataFrame(chunks, "chunk_id string, doc_name string, page int, norm string").repartition(3)
    got = {(r.question_id, r.item): r for r in evidence.map_evidence(e, c).collect()}
    assert len(got) == len(items)
    for q, k, doc, page, norm in items:
        mine = [(i, t) for i, d, p, t in chunks if d is not None and p is not None and (d, p) == (doc, page)]
        w = norm.split()

        def share(t):
            return sum(min(w.count(x), t.split().count(x)) for x in set(w)) / len(w) if w and t else 0.0

        exact = sorted(i for i, t in mine if norm and t and (norm in t or (len(t.split()) >= 8 and t in norm)))
        best = max((share(t) for _, t in mine), default=0.0)
        strong = sorted(i for i, t in mine if share(t) >= 0.35 and share(t) >= 0.8 * best)
        want = [] if not norm else exact or strong
        method = "no_evidence_text" if not norm else "normalized_exact_containment" if exact else "token_containment" if strong else "page_only_no_strict_chunk_match"
        r = got[q, k]
        assert (r.method, r.matched, r.candidates) == (method, want, len(mine)) and r.best_score == pytest.approx(best), (q, norm)


def test_rules_of_support_and_selection(spark):
    rows = [("P0", 1, 0, None, None, None, None), ("P0", 2, 0, 1, 1, 1.0, 0.0), ("P1", 3, 1, None, None, None, None), ("P1", 4, 1, 2, 1, 0.5, 0.5), ("P1", 5, 0, 0, 0, None, None), ("P1", 6, 0, 0, 0, 0.0, 1.0),
            ("P1", 7, 0, 3, 1, 1 / 3, 1 - 1 / 3), ("P1", 8, 0, 3, 1, 0.3333, 0.6667), ("P1", 9, 0, 2, 3, 1.5, -0.5), ("P1", 10, 0, None, None, None, None), ("P1", 11, 0, 4, 1, 0.25, None)]
    d = spark.createDataFrame(rows, "architecture string, id int, abstained int, gold_claim_count int, gold_supported_count int, s double, h double")
    got = {int(r.key): r.detail for r in validation.support_rules(d, "gold", "s", "h", F.col("id"), ["P0"]).collect()}
    assert got == {2: "not_applicable", 4: "unit_counts", 6: "scores_without_units", 8: "support_disagrees", 9: "unit_counts", 10: "unit_counts", 11: "support_disagrees"}
    stage = spark.createDataFrame([("q", "union", r, c, "d") for r, c in enumerate("abcdef", 1)] + [("q", "final", 1, "b", "d"), ("q", "final", 2, "e", "d"), ("q", "final", 3, "c", "x"), ("q", "final", 4, "z", "d"), ("q", "final", 5, "d", "d")], "q string, stage string, rank int, id string, doc string")
    assert {(r.key, r.detail) for r in validation.stage_identity(stage, ["q"], "id", "final", "union", ["doc"]).collect()} == {("q|c", "doc,order"), ("q|z", "absent"), ("q|d", "order")}
    assert {(r.key, r.detail) for r in validation.saved_selection(stage, ["q"], ["id"], "union", "final", 5).collect()} == {("q|1", "id"), ("q|2", "id"), ("q|4", "id"), ("q|5", "id")}
    assert {r.detail for r in validation.saved_selection(stage.where("not (stage = 'final' and rank = 5)"), ["q"], ["id"], "union", "final", 5).collect()} == {"id", "not_in_final"}


@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_blocks_give_what_all_rows_give_and_are_passed_over(spark, spread):
    rng = np.random.default_rng(4)
    x = 5 * rng.standard_normal((12, 8))[rng.integers(12, size=3000)] + spread * rng.standard_normal((3000, 8))
    x[500:520] = x[499]  # ties
    rows = [(f"r{i:04d}", v.tolist(), ["a", "b", None][i % 3]) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "id string, v array<double>, tag string").repartition(4)
    asks = spark.createDataFrame([(f"q{i}", x[i * 37].tolist(), [None, "a", "zz"][i % 3]) for i in range(40)], "query_id string, v array<double>, tag string")
    index = dense.block_index(v, ["tag"])
    for on in ([], ["tag"]):
        got, want = (sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in f.collect()) for f in (dense.search_blocks(index, asks, 7, on), dense.exact_top_k(v, asks, 7, on)))
        assert got == want and len(got) > 150
    blocks = index.collect()
    search = dense.BlockSearch(list(range(40)), np.array([x[i * 37] for i in range(40)]), [], 7)
    bound = search.bounds(np.array([b.middle for b in blocks]), np.array([b.radius for b in blocks]))
    for i in np.argsort(-bound.max(axis=0)):
        search.add(bound[:, i], blocks[i].ids, np.frombuffer(blocks[i].v).reshape(-1, 8), [])
    assert search.read + search.passed == 40 * len(blocks)
    assert spread > 1 or search.read < 0.5 * 40 * len(blocks)
    assert dense.block_index(v.where("false")).collect() == [] and dense.search_blocks(index, asks.where("false"), 3).collect() == []
    with pytest.raises(Exception, match="components"):
        dense.block_index(v.select("id", F.when(F.col("id") == "r0007", F.array(F.lit(1.0))).otherwise(F.col("v")).alias("v")), dim=8).collect()


def test_records_carry_what_they_were_made_with(spark):
    pages = spark.createDataFrame([("acme_2020_10K", 0, "Acme sold many anvils in the year."), ("acme_2020_10K", 1, "The balance sheet shows cash of $5 million."), ("beta", 0, "Beta makes rope.")], "doc_name string, page int, text string")
    corpus = pipelines.build_corpus(chunking.chunk_pages(pages))
    q = spark.createDataFrame([("1", "How much cash?", "cash on the balance sheet", "$5 million"), ("2", "Rope?", "rope", "Beta")], "question_id string, question string, retrieval_query string, gold_answer string")
    made = {a: pipelines.answer(a, corpus, q, model={"model": "m", "temperature": 0.0}, experiment={"run": "r1"}).collect() for a in ("P0", "P1", "P2", "P3")}
    for a, rows in made.items():
        for r in rows:
            parts = [x for x in (r.retrieval_latency_ms, r.reranking_latency_ms, r.generation_latency_ms) if x is not None]
            assert r.total_latency_ms == pytest.approx(sum(parts)) and len(parts) == {"P0": 1, "P3": 3}.get(a, 2)
            assert r.input_tokens == len(r.prompt.split()) and r.output_tokens == len(r.generated_answer.split()) and r.total_tokens == r.input_tokens + r.output_tokens
            assert r.generation_parameters == {"model": "m", "temperature": "0.0"} and r.experiment_parameters == pipelines.metadata(a) | {"run": "r1"}
            assert a == "P0" or set(r.retrieved_chunks[0].asDict()) >= {"rank", "chunk_id", "doc_name", "page", "text", "score"}
    assert pipelines.metadata("P0") == {"architecture": "P0", "final_context_k": "0"} and pipelines.metadata("P3")["reranker_candidate_k"] == "20" and "sparse_candidate_k" not in pipelines.metadata("P1")
    both = spark.createDataFrame([("P1", {"final_context_k": "5"}), ("P1", {"final_context_k": "6"})], "architecture string, experiment_parameters map<string,string>")
    with pytest.raises(Exception, match="different parameters"):
        report.configuration(both).collect()


def test_the_expression_scores_as_the_function_does(spark):
    pairs = [("Cash flow of 2020", "the cash_flow OF 2020, cash"), ("", "x"), ("a", ""), (None, "a"), ("é É", "É"), ("a a b", "b")]
    d = spark.createDataFrame(pairs, "q string, t string").select(models.cross_score(F.col("q"), F.col("t")).alias("s"))
    assert [r.s for r in d.collect()] == pytest.approx(models.overlap_scorer(pairs))
    with pytest.raises(Exception, match="over the model's 2"):
        spark.createDataFrame([("a b c", "a")], "c string, r string").select(models.soft_match(F.col("c"), F.col("r"), refuse=2)).collect()
    one, two = spark.range(1).select(F.lit("x").alias("a")).select(*[models.score_fingerprint(["a"], "m", h).alias(h) for h in ("h1", "h2")]).first()
    assert one != two and len(one) == 64


def test_dense_scores_are_held_in_blocks():
    import tracemalloc

    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((20000, 16)), rng.standard_normal((4000, 16))
    rows = [pa.RecordBatch.from_arrays([pa.array(range(at, at + 10000)), pa.array(list(v[at : at + 10000]))], names=["id", "v"]) for at in (0, 10000)]
    sent = type("Sent", (), {"value": {(): (list(range(4000)), q)}})
    tracemalloc.start()
    got: dict[int, list] = {}
    for b in dense._best_of_batch(sent, 3, pa.int64(), 0)(iter(rows)):
        for x, y, z in zip(*[c.to_numpy() for c in b.columns], strict=True):
            if x < 50:
                got.setdefault(int(x), []).append((-z, int(y)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # all scores of a batch take 320 MB
    best = np.argsort(-(q[:50] @ v.T), axis=1)[:, :3]
    assert [[y for _, y in sorted(got[x])[:3]] for x in range(50)] == best.tolist()


def test_evidence_reads_chunks_of_its_own_pages(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(n))
    chunks = [(i, "d", 0 if i % 3 else i % 11, text(20)) for i in range(300)]  # page 0 is the largest by far
    items = [(i, 0, "d", c[2], c[3][4:40]) for i, c in enumerate(chunks)] + [(900, 0, None, 1, "a1"), (901, 0, "d", 1, "")]
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    schema = "chunk_id int, doc_name string, page int, norm string"
    c, e = spark.createDataFrame(chunks, schema), spark.createDataFrame(items, "question_id int, item int, doc_name string, page int, norm string")
    answer = lambda: sorted((tuple(r) for r in evidence.map_evidence(e, c.mapInArrow(counted, schema)).collect()), key=lambda r: r[0])
    whole = answer()
    made.value = 0
    monkeypatch.setattr(evidence, "SLICE_BYTES", 1000)
    assert answer() == whole
    assert made.value <= 2 * len(chunks)  # once for their normal forms, once for how many a page has

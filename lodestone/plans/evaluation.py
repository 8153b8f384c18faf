"""Queries over answers, numbers, support, roll-ups, statistics and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..functions import text as T
from ..operators import answers, checks, merkle, models, rerank, rollups, selection, stats, support
from .common import query, table
from .retrieval import BM25, _bm25

_QA = """qa AS (SELECT u.conv_id, u.turn, u.text AS gold, a.text AS generated FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""
_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"
_F1 = f"""{_QA}, tk AS (SELECT conv_id, turn, {_TOK.format(x='gold')} AS g, {_TOK.format(x='generated')} AS a FROM qa),
ov AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS o FROM (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS t FROM tk) GROUP BY ALL) x JOIN (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS t FROM tk) GROUP BY ALL) y USING (conv_id, turn, t) GROUP BY ALL),
f1 AS (SELECT conv_id, turn, CAST(g = a AS INT) AS exact_match, CASE WHEN len(g) + len(a) = 0 THEN 1.0::DOUBLE ELSE round(2.0::DOUBLE * coalesce(o, 0) / (len(g) + len(a)), 9) END AS token_f1 FROM tk LEFT JOIN ov USING (conv_id, turn))"""


def _qa(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("gold_answer"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated_answer"))
    return u.join(a, ["conv_id", "turn"])


def _f1(spark, sf_dir):
    g, a = F.col("gold_answer"), F.col("generated_answer")
    return _qa(spark, sf_dir).select("conv_id", "turn", answers.exact_match(g, a).alias("exact_match"), F.round(answers.token_f1(g, a), 9).alias("token_f1"))


@query(f"WITH {_F1} SELECT * FROM f1")
def answer_token_f1(spark, sf_dir):
    return _f1(spark, sf_dir)


_MONEY = """m AS (SELECT o_orderkey, o_custkey % 4 AS part, CAST(o_orderkey % 7 AS BIGINT) AS g, CAST(o_orderkey % 5 AS BIGINT) AS h FROM orders)"""
_MONEY_SCORES = f"""{_MONEY}, n AS (SELECT *, CASE WHEN g = 0 THEN 0 ELSE 1 END AS gn, CASE WHEN h = 0 THEN 0 ELSE 1 END AS an, CASE WHEN g > 0 AND g = h THEN 1 ELSE 0 END AS mn FROM m),
s AS (SELECT o_orderkey, part, CAST(gn AS INT) AS gold_numeric_count, CAST(an AS INT) AS generated_numeric_count, CAST(mn AS INT) AS matched_numeric_count,
 CASE WHEN gn > 0 THEN mn / gn END AS numeric_accuracy, CASE WHEN an > 0 THEN mn / an WHEN gn > 0 THEN 0.0 END AS numeric_precision, CASE WHEN gn > 0 THEN mn / gn END AS numeric_recall, CASE WHEN gn + an > 0 THEN 2 * mn / (gn + an) END AS numeric_f1 FROM n)"""


def _money(spark, sf_dir):
    """Gold and generated answers with at most one amount; 0 stands for none."""
    say = lambda k, form: F.when(k == 0, F.lit("no amount is given")).otherwise(F.format_string(form, k))
    g, h = F.pmod("o_orderkey", F.lit(7)), F.pmod("o_orderkey", F.lit(5))
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(4)).alias("part"), F.lit("").alias("question"), say(g, "It was $%d million in 2021.").alias("gold_answer"), say(h, "About $%d,000,000 in all.").alias("generated_answer"))
    return answers.numeric_scores(d)


@query(f"WITH {_MONEY_SCORES} SELECT * FROM s")
def numeric_scores(spark, sf_dir):
    return _money(spark, sf_dir).drop("question", "gold_answer", "generated_answer")


@query(f"WITH {_F1}, v AS (SELECT *, conv_id % 3 AS part, CASE WHEN turn % 2 = 0 THEN NULL ELSE token_f1 END AS x FROM f1) SELECT part, CAST(count(*) AS BIGINT) AS question_count, CAST(count(*) FILTER (turn % 2 = 1) AS BIGINT) AS numeric_applicable_count, round(avg(exact_match), 6) AS exact_match, round(avg(token_f1), 6) AS token_f1, round(avg(x), 6) AS numeric_accuracy FROM v GROUP BY 1")
def answer_summary(spark, sf_dir):
    """The numeric columns stand in by parity of the turn: applicable on odd turns only."""
    x = F.when(F.col("turn") % 2 == 1, F.col("token_f1"))
    d = _f1(spark, sf_dir).withColumn("part", F.pmod("conv_id", F.lit(3))).withColumn("gold_numeric_count", (F.col("turn") % 2).cast("int"))
    for c in ("numeric_accuracy", "numeric_precision", "numeric_recall", "numeric_f1"):
        d = d.withColumn(c, x)
    s = answers.summarise(d, "part")
    return s.select("part", "question_count", "numeric_applicable_count", *[F.round(c, 6).alias(c) for c in ("exact_match", "token_f1", "numeric_accuracy")])


@query(f"WITH {_MONEY_SCORES} SELECT part, CAST(count(*) AS BIGINT) AS question_count, CAST(sum(gold_numeric_count) AS BIGINT) AS applicable, round(avg(numeric_accuracy) FILTER (gold_numeric_count > 0), 6) AS numeric_accuracy, round(avg(numeric_precision) FILTER (gold_numeric_count > 0), 6) AS numeric_precision, round(avg(numeric_f1) FILTER (gold_numeric_count > 0), 6) AS numeric_f1 FROM s GROUP BY 1")
def numeric_summary(spark, sf_dir):
    d = _money(spark, sf_dir).withColumn("exact_match", F.lit(0)).withColumn("token_f1", F.lit(0.0))
    return answers.summarise(d, "part").select("part", "question_count", F.col("numeric_applicable_count").alias("applicable"), *[F.round(c, 6).alias(c) for c in ("numeric_accuracy", "numeric_precision", "numeric_f1")])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, list_value(round(CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * l_quantity * 1000000, 2), round(l_suppkey * 1.0, 2)) AS values, ['USD', 'percent'] AS units FROM lineitem""")
def numeric_entities(spark, sf_dir):
    """Amounts in brackets or not, with a magnitude, a percentage and a year that is none."""
    q, s = F.col("l_quantity").cast("int"), F.col("l_suppkey")
    amount = F.when(F.col("l_linenumber") % 2 == 0, F.format_string("(%d) million", q)).otherwise(F.format_string("$%d million", q))
    text = F.concat(F.lit("In 2019 it was "), F.when(F.col("l_linenumber") % 2 == 0, F.format_string("($%d) million", q)).otherwise(amount), F.format_string(" and grew %d%% after.", s))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numeric.numeric_entities(text).alias("e"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.transform("e", lambda x: F.round(x["value"].cast("double"), 2)).alias("values"), F.transform("e", lambda x: x["unit"]).alias("units"))


@query()
def numeric_entities_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numeric.numeric_entities(F.col("text")).alias("entities"), numeric.financial_spans(F.col("text")).alias("spans"), numeric.number_keys(F.col("text")).alias("keys"))


_UNITS = r"""u AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n\s*(?:[-*]\s+|\d+\.\s+)?', chr(10), 'g'), ';\s+', chr(10), 'g'), '([.!?])\s+([A-Z0-9*])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM conversations WHERE role = 'assistant')"""


@query(f"WITH {_UNITS} SELECT conv_id, turn, CAST(len(p) AS INT) AS n, sha256(array_to_string(list_transform(p, lambda x, i: 'U' || i || ':' || x), '|')) AS units_sha256 FROM u")
def answer_units(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.answer_units(F.col("text")).alias("u"))
    return d.select("conv_id", "turn", F.size("u").alias("n"), F.sha2(F.array_join(F.transform("u", lambda x: F.concat(x["unit_id"], F.lit(":"), x["text"])), "|"), 256).alias("units_sha256"))


_GRID = "g AS (SELECT user_id AS question_id, CAST(user_id AS BIGINT) AS position, event_type AS architecture, avg(value) AS latency_ms, CAST(max(value) > 120 AS INT) AS abstained, CASE WHEN max(value) > 120 THEN NULL ELSE least(1.0, avg(value) / 100) END AS support, max(value) / 500 AS quality FROM events GROUP BY 1, 3)"
_ARCHS = ["click", "purchase", "view"]
_IN = "('click', 'purchase', 'view')"


def _grid(spark, sf_dir):
    top, mean = F.max("value"), numeric.exact_mean(F.col("value"))  # whether a mean reaches a limit or equals another must not rest on the order of its rows
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("question_id"), F.col("user_id").cast("long").alias("position"), F.col("event_type").alias("architecture")).agg(
        mean.alias("latency_ms"), (top > 120).cast("int").alias("abstained"), F.when(top <= 120, F.least(F.lit(1.0), mean / 100)).alias("support"), (top / 500).alias("quality")
    )


@query("SELECT conv_id, turn, lower(regexp_replace(trim(x), '\\.+$', '')) IN ('insufficient evidence in the retrieved context', 'insufficient evidence', 'i don''t know', 'i do not know', 'cannot determine from the provided information') AS abstained FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN ' Insufficient evidence. ' WHEN 1 THEN 'I don''t know..' WHEN 2 THEN 'insufficient  evidence' ELSE text END AS x FROM conversations)")
def abstention_flags(spark, sf_dir):
    x = F.when(F.col("turn") % 5 == 0, " Insufficient evidence. ").when(F.col("turn") % 5 == 1, "I don't know..").when(F.col("turn") % 5 == 2, "insufficient  evidence").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_abstention(x).alias("abstained"))


@query(f"WITH {_GRID}, q AS (SELECT question_id, position, string_agg(CAST(abstained AS VARCHAR), '' ORDER BY architecture) AS pattern FROM g WHERE architecture IN {_IN} GROUP BY 1, 2), s AS (SELECT unnest(['000','001','010','011','100','101','110','111']) AS pattern) SELECT s.pattern, CAST(count(question_id) AS BIGINT) AS question_count, round(count(question_id) / (SELECT count(*) FROM q), 9) AS question_rate, coalesce(list(question_id ORDER BY position) FILTER (question_id IS NOT NULL), []) AS question_ids FROM s LEFT JOIN q USING (pattern) GROUP BY 1")
def abstention_overlap(spark, sf_dir):
    return rollups.abstention_overlap(_grid(spark, sf_dir), _ARCHS).withColumn("question_rate", F.round("question_rate", 9)).withColumn("question_count", F.col("question_count").cast("long"))


@query(f"WITH {_GRID}, p AS (SELECT a.architecture AS architecture_a, b.architecture AS architecture_b, count(*) AS n, count(*) FILTER (a.abstained = 1 AND b.abstained = 1) AS bb, count(*) FILTER (a.abstained = 1 AND b.abstained = 0) AS ao, count(*) FILTER (a.abstained = 0 AND b.abstained = 1) AS bo, count(*) FILTER (a.abstained = 0 AND b.abstained = 0) AS nn FROM g a JOIN g b ON a.question_id = b.question_id AND a.architecture < b.architecture GROUP BY 1, 2) SELECT architecture_a, architecture_b, n AS question_count, bb AS both_abstained, ao AS a_only_abstained, bo AS b_only_abstained, nn AS neither_abstained, n - nn AS either_abstained, CASE WHEN n > nn THEN round(bb / (n - nn), 9) END AS jaccard_abstentions, round((ao + bo) / n, 9) AS disagreement_rate FROM p")
def abstention_pairwise(spark, sf_dir):
    return rollups.abstention_pairwise(_grid(spark, sf_dir)).withColumn("jaccard_abstentions", F.round("jaccard_abstentions", 9)).withColumn("disagreement_rate", F.round("disagreement_rate", 9))


_WHY = ("empty_retrieval", "gold_page_absent_candidate_union", "gold_page_lost_before_pre_final", "gold_page_lost_at_final_selection", "final_gold_page_hit")
_WHYS = "d AS (SELECT *, (['" + "','".join(_WHY) + "'])[question_id % 5 + 1] AS c FROM g)"


@query(f"WITH {_GRID}, {_WHYS}, s AS (SELECT a.architecture, f.abstained FROM (SELECT unnest(['click','purchase','view']) AS architecture) a, (SELECT unnest([0, 1]) AS abstained) f), t AS (SELECT architecture, count(*) AS total FROM d GROUP BY 1), x AS (SELECT architecture, abstained, count(*) AS n, count(*) FILTER (c = 'final_gold_page_hit') AS hit, count(*) FILTER (c = 'empty_retrieval') AS empty, count(*) FILTER (c IN ('empty_retrieval', 'gold_page_absent_candidate_union')) AS absent, count(*) FILTER (c = 'gold_page_lost_before_pre_final') AS pre, count(*) FILTER (c = 'gold_page_lost_at_final_selection') AS fin FROM d GROUP BY 1, 2) SELECT s.architecture, CAST(s.abstained AS INT) AS abstained, CAST(coalesce(n, 0) AS BIGINT) AS question_count, CAST(coalesce(hit, 0) AS BIGINT) AS final_gold_page_hit, CAST(coalesce(empty, 0) AS BIGINT) AS empty_retrieval, CAST(coalesce(absent, 0) AS BIGINT) AS gold_page_absent_candidate_union, CAST(coalesce(pre, 0) AS BIGINT) AS gold_page_lost_before_pre_final, CAST(coalesce(fin, 0) AS BIGINT) AS gold_page_lost_at_final_selection, CAST(coalesce(n, 0) - coalesce(hit, 0) AS BIGINT) AS no_final_gold_page_hit, round(coalesce(n, 0) / total, 9) AS question_rate, round(hit / n, 9) AS final_gold_page_hit_rate FROM s LEFT JOIN x USING (architecture, abstained) LEFT JOIN t USING (architecture)")
def abstention_coverage(spark, sf_dir):
    d = _grid(spark, sf_dir).withColumn("diagnostic_category", F.element_at(F.array(*map(F.lit, _WHY)), (F.pmod("question_id", F.lit(5)) + 1).cast("int")))
    out = rollups.abstention_coverage(d, _ARCHS)
    return out.withColumn("question_rate", F.round("question_rate", 9)).withColumn("final_gold_page_hit_rate", F.round("final_gold_page_hit_rate", 9)).withColumn("question_count", F.col("question_count").cast("long"))


@query(f"WITH {_GRID} SELECT architecture, coalesce(CASE question_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE 'y' END, 'unannotated') AS category, 'reasoning' AS grouping, CAST(count(*) AS BIGINT) AS question_count, CAST(sum(abstained) AS BIGINT) AS exact_abstentions, CAST(count(*) - sum(abstained) AS BIGINT) AS non_abstentions, round(avg(abstained), 9) AS exact_abstention_rate FROM g GROUP BY 1, 2")
def abstention_categories(spark, sf_dir):
    d = _grid(spark, sf_dir).withColumn("reasoning", F.when(F.pmod("question_id", F.lit(3)) == 1, "x").when(F.pmod("question_id", F.lit(3)) == 2, "y"))
    return rollups.abstention_categories(d, ["reasoning"]).withColumn("exact_abstention_rate", F.round("exact_abstention_rate", 9))


@query(f"WITH {_GRID} SELECT architecture, CAST(count(*) AS BIGINT) AS question_count, CAST(sum(abstained) AS BIGINT) AS exact_abstention_count, round(avg(abstained), 9) AS exact_abstention_rate FROM g GROUP BY 1")
def abstention_summary(spark, sf_dir):
    return rollups.abstention_summary(_grid(spark, sf_dir)).withColumn("exact_abstention_rate", F.round("exact_abstention_rate", 9))


@query(f"WITH {_GRID} SELECT architecture, CAST(count(*) AS BIGINT) AS question_count, CAST(sum(abstained) AS BIGINT) AS exact_abstentions, round(avg(abstained), 9) AS exact_abstention_rate, CAST(count(*) - sum(abstained) AS BIGINT) AS non_abstentions, CAST(count(support) AS BIGINT) AS context_scored_n, CASE WHEN architecture <> 'click' THEN CAST(count(*) - sum(abstained) - count(support) AS BIGINT) END AS context_unscored_non_abstentions, round(avg(support), 9) AS context_support, round(avg(1 - support), 9) AS context_hallucination_proxy, 'v4' AS judge_protocol FROM g GROUP BY 1")
def support_summary(spark, sf_dir):
    d = _grid(spark, sf_dir).withColumnRenamed("support", "context_support").withColumn("judge_protocol", F.lit("v4"))
    out = rollups.support_summary(d, ["context"], {"context": ["click"]})
    for c in ("exact_abstention_rate", "context_support", "context_hallucination_proxy"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query("SELECT event_type, 'value' AS component, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1")
def latency_summary(spark, sf_dir):
    out = rollups.latency_summary(table(spark, sf_dir, "events"), "event_type", ["value"])
    return out.select("event_type", "component", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")])


@query("WITH x AS (SELECT 'lang' AS grouping, lang AS category, source, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), source, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT grouping, category, source, CAST(count(*) AS BIGINT) AS question_count, CAST(count(n_chars) AS BIGINT) AS n_chars_n, round(avg(n_chars), 6) AS n_chars_mean, CAST(count(quality) AS BIGINT) AS quality_n, round(avg(quality), 6) AS quality_mean FROM x WHERE category IS NOT NULL GROUP BY 1, 2, 3")
def category_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = rollups.category_summary(d, ["lang", "quality"], "source", ["n_chars", "quality"])
    return out.withColumn("n_chars_mean", F.round("n_chars_mean", 6)).withColumn("quality_mean", F.round("quality_mean", 6))


@query("SELECT quality, CAST(count(*) AS BIGINT) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def label_value_counts(spark, sf_dir):
    return rollups.value_counts(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "quality")


@query("SELECT CAST(count(value) AS BIGINT) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max FROM events")
def describe_values(spark, sf_dir):
    d = rollups.describe(table(spark, sf_dir, "events"), "value")
    return d.select("count", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


_TRADE = f"{_GRID}, t AS (SELECT architecture, count(*) AS question_count, avg(quality) AS quality_mean, count(quality) AS quality_n, avg(support) AS support_mean, count(support) AS support_n, avg(latency_ms) AS lm, quantile_cont(latency_ms, 0.5) AS lmed FROM g GROUP BY 1)"


@query(f"WITH {_TRADE} SELECT architecture, CAST(question_count AS BIGINT) AS question_count, round(quality_mean, 6) AS quality_mean, CAST(quality_n AS BIGINT) AS quality_n, round(support_mean, 6) AS support_mean, CAST(support_n AS BIGINT) AS support_n, round(lm, 6) AS total_latency_mean_ms, round(lmed, 6) AS total_latency_median_ms FROM t")
def tradeoff_summary(spark, sf_dir):
    t = rollups.tradeoff_summary(_grid(spark, sf_dir), ["quality", "support"], "latency_ms")
    return t.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])


@query(f"WITH {_TRADE}, o AS (SELECT 'quality' AS objective, architecture, quality_mean AS q, lm FROM t UNION ALL SELECT 'support', architecture, support_mean, lm FROM t WHERE architecture <> 'view') SELECT a.objective, a.architecture, round(a.q, 6) AS quality_mean, round(a.lm, 6) AS mean_total_latency_ms, CAST(count(b.architecture) = 0 AS INT) AS pareto_nondominated, coalesce(string_agg(b.architecture, ',' ORDER BY b.architecture), '') AS dominated_by FROM o a LEFT JOIN o b ON a.objective = b.objective AND b.q >= a.q AND b.lm <= a.lm AND (b.q > a.q OR b.lm < a.lm) GROUP BY ALL")
def pareto_frontier(spark, sf_dir):
    t = rollups.tradeoff_summary(_grid(spark, sf_dir), ["quality", "support"], "latency_ms")
    p = rollups.pareto(t, ["quality", "support"], {"support": ["click", "error", "purchase", "signup"]})
    return p.withColumn("quality_mean", F.round("quality_mean", 6)).withColumn("mean_total_latency_ms", F.round("mean_total_latency_ms", 6))


_LONG = f"{_GRID}, l AS (SELECT question_id, architecture, 'latency_ms' AS metric, latency_ms AS value FROM g UNION ALL SELECT question_id, architecture, 'support', support FROM g UNION ALL SELECT question_id, architecture, 'abstained', abstained FROM g)"


@query(f"WITH {_LONG}, p AS (SELECT a.architecture AS architecture_a, b.architecture AS architecture_b, a.metric, a.value AS x, b.value AS y FROM l a JOIN l b ON a.question_id = b.question_id AND a.metric = b.metric AND ((a.architecture = 'click' AND b.architecture = 'purchase' AND a.metric <> 'support') OR (a.architecture = 'purchase' AND b.architecture = 'view')) WHERE a.metric <> 'abstained'), s AS (SELECT architecture_a, architecture_b, metric, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS pair_count, count(*) FILTER (x IS NULL OR y IS NULL) AS ex, avg(x) FILTER (y IS NOT NULL) AS ma, avg(y) FILTER (x IS NOT NULL) AS mb FROM p GROUP BY 1, 2, 3) SELECT architecture_a, architecture_b, metric, CAST(pair_count AS BIGINT) AS pair_count, CAST(ex AS BIGINT) AS excluded_pair_count, round(ma, 6) AS mean_a_paired, round(mb, 6) AS mean_b_paired, round(mb - ma, 6) AS mean_difference_b_minus_a, CASE WHEN metric = 'latency_ms' AND ma <> 0 THEN round(100 * (mb - ma) / ma, 6) END AS percent_change_from_a FROM s")
def paired_tradeoffs(spark, sf_dir):
    p = rollups.adjacent_pairs(_grid(spark, sf_dir), _ARCHS, ["latency_ms", "support"], "latency_ms", {("click", "support")})
    return p.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in p.dtypes])


def _pairs(spark, sf_dir, metrics):
    g = _grid(spark, sf_dir).withColumn("abstained", F.col("abstained").cast("double"))
    long = g.unpivot(["question_id", "architecture"], ["latency_ms", "support", "abstained"], "metric", "value")
    comparisons = spark.createDataFrame([(a, b, m) for a, b in zip(_ARCHS, _ARCHS[1:], strict=False) for m in metrics], "architecture_a string, architecture_b string, metric string")
    return stats.paired_values(long, comparisons)


_BY = ["architecture_a", "architecture_b", "metric"]
_PAIRS = _LONG + ", p AS (SELECT a.question_id, a.architecture AS architecture_a, b.architecture AS architecture_b, a.metric, a.value AS x, b.value AS y FROM l a JOIN l b ON a.question_id = b.question_id AND a.metric = b.metric AND ((a.architecture = 'click' AND b.architecture = 'purchase') OR (a.architecture = 'purchase' AND b.architecture = 'view')) WHERE a.value IS NOT NULL AND b.value IS NOT NULL)"
_MC = _PAIRS + ", c AS (SELECT architecture_a, architecture_b, metric, count(*) AS n, count(*) FILTER (x = 1 AND y = 0) AS ao, count(*) FILTER (x = 0 AND y = 1) AS bo FROM p WHERE metric = 'abstained' GROUP BY 1, 2, 3), pv AS (SELECT *, CASE WHEN ao + bo = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(ao, bo) + 1), lambda i: exp(lgamma(ao + bo + 1) - lgamma(i + 1) - lgamma(ao + bo - i + 1) - (ao + bo) * ln(2))))) END AS p_value FROM c)"


@query(f"WITH {_MC} SELECT architecture_a, architecture_b, metric, CAST(n AS BIGINT) AS pair_count, CAST(ao AS BIGINT) AS a_only, CAST(bo AS BIGINT) AS b_only, round(p_value, 9) AS p_value FROM pv")
def paired_mcnemar(spark, sf_dir):
    return stats.mcnemar(_pairs(spark, sf_dir, ["abstained"]), _BY).withColumn("p_value", F.round("p_value", 9))


_RB = _PAIRS + ", d AS (SELECT *, y - x AS d FROM p WHERE metric <> 'abstained'), r AS (SELECT architecture_a, architecture_b, metric, d, rank() OVER (PARTITION BY architecture_a, architecture_b, metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY architecture_a, architecture_b, metric, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0), s AS (SELECT architecture_a, architecture_b, metric, coalesce(sum(r) FILTER (d > 0), 0) AS wp, coalesce(sum(r) FILTER (d < 0), 0) AS wm FROM r GROUP BY 1, 2, 3)"


@query(f"WITH {_RB} SELECT architecture_a, architecture_b, metric, CAST(count(*) AS BIGINT) AS pair_count, round(avg(d), 6) AS mean_difference, round(any_value(coalesce(wp, 0)), 6) AS w_plus, round(any_value(coalesce(wm, 0)), 6) AS w_minus, round(any_value(CASE WHEN wp + wm > 0 THEN (wp - wm) / (wp + wm) ELSE 0 END), 9) AS effect FROM d LEFT JOIN s USING (architecture_a, architecture_b, metric) GROUP BY 1, 2, 3")
def paired_wilcoxon_effect(spark, sf_dir):
    r = stats.rank_biserial(_pairs(spark, sf_dir, ["latency_ms", "support"]), _BY)
    return r.withColumn("mean_difference", F.round("mean_difference", 6)).withColumn("w_plus", F.round("w_plus", 6)).withColumn("w_minus", F.round("w_minus", 6)).withColumn("effect", F.round("effect", 9))


@query()
def paired_bootstrap_ci(spark, sf_dir):
    """With the signed-rank p; numpy's generator has no SQL form, so a test holds it to a direct computation."""
    return stats.wilcoxon_and_bootstrap(_pairs(spark, sf_dir, ["latency_ms", "support"]), _BY, "run-1")


#: 1 - erf by its series; rank sums of more than 50 differences are near normal.
_ERFC = "CASE WHEN x = 0 THEN 1.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 400), lambda n: exp((2 * n + 1) * ln(x) + 2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2))))) END"
_NORMAL = _RB + ", t AS (SELECT architecture_a, architecture_b, metric, abs(d) AS size, count(*) AS t FROM d WHERE d <> 0 GROUP BY ALL), u AS (SELECT architecture_a, architecture_b, metric, CAST(sum(t) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM t GROUP BY 1, 2, 3), v AS (SELECT *, abs(least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM u JOIN s USING (architecture_a, architecture_b, metric)), x AS (SELECT *, z / sqrt(2) AS x FROM v)"


@query(f"WITH {_NORMAL} SELECT architecture_a, architecture_b, metric, CAST(n AS BIGINT) AS n, round(ties, 3) AS ties, round({_ERFC}, 9) AS wilcoxon_p FROM x WHERE n > 50")
def paired_signed_rank_p(spark, sf_dir):
    """Comparisons of more than 50 nonzero differences, whose p is the normal one with tie correction."""
    ranks = stats.signed_ranks(_pairs(spark, sf_dir, ["latency_ms", "support"]), _BY).where("n > 50")
    return ranks.join(stats.wilcoxon(ranks, _BY), _BY).select(*_BY, "n", F.round("ties", 3).alias("ties"), F.round("wilcoxon_p", 9).alias("wilcoxon_p"))


_SPLITMIX = [f"CAST(CAST(xor(x, x >> {a}) AS UHUGEINT) * {b} % 18446744073709551616 AS UBIGINT)" for a, b in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))]
_POISSON = "(" + " + ".join(f"CAST(u >= {t} AS INT)" for t in (24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535, 65535, 65535)) + ")"


@query(f"""WITH {_PAIRS}, k AS (SELECT architecture_a, architecture_b, metric, y - x AS d, CAST(CAST('0x' || substr(sha256('run-1:' || architecture_a || ':' || architecture_b || ':' || metric || ':' || question_id), 1, 16) AS UBIGINT) AS UHUGEINT) AS h FROM p WHERE metric <> 'abstained'),
r AS (SELECT *, r, CAST((h + CAST(r // 4 + 1 AS UHUGEINT) * {0x9E3779B97F4A7C15}) % 18446744073709551616 AS UBIGINT) AS x FROM k, range(0, 40) t(r)),
r1 AS (SELECT * REPLACE ({_SPLITMIX[0]} AS x) FROM r), r2 AS (SELECT * REPLACE ({_SPLITMIX[1]} AS x) FROM r1), r3 AS (SELECT *, (xor(x, x >> 31) >> CAST(16 * (r % 4) AS UBIGINT)) & 65535 AS u FROM r2),
c AS (SELECT *, {_POISSON} AS times FROM r3)
SELECT architecture_a, architecture_b, metric, CAST(r AS INT) AS replicate, round(sum(times * d) / sum(times), 9) AS mean FROM c GROUP BY 1, 2, 3, 4 HAVING sum(times) > 0""")
def bootstrap_means(spark, sf_dir):
    """The first 40 of the mergeable resamples: each pair's counts follow from its key."""
    return stats.resampled_means(_pairs(spark, sf_dir, ["latency_ms", "support"]), _BY, "run-1", replicates=40).withColumn("mean", F.round("mean", 9))


@query("WITH b AS (SELECT o_orderpriority AS name, count(*) FILTER (o_totalprice > 200000) / count(*) / 100 AS p FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM b) SELECT name, round(p, 9) AS p, round(max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS holm_p, max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) < 0.05 AS significant FROM k")
def holm_adjust(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg((F.sum((F.col("o_totalprice") > 200000).cast("int")) / F.count("*") / 100).alias("p"))
    return stats.holm(p, "p", "name").withColumn("p", F.round("p", 9)).withColumn("holm_p", F.round("holm_p", 9))


@query("SELECT p_brand, max(p_brand) AS label, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def unique_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("label", F.col("p_brand"))
    return rollups.unique_documents(p, "p_brand", ["label"]).join(p.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand")


@query("SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM benchmark ORDER BY sha256('dev:' || item_id), item_id LIMIT 5) THEN 'dev' ELSE 'heldout' END AS part FROM benchmark")
def split_dev_heldout(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return selection.split_by_ids(b, selection.hash_ordered(b, "item_id", "dev:", 5), "item_id").select("item_id", "part")


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM benchmark ORDER BY sha256('dev:' || item_id) LIMIT 5) ORDER BY sha256('audit:' || item_id) LIMIT 8")
def hash_sample(spark, sf_dir):
    """Eight items of those that an earlier sample has not drawn."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    drawn = selection.hash_ordered(items, "item_id", "dev:", 5)
    return selection.hash_ordered(items.join(F.broadcast(drawn), "item_id", "left_anti"), "item_id", "audit:", 8)


@query("SELECT CAST(round_even(i * ((SELECT count(*) FROM benchmark) - 1) / 6.0::DOUBLE, 0) AS BIGINT) AS position FROM range(0, 7) t(i)")
def even_sample(spark, sf_dir):
    return selection.even_positions(table(spark, sf_dir, "benchmark"), 7)


@query("SELECT 'duplicate_key' AS rule, CAST(user_id AS VARCHAR) || '|' || event_type AS key, CAST(count(*) AS VARCHAR) AS detail FROM events GROUP BY user_id, event_type HAVING count(*) > 1")
def integrity_duplicates(spark, sf_dir):
    return checks.duplicate_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT 'coverage' AS rule, CAST(doc_id AS VARCHAR) AS key, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS detail FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def integrity_coverage(spark, sf_dir):
    return checks.coverage(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), ["doc_id"])


@query("SELECT 'functional_dependency' AS rule, CAST(n_regionkey AS VARCHAR) AS key, 'n_name' AS detail FROM nation GROUP BY n_regionkey HAVING count(DISTINCT n_name) > 1")
def integrity_functional_dependency(spark, sf_dir):
    return checks.functional_dependency(table(spark, sf_dir, "nation"), "n_regionkey", ["n_name"])


@query("SELECT 'published_value' AS rule, CAST(l_orderkey AS VARCHAR) AS key, 'q' AS detail FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) WHERE l_orderkey % 100 = 0")
def integrity_published_values(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return checks.values_agree(a, a.withColumn("q", F.when(F.col("l_orderkey") % 100 == 0, F.col("q") + 1).otherwise(F.col("q"))), ["l_orderkey"], ["q"])


@query("SELECT source, sha256(string_agg(h, '' ORDER BY b)) AS digest FROM (SELECT source, CAST(floor(doc_id / 1024) AS BIGINT) AS b, sha256(string_agg(sha256(doc_id || chr(9) || text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2) GROUP BY 1")
def corpus_digest(spark, sf_dir):
    """Order-sensitive digest per source: the root of a tree over the documents in order of their ids."""
    return merkle.roots(merkle.tree(_leaves(spark, sf_dir), ["source"]), ["source"]).select("source", "digest")


def _leaves(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("place"), F.sha2(F.concat_ws("\t", "doc_id", "text"), 256).alias("digest"))


_NODES = "SELECT source, CAST(floor(doc_id / 1024) AS BIGINT) AS node, min(doc_id) AS first_place, max(doc_id) AS last_place, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM {0} GROUP BY 1, 2"


@query(f"""WITH a AS (SELECT source, doc_id, sha256(doc_id || chr(9) || text) AS h FROM documents), b AS (SELECT source, doc_id, CASE WHEN doc_id % 700 = 3 THEN sha256(h) ELSE h END AS h FROM a WHERE source <> 'src1'),
x AS ({_NODES.format('a')}), y AS ({_NODES.format('b')})
SELECT source, node, CASE WHEN x.h IS NULL THEN y.first_place ELSE x.first_place END AS first_place, CASE WHEN x.h IS NULL THEN y.last_place ELSE x.last_place END AS last_place, CASE WHEN y.h IS NULL THEN 'removed' WHEN x.h IS NULL THEN 'added' ELSE 'changed' END AS status
FROM x FULL JOIN y USING (source, node) WHERE x.h IS DISTINCT FROM y.h""")
def corpus_changes(spark, sf_dir):
    """Ranges of documents that differ between two states of the corpus, found from the trees alone: one source is gone, and some texts have changed."""
    was = _leaves(spark, sf_dir)
    now = was.where("source <> 'src1'").withColumn("digest", F.when(F.col("place") % 700 == 3, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return merkle.changes(merkle.tree(was, ["source"]), merkle.tree(now, ["source"]), ["source"])


@query(f"WITH {_GRID}, k AS (SELECT question_id FROM g WHERE architecture IN {_IN} GROUP BY 1 HAVING sum(abstained) = 0 AND count(*) = 3) SELECT architecture, CAST(count(*) AS BIGINT) AS question_count, round(avg(quality), 9) AS quality, round(avg(support), 9) AS support FROM g WHERE question_id IN (SELECT question_id FROM k) GROUP BY 1")
def common_subset_quality(spark, sf_dir):
    c = rollups.common_subset(_grid(spark, sf_dir), _ARCHS, ["quality", "support"])
    return c.withColumn("quality", F.round("quality", 9)).withColumn("support", F.round("support", 9))


@query("WITH f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, length(text) AS n FROM conversations) SELECT conv_id, CAST(pos AS INT) AS pos, role, CAST(n AS INT) AS n FROM f")
def evidence_flatten(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("e"))
    return rollups.flattened(g, "conv_id", "e").select("conv_id", "pos", "role", "n")


_LABEL = "(['correct', 'partially_correct', 'incorrect', 'failure_to_answer', 'judge_error'])[question_id % 5 + 1]"


@query(f"WITH {_GRID}, j AS (SELECT *, {_LABEL} AS label FROM g) SELECT architecture, CAST(count(*) AS BIGINT) AS question_count, CAST(count(*) FILTER (label = 'correct') AS BIGINT) AS correct_count, CAST(count(*) FILTER (label = 'judge_error') AS BIGINT) AS judge_error_count, round(avg(CAST(label = 'correct' AS INT)) FILTER (label <> 'judge_error'), 9) AS semantic_correctness, round(avg(support) FILTER (label <> 'judge_error'), 9) AS completeness, round(avg(CAST(label = 'correct' AS INT)) FILTER (label <> 'judge_error' AND abstained = 0), 9) AS semantic_correctness_non_abstained, round(avg(support) FILTER (label <> 'judge_error' AND abstained = 0), 9) AS completeness_non_abstained, round(avg(quality), 9) AS bertscore_f1, round(count(*) FILTER (label = 'correct') / count(*), 9) AS correct_lower, round(count(*) FILTER (label IN ('correct', 'judge_error')) / count(*), 9) AS correct_upper FROM j GROUP BY 1")
def quality_labels(spark, sf_dir):
    names = ["correct", "partially_correct", "incorrect", "failure_to_answer", "judge_error"]
    d = _grid(spark, sf_dir).withColumn("label", F.element_at(F.array(*map(F.lit, names)), (F.pmod("question_id", F.lit(5)) + 1).cast("int"))).withColumnRenamed("support", "completeness").withColumnRenamed("quality", "bertscore_f1")
    q = rollups.quality_summary(d, ["correct", "judge_error"])
    return q.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in q.dtypes])


@query("""WITH x AS (SELECT conv_id, turn, conv_id % 5 AS k FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, 'U1' AS unit_id,
 CASE k WHEN 0 THEN 'missing_unit_assessment' WHEN 1 THEN 'support_type_conflict' WHEN 2 THEN 'missing_or_unknown_evidence_id' WHEN 3 THEN 'financial_number_absent_from_passage' ELSE '' END AS guard_reason, k = 4 AS supported, k > 0 AS judge_supported FROM x""")
def judge_guards(spark, sf_dir):
    """A deterministic judge that errs in a way set by the conversation's id."""
    k = F.pmod("conv_id", F.lit(5))
    one = lambda kind, ids: F.array(F.struct(F.lit("U1").alias("unit_id"), F.lit(True).alias("factual"), F.lit(True).alias("supported"), F.lit(kind).alias("support_type"), F.array(*map(F.lit, ids)).alias("evidence_ids"), F.lit("").alias("derivation")))
    none = F.from_json(F.lit("[]"), support.ASSESSMENTS)
    a = F.when(k == 0, none).when(k == 1, one("unsupported", ["E1"])).when(k == 2, one("direct", ["E9"])).otherwise(one("direct", ["E1"]))
    said = F.when(k == 4, "It was $5 million.").otherwise("It was $7 million.")
    d = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", F.array(F.struct(F.lit("U1").alias("unit_id"), said.alias("text"))).alias("units"), F.array(F.struct(F.lit("E1").alias("evidence_id"), F.lit("Revenue was $5 million.").alias("text"))).alias("passages"), a.alias("assessments")
    )
    return support.claim_rows(support.guard_claims(d), ["conv_id", "turn"]).select("conv_id", "turn", "unit_id", "guard_reason", "supported", "judge_supported")


@query(f"WITH {BM25}, t5 AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM z WHERE score > 0) WHERE rank <= 5) SELECT item_id, doc_id, CAST(rank AS INT) AS first_rank, CAST(CASE WHEN n + m + 3 <= 512 THEN 1 WHEN n <= 509 - m THEN 1 ELSE ceil((n - (509 - m)) / (445.0 - m)) + 1 END AS BIGINT) AS window_count FROM t5 JOIN (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) USING (doc_id) JOIN (SELECT item_id, len(regexp_extract_all(text, '\\S+')) AS m FROM benchmark) USING (item_id)")
def rerank_windows(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = _bm25(spark, sf_dir, 5).withColumnRenamed("query_id", "item_id").withColumnRenamed("id", "doc_id")
    c = found.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("query")), "item_id").select(F.col("item_id").alias("question_id"), "query", "rank", F.col("doc_id").alias("chunk_id"), F.lit("").alias("header"), "text")
    w = rerank.candidate_windows(c).groupBy("question_id", "chunk_id", "rank").agg(F.count("*").alias("window_count"))
    return w.select(F.col("question_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.col("rank").alias("first_rank"), "window_count")


@query()
def rerank_windows_best(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = _bm25(spark, sf_dir, 20).withColumnRenamed("query_id", "item_id").withColumnRenamed("id", "doc_id")
    c = found.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("query")), "item_id").select(F.col("item_id").alias("question_id"), "query", "rank", F.col("doc_id").alias("chunk_id"), F.lit("").alias("header"), "text")
    return rerank.rerank(c)


@query()
def embed_default(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", models.embed(F.col("text")).alias("embedding"))


@query()
def answer_similarity(spark, sf_dir):
    return _qa(spark, sf_dir).select("conv_id", "turn", models.soft_match(F.col("generated_answer"), F.col("gold_answer")).alias("s")).select("conv_id", "turn", "s.*")


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256('run-1:' || source || ':' || doc_id), 1, 16) AS UBIGINT) AS DECIMAL(20, 0)) AS seed FROM documents")
def text_seeds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.seed64(F.concat_ws(":", F.lit("run-1"), "source", F.col("doc_id").cast("string"))).alias("seed"))


_AMOUNT = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_AMOUNT} AS said, CAST(CAST(l_quantity AS BIGINT) + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS was, l_returnflag AS flag FROM lineitem),
u AS (SELECT l_orderkey, l_linenumber, 'U1' AS unit_id, 'It cost $' || said || ' million.' AS claim, said <> was AS wrong FROM x UNION ALL SELECT l_orderkey, l_linenumber, 'U2', 'The flag was ' || flag || '.', false FROM x)
SELECT l_orderkey, l_linenumber, unit_id, claim, CASE WHEN wrong THEN 'financial_number_absent_from_passage' ELSE '' END AS guard_reason, NOT wrong AS supported FROM u""")
def judge_guards_on_text(spark, sf_dir):
    """Units cut from answers and passages made from the rows: numbers that the passage does not have turn a judge's support off."""
    said = F.col("l_quantity").cast("long")
    answer = F.concat(F.lit("It cost $"), said.cast("string"), F.lit(" million. The flag was "), "l_returnflag", F.lit("."))
    passage = F.concat(F.lit("Cost: $"), (said + (F.col("l_partkey") % 3 == 0).cast("long")).cast("string"), F.lit(" million; flag "), "l_returnflag")
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.answer_units(answer).alias("units"), F.array(F.struct(F.lit("E1").alias("evidence_id"), passage.alias("text"))).alias("passages"))
    judged = F.transform("units", lambda u: F.struct(u["unit_id"].alias("unit_id"), F.lit(True).alias("factual"), F.lit(True).alias("supported"), F.lit("direct").alias("support_type"), F.array(F.lit("E1")).alias("evidence_ids"), F.lit("").alias("derivation")))
    claims = support.guard_claims(d.withColumn("assessments", judged))
    return support.claim_rows(claims, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "unit_id", "claim", "guard_reason", "supported")

"""Tables rolled up from per-question metrics. Grids that must be complete are built on spines, so empty groups stay visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import with_quantiles


def latency_summary(rows: DataFrame, by: str, components: list[str], applicable: dict[str, list[str]] | None = None) -> DataFrame:
    """Mean, median, sample deviation (0 of one value), least and most of each component; a component without values has no row. A negative value raises, and
    so does one of a component that does not apply to its architecture; applicable names the architectures of such components."""
    for c, names in (applicable or {}).items():
        ok = F.col(c).isNull() | F.coalesce(F.col(by).isin(*names), F.lit(False))
        rows = rows.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} does not apply to "), F.coalesce(F.col(by).cast("string"), F.lit("null")))).cast("double")))
    long = rows.unpivot([by], components, "component", "ms").where("ms is not null")
    ms = F.when(F.col("ms") >= 0, F.col("ms")).otherwise(F.raise_error(F.lit("latency is negative")).cast("double"))
    long = long.withColumn("ms", ms)
    g = long.groupBy(by, "component").agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("std"), F.min("ms").alias("min"), F.max("ms").alias("max"))
    return with_quantiles(g, long, [by, "component"], "ms", [0.5]).select(by, "component", "n", "mean", F.col("q")[0].alias("median"), "std", "min", "max")


def category_summary(rows: DataFrame, groupings: list[str], by: str, metrics: list[str]) -> DataFrame:
    """Per grouping, category and architecture the non-null count and mean of each metric; rows without a category in a grouping don't count there."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("category")) for g in groupings])).alias("_g"), by, *metrics)
    long = long.select("_g.grouping", "_g.category", by, *metrics).where("category is not null")
    aggs = [a for m in metrics for a in (F.count(m).alias(f"{m}_n"), F.avg(m).alias(f"{m}_mean"))]
    return long.groupBy("grouping", "category", by).agg(F.count("*").alias("question_count"), *aggs)


def correctness_bounds(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Lower bound correct / n, upper (correct + judge_error) / n; null if any row of the group has no label."""
    n, hit, err = F.count("*"), F.sum((F.col(label) == "correct").cast("int")), F.sum((F.col(label) == "judge_error").cast("int"))
    whole = F.sum(F.col(label).isNull().cast("int")) == 0
    return rows.groupBy(*by).agg(n.alias("n"), F.when(whole, hit / n).alias("correct_lower"), F.when(whole, (hit + err) / n).alias("correct_upper"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts per value with null as a value of its own."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def nunique(column: str) -> Column:
    """Distinct values, null counted as one."""
    return F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))


def describe(rows: DataFrame, column: str) -> DataFrame:
    g = rows.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    return with_quantiles(g, rows, [], column, [0.25, 0.5, 0.75]).select("count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def abstention_overlap(rows: DataFrame, architectures: list[str]) -> DataFrame:
    """rows (question_id, position, architecture, abstained 0/1) -> every pattern of the architectures' flags, also those of no question: pattern,
    question_count, question_rate, question_ids in order of position."""
    flags = [F.max(F.when(F.col("architecture") == a, F.col("abstained"))).cast("string") for a in architectures]
    q = rows.where(F.col("architecture").isin(architectures)).groupBy("question_id", "position").agg(F.concat(*flags).alias("pattern"))
    n = len(architectures)
    spine = rows.sparkSession.range(2**n).select(F.lpad(F.conv("id", 10, 2), n, "0").alias("pattern"))
    total = q.agg(F.count("*").alias("total"))
    g = q.groupBy("pattern").agg(F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct("position", "question_id"))).alias("ids"))
    out = F.broadcast(spine).join(g, "pattern", "left").crossJoin(F.broadcast(total))
    ids = F.coalesce(F.transform("ids", lambda x: x["question_id"]), F.slice(F.transform("ids", lambda x: x["question_id"]), 1, 0), F.array())
    return out.select("pattern", F.coalesce("c", F.lit(0)).alias("question_count"), (F.coalesce("c", F.lit(0)) / F.col("total")).alias("question_rate"), ids.alias("question_ids"))


def abstention_pairwise(rows: DataFrame) -> DataFrame:
    """Per pair of architectures the 2 x 2 counts, Jaccard index (null if neither ever abstains) and disagreement."""
    a = rows.select("question_id", F.col("architecture").alias("architecture_a"), F.col("abstained").alias("x"))
    b = rows.select("question_id", F.col("architecture").alias("architecture_b"), F.col("abstained").alias("y"))
    c = lambda x, y: F.sum(((F.col("x") == x) & (F.col("y") == y)).cast("int"))
    g = a.join(b, "question_id").where("architecture_a < architecture_b").groupBy("architecture_a", "architecture_b").agg(
        F.count("*").alias("question_count"), c(1, 1).alias("both_abstained"), c(1, 0).alias("a_only_abstained"), c(0, 1).alias("b_only_abstained"), c(0, 0).alias("neither_abstained")
    )
    either = F.col("question_count") - F.col("neither_abstained")
    return g.withColumn("either_abstained", either).withColumn("jaccard_abstentions", F.when(either > 0, F.col("both_abstained") / either)).withColumn("disagreement_rate", (F.col("a_only_abstained") + F.col("b_only_abstained")) / F.col("question_count"))


def abstention_coverage(rows: DataFrame, architectures: list[str]) -> DataFrame:
    """rows (architecture, abstained, diagnostic_category) -> per architecture and flag, both always there, where gold pages were lost."""
    spark = rows.sparkSession
    spine = spark.createDataFrame([(a, f) for a in architectures for f in (0, 1)], "architecture string, abstained int")
    is_ = lambda *c: F.sum(F.col("diagnostic_category").isin(*c).cast("int"))
    total = rows.groupBy("architecture").agg(F.count("*").alias("total"))
    g = rows.groupBy("architecture", "abstained").agg(
        F.count("*").alias("question_count"), is_("final_gold_page_hit").alias("final_gold_page_hit"), is_("empty_retrieval").alias("empty_retrieval"), is_("empty_retrieval", "gold_page_absent_candidate_union").alias("gold_page_absent_candidate_union"),
        is_("gold_page_lost_before_pre_final").alias("gold_page_lost_before_pre_final"), is_("gold_page_lost_at_final_selection").alias("gold_page_lost_at_final_selection"),
    )
    counts = [c for c in g.columns if c not in ("architecture", "abstained")]
    out = F.broadcast(spine).join(g, ["architecture", "abstained"], "left").join(total, "architecture", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    n, hit = F.coalesce("question_count", F.lit(0)), F.coalesce("final_gold_page_hit", F.lit(0))
    return out.select("architecture", "abstained", *zero, (n - hit).alias("no_final_gold_page_hit"), (n / F.col("total")).alias("question_rate"), F.when(n > 0, hit / n).alias("final_gold_page_hit_rate"))


def abstention_categories(rows: DataFrame, groupings: list[str]) -> DataFrame:
    """As category_summary, but a missing category is one of its own, 'unannotated'."""
    parts = [rows.groupBy("architecture", F.lit(g).alias("grouping"), F.coalesce(F.col(g).cast("string"), F.lit("unannotated")).alias("category")).agg(F.count("*").alias("question_count"), F.sum("abstained").alias("exact_abstentions")) for g in groupings]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("non_abstentions", F.col("question_count") - F.col("exact_abstentions")).withColumn("exact_abstention_rate", F.col("exact_abstentions") / F.col("question_count"))


def support_summary(rows: DataFrame, sources: list[str], inapplicable: dict[str, list[str]] | None = None) -> DataFrame:
    """rows (architecture, abstained, <source>_support, judge_protocol) -> scored and unscored counts and means; mixed protocols in an architecture raise.

    inapplicable: source -> architectures for which unscored rows are no shortcoming but not applicable (null).
    """
    n, ab = F.count("*"), F.sum("abstained")
    cols = [n.alias("question_count"), ab.alias("exact_abstentions"), (ab / n).alias("exact_abstention_rate"), (n - ab).alias("non_abstentions")]
    for s in sources:
        scored = F.count(f"{s}_support")
        skip = F.col("architecture").isin((inapplicable or {}).get(s, [])) if (inapplicable or {}).get(s) else F.lit(False)
        cols += [scored.alias(f"{s}_scored_n"), F.when(~F.first(skip), n - ab - scored).alias(f"{s}_unscored_non_abstentions"), F.avg(f"{s}_support").alias(f"{s}_support"), F.avg(1 - F.col(f"{s}_support")).alias(f"{s}_hallucination_proxy")]
    one = F.when(F.count_distinct("judge_protocol") <= 1, F.max("judge_protocol")).otherwise(F.raise_error(F.lit("mixed judge protocols")).cast("string"))
    return rows.groupBy("architecture").agg(*cols, one.alias("judge_protocol"))


def abstention_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("architecture").agg(F.count("*").alias("question_count"), F.sum("abstained").alias("exact_abstention_count"), F.avg("abstained").alias("exact_abstention_rate"))


def common_subset(rows: DataFrame, architectures: list[str], metrics: list[str]) -> DataFrame:
    """Means over the questions on which none of the architectures abstained, for all architectures."""
    ids = rows.where(F.col("architecture").isin(architectures)).groupBy("question_id").agg(F.sum("abstained").alias("s"), F.count("*").alias("n")).where((F.col("s") == 0) & (F.col("n") == len(architectures))).select("question_id")
    return rows.join(ids, "question_id", "left_semi").groupBy("architecture").agg(F.count("*").alias("question_count"), *[F.avg(m).alias(m) for m in metrics])


def quality_summary(rows: DataFrame, labels: list[str]) -> DataFrame:
    """rows (architecture, label, abstained, completeness, bertscore_f1) -> label counts, valid means, means over non-abstained rows, bounds."""
    ok = F.col("label") != "judge_error"
    n = F.count("*")
    right, err = F.sum((F.col("label") == "correct").cast("int")), F.sum((F.col("label") == "judge_error").cast("int"))
    semantic = F.when(ok, (F.col("label") == "correct").cast("int"))
    return rows.groupBy("architecture").agg(
        n.alias("question_count"), *[F.sum((F.col("label") == x).cast("int")).alias(f"{x}_count") for x in labels], F.avg(semantic).alias("semantic_correctness"), F.avg(F.when(ok, F.col("completeness"))).alias("completeness"),
        F.avg(F.when(F.col("abstained") == 0, semantic)).alias("semantic_correctness_non_abstained"), F.avg(F.when(ok & (F.col("abstained") == 0), F.col("completeness"))).alias("completeness_non_abstained"), F.avg("bertscore_f1").alias("bertscore_f1"),
        (right / n).alias("correct_lower"), ((right + err) / n).alias("correct_upper"),
    )


def tradeoff_summary(rows: DataFrame, means: list[str], latency: str) -> DataFrame:
    """Means and counts of the values that are there, and mean and median latency, per architecture."""
    aggs = [a for m in means for a in (F.avg(m).alias(f"{m}_mean"), F.count(m).alias(f"{m}_n"))]
    g = rows.groupBy("architecture").agg(F.count("*").alias("question_count"), *aggs, F.avg(latency).alias("total_latency_mean_ms"))
    return with_quantiles(g, rows, ["architecture"], latency, [0.5]).withColumn("total_latency_median_ms", F.col("q")[0]).drop("q")


def pareto(summary: DataFrame, objectives: list[str], eligible: dict[str, list[str]] | None = None) -> DataFrame:
    """Per objective: nondominated 0/1 and who dominates, in order of architecture. An architecture without a value of the objective stays, with null: nothing is compared with it, so nothing
    dominates it. Summaries have a row per architecture, so the theta join is tiny."""
    out = []
    for o in objectives:
        s = summary.select("architecture", F.col(f"{o}_mean").alias("q"), F.col("total_latency_mean_ms").alias("t"))
        if eligible and o in eligible:
            s = s.where(F.col("architecture").isin(eligible[o]))
        b = F.broadcast(s.select(F.col("architecture").alias("other"), F.col("q").alias("q2"), F.col("t").alias("t2")))
        d = s.join(b, F.expr("q2 >= q and t2 <= t and (q2 > q or t2 < t)"), "left")
        g = d.groupBy("architecture", "q", "t").agg(F.array_join(F.sort_array(F.collect_list("other")), ",").alias("dominated_by"))
        out.append(g.select(F.lit(o).alias("objective"), "architecture", F.col("q").alias("quality_mean"), F.col("t").alias("mean_total_latency_ms"), (F.col("dominated_by") == "").cast("int").alias("pareto_nondominated"), "dominated_by"))
    return reduce(DataFrame.unionByName, out)


def adjacent_pairs(rows: DataFrame, architectures: list[str], metrics: list[str], percent_of: str, skip: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """Per neighbouring architectures and metric the paired means over questions where both have a value; percent change for one metric only. skip: (architecture_a, metric) pairs that don't apply."""
    order = rows.sparkSession.createDataFrame(list(zip(architectures, architectures[1:], strict=False)), "architecture_a string, architecture_b string")
    long = rows.unpivot(["question_id", "architecture"], metrics, "metric", "value")
    a = long.select("question_id", "metric", F.col("architecture").alias("architecture_a"), F.col("value").alias("a")).join(F.broadcast(order), "architecture_a")
    b = long.select("question_id", "metric", F.col("architecture").alias("architecture_b"), F.col("value").alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    p = a.join(b, ["question_id", "metric", "architecture_b"])
    for arch, metric in skip:
        p = p.where(~((F.col("architecture_a") == arch) & (F.col("metric") == metric)))
    ma, mb = F.avg(F.when(both, F.col("a"))), F.avg(F.when(both, F.col("b")))
    g = p.groupBy("architecture_a", "architecture_b", "metric").agg(F.sum(both.cast("int")).alias("pair_count"), F.sum((~both).cast("int")).alias("excluded_pair_count"), ma.alias("mean_a_paired"), mb.alias("mean_b_paired"))
    diff = F.col("mean_b_paired") - F.col("mean_a_paired")
    return g.withColumn("mean_difference_b_minus_a", diff).withColumn("percent_change_from_a", F.when((F.col("metric") == percent_of) & (F.col("mean_a_paired") != 0), 100 * diff / F.col("mean_a_paired")))


def unique_documents(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key; metadata that is not constant within a key raises."""
    bad = [F.when(nunique(c) > 1, F.lit(c)) for c in columns]
    g = rows.groupBy(key).agg(F.concat_ws(",", *bad).alias("_bad"), *[F.max(c).alias(c) for c in columns])
    return g.withColumn("_ok", F.when(F.col("_bad") != "", F.raise_error(F.concat(F.lit("inconsistent metadata: "), F.col("_bad"))).cast("boolean")).otherwise(True)).where("_ok").drop("_bad", "_ok")


def first_per_group(rows: DataFrame, by: list[str], order: list[str], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def spread(rows: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """How many rows a key has: keys, least, most and mean, in all or per value of `by`."""
    n = rows.groupBy(*([by] if by else []), key).agg(F.count("*").alias("n"))
    return n.groupBy(*([by] if by else [])).agg(F.count("*").alias("keys"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def flattened(rows: DataFrame, key: str, items: str) -> DataFrame:
    """(key, pos, the fields of each item) of an array of structs, pos from 0; rows without items have none."""
    return rows.select(key, F.posexplode(items).alias("pos", "_x")).select(key, "pos", "_x.*")


def mismatches(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: for each rule the number of rows for which it is false or null, and rows in all."""
    return rows.agg(F.count("*").alias("rows"), *[F.sum((~F.coalesce(ok, F.lit(False))).cast("int")).alias(name) for name, ok in rules.items()])

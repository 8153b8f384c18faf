"""Paired tests over long metric tables: one row per comparison, all comparisons at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import materialise
from .ranks import quantiles, ranked_values

REPLICATES = 10_000
#: Bytes of resampled places at once, and pairs of a comparison up to which they are drawn one by one in one task.
BLOCK_BYTES, FEW_PAIRS = 64 << 20, 20_000
#: Up to so many tied differences the sign distribution is enumerated; untied ones have an exact distribution up to EXACT.
ENUMERATE, EXACT = 13, 50


# The prespecified comparisons (hypothesis, architecture_a, architecture_b, metric, source, population) and the metrics that are 0 or 1.
PLANNED = (
    ("H0,H1", "P0", "P1", "gold_evidence_support", "faithfulness", "scored_units_only"),
    ("H0", "P0", "P2", "gold_evidence_support", "faithfulness", "scored_units_only"),
    ("H0", "P0", "P3", "gold_evidence_support", "faithfulness", "scored_units_only"),
    ("H0", "P0", "P1", "exact_match", "answer", "all_questions"),
    ("H0", "P0", "P1", "token_f1", "answer", "all_questions"),
    ("H0", "P0", "P1", "numeric_accuracy", "answer", "gold_numeric_questions"),
    ("H0", "P0", "P1", "total_latency_ms", "latency", "all_questions"),
    ("H0", "P0", "P2", "exact_match", "answer", "all_questions"),
    ("H0", "P0", "P2", "token_f1", "answer", "all_questions"),
    ("H0", "P0", "P2", "numeric_accuracy", "answer", "gold_numeric_questions"),
    ("H0", "P0", "P2", "total_latency_ms", "latency", "all_questions"),
    ("H0", "P0", "P3", "exact_match", "answer", "all_questions"),
    ("H0", "P0", "P3", "token_f1", "answer", "all_questions"),
    ("H0", "P0", "P3", "numeric_accuracy", "answer", "gold_numeric_questions"),
    ("H0", "P0", "P3", "total_latency_ms", "latency", "all_questions"),
    ("H2", "P1", "P2", "hit_at_5", "retrieval", "all_questions"),
    ("H2", "P1", "P2", "recall_at_5", "retrieval", "all_questions"),
    ("H2", "P1", "P2", "mrr_at_5", "retrieval", "all_questions"),
    ("H2", "P1", "P2", "numeric_accuracy", "answer", "gold_numeric_questions"),
    ("H3", "P2", "P3", "context_faithfulness", "faithfulness", "scored_units_only"),
    ("H3", "P2", "P3", "total_latency_ms", "latency", "all_questions"),
)
BINARY = ("exact_match", "hit_at_5")


def planned_comparisons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PLANNED), "hypothesis string, architecture_a string, architecture_b string, metric string, source string, population string")


def planned_pairs(rows: DataFrame, comparisons: DataFrame) -> DataFrame:
    """comparisons (hypothesis, architecture_a, architecture_b, metric, ...) with what rows (question_id, architecture, metric, value) have for each: pair_count complete pairs, the
    questions of either side that have none, and both means over the pairs; a comparison without rows has 0."""
    by = ["architecture_a", "architecture_b", "metric"]
    pairs = paired_values(rows, comparisons.select(*by).distinct())
    have = pairs.groupBy(*by).agg(F.count("*").alias("pair_count"), F.avg("a").alias("mean_a_paired"), F.avg("b").alias("mean_b_paired"))
    sides = rows.where("value is not null").groupBy("architecture", "metric").agg(F.count("*").alias("n"))
    side = lambda x: F.broadcast(sides.select(F.col("architecture").alias(f"architecture_{x}"), "metric", F.col("n").alias(f"n_{x}")))
    out = comparisons.join(have, by, "left").join(side("a"), ["architecture_a", "metric"], "left").join(side("b"), ["architecture_b", "metric"], "left")
    n = F.coalesce("pair_count", F.lit(0))
    alone = lambda x: (F.coalesce(f"n_{x}", F.lit(0)) - n).alias(f"unpaired_{x}")
    return out.select(*comparisons.columns, n.alias("pair_count"), alone("a"), alone("b"), "mean_a_paired", "mean_b_paired")


def paired_values(rows: DataFrame, comparisons: DataFrame) -> DataFrame:
    """rows (question_id, architecture, metric, value), comparisons (architecture_a, architecture_b, metric) -> complete pairs with a, b.

    The comparison list is small and broadcast; a value that is not finite raises.
    """
    finite = F.when(F.col("value").isNull() | (~F.isnan("value") & (F.abs("value") < float("inf"))), F.col("value")).otherwise(F.raise_error(F.lit("value is not finite")).cast("double"))
    long = rows.select("question_id", "architecture", "metric", finite.alias("value")).where("value is not null")
    a = long.select("question_id", "metric", F.col("architecture").alias("architecture_a"), F.col("value").alias("a")).join(F.broadcast(comparisons), ["architecture_a", "metric"])
    b = long.select("question_id", "metric", F.col("architecture").alias("architecture_b"), F.col("value").alias("b"))
    return a.join(b, ["question_id", "metric", "architecture_b"])


def _stirling_rest(n: Column) -> Column:
    """ln n! less Stirling's formula, sqrt(2 pi n) (n / e)^n, for n >= 1: the series beyond 15, the logarithms themselves below."""
    exact = F.lit(0.0)
    for k in range(1, 16):
        exact = F.when(n == k, math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi)).otherwise(exact)
    x = F.lit(1.0) / (n * n)
    return F.when(n > 15, (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x * (1 / 1680 - x / 1188)))) / n).otherwise(exact)


def _half_deviance(k: Column, mean: Column) -> Column:
    """k ln(k / mean) + mean - k, the part of a binomial term that its distance from the mean costs; by a series where both are near."""
    v = (k - mean) / (k + mean)
    term, total = 2 * k * v, (k - mean) * v
    for j in range(1, 13):
        term = term * v * v
        total = total + term / (2 * j + 1)
    return F.when(F.abs(k - mean) < 0.1 * (k + mean), total).otherwise(k * F.log(k / mean) + mean - k)


def binomial_half(k: Column, n: Column) -> Column:
    """P(X <= k) for X binomial(n, 1/2) and k <= n / 2: the term of k by its distance from the mean, which loses no digits for large n, and the terms under it by
    their ratios as far as they count, about 7 sqrt(n) of them."""
    k, n = k.cast("double"), n.cast("double")
    log_term = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - _half_deviance(k, n / 2) - _half_deviance(n - k, n / 2) + 0.5 * F.log(n / (2 * math.pi * k * (n - k)))
    term = F.when(k == 0, F.exp(-n * math.log(2))).otherwise(F.exp(log_term))
    steps = F.least(k, F.ceil(7 * F.sqrt(n)) + 60).cast("int")
    down = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.slice(F.sequence(F.lit(1), F.lit(1)), 1, 0))
    series = F.aggregate(
        down, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * (k - i) / (n - k + 1 + i)).alias("term"), (s["sum"] + s["term"] * (k - i) / (n - k + 1 + i)).alias("sum")), lambda s: s["sum"],
    )
    return term * series


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Exact two-sided test on binary pairs; p is 1 without discordant ones. Values other than 0 and 1 raise."""
    ok = F.col("a").isin(0, 1) & F.col("b").isin(0, 1)
    x = F.when(ok, F.col("a")).otherwise(F.raise_error(F.lit("pairs must be 0 or 1")).cast("double"))
    g = pairs.groupBy(*by).agg(F.count("*").alias("pair_count"), F.sum(((x == 1) & (F.col("b") == 0)).cast("int")).alias("a_only"), F.sum(((x == 0) & (F.col("b") == 1)).cast("int")).alias("b_only"))
    n = F.col("a_only") + F.col("b_only")
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_half(F.least("a_only", "b_only"), n)))
    return g.withColumn("p_value", p)


def signed_ranks(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per comparison with a nonzero difference: n of them, w_plus and w_minus (sums of average ranks of sizes), distinct sizes, ties (the sum of t^3 - t) and,
    for up to EXACT differences, t (how many share each size, by rising size). Ranks are counted over ranges of (comparison, size), so no task has all pairs of one."""
    d = pairs.withColumn("d", F.col("b") - F.col("a")).where("d <> 0").withColumn("size", F.abs("d"))
    r = ranked_values(d, by, "size", plus=(F.col("d") > 0).cast("long")).withColumn("r", F.col("before") + (F.col("n") + 1) / 2)
    cube = F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")
    few = F.when(F.col("total") <= EXACT, F.struct("size", "n"))
    return r.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("plus") * F.col("r")).alias("w_plus"), F.sum((F.col("n") - F.col("plus")) * F.col("r")).alias("w_minus"), F.count("*").alias("distinct"), F.sum(cube).alias("ties"),
        F.transform(F.sort_array(F.collect_list(few)), lambda x: x["n"]).alias("t"),
    )


def rank_biserial(pairs: DataFrame, by: list[str], ranks: DataFrame | None = None) -> DataFrame:
    """(W+ - W-) / (W+ + W-) over nonzero differences with average ranks; 0 without any. ranks: signed_ranks() of the pairs, if they are there already."""
    g = (signed_ranks(pairs, by) if ranks is None else ranks).select(*by, "w_plus", "w_minus")
    out = pairs.groupBy(*by).agg(F.count("*").alias("pair_count"), F.avg(F.col("b") - F.col("a")).alias("mean_difference")).join(g, by, "left")
    plus, minus = F.coalesce("w_plus", F.lit(0.0)), F.coalesce("w_minus", F.lit(0.0))
    return out.select(*by, "pair_count", "mean_difference", plus.alias("w_plus"), minus.alias("w_minus"), F.when(plus + minus > 0, (plus - minus) / (plus + minus)).otherwise(0.0).alias("effect"))


def rank_sum_p(low: float, n: int, distinct: int, ties: float, shared: list[int]) -> float:
    """Two-sided p of a signed-rank sum `low` (the smaller one) of n nonzero differences: exact without ties, enumerated for few tied ones, else normal with tie correction."""
    if not n:
        return 1.0
    if distinct == n and n <= EXACT:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    if n <= ENUMERATE:
        counts = np.array(shared)
        ranks = np.repeat(np.cumsum(counts) - (counts - 1) / 2, counts)
        sums = ((np.arange(2**n)[:, None] >> np.arange(n)) & 1) @ ranks
        return float(min(1.0, 2 * (sums <= low + 1e-9).mean()))
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return float(min(1.0, math.erfc((n * (n + 1) / 4 - low) / sd / math.sqrt(2)))) if sd else 1.0


def signed_rank_p(d: np.ndarray) -> float:
    """rank_sum_p() of differences; zeros are dropped."""
    d = d[d != 0]
    _, inverse, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    plus = ranks[d > 0].sum()
    return rank_sum_p(min(plus, ranks.sum() - plus), len(d), len(counts), float((counts.astype(float) ** 3 - counts).sum()), counts.tolist())


def wilcoxon(ranks: DataFrame, by: list[str]) -> DataFrame:
    """signed_ranks() -> by, wilcoxon_p: a row per comparison, whose p needs its sums alone."""

    def p(low: pd.Series, n: pd.Series, distinct: pd.Series, ties: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([rank_sum_p(*row) for row in zip(low, n, distinct, ties, t, strict=True)], dtype=float)

    return ranks.select(*by, F.pandas_udf(p, "double")(F.least("w_plus", "w_minus"), "n", "distinct", "ties", "t").alias("wilcoxon_p"))


def bootstrap_ci(d: np.ndarray, seed: int, replicates: int = REPLICATES) -> tuple[float, float]:
    """Percentile interval of the mean; the stream of resamples is the same however they are cut into blocks, which hold BLOCK_BYTES of indices at most."""
    rng = np.random.default_rng(seed)
    means, step = [], max(1, BLOCK_BYTES // (8 * len(d)))
    for at in range(0, replicates, step):
        means.append(d[rng.integers(0, len(d), size=(min(step, replicates - at), len(d)))].mean(axis=1))
    lo, hi = np.quantile(np.concatenate(means), [0.025, 0.975])
    return float(lo), float(hi)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def resample_counts(keys: np.ndarray, replicates: int) -> np.ndarray:
    """How often each pair (64-bit key) is drawn in each replicate: Poisson with mean 1, from 16 bits of splitmix64 started at the key; four replicates a number. A pair's
    counts depend on its key alone, so any task may draw them."""
    numbers = -(-replicates // 4)
    with np.errstate(over="ignore"):
        steps = np.arange(1, numbers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = _mix(keys.astype(np.uint64)[:, None] + steps[None])
    return _DRAWN[x.astype("<u8", copy=False).view("<u2")[:, :replicates]]


#: Count for each value of 16 bits: as many values as the Poisson distribution with mean 1 has of 65536.
_UPTO = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])
_DRAWN = np.searchsorted(np.floor(_UPTO * 65536), np.arange(65536), side="right").astype(np.uint8)


def pair_keys(by: list[str], run_id: str, order: str) -> Column:
    """The first 8 bytes of the SHA-256 of run, comparison and pair."""
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", F.lit(run_id), *by, F.col(order).cast("string")), 256), 1, 16))


def resampled_means(pairs: DataFrame, by: list[str], run_id: str, order: str = "question_id", replicates: int = REPLICATES) -> DataFrame:
    """by, replicate, mean: the means of Poisson resamples of the differences. Each task adds its pairs to one sum and one count per replicate and comparison, and only these are
    shuffled, so a comparison may have any number of pairs."""
    names = ", ".join(f"{c} string" for c in by)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            group = list(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True))
            d = b.column(len(by)).to_numpy()
            keys = np.frombuffer(b"".join(b.column(len(by) + 1).to_pylist()), ">u8").astype(np.uint64)
            places: dict[tuple, list[int]] = {}
            for i, g in enumerate(group):
                places.setdefault(g, []).append(i)
            for g, at in places.items():
                into = sums.setdefault(g, np.zeros((2, replicates)))
                for a in range(0, len(at), 128):
                    some = np.array(at[a : a + 128])
                    counts = resample_counts(keys[some], replicates).astype(np.float64)
                    into += np.stack([d[some], np.ones(len(some))]) @ counts
        for g, (total, n) in sums.items():
            columns = [pa.array([x] * replicates, pa.string()) for x in g]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(replicates), pa.int32()), pa.array(total), pa.array(n)], names=[*by, "replicate", "total", "n"])

    rows = pairs.select(*[F.col(c).cast("string") for c in by], (F.col("b") - F.col("a")).cast("double").alias("d"), pair_keys(by, run_id, order).alias("key"))
    drawn = rows.mapInArrow(run, f"{names}, replicate int, total double, n double")
    return drawn.groupBy(*by, "replicate").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").select(*by, "replicate", (F.col("total") / F.col("n")).alias("mean"))


def bootstrap(pairs: DataFrame, by: list[str], run_id: str, order: str = "question_id", most: int = FEW_PAIRS) -> DataFrame:
    """by, ci_low, ci_high: the percentile interval of the mean difference. Comparisons of up to `most` pairs are resampled as bootstrap_ci() does, with a seed from their name, one task
    each; larger ones through resampled_means()."""
    sizes = materialise(pairs.groupBy(*by).agg(F.count("*").alias("_n")), "sizes")
    few, many = (pairs.join(F.broadcast(sizes.where(which).select(*by)), by, "left_semi") for which in (f"_n <= {most}", f"_n > {most}"))
    names = ", ".join(f"{c} string" for c in by)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = (rows["b"] - rows["a"]).to_numpy()[np.argsort(rows[order].to_numpy(), kind="stable")]
        seed = int.from_bytes(hashlib.sha256(":".join([run_id, *map(str, key)]).encode()).digest()[:8], "big")
        return pd.DataFrame([[*map(str, key), *bootstrap_ci(d, seed)]])

    small_ones = few.groupBy(*by).applyInPandas(run, f"{names}, ci_low double, ci_high double")
    if sizes.where(f"_n > {most}").isEmpty():
        return small_ones
    q = quantiles(resampled_means(many, by, run_id, order), by, ["mean"], [0.025, 0.975])
    return small_ones.unionByName(q.select(*by, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high")))


def wilcoxon_and_bootstrap(pairs: DataFrame, by: list[str], run_id: str, order: str = "question_id", ranks: DataFrame | None = None) -> DataFrame:
    """by, pair_count, wilcoxon_p (1 without a nonzero difference), ci_low, ci_high per comparison."""
    n = pairs.groupBy(*by).agg(F.count("*").alias("pair_count"))
    p = wilcoxon(signed_ranks(pairs, by) if ranks is None else ranks, by)
    out = n.join(p, by, "left").join(bootstrap(pairs, by, run_id, order), by)
    return out.select(*by, "pair_count", F.coalesce("wilcoxon_p", F.lit(1.0)).alias("wilcoxon_p"), "ci_low", "ci_high")


def holm(rows: DataFrame, p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """Adds holm_p and significant over all rows, which are one per test: a handful, so one window partition holds them."""
    w = Window.orderBy(p, tie)
    m = rows.agg(F.count("*").alias("_m"))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_k") + 1) * F.col(p))
    out = rows.crossJoin(F.broadcast(m)).withColumn("_k", F.row_number().over(w)).withColumn("_s", step)
    out = out.withColumn("holm_p", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.withColumn("significant", F.col("holm_p") < alpha).drop("_m", "_k", "_s")


def evaluate(rows: DataFrame, comparisons: DataFrame, run_id: str, question_count: int, binary: tuple[str, ...] = BINARY, alpha: float = 0.05) -> DataFrame:
    """The table of paired tests: rows (question_id, architecture, metric, value) and comparisons (hypothesis, architecture_a, architecture_b, metric, population) -> one row per comparison
    with pair_count, excluded_pair_count, both means over complete pairs, their mean difference with its bootstrap interval, the test and its p-value, Holm's over all, and effect or successes.

    McNemar for binary metrics, else the signed rank. A comparison without a complete pair raises.
    """
    by = ["architecture_a", "architecture_b", "metric"]
    pairs = paired_values(rows, comparisons.select(*by).distinct())
    empty = comparisons.select(*by).join(pairs.select(*by).distinct(), by, "left_anti").limit(3).collect()
    if empty:
        raise ValueError("no complete pairs: " + "; ".join("/".join(r) for r in empty))
    means = pairs.groupBy(*by).agg(F.count("*").alias("pair_count"), F.avg("a").alias("mean_a_paired"), F.avg("b").alias("mean_b_paired"), F.avg(F.col("b") - F.col("a")).alias("mean_difference_b_minus_a"))
    is_binary = F.col("metric").isin(*binary)
    yes = mcnemar(pairs.where(is_binary), by).select(*by, F.col("p_value").alias("_mcnemar"), "a_only", "b_only")
    ranks = materialise(signed_ranks(pairs, by), "ranks")
    effect = rank_biserial(pairs.where(~is_binary), by, ranks).select(*by, "effect")
    drawn = wilcoxon_and_bootstrap(pairs, by, run_id, ranks=ranks).select(*by, "wilcoxon_p", "ci_low", "ci_high")
    out = comparisons.join(means, by).join(drawn, by).join(yes, by, "left").join(effect, by, "left")
    out = out.select(
        F.lit(run_id).alias("run_id"), "hypothesis", *by, "population", F.when(is_binary, "McNemar exact, two-sided").otherwise("Wilcoxon signed-rank, two-sided").alias("test"),
        "pair_count", (question_count - F.col("pair_count")).alias("excluded_pair_count"), "mean_a_paired", "mean_b_paired", "mean_difference_b_minus_a", F.col("ci_low").alias("difference_ci95_low"),
        F.col("ci_high").alias("difference_ci95_high"), F.when(is_binary, F.col("_mcnemar")).otherwise(F.col("wilcoxon_p")).alias("p_value_two_sided"), F.when(~is_binary, F.col("effect")).alias("rank_biserial_b_minus_a"),
        F.col("a_only").alias("a_only_success"), F.col("b_only").alias("b_only_success"), F.concat_ws("|", "hypothesis", *by).alias("_tie"),
    )
    out = holm(out, "p_value_two_sided", "_tie", alpha)
    return out.withColumn("significant_holm", F.col("significant").cast("int")).withColumnRenamed("holm_p", "holm_p_value").drop("_tie", "significant")

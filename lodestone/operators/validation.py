"""Joins that must be complete, and rules that hold between stages. Rules give violations (rule, key, detail), as checks does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import _violations, coverage, duplicate_keys, enforce, together

KEYS = ["architecture", "question_id"]
# States of a manifest row whose document is on disk, and the label where a judge failed.
LOCAL = ("downloaded", "skipped_existing")
JUDGE_ERROR = "judge_error"


def evidence_pages(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """evidence (question_id, item, doc_name, page, ...) with the text of its page, page_text, and found; found is false where the page is missing."""
    p = pages.select("doc_name", "page", F.col("text").alias("page_text"), F.lit(True).alias("found"))
    return evidence.join(p, ["doc_name", "page"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def missing_pages(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Evidence that names no page, or one that is not there; pages that are there twice."""
    joined = evidence_pages(evidence, pages.dropDuplicates(["doc_name", "page"]))
    why = F.when(F.col("doc_name").isNull() | F.col("page").isNull(), "no_page_named").otherwise(F.concat(F.col("doc_name"), F.lit(":"), F.col("page").cast("string")))
    gone = _violations(joined.where(~F.col("found")), "missing_page", F.concat_ws("|", F.col("question_id").cast("string"), F.col("item").cast("string")), why)
    return gone.unionByName(duplicate_keys(pages, ["doc_name", "page"], "duplicate_page"))


def require_pages(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """evidence_pages(), but a page that is missing or there twice raises."""
    enforce(missing_pages(evidence, pages))
    return evidence_pages(evidence, pages).drop("found")


def manifest_violations(required: DataFrame, manifest: DataFrame) -> DataFrame:
    """required (doc_name), manifest (doc_name, download_status): documents that the manifest lacks or has twice, or that are not on disk."""
    need = required.select("doc_name").distinct()
    have = manifest.select("doc_name", "download_status").join(need, "doc_name", "left_semi")
    lost = _violations(need.join(have, "doc_name", "left_anti"), "not_in_manifest", F.col("doc_name"), F.lit("missing"))
    bad = _violations(have.where(~F.coalesce(F.col("download_status").isin(*LOCAL), F.lit(False))), "not_on_disk", F.col("doc_name"), F.coalesce("download_status", F.lit("null")))
    return together(lost, bad, duplicate_keys(have, ["doc_name"], "twice_in_manifest"))


def corpus_manifest(required: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows of the required documents; raises if one is missing, twice there or not on disk."""
    enforce(manifest_violations(required, manifest))
    return manifest.join(required.select("doc_name").distinct(), "doc_name", "left_semi")


def extraction_violations(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """manifest (doc_name, pdf_pages), pages (doc_name, page, extraction_status): documents without pages, with another number than declared, or with pages that failed."""
    n = pages.groupBy("doc_name").agg(F.count("*").alias("_n"), F.sum(F.startswith(F.coalesce("extraction_status", F.lit("")), F.lit("error")).cast("int")).alias("_e"))
    j = manifest.select("doc_name", "pdf_pages").join(n, "doc_name", "left").select("doc_name", "pdf_pages", F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_e", F.lit(0)).alias("_e"))
    none = _violations(j.where("_n = 0"), "no_pages", F.col("doc_name"), F.lit("0"))
    count = _violations(j.where("_n > 0 and pdf_pages is not null and _n <> pdf_pages"), "page_count", F.col("doc_name"), F.concat_ws("/", F.col("pdf_pages").cast("string"), F.col("_n").cast("string")))
    failed = _violations(j.where("_e > 0"), "page_error", F.col("doc_name"), F.col("_e"))
    return together(none, count, failed)


def extraction_summary(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: documents, pages, empty_text_pages, nonempty_text_pages of the manifest's documents."""
    p = pages.join(manifest.select("doc_name").distinct(), "doc_name", "left_semi")
    empty = F.sum((F.col("extraction_status") == "empty").cast("int"))
    per = p.groupBy("doc_name").agg(F.count("*").alias("n"), empty.alias("e"))
    return per.agg(F.count("*").alias("documents"), F.sum("n").alias("pages"), F.sum("e").alias("empty_text_pages"), (F.sum("n") - F.sum("e")).alias("nonempty_text_pages"))


def extract_corpus(required: DataFrame, manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of the required documents with what the manifest says of each; raises unless manifest and page counts hold."""
    chosen = corpus_manifest(required, manifest)
    mine = pages.join(chosen.select("doc_name"), "doc_name", "left_semi")
    enforce(extraction_violations(chosen, mine))
    more = [c for c in chosen.columns if c not in pages.columns or c == "doc_name"]
    return mine.join(chosen.select(*more), "doc_name")


def assemble_quality(answers: DataFrame, judgments: DataFrame, similarity: DataFrame) -> DataFrame:
    """answers, judgments (label null where the judge failed, with judge_error) and similarity, one row each per architecture and question -> side by side.

    All three must have the same keys, once each, else it raises. A failed judgment has the label judge_error, null scores, and its error as rationale."""
    rules = [duplicate_keys(d, KEYS, f"duplicate_{n}") for n, d in (("answer", answers), ("judgment", judgments), ("similarity", similarity))]
    enforce(together(*rules, coverage(judgments, answers, KEYS, "judgment_coverage"), coverage(similarity, answers, KEYS, "similarity_coverage")))
    j = judgments.withColumn("rationale", F.when(F.col("label").isNull(), F.col("judge_error")).otherwise(F.col("rationale"))).withColumn("label", F.coalesce("label", F.lit(JUDGE_ERROR))).drop("judge_error")
    return answers.join(j, KEYS).join(similarity, KEYS)


def another_run(df: DataFrame, run_id: str, key: Column, rule: str = "another_run") -> DataFrame:
    return _violations(df.where(~F.coalesce(F.col("run_id") == run_id, F.lit(False))), rule, key, F.coalesce("run_id", F.lit("null")))


def category_violations(categories: DataFrame, architectures: list[str], declared: DataFrame | None = None) -> DataFrame:
    """categories (grouping, category, architecture, question_count): repeated rows, categories that lack an architecture or have an unknown one, unequal counts, and
    groupings whose questions (of the first architecture) are not as many as declared (grouping, question_count)."""
    g = categories.groupBy("grouping", "category").agg(F.array_sort(F.collect_set("architecture")).alias("a"), F.count_distinct("question_count").alias("m"))
    key = F.concat_ws("|", "grouping", "category")
    wrong = _violations(g.where(F.col("a") != F.array(*[F.lit(x) for x in sorted(architectures)])), "incomplete_category", key, F.array_join("a", ","))
    uneven = _violations(g.where("m <> 1"), "unequal_counts", key, F.col("m"))
    out = together(duplicate_keys(categories, ["grouping", "category", "architecture"], "duplicate_category"), wrong, uneven)
    if declared is None:
        return out
    n = categories.where(F.col("architecture") == architectures[0]).groupBy("grouping").agg(F.sum("question_count").alias("_n"))
    j = declared.select("grouping", F.col("question_count").alias("_d")).join(n, "grouping", "full_outer").where("not (_n <=> _d)")
    return out.unionByName(_violations(j, "category_coverage", F.col("grouping"), F.concat_ws("/", F.coalesce("_d", F.lit(0)).cast("string"), F.coalesce("_n", F.lit(0)).cast("string"))))


def abstention_violations(summary: DataFrame, scores: DataFrame) -> DataFrame:
    """summary (architecture, question_count, exact_abstention_count, context_scored_count, gold_scored_count) against per-question scores
    (architecture, abstained, context_score, gold_score): architectures of which a count disagrees or that one side lacks."""
    s = scores.groupBy("architecture").agg(F.count("*").alias("_q"), F.sum("abstained").alias("_a"), F.count("context_score").alias("_c"), F.count("gold_score").alias("_g"))
    pairs = [("question_count", "_q"), ("exact_abstention_count", "_a"), ("context_scored_count", "_c"), ("gold_scored_count", "_g")]
    j = summary.select("architecture", *[a for a, _ in pairs]).join(s, "architecture", "full_outer")
    far = F.concat_ws(",", *[F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(a)) for a, b in pairs])
    return _violations(j.where(far != ""), "abstention_counts", F.col("architecture"), far)


def journal_violations(journal: DataFrame, keys: list[str], expected: dict[str, str], sources: DataFrame | None = None, digests: list[str] = ()) -> DataFrame:
    """Journal rows that repeat a key, were made with another model or protocol than expected, or from sources whose digests have changed (or are gone)."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    off = F.concat_ws(",", *[F.when(~F.coalesce(F.col(c) == v, F.lit(False)), F.lit(c)) for c, v in expected.items()])
    out = together(duplicate_keys(journal, keys, "duplicate_entry"), _violations(journal.where(off != ""), "journal_protocol", key, off))
    if sources is None:
        return out
    j = journal.join(sources.select(*keys, *[F.col(c).alias(f"_{c}") for c in digests]), keys, "left")
    changed = F.concat_ws(",", *[F.when(~F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False)), F.lit(c)) for c in digests])
    return out.unionByName(_violations(j.where(changed != ""), "journal_source", key, changed))


def stage_identity(df: DataFrame, by: list[str], member: str, inner: str, outer: str, identity: list[str], rule: str = "stage_identity") -> DataFrame:
    """Members (by and member) of the inner stage that the outer one lacks, that differ there in a column of identity, or whose rank there is before that of the member in front of them
    in the inner stage (order)."""
    keep = [*by, member, "rank", *identity]
    a = df.where(F.col("stage") == inner).select(*keep)
    b = df.where(F.col("stage") == outer).select(*by, member, F.col("rank").alias("_rank"), *[F.col(c).alias(f"_{c}") for c in identity])
    j = a.join(b, [*by, member], "left")
    front = Window.partitionBy(*by).orderBy("rank", member).rowsBetween(Window.unboundedPreceding, -1)
    j = j.withColumn("_back", F.col("_rank") < F.max("_rank").over(front))
    there = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in identity]
    why = F.when(F.col("_rank").isNull(), "absent").otherwise(F.concat_ws(",", *there, F.when(F.col("_back"), F.lit("order"))))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, member]])
    return _violations(j.withColumn("_why", why).where("_why <> ''"), rule, key, F.col("_why"))


def saved_selection(df: DataFrame, by: list[str], identity: list[str], selection: str, final: str, n: int, rule: str = "saved_selection") -> DataFrame:
    """Places up to n at which the final stage does not hold what the selection's first n hold, in order: place by place, both sides."""
    keep = [*by, "rank", *identity]
    a = df.where((F.col("stage") == selection) & (F.col("rank") <= n)).select(*keep, F.lit(True).alias("_a"))
    b = df.where(F.col("stage") == final).select(*by, "rank", *[F.col(c).alias(f"_{c}") for c in identity], F.lit(True).alias("_b"))
    j = a.join(b, [*by, "rank"], "full")
    differ = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in identity])
    why = F.when(F.col("_b").isNull(), "not_in_final").when(F.col("_a").isNull(), "not_selected").otherwise(differ)
    return _violations(j.withColumn("_why", why).where("_why <> ''"), rule, F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, "rank"]]), F.col("_why"))


def support_rules(rows: DataFrame, source: str, support: str, proxy: str, key: Column, inapplicable: list[str] = (), tolerance: float = 1e-12) -> DataFrame:
    """rows (architecture, abstained, <source>_claim_count, <source>_supported_count, support, proxy): scores where the source does not apply, counts that cannot be (missing, negative,
    more supported than there are, any for an exact abstention), scores without units, and scores that are not the share of supported units and its complement."""
    n, s = F.col(f"{source}_claim_count"), F.col(f"{source}_supported_count")
    values = [n, s, F.col(support), F.col(proxy)]
    nothing = values[0].isNull() & values[1].isNull() & values[2].isNull() & values[3].isNull()
    skipped = F.col("architecture").isin(*inapplicable) if inapplicable else F.lit(False)
    far = lambda a, b: ~F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))
    bad_count = n.isNull() | s.isNull() | (n < 0) | (s < 0) | (s > n) | ((F.col("abstained") == 1) & (n > 0))
    why = (
        F.when(skipped, F.when(~nothing, "not_applicable")).when(nothing & (F.col("abstained") == 1), None).when(bad_count, "unit_counts")
        .when(n == 0, F.when(F.col(support).isNotNull() | F.col(proxy).isNotNull(), "scores_without_units")).when(far(F.col(support), s / n) | far(F.col(proxy), 1 - F.col(support)), "support_disagrees")
    )
    return _violations(rows.withColumn("_why", why).where("_why is not null"), f"{source}_support", key, F.col("_why"))


def stage_inputs(
    run_id: str, summaries: dict[str, tuple[DataFrame, list[str]]], latency: DataFrame, categories: DataFrame, architectures: list[str], declared: DataFrame, tables: dict[str, tuple[DataFrame, int]],
    equal: list[tuple[str, str, str, str]], tolerance: float = 1e-9,
) -> DataFrame:
    """All that must hold between the tables of an evaluation before a report may be made of them, in one table of violations.

    summaries: name -> (rows with run_id and architecture, the architectures it must have, once each). latency (run_id, architecture, component, ...): one row per
    architecture and component, a total for each. categories and declared: as in category_violations(). tables: name -> (rows with run_id, how many there must be).
    equal: (summary, column, summary, column) pairs that must agree for every architecture that both have; the summary "latency" stands for the totals.
    """
    key = F.coalesce("architecture", F.lit("null"))
    out = []
    for name, (rows, names) in summaries.items():
        spine = rows.sparkSession.createDataFrame([(a,) for a in names], "architecture string")
        out += [another_run(rows, run_id, F.concat(F.lit(f"{name}|"), key)), duplicate_keys(rows.withColumn("table", F.lit(name)), ["table", "architecture"], "duplicate_row")]
        out.append(coverage(rows.select(F.concat(F.lit(f"{name}|"), key).alias("k")).distinct(), spine.select(F.concat(F.lit(f"{name}|"), F.col("architecture")).alias("k")), ["k"], "architecture_rows"))
    totals = latency.where("component = 'total'")
    spine = latency.sparkSession.createDataFrame([(a,) for a in architectures], "architecture string")
    out += [another_run(latency, run_id, F.concat_ws("|", F.lit("latency"), key, "component")), duplicate_keys(latency, ["architecture", "component"], "duplicate_latency")]
    out.append(_violations(spine.join(totals.select("architecture"), "architecture", "left_anti"), "no_total_latency", F.col("architecture"), F.lit("total")))
    out += [another_run(categories, run_id, F.concat_ws("|", F.lit("categories"), "grouping", "category", key)), category_violations(categories, architectures, declared)]
    for name, (rows, n) in tables.items():
        out.append(another_run(rows, run_id, F.lit(name)))
        out.append(_violations(rows.agg(F.count("*").alias("_n")).where(F.col("_n") != n), "row_count", F.lit(name), F.concat_ws("/", F.lit(n), F.col("_n"))))
    sides = {**{name: rows for name, (rows, _) in summaries.items()}, "latency": totals}
    for a, x, b, y in equal:
        j = sides[a].select("architecture", F.col(x).cast("double").alias("_x")).join(sides[b].select("architecture", F.col(y).cast("double").alias("_y")), "architecture")
        far = j.where(~F.coalesce(F.abs(F.col("_x") - F.col("_y")) <= tolerance, F.col("_x").isNull() & F.col("_y").isNull()))
        out.append(_violations(far, "cross_stage", F.col("architecture"), F.lit(f"{a}.{x}/{b}.{y}")))
    return together(*out)


def question_records(df: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """Records without an id or with a blank question."""
    why = F.concat_ws(",", F.when(F.col(id_col).isNull(), F.lit(id_col)), F.when(F.coalesce(F.regexp_replace(text_col, r"(?U)\s+", ""), F.lit("")) == "", F.lit(text_col)))
    return _violations(df.withColumn("_why", why).where("_why <> ''"), "question_record", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("_why"))


def chunk_records(chunks: DataFrame, required: list[str], text_col: str = "retrieval_text") -> DataFrame:
    """Chunks that lack a required field, repeat an id, or have a blank text."""
    key = F.coalesce(F.col("chunk_id").cast("string"), F.lit("null"))
    lack = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    blank = chunks.where(F.coalesce(F.regexp_replace(text_col, r"(?U)\s+", ""), F.lit("")) == "")
    return together(_violations(chunks.withColumn("_lack", lack).where("_lack <> ''"), "missing_field", key, F.col("_lack")), duplicate_keys(chunks.where("chunk_id is not null"), ["chunk_id"], "duplicate_chunk"), _violations(blank, "blank_text", key, F.lit(text_col)))

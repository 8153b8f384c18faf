"""Claim support and whole-answer judgments: model responses parsed strictly, then guarded by deterministic rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import financial_spans, number_keys
from ..functions.text import is_abstention, strip

ASSESSMENTS = "array<struct<unit_id:string,factual:boolean,supported:boolean,support_type:string,evidence_ids:array<string>,derivation:string>>"
# Labels and statuses that judgments may use.
SUPPORT_TYPES = ("direct", "arithmetic", "unsupported")
LABELS = ("correct", "partially_correct", "incorrect", "failure_to_answer")
STATUSES = ("answered", "incorrect", "missing")
# Why a guard turned support off.
GUARDS = {
    "missing": "missing_unit_assessment",
    "conflict": "support_type_conflict",
    "unknown": "missing_or_unknown_evidence_id",
    "premise": "arithmetic_premise_not_cited",
    "absent": "financial_number_absent_from_passage",
    "nonfactual": "financial_unit_marked_nonfactual",
}


def parse_assessments(payload: Column) -> Column:
    """The response's assessments; null where the response is malformed, so that callers can reject it."""
    a = F.from_json(payload, f"struct<assessments:{ASSESSMENTS}>", {"mode": "PERMISSIVE"})["assessments"]
    whole = F.forall(a, lambda x: x["unit_id"].isNotNull() & x["factual"].isNotNull() & x["supported"].isNotNull() & x["support_type"].isin(*SUPPORT_TYPES) & x["derivation"].isNotNull() & x["evidence_ids"].isNotNull() & F.forall(x["evidence_ids"], lambda e: e.isNotNull()))
    return F.when(whole, a)


def guard_claims(df: DataFrame, units: str = "units", passages: str = "passages", assessments: str = "assessments") -> DataFrame:
    """Adds claims, nonfactual_unit_ids and unknown_or_duplicate_unit_ids to rows with units (array of unit_id, text), passages (array of evidence_id, text) and
    assessments. The first assessment of a unit counts. A guard may only turn support off; the first that applies names its reason.
    """
    u, p, a = F.col(units), F.col(passages), F.col(assessments)
    ids = F.transform(a, lambda x: x["unit_id"])
    known = F.transform(u, lambda x: x["unit_id"])
    odd = F.transform(F.filter(F.transform(a, lambda x, i: F.struct(x["unit_id"].alias("id"), (~F.array_contains(known, x["unit_id"]) | (F.array_position(ids, x["unit_id"]) < i + 1)).alias("bad"))), lambda x: x["bad"]), lambda x: x["id"])
    text_of = F.map_from_entries(F.transform(p, lambda x: F.struct(x["evidence_id"], x["text"])))

    def judged(unit: Column) -> Column:
        x = F.get(F.filter(a, lambda y: y["unit_id"] == unit["unit_id"]), F.lit(0))
        return F.struct(unit["unit_id"].alias("unit_id"), unit["text"].alias("text"), x.alias("x"), F.transform(x["evidence_ids"], strip).alias("cited"), financial_spans(unit["text"]).alias("spans"))

    def numbers(unit: Column, texts: Column) -> Column:
        cited_text = F.array_join(F.transform(unit["cited"], lambda e: F.coalesce(F.element_at(texts, e), F.lit(""))), "\n")
        asked = (F.size(unit["spans"]) > 0) | (unit["x"]["support_type"] == "arithmetic")
        unknown = (F.size(unit["cited"]) == 0) | F.exists(unit["cited"], lambda e: ~F.array_contains(F.map_keys(texts), e))
        return F.struct(*[unit[c].alias(c) for c in ("unit_id", "text", "x", "spans")], unknown.alias("unknown"), F.when(asked, number_keys(cited_text)).alias("keys"))

    def reasoned(unit: Column) -> Column:
        x, keys = unit["x"], unit["keys"]
        absent = F.exists(unit["spans"], lambda s: F.size(F.array_except(number_keys(s), keys)) > 0)
        premises = number_keys(F.split(x["derivation"], "=")[0])
        weak = (strip(x["derivation"]) == "") | (F.size(premises) == 0) | (F.size(F.array_except(premises, keys)) > 0)
        on = x["supported"]
        reason = (
            F.when(x.isNull(), GUARDS["missing"]).when(~x["factual"], GUARDS["nonfactual"]).when(on & (x["support_type"] == "unsupported"), GUARDS["conflict"])
            .when(on & unit["unknown"], GUARDS["unknown"]).when(on & (x["support_type"] == "direct") & absent, GUARDS["absent"])
            .when(on & (x["support_type"] == "arithmetic") & weak, GUARDS["premise"]).otherwise("")
        )
        return F.struct(*[unit[c].alias(c) for c in ("unit_id", "text", "x", "spans")], reason.alias("reason"))

    def claim(unit: Column) -> Column:
        x, on, reason = unit["x"], unit["x"]["supported"], unit["reason"]
        return F.struct(
            unit["unit_id"].alias("unit_id"), unit["text"].alias("claim"), F.coalesce(on, F.lit(False)).alias("judge_supported"), (F.coalesce(on, F.lit(False)) & (reason == "")).alias("supported"),
            F.coalesce(x["support_type"], F.lit("unsupported")).alias("support_type"), reason.alias("guard_reason"), (x.isNotNull() & ~F.coalesce(x["factual"], F.lit(True)) & (F.size(unit["spans"]) == 0)).alias("nonfactual"),
        )

    # a step's results are the next one's argument, so each is made once for a unit; the passages by their ids once for a row
    given = F.get(F.transform(F.array(text_of), lambda texts: F.transform(F.transform(u, judged), lambda unit: numbers(unit, texts))), F.lit(0))
    d = df.withColumn("_all", F.transform(F.transform(given, reasoned), claim))
    return d.withColumn("claims", F.filter("_all", lambda x: ~x["nonfactual"])).withColumn("nonfactual_unit_ids", F.transform(F.filter("_all", lambda x: x["nonfactual"]), lambda x: x["unit_id"])).withColumn("unknown_or_duplicate_unit_ids", odd).drop("_all")


def claim_rows(guarded: DataFrame, keep: list[str], claims: str = "claims") -> DataFrame:
    """A row per claim: keep and the claim's fields. explode_outer(), as for explode() Spark first filters by the size of claims, in an expression of its own that makes them once more,
    with all they come from written out in every place."""
    return guarded.select(*keep, F.explode_outer(claims).alias("_c")).where("_c is not null").select(*keep, "_c.*")


def claim_scores(df: DataFrame, claims: str = "claims") -> DataFrame:
    """Adds claim_count, supported_count, score (null without claims), hallucination, guard_override_count."""
    n, s = F.size(claims), F.size(F.filter(claims, lambda x: x["supported"]))
    return df.withColumn("claim_count", n).withColumn("supported_count", s).withColumn("score", F.when(n > 0, s / n)).withColumn("hallucination", F.when(n > 0, 1 - s / n)).withColumn("guard_override_count", F.size(F.filter(claims, lambda x: x["guard_reason"] != "")))


def judge_answers(df: DataFrame) -> DataFrame:
    """rows with units (expected ids), statuses (array<struct<unit_id, status>>), attempted, contradiction, label -> correctness_label, completeness, counts.

    error is set, and the rest null, where ids are unknown, repeated or missing, a status is none of STATUSES, a substantive unit stands in an answer not attempted, or the label is not the one
    that follows from units and flags.
    """
    ids = F.transform("statuses", lambda x: x["unit_id"])
    bad_ids = (F.size(F.array_except(ids, F.col("units"))) > 0) | (F.size(F.array_distinct(ids)) < F.size(ids)) | (F.size(F.array_except(F.col("units"), ids)) > 0)
    bad_status = F.exists("statuses", lambda x: ~x["status"].isin(*STATUSES))
    n = F.size("units")
    count = lambda s: F.size(F.filter("statuses", lambda x: x["status"] == s))
    a, i = count("answered"), count("incorrect")
    label = (
        F.when(~F.col("attempted") & ~F.col("contradiction"), "failure_to_answer").when(F.col("contradiction") | (i > 0) | (a == 0), "incorrect")
        .when(a == n, "correct").otherwise("partially_correct")
    )
    error = (
        F.when(bad_ids, "unit_ids").when(bad_status, "status").when(~F.col("attempted") & ((a > 0) | (i > 0)), "substantive_unit_not_attempted").when(~F.col("label").isin(*LABELS), "label").when(F.col("label") != label, "label_conflict")
    )
    d = df.withColumn("error", error)
    ok = lambda c, name: F.when(F.col("error").isNull(), c).alias(name)
    return d.select(*df.columns, "error", ok(label, "correctness_label"), ok((label == "correct").cast("int"), "semantic_correctness"), ok(a / n, "completeness"), ok(a, "matched_unit_count"), ok(i, "incorrect_unit_count"), ok(n - a - i, "missing_unit_count"))


def parse_rubric(payload: Column) -> Column:
    """array<string> of a rubric's requirements; null unless it has 1 to 40 units, numbered U1, U2, ... in order, each with a text that no other has
    but for case and blanks."""
    u = F.from_json(payload, "struct<essential_units:array<struct<unit_id:string,requirement:string>>,rationale:string>")
    units = u["essential_units"]
    plain = F.transform(units, lambda x: F.lower(F.regexp_replace(strip(x["requirement"]), r"(?U)\s+", " ")))
    ids = F.transform(units, lambda x, i: x["unit_id"] == F.concat(F.lit("U"), (i + 1).cast("string")))
    ok = F.size(units).between(1, 40) & F.forall(ids, lambda x: F.coalesce(x, F.lit(False))) & F.forall(plain, lambda x: F.coalesce(x != "", F.lit(False))) & (F.size(F.array_distinct(plain)) == F.size(units)) & (strip(u["rationale"]) != "")
    return F.when(ok, F.transform(units, lambda x: strip(x["requirement"])))


def split_exact_abstentions(answers: DataFrame, column: str = "generated_answer") -> tuple[DataFrame, DataFrame]:
    """(answers to be judged, exact abstentions): the latter need no model call, they fail to answer by definition."""
    flag = F.coalesce(is_abstention(F.col(column)), F.lit(False))
    return answers.where(~flag), answers.where(flag).withColumn("correctness_label", F.lit("failure_to_answer")).withColumn("completeness", F.lit(0.0)).withColumn("semantic_correctness", F.lit(0))

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.functions import multiset, numeric
from lodestone.functions import text as T


def one(spark, values, column):
    rows = values if isinstance(values, list) else [values]
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, x string").orderBy("i").select(column).collect()]




def test_clean_and_strip(spark):
    assert one(spark, ["a\x00b \t\r\nc\r d  ", "  x ", None], T.clean_text(F.col("x"))) == ["ab\nc\n d", "x", None]


def test_safe_identifier(spark):
    assert one(spark, [" A & B/c__d ", "x.y-z"], T.safe_identifier(F.col("x"))) == ["A_B_c_d", "x.y-z"]
    with pytest.raises(Exception, match="empty after"):
        one(spark, "///", T.safe_identifier(F.col("x")))


def test_document_metadata(spark):
    null = F.lit(None).cast("string")
    got = one(spark, ["ACME_CO_2021Q2_10Q", "ACME_2020_10-K", "Other_file"], T.document_metadata(F.col("x"), F.lit("Given"), F.lit("8-K"), F.lit("FY 2019")))
    assert [tuple(r) for r in got] == [("ACME CO", 2021, "10-Q"), ("ACME", 2020, "10-K"), ("Given", 2019, "8-K")]
    assert one(spark, "D", T.retrieval_header(T.document_metadata(F.col("x"), null, null, null), F.col("x"), F.lit(3))) == ["Document: D\nPage: 3\n\n"]


def test_tokens(spark):
    assert one(spark, "PP&E rose 5.2% to $1,200 (10-K)", T.financial_tokens(F.col("x"))) == [["pp&e", "rose", "5.2%", "to", "$1", "200", "10-k"]]
    assert one(spark, "The cat, a dog & an owl!", T.answer_tokens(F.col("x"))) == [["cat", "dog", "owl"]]
    assert one(spark, "Revenue was $1,234.5 or 5%", T.match_normal_form(F.col("x"))) == ["revenue was 1234.5 or 5%"]
    assert one(spark, "ﬁne １２", T.nfkc(F.col("x"))) == ["fine 12"]


def test_years(spark):
    q = ["FY2021 and FY 2021 vs 2019", "FY2020 or fiscal year 2021", "in 2018", "2018 to 2019", "FY21"]
    assert one(spark, q, T.unambiguous_year(F.col("x"))) == [2021, None, 2018, None, None]
    assert one(spark, ["2020-12", "x2020", None], T.coerce_year(F.col("x"))) == [2020, None, None]


def test_focus_question(spark):
    q = [
        "Assume that you are a public analyst. Answer the following question by primarily using information that is shown in the balance sheet: what is  net PPNE? Answer in USD billions.",
        "What is capex? Give a response to the question by relying on the details shown in the cash flow statement.",
        "plain",
    ]
    assert one(spark, q, T.focus_question(F.col("x"))) == ["balance sheet: what is net PPNE? USD billions", "What is capex? cash flow statement", "plain"]


def test_expansions_in_order(spark):
    got = one(spark, "Is it capital-intensive by CAPEX and PP&E in the balance sheets?", T.expanded_query(F.col("x"), F.lit(2020)))[0]
    assert got.endswith(" 2020") and got.index("net PP&E") < got.index("consolidated balance sheet") < got.index("purchases of") < got.index("return on assets")


def test_company_mentions(spark):
    d = spark.createDataFrame([("What did Coca-Cola earn?", "COCACOLA"), ("amcor plc?", "AMCOR"), ("scamcorx", "AMCOR"), ("3M margin", "3M"), ("13M margin", "3M"), ("American Express card", "AMERICANEXPRESS")], "q string, c string")
    assert [r[0] for r in d.select(T.mentions_company(F.col("q"), F.col("c"))).collect()] == [True, True, True, True, False, True]


def test_abstention(spark):
    said = [" Insufficient evidence.. ", "I don't know", "insufficient evidence in the retrieved context.", "insufficient evidence here", ""]
    assert one(spark, said, T.is_abstention(F.col("x"))) == [True, True, True, False, False]


def test_answer_units(spark):
    got = one(spark, "- First point; second one\n2. It rose. Then 5% fell! ok\n\n* ", T.answer_units(F.col("x")))[0]
    assert [tuple(u) for u in got] == [("U1", "First point"), ("U2", "second one"), ("U3", "It rose."), ("U4", "Then 5% fell! ok"), ("U5", "*")]


def entities(spark, text, question=""):
    return [(r.value.normalize(), r.unit) for r in one(spark, text, numeric.numeric_entities(F.col("x"), F.lit(question)))[0]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$1,577", [(1577, "USD")]), ("$1,577.00", [(1, "USD"), (577, "number")]), ("-$5 million", [(5000000, "USD")]), ("($155)", [(-155, "USD")]), ("(155", [(155, "number")]), ("$8.70.", []),
        ("12.5 percentage points", [(Decimal("12.5"), "percentage_points")]), ("10-K 2022", [(10, "number")]), ("5 marks", [(5, "number")]), ("3m", []), ("£2bn or €3 k", [(2 * 10**9, "GBP"), (3000, "EUR")]), ("7% and 7 percent", [(7, "percent"), (7, "percent")]), ("née 5é", []),
    ],
)
def test_numbers(spark, text, want):
    assert entities(spark, text) == [(Decimal(v).normalize(), u) for v, u in want]


def test_question_sets_the_unit(spark):
    assert entities(spark, "It is 5 and $7 and 8% and £9", "in USD millions") == [(Decimal(5 * 10**6).normalize(), "USD"), (Decimal(7 * 10**6).normalize(), "USD"), (8, "percent"), (9, "GBP")]


def test_spans_and_keys(spark):
    assert one(spark, "about $5 million, 3m people, 7%, 12", numeric.financial_spans(F.col("x"))) == [["$5 million", "7%"]]
    assert one(spark, "$1,234 and 5.5%", numeric.number_keys(F.col("x"))) == [["1234", "55"]]


def test_overlap_counts_repeats(spark):
    d = spark.createDataFrame([(["a", "a", "b"], ["a", "a", "a", "c"]), ([], ["a"]), (["x"] * 5, ["x"] * 3)], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(multiset.overlap(F.col("a"), F.col("b"))).collect()] == [2, 0, 3]


def test_seed(spark):
    import hashlib

    assert one(spark, "run:P0:P1:f1", T.seed64(F.col("x"))) == [int.from_bytes(hashlib.sha256(b"run:P0:P1:f1").digest()[:8], "big")]


def test_compact_text(spark):
    assert one(spark, ["a  b\nc", "abcdefghij klm"], T.compact_text(F.col("x"), 10)) == ["a b c", "abcdefg..."]


def test_numbers_are_searched_once(spark):
    d = spark.createDataFrame([("It was ($5) million in 2019\x01, \x02then 12%\x01 and\x027 points.",), (None,), ("",)], "x string")
    found = numeric.matches(F.col("x"))
    assert d.select(found.alias("m"))._jdf.queryExecution().optimizedPlan().toString().count("thousand|million") == 1
    got = [r.m for r in d.select(found.alias("m")).collect()]
    assert [(m.all.strip(), m.open, m.currency, m.number, m.close, m.magnitude, m.percent) for m in got[0]] == [("($5) million", "(", "$", "5", ")", "million", ""), ("2019", "", "", "2019", "", "", ""), ("12%", "", "", "12", "", "", "%"), ("7", "", "", "7", "", "", "")]
    assert got[1] is None and got[2] == []


def test_rounding_keeps_the_sign_of_zero(spark):
    got = spark.createDataFrame([(-1e-7,), (1e-7,), (-0.1234567,), (None,)], "x double").select(numeric.rounded(F.col("x"), 5).alias("r")).collect()
    assert [str(r.r) for r in got] == ["-0.0", "0.0", "-0.12346", "None"]


def test_means_do_not_rest_on_the_order_of_rows(spark):
    values = [0.1, 0.2, 0.3, 1e6, -1e6 + 0.02, 29.29]
    rows = [(k, v) for k, order in enumerate((values, values[::-1], values[3:] + values[:3])) for v in order] + [(7, 1 / 3), (7, 1e-15), (8, float("nan")), (8, 1.0), (9, None)]
    d = spark.createDataFrame(rows, "k int, x double").coalesce(1)
    got = {r.k: r.m for r in d.groupBy("k").agg(numeric.exact_mean(F.col("x")).alias("m")).collect()}
    assert got[0] == got[1] == got[2] == 29.91 / 6
    assert got[7] == (1 / 3 + 1e-15) / 2 and got[8] != got[8] and got[9] is None

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm.fill_in_middle import RUN, UNIT, fill_in_middle, restored

PATTERN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def by_the_contract(doc_id, text):
    text = text or ""
    units = re.findall(PATTERN, text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    odd = ["", None, "   ", "\t\n\x0b\x0c\r", "a", " a", "a ", "a  b\n\nc ", "x<P>y z", "a <S> b", "<M>", "<P <S a> <<S", "é 😀 日本 ñ\x85\xa0 b", "\x00 a\x1f b", "w " * RUN, "w " * (RUN - 1) + "w", "w " * 3 * RUN, " ".join(f"w{i}" for i in range(20000))]
    return [(i, odd[i % len(odd)]) for i in range(12 * len(odd))]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 26])
def test_rows_equal_the_contract_on_odd_texts(spark, broadcast_bytes):
    rows = [*texts(), (3, "another text of a repeated id"), (3, "another text of a repeated id"), (None, "one two three"), (None, "four five"), (-5, "six seven"), (2**62, " eight")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, form string, n int, t int")
    out = fill_in_middle(docs, broadcast_bytes=broadcast_bytes)
    got = sorted(((*r[:6],) for r in out.collect()), key=repr)
    assert got == sorted((by_the_contract(i, t) for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = sorted((r.doc_id, r.b) for r in out.where("doc_id is not null").select("doc_id", restored().alias("b")).collect())
    assert back == sorted((i, t or "") for i, t in rows if i is not None)


def test_cut_rates_and_an_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    assert fill_in_middle(docs, moved=0).where("form <> 'plain'").isEmpty()
    assert fill_in_middle(docs, moved=100, suffix_first=0).where("form <> 'psm'").isEmpty()


def test_pattern_finds_what_the_plain_one_finds():
    possessive = re.compile(UNIT)
    for _, t in texts():
        assert possessive.findall(t or "") == re.findall(PATTERN, t or "")


def test_no_python_in_the_plan_and_only_offsets_are_broadcast(spark):
    out = fill_in_middle(spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan

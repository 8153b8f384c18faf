import random
import re

import pytest

from lodestone.llm.pii import KINDS, discovered, patterns, personal_spans, redact, scan

BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(x):
    return sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(x)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 16 <= len(digits) <= 19 and luhn(digits)) or (k == 3 and 8 <= len(digits) <= 15):
                out.append((k, m.start(), m.end()))
    return out


ODD = [
    None, "", "a@b.c", "a@b.com_x@y.org", "1.2.3.4.5.6.7.8", "1.2.3.400", "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "+1 (555) 010-9999.", "+12 34", "é@é.com x.y@z-q.co.uk😀 1.2.3.4", "@@a@b..c", "9" * 30,
    "+1+2 345 678 901 +49 30 1234567", "a" * 20000 + "@x.y", "1 " * 3000, "12345678901234567890.1.1.1", "a.b@c.d.e f@g", "٣.٣.٣.٣",
]


def test_base_spans_equal_regular_expressions(spark):
    rng = random.Random(5)
    alphabet = ["1", "22", "255", "300", "4111111111111111", ".", "..", "@", "a", "b-c", "+", " ", "-", "(", ")", "é", "%", "_", "\n", "com"]
    rows = list(enumerate(ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]))
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, base string, k int")
    got = {r.doc_id: [(x.k, x.s, x.e) for x in r.base] for r in personal_spans(d).collect()}
    for i, t in rows:
        assert got[i] == brute(t), (i, t)


def test_the_method_finds_identifiers_after_learned_words(spark):
    rows = [(i, f"lorem {w} ipsum badge: u{i}@mail.example.com dolor") for i, w in enumerate(["a", "b", "c", "d"] * 5)]
    rows += [(100, "nothing badge: 99-8812-17 here"), (101, "the year 12345678 is no badge at all"), (102, "badge: 5")]
    rows += [(200 + i, f"the number {10000 + i} stands alone and the u{i}@x.org too") for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(KINDS[x.k], x.s, x.e) for x in r.spans] for r in personal_spans(d).collect()}
    assert got[100] == [("email", 15, 25)]
    assert got[101] == [] and got[102] == []
    assert got[0] == [("email", 21, 40)]
    assert all(len(got[200 + i]) == 1 for i in range(10))


def test_discovered_strings_induce_patterns_of_their_own(spark):
    # badge: is learned from base e-mails, and tells that the numbers after it are of that kind; they alone introduce `pass:`, which finds others
    rows = [(1000 + i, f"badge: u{i}@mail.example.com") for i in range(200)] + [(100 + i, f"badge: 77-00{i}-31") for i in range(6)]
    rows += [(200 + i, f"pass: 77-00{i}-31 x") for i in range(6)] + [(300, "pass: 55-1234-99"), (301, "door: 55-1234-99")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = scan(d, "doc_id").persist()
    assert {r.c for r in patterns(scanned, rounds=1).collect()} == {"badge:"}
    good = patterns(scanned)
    assert {(r.c, r.k) for r in good.collect()} == {("badge:", 0), ("pass:", 0)}
    found = {r.doc_id: [(x.k, x.s, x.e) for x in r.more] for r in discovered(scanned, good).collect()}
    assert found[300] == [(0, 6, 16)] and found[301] == [] and found[203] == [(0, 6, 15)]
    joined = {r.doc_id: [(x.k, x.s, x.e) for x in r.more] for r in _joined(scanned, good)}
    assert joined == found


def _joined(scanned, good):
    from lodestone.llm import pii

    kept, pii.LOOKED_UP = pii.LOOKED_UP, 0
    try:
        return discovered(scanned, good).collect()
    finally:
        pii.LOOKED_UP = kept


def test_a_pattern_of_few_seeds_counts_what_others_vouch_for(spark):
    rows = [(i, f"badge: u{i}@mail.example.com") for i in range(100)] + [(100 + i, f"badge: 77-00{i:02d}-31") for i in range(14)]
    rows += [(200 + i, f"pass: v{i}@mail.example.com") for i in range(6)] + [(300 + i, f"pass: 77-00{i:02d}-31") for i in range(14)] + [(400, "pass: 11-2222-33")]
    got = {r.doc_id: [(x.k, x.s, x.e) for x in r.spans] for r in personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[400] == [(0, 6, 16)]


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "x a@b.c")], "doc_id long, text string")
    s = scan(d, "doc_id")
    for df in (s, personal_spans(d), redact(d), discovered(s, patterns(s))):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "mail a@b.com, call +1 (555) 010-9999 😀 end", "en"), (1, "mail a@b.com, call +1 (555) 010-9999 😀 end", "en"), (2, None, None), (3, "", "fr"), (4, "4111 1111 1111 1111@x.y", "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    out = redact(d)
    assert out.columns == d.columns
    got = sorted(map(tuple, out.collect()), key=str)
    say = "mail [EMAIL], call [PHONE] 😀 end"
    assert got == sorted([(1, say, "en"), (1, say, "en"), (2, None, None), (3, "", "fr"), (4, "[CARD]", "q")], key=str)


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert personal_spans(d).collect() == [] and redact(d).collect() == []


@pytest.mark.parametrize("text", ["x" * 200_000, "1." * 20_000, "+" * 50_000, "a@" * 30_000])
def test_long_runs_take_linear_time(spark, text):
    assert personal_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0].base == [(k, s, e) for k, s, e in brute("" if text[0] == "x" else text)]

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import kernels as K
from lodestone.llm.quality_rules import BINS, COUNTS, DEPTH, average_path, count_texts, grow, judge, limit, rule_statistics


def by_the_contract(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


FIRST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counted(texts):
    parts = [count_texts(d, o) for _, _, d, o in K.chunks(pa.array(texts, pa.string()))]
    return list(zip(*(np.concatenate([p[c] for p in parts]).tolist() for c in FIRST), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\r#é😀A\x85", max_size=40), min_size=1, max_size=6))
def test_counts_equal_the_contract(texts):
    assert counted(texts) == [by_the_contract(t) for t in texts]


def test_counts_of_odd_texts():
    texts = ["", "\n", "\n\n", "a\n", "\na\na", "a\nA\na\r\na\r", "a a a a", "x y z x y z", "a b c d " * 9, " \n \n", "w" * 70000, "a b\n" * 5000, " ".join(map(str, range(9000))), "é\né", "|*|\n|*|"]
    assert counted(texts) == [by_the_contract(t) for t in texts]


def test_paths_equal_a_walk_of_each_tree():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(500, 3)), [[9, 9, 9]], np.zeros((40, 3))])
    forest = grow(x, trees=30, seed=1)

    def path(t, row):
        node, depth = 0, 0
        while forest.column[t, node] >= 0:
            node = 2 * node + 1 + int(row[forest.column[t, node]] >= forest.cut[t, node])
            depth += 1
        assert depth <= DEPTH
        return forest.path[t, node]

    want = [2 ** (-np.mean([path(t, r) for t in range(30)]) / average_path(256)) for r in x]
    got = forest.score(x)
    assert np.allclose(got, want) and got.argmax() == 500 and abs(float(average_path(256)) - 10.2448) < 1e-3
    assert grow(np.ones((5, 2)), trees=3).score(np.ones((2, 2))).tolist() == [0.5, 0.5]  # rows that are all alike


def test_the_limit_parts_the_labels_and_spares_the_good():
    assert limit([]) == np.inf and limit([(5, 1, 3)]) == np.inf and limit([(5, 0, 3)]) == np.inf
    assert limit([(100, 1, 1000), (500, 0, 10)]) == 500 / BINS
    assert limit([(100, 1, 1000), (600, 1, 5), (500, 0, 10), (700, 0, 1)]) == 700 / BINS  # 500 would flag 5 of 1005 good ones
    assert limit([(500, 1, 5), (100, 0, 5)]) == np.inf


def corpus(n, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 8))) for _ in range(rng.randint(60, 200))]
        kind = i % 12
        if kind == 0:
            words = [w + "***" for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif kind == 2:
            words = words[:20]
        elif kind == 3:
            words = words[:9] * 9
        rows.append((i, " ".join(words)))
        if i % 2 or kind in (0, 2) and i % 3 == 0:
            labels.append((i, int(kind > 3)))
    return rows, labels


def test_junk_goes_and_clean_texts_stay(spark):
    rows, labels = corpus(1200)
    out = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(out) == 1200 and all(out[i].base_failed == (i % 12 in (2, 3)) for i in out)
    assert sum(not r.kept for r in out.values() if r.doc_id % 12 > 3) <= 2
    assert sum(r.kept for r in out.values() if r.doc_id % 12 < 4) <= 4
    for i, t in rows[::37]:
        assert tuple(out[i][c] for c in FIRST) == by_the_contract(t)


def test_odd_rows_and_labels(spark):
    clash = "doc_id long, text string, score double, quality int, n_words int"
    rows = [(1, None, 1.0, 1, 1), (2, "", 1.0, 1, 1), (None, "a b c", 1.0, 1, 1), (4, "x " * 60, 1.0, 1, 1), (4, "x " * 60, 1.0, 1, 1), (5, " ".join(map(str, range(70))), 1.0, 1, 1)]
    labels = spark.createDataFrame([(5, 1, "x"), (5, 1, "x"), (None, 0, "x"), (4, None, "x"), (77, 0, "x"), (2, 9, "x")], "doc_id long, quality int, text string")
    out = judge(spark.createDataFrame(rows, clash), labels).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in out) == [(0, 3, False), (1, 0, False), (2, 0, False), (4, 60, False), (4, 60, False), (5, 70, True)]
    empty = judge(spark.createDataFrame([], "doc_id long, text string"), labels)
    assert empty.collect() == [] and {"kept", "anomalous", "score", *COUNTS} <= set(empty.columns)
    assert rule_statistics(spark.createDataFrame([], "doc_id long, text string")).collect() == []

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import near_dedup as N
from lodestone.llm.graph import connected_components
from lodestone.llm.near_dedup import near_duplicates, tiers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent, size=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.setdefault(i, []).append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def family(rng, n, words, copies):
    """Texts with copies that lose, change or gain words, so that similarities fall around the threshold."""
    vocabulary = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        out.append(base)
        for _ in range(rng.randint(0, copies)):
            c = base[:]
            for _ in range(rng.randint(0, 1 + len(c) // 60)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            out.append(c)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("percent", "words", "seed"), [(85, 40, 1), (80, 300, 2), (85, 400, 3)])
def test_components_equal_brute_force(spark, percent, words, seed):
    rng = random.Random(seed)
    rows = list(enumerate(family(rng, 45, words, 6)))
    rng.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_of_short_and_long_texts_equal_brute_force(spark):
    rng = random.Random(12)
    rows = list(enumerate(family(rng, 30, 120, 4) + family(rng, 6, 2500, 4)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 80)


def test_nulls_ties_short_and_repeated_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text), (1, text.upper()), (3, text), (7, None), (8, ""), (9, " \t\n"), (4, "one two"), (5, "One  two"), (None, text), (11, "x" * 5000)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, component_id string, n long")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(df, 85).collect())
    assert got == [(-1, 4, -1, False), (1, 4, 1, True), (3, 4, 1, False), (3, 4, 1, False), (4, 1, 4, True), (5, 1, 4, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (11, 1, 11, True)]


def under_the_threshold(n, rng):
    """Texts that all share five sixths of their words, in one run, and link with none of the others."""
    shared = [f"s{i}" for i in range(330)]
    return [(i, " ".join(shared + [f"u{i}.{rng.randrange(10**6)}.{j}" for j in range(70)])) for i in range(n)]


def test_a_large_family_under_the_threshold_is_not_compared_pair_by_pair(spark):
    """Prefixes of such texts hold what is their own; the pairs that are compared are the few that were planted."""
    rows = under_the_threshold(900, random.Random(3))
    copies = [(2000 + i, rows[i][1].replace(f"s{i}", f"x{i}")) for i in range(0, 300, 30)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    got = near_duplicates(docs, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - 2000 if i >= 2000 else i for i, _ in rows + copies}
    classes = spark.createDataFrame([(i,) for i, _ in rows + copies], "rep long")
    alone = spark.createDataFrame([], "node long, component long")
    listed = N._prefixes(classes, docs, alone, 85, 5)
    pairs = listed.alias("l").join(listed.alias("r"), "key").where("l.doc < r.doc").select("l.doc", "r.doc").distinct().count()
    assert pairs < 60


@settings(max_examples=400, deadline=None)
@given(st.sets(st.integers(0, 90), min_size=1, max_size=60), st.lists(st.tuples(st.booleans(), st.integers(0, 90)), max_size=9), st.lists(st.tuples(st.integers(0, 90), st.integers(2, 9))), st.sampled_from([40, 50, 60, 80, 85, 95]), st.integers(1, 50))
def test_sets_at_the_threshold_share_a_key(one, changes, known, percent, long):
    other = set(one)
    for added, v in changes:
        (other.add if added else other.discard)(v)
    if not other:
        return
    a, b = (np.array(sorted(x), np.uint64) for x in (one, other))
    table = dict(known)
    common, times = np.array(sorted(table), np.uint64), np.array([table[k] for k in sorted(table)], np.int64)
    if 100 * len(one & other) >= percent * len(one | other):
        (ka, la, ra), (kb, lb, rb) = (N.listed_under(x, percent, common, times, long) for x in (a, b))
        alike = -(-percent * (len(a) + len(b)) // (100 + percent))
        need = lambda run: 3 * alike - len(a) - len(b) - 1 if run else alike
        assert any(ka[i] == kb[j] and ra[i] == rb[j] and 1 + min(la[i], lb[j]) >= need(ra[i]) for i in range(len(ka)) for j in range(len(kb)))


def test_long_texts_that_share_a_passage_meet_in_no_list(spark):
    """Texts of many words out of few: single shingles are shared by chance, runs of two are not."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(rng.choices("abcdefghijkl", k=3000))) for i in range(60)] + [(100, None)]
    rows[59] = (59, rows[58][1][:-20])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 85).collect()} == {i: 58 if i == 59 else i for i, _ in rows}
    listed = N._prefixes(spark.createDataFrame([(i,) for i in range(60)], "rep long"), docs, spark.createDataFrame([], "node long, component long"), 85, 5)
    pairs = listed.alias("l").join(listed.alias("r"), "key").where("l.doc < r.doc").select("l.doc", "r.doc").distinct().count()
    assert pairs < 0.1 * 60 * 59 / 2


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(400):
        c = base[:]
        if i:
            c[rng.randrange(len(c))] = f"u{i}"
        rows.append((1000 + i, " ".join(c)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.component_id for r in got} == {1000}


@pytest.mark.parametrize("percent", [80, 85])
def test_long_texts_held_by_others_in_a_template_family(spark, percent):
    """Each text is held by a longer one just under the threshold, which is the head of their lists (ties go to the smaller id), and by one just at it."""
    rng = random.Random(percent)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for f in range(60):
        n = rng.randint(1100, 1900)
        whole = template + [f"w{f}.{i}" for i in range(3000)]
        second = (n - 4) * 100 // percent + 4
        rows += [(3 * f + j, " ".join(whole[:k])) for j, k in enumerate((n, second + 4, second))]
    rng.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 3 for i, _ in rows} == brute(rows, percent)


@pytest.mark.parametrize("percent", [50, 80, 85, 90, 95])
def test_tiers_cover_every_pair_of_sizes(percent):
    levels = tiers(percent)
    for u in range(1, 400):
        d = u * (100 - percent) // 100
        if d:
            run = -(-(u - d) // (d + 1))
            for a, b in ((u, u - d), (u - d // 2, u - (d - d // 2)), (u - d, u)):
                assert any(lo <= a <= hi and lo <= b <= hi and r <= run for r, lo, hi in levels), (percent, u, a, b)


def test_components_of_chains_stars_and_loops(spark):
    hub = [(5000, x) for x in range(5001, 6000)] + [(x, 7000) for x in range(6001, 7000)]
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + hub + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 160)}, **{x: 5000 for x in range(5000, 6000)}, **{x: 6001 for x in range(6001, 7001)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []

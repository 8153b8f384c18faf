import random
import re

from lodestone.llm.decontaminate import build_index, contamination, search

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(doc, items, size=13):
    w, inside, found = words(doc), set(), set()
    for i, t in items:
        v = words(t)
        n = min(size, len(v))
        for k in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    inside.update(range(p, p + n))
                    found.add(str(i))
    return len(w), len(inside), sorted(found)


def test_phrases_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(12)] + ["É", "naïve"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 13, 14, 30])))) for i in range(25)] + [(99, None), (3, "Repeated, item!")]
    docs = []
    for i in range(80):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, 1), (rng.choice(items)[1] or "").upper().replace(" ", ", "))
        docs.append((i, ". ".join(parts)))
    docs += [(500, None), (501, ""), (None, "t1 t2"), (7, docs[7][1])]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, items string").repartition(3)
    got = contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted((str(i), *brute(t, items)) for i, t in docs)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_proximity_allows_words_to_shift(spark):
    item = [(1, "alpha beta gamma delta epsilon")]
    docs = [(1, "x alpha beta gamma delta epsilon"), (2, "alpha beta inserted gamma delta epsilon"), (3, "alpha beta one two three four five six gamma delta epsilon")]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame(item, "item_id long, text string")
    assert {r.doc_id for r in search(index, items).collect() if r.n_hit} == {1}
    assert {r.doc_id for r in search(index, items, slop=1).collect() if r.n_hit} == {1, 2}


def near_brute(doc, items, size, slop):
    w, found = words(doc), set()
    for i, t in items:
        v = words(t)
        n = min(size, len(v))
        for k in range(len(v) - n + 1) if n else ():
            if any(all(v[k + j] in w[max(0, p + j - slop) : max(0, p + j + slop + 1)] for j in range(n)) for p in range(-slop, len(w) + slop)):
                found.add(str(i))
    return sorted(found)


def test_proximity_and_slices_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 9])))) for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for i in range(90)]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).persist()
    asked = spark.createDataFrame(items, "item_id long, text string")
    for room in (8 << 20, 40):  # in one slice, and in many
        monkeypatch.setattr("lodestone.llm.decontaminate.SLICE_BYTES", room)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.near_items) for r in search(index, asked, size=5, near=2).collect()}
        assert got == {i: (*brute(t, items, 5), near_brute(t, items, 5, 2)) for i, t in docs}


def test_stored_index_answers_alike(spark, tmp_path):
    d = spark.createDataFrame([(i, f"a b c d {i} e f") for i in range(50)], "doc_id long, text string")
    build_index(d).write.parquet(str(tmp_path / "index"))
    items = spark.createDataFrame([("q", "d 17 e")], "item_id string, text string")
    assert [r.doc_id for r in search(spark.read.parquet(str(tmp_path / "index")), items).collect() if r.n_hit] == [17]


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination(d, i).collect() == []
    one = contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), i).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in one] == [(2, 0, False)]

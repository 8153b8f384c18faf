import math
import random
import re

import numpy as np
import pytest

from lodestone.llm import language_id as L
from lodestone.llm import toxicity as X

WORDS = {"en": "the and of house water street with they thing over light".split(), "de": "und der schule nicht straße über wir haben licht wasser".split(), "fr": "les été dans où être avec lumière rue maison garçon".split()}


def corpus(rng, n):
    return [(i, " ".join(rng.choice(WORDS[x]) + rng.choice(["", ".", ","]) for _ in range(rng.randint(5, 60))), x) for i, x in enumerate(rng.choice(list(WORDS)) for _ in range(n))]


def test_counts_equal_a_plain_count(spark):
    rows = [(1, "Ab ab", "en"), (2, "ab", "en"), (3, "ab", "de"), (4, None, "en"), (5, "x1y", "en")]
    got = {(r.lang, r.gram): r.n for r in L.count_grams(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3).collect()}
    want = {}
    for _, t, lang in rows:
        for w in "".join(c.lower() if c.isalpha() else " " for c in t or "").split():
            p = "\1\1" + w + "\1"
            for k in range(2, len(p)):
                want[lang, p[k - 2 : k + 1]] = want.get((lang, p[k - 2 : k + 1]), 0) + 1
    assert got == want


def kneser_ney(counts, order):
    """Textbook interpolated Kneser-Ney of one language, as a function of a gram."""
    levels = {order: dict(counts)}
    for o in range(order - 1, 0, -1):
        levels[o] = {}
        for g in levels[o + 1]:
            levels[o][g[1:]] = levels[o].get(g[1:], 0) + 1
    d = {o: max(1, sum(v == 1 for v in c.values())) / (max(1, sum(v == 1 for v in c.values())) + 2 * max(1, sum(v == 2 for v in c.values()))) for o, c in levels.items()}
    letters = max(2, len(levels[1]))
    floor = 1 / (2 * letters + 1000)

    def p(g):
        if not g:
            return floor
        c = levels[len(g)]
        same = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        return max(c.get(g, 0) - d[len(g)], 0) / total + d[len(g)] * len(same) / total * p(g[1:])

    return p


def test_probabilities_equal_the_textbook(spark):
    rows = corpus(random.Random(1), 60)
    counts = L.count_grams(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3)
    model = L.build_model(counts, 3)
    for j, lang in enumerate(model.langs):
        p = kneser_ney({r.gram: r.n for r in counts.where(f"lang = '{lang}'").collect()}, 3)
        for g in ("\1\1t", "the", "he\1", "zzz", "xß\1", "éé\1", "\1th", "wxq"):
            got = model._log_probs(np.frombuffer(g.encode("utf-32-le"), np.uint32).reshape(1, 3))[0, j]
            assert got == pytest.approx(math.log(p(g)), abs=1e-4), (lang, g)


def test_language_of_held_out_texts_and_odd_rows(spark):
    rows = corpus(random.Random(2), 300)
    d = spark.createDataFrame(rows + [(1000, "the house", None), (1001, None, "fr"), (1002, None, None)], "doc_id long, text string, lang string")
    model = L.train(d, "doc_id % 4 <> 2")
    odd = [(2000, None), (2001, ""), (2002, "123 +-"), (2003, "日本語の文章です" * 20), (2004, "THE HOUSE AND THE STREET OF LIGHT"), (2005, "the " * 50000), (None, "wir haben wasser"), (7, rows[7][1]), (7, rows[7][1])]
    held = [(i, t) for i, t, _ in rows if i % 4 == 2]
    test = spark.createDataFrame([(*r, "zz") for r in held + odd], "doc_id long, text string, lang string")
    got = L.identify(test, model).collect()
    assert len(got) == len(held) + len(odd)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].lang_pred == rows[i][2] for i, _ in held) >= 0.98 * len(held)
    assert all(by[i].accepted for i, _ in held)
    assert [(by[i].lang_pred, by[i].score, by[i].accepted) for i in (2000, 2001, 2002)] == [("und", 0.0, False)] * 3
    assert by[2003].lang_pred in WORDS and not by[2003].accepted
    assert by[2004].lang_pred == "en" and by[2005].lang_pred == "en" and by[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.accepted_only(test, model)
    assert kept.columns == test.columns and kept.where("doc_id between 2000 and 2003").count() == 0 and kept.where("doc_id = 7").count() == 2


def test_rare_grams_stay_however_many_there_are(spark):
    many = (1 << 20) + 5000
    letters = "concat(" + ", ".join(f"char(97 + cast(id / {26**j} as long) % 26)" for j in range(5)) + ")"
    big = spark.range(many).selectExpr("'a' as lang", f"{letters} as gram", "case when id % 4 = 0 then 2L else 1L end as n")
    model = L.build_model(big.unionAll(spark.createDataFrame([("b", "zzzzz", 1), ("b", "yyyyy", 1)], "lang string, gram string, n long")))
    assert model.langs == ["a", "b"] and len(model.grams[4][0]) == many + 2
    rows = np.frombuffer("zzzzz".encode("utf-32-le"), np.uint32).reshape(1, 5)
    assert model._log_probs(rows)[0, 1] > model._log_probs(rows)[0, 0]


def test_a_rare_language_beside_one_of_large_counts(spark):
    """All counts of the large language are over 4096, so no gram of it occurs once or twice; the small one still answers for its words."""
    grams = [x + y + z for x in "abc" for y in "abc" for z in "abc"] + ["\x01\x01" + x for x in "abc"] + [g for x in "abc" for y in "abc" for g in ("\x01" + x + y, x + y + "\x01")]
    rows = [("a", g, 5000 + i) for i, g in enumerate(grams)] + [("b", g, 1) for g in ("\x01\x01k", "\x01ka", "kab", "abk", "bk\x01")]
    model = L.build_model(spark.createDataFrame(rows, "lang string, gram string, n long"), 3)
    assert model.langs == ["a", "b"] and len(model.grams[2][0]) == len(rows)
    lang, score, _ = model.judge(["kabk kabk", "abcabc abba"])
    assert lang == ["b", "a"] and all(0 <= x <= 1 for x in score)


def test_rejection_is_calibrated_on_texts_that_the_model_has_not_seen(spark):
    rows = corpus(random.Random(8), 2600)
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id % 4 <> 2")
    held = [t for i, t, _ in rows if i % 4 == 2]
    _, _, ok = model.judge(held)
    assert model.limit != 8.0 and ok.mean() == 1.0, model.limit
    foreign = ["".join(random.Random(k).choice("qxzjvkw") for _ in range(4)) + " zxqj vkwq jjzx qwvx" for k in range(50)]
    _, _, ok = model.judge([" ".join([t] * 8) for t in foreign])
    assert ok.mean() == 0.0


def test_calibration_rests_on_all_training_rows(spark):
    """Medians, deviations and the limit equal plain ones over every row, each measured with the model of the half that it isn't in."""
    rng = random.Random(5)
    rows = [(i, t + (" qxzj" * 9 if i % 61 == 0 else ""), x) for i, t, x in corpus(rng, 6000)] + [(9000, "12 34", "en"), (9001, "kalt warm", "nl")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(d, "true")
    half = dict(d.selectExpr("doc_id", "pmod(xxhash64('calibrate', doc_id, octet_length(text)), 2)").collect())
    z, own_loss, best_loss = [], {x: [] for x in model.langs}, []
    for k in (0, 1):
        other = L.build_model(L.count_grams(d.where(f"pmod(xxhash64('calibrate', doc_id, octet_length(text)), 2) <> {k}")))
        mine = [(t, x) for i, t, x in rows if half[i] == k]
        loss, n = other.losses([t for t, _ in mine])
        for (_, x), row, letters in zip(mine, loss, n, strict=True):
            if letters:
                best = other.langs[int(row.argmin())]
                best_loss.append((best, x, float(row.min()), int(letters)))
                if x in other.langs:
                    own_loss[x].append((float(row[other.langs.index(x)]), best == x and letters >= 100))
    assert len(best_loss) == 6001 and model.langs == ["de", "en", "fr", "nl"]
    for j, x in enumerate(model.langs):
        long = [v for v, long in own_loss[x] if long]
        values = np.array(long if len(long) >= 5 else [v for v, _ in own_loss[x]])
        if not len(values):
            assert np.isinf(model.spread[j])
            continue
        assert model.mean[j] == pytest.approx(np.median(values), abs=1e-9)
        assert model.spread[j] == pytest.approx(max(L.LEAST_SPREAD, 1.4826 * np.median(np.abs(values - np.median(values)))), abs=1e-9)
    for best, x, v, letters in best_loss:
        j = model.langs.index(best)
        if best == x:
            z.append(max(0.0, (v - model.mean[j]) / (model.spread[j] * math.sqrt(1 + 300 / letters))))
    z = np.sort(z)
    tail = z[len(z) - math.ceil(L.TAIL * len(z)) :]
    excess = ((tail - tail[0]).sum() + L.PRIOR * L.PRIOR_EXCESS) / (len(tail) + L.PRIOR)
    assert model.limit == pytest.approx(max(tail[-1], tail[0] + excess * math.log(len(tail) / len(z) / L.FALSE_REJECTS)), abs=1e-9)


@pytest.mark.parametrize("wrong", [3, 40])
def test_scores_are_shares_of_right_answers_where_some_labels_are_wrong(spark, wrong):
    rows = [(i, t, "de" if i < wrong and x != "de" else x) for i, t, x in corpus(random.Random(9), 2000)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "true")
    lang, score, _ = model.judge([t for _, t, _ in rows])
    right = np.mean([a == x for a, (_, _, x) in zip(lang, rows, strict=True)])
    assert right < 1 and abs(score.mean() - right) < 0.002


def test_the_curve_of_scores_is_the_best_one():
    rng = np.random.default_rng(4)
    x = np.stack([np.ones(400), rng.exponential(20, 400), -rng.exponential(1, 400)], axis=1)
    rows, y = rng.integers(1, 500, 400).astype(float), (rng.random(400) < 1 / (1 + np.exp(-(0.3 * x[:, 1] + x[:, 2])))).astype(float)
    cost = lambda w: (rows * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w))).sum() + 0.005 * (w @ w)
    w = L.fit_curve(x, y, rows)
    for k in range(3):
        for step in (-1e-3, 1e-3):
            assert cost(np.maximum(w + step * np.eye(3)[k], [-20, 0, 0])) >= cost(w)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.train(empty, "true")
    assert L.identify(empty, model).collect() == []
    one = L.identify(spark.createDataFrame([(1, "word")], "doc_id long, text string"), model).collect()[0]
    assert (one.lang_pred, one.score, one.accepted) == ("und", 0.0, False)


def toxic_rows(rng, n):
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    out = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(3, 200))]
        bad = i % 3 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["scumbag", "scumbags", "vilescum"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_gradients_equal_differences():
    net = X.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, starts, ends, text = X._words(["abc de fgh abc zz y", "q w abc"])
    first, kind, _ = X._distinct(codes, starts, ends)
    idx = X.windows(text, kind, 2)[0][:, :8]
    inputs, y = X._word_inputs(codes, starts[first], ends[first]), np.array([1.0, 0.0])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(net.project(net.inputs(*inputs)[0]), idx)))
        return -np.mean(np.where(y > 0.5, np.log(p), np.log(1 - p)))

    x, count = net.inputs(*inputs)
    grads, _ = net.gradients(x, *inputs, count, net.project(x), idx, y)
    for k, v in net.p.items():
        flat, i = v.reshape(-1), int(np.abs(grads[k]).reshape(-1).argmax())
        was, h = flat[i], 1e-3
        flat[i] = was + h
        up = loss()
        flat[i] = was - h
        down = loss()
        flat[i] = was
        assert (up - down) / (2 * h) == pytest.approx(grads[k].reshape(-1)[i], rel=1e-3, abs=1e-6), k


def plain_score(net, text):
    """One window after the other, one word after the other, one gate after the other."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = re.findall(r"[^\W\d_]+", text.lower())
    sig = lambda x: 1 / (1 + np.exp(-x))

    def embed(w):
        c = [2, *map(ord, w), 3]
        tri = [(c[k - 1] * 1000003 + c[k] * 10007 + c[k + 1] * 7919) % 1000000007 % X.TRIGRAMS for k in range(1, len(c) - 1)]
        whole = sum(ord(x) * pow(31, k % 64, 1000000007) % 1000000007 for k, x in enumerate(w)) % 1000000007 % X.WORDS
        return p["word"][whole] + p["tri"][tri].mean(axis=0)

    best = None
    for start in range(0, max(1, len(words) - (X.WINDOW - X.STRIDE)), X.STRIDE) if words else ():
        x = [embed(w) for w in words[start : start + X.WINDOW]]
        states = []
        for way in (0, 1):
            h, out = np.zeros(X.HIDDEN), []
            for v in x[::-1] if way else x:
                gx, gh = v @ p["w"][way] + p["b"][way][0], h @ p["u"][way]
                z, r = sig(gx[: X.HIDDEN] + gh[: X.HIDDEN]), sig(gx[X.HIDDEN : 2 * X.HIDDEN] + gh[X.HIDDEN : 2 * X.HIDDEN])
                h = z * h + (1 - z) * np.tanh(gx[2 * X.HIDDEN :] + r * gh[2 * X.HIDDEN :])
                out.append(h)
            states.append(out[::-1] if way else out)
        s = np.array([np.concatenate(y) for y in zip(*states, strict=True)])
        a = np.exp(s @ p["att"] - (s @ p["att"]).max())
        logit = (a / a.sum()) @ s @ p["out"] + p["bias"][0]
        best = logit if best is None else max(best, logit)
    return 0.0 if best is None else sig(best)


def test_scores_equal_a_plain_network(spark):
    rng = random.Random(21)
    rows = toxic_rows(rng, 60)
    net = X.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows]), epochs=2)
    texts = [t for _, t, _ in toxic_rows(rng, 25)] + ["", "12 +", "one", "Été ÜBER naïve 日本 x", " ".join(f"w{chr(97 + k % 26)}" for k in range(300)), "a" * 200 + " b"]
    got = {r.doc_id: r.score for r in X.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(net, t), abs=1e-4), t


def test_windows_cover_every_word_and_overlap():
    for n in (1, 47, 48, 49, 84, 85, 500):
        idx, owner = X.windows(np.zeros(n, np.int64), np.arange(n), 1)
        assert set(idx[idx >= 0].tolist()) == set(range(n)) and set(owner.tolist()) == {0}
        for a, b in zip(idx, idx[1:], strict=False):
            assert set(a[a >= 0].tolist()) & set(b[b >= 0].tolist())


def test_held_out_toxicity_and_odd_rows(spark):
    rows = toxic_rows(random.Random(3), 600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9999, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    net = X.train(docs, labels, "doc_id % 3 <> 1 or doc_id % 2 = 0", per_label=150)
    test = toxic_rows(random.Random(77), 300)
    clean = " ".join(t for _, t, y in test if not y)
    odd = [(5000, None), (5001, ""), (5002, "12 34 !!"), (5003, clean[:60000]), (5004, clean[:30000] + " scumbag vilescum " + clean[:30000])]
    got = {r.doc_id: r for r in X.score_texts(spark.createDataFrame([(i, t) for i, t, _ in test] + odd, "doc_id long, text string"), net).collect()}
    right = sum((got[i].score >= 0.7) == bool(y) for i, _, y in test)
    assert right >= 0.95 * len(test)
    assert [got[i].score for i in (5000, 5001, 5002)] == [0.0] * 3
    assert got[5004].score >= 0.7 > got[5003].score
    assert got[5003].windows > 100


def test_toxicity_without_rows_or_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    net = X.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), "true")
    assert X.score_texts(docs, net).collect() == []
    assert X.score_texts(spark.createDataFrame([(1, "plain words")], "doc_id long, text string"), net).collect()[0].score < 0.7

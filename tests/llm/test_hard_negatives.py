import random

import numpy as np
import pytest

from lodestone.llm import hard_negatives as H


def brute(rows, every=100, positives=5, negatives=5, low=80):
    """Every anchor against every row."""
    seen = sorted({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)})
    out = []
    for a, lab, v in seen:
        if a % every:
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), i, o == lab) for i, o, w in seen if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            near = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i, _) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(i, lab, v, 7, 0.5) for i, lab, v in rows], "vec_id long, label int, v array<double>, pivot int, score double")
    return sorted(tuple(r) for r in H.hard_negatives(df, **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, dim, seed, groups=12, spread=30):
    rng = np.random.default_rng(seed)
    centre = rng.integers(-200, 200, (groups, dim))
    own = rng.integers(0, groups, n)
    return [(i, int(rng.integers(0, 4)), (centre[own[i]] + rng.integers(-spread, spread, dim)).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force_on_clusters(spark, seed):
    rows = clustered(1500, 8, seed)
    assert mined(spark, rows, every=25) == brute(rows, every=25)


def test_ties_and_a_vector_that_a_third_of_the_rows_share(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, i % 5, [3.0, 4.0, 1.0] if i % 3 == 0 else [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(900)]
    monkeypatch.setattr(H, "BLOCK", 32)
    assert mined(spark, rows, every=30) == brute(rows, every=30)


def test_anchors_in_many_slices(spark, monkeypatch):
    rows = clustered(400, 4, 3)
    monkeypatch.setattr(H, "SLICE_BYTES", 2000)
    assert mined(spark, rows, every=10) == brute(rows, every=10)


def test_a_bounded_sample_sets_floors_only(spark, monkeypatch):
    rows = clustered(700, 6, 4)
    monkeypatch.setattr(H, "SAMPLE", 60)
    assert mined(spark, rows, every=20) == brute(rows, every=20)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, 1, [5.0, 5.0]), (0, 1, [5.0, 5.0]), (0, 2, [1.0, 1.0]), (1, 1, [4.0, 4.0]), (2, 2, [4.0, 3.0]), (2, 2, [4.0, 3.0]), (3, 2, [0.0, 0.0]), (100, 1, [-3.0, -3.0]), (-100, 2, [2.0, 4.0])]
    odd = [(None, 1, [5.0, 5.0]), (4, None, [5.0, 5.0]), (5, 1, None), (6, 1, []), (7, 1, [nan, 1.0]), (8, 1, [1.0, None]), (9, 2, [float("inf"), 1.0])]
    assert mined(spark, rows + odd) == brute(rows)
    assert mined(spark, rows + odd + [(200, 1, [1.0, 2.0, 3.0])]) == brute(rows)  # another length than most
    assert mined(spark, odd) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0])]) == []
    with pytest.raises(ValueError, match="squared length"):
        mined(spark, [(0, 1, [1e8, 0.0])])


def test_blocks_out_of_reach_are_not_read():
    rows = clustered(4000, 8, 6, groups=10, spread=6)
    x = np.array([v for _, _, v in rows])
    ids, labels = np.arange(4000), np.array([lab for _, lab, _ in rows])
    most = float((x * x).sum(axis=1).max())
    pivots = H.choose_pivots(H.longer(x, most), 10)
    d = H.distances(H.longer(x, most), pivots)
    own = d.argmin(axis=1)
    key = d[np.arange(4000), own]
    cuts = [g for p in range(10) for g in np.array_split(np.flatnonzero(own == p)[np.argsort(key[own == p])], 8) if len(g)]
    anchors = np.arange(0, 4000, 100)
    near = H.distances(np.concatenate([x[anchors], np.zeros((40, 1))], axis=1), pivots)
    s = H.Searches(ids[anchors], labels[anchors], x[anchors], near, most, np.full((40, 1), -np.inf), np.full((40, 1), np.inf), True, 5)
    s.walk(own[[g[0] for g in cuts]], np.array([key[g].min() for g in cuts]), np.array([key[g].max() for g in cuts]), lambda i: (ids[cuts[i]], labels[cuts[i]], x[cuts[i]]))
    assert s.read < 0.35 * 40 * len(cuts)
    for a in range(40):
        score = x @ x[anchors[a]]
        score[(labels != labels[anchors[a]]) | (ids == anchors[a])] = -np.inf
        assert s.found[a, 0].tolist() == np.lexsort((ids, -score))[:5].tolist()

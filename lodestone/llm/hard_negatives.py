"""Hard negatives by one-dimensional distance keys.

Largest inner product becomes smallest distance by one more component: x becomes (x, sqrt(M - x x)) for the largest squared length M, an anchor q
becomes (q, 0), and the squared distance is q q + M - 2 q x. Rows are stored sorted by (pivot, distance to it), the nearest of a few pivots,
in blocks that know the interval of distances they hold. By the triangle inequality a block's rows are no nearer to an anchor than the gap between the
anchor's own distance to the pivot and that interval, and no farther than their sum.

A search is for one anchor and a range of scores, an annulus around it. Each task walks the key intervals of its blocks outward from the anchor's own keys, in rings that
double; what it has found raises the least score that still counts, and a block whose bound stays under it is not read. So every task certifies its own
blocks, and the best k of all tasks are the best k of all rows: nothing is approximate.

Positives are one search among rows of the anchor's label; negatives one for each positive, among rows of other labels, under its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, kept, materialise

#: Rows that pivots and first floors come from, at most; all rows are stored and searched.
SAMPLE = 4096
#: Pivots at most, and rows of a block.
MOST_PIVOTS, BLOCK = 256, 256
#: Bytes of the anchors that are searched at once: one broadcast.
SLICE_BYTES = 16 << 20
#: Anchors whose scores against a block are held at once.
TOGETHER = 512
#: Squared lengths from here on are refused: sums of products would no longer be exact.
EXACT = 2.0**52
LAST = np.iinfo(np.int64).max
KEYED = "pivot int, dist double, vec_id long, label long, v binary"
BLOCKS = "pivot int, lo double, hi double, ids array<long>, labels array<long>, v binary"
FOUND = "a int, band int, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (array<double>) of the rows that take part: with an id, a label and a vector of finite components only."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
    return rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def longer(x: np.ndarray, most: float) -> np.ndarray:
    """Rows x with the component that makes all of them equally long."""
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T, 0))


def choose_pivots(x: np.ndarray, n: int, seed: int = 13, rounds: int = 8) -> np.ndarray:
    """n centres of the sample x, by a few rounds of means."""
    pivots = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = distances(x, pivots).argmin(axis=1)
        pivots = np.stack([x[own == p].mean(axis=0) if (own == p).any() else pivots[p] for p in range(n)])
    return pivots


def keyed(rows: DataFrame, dim: int, most: float, pivots: np.ndarray) -> DataFrame:
    """Rows with their pivot and distance, v as 32-bit integers."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(2).flatten()).reshape(-1, dim)
            d = distances(longer(x, most), sent.value)
            own = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield batch({"pivot": pa.array(own, pa.int32()), "dist": pa.array(d[np.arange(len(x)), own]), "vec_id": b.column(0), "label": b.column(1), "v": pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())})

    return rows.mapInArrow(run, KEYED)


def blocks(rows: DataFrame) -> DataFrame:
    """Stored keyed() rows -> BLOCKS sorted by (pivot, distance). Rows equal in id, label and vector are stored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def out() -> pa.RecordBatch:
            d = [r[1] for r in held]
            return batch({
                "pivot": pa.array([held[0][0]], pa.int32()), "lo": pa.array([min(d)]), "hi": pa.array([max(d)]), "ids": pa.array([[r[2] for r in held]], pa.list_(pa.int64())),
                "labels": pa.array([[r[3] for r in held]], pa.list_(pa.int64())), "v": pa.array([b"".join(r[4] for r in held)], pa.binary()),
            })

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row == last:
                    continue
                if held and (row[0] != held[0][0] or len(held) == BLOCK):
                    yield out()
                    held = []
                held.append(row)
                last = row
        if held:
            yield out()

    order = ["pivot", "dist", "vec_id", "label", "v"]
    return rows.repartitionByRange(*order[:3]).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


@dataclass
class Searches:
    """For each anchor (rows of ids, labels, v; near: distances to the pivots) ranges of scores: least and most, one column a band. A range with
    least over most finds nothing. same: rows of the anchor's label are looked for, else rows of the others."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    near: np.ndarray
    longest: float
    least: np.ndarray
    most: np.ndarray
    same: bool
    k: int
    score: np.ndarray = field(init=False)
    found: np.ndarray = field(init=False)
    read: int = 0

    def __post_init__(self) -> None:
        shape = (*self.least.shape, self.k)
        self.score, self.found = np.full(shape, -np.inf), np.full(shape, LAST)
        self.square = (self.v * self.v).sum(axis=1)

    def _merge(self, rows: np.ndarray, band: int, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores s (nan where a row doesn't count) of `ids` for the anchors `rows`: the best k of each stay, ties to the smaller id."""
        last, last_id = self.score[rows, band, -1], self.found[rows, band, -1]
        bar = np.maximum(self.least[rows, band], last)[:, None]
        hit = (s > bar) | ((s == bar) & ((bar > last[:, None]) | (ids[None] < last_id[:, None])))
        hit &= s <= self.most[rows, band][:, None]
        if hit.sum() > 4 * self.k * len(rows) and s.shape[1] > self.k:
            top = np.partition(np.where(hit, s, -np.inf), -self.k, axis=1)[:, -self.k]
            hit &= s >= top[:, None]
        r, c = np.nonzero(hit)
        if not len(r):
            return
        some = np.unique(r)
        at = rows[some]
        who = np.concatenate([np.repeat(np.arange(len(some)), self.k), np.searchsorted(some, r)])
        score = np.concatenate([self.score[at, band].ravel(), s[r, c]])
        found = np.concatenate([self.found[at, band].ravel(), ids[c]])
        order = np.lexsort((found, -score, who))
        begin = np.searchsorted(who[order], np.arange(len(some)))
        first = order[begin[:, None] + np.arange(self.k)[None]]
        self.score[at, band], self.found[at, band] = score[first], found[first]

    def compare(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        """The anchors `rows` against the rows of one block."""
        for a in range(0, len(rows), TOGETHER):
            some = rows[a : a + TOGETHER]
            s = self.v[some] @ x.T
            out = ((self.labels[some][:, None] == labels[None]) != self.same) | (self.ids[some][:, None] == ids[None])
            s[out] = np.nan
            for band in range(self.least.shape[1]):
                self._merge(some, band, s, ids)
        self.read += len(rows)

    def walk(self, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray, block) -> None:
        """All blocks, each given by its key interval; block(i) has its ids, labels and vectors. Nearest intervals first, then twice as many each time."""
        own = self.near[:, pivot]
        gap = np.maximum(np.maximum(lo[None] - own, own - hi[None]), 0)
        slack = 1e-6 * (1 + self.longest)
        best = (self.square[:, None] + self.longest - gap * gap) / 2 + slack
        worst = (self.square[:, None] + self.longest - (own + hi[None]) ** 2) / 2 - slack
        place = np.empty(gap.shape, np.int64)
        np.put_along_axis(place, np.argsort(gap, axis=1, kind="stable"), np.arange(gap.shape[1])[None], axis=1)
        start, end = 0, 1
        while start < len(pivot):
            for i in np.flatnonzero(((place >= start) & (place < end)).any(axis=0)):
                bar = np.maximum(self.least, self.score[:, :, -1])
                can = (best[:, i, None] >= bar) & (worst[:, i, None] <= self.most) & (self.least <= self.most)
                rows = np.flatnonzero(can.any(axis=1) & (place[:, i] >= start) & (place[:, i] < end))
                if len(rows):
                    self.compare(rows, *block(i))
            start, end = end, 2 * end


def floors(search: Searches, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The k-th best score among the sample's rows, per anchor and band (their least where the sample has fewer): at least k rows reach it."""
    for a in range(0, len(ids), BLOCK):
        search.compare(np.arange(len(search.ids)), ids[a : a + BLOCK], labels[a : a + BLOCK], x[a : a + BLOCK])
    return np.maximum(search.least, search.score[:, :, -1])


def searched(stored: DataFrame, search: Searches, dim: int) -> DataFrame:
    """Stored blocks() -> FOUND: per anchor (its place) and band the best k, best first as rank."""
    sent = stored.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        s = Searches(s.ids, s.labels, s.v, s.near, s.longest, s.least, s.most, s.same, s.k)
        for b in batches:
            if not b.num_rows:
                continue
            pivot, lo, hi = (b.column(i).to_numpy() for i in range(3))

            def block(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                ids, labels = (b.column(c)[i].values.to_numpy() for c in (3, 4))
                return ids, labels, np.frombuffer(b.column(5)[i].as_py(), "<i4").reshape(-1, dim).astype(np.float64)

            s.walk(pivot, lo, hi, block)
        a, band, k = np.nonzero(s.score > -np.inf)
        yield batch({"a": pa.array(a, pa.int32()), "band": pa.array(band, pa.int32()), "vec_id": pa.array(s.found[a, band, k]), "score": pa.array(s.score[a, band, k].astype(np.int64))})

    order = Window.partitionBy("a", "band").orderBy(F.desc("score"), "vec_id")
    return stored.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """vectors (vec_id, label, v: whole numbers) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`, an anchor's positives the first `positives` other rows of its label, and a positive's
    negatives the first `negatives` rows of other labels whose score is from low hundredths of the positive's up to all of it; first are higher
    inner products, ties by the smaller vec_id. Rows without an id or a label, null and empty vectors and those with null or non-finite components take no
    part, nor do vectors of another length than most (of equally frequent ones the longest). Rows equal in id, label and vector count once;
    rows that share an id alone count each, and none is another row to an anchor of its id. Squared lengths from 2^52 on raise. Extra columns are not read; no rows give no rows.
    """
    return kept(vectors.sparkSession, "negatives", lambda: _mined(vectors, every, positives, negatives, low))


def _mined(vectors: DataFrame, every: int, positives: int, negatives: int, low: int) -> DataFrame:
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(vectors)
    square = F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("most")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], out)
    dim, total, most = lengths
    if most >= EXACT:
        raise ValueError(f"squared length {most:g}: scores are exact under {EXACT:g} only")
    rows = rows.where(F.size("v") == dim)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30))
    some = rows.where(draw < min(1 << 30, int(0.9 * SAMPLE / total * (1 << 30)))) if total > SAMPLE else rows
    got = some.distinct().orderBy("vec_id", "label").limit(SAMPLE).collect()
    sample = np.array([r.vec_id for r in got], np.int64), np.array([r.label for r in got], np.int64), np.array([r.v for r in got]).reshape(-1, dim)
    pivots = choose_pivots(longer(sample[2], most), min(len(got), MOST_PIVOTS, max(1, round(total**0.5 / 8)))) if got else np.zeros((1, dim + 1))
    stored = materialise(keyed(rows, dim, most, pivots), "keyed")
    anchors = stored.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "label", "v").distinct()
    slices = -(-anchors.count() * (dim + len(pivots) + 64) * 8 // SLICE_BYTES)
    index = materialise(blocks(stored), "blocks")
    done = [_slice(index, anchors.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(slices)) == i), dim, most, pivots, sample, positives, negatives, low) for i in range(slices)]
    return reduce(DataFrame.unionAll, done) if done else spark.createDataFrame([], out)


def _slice(index: DataFrame, anchors: DataFrame, dim: int, most: float, pivots: np.ndarray, sample: tuple, positives: int, negatives: int, low: int) -> DataFrame:
    """The result for one slice of the anchors, written."""
    got = anchors.orderBy("vec_id", "label").collect()
    ids, labels = np.array([r.vec_id for r in got], np.int64), np.array([r.label for r in got], np.int64)
    v = np.array([np.frombuffer(r.v, "<i4") for r in got], np.float64).reshape(-1, dim)
    near = distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1), pivots)

    def search(least: np.ndarray, upto: np.ndarray, same: bool, k: int) -> DataFrame:
        ask = Searches(ids, labels, v, near, most, least, upto, same, k)
        return searched(index, Searches(ids, labels, v, near, most, floors(ask, *sample), upto, same, k), dim)

    any_score = np.full((len(ids), 1), np.inf)
    best = search(-any_score, any_score, True, positives).collect()
    of, score = np.full((len(ids), positives), LAST), np.full((len(ids), positives), -1.0)
    for r in best:
        of[r.a, r["rank"] - 1], score[r.a, r["rank"] - 1] = r.vec_id, r.score
    # a positive under 0 has no negatives: the range is empty
    least = -(-score.astype(np.int64) * low // 100)
    found = search(np.where(score >= 0, least, np.inf), score, False, negatives)
    names = pa.table({"a": pa.array(np.repeat(np.arange(len(ids)), positives), pa.int32()), "band": pa.array(np.tile(np.arange(positives), len(ids)), pa.int32()), "anchor_id": np.repeat(ids, positives), "positive_id": of.ravel(), "positive_score": score.ravel().astype(np.int64)})
    named = F.broadcast(index.sparkSession.createDataFrame(names))  # a slice is bounded
    made = found.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(named, ["a", "band"])
    return materialise(made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "slice")

"""Near-duplicates by bottom-k sketches from one hash function.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit fingerprint of
   the set and its bottom-k sketch (the k smallest of one hash). Documents with equal sets become one class.
2. Inverted lists over the retained values: a list's key is a run of r consecutive retained values. Two
   sets of similarity t that are kept whole always share such a run for the r of their size (pigeonhole over
   their differing elements, see tiers()); for sketches the chance of no shared run is below 1e-5 at t.
   In each list, members are paired with the one that shares the most lists: a star, never all pairs.
3. The number of shared lists picks each document's best partner, the union sketch estimates the
   similarity, and the exact Jaccard index of the full sets decides.
4. Components of the links found are built. Then nothing is left to chance: every class is listed under so many of its rarest shingles (long
   ones: rarest runs of two) that two sets at the threshold must share one, and pairs in a list that are still in different components, and whose sizes and odd
   sketches allow it, are compared on their full sets, without an estimate. What is rare is known from a bounded sample; it orders the shingles,
   the same way for all sets, and no pair depends on it.

Shingles are compared by 64-bit hashes: two different ones are taken for one with a probability of 2^-64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import batch, kept, materialise, maybe_broadcast
from .graph import connected_components

SKETCH = 96
#: Bits of an odd sketch; it tells sets apart as long as their bound is well under half of that. Longer sets than LONG are listed under runs.
ODD_BITS, LONG = 1024, 1500
#: Bits of the odd sketches that pairs of longer sets are told apart by, before their sets meet.
WIDE_BITS = 1 << 14
#: Standard deviations that an estimate may lie under the threshold; what it drops is left to the prefixes.
SLACK = 4.5
#: Classes whose shingles tell what is common, and how many common ones are sent to all tasks, at most.
SAMPLE, COMMON = 4096, 1 << 18
#: Members of a list up to which lists with the same members are met once.
SHORT = 16
#: Rows of key lists that one flush of the map-side combiner holds.
FLUSH = 1 << 20


def tiers(percent: int, sketch: int = SKETCH) -> list[tuple[int, int, int]]:
    """(r, smallest, largest set size) of the key lists: any two sets of sizes within percent of each other that differ
    and reach the threshold share a run of r hashes in a tier that both belong to."""

    def sure(u: int) -> int:
        d = u - math.ceil(percent * u / 100)
        return 10**9 if d < 1 else math.ceil((u - d) / (d + 1))

    top = 4096
    floor = [0] * (top + 2)
    floor[top + 1] = math.ceil(percent / (100 - percent)) if percent < 100 else 64
    for u in range(top, 0, -1):
        floor[u] = min(floor[u + 1], sure(u))
    out, hi = [], 1 << 62
    while hi > 0:
        reach = min(hi, top)
        u = reach
        while u > max(1, reach // 4 if hi > top else reach // 2) or (u > 1 and floor[u - 1] == floor[u]):
            u -= 1
        if hi > top:  # the longest run that is still sure at this size
            u = next(i for i in range(1, top + 1) if floor[i] == floor[top])
        r = max(1, floor[u])
        out.append((r, max(1, math.ceil(percent * u / 100)), hi))
        hi = u - 1
        if hi < 1 or all(sure(i) == 10**9 for i in range(1, hi + 1)):
            break
    return out


def _prefix(n: int, percent: int) -> int:
    """Of the values of a set of n, in one order for all sets, so many first ones that it shares one of them with any set that reaches the threshold."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _sketches(size: int, sketch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, hi, data, offsets in K.chunks(texts):
                h, before, _ = K.words(data, offsets, K.BLANK_WORDS)
                sets = K.shingle_hashes(h, before, size)
                fp = [((int(x.sum(dtype=np.uint64)) ^ len(x)) - (1 << 63), int(K.mix(x ^ K._C1).sum(dtype=np.uint64)) - (1 << 63)) for x in sets]
                yield batch({
                    "doc_id": ids.slice(lo, hi - lo),
                    "n": pa.array([len(x) for x in sets], pa.int64()),
                    "f1": pa.array([x for x, _ in fp], pa.int64()),
                    "f2": pa.array([y for _, y in fp], pa.int64()),
                    "sketch": pa.array([x[:sketch].tobytes() for x in sets], pa.binary()),
                    "odd": pa.array([_odd(x) for x in sets], pa.binary()),
                })

    return run


def _runs(x: np.ndarray, r: int) -> np.ndarray:
    key = np.full(len(x) - r + 1, np.uint64(r), np.uint64)
    for j in range(r):
        key = key * K._MULT + x[j : len(x) - r + 1 + j]
    return K.mix(key).view(np.int64)


def _odd(x: np.ndarray, bits: int = ODD_BITS) -> bytes:
    """Odd sketch: the parity of how many values fall on each of the bits. Two differ in at most as many bits as the sets in values."""
    return np.packbits(np.bincount((x >> np.uint64(20)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1).tobytes()


def _near_enough(percent: int) -> str:
    """SQL: whether two sets l and r can reach the threshold by size and by odd sketches, which differ in no more bits than the sets in values. Nothing is lost."""
    apart = " + ".join(f"bit_count(l.o{i} ^ r.o{i})" for i in range(ODD_BITS // 64))
    return f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) and {apart} <= (l.n + r.n) * {100 - percent} div {100 + percent}"


def _listed(rows):
    """Rows (key, doc, n, kind) of rows(batch), which gives (doc, n, its distinct keys). kind 0: alone with its key among the rows that one flush holds; 1: the first of
    several; 2: another of them, already known to share its list, so that a very long list need not meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, sizes, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, docs, sizes, held
            if not held:
                return
            k, d, n = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes)
            order = np.argsort(k, kind="stable")
            k, d, n = k[order], d[order], n[order]
            same = k[1:] == k[:-1]
            after, before = np.append(False, same), np.append(same, False)
            kind = np.where(after, 2, np.where(before, 1, 0)).astype(np.int32)
            for a in range(0, len(k), 200_000):
                s = slice(a, a + 200_000)
                yield batch({"key": pa.array(k[s]), "doc": pa.array(d[s]), "n": pa.array(n[s]), "kind": pa.array(kind[s])})
            keys, docs, sizes, held = [], [], [], 0

        for b in batches:
            for doc, n, k in rows(b):
                if len(k):
                    keys.append(k), docs.append(np.full(len(k), doc, np.int64)), sizes.append(np.full(len(k), n, np.int64))
                    held += len(k)
                if held >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


LISTED = "key long, doc long, n long, kind int"


def _run_keys(levels: list[tuple[int, int, int]]):
    """Of (rep, n, sketch): a class under its runs of retained values."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for doc, n, sketch in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = np.frombuffer(sketch, np.uint64)
            k = [_runs(x, r) for r, lo, hi in levels if lo <= n <= hi and len(x) >= r]
            yield doc, n, np.unique(np.concatenate(k)) if k else np.zeros(0, np.int64)

    return rows


def listed_under(x: np.ndarray, percent: int, common: np.ndarray, times: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a set x (sorted hashes) such that it shares one with any set that reaches the threshold; common: sorted hashes that the sample has more than once, times: how often.
    With each key how many more the whole order has behind it, and whether it is a run.

    Sets of up to `long` values have their prefix: by rising count in the sample, then by hash, so many values that not all can differ. Longer sets would meet in single values by
    chance; they have runs of two. If u values of a union hold i common ones, at least i - (u - i + 1) pairs of common neighbours have nothing between them, which is (2 t - 1) n - 1 at least for
    a set of n: a prefix of the runs, by count and hash too, that leaves out fewer. Sets that a shorter one may be near to have both."""
    seen = np.zeros(len(x), np.int64)
    if len(common) and len(x):
        at = np.searchsorted(common, x)
        at[at == len(common)] = 0
        seen = np.where(common[at] == x, times[at], 0)
    parts = []
    alike = -(-(2 * percent - 100) * len(x) // 100) - 1
    if len(x) * percent <= 100 * long or alike < 1:
        k = _prefix(len(x), percent)
        parts.append((x[np.lexsort((x, seen))[:k]].view(np.int64), len(x) - 1 - np.arange(k), np.zeros(k, bool)))
    if len(x) > long and alike >= 1:
        runs = _runs(x, 2)
        k = len(x) - alike
        parts.append((runs[np.lexsort((runs, seen[:-1] + seen[1:]))[:k]], len(runs) - 1 - np.arange(k), np.ones(k, bool)))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _early_enough(percent: int) -> str:
    """SQL: whether a key that two sets share may be the first one in the order of all keys: it and what both have behind it must still make up what sets of such sizes at the threshold
    have in common. Of the keys that a pair shares the first one passes, and in pairs under the threshold, whose rare shingles differ, mostly none."""
    alike = f"(({percent} * (l.n + r.n) + {99 + percent}) div {100 + percent})"
    return f"l.run = r.run and 1 + least(l.behind, r.behind) >= if(l.run, 3 * {alike} - (l.n + r.n) - 1, {alike})"


def _prefix_rows(size: int, percent: int, sent):
    """Of (doc_id, text, c): a class under its rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = sent.value
        for b in batches:
            ids, parts = b.column(0).to_numpy(), b.column(2).to_numpy()
            for lo, hi, data, offsets in K.chunks(b.column(1)):
                h, before, _ = K.words(data, offsets, K.BLANK_WORDS)
                listed = [listed_under(x, percent, common, times) for x in K.shingle_hashes(h, before, size)]
                n = [len(k) for k, _, _ in listed]
                key, behind, run_ = (np.concatenate([x[i] for x in listed]) for i in range(3))
                yield batch({"key": pa.array(key), "doc": pa.array(np.repeat(ids[lo:hi], n)), "c": pa.array(np.repeat(parts[lo:hi], n)), "behind": pa.array(behind.astype(np.int32)), "run": pa.array(run_)})

    return run


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in K.chunks(b.column(1)):
                h, before, _ = K.words(data, offsets, K.BLANK_WORDS)
                for x in K.shingle_hashes(h, before, size):
                    yield batch({"key": pa.array(x.view(np.int64))})

    return run


def _estimate(sketch: int):
    """Adds the union-sketch estimate of the similarity and the number of values it rests on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            est, base = [], []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = np.append(both[1:] == both[:-1], False)
                distinct = both[np.concatenate([[True], ~same[:-1]])]
                bottom = distinct[:sketch]
                hit = int(np.searchsorted(both[same], bottom[-1], side="right")) if len(bottom) else 0
                est.append(hit / max(1, len(bottom))), base.append(len(bottom))
            yield batch({"a": b.column(0), "b": b.column(1), "est": pa.array(est, pa.float64()), "base": pa.array(base, pa.int64())})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, data, offsets in K.chunks(b.column(1)):
                h, before, _ = K.words(data, offsets, K.BLANK_WORDS)
                sets = K.shingle_hashes(h, before, size)
                wide = pa.array([_odd(x, WIDE_BITS) for x in sets], pa.binary())
                yield batch({"doc": ids.slice(lo, hi - lo), "m": pa.array([len(x) for x in sets], pa.int64()), "wide": wide, "items": pa.array([x.tobytes() for x in sets], pa.binary())})

    return run


def _not_apart(percent: int):
    """Of (a, b, ma, mb, wa, wb): the pairs whose wide odd sketches differ in no more bits than two sets of such sizes at the threshold may in values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (b.column(2).to_numpy() + b.column(3).to_numpy()) * (100 - percent) // (100 + percent)
            apart = [int(np.bitwise_count(np.frombuffer(p, np.uint64) ^ np.frombuffer(q, np.uint64)).sum()) for p, q in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            keep = pa.array(np.array(apart, np.int64) <= most)
            yield batch({"a": b.column(0).filter(keep), "b": b.column(1).filter(keep)})

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter) and inter > 0)
            keep = pa.array(ok, pa.bool_())
            yield batch({"a": b.column(0).filter(keep), "b": b.column(1).filter(keep)})

    return run


def _confirm(pairs: DataFrame, sketches: DataFrame | None, documents: DataFrame, percent: int, size: int, sketch: int) -> DataFrame:
    """Links (a, b) among candidate pairs (a, b): estimate on the sketches, if given, then exact on the sets of the texts involved."""
    side = lambda c, as_: F.col(c).alias(as_)
    likely = materialise(pairs.select("a", "b") if sketches is None else _likely(pairs, sketches, percent, sketch), "likely")
    need = likely.select(side("a", "doc_id")).unionAll(likely.select(side("b", "doc_id"))).distinct()
    texts = documents.select("doc_id", "text").join(maybe_broadcast(need, 16), "doc_id", "left_semi")
    sets = materialise(texts.mapInArrow(K.tidy(_sets(size)), "doc long, m long, wide binary, items binary"), "sets")
    if sketches is None:  # pairs that no sketch has judged: few of them are near, so their sets should not meet
        both = likely.join(sets.select(side("doc", "a"), side("m", "ma"), side("wide", "wa")), "a").join(sets.select(side("doc", "b"), side("m", "mb"), side("wide", "wb")), "b")
        likely = materialise(both.select("a", "b", "ma", "mb", "wa", "wb").mapInArrow(K.tidy(_not_apart(percent)), "a long, b long"), "near")
    full = likely.join(sets.select(side("doc", "a"), side("items", "xa")), "a").join(sets.select(side("doc", "b"), side("items", "xb")), "b")
    return full.select("a", "b", "xa", "xb").mapInArrow(K.tidy(_exact(percent)), "a long, b long").distinct()


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int, sketch: int) -> DataFrame:
    side = lambda c, as_: F.col(c).alias(as_)
    both = pairs.select("a", "b").join(sketches.select(side("rep", "a"), side("sketch", "sa")), "a").join(sketches.select(side("rep", "b"), side("sketch", "sb")), "b")
    t = percent / 100
    slack = F.when(F.col("base") >= sketch, SLACK * F.sqrt(F.lit(t * (1 - t)) / F.col("base"))).otherwise(1e-9)
    return both.select("a", "b", "sa", "sb").mapInArrow(K.tidy(_estimate(sketch)), "a long, b long, est double, base long").where(F.col("est") >= t - slack).select("a", "b")


def _shared_lists(made: DataFrame) -> DataFrame:
    """_listed() rows -> (key, doc, n), written: the lists with several members."""
    lists = materialise(made, "lists")
    window = "over (partition by key order by doc)"
    alone = lists.where("kind < 2").selectExpr("key", "doc", "n", "kind", f"lag(key) {window} as x", f"lead(key) {window} as y")
    shared = alone.where("kind = 1 or x is not null or y is not null").select("key", "doc", "n").unionAll(lists.where("kind = 2").select("key", "doc", "n"))
    return materialise(shared, "shared")


def _partners(classes: DataFrame, percent: int, sketch: int) -> DataFrame:
    """(a, b): for each class the head with which it shares the most lists of runs."""
    shared = _shared_lists(classes.select("rep", "n", "sketch").mapInArrow(K.tidy(_listed(_run_keys(tiers(percent, sketch)))), LISTED))
    # a list's head is the member with the most shared lists: what others were copied from shares more than copies do
    weight = shared.groupBy("doc").agg(F.count("*").alias("w"))
    shared = materialise(shared.join(weight, "doc").select("key", "doc", "n", "w"), "weighted")
    heads = shared.groupBy("key").agg(F.max(F.struct("w", -F.col("doc"), "n")).alias("h")).select("key", (-F.col("h.col2")).alias("head"), F.col("h.n").alias("m"))
    star = shared.join(heads, "key").where(f"doc <> head and 100 * least(n, m) >= {percent} * greatest(n, m)")
    best = star.groupBy(F.col("doc").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("times"))
    return best.groupBy("a").agg(F.max_by("b", F.struct("times", -F.col("b"))).alias("b"))


def _prefixes(classes: DataFrame, documents: DataFrame, parts: DataFrame, percent: int, size: int) -> DataFrame:
    """(key, doc, c, behind, run): the lists of prefixes whose members are in several components. Most keys are a class's own, so of them only key and component are shuffled."""
    spark = documents.sparkSession
    nodes = parts.select(F.col("node").alias("doc_id"), "component")
    reps = classes.select(F.col("rep").alias("doc_id")).join(maybe_broadcast(nodes, 24), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("c"))
    texts = documents.join(maybe_broadcast(reps, 24), "doc_id").select("doc_id", "text", "c")
    draw = F.pmod(F.xxhash64(F.lit("common"), "doc_id"), F.lit(max(1, classes.count()))) < SAMPLE
    counted = texts.where(draw).mapInArrow(K.tidy(_shingles(size)), "key long").groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    got = counted.orderBy(F.desc("times"), "key").limit(COMMON).toArrow()
    known = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    sent = spark.sparkContext.broadcast((known[order], got["times"].to_numpy()[order]))
    rows = materialise(texts.mapInArrow(K.tidy(_prefix_rows(size, percent, sent)), "key long, doc long, c long, behind int, run boolean"), "prefixes")
    mixed = rows.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    return rows.join(maybe_broadcast(materialise(mixed, "mixed"), 16), "key", "left_semi")


def _rest(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of _prefixes() rows in different components that size and odd sketches allow. Short lists that hold the same members, as two texts that share much have many of, are one
    list; in longer ones members meet over keys that may be a pair's first."""
    ends = [F.conv(F.hex(F.substring("odd", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"o{i}") for i in range(ODD_BITS // 64)]
    odd = materialise(classes.join(rows.select(F.col("doc").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("doc"), "n", *ends), "odd")
    members = materialise(rows.groupBy("key").agg(F.count("*").alias("members")), "members")
    rows = rows.join(maybe_broadcast(members, 16), "key").join(maybe_broadcast(odd.select("doc", "n"), 16), "doc")
    short = rows.where(F.col("members") <= SHORT).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("doc", "c", "n"))).alias("m")).select("m").distinct()
    met = F.expr(f"explode(flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, {SHORT}), y -> x.c <> y.c and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)), y -> struct(y.doc as a, x.doc as b)))))")
    pairs = short.select(met.alias("p")).select("p.a", "p.b").distinct()
    near = pairs.join(odd.alias("l"), F.expr("a = l.doc")).join(odd.alias("r"), F.expr("b = r.doc")).where(_near_enough(percent)).select("a", "b")
    long = rows.where(F.col("members") > SHORT).drop("n").join(odd, "doc")
    apart = long.alias("l").join(long.alias("r"), F.expr(f"l.key = r.key and l.c < r.c and {_early_enough(percent)} and {_near_enough(percent)}"))
    return near.unionAll(apart.select(F.greatest("l.doc", "r.doc").alias("a"), F.least("l.doc", "r.doc").alias("b"))).distinct()


def _components(classes: DataFrame, documents: DataFrame, percent: int, size: int, sketch: int) -> DataFrame:
    """(node, component) over the representatives of classes that have links."""
    spark = documents.sparkSession
    best = kept(spark, "best", lambda: _partners(classes, percent, sketch))
    sketches = classes.select("rep", "sketch")
    links = kept(spark, "links", lambda: _confirm(best, sketches, documents, percent, size, sketch))
    parts = kept(spark, "components", lambda: connected_components(links))
    rows = kept(spark, "rows", lambda: _prefixes(classes, documents, parts, percent, size))
    rest = kept(spark, "rest", lambda: _rest(rows, classes, percent))
    more = kept(spark, "more", lambda: _confirm(rest, None, documents, percent, size, sketch))
    return connected_components(links.unionAll(more))


def near_duplicates(documents: DataFrame, percent: int = 80, size: int = 5, sketch: int = SKETCH) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, n_shingles, component_id, kept).

    Words are runs without blank space, A-Z lower-cased; a set holds the distinct shingles of `size` words, or
    the whole sequence if there are fewer. Two documents link if 100 * |intersection| >= percent * |union|.
    Null and empty texts have an empty set and link with nothing. Rows that repeat a doc_id count as one
    document. A row without doc_id is linked with nothing: its component is null and it is not kept. Columns beside doc_id and text
    are not read. An empty table gives an empty result.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_ = materialise(documents.mapInArrow(K.tidy(_sketches(size, sketch)), "doc_id long, n long, f1 long, f2 long, sketch binary, odd binary"), "sketches")
    real = all_.where("n > 0 and doc_id is not null")
    # one class per set; the sketch of a class is the same whichever row it comes from
    classes = real.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "sketch", "odd")).alias("x"), F.count("*").alias("copies"))
    classes = materialise(classes.select("f1", "f2", "n", F.col("x.doc_id").alias("rep"), F.col("x.sketch").alias("sketch"), F.col("x.odd").alias("odd"), "copies"), "classes")
    spark = documents.sparkSession
    parts = kept(spark, "components", lambda: _components(classes, documents, percent, size, sketch))
    comp = classes.where("copies > 1").select("f1", "f2", "n", "rep").join(parts, F.col("rep") == F.col("node"), "left")
    single = classes.where("copies = 1").select("f1", "f2", "n", "rep").join(parts, F.col("rep") == F.col("node"))
    known = comp.unionAll(single).select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    out = all_.select("doc_id", "n", "f1", "f2").join(known, ["f1", "f2", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))

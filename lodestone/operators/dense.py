"""Exact vector search: inner products of all queries with all rows, the k best each.

Over a plain table every batch is multiplied with the queries. A stored index has its rows in blocks around centres: q x = q c + q (x - c) is at most q c + |q| r for the
radius r of a block, so a query passes over blocks that cannot reach the k-th best it has, and the result is still exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.store import materialise

#: Bytes of query vectors that one pass broadcasts; more queries take more passes over the rows.
SLICE_BYTES = 32 << 20
#: Scores that a task holds at once, and pairs whose scores are summed at once.
SCORES, PAIRS = 2 << 20, 1 << 14


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, on: list[str] | None = None) -> DataFrame:
    """vectors (id, v, *on), queries (query_id, v, *on) -> (query_id, rank, id, score); ties to the smaller id.

    With `on`, a query sees only rows that equal it in those columns; a null there asks for nothing. Queries go to the rows in slices of
    bounded size, one after the other, and are multiplied with the rows of each Arrow batch that they may see, so many of them at a time that a task holds SCORES scores; only what may be among the task's k best leaves a batch, so
    no row is shuffled, whatever many of them share.
    """
    on = on or []
    kinds = to_arrow_type(queries.schema["query_id"].dataType), dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    n, size = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    slices = max(1, -(-(n * (size or 0) * 8) // SLICE_BYTES))
    parts = []
    for s in range(slices):
        part = queries if slices == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s)
        groups: dict[tuple, tuple[list, list]] = {}
        for r in part.select("query_id", "v", *on).collect():
            names, rows = groups.setdefault(tuple(r[2:]), ([], []))
            names.append(r[0]), rows.append(r[1])
        sent = vectors.sparkSession.sparkContext.broadcast({key: (names, np.array(rows, np.float64)) for key, (names, rows) in groups.items()})
        best = top_k(vectors.select("id", "v", *on).mapInArrow(_best_of_batch(sent, k, kinds[0], len(on)), f"query_id {kinds[1]}, id {kinds[2]}, score double"), k)
        if slices > 1:
            best = materialise(best, "best")
            sent.unpersist()
        parts.append(best)
    return reduce(DataFrame.unionAll, parts).select("query_id", "rank", "id", "score")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of_batch(sent, k: int, kind: pa.DataType, filters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            columns = [b.column(2 + j) for j in range(filters)]
            for key, (names, q) in sent.value.items():
                seen = np.ones(b.num_rows, bool)
                for column, x in zip(columns, key, strict=True):
                    if x is not None:
                        seen &= pc.fill_null(pc.equal(column, pa.scalar(x, column.type)), False).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(seen)
                if not len(rows):
                    continue
                mine, low = v[rows], floors.setdefault(key, np.full(len(q), -np.inf))
                step = max(1, SCORES // len(rows))
                for at in range(0, len(q), step):
                    s = q[at : at + step] @ mine.T
                    if s.shape[1] >= k:
                        # k rows reach the cut, so nothing under it is asked for in later batches either
                        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                        low[at : at + step] = np.fmax(low[at : at + step], cut)
                    # ties by id must survive the cut, so everything that equals the k-th stays
                    i, j = np.nonzero(~(s < low[at : at + step, None] - 1e-9))
                    for p in range(0, len(i), PAIRS):
                        x, y = i[p : p + PAIRS] + at, j[p : p + PAIRS]
                        exact = np.add.accumulate(q[x] * mine[y], axis=1)[:, -1]
                        yield pa.RecordBatch.from_arrays([pa.array([names[n] for n in x], kind), b.column(0).take(pa.array(rows[y])), pa.array(exact)], names=["query_id", "id", "score"])

    return run


#: Rows that centres come from at most, centres at most, and rows of a block.
SAMPLE, CENTRES, BLOCK = 4096, 256, 256


def choose_centres(x: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """n means of the rows x."""
    centres = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)[0]
        centres = np.stack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(n)])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T
    own = d.argmin(axis=1)
    return own, np.sqrt(np.maximum(d[np.arange(len(x)), own], 0))


def block_index(vectors: DataFrame, keep: list[str] | None = None, dim: int | None = None) -> DataFrame:
    """vectors (id, v, *keep) -> blocks (middle, radius, ids, v, a list of each kept column): rows beside one another have the same centre and lie about as far from it. Rows
    without an id or a vector are not indexed; vectors of another length than `dim` (the first one's, if not given) raise."""
    keep, spark = keep or [], vectors.sparkSession
    rows = vectors.where("id is not null and v is not null").select("id", F.col("v").cast("array<double>").alias("v"), *keep)
    total = rows.count()
    share = F.pmod(F.xxhash64(F.lit("centres"), F.col("id").cast("string")), F.lit(max(1, total))) < SAMPLE
    got = rows.where(share).select("v").limit(2 * SAMPLE).collect() or rows.select("v").take(1)
    dim = dim or (len(got[0].v) if got else 0)
    rows = rows.withColumn("v", F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(F.lit(f"vector without {dim} components")).cast("array<double>")))
    sample = [r.v for r in got if len(r.v) == dim]
    sample = np.array(sample, np.float64).reshape(len(sample), dim)
    sent = spark.sparkContext.broadcast(choose_centres(sample, min(len(sample), CENTRES, max(1, round(total**0.5 / 8)))) if len(sample) else np.zeros((1, dim)))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in ("id", *keep)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, d = _nearest(np.array(b.column(1).flatten(), np.float64).reshape(b.num_rows, dim), sent.value) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(d), *b.columns], names=["centre", "apart", *b.schema.names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            centre, x = b.column(0).to_numpy(), np.array(b.column(3).flatten(), np.float64).reshape(-1, dim)
            edges = np.flatnonzero(np.diff(centre)) + 1
            starts = sorted({0, *edges.tolist(), *range(0, b.num_rows, BLOCK)})
            for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
                middle = x[a:z].mean(axis=0)  # the block's own, so its radius is small
                radius = float(np.sqrt(((x[a:z] - middle) ** 2).sum(axis=1).max()))
                lists = [pa.array([b.column(i).slice(a, z - a).to_pylist()], pa.list_(b.column(i).type)) for i in (2, *range(4, b.num_columns))]
                yield pa.RecordBatch.from_arrays([pa.array([middle.tolist()]), pa.array([radius]), lists[0], pa.array([x[a:z].tobytes()], pa.binary()), *lists[1:]], names=["middle", "radius", "ids", "v", *keep])

    kinds = dict(rows.dtypes)
    near = rows.mapInArrow(assign, ", ".join(["centre int", "apart double", kept[0], "v array<double>", *kept[1:]]))
    ordered = near.repartitionByRange("centre", "apart", "id").sortWithinPartitions("centre", "apart", "id")
    return ordered.mapInArrow(pack, ", ".join(["middle array<double>", "radius double", f"ids array<{kinds['id']}>", "v binary", *[f"`{c}` array<{kinds[c]}>" for c in keep]]))


def search_blocks(index: DataFrame, queries: DataFrame, k: int, on: list[str] | None = None) -> DataFrame:
    """exact_top_k() over stored block_index() rows: the same result, without reading the blocks whose bound is under what a query has already."""
    on, id_kind = on or [], index.schema["ids"].dataType.elementType
    kinds = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(id_kind)
    n, size = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    slices = max(1, -(-(n * (size or 0) * 8) // SLICE_BYTES))
    parts = []
    for s in range(slices):
        part = queries if slices == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s)
        got = part.select("query_id", "v", *on).collect()
        sent = index.sparkSession.sparkContext.broadcast(BlockSearch([r[0] for r in got], np.array([r[1] for r in got], np.float64).reshape(len(got), size or 0), [[r[2 + j] for r in got] for j in range(len(on))], k))
        found = index.select("middle", "radius", "ids", "v", *on).mapInArrow(_walked(sent, kinds), f"query_id {dict(queries.dtypes)['query_id']}, id {id_kind.simpleString()}, score double")
        best = top_k(found, k)
        parts.append(best if slices == 1 else materialise(best, "best"))
    return reduce(DataFrame.unionAll, parts).select("query_id", "rank", "id", "score")


class BlockSearch:
    """The k best of each query (names, rows of q, what they filter by) over blocks given one after the other; read counts the queries that a block was read for, passed those it was not."""

    def __init__(self, names: list, q: np.ndarray, filters: list[list], k: int) -> None:
        self.names, self.q, self.filters, self.k = names, q, filters, k
        self.best: list[list[tuple]] = [[] for _ in names]  # (-score to 9 digits, id, score), best first
        self.last = np.full(len(names), -np.inf)
        self.read = self.passed = 0

    def bounds(self, middle: np.ndarray, radius: np.ndarray) -> np.ndarray:
        return self.q @ middle.T + np.linalg.norm(self.q, axis=1)[:, None] * radius[None]

    def add(self, bound: np.ndarray, ids: list, v: np.ndarray, tags: list[list]) -> None:
        alive = np.flatnonzero(bound >= self.last - 1e-6)
        self.read, self.passed = self.read + len(alive), self.passed + len(bound) - len(alive)
        for a in range(0, len(alive), 1024):
            some = alive[a : a + 1024]
            s = self.q[some] @ v.T
            for wanted, tag in zip(self.filters, tags, strict=True):
                codes = {x: i for i, x in enumerate(dict.fromkeys(tag))}
                have = np.array([codes[x] if x is not None else -2 for x in tag])
                want = np.array([-1 if (x := wanted[i]) is None else codes.get(x, -3) for i in some.tolist()])[:, None]
                s[(want != -1) & (want != have[None])] = -np.inf
            may = (s >= self.last[some][:, None] - 1e-8) & (s > -np.inf)
            for i in np.flatnonzero(may.any(axis=1)).tolist():
                at = np.flatnonzero(may[i])
                if len(at) > 4 * self.k:
                    at = at[s[i, at] >= np.partition(s[i, at], -self.k)[-self.k] - 1e-8]
                one = int(some[i])
                exact = np.add.accumulate(self.q[one][None] * v[at], axis=1)[:, -1]  # one order of summation, so equal vectors tie
                rows = [(-round(x, 9), ids[j], x) for j, x in zip(at.tolist(), exact.tolist(), strict=True)]
                self.best[one] = sorted(self.best[one] + rows, key=lambda r: r[:2])[: self.k]
                if len(self.best[one]) == self.k:
                    self.last[one] = -self.best[one][-1][0]


def _walked(sent, kinds: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask: BlockSearch = sent.value
        search = BlockSearch(ask.names, ask.q, ask.filters, ask.k)
        for b in batches:
            if not b.num_rows or not search.names:
                continue
            middle = np.array(b.column(0).flatten(), np.float64).reshape(b.num_rows, -1)
            bound = search.bounds(middle, b.column(1).to_numpy())
            for i in np.argsort(-bound.max(axis=0), kind="stable").tolist():
                v = np.frombuffer(b.column(3)[i].as_py(), np.float64).reshape(-1, middle.shape[1])
                search.add(bound[:, i], b.column(2)[i].as_py(), v, [b.column(4 + j)[i].as_py() for j in range(len(search.filters))])
        out = [(name, x[1], x[2]) for name, found in zip(search.names, search.best, strict=True) for x in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kinds[0]), pa.array([r[1] for r in out], kinds[1]), pa.array([r[2] for r in out], pa.float64())], names=["query_id", "id", "score"])

    return run

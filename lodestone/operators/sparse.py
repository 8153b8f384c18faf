"""BM25 (Okapi) index and search over all queries at once.

Documents are stored with their terms counted inside the row. A search sends the queries' weighted terms to the rows: each task scores its documents where they lie
and keeps k for each query, so no row per query and document ever leaves a task. Rows are scored in blocks, and a block's largest part of each term bounds
what any of its documents can score: queries whose k-th document is better skip the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import raw_financial_tokens
from ..sources.store import materialise

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query terms are broadcast up to so many rows; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Terms of the queries that one pass over the rows scores; more queries take more passes.
SLICE_TERMS = 200_000
#: Rows of a block, and cells (a row and a query) that are scored at once at most.
BLOCK, CELLS = 256, 1 << 21


@dataclass(frozen=True)
class SparseIndex:
    """rows (id, dl, p: array<struct<term, tf>> in order of the terms, and kept columns); terms (term, df, idf); stats (n, avgdl, avg_idf), one row."""

    rows: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(id, dl, term, tf)"""
        return self.rows.select("id", "dl", F.explode("p").alias("p")).select("id", "dl", "p.term", F.col("p.tf").cast("long").alias("tf"))

    @property
    def lengths(self) -> DataFrame:
        return self.rows.select("id", "dl")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if the counted rows are few, else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def count_terms(tokens: pa.ListArray) -> tuple[pa.Array, pa.ListArray]:
    """Per row the number of tokens and the list of (term, tf) in order of the terms."""
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    size = np.diff(tokens.offsets.to_numpy())
    flat = tokens.flatten().dictionary_encode()
    names = flat.dictionary
    order = pc.sort_indices(names).to_numpy()
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    key = np.repeat(np.arange(len(size)), size) * max(1, len(names)) + place[flat.indices.to_numpy(zero_copy_only=False)]
    known, tf = np.unique(key, return_counts=True)
    row, term = np.divmod(known, max(1, len(names)))
    pairs = pa.StructArray.from_arrays([names.take(pa.array(order[term])).cast(pa.string()), pa.array(tf, pa.int32())], names=["term", "tf"])
    return pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(size) + 1)), pa.int32()), pairs)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens=raw_financial_tokens, fold=F.lower, keep: list[str] = ()) -> SparseIndex:
    """Statistics are of the whole corpus and never of a filtered part. A term of negative idf gets EPSILON times the mean idf of all terms.

    Documents are tokenised once: rows with their counted terms are stored, with the columns of keep (what searches filter by), and only terms are shuffled, once, for
    their document frequencies."""
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("id"), *keep, F.transform(tokens(F.coalesce(F.col(text_col), F.lit(""))), fold).alias("t"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dl, p = count_terms(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], dl, p], names=[*b.schema.names[:-1], "dl", "p"])

    rows = materialise(read.mapInArrow(run, ", ".join([*fields, "dl int", "p array<struct<term:string,tf:int>>"])), "postings")
    n, avgdl = rows.agg(F.count("*"), F.avg("dl")).first()
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = materialise(rows.select(F.explode("p.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    mean = df.agg(F.avg(raw)).first()[0]
    terms = df.select("term", "df", F.when(raw < 0, EPSILON * F.lit(mean).cast("double")).otherwise(raw).alias("idf"))
    return SparseIndex(rows, terms, spark.createDataFrame([(n, avgdl, mean)], "n long, avgdl double, avg_idf double"))

def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text", tokens=raw_financial_tokens, fold=F.lower) -> DataFrame:
    """(query_id, term, qtf): terms with their multiplicity."""
    t = queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("raw")).select("query_id", fold("raw").alias("term"))
    return t.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))



def top_k(scored: DataFrame, k: int, by: Column | None = None) -> DataFrame:
    """The k best per query by score, ties to the smaller id. Spark prunes within partitions before it shuffles."""
    by = F.round("score", 9) if by is None else by
    w = Window.partitionBy("query_id").orderBy(by.desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: SparseIndex, terms: DataFrame, k: int, filters: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, score). Ranking is over all eligible documents, those without a shared term at score 0.

    filters (query_id, ...): a query sees only documents that equal it in those columns, and a null asks for nothing. They are columns that the index keeps, or else of
    attributes (id, ...), which is then joined to the rows. Without filters every document is eligible. Scores always rest on whole-corpus statistics.
    Queries without terms get no rows.
    """
    weighted = terms.join(small(index.terms.select("term", "idf")), "term", "left").select("query_id", "term", (F.col("qtf") * F.coalesce("idf", F.lit(0.0))).alias("weight"))
    n, avgdl, _ = index.stats.first()
    return best_rows(index.rows, weighted, k, lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)), filters, attributes)


def shared_terms(index: SparseIndex, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) by the number of distinct terms that query and document share."""
    return best_rows(index.rows, terms.select("query_id", "term", F.lit(1.0).alias("weight")), k, lambda tf, dl: np.ones(len(tf)))


def best_rows(rows: DataFrame, weighted: DataFrame, k: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray], filters: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """rows (id, dl, p), weighted (query_id, term, weight) -> (query_id, rank, id, score): the k rows of the largest sums of weight times part(tf, dl)
    over shared terms, those without any at 0. Order: score to 9 digits, id. Queries go in slices of SLICE_TERMS terms, one broadcast after the other."""
    on = [c for c in filters.columns if c != "query_id"] if filters is not None else []
    if any(c not in rows.columns for c in on):
        rows = rows.drop(*on).join(attributes.select("id", *on), "id")
    kinds = dict(rows.dtypes)["id"], dict(weighted.dtypes)["query_id"]
    arrow = {"id": to_arrow_type(rows.schema["id"].dataType), "query_id": to_arrow_type(weighted.schema["query_id"].dataType)}
    asked = materialise(weighted.join(filters, "query_id").select("query_id", "term", "weight", *on) if on else weighted, "asked")
    slices = max(1, -(-asked.count() // SLICE_TERMS))
    found = []
    for s in range(slices):
        got = (asked if slices == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s)).toArrow()
        if not len(got):
            continue
        sent = rows.sparkSession.sparkContext.broadcast(Asked.of(got, on))
        best = top_k(rows.select("id", "dl", "p", *on).mapInArrow(_keep_best(sent, k, part, arrow), f"query_id {kinds[1]}, id {kinds[0]}, score double"), k)
        found.append(best if slices == 1 else materialise(best, "best"))
    if not found:
        return rows.sparkSession.createDataFrame([], f"query_id {kinds[1]}, rank int, id {kinds[0]}, score double")
    return reduce(DataFrame.unionAll, found).select("query_id", "rank", "id", "score")


@dataclass(frozen=True)
class Asked:
    """A slice of queries: their names; the distinct terms, and for each of them (from start on) the queries that ask for it and their weights; per filter column the
    distinct values and each query's place among them (-1: asks for nothing)."""

    names: list
    terms: pa.Array
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    filters: list[tuple[pa.Array, np.ndarray]]

    @staticmethod
    def of(got: pa.Table, on: list[str]) -> Asked:
        got = got.combine_chunks()
        name, term = (got[c].chunk(0).dictionary_encode() for c in ("query_id", "term"))
        query, of = name.indices.to_numpy(), term.indices.to_numpy()
        order = np.lexsort((query, of))
        first = np.unique(query, return_index=True)[1]
        filters = []
        for c in on:
            value = got[c].chunk(0)
            values = pc.drop_null(value).unique()
            at = pc.fill_null(pc.index_in(value, value_set=values), -1).to_numpy(zero_copy_only=False)
            filters.append((values, at[first]))
        return Asked(name.dictionary.to_pylist(), term.dictionary, np.searchsorted(of[order], np.arange(len(term.dictionary) + 1)), query[order], got["weight"].to_numpy()[order], filters)


def _expanded(q: Asked, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hits on the terms: the hit and the place in q.query of each query that asks for it."""
    times = q.start[term + 1] - q.start[term]
    hit = np.repeat(np.arange(len(term)), times)
    return hit, np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + q.start[term][hit]


def _bound(q: Asked, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What no row of a block can score more than, per query: the block's largest part of each term, for all terms together."""
    known, at = np.unique(term, return_inverse=True)
    most = np.zeros(len(known))
    np.maximum.at(most, at, value)
    hit, place = _expanded(q, known)
    return np.bincount(q.query[place], np.maximum(q.weight[place], 0) * most[hit], len(q.names))


def _scores(q: Asked, term: np.ndarray, row: np.ndarray, value: np.ndarray, alive: np.ndarray, rows: int) -> np.ndarray:
    """Scores of a block's rows for the queries alive; a row's parts are added in order of its terms, so equal rows score the same to the bit."""
    place_of = np.full(len(q.names), -1, np.int64)
    place_of[alive] = np.arange(len(alive))
    out = np.zeros(len(alive) * rows)
    ends = np.cumsum(q.start[term + 1] - q.start[term])
    cuts = [0, *(np.flatnonzero(np.diff(ends // CELLS)) + 1).tolist(), len(term)] if len(term) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        hit, place = _expanded(q, term[a:b])
        who = place_of[q.query[place]]
        if len(alive) < len(q.names):
            hit, place, who = (x[who >= 0] for x in (hit, place, who))
        out += np.bincount(who * rows + row[a:b][hit], q.weight[place] * value[a:b][hit], len(out))
    return out.reshape(len(alive), rows)


def _keep_best(sent, k: int, part, kinds: dict[str, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Asked = sent.value
        best: list[list[tuple]] = [[] for _ in q.names]  # (-score to 9 digits, id, score), best first
        last = np.full(len(q.names), -np.inf)
        step = max(1, min(BLOCK, CELLS // len(q.names)))
        for b in batches:
            flat = b.column(2).flatten()
            term = pc.fill_null(pc.index_in(flat.field(0), value_set=q.terms), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
            hits = np.flatnonzero(term >= 0)
            row, term = row[hits], term[hits]
            value = part(flat.field(1).to_numpy()[hits].astype(np.float64), b.column(1).to_numpy()[row].astype(np.float64))
            codes = [pc.fill_null(pc.index_in(b.column(3 + j), value_set=values.cast(b.column(3 + j).type)), -2).to_numpy(zero_copy_only=False) for j, (values, _) in enumerate(q.filters)]
            ids = b.column(0).to_pylist()
            for a in range(0, b.num_rows, step):
                rows = min(step, b.num_rows - a)
                lo, hi = np.searchsorted(row, (a, a + rows))
                alive = np.flatnonzero(_bound(q, term[lo:hi], value[lo:hi]) >= last - 1e-9)
                if not len(alive):
                    continue
                s = _scores(q, term[lo:hi], row[lo:hi] - a, value[lo:hi], alive, rows)
                for (_, wanted), code in zip(q.filters, codes, strict=True):
                    w = wanted[alive][:, None]
                    s[(w != -1) & (w != code[None, a : a + rows])] = -np.inf
                key = np.round(s, 9)
                may = (key >= last[alive][:, None]) & (s > -np.inf)
                for i in np.flatnonzero(may.any(axis=1)).tolist():
                    at = np.flatnonzero(may[i])
                    if len(at) > 4 * k:
                        at = at[key[i, at] >= np.partition(key[i, at], -k)[-k]]
                    one = alive[i]
                    best[one] = sorted(best[one] + [(-key[i, j], ids[a + j], s[i, j]) for j in at.tolist()], key=lambda x: x[:2])[:k]
                    if len(best[one]) == k:
                        last[one] = -best[one][-1][0]
        out = [(name, x[1], x[2]) for name, found in zip(q.names, best, strict=True) for x in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kinds["query_id"]), pa.array([r[1] for r in out], kinds["id"]), pa.array([r[2] for r in out], pa.float64())], names=["query_id", "id", "score"])

    return run

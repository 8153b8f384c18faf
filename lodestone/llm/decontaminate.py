"""Benchmark decontamination with a distributed positional inverted index.

build_index() turns each block of documents into one index row: the sorted distinct terms (64-bit word
hashes), where each term's postings begin, and the postings, which are word positions in the block,
ascending. Blocks are built where the documents lie and written to the shared folder, so building and searching need no shuffle, and a lost
executor's blocks are built again from their documents. search() looks every window of the test items up in
every stored block: the posting list of the window's rarest term there, shifted by its offset, is intersected with
those of the other terms, rarest first. Items come in slices of bounded size, one after the other, each sent to all blocks.
Words are compared by 64-bit hashes: a false match needs all hashes of a window to clash, under 2^-64 for any given pair of different windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from ..sources.store import WIDE
from .common import batch, bound_batches, kept, materialise, wide_rows

#: Bytes of item text that are broadcast at once; larger test sets are searched slice by slice.
SLICE_BYTES = 8 << 20
INDEX = "block long, doc_ids binary, bounds binary, terms binary, starts binary, postings binary"
_KINDS = (np.int64, np.int64, np.uint64, np.int32, np.int32)
#: Words that the terms of a window may each stand away from their place in a proximity match.
NEAR = 2


def build_index(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> one row per block of about a megabyte of text; write it with .write.parquet to keep it.

    block numbers the blocks; doc_ids and bounds (words before each document) are int64 arrays, a null doc_id is the smallest int64;
    terms uint64, starts and postings int32 arrays. Null texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for k, row in enumerate(_blocks(batches)):
            yield batch({"block": pa.array([first + k], pa.int64())} | {n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("doc_ids", "bounds", "terms", "starts", "postings"), row, strict=True)})

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.tidy(run), INDEX)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Index rows (doc_ids, bounds, terms, starts, postings) of batches of (doc_id, text)."""
    for b in batches:
        ids = b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in K.chunks(b.column(1)):
            h, before, _ = K.words(data, offsets, K.ALNUM_WORDS)
            order = np.argsort(h, kind="stable")
            s = h[order]
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            yield ids[lo:hi].astype(np.int64), before.astype(np.int64), s[at], np.append(at, len(s)).astype(np.int32), order.astype(np.int32)


class Windows:
    """The windows of a slice of items as a matrix of terms per window length."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.groups: dict[int, tuple[np.ndarray, list]] = {}
        rows: dict[int, dict[bytes, list]] = {}
        for item, text in items:
            for _, _, data, offsets in K.chunks(pa.array([text], pa.string())):
                h, _, _ = K.words(data, offsets, K.ALNUM_WORDS)
                w = min(size, len(h))
                for i in range(len(h) - w + 1) if w else ():
                    rows.setdefault(w, {}).setdefault(h[i : i + w].tobytes(), []).append(item)
        for w, found in rows.items():
            self.groups[w] = (np.frombuffer(b"".join(found), np.uint64).reshape(-1, w), [sorted(set(x)) for x in found.values()])


def _shifted(row: tuple[np.ndarray, ...], matrix: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start position, document of the block) of the occurrences in one block, each in one document; with slop, each term may stand up to slop words from its place."""
    _, bounds, terms, starts, postings = row
    starts = starts.astype(np.int64)
    w = matrix.shape[1]
    at = np.searchsorted(terms, matrix)
    at[at == len(terms)] = 0
    rows = np.flatnonzero((terms[at] == matrix).all(axis=1))
    if not len(rows):
        return rows, rows, rows
    at = at[rows]
    sizes = starts[at + 1] - starts[at]
    rank = np.argsort(sizes, axis=1, kind="stable")
    pick = lambda k: np.take_along_axis(at, rank[:, k : k + 1], axis=1)[:, 0]
    term, shift = pick(0), rank[:, 0]
    count = starts[term + 1] - starts[term]
    owner = np.repeat(np.arange(len(rows)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    found = postings[np.repeat(starts[term], count) + inner].astype(np.int64)
    doc = np.searchsorted(bounds, found, side="right") - 1
    pos = found - shift[owner]
    if slop:  # the rarest term may itself stand beside its place
        away = np.arange(-slop, slop + 1)
        owner, doc, pos = np.repeat(owner, len(away)), np.repeat(doc, len(away)), (pos[:, None] + away).ravel()
        _, first = np.unique(np.stack([owner, doc, pos]), axis=1, return_index=True)
        owner, doc, pos = owner[first], doc[first], pos[first]
    base = len(postings) + 1
    for k in range(1, w):
        if not len(owner):
            break
        # one sorted array of (term, position) answers every window at once
        term = pick(k)
        lists = np.unique(term[np.unique(owner)])
        n = starts[lists + 1] - starts[lists]
        flat = np.repeat(starts[lists], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.repeat(np.arange(len(lists)), n) * base + postings[flat]
        place = pos + rank[owner, k]
        lo, hi = np.maximum(place - slop, bounds[doc]), np.minimum(place + slop, bounds[doc + 1] - 1)
        which = np.searchsorted(lists, term)[owner] * base
        left = np.searchsorted(key, which + lo)
        hit = (lo <= hi) & (left < len(key))
        hit[hit] = key[left[hit]] <= (which + hi)[hit]
        owner, pos, doc = owner[hit], pos[hit], doc[hit]
    return rows[owner], pos, doc


def search(index: DataFrame, items: DataFrame, size: int = 13, slop: int = 0, near: int = 0) -> DataFrame:
    """Index rows, stored, and items (item_id, text) -> per document (doc_id, n_words, n_hit, items, near_items).

    A window is `size` consecutive words of an item, or all its words if fewer; items without words have none.
    n_hit counts the document's words inside any occurrence; items lists the ids (strings, sorted) with one.
    With slop > 0 a window also occurs where each of its terms stands within slop words of its place
    (proximity match); an occurrence never crosses documents. near_items lists the items with such an occurrence for a slop of `near`, those of `items`
    among them; it is empty for near = 0. Items with a null id count as 'null'; repeated items add nothing. Documents without words are returned with zeros.
    One slice of items is in memory at a time; what several slices find is put together by block and document.
    """
    spark = items.sparkSession
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-int(total) // SLICE_BYTES))
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = []
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        sent = spark.sparkContext.broadcast(Windows([tuple(r) for r in part.distinct().collect()], size))
        found = index.mapInArrow(K.tidy(_searched(sent, slop, near)), FOUND)
        if slices > 1:
            found = materialise(found, "found")
            sent.unpersist()
        parts.append(found)
    count = "aggregate(array_sort(spans), struct(0L as n, 0L as at), (a, x) -> struct(a.n + greatest(0L, x.e - greatest(a.at, x.s)) as n, greatest(a.at, x.e) as at), a -> a.n)"
    if slices == 1:
        return parts[0].select("doc_id", "n_words", F.expr(count).alias("n_hit"), "items", "near_items")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    every = every.groupBy("block", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), names("items"), names("near_items"))
    return every.select("doc_id", "n_words", F.expr(count).alias("n_hit"), "items", "near_items")


FOUND = "block long, place int, doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<string>, near_items array<string>"


def _searched(sent, slop: int, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *row in zip(*b.columns, strict=True):
                yield _found(block.as_py(), tuple(np.frombuffer(x.as_buffer(), k) for x, k in zip(row, _KINDS, strict=True)), sent.value, slop, near)

    return run


def _found(block: int, row: tuple[np.ndarray, ...], windows: Windows, slop: int, near: int) -> pa.RecordBatch:
    """What one block's documents hold of the windows."""
    ids, bounds, terms, _, _ = row
    named: tuple[dict[int, set], dict[int, set]] = {}, {}
    docs, lows, highs = [], [], []
    for w, (matrix, names) in windows.groups.items() if len(terms) else ():
        for out, room in ((0, slop), *([(1, near)] if near else [])):
            window, pos, doc = _shifted(row, matrix, room)
            for d, i in set(zip(doc.tolist(), window.tolist(), strict=True)):
                named[out].setdefault(d, set()).update(names[i])
            if not out:
                docs.append(doc), lows.append(np.maximum(pos - slop, bounds[doc]) - bounds[doc]), highs.append(np.minimum(pos + w + slop, bounds[doc + 1]) - bounds[doc])
    # a document's occurrences as intervals of words, overlapping ones as one
    spans: list[list] = [[] for _ in ids]
    if docs:
        doc, lo, hi = (np.concatenate(x) for x in (docs, lows, highs))
        for i in np.lexsort((hi, lo, doc)).tolist():
            own = spans[doc[i]]
            if own and own[-1]["e"] >= lo[i]:
                own[-1]["e"] = max(own[-1]["e"], int(hi[i]))
            else:
                own.append({"s": int(lo[i]), "e": int(hi[i])})
    listed = lambda x: pa.array([sorted(x.get(d, ())) for d in range(len(ids))], pa.list_(pa.string()))
    return batch({
        "block": pa.array([block] * len(ids), pa.int64()), "place": pa.array(np.arange(len(ids), dtype=np.int32)), "doc_id": pa.array(ids, mask=ids == -(1 << 63)), "n_words": pa.array(np.diff(bounds)),
        "spans": pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), "items": listed(named[0]), "near_items": listed(named[1]),
    })


def contamination(documents: DataFrame, items: DataFrame, size: int = 13, slop: int = 0, share: int = 20, near: int = 0) -> DataFrame:
    """search() over documents, whose index stands in the shared folder until the answers do, and contaminated: n_hit > 0 and share * n_hit >= n_words."""
    spark = documents.sparkSession
    bound_batches(spark)
    with wide_rows(spark):
        found = kept(spark, "found", lambda: search(materialise(build_index(documents), "index", **WIDE), items, size, slop, near))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))

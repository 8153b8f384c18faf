"""Gold evidence mapped to chunks: exact containment of the normal form first, then shares of tokens.

Items go to the chunks, a bounded slice of pages at a time. With more than one slice the chunks' normal forms are stored by slice, so a slice reads the chunks of its own pages and the work
grows with the tables, not with chunks times slices; a slice whose pages have too many items takes several passes over these. A task looks a chunk's tokens up in an
inverted index of the items of its page, which gives the shared tokens of all pairs that share any; where they are all but an item's two outer ones (which containment
may cut) the texts are compared, and items of two tokens at most are found by an automaton over them. Only pairs that can win leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import match_normal_form, nfkc
from ..sources.store import materialise
from .sparse import count_terms

THRESHOLD, OF_BEST, LEAST_TOKENS = 0.35, 0.8, 8
#: Bytes of the items' normal forms that one pass looks for, twice as many at most; more items take more passes, each over the chunks of its pages.
SLICE_BYTES = 16 << 20


@dataclass
class Wanted:
    """A slice of items by place: their ids, pages (places in pages), sizes in tokens and texts; per (page, term), by rising code, the items that have it and how often."""

    ids: np.ndarray
    pages: pa.Array
    page: np.ndarray
    size: np.ndarray
    text: list[str]
    terms: pa.Array
    code: np.ndarray
    start: np.ndarray
    item: np.ndarray
    count: np.ndarray
    automata: dict = field(default_factory=dict)

    @staticmethod
    def of(got: pa.Table) -> Wanted:
        page = got["key"].combine_chunks().dictionary_encode()
        size, listed = count_terms(got["t"].combine_chunks())
        pairs = listed.flatten()
        term = pairs.field(0).dictionary_encode()
        item = np.repeat(np.arange(len(got)), np.diff(listed.offsets.to_numpy()))
        code = page.indices.to_numpy()[item].astype(np.int64) * max(1, len(term.dictionary)) + term.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        known, start = np.unique(code[order], return_index=True)
        return Wanted(got["eid"].to_numpy(), page.dictionary, page.indices.to_numpy(), size.to_numpy(), got["norm"].to_pylist(), term.dictionary, known, np.append(start, len(code)), item[order], pairs.field(1).to_numpy()[order])

    def short(self, page: int):
        """The automaton of a page's items of two tokens at most, or None."""
        if page not in self.automata:
            import ahocorasick

            found: dict[str, list[int]] = {}
            for i in np.flatnonzero((self.page == page) & (self.size > 0) & (self.size <= 2)).tolist():
                found.setdefault(self.text[i], []).append(i)
            made = ahocorasick.Automaton() if found else None
            for text, items in found.items():
                made.add_word(text, items)
            if made is not None:
                made.make_automaton()
            self.automata[page] = made
        return self.automata[page]

    def pairs(self, page: np.ndarray, sizes: np.ndarray, listed: pa.ListArray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared tokens, exact) of the pairs on one page that share a token or contain one another."""
        flat = listed.flatten()
        row = np.repeat(np.arange(len(page)), np.diff(listed.offsets.to_numpy()))
        term = pc.fill_null(pc.index_in(flat.field(0), value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        code = page[row].astype(np.int64) * max(1, len(self.terms)) + term
        at = np.minimum(np.searchsorted(self.code, code), max(0, len(self.code) - 1))
        hit = np.flatnonzero((term >= 0) & (self.code[at] == code)) if len(self.code) else np.zeros(0, np.int64)
        times = self.start[at[hit] + 1] - self.start[at[hit]]
        which = np.repeat(np.arange(len(hit)), times)
        place = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + self.start[at[hit]][which]
        shared = np.minimum(flat.field(1).to_numpy()[hit][which], self.count[place])
        known, of = np.unique(row[hit][which] * len(self.ids) + self.item[place], return_inverse=True)
        m = np.bincount(of, shared, len(known)).astype(np.int64)
        r, i = np.divmod(known, len(self.ids))
        exact = np.zeros(len(r), bool)
        near = (m >= self.size[i] - 2) | ((sizes[r] >= LEAST_TOKENS) & (m >= sizes[r] - 2))
        for x in np.flatnonzero(near).tolist():
            mine, other = texts[int(r[x])].as_py(), self.text[i[x]]
            exact[x] = other in mine or (sizes[r[x]] >= LEAST_TOKENS and mine in other)
        have = {(a, b): x for x, (a, b) in enumerate(zip(r.tolist(), i.tolist(), strict=True)) if self.size[b] <= 2}
        more = set()
        for a in np.unique(np.arange(len(page))[sizes > 0]).tolist() if len(page) else []:
            if (automaton := self.short(int(page[a]))) is not None:
                more.update((a, b) for _, items in automaton.iter(texts[a].as_py()) for b in items if (a, b) not in have)
        if more:
            r, i = (np.concatenate([old, np.array([p[j] for p in sorted(more)], np.int64)]) for j, old in enumerate((r, i)))
            m, exact = np.concatenate([m, np.zeros(len(more), np.int64)]), np.concatenate([exact, np.ones(len(more), bool)])
        return r, i, m, exact


def _matches(sent, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Wanted = sent.value
        best = np.full(len(w.ids), -1.0)
        for b in batches:
            page = pc.index_in(b.column(1), value_set=w.pages)
            b = b.filter(page.is_valid())
            if not b.num_rows:
                continue
            page = page.drop_null().to_numpy()
            sizes, listed = count_terms(b.column(3))
            sizes = sizes.to_numpy()
            r, i, m, exact = w.pairs(page, sizes, listed, b.column(2))
            score = m / np.maximum(w.size[i], 1)
            np.maximum.at(best, i, score)
            keep = np.flatnonzero(exact | ((score >= THRESHOLD) & (score >= OF_BEST * best[i])))
            yield pa.RecordBatch.from_arrays([pa.array(w.ids[i[keep]]), b.column(0).take(pa.array(r[keep])).cast(kind), pa.array(score[keep]), pa.array(exact[keep])], names=["eid", "chunk_id", "score", "exact"])
        some = np.flatnonzero(best >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(w.ids[some]), pa.nulls(len(some), kind), pa.array(best[some]), pa.array(np.zeros(len(some), bool))], names=["eid", "chunk_id", "score", "exact"])

    return run


def map_evidence(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence (question_id, item, doc_name, page, norm) and chunks (chunk_id, doc_name, page, norm) -> per item:
    question_id, item, doc_name, page, method, matched (chunk ids sorted), best_score, candidates.

    norm is the text's match_normal_form(nfkc(text)), see match_texts(). Only chunks of the item's page compete. The score is the share of the item's tokens, with repeats,
    that the chunk has. All exact matches win; else all chunks over the threshold and near the best; else none. Items without a page have no candidates.
    """
    spark = evidence.sparkSession
    key = F.when(F.col("doc_name").isNotNull() & F.col("page").isNotNull(), F.to_json(F.struct("doc_name", "page"))).alias("key")
    tokens = F.filter(F.split("norm", " "), lambda x: x != "").alias("t")
    e = materialise(evidence.select(F.monotonically_increasing_id().alias("eid"), "question_id", "item", "doc_name", "page", "norm", key), "evidence")
    kind = chunks.schema["chunk_id"].dataType
    room = e.agg(F.sum(F.octet_length("norm"))).first()[0] or 0
    slices = max(1, -(-room // SLICE_BYTES))
    part = F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")
    wanted = e.where("key is not null and norm <> ''").select("eid", "key", "norm", part.alias("slice"))
    there = chunks.select("chunk_id", key, "norm").where("key is not null")
    if slices > 1:
        there = materialise(there.withColumn("slice", part), "chunks", by="slice")
    found = []
    for r in wanted.groupBy("slice").agg(F.sum(F.octet_length("norm")).alias("bytes")).orderBy("slice").collect():  # a row per slice
        times = -(-r.bytes // (2 * SLICE_BYTES))  # pages with very many items take more passes over their own chunks
        for k in range(times):
            mine = wanted.where((F.col("slice") == r.slice) & (F.pmod(F.xxhash64("eid"), F.lit(times)) == k))
            got = mine.select("eid", "key", "norm", tokens).toArrow()
            if not len(got):
                continue
            sent = spark.sparkContext.broadcast(Wanted.of(got.combine_chunks()))
            read = there if slices == 1 else there.where(F.col("slice") == r.slice)
            rows = read.select("chunk_id", "key", "norm", tokens).mapInArrow(_matches(sent, to_arrow_type(kind)), f"eid long, chunk_id {kind.simpleString()}, score double, exact boolean")
            found.append(materialise(rows, "matches"))
            sent.unpersist()
    out = e.withColumnRenamed("eid", "id")
    nothing = F.lit(None)
    if found:
        rows = reduce(DataFrame.unionAll, found)
        top = rows.groupBy("eid").agg(F.max("score").alias("best"), F.max("exact").alias("any_exact"))
        won = rows.where("chunk_id is not null").join(top, "eid").where(F.when(F.col("any_exact"), F.col("exact")).otherwise((F.col("score") >= THRESHOLD) & (F.col("score") >= OF_BEST * F.col("best"))))
        won = won.groupBy("eid").agg(F.array_sort(F.collect_list("chunk_id")).alias("won")).withColumnRenamed("eid", "of")
        out = out.join(top, F.col("id") == F.col("eid"), "left").join(won, F.col("id") == F.col("of"), "left")
    else:
        out = out.withColumns({"best": nothing.cast("double"), "any_exact": nothing.cast("boolean"), "won": nothing.cast(f"array<{kind.simpleString()}>")})
    on_page = chunks.select(key, F.col("chunk_id")).where("key is not null").groupBy("key").agg(F.count("chunk_id").alias("n")).withColumnRenamed("key", "_key")
    out = out.join(on_page, F.col("key") == F.col("_key"), "left")
    method = F.when(F.col("norm") == "", "no_evidence_text").when(F.col("any_exact"), "normalized_exact_containment").when(F.size("won") > 0, "token_containment").otherwise("page_only_no_strict_chunk_match")
    return out.select(
        "question_id", "item", "doc_name", "page", method.alias("method"), F.coalesce("won", F.array().cast(f"array<{kind.simpleString()}>")).alias("matched"), F.coalesce("best", F.lit(0.0)).alias("best_score"), F.coalesce("n", F.lit(0)).alias("candidates"),
    )


def match_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds norm, the form in which evidence and chunks are matched: compatibility forms folded (ligatures, full-width digits), lower case, no commas, tokens only."""
    return df.withColumn("norm", match_normal_form(nfkc(F.col(text))))


def summarise(mapped: DataFrame) -> DataFrame:
    """Per question: page references and chunk ids without repeats in order of the items, the single gold document or null, complete."""
    g = mapped.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("item", "doc_name", "page", "matched", "method"))).alias("i"))
    docs = F.array_distinct(F.transform("i", lambda x: x["doc_name"]))
    strict = F.forall("i", lambda x: F.size(x["matched"]) > 0)
    return g.select(
        "question_id", F.size("i").alias("item_count"), F.array_distinct(F.transform("i", lambda x: F.struct(x["doc_name"], x["page"]))).alias("gold_page_refs"),
        F.array_distinct(F.flatten(F.transform("i", lambda x: x["matched"]))).alias("gold_chunk_ids"), F.when(F.size(docs) == 1, docs[0]).alias("gold_doc"), ((F.size("i") > 0) & strict).alias("mapping_complete"),
    )

"""Token-window chunks of pages: in closed form, without Python, for tokens that a pattern gives; window by window for any other tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..sources.store import materialise
from .checks import duplicate_keys, enforce


@dataclass(frozen=True)
class ChunkConfig:
    """capacity = size - special - prefix; a page's header takes its tokens off it."""

    size: int = 512
    overlap: int = 50
    special: int = 2
    prefix: int = 2
    token: str = r"\S+"

    def __post_init__(self):
        if not 0 <= self.overlap < self.capacity:
            raise ValueError("the overlap must be smaller than the capacity")

    @property
    def capacity(self) -> int:
        return self.size - self.special - self.prefix


def chunk_pages(pages: DataFrame, config: ChunkConfig = ChunkConfig(), header: Column | None = None) -> DataFrame:
    """pages (doc_name, page, text, ...) -> one row per chunk with all page columns but text, and chunk_index, chunk_id, text, retrieval_text,
    token_start, token_end, char_start, char_end, content_capacity.

    Windows are page-local; one starts `overlap` tokens before the last one ended and never empty ones are made, so a blank page has none. Text
    is the page's own between the window's first and last token. A capacity that the header leaves at or under the overlap raises.
    """
    token = config.token
    head = F.coalesce(header, F.lit("")) if header is not None else F.lit("")
    p = pages.withColumn("_header", head)
    # pieces: every token with what stands before it, so a window's text is a slice joined
    p = p.withColumn("_pieces", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"[\s\S]*?(?:{token})"), F.lit(0)))
    capacity = config.capacity - F.size(F.regexp_extract_all("_header", F.lit(token), F.lit(0)))
    capacity = F.when(capacity > config.overlap, capacity).otherwise(F.raise_error(F.lit("header leaves no room for content")).cast("int"))
    p = p.where(F.size("_pieces") > 0).withColumn("content_capacity", capacity).withColumn("_n", F.size("_pieces"))
    step = F.col("content_capacity") - config.overlap
    count = F.when(F.col("_n") <= F.col("content_capacity"), 1).otherwise(F.ceil((F.col("_n") - F.col("content_capacity")) / step).cast("int") + 1)
    # characters of each step between window starts, summed once; a window's offset is the sum of the steps before it
    p = p.withColumn("_step", step).withColumn("_count", count).withColumn("_sizes", F.transform("_pieces", F.length))
    p = p.withColumn("_steps", F.transform(F.sequence(F.lit(0), F.col("_count") - 1), lambda i: F.aggregate(F.slice("_sizes", i * F.col("_step") + 1, F.col("_step")), F.lit(0), lambda a, x: a + x)))
    p = p.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    p = p.withColumn("token_start", F.col("chunk_index") * step).withColumn("token_end", F.least("_n", F.col("token_start") + F.col("content_capacity")))
    raw = F.array_join(F.slice("_pieces", F.col("token_start") + 1, F.col("token_end") - F.col("token_start")), "")
    before = F.aggregate(F.slice("_steps", F.lit(1), F.col("chunk_index")), F.lit(0), lambda a, x: a + x)
    body = T.strip(raw)
    start = before + F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
    keep = [c for c in pages.columns if c != "text"]
    return p.select(
        *keep, "chunk_index", _chunk_id().alias("chunk_id"), body.alias("text"), F.concat("_header", body).alias("retrieval_text"),
        "token_start", "token_end", start.cast("int").alias("char_start"), (start + F.length(body)).cast("int").alias("char_end"), "content_capacity",
    )


def chunk_pages_with(pages: DataFrame, tokenizer: Callable[[str], list[tuple[int, int]]], config: ChunkConfig = ChunkConfig(), header: Column | None = None) -> DataFrame:
    """chunk_pages() for any tokenizer, given as a function from a text to its tokens' (start, end) places in code points.

    Such tokenizers may give a piece of a text more tokens than it had inside, so a window gives up tokens at its end until header and piece fit; the next one starts
    `overlap` tokens before where it really ended. A window without text is not made and takes no number. Pages are independent, in Arrow batches.
    """
    keep = [f for f in pages.schema.fields if f.name != "text"]
    extra = "chunk_index int, chunk_id string, text string, retrieval_text string, token_start int, token_end int, char_start int, char_end int, content_capacity int"
    schema = StructType([*keep, *StructType.fromDDL(extra).fields])
    fields = extra.replace(",", "").split()[::2]

    def windows(text: str, head: str) -> Iterator[tuple]:
        spans, room = tokenizer(text), config.capacity - len(tokenizer(head))
        if spans and room <= config.overlap:
            raise ValueError("header leaves no room for content")
        first, number = 0, 0
        while first < len(spans):
            last = min(first + room, len(spans))
            while True:
                raw = text[spans[first][0] : spans[last - 1][1]]
                over = len(tokenizer(head + raw.strip())) - config.capacity
                if over <= 0 or last - first == 1:
                    break
                last = max(first + 1, last - over)
            body = raw.strip()
            if body:
                at = spans[first][0] + len(raw) - len(raw.lstrip())
                yield number, body, first, last, at, at + len(body), room
                number += 1
            if last >= len(spans):
                return
            first = max(first + 1, last - config.overlap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, (text, head) in enumerate(zip(b["text"], b["_header"], strict=True)):
                for number, body, first, last, start, end, room in windows(text or "", head or ""):
                    rows.append((k, number, "", body, (head or "") + body, first, last, start, end, room))
            made = pd.DataFrame(rows, columns=["_k", *fields])
            out = b.drop(columns=["text", "_header"]).iloc[made["_k"].to_numpy(dtype=int)].reset_index(drop=True)
            yield pd.concat([out, made.drop(columns="_k")], axis=1)

    made = pages.withColumn("_header", F.coalesce(header, F.lit("")) if header is not None else F.lit("")).mapInPandas(run, schema)
    return made.withColumn("chunk_id", _chunk_id())


def _chunk_id() -> Column:
    number = F.col("chunk_index").cast("string")
    number = F.when(F.col("chunk_index") < 1000, F.lpad(number, 3, "0")).otherwise(number)
    return F.concat(T.safe_identifier(F.col("doc_name").cast("string")), F.lit("_p"), F.col("page").cast("string"), F.lit("_c"), number)


def require_unique(chunks: DataFrame) -> DataFrame:
    """chunks, in which an id that is there twice raises."""
    enforce(duplicate_keys(chunks, ["chunk_id"], "duplicate_chunk"))
    return chunks


def uncovered_pages(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages with text that have no chunk; empty if all is well."""
    return pages.where(T.strip(F.col("text")) != "").join(chunks.select("doc_name", "page").distinct(), ["doc_name", "page"], "left_anti").select("doc_name", "page")


def with_ordinal(chunks: DataFrame) -> DataFrame:
    """ordinal: the place in the order of doc_name, page, chunk_index. Numbers run within ranges of doc_name and are shifted by the
    ranges before, so no task sees all rows. They are dealt once: each reading of a
    plan draws its own sample for the bounds of ranges and merges small ranges by its own columns' bytes, and sizes of other ranges would shift the numbers wrongly."""
    dealt = materialise(chunks.repartitionByRange("doc_name", "page").withColumn("_r", F.spark_partition_id()), "dealt")
    w = Window.partitionBy("_r").orderBy("doc_name", "page", "chunk_index")
    dealt = dealt.withColumn("_k", F.row_number().over(w))
    sizes = dealt.groupBy("_r").agg(F.count("*").alias("_n"))  # a row per range
    base = sizes.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_b"))
    return dealt.join(F.broadcast(base), "_r").withColumn("ordinal", F.col("_b") + F.col("_k") - 1).drop("_r", "_k", "_b")

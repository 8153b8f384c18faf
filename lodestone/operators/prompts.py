"""Prompts as expressions, for whole question sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

# The wording that models are asked with.
CLOSED_BOOK = "Question:\n%s\n\nAnswer:"
RAG = (
    "Use only the supplied context to answer the financial question.\n"
    "If the answer cannot be determined from the supplied context, say:\n"
    '"Insufficient evidence in the retrieved context."\n\n'
    "Context:\n%s\n\nQuestion:\n%s\n\nAnswer:"
)
NO_CONTEXT = "[No retrieved context]"


def closed_book_prompt(question: Column) -> Column:
    q = strip(question)
    return F.when(q == "", F.raise_error(F.lit("question must not be empty"))).otherwise(F.format_string(CLOSED_BOOK, q))


def context(chunks: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """chunks: array of structs with doc_name, page, chunk_id, text in rank order; extra: (label, field) lines for fields that are not null."""

    def one(c: Column, i: Column) -> Column:
        lines = [F.concat(F.lit("[Context "), i + 1, F.lit("]")), F.concat(F.lit("Document: "), c["doc_name"]), F.concat(F.lit("Page (zero-indexed): "), c["page"]), F.concat(F.lit("Chunk ID: "), c["chunk_id"])]
        lines += [F.when(c[f].isNotNull(), F.concat(F.lit(f"{label}: "), c[f].cast("string"))) for label, f in extra]
        text = strip(c["text"])
        return F.concat_ws("\n", *lines, F.when(text == "", F.raise_error(F.lit("a retrieved chunk has an empty text"))).otherwise(text))

    return F.when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, NO_CONTEXT).otherwise(F.array_join(F.transform(chunks, one), "\n\n"))


def rag_prompt(question: Column, chunks: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    q = strip(question)
    return F.when(q == "", F.raise_error(F.lit("question must not be empty"))).otherwise(F.format_string(RAG, context(chunks, extra), q))

"""Questions turned into retrieval queries with an unambiguous company and year."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import materialise

#: Bytes of names that are looked for at once: one automaton and one broadcast; more names take more passes over the questions.
SLICE_BYTES = 32 << 20
#: Collapsed keys from this length on are found inside a question's collapsed text; shorter ones only as bounded words.
LEAST_KEY = 3
#: Letters that equal an ASCII letter when case is ignored.
_FOLD = str.maketrans({"\u017f": "s", "\u212a": "k", "\u0130": "i", "\u0131": "i"})


def collapsed(text: str) -> str:
    return re.sub("[^a-z0-9]+", "", text.lower())


@dataclass
class Mentions:
    """Company names by collapsed key: an automaton over the keys of LEAST_KEY characters and more and over the shorter keys that names have (there are few),
    in one pass over a question's collapsed text; what it finds of short keys, or across folded letters, is confirmed by the name's own pattern."""

    names: dict[str, list[str]]
    _automaton: object = field(default=None, repr=False)
    _patterns: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def of(names: list[str]) -> Mentions:
        found: dict[str, list[str]] = {}
        for name in names:
            words = re.findall("[A-Za-z0-9]+", name)
            # what the pattern of the words can match collapses to the words themselves, which for names with folded letters is not the key
            for at in {collapsed(name), "".join(words).lower()} - {""}:
                found.setdefault(at, []).append(name)
        return Mentions(found)

    def __reduce__(self):
        return Mentions, (self.names,)

    def _matches(self, name: str, question: str) -> bool:
        """The name's words, anything but letters and digits between, bounded by what is no ASCII letter or digit."""
        if name not in self._patterns:
            words = re.findall("[A-Za-z0-9]+", name)
            self._patterns[name] = re.compile(r"(?<![A-Za-z0-9])" + r"[\W_]*".join(words) + r"(?![A-Za-z0-9])", re.IGNORECASE) if words else None
        return self._patterns[name] is not None and self._patterns[name].search(question) is not None

    def keys(self, question: str) -> list[str]:
        """Keys of the companies that a question mentions, two at most: more tell no more."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for key in self.names:
                self._automaton.add_word(key, key)
            if self.names:
                self._automaton.make_automaton()
        if not self.names:
            return []
        plain, out, tried = collapsed(question), set(), set()
        folded = collapsed(question.translate(_FOLD))
        for text in dict.fromkeys((plain, folded)):
            for _, at in self._automaton.iter(text):
                if (at, text) in tried:
                    continue
                tried.add((at, text))
                for name in self.names[at]:
                    key = collapsed(name)
                    if key not in out and ((len(key) >= LEAST_KEY and key in plain) or self._matches(name, question)):
                        out.add(key)
                if len(out) > 1:
                    return sorted(out)[:2]
        return sorted(out)


def _finder(sent):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield t.map(lambda q: sent.value.keys(q) if isinstance(q, str) else [])

    return find


def mentioned(questions: DataFrame, names: DataFrame, column: str = "question") -> DataFrame:
    """questions with k: the collapsed keys of the companies that each mentions, two at most. names (company): any number, in slices of SLICE_BYTES."""
    spark = questions.sparkSession
    names = names.select("company").where("company <> ''").distinct()
    slices = max(1, -(-(names.agg(F.sum(F.octet_length("company"))).first()[0] or 0) // SLICE_BYTES))
    names = materialise(names, "names") if slices > 1 else names
    out = questions.withColumn("k", F.array().cast("array<string>"))
    for s in range(slices):
        part = names if slices == 1 else names.where(F.pmod(F.xxhash64("company"), F.lit(slices)) == s)
        sent = spark.sparkContext.broadcast(Mentions.of([r[0] for r in part.collect()]))

        out = out.withColumn("k", F.slice(F.array_sort(F.array_union("k", F.pandas_udf(_finder(sent), "array<string>")(F.col(column)))), 1, 2))
        out = materialise(out, "mentions") if slices > 1 else out
    return out


def process_queries(questions: DataFrame, companies: DataFrame, id_col: str = "question_id") -> DataFrame:
    """questions (id, question), companies (company) -> id, retrieval_query, company (collapsed key), fiscal_year.

    A company counts only if exactly one key is mentioned; a year only if it is unambiguous. An empty question raises.
    """
    q = mentioned(questions.withColumn("question", T.strip(F.col("question"))), companies)
    year = T.unambiguous_year(F.col("question"))
    text = F.when(F.col("question") == "", F.raise_error(F.lit("question must not be empty"))).otherwise(T.expanded_query(F.col("question"), year))
    return q.select(id_col, text.alias("retrieval_query"), F.when(F.size("k") == 1, F.col("k")[0]).alias("company"), year.alias("fiscal_year"))


def chunk_filters(chunks: DataFrame, id_col: str = "chunk_id", keep: list[str] = ()) -> DataFrame:
    """chunks (id, company, fiscal_year, doc_period, whichever there are) -> id, company (collapsed key), fiscal_year and the columns of keep: what retrieval filters by.
    A chunk's year falls back to its period; a column that is missing is null, so no filtered question sees the chunk."""
    text = lambda c: F.col(c).cast("string") if c in chunks.columns else F.lit(None).cast("string")
    key = T.company_key(F.coalesce(text("company"), F.lit("")))
    return chunks.select(F.col(id_col).alias("id"), F.when(key != "", key).alias("company"), T.coerce_year(F.coalesce(text("fiscal_year"), text("doc_period"))).alias("fiscal_year"), *keep)

"""Pluggable models: embedder, cross-encoder, generator, judge. Each is a batch function with a deterministic default that needs no network."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .selection import canonical

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[tuple[str, str]]], list[float]]
Generator = Callable[[list[str]], list[str]]
_WORD = re.compile(r"\w+")  # letters, digits, underscores
#: What a prompt is followed by when its response was not valid.
FEEDBACK = "\n\nThe last response was rejected: %s. Answer again, in the form asked for."


def hashing_encoder(dim: int = 64) -> Encoder:
    """Signed feature hashing of words, to unit length; a text without words is the zero vector."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in _WORD.findall((t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    return encode


def embed(text: Column, encoder: Encoder | None = None, prefix: str = "") -> Column:
    encoder = encoder or hashing_encoder()

    def run(t: pd.Series) -> pd.Series:
        return pd.Series(list(encoder([prefix + (x or "") for x in t]).astype(float)))

    return F.pandas_udf(run, "array<double>")(text)


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """Share of the query's distinct words that the text has."""
    out = []
    for q, t in pairs:
        a, b = set(_WORD.findall((q or "").lower())), set(_WORD.findall((t or "").lower()))
        out.append(len(a & b) / len(a) if a else 0.0)
    return out


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def cross_score(query: Column, text: Column, scorer: Scorer = overlap_scorer) -> Column:
    """The scorer's values, in Arrow batches; overlap_scorer, the default, as an expression."""
    if scorer is overlap_scorer:
        words = _words(query)
        return F.when(F.size(words) > 0, F.size(F.array_intersect(words, _words(text))) / F.size(words)).otherwise(0.0)

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(list(zip(q, t, strict=True))), dtype=float)

    return F.pandas_udf(run, "double")(query, text)


def echo_generator(prompts: list[str]) -> list[str]:
    """The first line of the first context, or the abstention when there is none: a stand-in for a model."""
    out = []
    for p in prompts:
        found = re.search(r"Chunk ID: [^\n]*\n(?:[A-Z][^\n:]*: [^\n]*\n)*([^\n]+)", p or "")
        out.append(found[1] if found else "Insufficient evidence in the retrieved context.")
    return out


def generate(df: DataFrame, prompt: str, generator: Generator = echo_generator, attempts: int = 3) -> DataFrame:
    """Adds generated_answer, generation_latency_ms and generation_error. A batch that fails is tried again; then its rows carry the error and no answer."""
    schema = StructType([*df.schema.fields, StructField("generated_answer", StringType()), StructField("generation_latency_ms", DoubleType()), StructField("generation_error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(attempts):
                began = time.perf_counter()
                try:
                    said, error = generator(list(b[prompt])), None
                    if len(said) != len(b):
                        raise ValueError("the model gave another number of answers")
                    break
                except Exception as e:
                    said, error = [None] * len(b), f"{type(e).__name__}: {e}"
                    if k + 1 < attempts:
                        time.sleep(0.1 * 2**k)
            ms = (time.perf_counter() - began) * 1000 / max(1, len(b))
            yield b.assign(generated_answer=said, generation_latency_ms=ms, generation_error=error)

    return df.mapInPandas(run, schema)


def call_each(df: DataFrame, prompt: str, model: Callable[[str], str], validate: Callable[[str], str | None] | None = None, attempts: int = 3, concurrency: int = 4, feedback: str = FEEDBACK) -> DataFrame:
    """Adds response, latency_ms, parse_attempts and model_error for a model that answers one prompt at a time.

    validate gives what is wrong with a response, or None; then the prompt is asked again with that said after it, up to `attempts` times, and the last error stays with no
    response. At most `concurrency` calls are open per task, so there are at most that many times the running tasks in all. Times are each row's own, all its attempts together.
    """
    added = [StructField("response", StringType()), StructField("latency_ms", DoubleType()), StructField("parse_attempts", LongType()), StructField("model_error", StringType())]
    schema = StructType([*df.schema.fields, *added])

    def one(text: str) -> tuple[str | None, float, int, str | None]:
        began, asked, error = time.perf_counter(), text, None
        for k in range(1, attempts + 1):
            try:
                said = model(asked)
                error = validate(said) if validate else None
                if error is None:
                    return said, (time.perf_counter() - began) * 1000, k, None
                asked = text + feedback % error
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                if k < attempts:
                    time.sleep(0.1 * 2 ** (k - 1))
        return None, (time.perf_counter() - began) * 1000, attempts, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                got = list(pool.map(one, b[prompt]))
                yield b.assign(**{f.name: [g[i] for g in got] for i, f in enumerate(added)})

    return df.mapInPandas(run, schema)


def _best_cosines(a: list[str], b: list[str], encoder: Encoder, block: int = 512) -> tuple[float, float]:
    """Mean over the words of each side of the best cosine with the other's; a block of each side is encoded at a time."""
    down, across = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), block):
        x = encoder(a[i : i + block])
        for j in range(0, len(b), block):
            s = x @ encoder(b[j : j + block]).T
            down[i : i + block] = np.maximum(down[i : i + block], s.max(axis=1))
            across[j : j + block] = np.maximum(across[j : j + block], s.max(axis=0))
    return float(down.mean()), float(across.mean())


def soft_match(candidate: Column, reference: Column, encoder: Encoder | None = None, limit: int | None = None, refuse: int | None = None) -> Column:
    """struct(precision, recall, f1, candidate_tokens, reference_tokens, truncated): greedy best cosine between word vectors, no weighting, no rescaling.

    A side without words scores 0. Whole texts are scored, in blocks of words. Only for a model that has a limit itself: a side over
    `limit` words sets truncated and scores its first words, and one over `refuse` words raises, so no score is of less than it seems."""
    encoder = encoder or hashing_encoder()

    def run(c: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(c, r, strict=True):
            a, b = (x or "").split(), (y or "").split()
            if refuse is not None and max(len(a), len(b)) > refuse:
                raise ValueError(f"a pair of {len(a)} and {len(b)} words is over the model's {refuse}")
            if a and b:
                p, q = _best_cosines(a[:limit], b[:limit], encoder)
            else:
                p = q = 0.0
            rows.append((p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0, len(a), len(b), int(limit is not None and max(len(a), len(b)) > limit)))
        return pd.DataFrame(rows, columns=["precision", "recall", "f1", "candidate_tokens", "reference_tokens", "truncated"])

    return F.pandas_udf(run, "precision double, recall double, f1 double, candidate_tokens int, reference_tokens int, truncated int")(candidate, reference)


def score_fingerprint(columns: list[str], model: str, model_sha256: str) -> Column:
    """SHA-256 that a stored score is known by: of the texts it was made from, in canonical JSON, and of the model's name and files. Another model is another score."""
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(model_sha256), canonical(columns)), 256)

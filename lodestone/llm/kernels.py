"""Vectorised byte kernels: words, word hashes and shingles of whole texts.

UTF-8 texts are handled as one byte buffer per chunk. Every byte over 0x7F belongs to a word in both
word definitions used here, so words can be cut on bytes. A word's hash is a polynomial over a random
64-bit value per byte, from prefix sums, so the work per byte does not depend on the length of words.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20


def process_cache() -> dict:
    """What this process has computed, by name. It hangs on sys, so it outlives a task's copy of this module and never travels with a function."""
    cache = sys.__dict__.get("_lodestone_cache")
    if cache is None:
        cache = sys.__dict__["_lodestone_cache"] = {}
        _return_memory()
    return cache


def _return_memory() -> None:
    """Large arrays go back to the system when they are freed, where the C library lets that be set: workers share an executor's memory."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD


def tidy(run):
    """A function over batches that gives what it has freed back to the system at its end, pieces between live ones too: a worker that is kept for the next task
    holds no more than that task needs."""

    def tidied(batches):
        process_cache()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return tidied


_M = 0x9E3779B97F4A7C15 | 1
_MULT, _INV = np.uint64(_M), np.uint64(pow(_M, -1, 1 << 64))
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.uint64(0x51ED270B1A2C3D4F)


def word_table(separators: bytes) -> np.ndarray:
    """True for each byte that belongs to a word."""
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Words are runs without blank, tab, line feed, vertical tab, form feed, carriage return.
BLANK_WORDS = word_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII letters, digits and everything over 0x7F.
ALNUM_WORDS = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _C1
    x = x ^ (x >> np.uint64(27))
    x = x * _C2
    return x ^ (x >> np.uint64(31))


def _power(which: str, n: int) -> np.ndarray:
    have = process_cache().get(("power", which))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), _MULT if which == "up" else _INV, dtype=np.uint64)
        steps[0] = 1
        have = process_cache()["power", which] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about CHUNK_BYTES; a longer text comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, by default lower-cased in A-Z, words before each text (len texts + 1), byte range starts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    low = _LOWER[data] if lower else data
    inside = table[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts[1:] - 1] = inside[cuts[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * _power("up", n), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _power("down", n)[starts]
    h = mix(h + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets), starts


def shingle_hashes(h: np.ndarray, before: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of `size` words; shorter texts give their whole sequence as one."""
    if len(h) >= size:
        s = np.full(len(h) - size + 1, _SEED + np.uint64(size), dtype=np.uint64)
        for j in range(size):
            s = s * _MULT + h[j : len(h) - size + 1 + j]
        s = mix(s)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            v = np.sort(s[a : b - size + 1])
            keep = np.ones(len(v), bool)
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            out.append(v[keep])
        elif b > a:
            with np.errstate(over="ignore"):
                x = _SEED + np.uint64(b - a)
                for w in h[a:b]:
                    x = x * _MULT + w
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range data[start:end], its length included; equal ranges have equal hashes."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=prefix[1:])
    # an empty range at the end of the data has no place of its own
    h = (prefix[ends] - prefix[starts]) * _power("down", len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))

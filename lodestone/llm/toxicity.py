"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the sum of an embedding of the word and the mean embedding of its character trigrams. The
network reads windows of WINDOW words that overlap by a quarter; attention pools its states, and a text's score is
that of its highest window, so a short passage counts in a long text. Input projections are computed once
per distinct word of a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch
from .language_id import _distinct, _slices, _words

WINDOW, STRIDE = 48, 36
DIM, HIDDEN = 12, 8
WORDS, TRIGRAMS = 1 << 13, 1 << 12
#: Training texts of each label, at most.
TRAIN_DOCS = 1500
EPOCHS, RATE, DECAY, TRUST = 14, 0.01, 0.2, 4
AT_ONCE = 2048
REPEATS = 384


def _word_inputs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its bucket; all trigrams' buckets, and the word that each belongs to."""
    n = ends - starts
    word = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[word] + inner
    c = codes.astype(np.int64)
    left = np.where(inner > 0, c[np.maximum(at - 1, 0)], 2)
    right = np.where(inner + 1 < n[word], c[np.minimum(at + 1, len(c) - 1)], 3)
    tri = (left * 1000003 + c[at] * 10007 + right * 7919) % 1000000007 % TRIGRAMS
    power = np.array([pow(31, k, 1000000007) for k in range(64)])
    whole = np.bincount(word, (c[at] * power[inner % 64] % 1000000007).astype(np.float64), len(n)).astype(np.int64) % 1000000007 % WORDS
    return whole, tri, word


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *shape, s=0.1: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {
            "word": f(WORDS, DIM), "tri": f(TRIGRAMS, DIM), "w": f(2, DIM, 3 * HIDDEN, s=0.3), "b": f(2, 1, 3 * HIDDEN, s=0.01),
            "u": f(2, HIDDEN, 3 * HIDDEN, s=0.3), "att": f(2 * HIDDEN), "out": f(2 * HIDDEN, s=0.3), "bias": np.full(1, -1.0, np.float32),
        }

    def inputs(self, whole, tri, word):
        count = np.maximum(np.bincount(word, minlength=len(whole)), 1).astype(np.float32)
        chars = np.zeros((len(whole), DIM), np.float32)
        for j in range(DIM):
            chars[:, j] = np.bincount(word, self.p["tri"][tri, j], len(whole))
        return self.p["word"][whole] + chars / count[:, None], count

    def project(self, x: np.ndarray) -> np.ndarray:
        """[direction, word, gates], with one more row of zeros for places without a word."""
        p = x[None] @ self.p["w"] + self.p["b"]
        return np.concatenate([p, np.zeros((2, 1, 3 * HIDDEN), np.float32)], axis=1)

    def forward(self, table: np.ndarray, idx: np.ndarray, keep: bool = False):
        """Logits of windows idx [window, place] (-1: no word, only at the end)."""
        n, steps = idx.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.zeros((steps, 2, n, HIDDEN), np.float32)
        cache = []
        H = HIDDEN
        for t in range(steps):
            both = (idx[:, t], idx[:, steps - 1 - t])
            px = np.stack([table[0][both[0]], table[1][both[1]]])
            live = np.stack([both[0] >= 0, both[1] >= 0])[:, :, None].astype(np.float32)
            hu = h @ self.p["u"]
            g = np.tanh(0.5 * (px[:, :, : 2 * H] + hu[:, :, : 2 * H])) * 0.5 + 0.5
            z, r = g[:, :, :H], g[:, :, H:]
            hn = hu[:, :, 2 * H :]
            c = np.tanh(px[:, :, 2 * H :] + r * hn)
            new = h + live * (1 - z) * (c - h)
            if keep:
                cache.append((h, z, r, hn, c, live))
            h = new
            states[t, 0], states[steps - 1 - t, 1] = new[0], new[1]
        s = np.concatenate([states[:, 0], states[:, 1]], axis=2)  # [place, window, 2H]
        a = s @ self.p["att"]
        a = np.where(idx.T >= 0, a, -30)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, s)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (s, a, pooled, cache)) if keep else logit

    def gradients(self, x, whole, tri, word, count, table, idx, target) -> tuple[dict, float]:
        H = HIDDEN
        logit, (s, a, pooled, cache) = self.forward(table, idx, keep=True)
        y = 1 / (1 + np.exp(-logit))
        d = ((y - target) / len(target)).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * self.p["out"][None]
        ds = a[:, :, None] * dp[None]
        da = np.einsum("nh,tnh->tn", dp, s)
        da = a * (da - (a * da).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", da, s)
        ds += da[:, :, None] * self.p["att"]
        steps = idx.shape[1]
        back = np.zeros((2, len(idx), H), np.float32)
        dt = np.zeros_like(table)
        ut = self.p["u"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            h, z, r, hn, c, live = cache[t]
            dh = back + np.stack([ds[t, :, :H], ds[steps - 1 - t, :, H:]])
            dlive = dh * live
            dz = dlive * (h - c) * z * (1 - z)
            dc = dlive * (1 - z) * (1 - c * c)
            dr = dc * hn * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            g["u"] += h.transpose(0, 2, 1) @ du
            back = dh * (1 - live) + dlive * z + du @ ut
            px = np.concatenate([dz, dr, dc], axis=2)
            np.add.at(dt[0], idx[:, t], px[0])
            np.add.at(dt[1], idx[:, steps - 1 - t], px[1])
        dt = dt[:, :-1]
        g["w"] = x.T[None] @ dt
        g["b"] = dt.sum(axis=1, keepdims=True)
        dx = np.einsum("dng,dkg->nk", dt, self.p["w"])
        np.add.at(g["word"], whole, dx)
        np.add.at(g["tri"], tri, (dx / count[:, None])[word])
        loss = -np.mean(np.where(target > 0.5, np.log(y + 1e-9), np.log(1 - y + 1e-9)))
        return g, float(loss)


def windows(text_of_word: np.ndarray, kinds: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows of word kinds, -1 after a text's end; text of each): every word is in a window, neighbours overlap."""
    bounds = np.searchsorted(text_of_word, np.arange(texts + 1))
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
    owner = np.repeat(np.arange(texts), count)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE + bounds[owner]
    at = start[:, None] + np.arange(WINDOW)
    ok = at < bounds[owner + 1][:, None]
    return np.where(ok, kinds[np.minimum(at, max(0, len(kinds) - 1))] if len(kinds) else -1, -1), owner


def prepare(texts: list[str]):
    """Word inputs of the distinct words of texts, windows over them and each window's text; a slice of the texts at a time."""
    hashes, whole, tri, word, idx, owner = [], [], [], [], [], []
    done = base = 0
    for part in _slices(texts):
        codes, starts, ends, text = _words([t.lower() for t in part])
        if len(starts):
            first, kind, known = _distinct(codes, starts, ends)
            w, t, of = _word_inputs(codes, starts[first], ends[first])
            i, o = windows(text, kind, len(part))
            hashes.append(known), whole.append(w), tri.append(t), word.append(of + base)
            idx.append(np.where(i >= 0, i + base, -1)), owner.append(o + done)
            base += len(first)
        done += len(part)
    if not hashes:
        return None
    if len(hashes) == 1:
        return whole[0], tri[0], word[0], idx[0], owner[0]
    _, first, new = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    word, i = np.concatenate(word), np.concatenate(idx)
    mine = np.isin(word, first)
    return np.concatenate(whole)[first], np.concatenate(tri)[mine], new[word[mine]], np.where(i >= 0, new[i], -1), np.concatenate(owner)


def logits(net: Network, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(logit of each text's highest window, number of windows); -inf and 0 without words. Whole texts."""
    best, count = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
    done = 0
    for part in _slices(texts):
        got = prepare(part)
        if got is not None:
            whole, tri, word, idx, owner = got
            table = net.project(net.inputs(whole, tri, word)[0])
            for a in range(0, len(idx), AT_ONCE):
                np.maximum.at(best, done + owner[a : a + AT_ONCE], net.forward(table, idx[a : a + AT_ONCE]))
            count[done : done + len(part)] = np.bincount(owner, minlength=len(part))
        done += len(part)
    return best, count


def _repeats(rng: np.random.Generator, clean: np.ndarray) -> np.ndarray:
    """Windows in which one to four words of texts without the label repeat: repetition alone is nothing bad."""
    runs = np.sort(rng.integers(0, WINDOW, (REPEATS, 3)) * (rng.random((REPEATS, 3)) < 0.5), axis=1)
    which = (np.arange(WINDOW)[None, None, :] >= runs[:, :, None]).sum(axis=1)
    return np.take_along_axis(clean[rng.integers(0, len(clean), (REPEATS, 4))], which, axis=1)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Each epoch trains on the window of each text that the network finds highest, and on a random one of each text without the label."""
    net, rng = Network(seed), np.random.default_rng(seed)
    got = prepare(texts) if len(texts) else None
    if got is None or len(set(labels.tolist())) < 2:
        return net
    whole, tri, word, idx, owner = got
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    clean = idx[labels[owner] == 0]
    clean = np.unique(clean[clean >= 0])
    for epoch in range(epochs):
        x, _ = net.inputs(whole, tri, word)
        table = net.project(x)
        score = np.concatenate([net.forward(table, idx[a : a + AT_ONCE]) for a in range(0, len(idx), AT_ONCE)])
        score = score + rng.gumbel(size=len(score)) * (2.0 if epoch < 3 else 0.1)
        order = np.lexsort((-score, owner))
        top = order[np.unique(owner[order], return_index=True)[1]]
        order = np.lexsort((rng.random(len(owner)), owner))
        any_ = order[np.unique(owner[order], return_index=True)[1]]
        if epoch >= TRUST:  # a text with the label and no window like the others' is taken for a wrong label
            top = top[(labels[owner[top]] == 0) | (score[top] > -1.5)]
        pick = np.concatenate([top, any_[labels[owner[any_]] == 0]])
        target = np.concatenate([labels[owner[pick]], np.zeros(REPEATS if len(clean) else 0)]).astype(np.float32)
        seen = np.concatenate([idx[pick], _repeats(rng, clean)]) if len(clean) else idx[pick]
        pick = rng.permutation(len(seen))
        for a in range(0, len(pick), 128):
            w = seen[pick[a : a + 128]]
            used, inverse = np.unique(w, return_inverse=True)
            inverse = inverse.reshape(w.shape)
            if used[0] == -1:
                used, inverse = used[1:], inverse - 1
            new = np.full(len(whole), -1, np.int64)
            new[used] = np.arange(len(used))
            mine = new[word] >= 0
            sub = (whole[used], tri[mine], new[word[mine]])
            x, count = net.inputs(*sub)
            g, _ = net.gradients(x, *sub, count, net.project(x), inverse, target[pick[a : a + 128]])
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs) * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] * g[k] - v[k])
                net.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)
                if k in ("word", "tri"):
                    net.p[k] *= np.float32(1 - rate * DECAY)
    return net


def train(documents: DataFrame, labels: DataFrame, fold: str, per_label: int = TRAIN_DOCS) -> Network:
    """Learns from `per_label` texts of each label, drawn by hash from the fold's rows; rows without a label or text don't count.

    If one label is missing the network stays untrained and scores all texts low.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(f"toxic in (0, 1) and doc_id is not null and ({fold})")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = dict(rows.groupBy("toxic").count().collect())
    share = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30))
    cut = F.lit(0)
    for label, n in total.items():
        cut = F.when(F.col("toxic") == label, min(1 << 30, int(per_label / n * (1 << 30)))).otherwise(cut)
    some = rows.where(share < cut).limit(4 * per_label)  # the draw has per_label rows of each label, give or take its deviation
    got = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").where("text is not null").select("doc_id", "text", "toxic").collect()
    got.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in got], np.array([r.toxic for r in got], np.int64))


def score_texts(documents: DataFrame, net: Network) -> DataFrame:
    """documents (doc_id, text) -> doc_id, score (0 to 1), windows (how many were scored).

    Words are runs of letters, lower-cased. Texts without words (null, empty, digits) score 0. Only the text is an input. Repeated
    rows are kept; an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logit, count = logits(sent.value, [t or "" for t in b.column(1).to_pylist()])
            score = np.where(count > 0, 1 / (1 + np.exp(-np.clip(logit, -40, 40))), 0.0)
            yield batch({"doc_id": b.column(0), "score": pa.array(score, pa.float64()), "windows": pa.array(count)})

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, windows long")

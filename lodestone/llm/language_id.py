"""Language identification with interpolated Kneser-Ney character models.

A word is a maximal run of letters, lower-cased; a model of order 5 sees each word between start marks and an
end mark, so a document's cross-entropy is a sum over its words and each distinct word of a batch is scored once.
Counts come from all training rows: per task over distinct words, then summed in Spark. Lower orders hold
continuation counts. The model is a sorted array of n-gram hashes per order with one row of log probabilities
(all languages) each, and one of context hashes with back-off weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import quantiles, ranked_values
from . import kernels as K
from .common import batch, materialise, scratch

ORDER = 5
#: Grams whose dense rows (all languages) the model's making holds at once.
MODEL_SLICE = 1 << 18
CHUNK_CHARS = 1 << 19
#: Rows of grams that a task counts before it sums them up, per language, and that it holds before it sends them on.
FRESH, HELD = 300_000, 1_500_000
_MARK = 1  # stands before and after a word; no letter has this code


def _letter_table() -> np.ndarray:
    cache = K.process_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, starts and ends of the words, and the text of each word."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        z = np.zeros(0, np.int64)
        return codes, z, z, z
    inside = _letter_table()[codes]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
    return codes, starts, ends, text


def _distinct(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one word of each kind, kind of each word, hash of each kind)."""
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(K.mix(codes.astype(np.uint64) + np.uint64(7)) * K._power("up", len(codes)), out=prefix[1:])
    h = K.mix((prefix[ends] - prefix[starts]) * K._power("down", len(codes))[starts] + (ends - starts).astype(np.uint64))
    known, first, kind = np.unique(h, return_index=True, return_inverse=True)
    return first, kind, known


def _grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order-grams of words as rows of codes (each letter and the end mark with what stands before), and each one's word."""
    n = ends - starts
    size = n + order  # order - 1 marks before, one after
    at = np.cumsum(size) - size
    flat = np.full(int(size.sum()), _MARK, np.uint32)
    word = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    flat[at[word] + order - 1 + inner] = codes[starts[word] + inner]
    owner = np.repeat(np.arange(len(n)), n + 1)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1) + at[owner]
    return np.stack([flat[first + j] for j in range(order)], axis=1), owner


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), np.uint64(rows.shape[1]), np.uint64)
    for j in range(rows.shape[1]):
        h = h * K._MULT + rows[:, j].astype(np.uint64)
    return K.mix(h)


def count_grams(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """documents (text, lang), and apart (0, 1 or 2) where some rows are set apart, -> (lang, gram, n, first, second): counts of the highest order over
    all rows, and over those of set 1 and of set 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.process_cache()
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        fresh: dict[tuple[str, int], int] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            rows, n = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
            _, first, kind = np.unique(_hash(rows), return_index=True, return_inverse=True)
            return rows[first], np.bincount(kind, n).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in dict.fromkeys(lang for lang, _ in held):
                parts = [(*p, apart) for (of, apart), some in held.items() if of == lang for p in some]
                rows, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                apart = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
                _, first, kind = np.unique(_hash(rows), return_index=True, return_inverse=True)
                total, one, two = (pa.array(np.bincount(kind, n * of, len(first)).astype(np.int64)) for of in (1, apart == 1, apart == 2))
                text = np.ascontiguousarray(rows[first].astype("<u4")).view(f"<U{order}")[:, 0]
                yield batch({"lang": pa.array([lang] * len(first), pa.string()), "gram": pa.array(text.tolist(), pa.string()), "n": total, "first": one, "second": two})
            held.clear()
            fresh.clear()

        for b in batches:
            texts, langs = b.column(0).to_pylist(), list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            for lang in dict.fromkeys(langs):
                for part in _slices([t for t, x in zip(texts, langs, strict=True) if x == lang and t]):
                    codes, starts, ends, _ = _words([t.lower() for t in part])
                    if not len(starts):
                        continue
                    first, kind, _ = _distinct(codes, starts, ends)
                    rows, owner = _grams(codes, starts[first], ends[first], order)
                    held.setdefault(lang, []).append((rows, np.bincount(kind)[owner].astype(np.float64)))
                    fresh[lang] = fresh.get(lang, 0) + len(rows)
                    if fresh[lang] > FRESH:
                        rows, n = merged(held[lang])
                        held[lang], fresh[lang] = [(rows, n.astype(np.float64))], 0
                if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                    yield from flush()
        yield from flush()

    rows = documents.select("text", "lang", "apart" if "apart" in documents.columns else F.lit(0).alias("apart")).mapInArrow(K.tidy(run), "lang string, gram string, n long, first long, second long")
    return rows.groupBy("lang", "gram").agg(*[F.sum(c).alias(c) for c in ("n", "first", "second")])


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, room = [], 0
    for t in texts:
        part.append(t)
        room += len(t)
        if room >= CHUNK_CHARS:
            yield part
            part, room = [], 0
    if part:
        yield part


@dataclass
class Model:
    langs: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]  # per order 1..order: sorted hashes, log probabilities
    contexts: list[tuple[np.ndarray, np.ndarray]]  # per order 2..order: sorted hashes of contexts, log back-off weights
    floor: np.ndarray  # log probability of a letter that no model knows
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: tuple[float, float, float] = (0.0, 8.0, 0.0)
    limit: float = 0.0  # strangeness beyond which a text is rejected; it says something once mean is set

    def losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per letter and end mark of each lower-cased text and language, number of those); whole texts."""
        out, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        done = 0
        for part in _slices(texts):
            codes, starts, ends, text = _words([t.lower() for t in part])
            if len(starts):
                first, kind, _ = _distinct(codes, starts, ends)
                rows, owner = _grams(codes, starts[first], ends[first], self.order)
                per = self._log_probs(rows)
                word = np.stack([np.bincount(owner, per[:, j], len(first)) for j in range(len(self.langs))], axis=1)
                for j in range(len(self.langs)):
                    out[done : done + len(part), j] = -np.bincount(text, word[kind, j], len(part))
                count[done : done + len(part)] = np.bincount(text, ends - starts + 1, len(part)).astype(np.int64)
            done += len(part)
        return out / np.maximum(count, 1)[:, None], count

    def _log_probs(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros((len(rows), len(self.langs)), np.float32)
        open_ = np.arange(len(rows))
        for o in range(self.order, 0, -1):
            sub = rows[open_, self.order - o :]
            known, values = self.grams[o - 1]
            at, hit = _lookup(known, _hash(sub))
            total[open_[hit]] += values[at[hit]]
            open_, sub = open_[~hit], sub[~hit]
            if not len(open_):
                return total
            if o > 1:
                known, values = self.contexts[o - 2]
                at, hit = _lookup(known, _hash(sub[:, :-1]))
                total[open_[hit]] += values[at[hit]]
        total[open_] += self.floor
        return total

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or 'und', score from 0 to 1, accepted)."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        loss, n = self.losses(texts)
        best = loss.argmin(axis=1)
        ordered = np.sort(loss, axis=1)
        margin = (ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.ones(len(texts))) * np.sqrt(np.minimum(n, 400))
        z = self.strange(loss, best, n)
        a, b, c = self.weights
        score = 1 / (1 + np.exp(-np.clip(a + b * margin - c * np.maximum(z, 0), -40, 40)))
        ok = n > 0
        lang = [self.langs[i] if y else "und" for i, y in zip(best, ok, strict=True)]
        return lang, np.where(ok, score, 0.0), ok & (z <= self.limit)

    def strange(self, loss: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Deviations of the best language's cross-entropy over that of its training texts of such a length."""
        if self.mean is None:
            return np.zeros(len(best))
        return (loss[np.arange(len(best)), best] - self.mean[best]) / (self.spread[best] * np.sqrt(1 + 300 / np.maximum(n, 1)))


#: Share of texts in a language of the model that calibration allows to be rejected, the share of held-out texts that its tail rests on and
#: the least number of them, and the excess (in deviations) that as many texts as PRIOR are taken to have shown before.
FALSE_REJECTS, TAIL, LEAST_TAIL = 1e-6, 0.05, 20
PRIOR, PRIOR_EXCESS = 4, 1.0
#: Cells of a unit of the logarithms of margin and strangeness, in which rows are counted for the curve of the scores.
CELLS = 32
#: Natural logarithms: no language is taken to vary less, so that tables, capitals or names in a text don't make it strange.
LEAST_SPREAD = 0.15


def _lookup(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    order = np.argsort(h)  # sorted look-ups stay in cache
    at = np.empty(len(h), np.int64)
    at[order] = np.searchsorted(known, h[order])
    at[at == len(known)] = 0
    return at, known[at] == h


def build_model(counts: DataFrame, order: int = ORDER) -> Model:
    """count_grams() -> Model. Interpolated Kneser-Ney, one discount n1 / (n1 + 2 n2) per language and order.

    Every gram counts and is in the model, however rare and in however small a language: nothing is pruned, so the driver's
    memory and the broadcast grow with the distinct grams. No counts give a model without languages, which answers 'und'.
    """
    rows = counts.select("lang", "gram", "n").toArrow()
    langs = sorted(set(rows["lang"].unique().to_pylist()))
    grams: list = []
    contexts: list = []
    if not langs:
        return Model([], order, [], [], np.zeros(0))
    place = {x: i for i, x in enumerate(langs)}
    lang, codes = [], []
    for b in rows.to_batches(max_chunksize=MODEL_SLICE):
        own = b.column(0).dictionary_encode()
        lang.append(np.array([place[x] for x in own.dictionary.to_pylist()], np.int32)[own.indices.to_numpy()])
        codes.append(np.frombuffer("".join(b.column(1).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order))
    lang, codes = np.concatenate(lang), np.concatenate(codes)
    n = rows["n"].to_numpy().astype(np.float64)
    del rows
    levels = [None] * (order + 1)
    levels[order] = (codes, lang, n)
    for o in range(order - 1, 0, -1):  # continuation counts: distinct letters that stand before
        up, up_lang, _ = levels[o + 1]
        h = K.mix(_hash(up[:, 1:]) + up_lang.astype(np.uint64))
        _, first, kind = np.unique(h, return_index=True, return_inverse=True)
        levels[o] = (up[first, 1:], up_lang[first], np.bincount(kind).astype(np.float64))
    alphabet = [max(2, len(np.unique(levels[1][0][levels[1][1] == j]))) for j in range(len(langs))]
    floor = np.array([-np.log(2.0 * a + 1000) for a in alphabet])
    below = None
    for o in range(1, order + 1):
        c, l, n = levels[o]
        h = _hash(c)
        known, first, kind = np.unique(h, return_index=True, return_inverse=True)
        n1, n2 = (np.array([max(1.0, ((n == v) & (l == j)).sum()) for j in range(len(langs))]) for v in (1, 2))
        d = n1 / (n1 + 2 * n2)
        ctx = _hash(c[first][:, :-1]) if o > 1 else np.zeros(len(known), np.uint64)
        ctx_known, ctx_kind = np.unique(ctx, return_inverse=True)
        cell = ctx_kind[kind] * len(langs) + l  # a gram is there once for each language that has it
        total, types = (np.bincount(cell, w, len(ctx_known) * len(langs)).reshape(-1, len(langs)) for w in (n, None))
        back = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
        sorted_, made = np.argsort(kind, kind="stable"), np.empty((len(known), len(langs)), np.float32)
        edge = np.searchsorted(kind[sorted_], np.arange(0, len(known) + MODEL_SLICE, MODEL_SLICE))
        for i, a in enumerate(range(0, len(known), MODEL_SLICE)):
            some, at, in_ = first[a : a + MODEL_SLICE], sorted_[edge[i] : edge[i + 1]], ctx_kind[a : a + MODEL_SLICE]
            table = np.zeros((len(some), len(langs)))
            table[kind[at] - a, l[at]] = n[at]
            lower = np.exp(floor)[None, :] if o == 1 else np.exp(below(c[some][:, 1:]))
            p = np.where(total[in_] > 0, np.maximum(table - d, 0) / np.maximum(total[in_], 1), 0.0) + back[in_] * lower
            made[a : a + MODEL_SLICE] = np.log(p)
        grams.append((known, made))
        if o > 1:
            contexts.append((ctx_known, np.log(back).astype(np.float32)))
        else:
            floor = floor + np.log(back[0])
        below = Model(langs, o, grams[:], contexts[:], floor)._log_probs
    return Model(langs, order, grams, contexts, floor)


def measure(model: Model, langs: list[str], rows: DataFrame) -> DataFrame:
    """rows (text, lang) that the model has not seen -> own, best (places in langs; own null without one), n (letters and end marks), loss (cross-entropy in the
    best language), own_loss (in the own one; null where the model lacks it), margin. Rows without a letter are left out, and all if the model has no language."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model = sent.value
            loss, n = model.losses([t or "" for t in b.column(0).to_pylist()])
            own = np.array([place.get(x, -1) for x in b.column(1).to_pylist()], np.int64)
            seen = np.flatnonzero((n > 0) & (len(model.langs) > 0))
            wide = np.full((len(seen), len(langs)), np.inf)
            wide[:, [place[x] for x in model.langs]] = loss[seen]
            n, own = n[seen], own[seen]
            best = wide.argmin(axis=1)
            ordered = np.partition(wide, 1, axis=1) if len(langs) > 1 else None
            margin = (np.minimum(ordered[:, 1] - ordered[:, 0], 10) if len(langs) > 1 else 1.0) * np.sqrt(np.minimum(n, 400))
            at = np.arange(len(seen))
            mine = wide[at, own]
            yield batch({
                "own": pa.array(own, mask=own < 0), "best": pa.array(best), "n": pa.array(n), "loss": pa.array(wide[at, best]),
                "own_loss": pa.array(mine, mask=(own < 0) | ~np.isfinite(mine)), "margin": pa.array(margin),
            })

    found = materialise(rows.select("text", "lang").mapInArrow(K.tidy(run), "own long, best long, n long, loss double, own_loss double, margin double"), "measured")
    sent.destroy()
    return found


def tail_limit(right: DataFrame) -> float:
    """Where an exponential tail through the largest strangenesses (z, of all rows of `right`) leaves FALSE_REJECTS of them: TAIL of all, LEAST_TAIL at least. Few
    texts count little beside the prior, so the rule is one for every number of texts, none included."""
    k = F.least(F.col("total"), F.greatest(F.lit(LEAST_TAIL), F.ceil(F.lit(TAIL) * F.col("total"))))
    inside = F.least(F.col("n"), F.col("before") + F.col("n") - (F.col("total") - k))
    r = ranked_values(right, [], "z").withColumn("inside", inside).where("inside > 0")
    r = r.agg(F.sum(F.col("inside") * F.col("z")).alias("sum"), F.sum("inside").alias("k"), F.min("z").alias("edge"), F.max("z").alias("top"), F.max("total").alias("total")).first()
    k, edge = r.k or 0, r.edge or 0.0
    excess = ((r.sum or 0.0) - k * edge + PRIOR * PRIOR_EXCESS) / (k + PRIOR)
    return float(max(r.top or 0.0, edge + excess * math.log(max(k, 1) / max(r.total or 0, 1) / FALSE_REJECTS)))


def fit_curve(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve from x to y, each row of them standing for `rows` rows, with a ridge; those of margin and strangeness are not negative. Newton
    steps are shortened until the loss falls, as a wrong label far from the others makes full ones leap to and fro."""
    cost = lambda w: (rows * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w))).sum() + 0.005 * (w @ w)
    w, damp = np.zeros(3), 1e-3
    now = cost(w)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (rows * (y - p)) - 0.01 * w
        h = (x * (rows * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        new = np.maximum(w + np.linalg.solve(h + damp * np.diag(np.diag(h)), g), [-20, 0.0, 0.0])
        if (then := cost(new)) < now:
            w, now, damp = new, then, damp / 4
        else:
            damp *= 8
            if damp > 1e15:
                break
    return w


def calibrate(model: Model, measured: DataFrame) -> Model:
    """Fits how unusual a text's cross-entropy is, the limit beyond which a text is rejected, and a logistic curve from margin to the chance of
    being right, from measure() of texts that the measuring models had not seen; its languages are the model's. All rows count: medians and the limit rest on their
    ranks, the curve on the sums of cells, whose number does not follow that of the rows."""
    if not model.langs:
        return model
    many = len(model.langs)
    model.mean, model.spread = np.zeros(many), np.full(many, np.inf)  # a language without a text here makes no text strange
    long = F.coalesce((F.col("own") == F.col("best")) & (F.col("n") >= 100), F.lit(False))
    enough = [r.own for r in measured.where(long).groupBy("own").count().where("count >= 5").collect()]
    mine = measured.where(F.col("own_loss").isNotNull() & (long | ~F.col("own").isin(enough)))
    at = lambda values, key: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col(key) + 1).cast("int"))
    for r in quantiles(mine, ["own"], ["own_loss"], [0.5]).collect():
        model.mean[r.own] = r.q[0]
    off = mine.select("own", F.abs(F.col("own_loss") - at(model.mean, "own")).alias("off"))
    for r in quantiles(off, ["own"], ["off"], [0.5]).collect():
        model.spread[r.own] = max(LEAST_SPREAD, 1.4826 * r.q[0])
    strange = (F.col("loss") - at(model.mean, "best")) / (at(model.spread, "best") * F.sqrt(1 + F.lit(300) / F.col("n")))
    judged = measured.select(F.coalesce(F.col("own") == F.col("best"), F.lit(False)).alias("right"), "margin", F.greatest(strange, F.lit(0.0)).alias("z"))
    model.limit = tail_limit(judged.where("right").select("z"))
    cell = lambda c: F.floor(F.log1p(c) * CELLS).alias(f"{c}_cell")
    cells = judged.groupBy("right", cell("margin"), cell("z")).agg(F.count("*").alias("rows"), F.avg("margin").alias("margin"), F.avg("z").alias("z")).toPandas()
    if not len(cells):
        return model
    x, y, rows = np.stack([np.ones(len(cells)), cells["margin"], -cells["z"]], axis=1), cells["right"].to_numpy(float), cells["rows"].to_numpy(float)
    model.weights = tuple(fit_curve(x, y, rows).tolist())
    return model


def train(documents: DataFrame, fold: str = "pmod(crc32(cast(doc_id as string)), 4) <> 2", order: int = ORDER) -> Model:
    """Learns from text and lang of the rows in the fold that have both; counts cover all of them. Rejection and scores are calibrated
    crosswise on all of them too, at every size by the same rule: each half of the rows is measured with a model of the other half's counts."""
    rows = documents.where(f"text is not null and lang is not null and ({fold})").select("doc_id", "text", "lang")
    half = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id", F.octet_length("text")), F.lit(2))
    rows = rows.withColumn("apart", (half + 1).cast("int"))
    with scratch(documents.sparkSession):
        counts = materialise(count_grams(rows, order), "grams")
        langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
        if not langs:
            return build_model(counts, order)
        measured = []
        for k, other in ((1, "second"), (2, "first")):  # one model at a time is all that the driver holds
            measured.append(measure(build_model(counts.select("lang", "gram", F.col(other).alias("n")).where("n > 0"), order), langs, rows.where(F.col("apart") == k)))
        return calibrate(build_model(counts.select("lang", "gram", "n"), order), measured[0].unionAll(measured[1]))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """documents (doc_id, text) -> doc_id, lang_pred, score, accepted.

    'und' with score 0 where the text is null or has no letter; otherwise a language of the model, of the lowest
    length-normalised cross-entropy (ties: first by name). accepted is false for 'und' and for texts unlike all training texts.
    lang, source and doc_id are not inputs. Repeated rows are kept; an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, ok = sent.value.judge([t or "" for t in b.column(1).to_pylist()])
            yield batch({"doc_id": b.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "accepted": pa.array(ok)})

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(K.tidy(run), "doc_id long, lang_pred string, score double, accepted boolean")


def accepted_only(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, whose text has a language of the model; judged row by row where they lie, so nothing is shuffled."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.judge([t or "" for t in b.column(at).to_pylist()])[2], pa.bool_()))

    return documents.mapInArrow(K.tidy(run), documents.schema)

"""Quality rules: statistics of whole texts, and an isolation forest that tells which texts stand apart.

1. One pass over the texts counts the statistics that rules look at; the two base rules decide on them alone.
2. Trees of random splits are grown on SUBSAMPLE rows each, drawn by hash from all rows; a row's score follows from the mean length of its
   paths. The statistics enter as shares, so a text's length alone says nothing.
3. The labelled rows set the limit. All of them are scored, and a histogram of scores by label is all that is gathered: the limit is the one
   that tells the labels apart best among those that flag at most WRONG of the rows labelled good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import batch, materialise, maybe_broadcast

#: Rows a tree is grown on and number of trees; together the most rows that reach the driver.
SUBSAMPLE, TREES = 256, 200
#: Share of the rows labelled good that the limit may flag at most; scores are told apart to 1 / BINS.
WRONG, BINS = 0.001, 20000
#: The base rules: fewer words, or a larger share (in hundredths) of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_digits", "n_marked_words")
_SYMBOL, _UPPER, _LETTER, _MARK, _DIGIT = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGIT[48:58] = True


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text of a run of texts (see kernels.chunks). Words are runs without blank, tab, line feed, vertical tab, form feed and
    carriage return, lines what stands between line feeds; words, windows of three words and lines are equal byte by byte (by 64-bit hashes)."""
    texts = len(offsets) - 1
    out = {c: np.zeros(texts, np.int64) for c in COUNTS}
    if not len(data):
        return out
    owner = np.repeat(np.arange(texts), np.diff(offsets))  # of bytes

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    inside, points = K.BLANK_WORDS[data], (data & 0xC0) != 0x80
    out["word_chars"] = per_text(inside & points)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _MARK), ("n_digits", _DIGIT)):
        out[name] = per_text(table[data])
    h, before, starts = K.words(data, offsets, K.BLANK_WORDS, lower=False)
    out["n_words"] = np.diff(before)
    text_of = owner[starts]
    # words that end in a mark or are nothing but marks, other than commas and full stops
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:] & (owner[1:] == owner[:-1]), [False]]))
    last = data[ends]
    out["n_marked_words"] = np.bincount(text_of, _MARK[last] & (last != 44) & (last != 46), texts).astype(np.int64)
    if len(h) > 2:
        g = K.mix(h[:-2] + K.mix(h[1:-1] + K.mix(h[2:])) + np.uint64(3))
        ok = np.flatnonzero(text_of[:-2] == text_of[2:])
        order = ok[np.lexsort((g[ok], text_of[ok]))]
        same = (g[order[1:]] == g[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        twice[1:] |= twice[:-1].copy()  # the window's second word
        first = np.zeros(len(h), bool)
        first[order[1:][same]] = first[order[:-1][same]] = True
        twice[2:] |= first[:-2]
        out["n_repeat_words"] = np.bincount(text_of, twice, texts).astype(np.int64)
    # a line runs from the start of its text or from behind a line feed to the next one or to the end of its text
    feeds = np.flatnonzero(data == 10)
    whole, inner = np.arange(texts), owner[feeds]
    begin = np.concatenate([offsets[:-1], feeds + 1])[np.argsort(np.concatenate([whole, inner]), kind="stable")]
    end = np.concatenate([feeds, offsets[1:]])[np.argsort(np.concatenate([inner, whole]), kind="stable")]
    whose = np.sort(np.concatenate([whole, inner]))
    words_upto = np.concatenate([[0], np.cumsum(inside)])
    full = words_upto[end] > words_upto[begin]
    out["n_lines"] = np.bincount(whose[full], minlength=texts)
    if full.any():
        lines, of = K.segment_hashes(data, begin[full], end[full]), whose[full]
        order = np.lexsort((lines, of))
        again = (lines[order[1:]] == lines[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        out["n_dup_lines"] = np.bincount(of[order[1:]][again], minlength=texts)
    return out


def rule_statistics(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id and COUNTS (longs).

    n_lines counts the lines with a word, n_dup_lines those of them that equal an earlier one, n_repeat_words the words in windows of three that
    the text holds twice or more, the first one's included; letters, upper case, marks and digits are those of ASCII. Null and empty
    texts have zeros. Repeated rows are kept, extra columns are not read, an empty table gives no rows. A text's arrays take about 60 times its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [count_texts(data, offsets) for _, _, data, offsets in K.chunks(b.column(1))]
            columns = {c: pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in COUNTS}
            yield batch({"doc_id": b.column(0)} | columns)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: shares of symbols, marked words and marks by words, of upper case by letters, and the share of repeated words, squared, as
    the base rule judges it already and common passages give clean texts small ones."""
    words, letters = np.maximum(c["n_words"], 1), np.maximum(c["n_letters"], 1)
    return np.stack([c["n_symbols"] / words, c["n_marked_words"] / words, c["n_upper"] / letters, c["n_marks"] / words, (c["n_repeat_words"] / words) ** 2], axis=1)


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary search tree of n rows: what a path that ends among n rows is short of."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Nodes of all trees as arrays: children of node i of tree t are 2 i + 1 and 2 i + 2; column is -1 at a leaf, whose path has the length path."""

    column: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that stand apart: 2 to the power of minus the mean path over the path expected."""
        total = np.zeros(len(x))
        for column, cut, path in zip(self.column, self.cut, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                c = column[at]
                down = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(c, 0)] >= cut[at])
                at = np.where(c >= 0, down, at)
            total += path[at]
        return 2.0 ** (-total / len(self.column) / self.norm)


#: Splits on a path at most: as many as halve the rows of a tree to one.
DEPTH = int(np.ceil(np.log2(SUBSAMPLE)))


def grow(x: np.ndarray, trees: int = TREES, seed: int = 12) -> Forest:
    """A forest on rows x: each tree on SUBSAMPLE of them (all, if fewer), each split at a random place of a random column that still differs."""
    rng, size = np.random.default_rng(seed), 2 ** (DEPTH + 1) - 1
    column, cut, path = np.full((trees, size), -1, np.int64), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, rng.choice(len(x), min(SUBSAMPLE, len(x)), replace=False))]
        while todo:
            node, depth, rows = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            differ = np.flatnonzero(high > low)
            path[t, node] = depth + average_path(len(rows))
            if depth < DEPTH and len(differ):
                column[t, node] = c = rng.choice(differ)
                cut[t, node] = at = high[c] - rng.random() * (high[c] - low[c])  # above low, so both sides have rows
                right = x[rows, c] >= at
                todo += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return Forest(column, cut, path, max(1.0, float(average_path(min(SUBSAMPLE, len(x))))))


def fit_forest(statistics: DataFrame, trees: int = TREES, seed: int = 12) -> Forest | None:
    """A forest on TREES * SUBSAMPLE rows at most, drawn by hash from all rows of stored rule_statistics(); None without rows."""
    wanted, total = trees * SUBSAMPLE, statistics.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", *COUNTS), F.lit(1 << 30))
    some = statistics.where(draw < min(1 << 30, int(0.9 * wanted / max(1, total) * (1 << 30)))) if total > wanted else statistics
    got = some.orderBy(draw, "doc_id").limit(wanted).select(*COUNTS).toArrow()
    return grow(features({c: got[c].to_numpy() for c in COUNTS}), trees, seed) if len(got) else None


def scores(statistics: DataFrame, forest: Forest | None) -> DataFrame:
    """rule_statistics() with base_failed and score (0 without a forest)."""
    sent = statistics.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features({c: b.column(i + 1).to_numpy() for i, c in enumerate(COUNTS)})
            score = sent.value.score(x) if sent.value is not None and len(x) else np.zeros(len(x))
            yield batch(dict(zip(b.schema.names, b.columns, strict=True)) | {"score": pa.array(score)})

    made = statistics.select("doc_id", *COUNTS).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    return made.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


def limit(histogram: list[tuple[int, int, int]], wrong: float = WRONG) -> float:
    """(bin, label, rows) -> the score from which on rows are flagged: of the limits that flag at most `wrong` of the rows labelled 1, the one with
    the largest difference of the shares flagged of label 0 and label 1; the highest of equal ones. Without rows of both labels nothing is flagged."""
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for b, label, n in histogram:
        (good if label else bad)[b] += n
    if not good.sum() or not bad.sum():
        return np.inf
    share = [np.cumsum(v[::-1])[::-1] / v.sum() for v in (good, bad)]
    gain = np.where(share[0] <= wrong, share[1] - share[0], -1)
    best = int(len(gain) - 1 - gain[::-1].argmax())
    return best / BINS if gain[best] > 0 else np.inf


def judge(documents: DataFrame, labels: DataFrame, wrong: float = WRONG, trees: int = TREES, seed: int = 12) -> DataFrame:
    """documents (doc_id, text) and labels (doc_id, quality 0 or 1) -> doc_id, COUNTS, score, base_failed, anomalous and kept.

    kept: the base rules pass and the forest doesn't flag the row. The limit is set on labelled rows that pass the base rules; a label without a
    document, other values of quality and null ids don't count, and repeated labels count each. Null, empty and repeated rows as in rule_statistics().
    """
    statistics = materialise(rule_statistics(documents), "statistics")
    stored = materialise(scores(statistics, fit_forest(statistics, trees, seed)), "scores")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    marks = marks.groupBy("doc_id", "quality").agg(F.count("*").alias("times"))
    rows = stored.where("not base_failed and doc_id is not null").select("doc_id", F.floor(F.col("score") * BINS).cast("int").alias("bin"))
    seen = rows.join(maybe_broadcast(marks, 24), "doc_id").groupBy("bin", "quality").agg(F.sum("times").alias("n"))
    at = limit([tuple(r) for r in seen.collect()], wrong)  # two rows a bin at most
    flagged = F.floor(F.col("score") * BINS) >= at * BINS if np.isfinite(at) else F.lit(False)
    return stored.withColumn("anomalous", flagged).withColumn("kept", ~F.col("base_failed") & ~F.col("anomalous"))


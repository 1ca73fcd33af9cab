"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (shares of byte classes, word lengths, repeated words, pairs and lines) come from vector
operations on a batch's buffers. Trees are grown by histograms of gradients over at most ``BINS`` bins per statistic,
level by level, on a sample of at most ``MAX_SAMPLE`` labelled rows (chosen by a hash of the id, so the same rows
whenever the table is the same). All trees are flattened into arrays of features, thresholds, children and values; a
batch walks all of them at once with array gathers. The model has a fixed size and is broadcast.

Defined cases: a null text is scored as an empty one; rows without label or with a null label aren't learned from;
repeated labels of a document count by their mean; without training rows all scores are 0.5; repeated rows are scored
as they stand; other columns are ignored, and labels, language, source and id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _tokens as tk
from ._work import pick, small_batches

MAX_SAMPLE = 20_000
BINS, TREES, DEPTH, RATE = 64, 80, 4, 0.15
MIN_WEIGHT, RIDGE = 2.0, 1.0
THRESHOLD = 0.7
SLICE_BYTES = 2 << 20

#: Byte classes whose shares are statistics; each string is one class.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r", ".", ",", "!", "?", ";:", "'\"", "()[]{}", "<>", "|", "#", "$", "%", "&", "*", "@", "/\\", "-_", "=+~^`"]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)  # control bytes and the rest
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:0xC0] = len(_CLASSES) + 1
_CLASS[0xC0:] = len(_CLASSES) + 2
_N_CLASSES = len(_CLASSES) + 3
_LINES = np.arange(1, 257, dtype=np.uint16)
_LINES[[0x0A, 0x0D]] = 0
N_STATISTICS = _N_CLASSES + 12


def _distinct_share(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the distinct values over all, and the commonest value's share."""
    n_rows = len(first) - 1
    count = np.diff(first)
    row = np.repeat(np.arange(n_rows), count)
    by = np.lexsort((hashes, row))
    row, value = row[by], hashes[by]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(fresh)
    size = np.diff(np.append(at, len(value)))
    top = np.zeros(n_rows)
    np.maximum.at(top, row[at], size)
    distinct = np.bincount(row[at], minlength=n_rows)
    return distinct / np.maximum(count, 1), top / np.maximum(count, 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``N_STATISTICS`` numbers per text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, N_STATISTICS))
    row = np.repeat(np.arange(n), size)
    out[:, :_N_CLASSES] = np.bincount(row * _N_CLASSES + _CLASS[data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, hashes, first = tk.words(data, offsets, tk.BLANK_WORDS_LOWER)
    words = np.diff(first)
    word_row = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    upper = (data >= 0x41) & (data <= 0x5A)
    letter = upper | ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    ends_letter = letter[ends - 1] if len(ends) else np.empty(0, bool)
    second = upper[np.minimum(starts + 1, len(data) - 1)] & (length > 1) if len(starts) else np.empty(0, bool)
    k = _N_CLASSES
    per = np.maximum(words, 1)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(words)
    out[:, k + 2] = np.bincount(word_row, weights=length, minlength=n) / per
    longest = np.zeros(n)
    np.maximum.at(longest, word_row, length)
    out[:, k + 3] = np.log1p(longest)
    out[:, k + 4] = np.bincount(word_row, weights=ends_letter, minlength=n) / per
    out[:, k + 5] = np.bincount(word_row, weights=second, minlength=n) / per
    out[:, k + 6], out[:, k + 7] = _distinct_share(hashes, first)
    pairs = tk.mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else np.empty(0, np.uint64)
    within = word_row[:-1] == word_row[1:] if len(hashes) > 1 else np.empty(0, bool)
    pair_first = np.concatenate([[0], np.cumsum(np.maximum(words - 1, 0))])
    out[:, k + 8], _ = _distinct_share(pairs[within], pair_first)
    line_starts, line_ends, line_hashes, line_first = tk.words(data, offsets, _LINES)
    lines = np.diff(line_first)
    out[:, k + 9], _ = _distinct_share(line_hashes, line_first)
    out[:, k + 10] = np.log1p(lines)
    out[:, k + 11] = np.log1p(np.bincount(np.repeat(np.arange(n), lines), weights=(line_ends - line_starts).astype(float), minlength=n) / np.maximum(lines, 1))
    return out


@dataclass
class Forest:
    """All trees in one set of arrays; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        if not len(self.roots):
            margin = np.full(len(x), self.base)
        else:
            row = np.arange(len(x))[:, None]
            node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            margin = self.base + self.value[node].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Boost ``trees`` trees on the logistic loss; ``y`` from 0 to 1."""
    none = np.empty(0, np.int64)
    if not len(x):
        return Forest(0.0, none, none, np.empty(0), none, none, np.empty(0), depth)
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(mean / (1 - mean)))
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add() -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    margin = np.full(len(x), base)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, weight = p - y, np.maximum(p * (1 - p), 1e-12)
        roots.append(add())
        node = np.zeros(len(x), dtype=np.int64)  # place among the open nodes
        open_ = [roots[-1]]
        at = np.full(len(x), roots[-1])
        rows = np.arange(len(x))
        for level in range(depth + 1):
            n = len(open_)
            g = np.bincount(node, weights=gradient[rows], minlength=n)
            h = np.bincount(node, weights=weight[rows], minlength=n)
            best = np.zeros(n)
            split: list[tuple[int, int] | None] = [None] * n
            if level < depth:
                for f in range(m):
                    if not len(cuts[f]):
                        continue
                    width = len(cuts[f]) + 1
                    cell = node * width + binned[rows, f]
                    gl = np.cumsum(np.bincount(cell, weights=gradient[rows], minlength=n * width).reshape(n, width), axis=1)[:, :-1]
                    hl = np.cumsum(np.bincount(cell, weights=weight[rows], minlength=n * width).reshape(n, width), axis=1)[:, :-1]
                    gr, hr = g[:, None] - gl, h[:, None] - hl
                    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (g**2 / (h + RIDGE))[:, None]
                    gain[(hl < MIN_WEIGHT) | (hr < MIN_WEIGHT)] = 0
                    top = gain.argmax(axis=1)
                    for k in np.flatnonzero(gain[np.arange(n), top] > best + 1e-9):
                        best[k], split[k] = gain[k, top[k]], (f, int(top[k]))
            following, place = [], np.full((n, 2), -1)
            for k, own in enumerate(open_):
                if split[k] is None:
                    value[own] = -rate * g[k] / (h[k] + RIDGE)
                else:
                    f, cut = split[k]
                    feature[own], threshold[own] = f, float(cuts[f][cut])
                    left[own], right[own] = add(), add()
                    place[k] = len(following), len(following) + 1
                    following += [left[own], right[own]]
            if not following:
                break
            some = np.array([s if s else (0, 0) for s in split])
            side = (binned[rows, some[node, 0]] > some[node, 1]).astype(int)
            going = place[node, side]
            moved = going >= 0
            rows, node = rows[moved], going[moved]
            at[rows] = np.array(following)[node]
            open_ = following
        margin += np.array(value)[at]
    arrays = (np.array(a) for a in (roots, feature, threshold, left, right, value))
    return Forest(base, *arrays, depth)


def _statistics_of(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = tk.text_buffer(batch.column("text"))
    parts = [statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in tk.row_slices(offsets, SLICE_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, N_STATISTICS))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_sample: int = MAX_SAMPLE) -> Forest:
    """Grow trees on a bounded sample of the labelled documents."""
    small_batches(docs.sparkSession)
    known = pick(labels, doc_id=doc_id, y=label).where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    n = known.count()
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 32) - 1))
    if n > max_sample:
        known = known.where(place < int((1 << 32) * 0.97 * max_sample / n)).orderBy(place, "doc_id").limit(max_sample)
    own = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string")).join(F.broadcast(known), "doc_id").withColumn("place", F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _statistics_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("place"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "place", "x"])

    kind = own.schema["doc_id"].dataType.simpleString()
    # of several texts of one id always the same one is learned from
    one = own.mapInArrow(work, f"doc_id {kind}, y double, place long, x array<double>").groupBy("doc_id").agg(F.min(F.struct("place", "y", "x")).alias("one"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").select("one.y", "one.x").collect()
    return grow(np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), N_STATISTICS), np.array([r["y"] for r in rows], dtype=float))


def score(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score."""
    small_batches(docs.sparkSession)
    own = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _statistics_of(batch)
            parts = [sent.value.score(x[k : k + 2048]) for k in range(0, len(x), 2048)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())], names=["doc_id", "score"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(work, f"doc_id {kind}, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from labels that aren't held out, and score all ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    forest = train(docs, pick(labels, doc_id="doc_id", quality="quality").where(~held_out(F.col("doc_id"))))
    return score(docs, forest).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

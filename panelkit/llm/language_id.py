"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are read as code points; letters are lower-cased, and each run of anything else is one border. All n-grams of 1
to ``MAX_GRAM`` characters, with borders, are hashed into ``BUCKETS`` counters. Counting is distributed over all
training rows: each task adds its rows up into one vector per language, and vectors are added per language and bucket.
The matrix of log probabilities (languages x buckets, a fixed size per language, and the number of languages is
checked) is broadcast; a batch is scored by gathering a column of the matrix per gram and adding per document.

The score is the posterior of the best language with the log likelihood per gram tempered to ``TEMPERED_GRAMS`` grams,
so that it says how clear the decision is instead of reaching 1 for every long text.

Defined cases: a null text, an empty one and one without letters (combining marks alone are none) are ``und`` with score
0, also where a whole table is of that kind; rows with a null language, and languages none of whose texts has a letter,
aren't learned; without any training rows everything is ``und`` with score 0; equal scores go to the first language by
code point; a very long text is read in pieces of bounded size and scored as a whole; repeated rows are learned from and
scored as they stand; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _tokens as tk
from ._work import numbered, pick, small_batches

BUCKETS = 1 << 15
MAX_GRAM = 3
SMOOTHING = 0.5
TEMPERED_GRAMS = 60.0
MAX_LANGUAGES = 1000
#: Arrays over a slice take about 200 bytes a byte of text, in each Python worker.
SLICE_BYTES = 1 << 18
#: Below this score a document's language counts as unknown where documents are filtered.
MIN_SCORE = 0.5

_BORDER = 32
_planes: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point of the first plane: its lower-case letter, a mark, or a border; and whether it is a letter."""
    if "mapped" not in _planes:
        mapped = np.full(0x10000, _BORDER, dtype=np.uint32)
        letter = np.zeros(0x10000, dtype=bool)
        for c in range(0x10000):
            x = chr(c)
            kind = unicodedata.category(x)[0]
            if kind == "L":
                low = x.lower()
                mapped[c] = ord(low) if len(low) == 1 else c
                letter[c] = True
            elif kind == "M":  # marks belong to their letter, but are none
                mapped[c] = c
        _planes["mapped"], _planes["letter"] = mapped, letter
    return _planes["mapped"], _planes["letter"]


def _mapped(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points as lower-case letters, marks and borders, and which of them are letters."""
    low, letters = _letters()
    at = np.minimum(points, 0xFFFF)
    high = points >= 0x10000
    mapped, letter = np.where(high, points, low[at]), letters[at] & ~high
    if high.any():
        some, at = np.unique(points[high], return_inverse=True)
        chars = [chr(c) for c in some.tolist()]
        kinds = [unicodedata.category(x)[0] for x in chars]
        mapped[high] = np.array([ord(x.lower()) if k == "L" and len(x.lower()) == 1 else ord(x) if k in "LM" else _BORDER for x, k in zip(chars, kinds, strict=True)], dtype=np.uint32)[at]
        letter[high] = np.array([k == "L" for k in kinds])[at]
    return mapped, letter


def normalised(data: np.ndarray, offsets: np.ndarray, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``points, row, has_letter``: lower-case letters with single borders around them, and the row of each.

    ``inside``: what stands before the first byte is a letter or mark of the first row, so a border there counts.
    """
    if sys.byteorder != "little":
        raise RuntimeError("little-endian machines only")
    n_rows = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    # first code point of each row: code points are counted at their lead bytes
    lead = np.zeros(len(data) + 1, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    first = lead[offsets].astype(np.int64)
    mapped, letter = _mapped(points)
    solid = mapped != _BORDER
    row = np.repeat(np.arange(n_rows), np.diff(first))
    upto = np.zeros(len(letter) + 1, dtype=np.int64)
    np.cumsum(letter, out=upto[1:])
    has = upto[first[1:]] > upto[first[:-1]]
    # a border where a row ends too: of each run of borders only the first stays
    keep = solid.copy()
    begins = np.zeros(len(solid), dtype=bool)
    begins[first[:-1][first[:-1] < len(solid)]] = True
    keep[1:] |= solid[:-1] & ~begins[1:]
    if inside and len(keep):
        keep[0] = True
    return mapped[keep], row[keep], has


def grams(points: np.ndarray, row: np.ndarray, buckets: int = BUCKETS, most: int = MAX_GRAM, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each n-gram; a row's text is led by a border, and no gram reaches into another row.

    ``known``: so many points at the beginning were there before; only grams that end behind them count.
    """
    parts, rows = [], []
    wide = points.astype(np.uint64)
    previous = np.full(len(points), _BORDER, dtype=np.uint64)
    previous[1:] = np.where(row[1:] != row[:-1], _BORDER, wide[:-1])
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    code = wide
    for size in range(1, min(most, len(points) + 1) + 1):
        # the gram that ends at each point from ``size - 2`` on; the border before a row's first letter takes part
        end = max(0, size - 2)
        if size == 2:
            code = (previous << np.uint64(21)) | wide
        elif size > 2:
            code = (code[:-1] << np.uint64(21)) | wide[end:]
        ok = np.arange(end, len(points)) >= known
        ok &= points != _BORDER if size == 1 else row[end:] == row[: len(row) - end]
        hashed = (code * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(size * 0x51ED270B)) * np.uint64(0xD6E8FEB86659FD93)
        parts.append((hashed >> shift).astype(np.int32)[ok])
        rows.append(row[end:][ok])
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(parts), np.concatenate(rows)


def _sliced(batch: pa.RecordBatch, body: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``lo, hi, bucket, row, has_letter`` of runs of rows: their grams' buckets, and the row of each.

    A text above ``SLICE_BYTES`` comes as several runs of that one row, cut between code points; the last two points
    of a run lead the next one, so its grams are those of the whole text.
    """
    data, offsets = tk.text_buffer(batch.column(body))
    for lo, hi in tk.row_slices(offsets, SLICE_BYTES):
        begin, end = int(offsets[lo]), int(offsets[hi])
        before, solid = np.empty(0, np.uint32), False
        while True:
            stop = min(end, begin + SLICE_BYTES) if hi - lo == 1 else end
            while stop < end and (data[stop] & 0xC0) == 0x80:
                stop += 1
            inner = offsets[lo : hi + 1] - begin if hi - lo > 1 else np.array([0, stop - begin])
            points, row, has = normalised(data[begin:stop], inner, solid)
            if len(before):
                points, row = np.concatenate([before, points]), np.concatenate([np.zeros(len(before), np.int64), row])
            yield lo, hi, *grams(points, row, known=len(before)), has
            if stop >= end:
                break
            before, solid, begin = points[-2:].copy(), len(points) > 0 and points[-1] != _BORDER, stop


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def sums(self, bucket: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood per row and language, and the number of grams per row."""
        if not len(bucket):
            return np.zeros((n_rows, len(self.languages))), np.zeros(n_rows, dtype=np.int64)
        total = np.stack([np.bincount(row, weights=own[bucket], minlength=n_rows) for own in self.log_prob], axis=1)
        return total, np.bincount(row, minlength=n_rows)

    def decide(self, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language (index) and its tempered posterior, per row of ``sums``."""
        total = total + self.log_prior
        best = np.argmax(total, axis=1)
        tempered = total * np.minimum(1.0, TEMPERED_GRAMS / np.maximum(n, 1))[:, None]
        tempered -= tempered.max(axis=1, keepdims=True)
        weight = np.exp(tempered)
        return best, weight[np.arange(len(total)), best] / weight.sum(axis=1)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count all labelled rows and take logarithms."""
    small_batches(labelled.sparkSession)
    rows = pick(labelled, lang=lang, text=text).where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            own, code = names.dictionary.to_pylist(), names.indices.to_numpy()
            lettered = np.zeros(batch.num_rows, dtype=bool)
            for lo, hi, bucket, at, has in _sliced(batch):
                lettered[lo:hi] |= has
                which = code[lo:hi][at]
                for k in np.unique(which).tolist():
                    more = np.bincount(bucket[which == k], minlength=BUCKETS)
                    sums[own[k]] = sums[own[k]] + more if own[k] in sums else more
            for k, n in enumerate(np.bincount(code[lettered], minlength=len(own)).tolist()):
                docs[own[k]] = docs.get(own[k], 0) + n
        for name in [x for x, n in docs.items() if n]:  # a language all of whose texts are without letters isn't learned
            vector = sums[name]
            some = np.flatnonzero(vector)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(some) + 1)), pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(vector[some], docs[name]), pa.int64())], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row per language, of a fixed size
    packed = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("all"))
    languages = packed.limit(MAX_LANGUAGES + 1).collect()
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((len(languages), BUCKETS))
    docs = np.zeros(len(languages))
    languages.sort(key=lambda r: r["lang"])
    for k, r in enumerate(languages):
        for bucket, n in r["all"]:
            if bucket < 0:
                docs[k] = n
            else:
                table[k, bucket] = n
    log_prob = np.log(table + SMOOTHING) - np.log(table.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return Model([r["lang"] for r in languages], np.log(np.maximum(docs, 1) / max(docs.sum(), 1)), log_prob)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    own = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = own.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, score = _predicted(sent.value, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return own.mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")


def _predicted(model: Model, batch: pa.RecordBatch, body: str = "text") -> tuple[np.ndarray, np.ndarray]:
    names = np.array(["und", *model.languages], dtype=object)
    n_rows = batch.num_rows
    pred, score = np.zeros(n_rows, dtype=np.int64), np.zeros(n_rows)
    if model.languages and n_rows:
        total, n, lettered = np.zeros((n_rows, len(model.languages))), np.zeros(n_rows, dtype=np.int64), np.zeros(n_rows, dtype=bool)
        for lo, hi, bucket, row, has in _sliced(batch, body):
            more, m = model.sums(bucket, row, hi - lo)
            total[lo:hi] += more
            n[lo:hi] += m
            lettered[lo:hi] |= has
        best, own = model.decide(total, n)
        pred, score = np.where(lettered, best + 1, 0), np.where(lettered, own, 0.0)
    return names[pred], score


def keep_known(docs: DataFrame, model: Model, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known."""
    own, body = numbered(docs, text)
    width = len(docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, score = _predicted(sent.value, batch, body)
            yield batch.filter(pa.array((name != "und") & (score >= min_score))).select(range(width))

    kept = own.mapInArrow(work, own.select(own.columns[:width]).schema)
    return kept.toDF(*docs.columns)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that may be learned from: doc_id, text, lang."""
    return pick(docs, doc_id=doc_id, text=text, lang=lang).where(~held_out(F.col("doc_id")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the rows that aren't held out, and predict all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(training_rows(docs))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

"""Benchmark decontamination by an FM-index per training shard.

The test phrases are windows of ``WINDOW`` consecutive words of a benchmark item; a shorter item is one window. Their
words are the alphabet. A training shard is a run of documents of one partition, bounded in words; its text is written
in that alphabet, other words and document borders are one separator, and stretches too short for any phrase are left
out, as no phrase can lie there. All phrases are searched backwards at once through wavelet-matrix ranks, occurrences
are located by sampled suffix positions, and the spans they cover are merged into removal spans.

Documents never leave their partition: no shuffle, whatever the number of copies or the frequency of a passage. The
phrases are sent to the executors in blocks of a fixed size; each shard is searched for one block after the other.

Words are hashed to 64 bits, and a benchmark word must agree in length too.

Defined cases: null or empty texts have no words, no hits and no items; a null item id counts as the item ``""``;
repeated rows each give their own result row; repeated item ids are one item; empty tables work on either side; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _tokens as tk
from ._work import numbered, pick, small_batches
from .fm_index import FMIndex

WINDOW = 10
#: Words of a training shard, and bytes of text that are tokenized at once.
SHARD_WORDS, SLICE_BYTES = 400_000, 2 << 20
#: Benchmark bytes of one block, the most that is broadcast at once.
BLOCK_BYTES = 1 << 20
#: Suffix rows that are located at once.
ROWS_AT_ONCE = 1 << 19


@dataclass
class Phrases:
    """Test phrases: ``by_length[L] = (patterns, first, items)`` with items of pattern i in ``items[first[i]:first[i + 1]]``."""

    ids: list[str]
    vocabulary: np.ndarray
    lengths: np.ndarray
    bits: int
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @property
    def shortest(self) -> int:
        return min(self.by_length, default=1)

    def symbols(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """2 and up: a word of the benchmark; 1: any other."""
        if not len(self.vocabulary):
            return np.ones(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where((self.vocabulary[at] == hashes) & (self.lengths[at] == sizes), at + 2, 1)


def phrases_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    """Phrases of (item id, text) rows."""
    texts = pa.array([t for _, t in items], pa.string())
    data, offsets = tk.text_buffer(texts)
    starts, ends, hashes, first = tk.words(data, offsets, tk.LETTER_WORDS_LOWER)
    vocabulary, at = np.unique(hashes, return_index=True)
    symbol = np.searchsorted(vocabulary, hashes) + 2
    ids = sorted({"" if i is None else str(i) for i, _ in items})
    number = {x: k for k, x in enumerate(ids)}
    found: dict[int, dict[tuple, set]] = {}
    for k, (item, _) in enumerate(items):
        own = symbol[first[k] : first[k + 1]].tolist()
        size = min(window, len(own))
        for j in range(len(own) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(own[j : j + size]), set()).add(number["" if item is None else str(item)])
    by_length = {}
    for size, windows in found.items():
        counts = [0, *(len(x) for x in windows.values())]
        by_length[size] = (np.array(list(windows), dtype=np.int32), np.cumsum(counts), np.array([i for x in windows.values() for i in sorted(x)], dtype=np.int64))
    return Phrases(ids, vocabulary, (ends - starts)[at] if len(at) else np.empty(0, np.int64), max(2, int(len(vocabulary) + 1).bit_length()), by_length)


def _reduced(symbol: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard in the phrases' alphabet without stretches below the shortest phrase, and the word of each place."""
    n = len(symbol)
    inside = symbol > 1
    opens, closes = inside.copy(), inside.copy()
    border = np.zeros(n + 1, dtype=bool)
    border[first] = True
    opens[1:] &= ~inside[:-1] | border[1:n]
    closes[:-1] &= ~inside[1:] | border[1:n]
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long_enough = hi - lo >= shortest
    lo, hi = lo[long_enough], hi[long_enough]
    if not len(lo):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # each stretch and the separator behind it
    size = hi - lo + 1
    begin = np.cumsum(size) - size
    word = np.arange(int(size.sum())) - np.repeat(begin - lo, size)
    text = np.ones(len(word), dtype=np.int64)
    behind = np.zeros(len(word), dtype=bool)
    behind[begin + size - 1] = True
    text[~behind] = symbol[word[~behind]]
    return text, word


def hits_of_shard(symbol: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``covered`` (a flag per word) and (document, item) pairs of the occurrences in one shard."""
    delta = np.zeros(len(symbol) + 1, dtype=np.int64)
    pairs = [np.empty(0, np.int64)]
    text, word = _reduced(symbol, first, phrases.shortest)
    if len(text):
        index = FMIndex(text, phrases.bits)
        for size, (patterns, at, items) in phrases.by_length.items():
            low, high = index.search(patterns)
            count = high - low
            hit = np.flatnonzero(count)
            upto = np.cumsum(count[hit])
            lo = 0
            while lo < len(hit):
                base = upto[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(upto, base + ROWS_AT_ONCE, side="right")))
                some = hit[lo:hi]
                n = count[some]
                pattern = np.repeat(some, n)
                rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
                start = word[index.locate(rows)]
                np.add.at(delta, start, 1)
                np.add.at(delta, start + size, -1)
                doc = np.searchsorted(first, start, side="right") - 1
                # every item of the pattern, once per document
                seen = np.unique(doc * len(at) + pattern)
                doc, pattern = np.divmod(seen, len(at))
                m = at[pattern + 1] - at[pattern]
                which = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(at[pattern], m)
                pairs.append(np.unique(np.repeat(doc, m) * len(phrases.ids) + items[which]))
                lo = hi
    pair = np.unique(np.concatenate(pairs))
    doc, item = np.divmod(pair, max(1, len(phrases.ids)))
    return np.cumsum(delta[:-1]) > 0, doc, item


def _spans(covered: np.ndarray, first: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    """Merged removal spans of each document, in its own word numbers, end exclusive."""
    n = len(covered)
    opens, closes = covered.copy(), covered.copy()
    border = np.zeros(n + 1, dtype=bool)
    border[first] = True
    if n:
        opens[1:] &= ~covered[:-1] | border[1:n]
        closes[:-1] &= ~covered[1:] | border[1:n]
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    at = np.searchsorted(lo, first)
    for k in range(len(first) - 1):
        yield [] if at[k] == at[k + 1] else [(int(a - first[k]), int(b - first[k])) for a, b in zip(lo[at[k] : at[k + 1]], hi[at[k] : at[k + 1]], strict=True)]


def shards(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their words' hashes and sizes and each row's first word, of ``SHARD_WORDS`` words or a row more."""
    waiting: list[tuple] = []
    held = 0
    for batch in batches:
        data, offsets = tk.text_buffer(batch.column(column))
        for lo, hi in tk.row_slices(offsets, SLICE_BYTES):
            piece = data[offsets[lo] : offsets[hi]]
            starts, ends, hashes, first = tk.words(piece, offsets[lo : hi + 1] - offsets[lo], tk.LETTER_WORDS_LOWER)
            waiting.append((batch.slice(lo, hi - lo), hashes, (ends - starts).astype(np.int32), first))
            held += len(hashes)
            if held >= SHARD_WORDS:
                yield _together(waiting)
                waiting, held = [], 0
    if waiting:
        yield _together(waiting)


def _together(waiting: list[tuple]) -> tuple:
    batch = pa.Table.from_batches([x[0] for x in waiting]).combine_chunks().to_batches()
    batch = batch[0] if batch else waiting[0][0]
    shift = np.cumsum([0, *(len(x[1]) for x in waiting)])
    first = np.concatenate([*(x[3][:-1] + s for x, s in zip(waiting, shift[:-1], strict=True)), shift[-1:]])
    return batch, np.concatenate([x[1] for x in waiting]), np.concatenate([x[2] for x in waiting]), first


_RESULT = "doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<begin: long, end: long>>"


def _blocks(spark: SparkSession, benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of bounded size."""
    rows = pick(benchmark, i=item_id, t=text).select(F.col("i").cast("string").alias("i"), F.col("t").cast("string").alias("t"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 40)).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans: per document the items found and the merged spans to remove, in words."""
    spark = docs.sparkSession
    small_batches(spark)
    own = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = _RESULT.format(kind=kind)

    blocks = [spark.sparkContext.broadcast(phrases_of(rows, window)) for rows in _blocks(spark, benchmark, item_id, item_text)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hashes, sizes, first in shards(batches):
            covered = np.zeros(len(hashes), dtype=bool)
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for sent in blocks:
                phrases = sent.value
                hit, doc, item = hits_of_shard(phrases.symbols(hashes, sizes), first, phrases)
                covered |= hit
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    items[d].add(phrases.ids[i])
                if len(blocks) > 1:  # one block in memory at a time
                    del phrases, sent._value
            upto = np.concatenate([[0], np.cumsum(covered)])
            spans = [[{"begin": a, "end": b} for a, b in x] for x in _spans(covered, first)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(upto[first[1:]] - upto[first[:-1]]), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return own.mapInArrow(work, _RESULT.format(kind=kind))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no phrase occurs."""
    spark = docs.sparkSession
    own, body = numbered(docs, text)
    width = len(docs.columns)
    blocks = [spark.sparkContext.broadcast(phrases_of(rows, window)) for rows in _blocks(spark, benchmark, item_id, item_text)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hashes, sizes, first in shards(batches, body):
            clean = np.ones(batch.num_rows, dtype=bool)
            for sent in blocks:
                phrases = sent.value
                clean[hits_of_shard(phrases.symbols(hashes, sizes), first, phrases)[1]] = False
                if len(blocks) > 1:
                    del phrases, sent._value
            yield batch.filter(pa.array(clean)).select(range(width))

    kept = own.mapInArrow(work, own.select(own.columns[:width]).schema)
    return kept.toDF(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search all of ``benchmark`` in all ``documents``."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws,
         row_number() OVER () AS rid
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, len(g) AS size, array_to_string(g, ' ') AS g
  FROM (SELECT item, ws[i:i + least(10, len(ws)) - 1] AS g
        FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0))
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, size, i, array_to_string(ws[i:i + size - 1], ' ') AS g
  FROM (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size)
), hit AS (
  SELECT rid, dw.size, i, item FROM dw JOIN bw ON dw.size = bw.size AND dw.g = bw.g
), pos AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, size, i FROM hit)) GROUP BY rid
), it AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""

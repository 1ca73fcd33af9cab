"""Substring dedup by seed and extend: repeated runs of ``WINDOW`` words and more are removed.

Seeds. Of every ``WINDOW - ANCHOR + 1`` consecutive runs of ``ANCHOR`` words the one with the least hash is an anchor
(winnowing; the last of equals). Which anchor a window of ``WINDOW`` words chooses depends on its words alone, so equal
windows choose equal anchors, and a window can only repeat if its anchor does. Documents are joined on anchors: one
shuffle by anchor hash tells which repeat.

Extension. Around a repeated anchor, each way to extend it left and right to ``WINDOW`` words gives one window that
chose this anchor. Equal extensions meet in a second shuffle by the hash of the extended window, and each learns of one
other occurrence: one of its own shard if there is any, else the first one by key and place. Windows next to each other
whose other occurrences are next to each other too are one match, which so grows left and right word by word as long as
the two texts agree: ``repeats`` has these maximal repeats, with their exact length and where they also stand. So all
occurrences of a seed are extended without ever pairing them: the work is linear in the number of occurrences, also for
a passage that a third of all documents share. Every repeated window is in a match; the matches' union is removed.
A match ends where the texts differ, or, of windows with three occurrences and more, where another one takes over.

Before either shuffle, what repeats within a task's own shard is settled there: matches inside a shard leave it as one
row each, one row per shard stands for a hot anchor or window, and of rows with equal id and text one speaks for all. A
group of the window function behind the shuffle so holds a few dozen bytes for each shard that has the value, never
texts or documents; it spills beyond its memory.

Texts of documents without a repeated anchor never move: a bitmap of a fixed size over document keys, broadcast, sorts
them out; where the corpus outgrows it, more texts move, and the result is the same. Words, anchors and windows are
compared by 64-bit hashes.

Defined cases: a null or empty text has no words; a text below ``WINDOW`` words loses none; all occurrences are removed,
also the first, also within one document and in repeated rows; ties of an anchor go to its last place; very long texts
are one shard of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _tokens as tk
from ._bitmap import marked
from ._work import keep, pick, small_batches

WINDOW, ANCHOR = 35, 16
#: Words of a shard, within which repeats are settled before a shuffle, and bytes tokenized at once.
SHARD_WORDS, SLICE_BYTES = 400_000, 2 << 20
#: Rows of one pass of the sliding minimum.
_STEP = 1 << 16


def chosen_anchors(grams: np.ndarray, spread: int) -> np.ndarray:
    """For each run of ``spread`` grams the index of its least, the last of equals."""
    n = len(grams) - spread + 1
    out = np.empty(max(n, 0), dtype=np.int64)
    for lo in range(0, n, _STEP):
        hi = min(n, lo + _STEP)
        view = np.lib.stride_tricks.sliding_window_view(grams[lo : hi + spread - 1], spread)
        out[lo:hi] = np.arange(lo, hi) + spread - 1 - view[:, ::-1].argmin(axis=1)
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows without their text, their words' hashes, and each row's first word."""
    waiting: list[tuple] = []
    held = 0

    def together() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        shift = np.cumsum([0, *(len(x[1]) for x in waiting)])
        first = np.concatenate([*(x[2][:-1] + s for x, s in zip(waiting, shift[:-1], strict=True)), shift[-1:]])
        return pa.Table.from_batches([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting]), first

    for batch in batches:
        data, offsets = tk.text_buffer(batch.column("text"))
        rest = batch.drop_columns(["text"])
        for lo, hi in tk.row_slices(offsets, SLICE_BYTES):
            _, _, hashes, first = tk.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], tk.BLANK_WORDS)
            waiting.append((rest.slice(lo, hi - lo), hashes, first))
            held += len(hashes)
            if held >= SHARD_WORDS:
                yield together()
                waiting, held = [], 0
    if waiting:
        yield together()


def _window_starts(n_words: int, first: np.ndarray, window: int) -> np.ndarray:
    """Word indices at which a window fits into its document."""
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n_words)
    return np.flatnonzero(room >= window)


def _settled(values: np.ndarray, key: np.ndarray, place: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    """What a shard sends: rows that are unique in it (``n`` 1, no other), a row for each value that isn't (``n`` 0), and
    matches within it: ``n`` places one after the other from ``place``, which are also at ``other_place`` of ``other``.

    Rows by key and place, in order; those that aren't ``fresh`` repeat a row of the same key.
    """
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    begin = np.cumsum(counts) - counts
    one = order[begin]
    many = np.flatnonzero(counts > 1)
    other = one[inverse]
    other[one[many]] = order[begin[many] + 1]
    some = np.flatnonzero((counts[inverse] > 1) & fresh)
    k, at, other_k, other_at = key[some], place[some], key[other[some]], place[other[some]]
    opens = np.ones(len(some), dtype=bool)
    opens[1:] = (some[1:] != some[:-1] + 1) | (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1) | (other_k[1:] != other_k[:-1]) | (other_at[1:] != other_at[:-1] + 1)
    head = np.flatnonzero(opens)
    run = np.diff(np.append(head, len(some)))
    alone, spoken = np.flatnonzero(counts[inverse] == 1), one[many]
    none = len(alone) + len(spoken)
    route = np.concatenate([values[alone], values[spoken], tk.mix(k[head].astype(np.uint64) ^ tk.mix(at[head].astype(np.uint64)))])
    pad = np.zeros(none, dtype=np.int64)
    mask = np.arange(none + len(head)) < none
    return pa.RecordBatch.from_arrays(
        [
            pa.array(route.view(np.int64)),
            pa.array(np.concatenate([key[alone], key[spoken], k[head]])),
            pa.array(np.concatenate([place[alone], place[spoken], at[head]]).astype(np.int32)),
            pa.array(np.concatenate([np.ones(len(alone)), np.zeros(len(spoken)), run]).astype(np.int32)),
            pa.array(np.concatenate([pad, other_k[head]]), mask=mask),
            pa.array(np.concatenate([pad, other_at[head]]).astype(np.int32), mask=mask),
        ],
        names=["route", "k", "place", "n", "other", "other_place"],
    )


_ROUTED = "route long, k long, place int, n int, other long, other_place int"
_FOUND = "array<struct<place: int, n: int, other: bigint, other_place: int>>"


def _repeated(routed: DataFrame) -> DataFrame:
    """k, place, n, other, other_place of all rows whose value was sent at least twice, and of all matches of a shard."""
    order = Window.partitionBy("route").orderBy("k", "place", F.desc("n"))
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("k", "place")
    met = routed.withColumns({"sent": F.count(F.lit(1)).over(all_), "low": F.first(here).over(all_), "high": F.last(here).over(all_), "before": F.lag(here).over(order)})
    partner = F.when(F.col("low") != here, F.col("low")).otherwise(F.col("high"))
    # rows with equal id and text send equal rows from several shards
    return met.where((F.col("n") > 0) & ~F.col("before").eqNullSafe(here) & (F.col("other").isNotNull() | (F.col("sent") > 1))).select(
        "k", "place", "n", F.coalesce("other", partner["k"]).alias("other"), F.coalesce("other_place", partner["place"]).alias("other_place")
    )


def _lists(found: pa.ListArray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first word in the shard, and the columns of all entries of a column of ``_FOUND``."""
    row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    place, n, other, other_place = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found.flatten().flatten())
    return row, place + first[row], place, n, other, other_place


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per input row: doc_id, key (of id and text), n_words, n_removed, kept_sha256, spans (removed words, merged),
    repeats (maximal repeats, each with the key of another document or the same one, and where it stands there), kept (the
    text that is left). Ends are exclusive.
    """
    small_batches(docs.sparkSession)
    own = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string")).withColumn("k", F.xxhash64("doc_id", "text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    spread = window - anchor + 1

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, first in _shards(batches):
            starts = _window_starts(len(hashes), first, window)
            if not len(starts):
                continue
            grams = tk.gram_hashes(hashes, anchor)
            at = np.unique(chosen_anchors(grams, spread)[starts])
            doc = np.searchsorted(first, at, side="right") - 1
            key = rows.column("k").combine_chunks().to_numpy()
            yield _settled(grams[at], key[doc], at - first[doc], _fresh(key)[doc])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, first in _shards(batches):
            key = rows.column("k").combine_chunks().to_numpy()
            _, begin, _, n, _, _ = _lists(rows.column("found").combine_chunks(), first)
            seeded = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(seeded, begin, 1)
            np.add.at(seeded, begin + n, -1)
            starts = _window_starts(len(hashes), first, window)
            if not len(starts):
                continue
            grams = tk.gram_hashes(hashes, anchor)
            starts = starts[np.cumsum(seeded)[chosen_anchors(grams, spread)[starts]] > 0]
            doc = np.searchsorted(first, starts, side="right") - 1
            yield _settled(tk.gram_hashes(hashes, window)[starts], key[doc], starts - first[doc], _fresh(key)[doc])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column("text"))
            found = batch.column("found")
            for lo, hi in tk.row_slices(offsets, SLICE_BYTES):
                yield _cut(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], batch.select(["doc_id", "k"]).slice(lo, hi - lo), found.slice(lo, hi - lo), window)

    def by_key(found: DataFrame) -> DataFrame:
        return found.groupBy("k").agg(F.collect_list(F.struct("place", "n", "other", "other_place")).alias("found"))

    none = F.array().cast(_FOUND)
    seeded = keep(by_key(_repeated(own.select("k", "text").mapInArrow(seeds, _ROUTED)).withColumns({"other": F.lit(0).cast("long"), "other_place": F.lit(0)})), "substring-seeds")
    both = marked(own, F.col("k"), seeded, "k", "seeded")
    moved = both.where("seeded").select("doc_id", "text", "k")
    matches = by_key(_repeated(moved.join(seeded, "k").select("k", "text", "found").mapInArrow(extend, _ROUTED)))
    schema = f"doc_id {kind}, key long, n_words long, n_removed long, kept_sha256 string, spans array<struct<begin: long, end: long>>, repeats array<struct<begin: long, end: long, other: long, other_begin: long>>, kept string"
    whole = both.where("NOT seeded").select("doc_id", "text", "k", none.alias("found"))
    partly = moved.join(matches, "k", "left").select("doc_id", "text", "k", F.coalesce("found", none).alias("found"))
    return whole.mapInArrow(cut, schema).unionByName(partly.mapInArrow(cut, schema))


def _fresh(key: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its key."""
    out = np.zeros(len(key), dtype=bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


def _matches(rows: int, row: np.ndarray, place: np.ndarray, n: np.ndarray, other: np.ndarray, other_place: np.ndarray, window: int) -> pa.ListArray:
    """Windows next to each other on both sides, put together: begin, end, other, other_begin, by row."""
    order = np.lexsort((place, other_place - place, other, row))
    row, place, n, other, shift = row[order], place[order], n[order], other[order], (other_place - place)[order]
    opens = np.ones(len(row), dtype=bool)
    opens[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] > (place + n)[:-1])
    head = np.flatnonzero(opens)
    end = np.maximum.reduceat(place + n, head) if len(head) else place
    begin, row, other, shift = place[head], row[head], other[head], shift[head]
    order = np.lexsort((other, begin, row))
    fields = [begin[order], end[order] - 1 + window, other[order], (begin + shift)[order]]
    structs = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["begin", "end", "other", "other_begin"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(rows + 1)).astype(np.int32)), structs)


def _cut(data: np.ndarray, offsets: np.ndarray, ids: pa.RecordBatch, found: pa.Array, window: int) -> pa.RecordBatch:
    """Results of some rows: words covered by their windows go, the others are joined by one space."""
    starts, ends, _, first = tk.words(data, offsets, tk.BLANK_WORDS)
    n = len(starts)
    delta = np.zeros(n + 1, dtype=np.int64)
    row, begin, place, m, other, other_place = _lists(found, first)
    np.add.at(delta, begin, 1)
    np.add.at(delta, begin + m - 1 + window, -1)
    gone = np.cumsum(delta[:-1]) > 0
    upto = np.concatenate([[0], np.cumsum(gone)])
    removed = upto[first[1:]] - upto[first[:-1]]
    # kept words and one blank behind each, in one buffer
    kept_starts, kept_ends = starts[~gone], ends[~gone]
    size = kept_ends - kept_starts + 1
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[stop - 1] = False
    mark = np.zeros(len(data) + 1, dtype=np.int8)
    mark[kept_starts] += 1
    np.subtract.at(mark, kept_ends, 1)
    out[inside] = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    kept_first = first - upto[first]
    texts, hashes, spans = [], [], []
    whole = out.tobytes()
    edge = np.concatenate([[0], stop])
    for k in range(ids.num_rows):
        a, b = int(edge[kept_first[k]]), int(edge[kept_first[k + 1]])
        body = whole[a : b - 1] if b > a else b""
        texts.append(body)
        hashes.append(hashlib.sha256(body).hexdigest())
        spans.append(_merged(gone[first[k] : first[k + 1]]) if removed[k] else [])
    return pa.RecordBatch.from_arrays(
        [*ids.columns, pa.array(np.diff(first)), pa.array(removed), pa.array(hashes), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), _matches(ids.num_rows, row, place, m, other, other_place, window), pa.array(texts, pa.binary()).cast(pa.string())],
        names=["doc_id", "key", "n_words", "n_removed", "kept_sha256", "spans", "repeats", "kept"],
    )


def _merged(gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [{"begin": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated windows from all ``documents``."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM r
), kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body
  FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (rid, p)
  GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds its distinct shingles of ``SHINGLE`` words, hashed to 64 bits. Documents with equal sets form a
class; from there on one set stands for its class. A sketch keeps the ``K`` least hash values of a set.

Candidates come from inverted lists of retained values. Sets with Jaccard similarity 0.75 share at least 2/3 of a
sketch that is complete (at most ``K`` shingles; certain), or ``MIN_SHARED`` of ``K`` values of a cut one (all but about
one pair in a million that lies just at the threshold, fewer above it). With the values of a sketch in the order of how
many sets retain them, rarest first, such a pair shares one of the first ``k - shared + 1`` values: lists of values that
very many documents retain (a common line or passage) are only entered by documents that consist of such values.

Lists aren't paired up. First each set meets one leader: of the sets that lead its lists (those whose values are retained
most often, so the middle of a family of copies) the one that it meets most often. Union-sketch estimates drop pairs, and the full sets confirm the rest:
``100 * intersection >= 75 * union``. The links found give components.
Sets of one list that are still in different components are settled without sketches, as these can't tell the edge of a
family from its middle: their full sets are joined on the rarest shingles (``linked_across``), and confirmed likewise.

Sets are told apart by 128-bit digests of all their shingles: 64 bits are the id, and a class whose rows differ in the
other 64 makes all ids be drawn again, so no two different sets are ever one class.

Defined cases: a text of fewer words than a shingle is one shingle; null, empty and blank texts have no shingles, are
linked with nothing and kept; repeated rows are copies of each other; ties of leaders go to the greater id; very long texts are one set
of any size; a null id never names a component unless all its
documents have null ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _tokens as tk
from ._bitmap import marked
from ._components import components
from ._work import forget, keep, packed, pick, position, small_batches

SHINGLE, K, MIN_SHARED = 5, 64, 30
#: Similarity in hundredths, and how far below it an estimate may lie.
SIMILARITY, SLACK = 75, 25
#: Width of a band of set sizes, as a ratio, and members of one component and band that count as a crowd.
BAND, CROWD = 1.03, 16
#: Shingles of a set up to which its rows carry the shingles before them; larger sets may meet more than once.
CARRIED = 600
SLICE_BYTES = 2 << 20
#: Should two different sets share a 64-bit id, which the other half of their digest shows, all ids are made anew.
SALTS = 4


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    _, _, hashes, first = tk.words(data, offsets, tk.BLANK_WORDS_LOWER)
    grams = tk.gram_hashes(hashes, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            fresh = np.ones(len(own), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]
        elif b > a:
            # a whole sequence that is shorter than a shingle; its length takes part
            yield tk.mix(tk.gram_hashes(hashes[a:b], b - a) + np.uint64(0x1D8E4E27C47D124F * (b - a) & 0xFFFFFFFFFFFFFFFF))
        else:
            yield np.empty(0, np.uint64)


def set_id(own: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """The two halves of a 128-bit digest of a sorted set: its id, and what tells sets apart that share an id."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = tk.text_buffer(batch.column("text"))
    for lo, hi in tk.row_slices(offsets, SLICE_BYTES):
        yield from sets_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def sketches(own: DataFrame, salt: int = 0) -> DataFrame:
    """doc_id, text_key, set_id, check, n, sketch (as signed numbers, in the order of the unsigned). own: doc_id, text, text_key."""
    kind = own.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, low = [], [], []
            for x in _sets(batch):
                ids.append(set_id(x, salt) if len(x) else (None, None))
                n.append(len(x))
                low.append(x[:K].view(np.int64).copy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([i for i, _ in ids], pa.int64()), pa.array([c for _, c in ids], pa.int64()), pa.array(n, pa.int64()), _lists(low)], names=["doc_id", "text_key", "set_id", "check", "n", "sketch"])

    return own.mapInArrow(work, f"doc_id {kind}, text_key long, set_id long, check long, n long, sketch array<long>")


def _key() -> Column:
    """What a row's text is found by, never null: its id, or where that is null its text."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.col("text_key"))


def _met(a: pa.ListArray, b: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, value, twice`` of the distinct values of both sides, in order by row and value; twice: on both sides.

    One sort for all rows; each side has a value once in a row.
    """
    rows = [np.repeat(np.arange(len(x)), x.value_lengths().to_numpy(zero_copy_only=False)) for x in (a, b)]
    row = np.concatenate(rows)
    value = np.concatenate([x.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    again = np.zeros(len(row), dtype=bool)
    again[1:] = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    twice = np.append(again[1:], False)[~again]
    return row[~again], value[~again], twice


def _last(x: pa.ListArray) -> np.ndarray:
    """The last (greatest) value of each row, none of which is empty."""
    return x.flatten().to_numpy(zero_copy_only=False).view(np.uint64)[np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)) - 1]


def estimates(a: pa.ListArray, b: pa.ListArray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each row's two sets by the union sketch; exact if both sketches are complete."""
    if not len(a):
        return np.empty(0)
    row, value, twice = _met(a, b)
    cut = (n_a > K) | (n_b > K)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    # beyond its last value a cut sketch knows nothing, and of the union the first K values count
    limit = np.minimum(np.where(n_a > K, _last(a), most), np.where(n_b > K, _last(b), most))
    first = np.searchsorted(row, np.arange(len(a)))
    ok = ~cut[row] | ((np.arange(len(row)) - first[row] < K) & (value <= limit[row]))
    union = np.bincount(row[ok], minlength=len(a))
    return np.bincount(row[ok & twice], minlength=len(a)) / np.maximum(union, 1)


def _likely(pairs: DataFrame, classes: DataFrame, tag: str) -> DataFrame:
    """a, b, key_a, key_b of the pairs whose union sketch allows for enough similarity."""
    side = lambda x: classes.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("key").alias(f"key_{x}"))

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            least = SIMILARITY - np.where(np.maximum(n_a, n_b) > K, SLACK, 0) - 1e-9
            likely = 100 * estimates(batch.column("sketch_a"), batch.column("sketch_b"), n_a, n_b) >= least
            yield batch.select(["a", "b", "key_a", "key_b"]).filter(pa.array(likely, pa.bool_()))

    return keep(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(estimated, "a long, b long, key_a long, key_b long"), f"{tag}-likely")


def _similar(pairs: DataFrame, classes: DataFrame, own: DataFrame, salt: int, tag: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    likely = _likely(pairs, classes, tag)
    needed = likely.select(F.explode(F.array(F.struct(F.col("a").alias("set_id"), F.col("key_a").alias("key")), F.struct(F.col("b").alias("set_id"), F.col("key_b").alias("key")))).alias("x")).select("x.*").distinct()
    sets = full_sets(needed, own, salt, tag)
    links = _confirmed(likely.select("a", "b"), sets, tag)
    for x in (likely, sets):
        forget(x)
    return links


def full_sets(needed: DataFrame, own: DataFrame, salt: int, tag: str) -> DataFrame:
    """set_id, shingles of the classes in ``needed`` (set_id, key), from the texts of their documents.

    Texts of documents that stand for none of them don't move.
    """

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column("text"))
            for lo, hi in tk.row_slices(offsets, SLICE_BYTES):
                found = [x for x in sets_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x, salt)[0] for x in found], pa.int64()), _lists([x.view(np.int64) for x in found])], names=["set_id", "shingles"])

    some = marked(own, _key(), needed, "key", "wanted").where("wanted").select("text")
    sets = some.mapInArrow(full, "set_id long, shingles array<long>").join(needed.select("set_id").distinct(), "set_id", "left_semi")
    return keep(sets.groupBy("set_id").agg(F.any_value("shingles").alias("shingles")), f"{tag}-sets")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def _confirmed(pairs: DataFrame, sets: DataFrame, tag: str) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sets_a"), batch.column("sets_b")
            row, _, twice = _met(a, b)
            both, all_ = np.bincount(row[twice], minlength=len(a)), np.bincount(row, minlength=len(a))
            sure = 100 * both >= SIMILARITY * all_
            yield batch.select(["a", "b"]).filter(pa.array(sure, pa.bool_()))

    with_sets = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("sets_a")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("sets_b")), "b")
    return keep(with_sets.mapInArrow(confirmed, "a long, b long"), f"{tag}-links")


def _fits(n_a: str, n_b: str):
    """Sizes between which the similarity can be reached at all."""
    return 100 * F.least(n_a, n_b) >= SIMILARITY * F.greatest(n_a, n_b)


def linked_classes(classes: DataFrame, own: DataFrame, salt: int = 0) -> DataFrame:
    """node (set_id), component. classes: set_id, n, key (of a document of the class), sketch."""
    values = classes.select("set_id", "n", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(often, "value")
    kept = F.least("n", F.lit(K))
    least = F.when(F.col("n") <= K, F.floor(F.col("n") * 0.66)).otherwise(F.lit(MIN_SHARED)).cast("int")
    order = Window.partitionBy("set_id").orderBy("df", "value")
    everything = Window.partitionBy("set_id")
    ranked = (
        shared.withColumns({"place": F.row_number().over(order), "m": F.count(F.lit(1)).over(everything), "central": F.sum("df").over(everything)})
        .withColumns({"least": F.greatest(least, F.lit(1)), "alone": kept - F.col("m")})
        # values that no other set retains come first, and lead to no pair
        .where("m >= least")
        .withColumn("head", kept - F.col("least") + 1 - F.col("alone"))
        .where("place <= head")
        .select("value", "set_id", "n", "central")
    )
    entries = lists = keep(ranked, "minhash-lists")

    leaders = entries.groupBy("value").agg(F.max(F.struct("central", "set_id", "n")).alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = (
        entries.join(leaders, "value")
        .select("set_id", "n", F.col("leader.set_id").alias("leader"), F.col("leader.n").alias("n_leader"), F.col("leader.central").alias("central"))
        .where(F.col("set_id") != F.col("leader"))
        .where(_fits("n", "n_leader"))
        .groupBy("set_id", "leader")
        .agg(F.count(F.lit(1)).alias("times"), F.max("central").alias("central"))
    )
    star = met.groupBy("set_id").agg(F.max(F.struct("times", "central", "leader")).alias("best")).select(F.least("set_id", "best.leader").alias("a"), F.greatest("set_id", "best.leader").alias("b")).distinct()
    star = keep(star, "minhash-star")
    first_links = _similar(star, classes, own, salt, "minhash-star")
    first = components(first_links, "minhash-first")

    # what is left: sets of one list in different components
    named = entries.select("value", "set_id").join(first.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    mixed = named.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("value")
    open_ = keep(named.join(mixed, "value", "left_semi").select("set_id", "component").distinct().join(classes.select("set_id", "n", "key"), "set_id"), "minhash-open")
    more = linked_across(open_, classes, own, salt)
    for x in (star, lists, open_):
        forget(x)
    if more.isEmpty():
        return first
    return components(first_links.union(more), "minhash-all")


def linked_across(sets: DataFrame, classes: DataFrame, own: DataFrame, salt: int) -> DataFrame:
    """All links (a, b) between sets of different components, by their full sets. sets: set_id, component, n, key.

    With the shingles of each set ordered rarest first, two similar sets share one of the first ``n - need + 1``: the
    larger set needs 3/4 of its shingles in common, the smaller one 6/7. Only shingles that sets of two components hold
    can be common here, and ``m`` of them leave room for partners up to a certain size alone; sizes are dealt into
    narrow bands, and a set only looks into the bands of its possible partners. Many members of one component and band are
    a crowd: a set only meets its members if enough of its shingles are held by the crowd as a whole. So variants that
    are too far from a large family never meet its members one by one.
    """
    full = full_sets(sets.select("set_id", "key"), own, salt, "minhash-open")
    # intersection >= s / (100 + s) * (sum of sizes), in integers
    top, all_ = SIMILARITY, 100 + SIMILARITY
    need = lambda total: F.expr(f"({top} * ({total}) + {all_ - 1}) div {all_}")
    band = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(BAND))).cast("int")
    sets = sets.select("set_id", "component", "n").withColumn("crowd", F.xxhash64("component", band(F.col("n"))))
    shingles = full.join(sets, "set_id").select("set_id", "component", "crowd", "n", F.explode("shingles").alias("value"))
    held = shingles.groupBy("value").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("value", "df")
    everything = Window.partitionBy("set_id")
    ranked = shingles.join(held, "value").withColumns({"place": F.row_number().over(everything.orderBy("df", "value")), "m": F.count(F.lit(1)).over(everything)})
    ranked = (
        ranked.withColumn("need_small", need("2 * n"))
        .withColumn("need_large", F.expr(f"({top} * n + 99) div 100"))
        .withColumn("most", F.expr(f"m * {all_} div {top} - n"))  # greatest size of a partner
        .where("m >= need_large")
    )
    ranked = keep(ranked.select("value", "set_id", "component", "crowd", "n", "m", "place", "need_small", "need_large", "most"), "minhash-prefix")
    # members of one component and band of sizes, where they are many, are met together before they are met one by one
    crowds = sets.groupBy("crowd").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.any_value("component").alias("of")).where(F.col("members") >= CROWD)
    crowds = keep(crowds, "minhash-crowds")
    union = ranked.join(crowds, "crowd").select("value", F.col("crowd").alias("near"), "least", "greatest", "of").distinct()
    reached = (
        ranked.select("value", "set_id", "component", "n")
        .join(union, "value")
        .where(F.col("component") != F.col("of"))
        .where((100 * F.col("n") >= SIMILARITY * F.col("least")) & (100 * F.col("greatest") >= SIMILARITY * F.col("n")))
        .groupBy("set_id", "n", "near", "least")
        .agg(F.count(F.lit(1)).alias("both"))
        .where(F.col("both") >= need("n + greatest(least, (75 * n + 99) div 100)"))
        .groupBy("set_id")
        .agg(F.collect_list("near").alias("near"))
    )
    none = F.array().cast("array<bigint>")
    heads = ranked.where("place <= m - need_large + 1")
    firsts = heads.groupBy("set_id", "crowd").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= CARRIED, F.struct("place", "value")))).alias("firsts"))
    known = firsts.join(reached, "set_id", "left").join(crowds.select("crowd", "members"), "crowd", "left")
    known = keep(known.select("set_id", F.col("firsts.value").alias("firsts"), F.coalesce("near", none).alias("near"), F.col("members").isNotNull().alias("crowded")), "minhash-near")
    # what stands before a shingle in its set: two sets meet at the first one that they share
    prefix = heads.join(known, "set_id").withColumns({"before": F.slice("firsts", F.lit(1), F.col("place") - 1), "rest": F.col("m") - F.col("place") + 1})
    small = prefix.where("place <= m - need_small + 1 AND most >= n").select("value", *[F.col(c).alias(f"{c}_a") for c in ("component", "crowd", "crowded", "near", "n", "most", "before", "rest")], F.col("set_id").alias("a"), band(F.col("n")).alias("band"))
    large = (
        prefix.withColumn("upto", F.least("n", "most"))
        .where("upto >= need_large")
        .select("value", *[F.col(c).alias(f"{c}_b") for c in ("component", "crowd", "crowded", "near", "n", "before", "rest")], F.col("set_id").alias("b"), "upto", F.explode(F.sequence(band(F.col("need_large")), band(F.col("upto")))).alias("band"))
    )
    meets = (
        small.join(large, ["value", "band"])
        .where("component_a <> component_b AND n_a <= upto AND n_b <= most_a AND (n_a < n_b OR a < b)")
        .where("(NOT crowded_a OR array_contains(near_b, crowd_a)) AND (NOT crowded_b OR array_contains(near_a, crowd_b))")
        .where(_fits("n_a", "n_b"))
        .where("NOT arrays_overlap(before_a, before_b)")
        # nothing before it is common, so no more can be than what is left of either set
        .where(f"{all_} * least(rest_a, rest_b) >= {top} * (n_a + n_b)")
    )
    pairs = keep(meets.select("a", "b").distinct(), "minhash-rest")
    likely = _likely(pairs, classes, "minhash-rest")
    links = _confirmed(likely.select("a", "b"), full, "minhash-rest")
    for x in (ranked, pairs, likely, full, crowds, known):
        forget(x)
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    return _decided(docs, doc_id, text).drop("text_key")


def _decided(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``near_duplicates`` with ``text_key``, the hash of the row's text."""
    small_batches(docs.sparkSession)
    own = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    for salt in range(SALTS):
        rows = keep(sketches(own, salt), "minhash-sketches")
        parts = [F.min("doc_id").alias("low"), F.min(_key()).alias("key"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"), F.min("check").alias("check"), F.max("check").alias("check_too")]
        classes = keep(rows.where("n > 0").groupBy("set_id").agg(*parts), "minhash-classes")
        if classes.where("check <> check_too").isEmpty():
            break
        for x in (rows, classes):
            forget(x)
    else:
        raise RuntimeError("different sets share an id under every salt")
    linked = linked_classes(classes, own, salt)
    named = classes.select("set_id", "low").join(linked.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = keep(named.join(least, "component").select("set_id", "component_id"), "minhash-components")
    full = rows.where("n > 0").select("doc_id", "text_key", "n", "set_id").join(by_class, "set_id").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept; documents that stay surely don't move."""
    dropped = keep(_decided(docs, doc_id, text).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).distinct().withColumn("_both", F.xxhash64("_id", "_text")), "minhash-dropped")
    rows = packed(docs).withColumns({"_id": F.col("row")[f"c{position(docs, doc_id)}"], "_text": F.xxhash64(F.col("row")[f"c{position(docs, text)}"].cast("string"))})
    both = marked(rows, F.xxhash64("_id", "_text"), dropped, "_both", "_maybe")
    sure = both.where("NOT _maybe").select("row")
    # by id and text, as each row follows its own decision, whatever other rows have its id
    exact = both.where("_maybe").alias("r").join(dropped.alias("d"), F.col("r._id").eqNullSafe(F.col("d._id")) & (F.col("r._text") == F.col("d._text")), "left_anti").select("row")
    return sure.unionByName(exact).select("row.*").toDF(*docs.columns)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates among all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT rid, doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY rid),
both_ AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
link AS (
  SELECT a, b FROM both_ JOIN n x ON a = x.rid JOIN n y ON b = y.rid WHERE 100 * c >= 75 * (x.n + y.n - c)
)
SELECT * FROM (
WITH RECURSIVE reach(src, dst) AS (
  SELECT rid, rid FROM d
  UNION
  SELECT reach.src, e.dst FROM reach JOIN (SELECT a AS src, b AS dst FROM link UNION ALL SELECT b, a FROM link) e ON reach.dst = e.src
)
SELECT x.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(y.doc_id) AS component_id, x.doc_id = min(y.doc_id) AS kept
FROM reach JOIN d x ON x.rid = src JOIN d y ON y.rid = dst LEFT JOIN n ON n.rid = src
GROUP BY x.rid, x.doc_id, n.n)
"""

"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Document rates are the ones nearest to 1 in relative entropy that meet all
targets and stay within ``MAX_COPIES``: ``rate = min(MAX_COPIES, exp(dual * z))``, with ``z`` a document's words over
its source's mean. The convex dual has one unknown per source. Newton steps on it are aggregates over a histogram of
(source, size), kept inside a bracket, so every iteration is one small distributed job and all sources move at once.

Rates become whole copies: the whole part for every document, and one more for the documents that come first by an
order-sampling priority (draw over fractional part) until the words still missing are covered. The priority at which a
source is full is found by histogram refinement, seven rounds of 8 bits, so no source is ever sorted in one task. What
a threshold can't fill is topped up by the largest documents that still fit, one bundle per source and round.

Equal rows (same id, text and source) are a unit, dealt into bundles of equal size: one row each up to ``BUNDLES`` rows. A
unit's bundles draw evenly spaced numbers behind one hash, so its rows get their extra copy at its rate whichever of
them that are; a bundle that fits in part only is topped up in part. So a source made of one repeated row still comes
within a row of its target.

All sums that decide are integers or decimals, so reruns agree whatever the order of tasks.

Defined cases: a null or empty text has size 0; a null source is a source of its own, and last; ties of priority go
together, and ties of top-ups to the greater draw; documents without words take none; very long texts count as they are;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bitmap import marked
from ._work import forget, keep, packed, pick, position, repeated

MAX_COPIES = 3
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rates are multiples of one in so many.
MICRO = 1_000_000
#: Enough for bisection alone to narrow any bracket to nothing.
NEWTON_STEPS = 100
TOLERANCE = 1e-7
ROUNDS, BITS = 7, 8
TOP_UPS = 6
#: Bundles of a unit, unless they would hold more than so many rows.
BUNDLES, BUNDLE_ROWS = 256, 1 << 16
#: More sources than this are joined by a shuffle, not broadcast.
BROADCAST_SOURCES = 20_000


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def unit_columns(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    own = pick(docs, doc_id=doc_id, text=text, source=source)
    return own.select("doc_id", *_unit(F.col("doc_id"), F.col("text"), F.col("source"))).withColumn("unit", F.col("hash"))


def _unit(doc_id: Column, text: Column, source: Column) -> list[Column]:
    return [
        F.xxhash64(doc_id.cast("string"), text.cast("string")).alias("hash"),
        source_key(source).alias("skey"),
        F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ]


def bundles(units: DataFrame) -> DataFrame:
    """``units`` (with hash and m) as bundles of their rows: ``bundle``, ``draw``, and ``m`` rows in each."""
    n = F.greatest(F.least("m", F.lit(BUNDLES)), F.expr(f"(m + {BUNDLE_ROWS - 1}) div {BUNDLE_ROWS}"))
    return (
        units.withColumn("_n", n)
        .withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("draw", F.expr(f"((hash & {0xFFFFFFFF}L) + bundle * {1 << 32}L) div _n + 1"))
        .withColumn("m", F.expr("(m * (bundle + 1)) div _n - (m * bundle) div _n"))
        .drop("_n", "hash")
    )


def targets(units: DataFrame) -> DataFrame:
    """skey, source_size, n_units, target. ``units``: skey, size, m.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Sources whose share exceeds ``MAX_COPIES`` times
    their size stop there, and the others share the rest by weight; in the order of size over weight these are the
    first ones, so running sums find them.
    """
    by = units.groupBy("skey").agg(F.sum(F.col("size") * F.col("m")).cast("long").alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("m")).otherwise(0)).alias("n_units"))
    everything = Window.partitionBy()
    weighed = (
        by.withColumn("place", F.row_number().over(Window.orderBy(F.when(F.col("skey") == "n", 1).otherwise(0), "skey")))
        .withColumn("weight", (F.pmod(F.col("place") - 1, F.lit(3)) + 1).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * MAX_COPIES)
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    order = Window.orderBy("ratio", "place")
    return (
        weighed.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("theta", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce("theta", F.lit(0.0))))
        .select("skey", "source_size", "n_units", "target")
    )


def rate_micro(dual: Column, size: Column, mean: Column) -> Column:
    """The rate of a document in millionths."""
    return F.least(F.lit(MAX_COPIES * MICRO), F.round(F.exp(F.least(dual * size / mean, F.lit(2.0))) * MICRO).cast("long"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def solve_dual(histogram: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    """``goals`` with ``mean`` and ``dual``. histogram: skey, size, n (documents).

    Newton on the logarithm of a source's words as a function of its dual, inside a bracket that each step narrows.
    """
    mean = F.col("source_size") / F.greatest(F.col("n_units"), F.lit(1)).cast("double")
    state = (
        goals.withColumn("mean", F.greatest(mean, F.lit(1.0)))
        .withColumn("full", F.col("target") >= F.col("source_size") * (MAX_COPIES - 1e-9))
        # a rate is never under e**-60 or at its limit for every document outside this bracket
        .withColumns({"low": F.lit(-60.0), "high": F.col("mean") * 1.1, "done": F.col("full") | (F.col("source_size") == 0) | (F.col("target") <= 0)})
        .withColumn("dual", F.when(F.col("full"), F.col("mean") * 2.0).when(F.col("done"), F.lit(0.0)).otherwise(F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size"))))
    )
    state = keep(state, "mix-dual")
    if state.where(~F.col("done")).isEmpty():
        return state.select("skey", "source_size", "target", "mean", "dual")
    for _ in range(NEWTON_STEPS):
        z = F.col("size") / F.col("mean")
        rate = rate_micro(F.col("dual"), F.col("size"), F.col("mean"))
        words = rate.cast("decimal(38,0)") * F.col("size") * F.col("n")
        slope = F.when(rate < MAX_COPIES * MICRO, F.round(rate * F.least(z, F.lit(1e6)) * 1000).cast("decimal(38,0)") * F.col("size") * F.col("n")).otherwise(F.lit(0).cast("decimal(38,0)"))
        sums = (
            histogram.join(_small(state.where(~F.col("done")).select("skey", "dual", "mean"), n_sources), "skey")
            .groupBy("skey")
            .agg(F.sum(words.cast("decimal(38,0)")).alias("words"), F.sum(slope.cast("decimal(38,0)")).alias("slope"))
        )
        ratio = F.col("words").cast("double") / MICRO / F.col("target")
        gap = F.log(F.greatest(ratio, F.lit(1e-300)))
        step = F.col("dual") - gap * F.col("words").cast("double") * 1000 / F.nullif(F.col("slope").cast("double"), F.lit(0.0))
        # a rate is off by half a millionth at most, which no dual mends
        rounding = F.abs(F.col("words").cast("double") - F.col("target") * MICRO) <= 0.5 * F.col("source_size")
        met = F.coalesce((F.abs(ratio - 1) <= TOLERANCE) | rounding, F.lit(True))
        low, high = F.when(gap < 0, F.col("dual")).otherwise(F.col("low")), F.when(gap > 0, F.col("dual")).otherwise(F.col("high"))
        moved = (
            state.join(_small(sums, n_sources), "skey", "left")
            .withColumns({"met": F.col("done") | met, "new_low": low, "new_high": high, "step": step})
            .withColumn("next", F.when((F.col("step") > F.col("new_low")) & (F.col("step") < F.col("new_high")), F.col("step")).otherwise((F.col("new_low") + F.col("new_high")) / 2))
            # a bracket this narrow can't move a rate by a millionth
            .withColumn("met", F.col("met") | (F.col("new_high") - F.col("new_low") < 1e-12))
            .select("skey", "source_size", "n_units", "target", "mean", "full", F.when(F.col("done"), F.col("low")).otherwise(F.col("new_low")).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(F.col("new_high")).alias("high"), F.col("met").alias("done"), F.when(F.col("met"), F.col("dual")).otherwise(F.col("next")).alias("dual"))
        )
        before, state = state, keep(moved, "mix-dual")
        forget(before)
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"targets aren't met after {NEWTON_STEPS} steps")
    return state.select("skey", "source_size", "target", "mean", "dual")


def _rated(units: DataFrame, params: DataFrame, n_sources: int) -> DataFrame:
    """Bundles with whole copies, fractional part and priority."""
    rate = rate_micro(F.col("dual"), F.col("size"), F.col("mean"))
    return (
        units.join(_small(params, n_sources), "skey")
        .withColumn("rate", rate)
        .withColumns({"whole": F.expr(f"rate div {MICRO}"), "part": F.pmod(F.col("rate"), F.lit(MICRO))})
        .withColumn("priority", F.when((F.col("part") > 0) & (F.col("size") > 0), F.expr(f"draw * {MICRO}L div part")))
    )


def topped_rows() -> Column:
    """How many rows of a rated bundle its source's top-ups take once more."""
    same = lambda x: (x["unit"] == F.col("unit")) & (x["bundle"] == F.col("bundle")) & (x["size"] == F.col("size"))
    return F.coalesce(F.get(F.filter("topped", same), 0)["rows"], F.lit(0).cast("long"))


def copies_column() -> Column:
    """Copies of each row of a rated bundle by its source's threshold, without top-ups."""
    by_threshold = F.coalesce(F.col("priority") < F.col("threshold"), F.lit(False))
    return F.when(F.col("size") > 0, F.col("whole") + F.when(by_threshold, 1).otherwise(0)).otherwise(0).cast("long")


def plan_mix(units: DataFrame) -> tuple[DataFrame, int]:
    """Per source what decides its documents' copies. units: unit, bundle, draw, skey, size, m (rows of that bundle)."""
    goals = keep(targets(units), "mix-goals")
    n_sources = goals.count()
    histogram = keep(units.where(F.col("size") > 0).groupBy("skey", "size").agg(F.sum("m").alias("n")), "mix-histogram")
    dual = keep(solve_dual(histogram, goals, n_sources), "mix-solved")
    rated = _rated(units, dual, n_sources)
    words = F.col("size") * F.col("m")
    missing = (
        rated.groupBy("skey")
        .agg(F.sum(F.col("whole") * words).alias("placed"))
        .join(dual.select("skey", "target"), "skey")
        .select("skey", (F.round("target").cast("long") - F.col("placed")).alias("missing"), F.lit(0).cast("long").alias("threshold"))
    )
    search = keep(missing, "mix-search")
    for k in range(ROUNDS):
        width = 1 << (BITS * (ROUNDS - 1 - k))
        # the units of the bucket in which each source gets full, dealt into 2**8 finer ones
        fine = (
            rated.select("skey", "priority", words.alias("words"))
            .join(_small(search, n_sources), "skey")
            .withColumn("bucket", F.expr(f"(priority - threshold) div {width}L"))
            .where((F.col("priority") >= F.col("threshold")) & (F.col("bucket") < (1 << BITS)))
            .groupBy("skey", "bucket")
            .agg(F.sum("words").alias("words"))
        )
        running = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        full = (
            fine.withColumn("upto", F.sum("words").over(running))
            .join(_small(search.select("skey", "missing"), n_sources), "skey")
            .groupBy("skey")
            .agg(
                F.min(F.when(F.col("upto") > F.col("missing"), F.col("bucket"))).alias("bucket"),
                F.max(F.when(F.col("upto") <= F.col("missing"), F.col("upto"))).alias("below"),
            )
        )
        # without such a bucket all units of the range fit, and the threshold is its end
        moved = search.join(_small(full, n_sources), "skey", "left").select(
            "skey",
            (F.col("missing") - F.coalesce("below", F.lit(0))).alias("missing"),
            (F.col("threshold") + F.coalesce("bucket", F.lit((1 << BITS) - 1 if k < ROUNDS - 1 else 1 << BITS)) * width).alias("threshold"),
        )
        before, search = search, keep(moved, "mix-search")
        forget(before)
    kind = "array<struct<unit: bigint, bundle: bigint, size: bigint, rows: bigint>>"
    params = keep(search.join(_small(dual, n_sources), "skey").withColumn("topped", F.array().cast(kind)), "mix-plan")
    for _ in range(TOP_UPS):
        free = (
            _rated(units, params, n_sources)
            .where((F.col("size") > 0) & (F.col("size") <= F.col("missing")) & (copies_column() < MAX_COPIES) & (topped_rows() == 0))
            .withColumn("rows", F.least("m", F.expr("missing div size")))
            .groupBy("skey")
            .agg(F.max(F.struct((F.col("size") * F.col("rows")).alias("words"), "draw", "unit", "bundle", "size", "rows")).alias("best"))
        )
        more = params.join(_small(free, n_sources), "skey", "left")
        taken = F.when(F.col("best").isNotNull(), F.array(F.struct("best.unit", "best.bundle", "best.size", "best.rows"))).otherwise(F.array()).cast(kind)
        moved = more.select(*[c for c in params.columns if c not in ("missing", "topped")], (F.col("missing") - F.coalesce("best.words", F.lit(0))).alias("missing"), F.concat("topped", taken).alias("topped"))
        before, params = params, keep(moved, "mix-plan")
        forget(before)
    return params, n_sources


def _most_rows(units: DataFrame) -> int:
    return units.agg(F.max("m")).first()[0] or 0


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per input row."""
    units = unit_columns(docs, doc_id, text, source).groupBy("doc_id", "unit", "hash", "skey", "size").agg(F.count(F.lit(1)).alias("m"))
    units = keep(bundles(units), "mix-units")
    params, n_sources = plan_mix(units)
    out = _rated(units, params, n_sources).select("doc_id", "unit", "bundle", "m", "size", "source_size", "target", copies_column().alias("each"), topped_rows().alias("topped_rows"))
    rows = repeated(out, "m", ["unit", "bundle"], _most_rows(units), "row")
    copies = F.col("each") + F.when(F.col("row") < F.col("topped_rows"), 1).otherwise(0)
    return rows.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each input row as often as it is taken, with the input's columns.

    What decides is a few numbers per source, so the texts aren't shuffled; only of rows that are equal in all columns
    one moves, once per task, and is repeated as often as they are taken together.
    """
    whole = [F.col("row")[f"c{k}"] if "map<" not in kind else F.to_json(F.struct(F.col("row")[f"c{k}"])) for k, (_, kind) in enumerate(docs.dtypes)]
    wide = packed(docs).select("row", *_unit(*[F.col("row")[f"c{position(docs, c)}"] for c in (doc_id, text, source)])).withColumn("unit", F.xxhash64(*whole))
    key = ["unit", "hash", "skey", "size"]
    units = keep(wide.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), "mix-rows")
    parts = keep(bundles(units), "mix-units")
    params, n_sources = plan_mix(parts)
    many = units.where("m > 1").select("unit")

    def times(own: DataFrame) -> DataFrame:
        # a document without words weighs nothing and is kept as it is
        n = F.when(F.col("size") == 0, F.col("m")).otherwise(copies_column() * F.col("m") + topped_rows())
        return _rated(bundles(own), params, n_sources).select("row", "unit", "bundle", n.alias("times")).where("times > 0")

    if many.isEmpty():
        out = repeated(times(wide.withColumn("m", F.lit(1).cast("long"))), "times", ["unit", "bundle"], MAX_COPIES, "copy")
    else:
        sorted_out = marked(wide, F.col("unit"), many, "unit", "_many")
        alone = times(sorted_out.where("NOT _many").drop("_many").withColumn("m", F.lit(1).cast("long")))
        together = times(sorted_out.where("_many").groupBy(*key).agg(F.any_value("row").alias("row"), F.count(F.lit(1)).alias("m")))
        out = repeated(alone, "times", ["unit", "bundle"], MAX_COPIES, "copy").unionByName(repeated(together, "times", ["unit", "bundle"], MAX_COPIES * _most_rows(parts), "copy"))
    return out.select("row.*").toDF(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))

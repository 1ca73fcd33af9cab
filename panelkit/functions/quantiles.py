"""Exact order statistics of long columns without ordering them.

A sketch gives a bracket around each wanted rank; its error is known, so the bracket surely holds the value. Rows below
the bracket are counted, and only those inside, a few thousandths of all, are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is one in so many rows.
ACCURACY = 5000


def order_statistics(long: DataFrame, points: list[float], rank: Column) -> DataFrame:
    """column, p, rank, value: the value at ``rank`` (from 0) for each point. long: column, value (defined values).

    ``rank`` is built from ``p`` and ``n``, the number of the column's values.
    """
    margin = 2.0 / ACCURACY
    edges = [min(1.0, max(0.0, p + side)) for p in points for side in (-margin, margin)]
    sketch = long.groupBy("column").agg(F.percentile_approx("value", F.array(*[F.lit(e) for e in edges]), ACCURACY).alias("_e"), F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col("_e")[2 * k].alias("lo"), F.col("_e")[2 * k + 1].alias("hi")) for k, p in enumerate(points)])
    # so few values are all ordered; of more, the margin is wider than the sketch's error and two rows
    few = F.col("n") <= 10 * ACCURACY
    brackets = (
        sketch.select("column", "n", F.inline(wanted))
        .withColumns({"lo": F.when(few, F.lit(float("-inf"))).otherwise(F.col("lo")), "hi": F.when(few, F.lit(float("inf"))).otherwise(F.col("hi"))})
        .withColumn("rank", rank.cast("bigint"))
    )
    near = long.join(F.broadcast(brackets), "column")  # one row per column and point
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    below = near.where("value < lo").groupBy("column", "p").agg(F.count(F.lit(1)).alias("below"))
    counted = near.where(inside).groupBy("column", "p", "rank", "value").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(below), ["column", "p"], "left")
    upto = F.coalesce("below", F.lit(0)) + F.sum("m").over(Window.partitionBy("column", "p").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("_to", upto).where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("m"))).select("column", "p", "rank", "value")


def linear_quantiles(long: DataFrame, points: list[float]) -> DataFrame:
    """column, p, value with linear interpolation between neighbours."""
    at = F.col("p") * (F.col("n") - 1)
    low = order_statistics(long, points, F.floor(at)).select("column", "p", F.col("value").alias("_low"), F.col("rank").alias("_rank"))
    high = order_statistics(long, points, F.ceil(at)).select("column", "p", F.col("value").alias("_high"))
    n = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    part = at - F.col("_rank")
    both = low.join(high, ["column", "p"]).join(n, "column")
    return both.select("column", "p", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias("value"))

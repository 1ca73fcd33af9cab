"""Window specifications and rolling statistics.

Two axes: per ticker in the order of dates, and per date across tickers. Rolling statistics need a full window: fewer
values than its length, or a null in it, give null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TICKER, DATE = "ticker", "date"


def per_ticker(*more: str) -> WindowSpec:
    return Window.partitionBy(*more, TICKER).orderBy(DATE)


def per_date(*more: str) -> WindowSpec:
    return Window.partitionBy(*more, DATE)


def last(spec: WindowSpec, n: int) -> WindowSpec:
    """The last ``n`` rows with the current one."""
    return spec.rowsBetween(-(n - 1), Window.currentRow)


def full(value: Column, counted: Column, spec: WindowSpec, n: int) -> Column:
    """``value`` over the last n rows where all n values of ``counted`` are there."""
    return F.when(F.count(counted).over(last(spec, n)) == n, value.over(last(spec, n)))


def rolling_by_sums(df: DataFrame, x: Column, windows: Iterable[int], spec: WindowSpec, names: dict[str, str]) -> DataFrame:
    """Rolling mean (``names["mean"]``) and sample deviation (``names["std"]``) for many windows at a constant cost per row.

    A framed aggregate adds up its whole frame again for every row, so its cost grows with the window. Here running
    counts, sums and sums of squares are taken once, and a window is a difference of two of them: two window passes over
    one sort, whatever the windows. Squares cancel for values that are large against their spread; ``x`` is centred on
    its partition's first value to keep that small. Names are templates with ``{n}``.
    """
    running = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = df.withColumn("_x", x).withColumn("_c", F.first("_x", ignorenulls=True).over(whole)).withColumn("_d", F.col("_x") - F.col("_c"))
    sums = base.withColumns(
        {
            "_n": F.count("_d").over(running),
            "_s": F.coalesce(F.sum("_d").over(running), F.lit(0.0)),
            "_q": F.coalesce(F.sum(F.col("_d") * F.col("_d")).over(running), F.lit(0.0)),
        }
    )
    out = {}
    for n in windows:
        before = lambda c, n=n: F.coalesce(F.lag(c, n).over(spec), F.lit(0))
        filled = (F.col("_n") - before("_n")) == n
        total, squares = F.col("_s") - before("_s"), F.col("_q") - before("_q")
        if "mean" in names:
            out[names["mean"].format(n=n)] = F.when(filled, total / n + F.col("_c"))
        if "std" in names and n > 1:
            out[names["std"].format(n=n)] = F.when(filled, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))))
        elif "std" in names:
            out[names["std"].format(n=n)] = F.lit(None).cast("double")
    return sums.withColumns(out).drop("_x", "_c", "_d", "_n", "_s", "_q")


def rolling_covariance_by_sums(df: DataFrame, x: Column, y: Column, windows: Iterable[int], spec: WindowSpec, name: str) -> DataFrame:
    """Rolling sample covariance (``name`` with ``{n}``) for many windows, as ``rolling_by_sums``; for values around 0."""
    running = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = x.isNotNull() & y.isNotNull()
    zero = F.lit(0.0)
    pairs = df.withColumns({"_x": F.when(both, x).otherwise(zero), "_y": F.when(both, y).otherwise(zero), "_b": both.cast("int")})
    sums = pairs.withColumns(
        {"_n": F.sum("_b").over(running), "_sx": F.sum("_x").over(running), "_sy": F.sum("_y").over(running), "_sxy": F.sum(F.col("_x") * F.col("_y")).over(running)}
    )
    out = {}
    for n in windows:
        part = lambda c, n=n: F.col(c) - F.coalesce(F.lag(c, n).over(spec), F.lit(0))
        out[name.format(n=n)] = F.when(part("_n") == n, (part("_sxy") - part("_sx") * part("_sy") / n) / (n - 1))
    return sums.withColumns(out).drop("_x", "_y", "_b", "_n", "_sx", "_sy", "_sxy")


def average_rank(x: Column, spec_keys: list[str], descending: bool = False) -> Column:
    """Rank within the keys, ties share their mean rank, null stays null."""
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    keys = [F.col(k) for k in spec_keys]
    least = F.rank().over(Window.partitionBy(*keys).orderBy(order)).cast("double")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), least + (ties - 1) / F.lit(2.0))

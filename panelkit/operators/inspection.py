"""Looking at a panel: counts, quantiles, histograms, correlations, calendar buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.helpers import as_list
from ..functions.quantiles import linear_quantiles, order_statistics
from ..functions.stats import pearson
from .evaluation import unpivot


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """column, n_null, n_nan, n_inf."""
    names = as_list(columns) if columns else [c for c, kind in df.dtypes if kind in ("double", "float")]
    count = lambda c: F.sum(c.cast("bigint"))
    sums = [F.struct(F.lit(c).alias("column"), count(F.col(c).isNull()).alias("n_null"), count(F.coalesce(F.isnan(c), F.lit(False))).alias("n_nan"), count(F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False))).alias("n_inf")) for c in names]
    return df.agg(F.array(*sums).alias("all")).select(F.inline("all"))


def unique_counts(df: DataFrame) -> DataFrame:
    """n_tickers, n_dates, n_rows."""
    return df.agg(F.countDistinct("ticker").alias("n_tickers"), F.countDistinct("date").alias("n_dates"), F.count(F.lit(1)).alias("n_rows"))


def rows_per_ticker(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


def _long(df: DataFrame, columns) -> DataFrame:
    return unpivot(df, columns, keep=(), name="column").where("value IS NOT NULL AND NOT isnan(value)")


def describe(df: DataFrame, columns) -> DataFrame:
    """column, n, mean, std, lo, q1, median, q3, hi of the defined values."""
    long = _long(df, columns)
    moments = long.groupBy("column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    q = linear_quantiles(long, [0.25, 0.5, 0.75]).groupBy("column").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value")).toDF("column", "q1", "median", "q3")
    return moments.join(q, "column").select("column", "n", "mean", "std", "lo", "q1", "median", "q3", "hi")


def quantiles(df: DataFrame, columns, points=(0.01, 0.5, 0.99)) -> DataFrame:
    """column, p, value: the value nearest to each quantile's place."""
    return order_statistics(_long(df, columns), list(points), F.round(F.col("p") * (F.col("n") - 1))).select("column", "p", "value")


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """a, b, corr: Pearson correlations of all pairs over complete rows, in one aggregate."""
    names = as_list(columns)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in names))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(F.col(a), F.col(b)).alias("corr")) for a in names for b in names]
    return rows.agg(F.array(*cells).alias("all")).select(F.inline("all"))


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int = 100) -> DataFrame:
    """bin, n: counts of equal bins from low to high; bin 0 lies below, bin ``bins + 1`` at or above the end."""
    return df.where(F.col(col).isNotNull()).groupBy(F.width_bucket(F.col(col), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def half_years(df: DataFrame, col: str) -> DataFrame:
    """period, mean, std, n: calendar half-years."""
    month = F.expr("CAST(floor((month(date) - 1) / 6) AS INT) * 6 + 1")
    period = F.make_date(F.year("date"), month, F.lit(1))
    return df.groupBy(period.alias("period")).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("n"))


def latest(df: DataFrame) -> DataFrame:
    """The rows of the newest date."""
    return df.join(F.broadcast(df.agg(F.max("date").alias("date"))), "date", "left_semi")


def normal_quantiles(df: DataFrame, col: str, points: int = 99) -> DataFrame:
    """p, value, normal: a quantile plot against the normal distribution; its points are a parameter."""
    from statistics import NormalDist

    ps = [k / (points + 1) for k in range(1, points + 1)]
    normal = F.element_at(F.create_map(*[F.lit(x) for p in ps for x in (p, NormalDist().inv_cdf(p))]), F.col("p"))
    return linear_quantiles(_long(df, col), ps).select("p", "value", normal.alias("normal"))

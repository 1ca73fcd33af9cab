"""How well a signal predicts: information coefficients, their significance, decay, turnover and long-short returns.

Every operator takes ``by``, extra keys that come before the date: with ``by=("signal",)`` a long table of many signals is
evaluated in one job instead of one job per signal. Series (one row per date) are the only thing that is ever ordered
without a partition.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import as_list, known, over_zero
from ..functions.stats import newey_west_lag, pearson, sharpe, two_sided_pvalue
from ..functions.windows import average_rank
from .signals import bucket_expr, decile_expr, make_signal

DECAY_HORIZONS = (1, 5, 10, 20)
LAGS = (1, 5, 10, 20)


def unpivot(df: DataFrame, columns, keep=("ticker", "date"), name: str = "signal", value: str = "value") -> DataFrame:
    """Long form: one row per input row and column."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in as_list(columns)])
    return df.select(*keep, F.inline(pairs))


def compute_ic(df: DataFrame, signal_col: str, forward_return_col: str = "fwdret", method: str = "spearman", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, ic): correlation of signal and forward return across the tickers of each date.

    Only rows that have both take part, also in the ranks; dates without such rows are absent; a constant side gives null.
    """
    keys = [*by, "date"]
    pairs = df.select(*keys, known(F.col(signal_col)).alias("_x"), known(F.col(forward_return_col)).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    if method == "spearman":
        pairs = pairs.select(*keys, average_rank(F.col("_x"), keys).alias("_x"), average_rank(F.col("_y"), keys).alias("_y"))
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}; spearman or pearson")
    return pairs.groupBy(*keys).agg(pearson(F.col("_x"), F.col("_y")).alias("ic"))


def summarize_ic(ic: DataFrame, ic_col: str = "ic", by: tuple[str, ...] = ()) -> DataFrame:
    """mean, std, ir, t_stat, hit_rate, n_days over the dates that have a value."""
    x = known(F.col(ic_col))
    sums = ic.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.count(x).alias("n_days"))
    ir = over_zero(F.col("mean"), F.col("std"))
    return sums.select(*by, "mean", "std", ir.alias("ir"), (ir * F.sqrt(F.col("n_days").cast("double"))).alias("t_stat"), "hit_rate", "n_days")


def compare_methods_ic(df: DataFrame, feature_col: str, methods: Iterable[str], forward_return_col: str = "fwdret", **options) -> DataFrame:
    """One summary per signal method of a feature, in one job."""
    return summarize_ic(build_ic(df, feature_col, methods, forward_return_col, **options), by=("method",))


def build_ic(df: DataFrame, feature_col: str, methods: Iterable[str], forward_return_col: str = "fwdret", **options) -> DataFrame:
    """(method, date, ic) of each signal method of a feature."""
    methods = list(methods)
    for m in methods:
        df = make_signal(df, feature_col, m, **options)
    names = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{feature_col}_{m}").cast("double").alias("value")) for m in methods])
    return compute_ic(df.select("ticker", "date", forward_return_col, F.inline(names)), "value", forward_return_col, by=("method",))


def newey_west(series: DataFrame, col: str = "ic", max_lag: int | None = None, by: tuple[str, ...] = (), order: str = "date") -> DataFrame:
    """mean, se, t_stat, max_lag, n of a series with autocorrelation-consistent errors.

    A series is one value per date; it becomes one sorted array, and each lag is a product of the array with itself
    shifted. Fewer than two values give nulls, and so does a variance that isn't above 0.
    """
    x = known(F.col(col))
    arrays = series.groupBy(*by).agg(sorted_values(x, order).alias("_a"), F.avg(x).alias("_m"))
    return arrays.select(*by, newey_west_of(F.col("_a"), F.col("_m"), max_lag).alias("_nw")).select(*by, "_nw.*")


def sorted_values(x: Column, order: str = "date") -> Column:
    """The defined values of a series in its order, as an aggregate; a series has one value per date."""
    return F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(F.col(order).alias("at"), x.alias("v"))))), lambda e: e["v"])


def newey_west_of(values: Column, mean: Column, max_lag: int | None = None) -> Column:
    """mean, se, t_stat, max_lag, n of an array of defined values, as a struct."""
    n = F.size(values)
    centred = F.transform(values, lambda v: v - mean)
    lag = F.lit(max_lag).cast("int") if max_lag is not None else newey_west_lag(n)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e)

    def covariance(k: Column) -> Column:
        m = F.greatest(n - k, F.lit(0))
        products = F.zip_with(F.slice(centred, k + 1, m), F.slice(centred, F.lit(1), m), lambda a, b: a * b)
        return F.coalesce(total(products), F.lit(0.0)) / n

    enough = n >= 2
    steps = F.when(enough & (lag >= 1), F.sequence(F.lit(1), lag)).otherwise(F.array().cast("array<int>"))
    weighted = F.aggregate(steps, F.lit(0.0), lambda s, k: s + (F.lit(1.0) - k / (lag + 1)) * covariance(k))
    variance = F.when(enough, total(F.transform(centred, lambda e: e * e)) / n + F.lit(2.0) * weighted)
    se = F.when(variance > 0, F.sqrt(variance / n))
    return F.struct(F.when(enough, mean).alias("mean"), se.alias("se"), over_zero(mean, se).alias("t_stat"), F.when(enough, lag).alias("max_lag"), n.cast("bigint").alias("n"))


newey_west_ic_tstat = newey_west


def ic_pvalue_nw(nw: DataFrame, t_col: str = "t_stat") -> DataFrame:
    """Add ``p_value``, two-sided normal."""
    return nw.withColumn("p_value", two_sided_pvalue(F.col(t_col)))


def ic_decay(df: DataFrame, signal_col: str, horizons: Iterable[int] = DECAY_HORIZONS, method: str = "spearman") -> DataFrame:
    """horizon, mean, std, ir, hit_rate, n_days: all horizons are columns of one window pass, then one group-by."""
    from .features import add_fwdret_horizon

    horizons = list(horizons)
    ahead = add_fwdret_horizon(df, horizons)
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_ret_{h}").alias("_fwd")) for h in horizons])
    long = ahead.select("date", F.col(signal_col).alias("_signal"), F.inline(pairs))
    out = summarize_ic(compute_ic(long, "_signal", "_fwd", method, by=("horizon",)), by=("horizon",))
    return out.select("horizon", "mean", "std", "ir", "hit_rate", "n_days")


def autocorrelation(df: DataFrame, col: str, lags: Iterable[int] = LAGS, group: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Lag-k autocorrelation.

    Without ``group`` of a series (per ``by``): one row with ``lag_k`` columns. With ``group``: within each group, then
    lag, mean, std and n_groups across groups.
    """
    lags = list(lags)
    keys = [*by, *([group] if group else [])]
    spec = Window.partitionBy(*keys).orderBy("date")
    x = known(F.col(col))
    shifted = df.select(*keys, x.alias("_x"), *[F.lag(x, k).over(spec).alias(f"_l{k}") for k in lags])
    own = shifted.groupBy(*keys).agg(*[pearson(F.col("_x"), F.col(f"_l{k}")).alias(f"lag_{k}") for k in lags])
    if group is None:
        return own
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"lag_{k}").alias("_r")) for k in lags])
    return own.select(*by, F.inline(pairs)).groupBy(*by, "lag").agg(F.avg("_r").alias("mean"), F.stddev_samp("_r").alias("std"), F.count("_r").alias("n_groups"))


def get_recent_coverage(df: DataFrame, col: str, n_days: int = 365, by: tuple[str, ...] = ()) -> DataFrame:
    """coverage: share of rows with a value among those of the last ``n_days`` calendar days, the first of them included."""
    newest = df.agg(F.max("date").alias("_newest"))
    recent = df.crossJoin(F.broadcast(newest)).where(F.col("date") >= F.date_sub("_newest", n_days))  # one row
    return recent.groupBy(*by).agg(F.avg(F.col(col).isNotNull().cast("double")).alias("coverage"))


def compute_stability(df: DataFrame, signal_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, turnover): mean absolute change of the signal since the ticker's row before."""
    x = F.col(signal_col).cast("double")
    change = F.abs(x - F.lag(x).over(Window.partitionBy(*by, "ticker").orderBy("date")))
    return df.select(*by, "date", change.alias("_c")).groupBy(*by, "date").agg(F.avg("_c").alias("turnover"))


def get_stability_DF(df: DataFrame, signal_cols) -> DataFrame:
    """(date, {signal}_turnover …) for several signals in one job."""
    spec = Window.partitionBy("ticker").orderBy("date")
    names = as_list(signal_cols)
    changes = df.select("date", *[F.abs(F.col(c) - F.lag(c).over(spec)).alias(f"_{k}") for k, c in enumerate(names)])
    return changes.groupBy("date").agg(*[F.avg(f"_{k}").alias(f"{c}_turnover") for k, c in enumerate(names)])


def series_summary(series: DataFrame, columns) -> DataFrame:
    """column, mean, std, n: what is printed next to a turnover or long-short series."""
    return unpivot(series, columns, keep=(), name="column").groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def decile_longshort_returns(df: DataFrame, signal_col: str, fwd_ret_col: str = "fwdret", n_buckets: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, long_ret, short_ret, spread_ret): mean return of the top bucket, less that of the bottom one.

    The signal is cut into buckets again, also if it is one already. Dates without one of the legs are absent.
    """
    keys = [*by, "date"]
    sides = df.select(*keys, F.col(fwd_ret_col).cast("double").alias("_f"), decile_expr(F.col(signal_col), n_buckets, by=tuple(keys)).alias("_s"))
    legs = sides.groupBy(*keys).agg(
        F.avg(F.when(F.col("_s") == 1, F.col("_f"))).alias("long_ret"),
        F.avg(F.when(F.col("_s") == -1, -F.col("_f"))).alias("short_ret"),
        F.count(F.when(F.col("_s") == 1, 1)).alias("_long"),
        F.count(F.when(F.col("_s") == -1, 1)).alias("_short"),
    )
    return legs.where("_long > 0 AND _short > 0").select(*keys, "long_ret", "short_ret", (F.col("long_ret") + F.col("short_ret")).alias("spread_ret"))


get_decile_longshort_returns_DF = decile_longshort_returns


def sharpe_ratio(series: DataFrame, col: str, periods_per_year: int = 252, by: tuple[str, ...] = ()) -> DataFrame:
    """sharpe: mean over population deviation, annualised; null without values or spread."""
    return series.groupBy(*by).agg(sharpe(known(F.col(col)), periods_per_year).alias("sharpe"))


def max_drawdown(series: DataFrame, col: str, by: tuple[str, ...] = (), order: str = "date") -> DataFrame:
    """max_drawdown: least distance of the running sum below its own running maximum, which starts at the first value."""
    spec = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = series.withColumn("_r", known(F.col(col))).where("_r IS NOT NULL").withColumn("_c", F.sum("_r").over(spec))
    return summed.withColumn("_d", F.col("_c") - F.max("_c").over(spec)).groupBy(*by).agg(F.min("_d").alias("max_drawdown"))


def decile_spread(df: DataFrame, signal_col: str, fwd_ret_col: str = "fwdret", n_buckets: int = 10) -> DataFrame:
    """bucket, mean_fwd: mean forward return of each quantile bucket, pooled over dates; rows without signal are a bucket."""
    cut = df.select(F.col(fwd_ret_col).alias("_f"), bucket_expr(F.col(signal_col), n_buckets).alias("bucket"))
    return cut.groupBy("bucket").agg(F.avg("_f").alias("mean_fwd"))


def cumulative_ic(ic: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, cum_ic): running sum, undefined dates count 0."""
    spec = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ic.select(*by, "date", F.sum(F.coalesce("ic", F.lit(0.0))).over(spec).alias("cum_ic"))


def ic_distribution(ic: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """lo, q1, median, q3, hi of the defined values."""
    q = F.percentile(F.col("ic"), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return ic.groupBy(*by).agg(q.alias("_q")).select(*by, *[F.col("_q")[k].alias(n) for k, n in enumerate(("lo", "q1", "median", "q3", "hi"))])


def coverage_per_date(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy("date").agg(F.count(col).alias("n"))


def moments_per_date(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy("date").agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))


def heatmap(df: DataFrame, col: str, tickers: list[str] | None = None) -> DataFrame:
    """The (ticker, date, value) cells of a heat map of all tickers, or of some."""
    some = df if tickers is None else df.where(F.col("ticker").isin(tickers))
    return some.select("ticker", "date", F.col(col).alias("value"))


def one_pager(df: DataFrame, signal_col: str) -> DataFrame:
    """date, n, mean, std: what the one-page overview of a signal draws, in one pass."""
    return df.groupBy("date").agg(F.count(signal_col).alias("n"), F.avg(signal_col).alias("mean"), F.stddev_samp(signal_col).alias("std"))

"""Cross-sectional signals per date, as column expressions and as frame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import add_expr, as_list
from ..functions.windows import average_rank

METHODS = ("zscore_tanh", "zscore", "zscore_clip", "rank", "decile")


def zscore_expr(x: Column, descending: bool = False, by: tuple[str, ...] = ("date",)) -> Column:
    """Value less the date's mean over its sample deviation; null where that isn't above 0."""
    spec = Window.partitionBy(*by)
    deviation = F.stddev_samp(x).over(spec)
    z = F.when(deviation > 0, (x - F.avg(x).over(spec)) / deviation)
    return -z if descending else z


def tanh_expr(x: Column, scale: float = 1.0) -> Column:
    return F.tanh(x * F.lit(float(scale)))


def clip_expr(x: Column, low: float = -3.0, high: float = 3.0) -> Column:
    """Clamp; null and NaN stay as they are."""
    return F.when(x.isNull() | F.isnan(x), x).when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def rank_expr(x: Column, descending: bool = False, by: tuple[str, ...] = ("date",)) -> Column:
    """Average rank within the date, from 1; null stays null."""
    return average_rank(x, list(by), descending)


def rank_scaled_expr(x: Column, descending: bool = False, by: tuple[str, ...] = ("date",)) -> Column:
    """Average rank scaled to -1..1 by the number of all rows of the date, nulls included; null for a single row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.lit(2.0) * (average_rank(x, list(by), descending) - 1) / F.nullif((n - 1).cast("double"), F.lit(0.0)) - 1


def decile_expr(x: Column, n_buckets: int = 10, descending: bool = False, by: tuple[str, ...] = ("date",)) -> Column:
    """1 above the top quantile, -1 up to the bottom one, else 0; linear quantiles of the date's values."""
    cut = F.percentile(x, F.array(F.lit(1.0 / n_buckets), F.lit((n_buckets - 1.0) / n_buckets))).over(Window.partitionBy(*by))
    side = F.when(x.isNull(), None).when(x > cut[1], 1).when(x <= cut[0], -1).otherwise(0)
    return -side if descending else side


def bucket_expr(x: Column, n_buckets: int = 10, by: tuple[str, ...] = ("date",)) -> Column:
    """Quantile bucket 0..n-1 within the date: how many inner quantiles lie below the value."""
    cuts = F.percentile(x, F.array(*[F.lit(k / n_buckets) for k in range(1, n_buckets)])).over(Window.partitionBy(*by))
    return F.when(x.isNotNull(), F.size(F.filter(cuts, lambda b: x > b)))


def z_score(df: DataFrame, columns, descending: bool = False) -> DataFrame:
    return add_expr(df, zscore_expr, columns, "z", descending=descending)


def tanh(df: DataFrame, columns, scale: float = 1.0) -> DataFrame:
    return add_expr(df, tanh_expr, columns, "tanh", scale=scale)


def clip(df: DataFrame, columns, low: float = -3.0, high: float = 3.0) -> DataFrame:
    return add_expr(df, clip_expr, columns, "clip", low=low, high=high)


def rank(df: DataFrame, columns, descending: bool = False) -> DataFrame:
    return add_expr(df, rank_expr, columns, "rank", descending=descending)


def rank_scaled(df: DataFrame, columns, descending: bool = False) -> DataFrame:
    """Like ``rank``, scaled; its own suffix keeps both apart."""
    return add_expr(df, rank_scaled_expr, columns, "rank_scaled", descending=descending)


def decile(df: DataFrame, columns, n_buckets: int = 10, descending: bool = False) -> DataFrame:
    return add_expr(df, decile_expr, columns, "decile", n_buckets=n_buckets, descending=descending)


def signal_expr(x: Column, method: str = "zscore_tanh", descending: bool = False, by: tuple[str, ...] = ("date",), **options) -> Column:
    """The expression of a method; options are those of the method."""
    if method == "zscore":
        return zscore_expr(x, descending, by)
    if method == "zscore_tanh":
        return tanh_expr(zscore_expr(x, descending, by), options.get("scale", 1.0))
    if method == "zscore_clip":
        return clip_expr(zscore_expr(x, descending, by), options.get("low", -3.0), options.get("high", 3.0))
    if method == "rank":
        return rank_scaled_expr(x, descending, by)
    if method == "decile":
        return decile_expr(x, options.get("n_buckets", 10), descending, by)
    raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")


def make_signal(df: DataFrame, columns, method: str = "zscore_tanh", **options) -> DataFrame:
    """Add ``{column}_{method}`` for each column in one projection."""
    return df.withColumns({f"{c}_{method}": signal_expr(F.col(c), method, **options) for c in as_list(columns)})

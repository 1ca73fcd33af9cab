"""Time-series features per ticker.

All of them are windows over the same partitioning and order, so a chain of them is one shuffle and one sort. Nothing
here sorts its input: a window's order suffices.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import as_list
from ..functions.windows import full, last, per_ticker, rolling_by_sums, rolling_covariance_by_sums

#: Windows from this length on are taken from running sums where values are on the scale of returns.
LONG = 20
MIN_TICKERS = 100


def add_log_returns(df: DataFrame) -> DataFrame:
    """``logret``: ln close - ln previous close; null in a ticker's first row."""
    return df.withColumn("logret", F.log("close") - F.log(F.lag("close").over(per_ticker())))


def add_fwd_returns(df: DataFrame) -> DataFrame:
    """``fwdret``: the next row's ``logret``."""
    return df.withColumn("fwdret", F.lead("logret").over(per_ticker()))


def add_fwdret_horizon(df: DataFrame, horizon=1) -> DataFrame:
    """``fwd_ret_{h}``: the sum of the ticker's next h log returns, null where they aren't all there."""
    out = {}
    for h in as_list(horizon):
        ahead = per_ticker().rowsBetween(1, h)
        out[f"fwd_ret_{h}"] = F.when(F.count("logret").over(ahead) == h, F.sum("logret").over(ahead))
    return df.withColumns(out)


def add_momentum(df: DataFrame, window=20) -> DataFrame:
    """``mom{w}``: close over the close w rows before, less 1; a null close stands for the last one before it."""
    filled = F.last("close", ignorenulls=True).over(per_ticker().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = df.withColumn("_close", filled)
    return base.withColumns({f"mom{w}": F.col("_close") / F.lag("_close", w).over(per_ticker()) - 1 for w in as_list(window)}).drop("_close")


def add_volatility(df: DataFrame, window=20, by_sums: bool = True) -> DataFrame:
    """``std{w}``: rolling sample deviation of ``logret`` over w returns."""
    windows = as_list(window)
    long = [w for w in windows if by_sums and w >= LONG]
    short = [w for w in windows if w not in long]
    x = F.col("logret")
    if short:
        df = df.withColumns({f"std{w}": full(F.stddev_samp(x), x, per_ticker(), w) for w in short})
    if long:
        df = rolling_by_sums(df, x, long, per_ticker(), {"std": "std{n}"})
    return df


def add_dollar_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("dollar_volume", F.col("close") * F.col("volume"))


def add_adv(df: DataFrame, window=20) -> DataFrame:
    """``adv{w}``: rolling mean of the dollar volume over a full window."""
    if "dollar_volume" not in df.columns:
        df = add_dollar_volume(df)
    x = F.col("dollar_volume")
    return df.withColumns({f"adv{w}": full(F.avg(x), x, per_ticker(), w) for w in as_list(window)})


def add_log_adv(df: DataFrame, window=20, by_sums: bool = True) -> DataFrame:
    """``log_adv{w}``: the logarithm of the rolling mean dollar volume."""
    if "dollar_volume" not in df.columns:
        df = add_dollar_volume(df)
    windows = as_list(window)
    long = [w for w in windows if by_sums and w >= LONG]
    x = F.col("dollar_volume")
    out = {f"log_adv{w}": F.log(full(F.avg(x), x, per_ticker(), w)) for w in windows if w not in long}
    df = df.withColumns(out) if out else df
    if long:
        df = rolling_by_sums(df, x.cast("double"), long, per_ticker(), {"mean": "log_adv{n}"})
        # a mean of positive values that cancels to 0 or below is no mean
        df = df.withColumns({f"log_adv{w}": F.when(F.col(f"log_adv{w}") > 0, F.log(f"log_adv{w}")) for w in long})
    return df


def market_returns(df: DataFrame, min_tickers: int = MIN_TICKERS) -> DataFrame:
    """date, mkt_logret, n_tickers: the equal-weight mean return of each date with enough tickers."""
    by = df.groupBy("date").agg(F.avg("logret").alias("mkt_logret"), F.count("logret").alias("n_tickers"))
    return by.withColumn("mkt_logret", F.when(F.col("n_tickers") >= min_tickers, F.col("mkt_logret")))


def add_market_return(df: DataFrame, min_tickers: int = MIN_TICKERS) -> DataFrame:
    """Join the market's return to each row. The joined side has one row per date, so it is broadcast."""
    return df.join(F.broadcast(market_returns(df, min_tickers)), "date", "left")


def market_variance(market: DataFrame, window=60) -> DataFrame:
    """date, mkt_var{w}: rolling sample variance of the market over the calendar of dates. market: date, mkt_logret."""
    return _with_variance(market, as_list(window)).select("date", *[f"mkt_var{w}" for w in as_list(window)])


def _with_variance(market: DataFrame, windows: list[int]) -> DataFrame:
    """``market`` with ``mkt_var{w}``."""
    calendar = Window.orderBy("date")  # one row per date
    x = F.col("mkt_logret")
    return market.withColumns({f"mkt_var{w}": full(F.var_samp(x), x, calendar, w) for w in windows})


def add_beta(df: DataFrame, window=60, min_tickers: int = MIN_TICKERS, by_sums: bool = True) -> DataFrame:
    """``beta{w}``: rolling covariance with the market over the ticker's rows, by the market's variance over the calendar.

    Adds ``mkt_logret`` and ``n_tickers`` where they aren't there yet.
    """
    windows = as_list(window)
    if "mkt_logret" in df.columns:
        market = df.groupBy("date").agg(F.max("mkt_logret").alias("mkt_logret"))
        market = _with_variance(market, windows).drop("mkt_logret")
    else:
        market = _with_variance(market_returns(df, min_tickers), windows)
    joined = df.join(F.broadcast(market), "date", "left")  # one row per date
    both = F.col("logret") + F.col("mkt_logret")
    long = [w for w in windows if by_sums and w >= LONG]
    covariance = {}
    for w in windows:
        if w not in long:
            frame = last(per_ticker(), w)
            covariance[f"_cov{w}"] = F.when(F.count(both).over(frame) == w, F.covar_samp("logret", "mkt_logret").over(frame))
    if covariance:
        joined = joined.withColumns(covariance)
    if long:
        joined = rolling_covariance_by_sums(joined, F.col("logret"), F.col("mkt_logret"), long, per_ticker(), "_cov{n}")
    out = joined.withColumns({f"beta{w}": F.col(f"_cov{w}") / F.nullif(F.col(f"mkt_var{w}"), F.lit(0.0)) for w in windows})
    return out.drop(*[f"{c}{w}" for w in windows for c in ("mkt_var", "_cov")])


def missing_days(df: DataFrame) -> DataFrame:
    """``missing_days``: calendar days without a row since the ticker's row before."""
    return df.withColumn("missing_days", F.datediff("date", F.lag("date").over(per_ticker())) - 1)


def build_features(
    prices: DataFrame,
    beta_windows: Iterable[int] = (60, 252),
    windows: Iterable[int] = (5, 10, 20, 60, 120, 252),
    min_tickers: int = MIN_TICKERS,
) -> DataFrame:
    """All features of the research panel: returns, market, betas, momentum, volatility, dollar volume and its means."""
    windows = list(windows)
    df = add_fwd_returns(add_log_returns(prices))
    df = add_beta(df, list(beta_windows), min_tickers)
    df = add_volatility(add_momentum(df, windows), windows)
    return add_log_adv(add_dollar_volume(df), windows)

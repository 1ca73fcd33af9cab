"""The queries of the driver contract: each takes (spark, sf_dir).

Doubles are rounded, as sums of doubles depend on their order in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import fdr, inspection, reports, risk, signals, validation
from ..sources import panels, workspace
from ..sources import prices as files

Query = Callable[[SparkSession, str], DataFrame]

SIGNALS = ("mom5", "std5", "logret")
METHODS = ("zscore_tanh", "zscore_clip", "rank", "decile")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to ``digits`` decimals, and no negative zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def rounded_correlations(df: DataFrame, digits: int = 9) -> DataFrame:
    """``rounded`` for a column ``corr`` from -1 to 1 of very many rows: the slow decimal rounding only near ties."""
    scale, x = F.lit(10.0**digits), F.col("corr")
    whole = F.rint(x * scale)
    near = (F.abs(x) <= 1.5) & (F.abs(x * scale - whole) < 0.499)
    return df.withColumn("corr", F.when(near, whole / scale).otherwise(F.round(x, digits)) + F.lit(0.0))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.daily_panel(spark, sf_dir).where("close > 0 AND volume > 0")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.weekly_panel(spark, sf_dir)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.monthly_panel(spark, sf_dir)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, close, logret, fwdret, mom5, std5: what signals and their evaluation start from."""
    df = ft.add_fwd_returns(ft.add_log_returns(prices(spark, sf_dir).select("ticker", "date", "close")))
    return ft.add_volatility(ft.add_momentum(df, 5), 5)


def _daily(build: Callable[[DataFrame], DataFrame], *columns: str, digits: int = 9) -> Query:
    """A query over the daily panel: ticker, date and some columns of what ``build`` makes."""
    return lambda spark, sf_dir: rounded(build(prices(spark, sf_dir)).select("ticker", "date", *columns), digits)


def _returns(build: Callable[[DataFrame], DataFrame], *columns: str, digits: int = 9) -> Query:
    return _daily(lambda df: build(ft.add_log_returns(df)), *columns, digits=digits)


def _signal(x: Callable[[Column], Column], name: str) -> Query:
    return lambda spark, sf_dir: rounded(base(spark, sf_dir).select("ticker", "date", x(F.col("mom5")).alias(name)))


def etl_clean_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts, positive rows, distinct: the cleaning step over the daily panel and itself again."""
    twice = panels.daily_panel(spark, sf_dir)
    twice = twice.unionByName(twice)
    cast = twice.select("ticker", F.col("date").cast("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("bigint").alias("volume"))
    return rounded(cast.where("close > 0 AND volume > 0").distinct())


def market_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ft.add_market_return(ft.add_log_returns(prices(spark, sf_dir)))
    return rounded(df.select("ticker", "date", "mkt_logret", "n_tickers"))


def market_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = ft.market_returns(ft.add_log_returns(prices(spark, sf_dir)))
    return rounded(ft.market_variance(market, 5))


def features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features on the weekly panel, with all windows that the operator builds by itself."""
    df = ft.build_features(weekly(spark, sf_dir), min_tickers=20)
    exact = ("close", "dollar_volume")  # quotients of decimals: fewer decimals would put some on the edge of rounding
    columns = [c for c in df.columns if c not in ("open", "high", "low")]
    return df.select(*[(F.round(c, 9 if c in exact else 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.select(*columns).dtypes])


def rolling_beta_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ft.add_beta(ft.add_log_returns(weekly(spark, sf_dir).select("ticker", "date", "close")), (60, 252), min_tickers=20)
    return rounded(df.select("ticker", "date", "beta60", "beta252"), 6)


def ic(spark: SparkSession, sf_dir: str, method: str = "spearman") -> DataFrame:
    return ev.compute_ic(base(spark, sf_dir), "mom5", "fwdret", method)


def weekly_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ft.add_fwd_returns(ft.add_log_returns(weekly(spark, sf_dir).select("ticker", "date", "close")))
    return ev.compute_ic(ft.add_momentum(df, 5), "mom5", "fwdret")


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.decile_longshort_returns(base(spark, sf_dir), "mom5")


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signal, pvalue: a fixed spread of p-values, one per part brand, some missing."""
    brands = panels.read(spark, sf_dir, "part").select(F.col("p_brand").alias("signal")).distinct()
    number = F.regexp_extract("signal", r"(\d+)", 1).cast("bigint")
    p = F.pmod(number * number, F.lit(97)) * F.pmod(number, F.lit(7)) / F.lit(1000.0)
    return brands.select("signal", F.when(F.pmod(number, F.lit(11)) != 0, p).alias("pvalue"))


def ic_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.ic_pvalue_nw(ev.newey_west(weekly_ic(spark, sf_dir))))


def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = validation.rolling_purged_embargoed_splits(weekly(spark, sf_dir), 52, 13, 16, 4, 2)
    return folds.withColumn("fold", F.col("fold").cast("bigint"))


def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per date with the closes of all its tickers, as text, so that any tickers have one schema."""
    wide = panels.wide_cells(prices(spark, sf_dir), "close")
    cell = lambda c: F.concat_ws("=", c["ticker"], F.round(c["value"], 6).cast("decimal(28,6)").cast("string"))
    return wide.select("date", F.size("cells").cast("bigint").alias("n_tickers"), F.array_join(F.transform("cells", cell), ",").alias("closes"))


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file path as a whole: one CSV folder per ticker, scanned, cleaned, written in order and read back."""
    raw = prices(spark, sf_dir).select("ticker", *[F.col(c).alias(c.capitalize()) for c in ("date", "open", "high", "low", "close")], F.col("close").alias("Adj Close"), F.col("volume").alias("Volume"))
    folder = workspace.new_folder(spark, "csv-scan")
    files.write_csv_per_ticker(raw, f"{folder}/raw")
    return rounded(files.etl(spark, f"{folder}/raw/*/*.csv", f"{folder}/prices"))


def frame_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal through its frame operator."""
    df = base(spark, sf_dir).select("ticker", "date", "mom5", "std5")
    df = signals.clip(signals.tanh(signals.z_score(df, ["mom5", "std5"]), "mom5", 2.0), "mom5", -0.5, 0.5)
    return rounded(signals.decile(signals.rank_scaled(signals.rank(df, "mom5"), "mom5"), "mom5").drop("mom5", "std5"))


def rolling_beta_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betas of a panel that has the market's return already."""
    df = ft.add_beta(ft.add_market_return(ft.add_log_returns(prices(spark, sf_dir))), [5, 10])
    return rounded(df.select("ticker", "date", "beta5", "beta10"), 6)


def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.add_log_returns(monthly(spark, sf_dir))


QUERIES: dict[str, Query] = {
    # sources and cleaning
    "etl_clean_prices": etl_clean_prices,
    "csv_scan": csv_scan,
    "panel_daily": lambda s, d: rounded(prices(s, d)),
    "panel_monthly": lambda s, d: rounded(monthly(s, d)),
    "panel_weekly": lambda s, d: rounded(weekly(s, d)),
    "sample_tickers": lambda s, d: inspection.rows_per_ticker(panels.sample_tickers(prices(s, d), 10)),
    # features per ticker
    "log_returns": _returns(lambda df: df, "logret"),
    "fwd_returns": _returns(ft.add_fwd_returns, "fwdret"),
    "fwd_returns_h5": _returns(lambda df: ft.add_fwdret_horizon(df, 5), "fwd_ret_5"),
    "momentum_multi": _daily(lambda df: ft.add_momentum(df, [5, 10, 20]), "mom5", "mom10", "mom20"),
    "volatility_multi": _returns(lambda df: ft.add_volatility(df, [5, 10, 20]), "std5", "std10", "std20"),
    "dollar_volume": _daily(ft.add_dollar_volume, "dollar_volume"),
    "adv": _daily(lambda df: ft.add_adv(df, [5, 20]), "adv5", "adv20", digits=6),
    "log_adv": _daily(lambda df: ft.add_log_adv(df, [5, 20]), "log_adv5", "log_adv20"),
    "market_return": market_return,
    "market_var": market_var,
    "rolling_beta": _returns(lambda df: ft.add_beta(df, [5, 10]), "beta5", "beta10", digits=6),
    "rolling_beta_weekly": rolling_beta_weekly,
    "rolling_beta_joined": rolling_beta_joined,
    "features_all": features_all,
    "missing_days": _daily(ft.missing_days, "missing_days"),
    # signals per date
    "zscore": _signal(signals.zscore_expr, "mom5_z"),
    "zscore_desc": _signal(lambda x: signals.zscore_expr(x, descending=True), "mom5_z"),
    "tanh": _signal(lambda x: signals.tanh_expr(x, 2.0), "mom5_tanh"),
    "clip": _signal(lambda x: signals.clip_expr(x, -0.5, 0.5), "mom5_clip"),
    "rank_avg": _signal(signals.rank_expr, "mom5_rank"),
    "rank_desc": _signal(lambda x: signals.rank_expr(x, descending=True), "mom5_rank"),
    "rank_scaled": _signal(signals.rank_scaled_expr, "mom5_rank_scaled"),
    "decile": _signal(signals.decile_expr, "mom5_decile"),
    "quintile_n5": _signal(lambda x: signals.decile_expr(x, 5), "mom5_decile"),
    "signal_zscore_tanh": lambda s, d: rounded(signals.make_signal(base(s, d), ["mom5", "std5"]).select("ticker", "date", "mom5_zscore_tanh", "std5_zscore_tanh")),
    "signal_zscore_clip": lambda s, d: rounded(signals.make_signal(base(s, d), "mom5", "zscore_clip", low=-1, high=1).select("ticker", "date", "mom5_zscore_clip")),
    "frame_signals": frame_signals,
    # evaluation
    "ic_spearman": lambda s, d: rounded(ic(s, d)),
    "ic_pearson": lambda s, d: rounded(ic(s, d, "pearson")),
    "ic_summary": lambda s, d: rounded(ev.summarize_ic(ic(s, d))),
    "ic_by_method": lambda s, d: rounded(ev.compare_methods_ic(base(s, d), "mom5", METHODS)),
    "ic_dict": lambda s, d: rounded(ev.build_ic(base(s, d), "mom5", ("zscore", "rank"))),
    "newey_west": lambda s, d: rounded(ev.newey_west(weekly_ic(s, d)), 7),
    "ic_pvalue": ic_pvalue,
    "ic_decay": lambda s, d: rounded(ev.ic_decay(base(s, d), "mom5", (1, 2, 5))),
    "autocorr_flat": lambda s, d: rounded(ev.autocorrelation(weekly_ic(s, d), "ic", (1, 5))),
    "autocorr_by_ticker": lambda s, d: rounded(ev.autocorrelation(base(s, d), "logret", (1, 5), "ticker")),
    "recent_coverage": lambda s, d: rounded(ev.get_recent_coverage(base(s, d), "mom5", 10)),
    "turnover": lambda s, d: rounded(ev.compute_stability(base(s, d), "mom5")),
    "turnover_multi": lambda s, d: rounded(ev.get_stability_DF(base(s, d), ["mom5", "std5"])),
    "series_summary": lambda s, d: rounded(ev.series_summary(spread(s, d), ["long_ret", "short_ret", "spread_ret"])),
    "long_short": lambda s, d: rounded(spread(s, d)),
    "sharpe": lambda s, d: rounded(ev.sharpe_ratio(spread(s, d), "spread_ret")),
    "max_drawdown": lambda s, d: rounded(ev.max_drawdown(spread(s, d), "spread_ret")),
    "signal_report": lambda s, d: rounded(reports.signal_report(base(s, d), "mom5"), 7),
    "compare_reports": lambda s, d: rounded(reports.compare_reports(base(s, d), SIGNALS), 7),
    "decile_spread": lambda s, d: rounded(ev.decile_spread(base(s, d), "mom5")),
    "cumulative_ic": lambda s, d: rounded(ev.cumulative_ic(ic(s, d))),
    "ic_distribution": lambda s, d: rounded(ev.ic_distribution(ic(s, d))),
    "coverage_per_date": lambda s, d: ev.coverage_per_date(base(s, d), "mom5"),
    "moments_per_date": lambda s, d: rounded(ev.moments_per_date(base(s, d), "mom5")),
    "one_pager": lambda s, d: rounded(ev.one_pager(base(s, d), "mom5")),
    "heatmap": lambda s, d: rounded(ev.heatmap(base(s, d), "mom5")),
    # multiple testing
    "bh": lambda s, d: fdr.benjamini_hochberg(pvalues(s, d), 0.2).select("signal", "survives_bh"),
    "by": lambda s, d: fdr.benjamini_yekutieli(pvalues(s, d), 0.2).select("signal", "survives_by"),
    "pi0": lambda s, d: rounded(fdr.estimate_pi0(pvalues(s, d))),
    "qvalues": lambda s, d: rounded(fdr.qvalues(pvalues(s, d)).select("signal", "qvalue")),
    "fdr_report": lambda s, d: rounded(fdr.fdr_report(pvalues(s, d), 0.2)),
    # validation
    "cv_folds": cv_folds,
    "fold_sizes": lambda s, d: validation.fold_rows(weekly(s, d), validation.rolling_purged_embargoed_splits(weekly(s, d), 52, 13, 16, 4, 2)).groupBy(F.col("fold").cast("bigint").alias("fold"), "part").agg(F.count(F.lit(1)).alias("n")),
    # inspection
    "semiannual_stats": lambda s, d: rounded(inspection.half_years(ft.add_log_returns(weekly(s, d)), "logret")),
    "feature_quantiles": lambda s, d: rounded(inspection.quantiles(base(s, d), ["mom5", "std5"], (0.01, 0.5, 0.99))),
    "feature_corr_matrix": lambda s, d: rounded(inspection.correlation_matrix(base(s, d), ["mom5", "std5", "logret"])),
    "describe": lambda s, d: rounded(inspection.describe(base(s, d), ["mom5", "logret"])),
    "histogram": lambda s, d: inspection.histogram(base(s, d), "logret", -5.0, 5.0, 100).withColumn("bin", F.col("bin").cast("bigint")),
    "null_counts": lambda s, d: inspection.null_counts(base(s, d), ["mom5", "std5", "logret", "fwdret"]),
    "unique_counts": lambda s, d: inspection.unique_counts(prices(s, d)),
    "rows_per_ticker": lambda s, d: inspection.rows_per_ticker(prices(s, d)),
    "pivot_wide": pivot_wide,
    "latest_cross_section": lambda s, d: rounded(inspection.latest(base(s, d))),
    "normal_quantiles": lambda s, d: rounded(inspection.normal_quantiles(base(s, d), "logret", 9)),
    # correlation structure
    "mp_bounds": lambda s, d: rounded(risk.mp_bounds(monthly(s, d))),
    "pairwise_correlations": lambda s, d: rounded_correlations(risk.all_correlations(monthly_returns(s, d), "logret")),
    "cleaned_correlations": lambda s, d: rounded_correlations(risk.cleaned_correlations(monthly_returns(s, d), "logret"), 6),
    "absorption": lambda s, d: rounded(risk.absorption(monthly_returns(s, d), "logret", 5), 6),
    "communities": lambda s, d: risk.communities(monthly_returns(s, d), "logret"),
}

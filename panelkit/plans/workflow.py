"""The whole way from raw price files to a report on signals, as three steps that each leave a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluation, fdr, features, reports, signals
from ..sources import prices


def build_prices(spark: SparkSession, raw: str, out: str) -> DataFrame:
    """Raw CSV files, one per ticker, to a clean panel in the order of ticker and date."""
    return prices.etl(spark, raw, out)


def build_features(spark: SparkSession, price_path: str, out: str, min_tickers: int = features.MIN_TICKERS, windows: Iterable[int] = (5, 10, 20, 60, 120, 252), beta_windows: Iterable[int] = (60, 252)) -> DataFrame:
    """The clean panel to the feature table."""
    prices.write_features(features.build_features(prices.read_prices(spark, price_path), beta_windows, windows, min_tickers), out)
    return prices.read_prices(spark, out)


def compare_signals(panel: DataFrame, columns: Iterable[str], method: str = "zscore_tanh", alpha: float = fdr.ALPHA, fwdret: str = "fwdret") -> DataFrame:
    """One row per feature's signal with all statistics, and what survives the control of false discoveries.

    Only the columns that are needed are read from the feature table.
    """
    columns = list(columns)
    made = signals.make_signal(panel.select("ticker", "date", fwdret, *columns), columns, method)
    report = reports.compare_reports(made, [f"{c}_{method}" for c in columns], fwdret)
    return fdr.fdr_report(report, alpha, "ic_pval_nw")


def inspect_signal(panel: DataFrame, column: str, method: str = "zscore_tanh") -> DataFrame:
    """Per date: coverage, mean and deviation of one signal."""
    made = signals.make_signal(panel.select("ticker", "date", column), column, method)
    return evaluation.one_pager(made, f"{column}_{method}").orderBy("date")

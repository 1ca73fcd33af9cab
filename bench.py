"""Headline queries on one machine: prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the data and the cores. Each query is
run once to warm up and then three times; its figure is the median of wall seconds until all its rows are made.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from panelkit.operators import evaluation as ev
from panelkit.operators import features as ft
from panelkit.operators import fdr, reports
from panelkit.plans import queries
from panelkit.session import session

RUNS = 3


def base_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ft.add_fwd_returns(ft.add_log_returns(queries.weekly(spark, sf_dir).select("ticker", "date", "close", "volume")))
    return ft.add_volatility(ft.add_momentum(df, [5, 20, 60]), [5, 20, 60])


def features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full feature build: 32 columns, windows from 5 to 252."""
    return ft.build_features(queries.weekly(spark, sf_dir), min_tickers=20)


def rolling_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.add_beta(ft.add_log_returns(queries.weekly(spark, sf_dir)), (60, 252), 20)


def ic_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.compute_ic(base_weekly(spark, sf_dir), "mom20", "fwdret")


def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.newey_west(ic_spearman(spark, sf_dir))


def ic_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ic_decay(base_weekly(spark, sf_dir), "mom20")


def compare_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compare_reports(base_weekly(spark, sf_dir), ["mom5", "mom20", "mom60", "std5", "std20", "std60"])


def fdr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fdr.fdr_report(compare_reports(spark, sf_dir).select("signal", "ic_pval_nw"), 0.2, "ic_pval_nw")


def seconds(run) -> float:
    begun = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 12g --conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false pyspark-shell")
    spark = session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for query in (features_all, rolling_beta, ic_spearman, newey_west, ic_decay, compare_reports, fdr_report):
        seconds(lambda q=query: q(spark, sf_dir))
        out[query.__name__] = round(statistics.median(seconds(lambda q=query: q(spark, sf_dir)) for _ in range(RUNS)), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

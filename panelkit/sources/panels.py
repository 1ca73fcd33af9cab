"""Panels (ticker, date, open, high, low, close, volume) from transaction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day of ``events``: first, greatest, least and last value, and their number. Picks only, no sums."""
    at = F.struct("ts", "event_id")
    return (
        read(spark, sf_dir, "events")
        .select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("date").alias("date"), "ts", "event_id", "value")
        .groupBy("ticker", "date")
        .agg(
            F.min_by("value", at).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", at).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def _shipments(spark: SparkSession, sf_dir: str, date: Column) -> DataFrame:
    """Per supplier and period of ``lineitem``: quantity, and the mean price of it. Sums are exact decimals."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    unit = (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return (
        read(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").cast("string").alias("ticker"), date.cast("date").alias("date"), unit, at.alias("at"), money("l_quantity").alias("q"), money("l_extendedprice").alias("p"))
        .groupBy("ticker", "date")
        .agg(
            F.min_by("unit", "at").alias("open"),
            F.max("unit").alias("high"),
            F.min("unit").alias("low"),
            (F.sum("p").cast("double") / F.sum("q").cast("double")).alias("close"),
            F.sum("q").cast("bigint").alias("volume"),
        )
    )


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipments(spark, sf_dir, F.date_trunc("month", F.col("l_shipdate")))


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shipments(spark, sf_dir, F.date_trunc("week", F.col("l_shipdate")))


def wide(panel: DataFrame, value: str, tickers: list[str] | None = None) -> DataFrame:
    """One row per date, one column per ticker. Name the tickers where they are known: it saves a pass."""
    return panel.groupBy("date").pivot("ticker", tickers).agg(F.first(value))


def wide_cells(panel: DataFrame, value: str) -> DataFrame:
    """date, cells: one row per date with (ticker, value) of all its tickers, in their order; the schema holds for any tickers."""
    first = panel.groupBy("ticker", "date").agg(F.first(value).alias("value"))
    return first.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("ticker", "value"))).alias("cells"))


def sample_tickers(panel: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """All rows of ``n`` tickers, drawn by a seeded hash, so the same ones each time."""
    drawn = panel.select("ticker").distinct().orderBy(F.md5(F.concat_ws(":", "ticker", F.lit(seed)).cast("binary")), "ticker").limit(n)
    return panel.join(F.broadcast(drawn), "ticker", "left_semi")

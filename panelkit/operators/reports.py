"""One row of statistics per signal, for any number of signals in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import as_list, known, over_zero
from ..functions.stats import pearson, sharpe, two_sided_pvalue
from ..functions.windows import average_rank
from . import evaluation as ev
from .signals import decile_expr

FIELDS = (
    "signal", "ic_mean", "ic_std", "ic_ir", "ic_tstat_naive", "ic_tstat_nw", "ic_pval_nw", "ic_lag1_autocorr", "hit_rate",
    "n_days", "recent_coverage", "avg_turnover", "long_short_sharpe", "long_short_max_dd",
)


def compare_reports(df: DataFrame, signal_cols, fwdret_col: str = "fwdret", n_days: int = 365) -> DataFrame:
    """``FIELDS`` for each signal.

    Rows move three times, whatever the number of signals: by ticker for the signals' changes, by signal and date for
    ranks, buckets and all statistics of a date, and, as one row per signal and date, by signal for the series.
    """
    signals, key = as_list(signal_cols), ["signal", "date"]
    per_ticker = Window.partitionBy("ticker").orderBy("date")
    value = lambda c: F.col(c).cast("double")
    triples = [F.struct(F.lit(c).alias("signal"), value(c).alias("value"), F.col(f"_change{k}").alias("change")) for k, c in enumerate(signals)]
    changed = df.withColumns({f"_change{k}": F.abs(value(c) - F.lag(value(c)).over(per_ticker)) for k, c in enumerate(signals)})
    long = changed.select("date", value(fwdret_col).alias("fwd"), F.inline(F.array(*triples)))

    both = known(F.col("value")).isNotNull() & known(F.col("fwd")).isNotNull()
    ranked = long.withColumns({"x": F.when(both, F.col("value")), "y": F.when(both, F.col("fwd"))})
    ranked = ranked.select(*key, "value", "fwd", "change", average_rank(F.col("x"), key).alias("x"), average_rank(F.col("y"), key).alias("y"), decile_expr(F.col("value"), by=tuple(key)).alias("side"))
    leg = lambda side: F.when(F.col("side") == side, F.lit(side) * F.col("fwd"))
    dates = ranked.groupBy(*key).agg(
        pearson(F.col("x"), F.col("y")).alias("ic"),
        F.count("x").alias("pairs"),
        F.avg("change").alias("turnover"),
        F.count("value").alias("n_known"),
        F.count(F.lit(1)).alias("n_rows"),
        (F.avg(leg(1)) + F.avg(leg(-1))).alias("spread"),
    )

    series = Window.partitionBy("signal").orderBy("date")
    upto = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.last(F.when(F.col("pairs") > 0, F.struct("ic")), ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    gain = known(F.col("spread"))
    dates = dates.withColumns(
        {
            "before": F.when(F.col("pairs") > 0, before["ic"]),
            "recent": F.col("date") >= F.date_sub(F.max("date").over(Window.partitionBy("signal")), n_days),
            "gain": gain,
            "gains": F.when(gain.isNotNull(), F.sum(gain).over(upto)),
        }
    ).withColumn("drop", F.col("gains") - F.max("gains").over(upto))
    x = known(F.col("ic"))
    out = dates.groupBy("signal").agg(
        F.avg(x).alias("ic_mean"),
        F.stddev_samp(x).alias("ic_std"),
        F.avg((x > 0).cast("double")).alias("hit_rate"),
        F.when(F.sum("pairs") > 0, F.count(x)).alias("n_days"),
        pearson(x, known(F.col("before"))).alias("ic_lag1_autocorr"),
        ev.sorted_values(x).alias("_values"),
        F.avg("turnover").alias("avg_turnover"),
        (F.sum(F.when(F.col("recent"), F.col("n_known"))) / F.sum(F.when(F.col("recent"), F.col("n_rows"))).cast("double")).alias("recent_coverage"),
        sharpe(F.col("gain")).alias("long_short_sharpe"),
        F.min("drop").alias("long_short_max_dd"),
    )
    out = (
        out.withColumn("ic_ir", over_zero(F.col("ic_mean"), F.col("ic_std")))
        .withColumn("ic_tstat_naive", F.col("ic_ir") * F.sqrt(F.col("n_days").cast("double")))
        .withColumn("ic_tstat_nw", ev.newey_west_of(F.col("_values"), F.col("ic_mean"))["t_stat"])
        .withColumn("ic_pval_nw", two_sided_pvalue(F.col("ic_tstat_nw")))
    )
    return out.select(*FIELDS)


def signal_report(df: DataFrame, signal_col: str, fwd_ret_col: str = "fwdret") -> DataFrame:
    """``FIELDS`` of one signal."""
    return compare_reports(df, as_list(signal_col), fwd_ret_col)

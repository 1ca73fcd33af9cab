"""Control of false discoveries among many tested signals.

A table of tests has one row per signal, so ordering it as a whole is ordering a small table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.05
#: Below so many tests the share of true nulls is taken as 1.
MIN_TESTS = 20
LAMBDAS = tuple(0.05 * k for k in range(1, 20))


def smoothing_weights(lambdas: tuple[float, ...] = LAMBDAS) -> tuple[float, ...]:
    """Weights of the estimates at each lambda in the least-squares cubic's value at the last one."""
    x = np.array(lambdas)
    powers = np.vander((x - x.mean()) / (x[-1] - x.mean()), 4)
    return tuple(float(w) for w in powers[-1] @ np.linalg.pinv(powers))


def _valid(p: str) -> Column:
    return F.when(~F.isnan(F.col(p)), F.col(p).cast("double"))


def _ranked(df: DataFrame, p: str) -> DataFrame:
    """``_p``, its place among the valid ones, and their number; a missing p-value has neither."""
    base = df.withColumn("_p", _valid(p))
    place = F.row_number().over(Window.orderBy(F.col("_p").asc_nulls_last()))
    return base.withColumns({"_i": F.when(F.col("_p").isNotNull(), place), "_n": F.count("_p").over(Window.partitionBy())})


def _step_up(ranked: DataFrame, alpha: float, out: str, harmonic: bool) -> DataFrame:
    """``out``: whether the place is at most the last one whose p-value is within its threshold."""
    everything = Window.partitionBy()
    share = F.lit(alpha) * (F.col("_i") / F.col("_n").cast("double"))
    if harmonic:
        share = share / F.sum(F.lit(1.0) / F.col("_i")).over(everything)
    last = F.max(F.when(F.col("_p") <= share, F.col("_i"))).over(everything)
    return ranked.withColumn(out, F.coalesce(F.col("_i") <= last, F.lit(False)))


def benjamini_hochberg(df: DataFrame, alpha: float = ALPHA, p: str = "pvalue", out: str = "survives_bh") -> DataFrame:
    return _step_up(_ranked(df, p), alpha, out, False).drop("_p", "_i", "_n")


def benjamini_yekutieli(df: DataFrame, alpha: float = ALPHA, p: str = "pvalue", out: str = "survives_by") -> DataFrame:
    return _step_up(_ranked(df, p), alpha, out, True).drop("_p", "_i", "_n")


def pi0_column(p: Column, window: Window | None = None) -> Column:
    """Share of true nulls, as an aggregate, or over a window."""
    over = (lambda c: c.over(window)) if window is not None else (lambda c: c)
    estimate = F.lit(0.0)
    for lam, w in zip(LAMBDAS, smoothing_weights(), strict=True):
        estimate = estimate + F.lit(w) * over(F.avg((p > F.lit(lam)).cast("double"))) / F.lit(1 - lam)
    return F.when(over(F.count(p)) < MIN_TESTS, F.lit(1.0)).otherwise(F.least(F.greatest(estimate, F.lit(0.0)), F.lit(1.0)))


def estimate_pi0(df: DataFrame, p: str = "pvalue") -> DataFrame:
    """pi0: one row."""
    return df.agg(pi0_column(_valid(p)).alias("pi0"))


def qvalues(df: DataFrame, p: str = "pvalue", out: str = "qvalue") -> DataFrame:
    return _with_q(_ranked(df, p), out).drop("_p", "_i", "_n")


def _with_q(ranked: DataFrame, out: str) -> DataFrame:
    pi0 = pi0_column(F.col("_p"), Window.partitionBy())
    raw = ranked.withColumn("_pi0", pi0).withColumn("_q", F.col("_pi0") * F.col("_n") * F.col("_p") / F.col("_i"))
    from_top = Window.orderBy(F.col("_i").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn(out, F.when(F.col("_p").isNotNull(), F.min("_q").over(from_top))).drop("_pi0", "_q")


def fdr_report(df: DataFrame, alpha: float = ALPHA, p: str = "pvalue") -> DataFrame:
    """The input with survives_bh, survives_by and qvalue, by p-value, missing ones last. A missing p-value never survives."""
    ranked = _ranked(df, p)
    out = _with_q(_step_up(_step_up(ranked, alpha, "survives_bh", False), alpha, "survives_by", True), "qvalue")
    return out.orderBy(F.col("_p").asc_nulls_last()).drop("_p", "_i", "_n")


FDR_report = fdr_report

"""Walk-forward splits with purging and embargo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_purged_embargoed_splits(dates: DataFrame, train_window: int, test_window: int, step: int, horizon: int, embargo: int) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end over the distinct dates of a table.

    ``horizon`` dates between train and test are purged; a step below test window plus embargo is an error.
    """
    if step < test_window + embargo:
        raise ValueError(f"step {step} is less than test window {test_window} plus embargo {embargo}")
    calendar = dates.select("date").where("date IS NOT NULL").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)  # one row per date
    n = calendar.agg(F.count(F.lit(1)).cast("int").alias("_n"))
    first = train_window + horizon
    starts = F.when(F.col("_n") - test_window >= first, F.sequence(F.lit(first), F.col("_n") - test_window, F.lit(step))).otherwise(F.array().cast("array<int>"))
    folds = n.select(F.posexplode(starts).alias("fold", "_s"))
    edges = F.array(
        F.struct(F.lit("train_start").alias("edge"), (F.col("_s") - horizon - train_window).alias("_i")),
        F.struct(F.lit("train_end").alias("edge"), (F.col("_s") - horizon - 1).alias("_i")),
        F.struct(F.lit("test_start").alias("edge"), F.col("_s").alias("_i")),
        F.struct(F.lit("test_end").alias("edge"), (F.col("_s") + test_window - 1).alias("_i")),
    )
    names = ["train_start", "train_end", "test_start", "test_end"]
    return folds.select("fold", F.inline(edges)).join(calendar, "_i").groupBy("fold").pivot("edge", names).agg(F.first("date")).select("fold", *names)


def fold_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, part, panel row): a row is in as many folds as hold its date. Folds are few, so they are broadcast."""
    ranges = folds.select("fold", F.inline(F.array(F.struct(F.lit("train").alias("part"), F.col("train_start").alias("_from"), F.col("train_end").alias("_to")), F.struct(F.lit("test").alias("part"), F.col("test_start").alias("_from"), F.col("test_end").alias("_to")))))
    dates = panel.select("date").distinct().join(F.broadcast(ranges), F.col("date").between(F.col("_from"), F.col("_to"))).select("date", "fold", "part")
    return panel.join(dates, "date")

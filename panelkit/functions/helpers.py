"""Small helpers of the expression surface."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(x) -> list:
    """A scalar becomes a list of one; an iterable becomes a list; None is an error."""
    if x is None:
        raise TypeError("a value or an iterable of values is needed")
    if isinstance(x, str | Column) or not isinstance(x, Iterable):
        return [x]
    return list(x)


def add_expr(df: DataFrame, expr: Callable[..., Column], columns, suffix: str = "expr", **kwargs) -> DataFrame:
    """Add ``expr(column, **kwargs)`` of each column as ``{column}_{suffix}``, in one projection."""
    return df.withColumns({f"{c}_{suffix}": expr(F.col(c), **kwargs) for c in as_list(columns)})


def known(x: Column) -> Column:
    """NaN and infinities become null: what is undefined is null here."""
    x = x.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def over_zero(x: Column, y: Column) -> Column:
    """``x / y``, null where ``y`` is 0."""
    return x / F.nullif(y, F.lit(0.0))

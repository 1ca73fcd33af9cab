"""Aggregates and scalar statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation of the normal tail by Hart (1968) in the double-precision form of West (2005),
# highest power first, and the continued fraction beyond its range.
TAIL_NUMERATOR = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_DENOMINATOR = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_BREAK, TAIL_END, ROOT_2_PI = 7.07106781186547, 37.0, 2.506628274631000502


def normal_tail(x: Column) -> Column:
    """``1 - Phi(x)`` for ``x >= 0``, to double precision; built from arithmetic, so it stays in generated code."""

    def poly(values: tuple[float, ...]) -> Column:
        out = F.lit(values[0])
        for v in values[1:]:
            out = out * x + F.lit(v)
        return out

    near = F.exp(-x * x / 2) * poly(TAIL_NUMERATOR) / poly(TAIL_DENOMINATOR)
    deep = x + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        deep = x + F.lit(k) / deep
    far = F.exp(-x * x / 2) / deep / ROOT_2_PI
    return F.when(x > TAIL_END, F.lit(0.0)).when(x < TAIL_BREAK, near).when(x.isNotNull(), far)


def two_sided_pvalue(t: Column) -> Column:
    """``2 (1 - Phi(|t|))``; null stays null."""
    return F.lit(2.0) * normal_tail(F.abs(t))


def compute_pval_from_tstat(t: Column | str) -> Column:
    """Two-sided normal p-value of a t-statistic column, null-safe per element."""
    return two_sided_pvalue(F.col(t) if isinstance(t, str) else t)


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over rows where both are there; null where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def sharpe(returns: Column, periods_per_year: int = 252) -> Column:
    """Mean over population deviation, annualised; an aggregate."""
    return F.avg(returns) / F.nullif(F.stddev_pop(returns), F.lit(0.0)) * F.sqrt(F.lit(float(periods_per_year)))


def newey_west_lag(n: Column) -> Column:
    """Bartlett lag length ``max(1, floor(4 (n / 100)^(2/9)))``."""
    return F.greatest(F.lit(1), F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0) / 9)).cast("int"))

"""Column helpers with the arithmetic of numeric rasters: NaN is NULL, k/0 is infinite, 0/0 is NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def divide(n: Column, d: Column) -> Column:
    n, d = n.cast("double"), d.cast("double")
    return F.coalesce(F.try_divide(n, d), F.when((d == 0) & (n != 0), F.signum(n) * F.lit(INF)))


def clamp(v: Column, low: float, high: float) -> Column:
    """Saturates; NULL stays NULL (greatest and least alone would drop it)."""
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def no_nan(v: Column) -> Column:
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def mean_of(cols: list[Column]) -> Column:
    """Mean over columns of a row, NULLs left out."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.try_divide(total, reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols]))


def sd_of(cols: list[Column]) -> Column:
    """Sample standard deviation over columns of a row, NULLs left out."""
    m, n = mean_of(cols), reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    squares = reduce(lambda a, b: a + b, [F.coalesce((c - m) * (c - m), F.lit(0.0)) for c in cols])
    return F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1)))


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate over complete pairs; NULL on a constant side."""
    a, b = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)) for c in (x, y))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))

"""Two-sided p-values of correlations: Student's t through the regularised incomplete beta function, and
Spearman's statistic."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b), by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation r over n pairs; None below three pairs."""
    if r is None or r != r or n < 3:
        return None
    return incomplete_beta((n - 2) / 2, 0.5, max(0.0, 1 - r * r))


#: Pairs up to which all orders are counted.
EXACT_RANKS = 9
#: Coefficients of the Edgeworth series of Spearman's statistic (algorithm AS 89).
EDGEWORTH = (0.2274, 0.2531, 0.1745, 0.0758, 0.1033, 0.3932, 0.0879, 0.0151, 0.0072, 0.0831, 0.0131, 0.00046)


@lru_cache
def rank_distances(n: int) -> tuple[int, ...]:
    """How many orders of n ranks have each sum of squared rank differences, from 0 in steps of 2."""
    of: dict[tuple[int, int], int] = {(0, 0): 1}  # (ranks used as bits, sum): orders
    for k in range(n):
        more: dict[tuple[int, int], int] = {}
        for (used, s), c in of.items():
            for j in range(n):
                if not used >> j & 1:
                    at = used | 1 << j, s + (j - k) ** 2
                    more[at] = more.get(at, 0) + c
        of = more
    out = [0] * (n * (n * n - 1) // 6 + 1)
    for (_, s), c in of.items():
        out[s // 2] += c
    return tuple(out)


def rank_tail(s: int, n: int) -> float:
    """P(S >= s) of the sum S of squared rank differences, an even number, of n independent pairs."""
    if s <= 0:
        return 1.0
    if s > n * (n * n - 1) // 3:
        return 0.0
    if n <= EXACT_RANKS:
        return sum(rank_distances(n)[-(-s // 2) :]) / math.factorial(n)
    c, b = EDGEWORTH, 1 / n
    x = (6 * (s - 1) * b / (n * n - 1) - 1) * math.sqrt(n - 1)
    y = x * x
    u = x * b * (c[0] + b * (c[1] + c[2] * b) + y * (-c[3] + b * (c[4] + c[5] * b) - y * b * (c[6] + c[7] * b - y * (c[8] - c[9] * b + y * b * (c[10] - c[11] * y)))))
    return min(1.0, max(0.0, u / math.exp(y / 2) + math.erfc(x / math.sqrt(2)) / 2))


def spearman_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation of n pairs without ties: exact for few, else by an Edgeworth
    series; by Student's t from 1290 pairs on."""
    if r is None or r != r or n < 3:
        return None
    if n >= 1290:
        return correlation_p(r, n)
    s = 2 * round((n**3 - n) * (1 - r) / 12)
    one = rank_tail(s, n) if s > (n**3 - n) / 6 else 1 - rank_tail(s + 2, n)
    return min(1.0, 2 * one)


@F.pandas_udf(DoubleType())
def correlation_p_udf(r: pd.Series, n: pd.Series, ranks: pd.Series) -> pd.Series:
    """ranks: whether r is of ranks without ties."""
    return pd.Series([(spearman_p if x else correlation_p)(None if pd.isna(a) else a, int(b)) for a, b, x in zip(r, n, ranks, strict=True)], dtype="float64")

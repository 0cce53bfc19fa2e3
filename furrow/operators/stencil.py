"""Neighbourhood sums on sparse pixel tables.

Every pixel hands its weighted value to its neighbours and one aggregate adds them up: partial sums
form before the shuffle, so rows of a stored tile mostly meet there, and nothing is sorted or joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = dict[tuple[int, int], float]

#: Weights by (down, right) of the neighbour that is read.
LAPLACIAN: Kernel = {(0, 0): -4.0, (-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0}
SOBEL_DOWN: Kernel = {(a, b): float(a * (2 - abs(b))) for a in (-1, 0, 1) for b in (-1, 0, 1)}
SOBEL_RIGHT: Kernel = {(a, b): float(b * (2 - abs(a))) for a in (-1, 0, 1) for b in (-1, 0, 1)}


def focal(pixels: DataFrame, keys: list[str], value: str, kernels: dict[str, Kernel], need_centre: bool) -> DataFrame:
    """keys, y, x and a sum per kernel, NULL neighbours left out, for cells that have a row.

    need_centre: only for cells with a value themselves. A cell with no value in reach is NULL.
    """
    reach = sorted({d for k in kernels.values() for d in k} | {(0, 0)})
    v = F.col(value)
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), *[F.lit(k.get((dy, dx), 0.0)).alias(n) for n, k in kernels.items()]) for dy, dx in reach])
    sent = pixels.select(*keys, "y", "x", v.cast("double").alias("v"), F.explode(steps).alias("s"))
    sent = sent.where(F.col("v").isNotNull() | ((F.col("s.dy") == 0) & (F.col("s.dx") == 0)))
    # The reader of a neighbour (dy, dx) away stands at (-dy, -dx) from it.
    home = (F.col("s.dy") == 0) & (F.col("s.dx") == 0)
    at = sent.select(*keys, (F.col("y") - F.col("s.dy")).alias("y"), (F.col("x") - F.col("s.dx")).alias("x"), home.alias("home"), F.col("v").isNotNull().alias("has"), *[(F.col(f"s.{n}") * F.col("v")).alias(n) for n in kernels])
    total = at.groupBy(*keys, "y", "x").agg(F.max(F.col("home")).alias("home"), F.max(F.col("home") & F.col("has")).alias("centre"), *[F.sum(n).alias(n) for n in kernels])
    return total.where("centre" if need_centre else "home").select(*keys, "y", "x", *kernels)


def sobel(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, y, x, gx, gy, magnitude. gx is the gradient down the rows and gy that along them, as the
    reference's column-major kernels have it; the magnitude is the same either way."""
    g = focal(pixels, keys, value, {"gx": SOBEL_DOWN, "gy": SOBEL_RIGHT}, need_centre=True)
    return g.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))

"""Bilinear resampling of one regular grid onto another."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A centre so near to a cell's reach, in its parts, is at its end.
EXACT = 1e-9


@dataclass(frozen=True)
class Grid:
    """Cells of res metres; row 0 at the north edge ymax, column 0 at the west edge xmin."""

    n_row: int
    n_col: int
    xmin: float
    ymax: float
    res: float

    def centre(self) -> tuple[Column, Column]:
        return (F.col("x") + 0.5) * self.res + self.xmin, F.lit(self.ymax) - (F.col("y") + 0.5) * self.res


def resample(raster: DataFrame, source: Grid, target: Grid, bands: list[str], keys: Sequence[str] = ()) -> DataFrame:
    """raster (keys, y, x, bands) on the target's cells; rasters of several keys at once.

    Each target cell's centre lies between four source cells. Target cells are made where source
    cells are: a source cell hands its values to the target centres less than a cell away, and one
    aggregate adds up weights, so a cell moves as often as it is used and nothing is joined. Cells
    whose four neighbours aren't all there, or hold a NULL in a band, are NULL in that band.
    """
    k = source.res / target.res
    # Place of this source centre in target cell units, and the range of target cells it reaches.
    tx = (F.lit(source.xmin - target.xmin) + (F.col("x") + 0.5) * source.res) / target.res - 0.5
    ty = (F.lit(target.ymax - source.ymax) + (F.col("y") + 0.5) * source.res) / target.res - 0.5
    reach = raster.select(*keys, "y", "x", *bands, tx.alias("tx"), ty.alias("ty"))
    near = lambda t, n: F.filter(F.sequence(F.greatest(F.lit(0), F.ceil(F.col(t) - k).cast("int")), F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(t) + k).cast("int")))), lambda i: (F.abs(i - F.col(t)) < k * (1 - EXACT)) & (i < n))
    at = reach.where((F.col("tx") > -k) & (F.col("tx") < target.n_col - 1 + k) & (F.col("ty") > -k) & (F.col("ty") < target.n_row - 1 + k))
    at = at.withColumn("u", F.explode(near("tx", target.n_col))).withColumn("v", F.explode(near("ty", target.n_row)))
    w = (1 - F.abs(F.col("u") - F.col("tx")) / k) * (1 - F.abs(F.col("v") - F.col("ty")) / k)
    full = lambda b: F.abs(F.sum(F.when(F.col(b).isNotNull(), F.col("w"))) - 1) < 1e-6
    summed = at.withColumn("w", w).groupBy(*keys, F.col("v").alias("y"), F.col("u").alias("x"))
    return summed.agg(*[F.when(full(b), F.sum(F.col("w") * F.col(b))).alias(b) for b in bands])

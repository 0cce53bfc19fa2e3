"""What plots of results show, as data: points, lines, outlines and labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import mean_of
from .segment import contrast_column

#: Most plots whose ids are shown.
SEGMENT_LABELS, GRID_LABELS = 200, 50
#: Points of a local fit; share of the points that each local line is fitted to.
LOESS_POINTS, LOESS_SPAN, LOESS_ROWS = 80, 0.75, 1000


def trait_points(fused: DataFrame, trait: str, vi_col: str = "mean", colour_by: str | None = None, facet_by: str | None = None) -> DataFrame:
    """x, y, colour, facet of the complete rows."""
    if missing := [c for c in (trait, vi_col, colour_by, facet_by) if c and c not in fused.columns]:
        raise ValueError(f"the fused data lacks {', '.join(missing)}")
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = fused.select(F.col(vi_col).cast("double").alias("x"), F.col(trait).cast("double").alias("y"), text(colour_by).alias("colour"), text(facet_by).alias("facet"))
    return rows.where("x is not null and y is not null")


def trait_lines(points: DataFrame) -> DataFrame:
    """facet, n, slope, intercept, r2, se (of the slope) of each facet's least squares line."""
    fit = points.groupBy("facet").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    r2 = F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))
    left = F.try_divide(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")), F.when(F.col("n") > 2, F.col("n") - 2))
    return fit.select("facet", "n", "slope", "intercept", r2.alias("r2"), F.sqrt(F.try_divide(left, F.col("sxx"))).alias("se"))


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = LOESS_SPAN) -> np.ndarray:
    """Local lines with tricube weights."""
    k, out = max(2, math.ceil(span * len(x))), np.full(len(at), np.nan)
    for i, a in enumerate(at):
        d = np.abs(x - a)
        h = np.partition(d, k - 1)[k - 1] if k <= len(x) else d.max()
        w = np.clip(1 - (d / h) ** 3, 0, 1) ** 3 if h > 0 else (d == 0).astype(float)
        m = np.average(x, weights=w)
        sxx = (w * (x - m) ** 2).sum()
        mean = np.average(y, weights=w)
        out[i] = mean + ((w * (x - m) * (y - mean)).sum() / sxx if sxx > 0 else 0) * (a - m)
    return out


def trait_curve(points: DataFrame) -> DataFrame:
    """facet, x, y: a local fit per facet over at most LOESS_ROWS points (those of the least hash)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        at = np.linspace(p["x"].min(), p["x"].max(), LOESS_POINTS)
        return pd.DataFrame({"facet": p["facet"].iloc[0], "x": at, "y": loess(p["x"].to_numpy(), p["y"].to_numpy(), at)})

    from pyspark.sql import Window

    w = Window.partitionBy("facet").orderBy(F.xxhash64("x", "y"), "x", "y")
    few = points.withColumn("k", F.row_number().over(w)).where(F.col("k") <= LOESS_ROWS).select("facet", "x", "y")
    return few.groupBy("facet").applyInPandas(run, "facet string, x double, y double")


def plot_vi_traits(fused: DataFrame, trait: str, vi_col: str = "mean", colour_by: str | None = "flight_date", facet_by: str | None = None, fit: str = "lm") -> dict[str, DataFrame]:
    if fit not in ("lm", "loess", "none"):
        raise ValueError("fit must be lm, loess or none")
    points = trait_points(fused, trait, vi_col, colour_by, facet_by)
    return {"points": points} | ({} if fit == "none" else {"fit": trait_lines(points) if fit == "lm" else trait_curve(points)})


def plot_segmentation_qc(plots: DataFrame, pixels: DataFrame, bands: list[str], show_ids: bool = True, quality_threshold: float = 0.5) -> dict[str, DataFrame]:
    """grid (y, x, contrast) and outlines with ``good``; labels only of up to SEGMENT_LABELS plots."""
    good = plots.withColumn("good", F.coalesce(F.col("quality") >= quality_threshold, F.lit(False)))
    few = show_ids and plots.limit(SEGMENT_LABELS + 1).count() <= SEGMENT_LABELS
    grid = pixels.select("y", "x", contrast_column(bands).alias("contrast"))
    return {"grid": grid, "outlines": good.withColumn("label", F.col("plot_id") if few else F.lit(None).cast("string"))}


def panel_qc_plot(pixels: DataFrame, panels: DataFrame, bands: list[str], wavelengths: list[float] | None = None, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """grid (keys, y, x, brightness), outlines and spectra (keys, panel_id, x, mean_dn; x in nm or band number)."""
    spectra = panels.select(*keys, "panel_id", F.posexplode("mean_dn").alias("k", "mean_dn"))
    x = F.element_at(F.array(*[F.lit(float(w)) for w in wavelengths]), F.col("k") + 1) if wavelengths else (F.col("k") + 1).cast("double")
    grid = pixels.select(*keys, "y", "x", mean_of([F.col(b) for b in bands]).alias("brightness"))
    return {"grid": grid, "outlines": panels.select(*keys, "panel_id", "ring", *(["parts"] if "parts" in panels.columns else [])), "spectra": spectra.select(*keys, "panel_id", x.alias("x"), "mean_dn")}


def preview_plot_grid(plots: DataFrame, pixels: DataFrame, bands: list[str], band: int = 1, show_ids: bool | None = None, border_colour: str = "cyan") -> dict[str, DataFrame]:
    """grid (y, x, value of a band) and outlines; ids by default only of up to GRID_LABELS plots."""
    if show_ids is None:
        show_ids = plots.limit(GRID_LABELS + 1).count() <= GRID_LABELS
    label = F.col("plot_id") if show_ids else F.lit(None).cast("string")
    return {"grid": pixels.select("y", "x", F.col(bands[band - 1]).alias("value")), "outlines": plots.select("plot_id", "ring", label.alias("label"), F.lit(border_colour).alias("colour"))}

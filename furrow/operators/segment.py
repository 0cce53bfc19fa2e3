"""Plot segmentation from gaps, boundary refinement and quality."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import divide
from ..plans.storage import materialize
from .components import label_cells
from .outline import outlines as outlines_of
from .resample import Grid
from .stencil import sobel
from .zonal import all_sides, join_polygons

METHODS = ("profile", "gradient", "combined")
SMALL = 1e-9


def contrast_column(bands: Sequence[str], wavelengths: Sequence[float] | None = None) -> Column:
    """One band: itself; three: excess green; else NDVI of the bands nearest 800 and 670 nm."""
    c = [F.col(b) for b in bands]
    if len(c) == 1:
        return c[0]
    if len(c) == 3:
        red, green, blue = c
        t = red + green + blue + SMALL
        return 2 * green / t - red / t - blue / t
    if wavelengths is not None and len(wavelengths) == len(c):
        near = lambda nm: c[min(range(len(c)), key=lambda k: (abs(wavelengths[k] - nm), k))]
        nir, red = near(800), near(670)
        return divide(nir - red, nir + red + SMALL)
    warnings.warn("no wavelengths match; the first band serves as contrast", stacklevel=2)
    return c[0]


def orientation(pixels: DataFrame, keys: Sequence[str] = (), value: str = "contrast", compat: str = "intent") -> DataFrame:
    """keys, orientation_deg: across the most frequent gradient direction, in bins of five degrees.

    Bins are closed on the right and the first includes zero; of equally full ones the first counts.
    compat: flat cells have no direction and don't count (``intent``), or count as zero (``reference``).
    """
    keys = list(keys)
    g = sobel(pixels, keys, value)
    if compat == "intent":
        g = g.where(F.col("magnitude") > SMALL)
    angle = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(180.0))
    bins = g.select(*keys, F.greatest(F.lit(1), F.ceil(angle / 5)).cast("int").alias("bin")).groupBy(*keys, "bin").count()
    top = bins.groupBy(*keys).agg(F.max(F.struct("count", (-F.col("bin")).alias("b"))).alias("t"))
    return top.select(*keys, F.pmod(-F.col("t.b") * 5 - 2.5 + 90.0, F.lit(180.0)).alias("orientation_deg"))


def kernel(sigma: float) -> list[float]:
    half = math.ceil(3 * sigma)
    w = [math.exp(-(k**2) / (2 * sigma**2)) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def gaussian_smooth(profile: DataFrame, by: list[str], order: str, value: str, sigma: float) -> DataFrame:
    """profile with ``smooth``: the weighted mean where the whole kernel fits, else the raw value."""
    if sigma <= 0:
        return profile.withColumn("smooth", F.col(value))
    k = kernel(sigma)
    half = len(k) // 2
    near = F.collect_list(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half))
    total = F.aggregate(F.zip_with(near, F.array(*map(F.lit, k)), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return profile.withColumn("smooth", F.when(F.size(near) == len(k), total).otherwise(F.col(value)))


def profiles(pixels: DataFrame, keys: Sequence[str] = (), value: str = "contrast") -> DataFrame:
    """keys, axis (y or x), at, mean: both mean profiles of the dense grid, absent and NULL as zero.

    Grouping sets give both from one pass; the other side's length divides.
    """
    keys = list(keys)
    v = pixels.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce(value, F.lit(0.0)).alias("v"))
    sums = v.groupingSets([[*keys, F.col("y")], [*keys, F.col("x")]], *keys, "y", "x").agg(F.sum("v").alias("s"))
    axis = F.when(F.col("x").isNull(), "y").otherwise("x")
    long = sums.select(*keys, axis.alias("axis"), F.coalesce("y", "x").alias("at"), "s")
    size = long.groupBy(*keys).agg(*[F.max(F.when(F.col("axis") == a, F.col("at") + 1)).alias(f"n_{a}") for a in "yx"])
    met = long.join(F.broadcast(size), keys) if keys else long.join(F.broadcast(size))
    return met.select(*keys, "axis", "at", (F.col("s") / F.when(F.col("axis") == "y", F.col("n_x")).otherwise(F.col("n_y"))).alias("mean"))


def profile_gap_lines(pixels: DataFrame, keys: Sequence[str] = (), value: str = "contrast", sigma: float = 3.0) -> DataFrame:
    """keys, axis, at, smooth, gap: lines whose smoothed profile lies below its 20th percentile."""
    keys = list(keys)
    s = gaussian_smooth(profiles(pixels, keys, value), [*keys, "axis"], "at", "mean", sigma)
    low = F.percentile("smooth", 0.2).over(Window.partitionBy(*keys, "axis"))
    return s.select(*keys, "axis", "at", "smooth", (F.col("smooth") < low).alias("gap"))


def profile_gaps(pixels: DataFrame, keys: Sequence[str] = (), value: str = "contrast", sigma: float = 3.0) -> DataFrame:
    """pixels with ``gap``: 1 in a gap row or a gap column."""
    keys = list(keys)
    lines = profile_gap_lines(pixels, keys, value, sigma).where("gap")
    row, col = (lines.where(F.col("axis") == a).select(*keys, F.col("at").alias(a), F.lit(1).alias(f"gap_{a}")) for a in "yx")
    met = pixels.join(row, [*keys, "y"], "left").join(col, [*keys, "x"], "left")
    return met.select(*pixels.columns, F.coalesce("gap_y", "gap_x", F.lit(0)).alias("gap"))


def gradient_gaps(pixels: DataFrame, keys: Sequence[str] = (), value: str = "contrast") -> DataFrame:
    """keys, y, x, magnitude, gap: 1 where the gradient exceeds its mean by a standard deviation."""
    keys = list(keys)
    g = sobel(pixels, keys, value)
    limit = g.groupBy(*keys).agg((F.avg("magnitude") + F.stddev_samp("magnitude")).alias("limit"))
    met = g.join(F.broadcast(limit), keys) if keys else g.join(F.broadcast(limit))
    return met.select(*keys, "y", "x", "magnitude", (F.col("magnitude") > F.col("limit")).cast("int").alias("gap"))


def gap_mask(pixels: DataFrame, method: str = "profile", keys: Sequence[str] = (), value: str = "contrast", sigma: float = 3.0) -> DataFrame:
    """pixels with ``gap`` by the profile or the gradient, or by either (combined)."""
    keys = list(keys)
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if method == "profile":
        return profile_gaps(pixels, keys, value, sigma)
    steep = gradient_gaps(pixels, keys, value).select(*keys, "y", "x", F.col("gap").alias("steep"))
    if method == "gradient":
        return pixels.join(steep, [*keys, "y", "x"], "left").withColumnRenamed("steep", "gap")
    both = profile_gaps(pixels, keys, value, sigma).join(steep, [*keys, "y", "x"], "left")
    return both.select(*pixels.columns, F.greatest("gap", "steep").alias("gap"))


def binned(v: str, low: str, high: str, n: Column) -> Column:
    """Which of n equal-width bins from low to high holds v; bins are closed on the right."""
    return F.coalesce(F.greatest(F.lit(1), F.least(n, F.ceil(F.try_divide(F.col(v) - F.col(low), (F.col(high) - F.col(low)) / n)))), F.ceil(n / 2)).cast("int")


def plot_polygons(masked: DataFrame, grid: Grid, min_area_m2: float = 1.0, expected_rows: int | None = None, expected_cols: int | None = None, prefix: str = "P", compat: str = "intent", keys: Sequence[str] = ()) -> DataFrame:
    """keys, plot_id, row_idx, col_idx, area_m2, quality (NULL), ring, parts from the cells outside gaps.

    compat: ``intent`` makes a plot of each patch of joined cells, its ring and parts the patch's outline;
    ``reference`` one of all cells. Plots of a raster are numbered by their first cell; row 1 is north. It
    is an error if no plot is large enough.
    """
    keys = list(keys)
    cells = masked.where(F.coalesce("gap", F.lit(0)) != 1).select(*keys, "y", "x")
    labels = materialize(cells.withColumn("label", F.lit(0).cast("long")) if compat == "reference" else label_cells(cells, keys))
    patch = labels.groupBy(*keys, "label").agg(F.count("*").alias("cells"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    patch = patch.withColumn("area_m2", F.col("cells") * grid.res**2).where(F.col("area_m2") >= min_area_m2).withColumn("north", -F.col("cy"))
    patch = materialize(patch)
    if patch.isEmpty():
        raise ValueError(f"no plots of at least {min_area_m2} m2 were found; lower the area or change the method")
    size = patch.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in ("north", "cx") for f, k in ((F.min, "low"), (F.max, "high"))])
    patch = patch.join(F.broadcast(size), keys) if keys else patch.join(F.broadcast(size))  # a row per raster
    bins = lambda wanted: F.greatest(F.lit(2), F.lit(wanted) if wanted else F.least(F.lit(30), F.col("n"))).cast("int")
    patch = patch.withColumn("r", binned("north", "north_low", "north_high", bins(expected_rows))).withColumn("col_idx", binned("cx", "cx_low", "cx_high", bins(expected_cols)))
    # Plots of a raster are few: one task may hold a row of each.
    of_raster = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    patch = patch.withColumn("row_idx", (F.max("r").over(of_raster) + 1 - F.col("r")).cast("int"))
    number = F.row_number().over(of_raster.orderBy("label"))
    plot_id = F.concat(F.lit(prefix), F.lpad(number.cast("string"), F.length(F.col("n").cast("string")), F.lit("0")))
    found = patch.join(outlines_of(labels, grid, keys), [*keys, "label"])
    return found.select(*keys, plot_id.alias("plot_id"), "row_idx", "col_idx", "area_m2", F.lit(None).cast("double").alias("quality"), "ring", "parts")


def score_quality(plots: DataFrame, masked: DataFrame, grid: Grid, value: str = "contrast", keys: Sequence[str] = ()) -> DataFrame:
    """plots with quality from 0 to 1: gaps around the boundary and contrast inside; 0.5 if unknown."""
    keys = list(keys)
    near = join_polygons(masked, plots, grid, margin=0.2, how="all", keys=keys)
    gap = F.avg(F.when((F.col("dist") <= 0.2) & F.col("gap").isNotNull(), (F.col("gap") == 1).cast("double")))
    inner = F.avg(F.when(F.col("held") & (F.col("dist") >= 0.1), F.col(value)))
    found = near.groupBy(*keys, "plot_id").agg(gap.alias("gap_frac"), inner.alias("inner"))
    score = 0.5 * F.least(F.col("gap_frac") * 2, F.lit(1.0)) + 0.5 * F.least(F.col("inner") + 0.5, F.lit(1.0))
    score = F.when(F.col("gap_frac").isNotNull() & F.col("inner").isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)).otherwise(0.5)
    return plots.join(found, [*keys, "plot_id"], "left").withColumn("quality", score).select(*plots.columns)


def segment_plots(pixels: DataFrame, bands: Sequence[str], grid: Grid, wavelengths: Sequence[float] | None = None, method: str = "profile", expected_rows: int | None = None, expected_cols: int | None = None, min_area_m2: float = 1.0, sigma: float = 3.0, prefix: str = "P", compat: str = "intent", keys: Sequence[str] = ()) -> DataFrame:
    """Plots of one raster, or of each raster by keys: keys, plot_id, row_idx, col_idx, area_m2, quality, ring, parts."""
    if len(bands) > 3 and wavelengths is None:
        raise ValueError(f"a raster of {len(bands)} bands requires wavelengths")
    masked = materialize(gap_mask(pixels.select(*keys, "y", "x", contrast_column(bands, wavelengths).alias("contrast")), method, keys, sigma=sigma))
    return score_quality(plot_polygons(masked, grid, min_area_m2, expected_rows, expected_cols, prefix, compat, keys), masked, grid, keys=keys)


def edge_cells(pixels: DataFrame, band: str, threshold: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """keys, y, x of cells whose normalised gradient magnitude reaches the threshold."""
    keys = list(keys)
    g = sobel(pixels, keys, band)
    r = F.broadcast(g.groupBy(*keys).agg(F.min("magnitude").alias("lo"), F.max("magnitude").alias("hi")))  # a row per raster
    return (g.join(r, keys) if keys else g.join(r)).where((F.col("magnitude") - F.col("lo")) / (F.col("hi") - F.col("lo") + SMALL) >= threshold).select(*keys, "y", "x")


def centroid(sides: Column) -> tuple[Column, Column]:
    """The centre of the area within closed rings, by their sides; holes count against it. From the first
    corner on: coordinates are large."""
    x0, y0 = F.element_at(sides, 1)["x1"], F.element_at(sides, 1)["y1"]
    moved = F.transform(sides, lambda s: F.struct((s["x1"] - x0).alias("a"), (s["y1"] - y0).alias("b"), (s["x2"] - x0).alias("c"), (s["y2"] - y0).alias("d")))
    cross = F.transform(moved, lambda s: F.struct((s["a"] * s["d"] - s["c"] * s["b"]).alias("w"), (s["a"] + s["c"]).alias("x"), (s["b"] + s["d"]).alias("y")))
    total = lambda f: F.aggregate(F.transform(cross, f), F.lit(0.0), lambda acc, v: acc + v)
    area = total(lambda s: s["w"])
    return x0 + F.try_divide(total(lambda s: s["w"] * s["x"]), 3 * area), y0 + F.try_divide(total(lambda s: s["w"] * s["y"]), 3 * area)


def refine_plot_boundaries(plots: DataFrame, pixels: DataFrame, band: str, grid: Grid, max_shift_m: float = 0.3, threshold: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """plots moved towards the centre of the edges near their boundary, and shift_m.

    A plot with fewer than four edge cells within max_shift_m of its boundary stays.
    """
    keys = list(keys)
    near = join_polygons(edge_cells(pixels, band, threshold, keys), plots, grid, margin=max_shift_m, how="boundary", keys=keys)
    centre = near.groupBy(*keys, "plot_id").agg(F.count("*").alias("edge_n"), F.avg("px").alias("ex"), F.avg("py").alias("ey"))
    met = plots.withColumn("own_sides", all_sides(plots)).join(centre, [*keys, "plot_id"], "left")
    mx, my = centroid(F.col("own_sides"))
    met = met.withColumn("dx", F.col("ex") - mx).withColumn("dy", F.col("ey") - my).withColumn("d", F.hypot("dx", "dy"))
    moved = F.when(F.col("edge_n") >= 4, F.least("d", F.lit(float(max_shift_m)))).otherwise(0.0)
    met = met.withColumn("moved", moved).withColumn("k", F.coalesce(F.try_divide("moved", "d"), F.lit(0.0)))
    by = {c: F.coalesce(F.col(f"d{c}") * F.col("k"), F.lit(0.0)) for c in "xy"}
    shifted = lambda ring: F.transform(ring, lambda p: F.struct((p["x"] + by["x"]).alias("x"), (p["y"] + by["y"]).alias("y")))
    met = met.withColumn("ring", shifted(F.col("ring")))
    if "parts" in plots.columns:
        met = met.withColumn("parts", F.transform("parts", shifted))
    return met.select(*plots.columns, F.bround("moved", 3).alias("shift_m"))


def outlines(plots: DataFrame) -> DataFrame:
    """plots with the area of their outline, for views: holes count against it."""
    own = all_sides(plots)
    x0, y0 = F.element_at(own, 1)["x1"], F.element_at(own, 1)["y1"]
    cross = F.transform(own, lambda s: (s["x1"] - x0) * (s["y2"] - y0) - (s["x2"] - x0) * (s["y1"] - y0))
    return plots.withColumn("ring_area_m2", F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2)

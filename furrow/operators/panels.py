"""Calibration panels and reflectance."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantile
from ..functions.safe import clamp, mean_of, sd_of
from ..plans.storage import materialize
from .components import label_cells
from .outline import outlines
from .resample import Grid
from .stack import lookup
from .zonal import join_polygons, mask


def bright_cells(pixels: DataFrame, bands: Sequence[str], quantile: float = 0.92, keys: Sequence[str] = ()) -> DataFrame:
    """pixels at or above the quantile of their raster's brightness, the mean over bands."""
    keys = list(keys)
    lit = pixels.withColumn("brightness", mean_of([F.col(b) for b in bands]))
    q = F.broadcast(exact_quantile(lit, keys, "brightness", quantile, "bright_from"))  # a row per raster
    return (lit.join(q, keys) if keys else lit.join(q)).where(F.col("brightness") >= F.col("bright_from")).drop("bright_from")


def panel_candidates(pixels: DataFrame, bands: Sequence[str], grid: Grid, size_m2=(0.1, 2.0), quantile: float = 0.92, flatness: float = 0.08, search_area: DataFrame | None = None, compat: str = "intent", keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, mean_dn, brightness, spectral_cv, area_m2, confidence, ring, parts of bright patches in size.

    compat: ``reference`` takes each bright cell as a patch of its own, ``intent`` joined cells.
    """
    keys = list(keys)
    low, high = (size_m2 * 0.5, size_m2 * 1.5) if isinstance(size_m2, (int, float)) else size_m2
    area = mask(pixels, search_area, grid) if search_area is not None else pixels
    bright = materialize(bright_cells(area, bands, quantile, keys).select(*keys, "y", "x", *bands))
    if compat == "reference":
        labels = bright.withColumn("label", F.shiftleft(F.col("y").cast("long"), 32) + F.col("x"))
    else:
        labels = bright.join(label_cells(bright, keys), [*keys, "y", "x"])
    patch = labels.groupBy(*keys, "label").agg(F.count("*").alias("cells"), *[F.avg(b).alias(b) for b in bands])
    means = [F.col(b) for b in bands]
    patch = patch.withColumn("area_m2", F.col("cells") * grid.res**2).where(F.col("area_m2").between(low, high))
    patch = patch.withColumn("brightness", mean_of(means))
    cv = F.when(F.col("brightness") > 0, F.coalesce(sd_of(means) / F.col("brightness"), F.lit(float("inf")))).otherwise(float("inf"))
    patch = patch.withColumn("cv", cv)
    confidence = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("cv") / flatness)), 3)
    kept = patch.select(*keys, "label", F.array(*means).alias("mean_dn"), "brightness", F.when(F.col("cv") < float("inf"), F.bround("cv", 4)).otherwise(float("inf")).alias("spectral_cv"), "area_m2", confidence.alias("confidence"))
    return kept.join(outlines(labels.select(*keys, "label", "y", "x"), grid, keys), [*keys, "label"])


PANEL = ["panel_id", "mean_dn", "brightness", "spectral_cv", "area_m2", "confidence", "ring", "parts"]


def detect_panels(pixels: DataFrame, bands: Sequence[str], grid: Grid, n_panels: int = 1, size_m2=(0.1, 2.0), quantile: float = 0.92, flatness: float = 0.08, search_area: DataFrame | None = None, compat: str = "intent", keys: Sequence[str] = ()) -> DataFrame:
    """At most n_panels flat bright patches by confidence, of each raster: keys, panel_id, mean_dn, brightness,
    spectral_cv, area_m2, confidence, ring, parts. If none is flat, the best whatever their spectrum, with
    a warning."""
    keys = list(keys)
    found = materialize(panel_candidates(pixels, bands, grid, size_m2, quantile, flatness, search_area, compat, keys))
    if found.isEmpty():
        raise ValueError("no candidate regions in the expected size range; change size_m2 or quantile")
    flat = F.col("spectral_cv") <= flatness
    of_raster = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # candidates of a raster are few
    any_flat = F.max(flat.cast("int")).over(of_raster)
    number = F.row_number().over(of_raster.orderBy(F.desc(flat.cast("int")), F.desc("confidence"), "label"))
    top = found.withColumn("any_flat", any_flat).withColumn("k", number).where((F.col("k") <= n_panels) & (flat | (F.col("any_flat") == 0)))
    if not top.where("any_flat = 0").isEmpty():
        warnings.warn("no candidate passed the flatness threshold; the brightest patches are returned", stacklevel=2)
    return top.withColumn("panel_id", F.concat(F.lit("panel_"), F.col("k").cast("string"))).select(*keys, *PANEL)


#: Panels whose DN differ by no more tell no line.
SAME_DN = 1e-9
Coefficients = list[tuple[str, float | None, float | None]]


def fit_coefficients(panels: DataFrame, bands: Sequence[str], known: Mapping[str, float] | Sequence[float], per_band: bool = True, key: str | None = None) -> Coefficients | dict[object, Coefficients]:
    """(band, gain, offset) from panels: panel_id and a mean DN per band; with a key, such as the flight, for
    each of its values.

    Two panels or more: least squares, NULL if their DN is the same; one: the gain alone. per_band=False uses
    the first band's for all.
    """
    known = known if isinstance(known, Mapping) else {f"panel_{k}": v for k, v in enumerate(known, 1)}
    truth = panels.sparkSession.createDataFrame([(k, float(v)) for k, v in known.items()], "panel_id string, known double")
    group = F.col(key) if key else F.lit(None)
    met = panels.withColumn("of", group).join(truth, "panel_id").unpivot(["of", "panel_id", "known"], list(bands), "band", "dn").where("dn is not null")
    apart = F.max("dn") - F.min("dn") > SAME_DN
    fit = met.groupBy("of", "band").agg(F.countDistinct("panel_id").alias("n"), F.when(apart, F.regr_slope("known", "dn")).alias("gain"), F.when(apart, F.regr_intercept("known", "dn")).alias("offset"), F.first(F.col("known") / F.greatest("dn", F.lit(1e-9))).alias("only"))
    own: dict[object, dict] = {}
    for r in fit.collect():  # a row per flight and band
        own.setdefault(r["of"], {})[r["band"]] = (r["only"], 0.0) if r["n"] == 1 else (r["gain"], r["offset"])
    if not own:
        raise ValueError("no matching panel IDs between panels and known reflectances")
    made = {of: [(b, *x.get(b if per_band else bands[0], (None, None))) for b in bands] for of, x in own.items()}
    return made if key else made[None]


def calibrate_reflectance(pixels: DataFrame, panels: DataFrame, grid: Grid, bands: Sequence[str], known: Mapping[str, float] | Sequence[float], per_band: bool = True, clamped: bool = True) -> DataFrame:
    """pixels with reflectance in place of DN. DNs are read again under the panels' rings.

    Coefficients, two numbers a band, become literals: applying them is one projection, without a join.
    """
    rings = panels.select(F.col("panel_id").alias("plot_id"), "ring", *(["parts"] if "parts" in panels.columns else []))
    dn = join_polygons(pixels, rings, grid).groupBy(F.col("plot_id").alias("panel_id")).agg(*[F.avg(b).alias(b) for b in bands])
    return apply_coefficients(pixels, fit_coefficients(dn, bands, known, per_band), clamped)


def apply_coefficients(pixels: DataFrame, coefficients: Coefficients | dict[object, Coefficients], clamped: bool = True, key: str | None = None) -> DataFrame:
    """pixels with reflectance in place of DN; with a key, by the coefficients of its value."""
    made = {}
    for k, (band, *one) in enumerate(coefficients if key is None else next(iter(coefficients.values()))):
        gain, offset = (F.lit(c).cast("double") if key is None else lookup(key, {of: x[k][j] for of, x in coefficients.items()}).cast("double") for j, c in enumerate(one, 1))
        v = F.col(band) * gain + offset
        made[band] = clamp(v, 0.0, 1.0) if clamped else v
    return pixels.withColumns(made)

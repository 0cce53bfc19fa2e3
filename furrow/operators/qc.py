"""Quality control of flights."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantile
from .stencil import LAPLACIAN, focal

SUMMARY = ["label", "date", "n_bands", "nodata_pct", "mean_brightness", "irradiance_cv", "blur_laplacian", "sat_frac_pct", "flag_bands", "flag_nodata", "flag_blur", "flag_irradiance", "flag_saturation", "overall_score", "recommendation"]


@dataclass(frozen=True)
class QCParams:
    expected_bands: int | None = None
    blur_threshold: float = 100.0
    saturation_threshold: float = 0.02
    irradiance_cv_threshold: float = 0.15
    nodata_threshold: float = 0.10


def laplacian_variance(pixels: DataFrame, keys: list[str], band: str) -> DataFrame:
    """keys, lap_var: sample variance of the first band's Laplacian over a flight's cells."""
    return focal(pixels, keys, band, {"lap": LAPLACIAN}, need_centre=False).groupBy(*keys).agg(F.var_samp("lap").alias("lap_var"))


def saturation(pixels: DataFrame, keys: list[str], bands: Sequence[str]) -> DataFrame:
    """keys, band, threshold, frac: the share of a band's values at or above its own 95th percentile."""
    long = pixels.unpivot(keys, list(bands), "band", "v").where("v is not null")
    p95 = exact_quantile(long, [*keys, "band"], "v", 0.95, "threshold")
    met = long.join(p95, [*keys, "band"])
    return met.groupBy(*keys, "band").agg(F.first("threshold").alias("threshold"), F.avg((F.col("v") >= F.col("threshold")).cast("double")).alias("frac"))


def flight_metrics(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("flight",)) -> DataFrame:
    """keys and the unrounded metrics of every flight: band_means, sat_fracs, nodata_frac,
    mean_brightness, irradiance_cv, lap_var, sat_frac."""
    keys = list(keys)
    basic = pixels.groupBy(*keys).agg(F.avg(F.col(bands[0]).isNull().cast("double")).alias("nodata_frac"), *[f(b).alias(f"{n}_{k}") for k, b in enumerate(bands) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    means = F.array(*[F.col(f"m_{k}") for k in range(len(bands))])
    cvs = F.array(*[F.when(F.col(f"m_{k}") > 0, F.col(f"s_{k}") / F.col(f"m_{k}")) for k in range(len(bands))])

    def mean(a):
        held = F.filter(a, lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(held, F.lit(0.0), lambda acc, v: acc + v), F.size(held))

    basic = basic.select(*keys, "nodata_frac", means.alias("band_means"), mean(means).alias("mean_brightness"), mean(cvs).alias("irradiance_cv"))
    order = {b: k for k, b in enumerate(bands)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("band")]
    sat = saturation(pixels, keys, bands).groupBy(*keys).agg(F.avg("frac").alias("sat_frac"), F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), "frac"))), lambda s: s["frac"]).alias("sat_fracs"))
    return basic.join(laplacian_variance(pixels, keys, bands[0]), keys, "left").join(sat, keys, "left")


def flight_qc(pixels: DataFrame, bands: Sequence[str], params: QCParams = QCParams(), keys: Sequence[str] = ("flight",), label: str = "flight", date: str | None = None) -> DataFrame:
    """The 15 columns of the QC summary, a row per flight, all flights at once."""
    m = flight_metrics(pixels, bands, [*keys, *([date] if date and date not in keys else [])])
    flag = lambda c: F.coalesce(c, F.lit(False))
    m = m.withColumn("flag_bands", F.lit(params.expected_bands is not None and params.expected_bands != len(bands)))
    m = m.withColumn("flag_nodata", flag(F.col("nodata_frac") > params.nodata_threshold))
    m = m.withColumn("flag_blur", flag(F.col("lap_var") < params.blur_threshold))
    m = m.withColumn("flag_irradiance", flag(F.col("irradiance_cv") > params.irradiance_cv_threshold))
    m = m.withColumn("flag_saturation", flag(F.col("sat_frac") > params.saturation_threshold))
    # Penalties and grades.
    penalties = {"flag_bands": 10, "flag_nodata": 20, "flag_blur": 25, "flag_irradiance": 20, "flag_saturation": 15}
    score = F.lit(100) - sum((F.col(c).cast("int") * p for c, p in penalties.items()), F.lit(0))
    m = m.withColumn("overall_score", F.greatest(F.lit(0), score))
    grade = F.when(F.col("overall_score") >= 80, "Accept").when(F.col("overall_score") >= 50, "Caution").otherwise("Reject")
    return m.select(
        F.col(label).cast("string").alias("label"),
        (F.col(date).cast("string") if date else F.lit(None).cast("string")).alias("date"),
        F.lit(len(bands)).alias("n_bands"),
        F.bround(F.col("nodata_frac") * 100, 1).alias("nodata_pct"),
        F.bround("mean_brightness", 4).alias("mean_brightness"),
        F.bround("irradiance_cv", 4).alias("irradiance_cv"),
        F.bround("lap_var", 1).alias("blur_laplacian"),
        F.bround(F.col("sat_frac") * 100, 2).alias("sat_frac_pct"),
        *penalties,
        "overall_score",
        grade.alias("recommendation"),
    )


def qc_counts(summary: DataFrame) -> DataFrame:
    """recommendation, flights and the labels of each."""
    return summary.groupBy("recommendation").agg(F.count("*").alias("flights"), F.array_sort(F.collect_list("label")).alias("labels"))


def describe(summary: DataFrame, show: int = 20) -> str:
    """What is to be printed of a QC summary: how many flights have which recommendation, and the rejected
    ones by label (the first ``show``), of which a warning tells too."""
    counts = {r["recommendation"]: r["flights"] for r in summary.groupBy("recommendation").agg(F.count("*").alias("flights")).collect()}
    lines = ["Flights checked: " + str(sum(counts.values())), *[f"  {k}: {counts.get(k, 0)}" for k in ("Accept", "Caution", "Reject")]]
    rejected = [r["label"] for r in summary.where("recommendation = 'Reject'").orderBy("label").select("label").limit(show).collect()]
    if rejected:
        more = counts["Reject"] - len(rejected)
        named = ", ".join(map(str, rejected)) + (f" and {more} more" if more else "")
        warnings.warn(f"rejected flights: {named}", stacklevel=2)
        lines.append("Rejected: " + named)
    return "\n".join(lines)

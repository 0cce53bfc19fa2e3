"""Vegetation indices: definitions, band matching and their catalogue."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .safe import divide


@dataclass(frozen=True)
class Index:
    """bands: role -> wanted wavelength in nm; tol: largest distance in nm; fun: roles' columns -> value."""

    bands: Mapping[str, float]
    tol: float
    fun: Callable[[Mapping[str, Column]], Column]
    desc: str
    clamped: bool = False

    def __post_init__(self) -> None:
        if not self.bands or not all(isinstance(v, (int, float)) for v in self.bands.values()):
            raise ValueError("bands must name wavelengths in nm")
        if not callable(self.fun):
            raise ValueError("fun must be callable")


def normalised(a: str, b: str) -> Callable[[Mapping[str, Column]], Column]:
    return lambda c: divide(c[a] - c[b], c[a] + c[b])


#: Wavelengths, tolerances and formulas of the built-in indices.
INDICES = {
    "NDVI": Index({"nir": 800, "red": 670}, 20, normalised("nir", "red"), "Normalised difference vegetation index", True),
    "NDRE": Index({"nir": 800, "edge": 720}, 20, normalised("nir", "edge"), "Normalised difference red edge", True),
    "VARI": Index({"green": 550, "red": 670, "blue": 480}, 25, lambda c: divide(c["green"] - c["red"], c["green"] + c["red"] - c["blue"]), "Visible atmospherically resistant index"),
    "MCARI": Index({"edge": 700, "red": 670, "green": 550}, 20, lambda c: ((c["edge"] - c["red"]) - 0.2 * (c["edge"] - c["green"])) * divide(c["edge"], c["red"]), "Modified chlorophyll absorption ratio"),
    "mNDVI705": Index({"b750": 750, "b705": 705, "b445": 445}, 15, lambda c: divide(c["b750"] - c["b705"], c["b750"] + c["b705"] - 2 * c["b445"]), "Modified red edge NDVI", True),
    "LCI": Index({"nir": 850, "edge": 710, "red": 670}, 25, lambda c: divide(c["nir"] - c["edge"], c["nir"] + c["red"]), "Leaf chlorophyll index", True),
    "GNDVI": Index({"nir": 800, "green": 550}, 20, normalised("nir", "green"), "Green NDVI", True),
    "CRI1": Index({"blue": 510, "green": 550}, 20, lambda c: divide(F.lit(1.0), c["blue"]) - divide(F.lit(1.0), c["green"]), "Carotenoid reflectance index 1"),
    "WBI": Index({"b900": 900, "b970": 970}, 15, lambda c: divide(c["b900"], c["b970"]), "Water band index"),
    "PSRI": Index({"red": 678, "blue": 500, "b750": 750}, 25, lambda c: divide(c["red"] - c["blue"], c["b750"]), "Plant senescence reflectance index"),
}


def match_band(wavelengths: list[float], target: float, tol: float) -> int:
    """Place of the nearest wavelength, the first of equally near ones; an error beyond tol."""
    at = min(range(len(wavelengths)), key=lambda k: (abs(wavelengths[k] - target), k))
    if abs(wavelengths[at] - target) > tol:
        raise ValueError(f"no band within {tol:g} nm of {target:g} nm; the nearest is {wavelengths[at]:g} nm")
    return at


def index_column(index: Index, bands: list[str], wavelengths: list[float]) -> Column:
    return index.fun({role: F.col(bands[match_band(wavelengths, nm, index.tol)]) for role, nm in index.bands.items()})


def list_vi(spark: SparkSession) -> DataFrame:
    """name, description, wavelengths (ascending, comma-joined) and tolerance of each index."""
    rows = [(k, v.desc, ", ".join(f"{x:g}" for x in sorted(v.bands.values())), float(v.tol)) for k, v in INDICES.items()]
    return spark.createDataFrame(rows, "name string, description string, wavelengths string, tolerance double")

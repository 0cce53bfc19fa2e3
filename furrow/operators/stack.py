"""Flight stacks and index stacks: one pixel table for all flights, metadata on the driver.

A pixel table has the key columns (``y`` from the north, ``x`` from the west; more columns, such as a
field's id, may stand before them), ``flight`` (1 to n by date), ``flight_date`` and a double column
per band. A pixel without a row on a flight counts as NULL there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indices import INDICES, Index, index_column
from ..functions.safe import clamp, no_nan
from .resample import Grid, resample


@dataclass(frozen=True)
class Flight:
    number: int
    date: date
    bbch: str | None = None
    meta: Any = None


@dataclass(frozen=True)
class FlightStack:
    pixels: DataFrame
    flights: tuple[Flight, ...]
    wavelengths: tuple[float, ...]
    bands: tuple[str, ...]
    keys: tuple[str, ...] = ("y", "x")

    def __len__(self) -> int:
        return len(self.flights)

    def __getitem__(self, at: int | slice | Sequence[int]) -> FlightStack:
        """The flights at places from 0, in order of date, numbered anew."""
        places = range(len(self))[at] if isinstance(at, slice) else [at] if isinstance(at, int) else list(at)
        chosen = sorted((self.flights[k] for k in places), key=lambda f: f.number)
        if not chosen:
            raise ValueError("a stack needs a flight")
        number = {f.number: k for k, f in enumerate(chosen, 1)}
        pixels = self.pixels.where(F.col("flight").isin(list(number)))
        pixels = pixels.withColumn("flight", lookup("flight", number).cast("int"))
        return replace(self, pixels=pixels, flights=tuple(replace(f, number=number[f.number]) for f in chosen))

    def __repr__(self) -> str:
        span = f"{self.flights[0].date} to {self.flights[-1].date}"
        return f"FlightStack: {len(self)} flights, {span}, {len(self.bands)} bands, {min(self.wavelengths):g}-{max(self.wavelengths):g} nm"

    def summary(self) -> DataFrame:
        """flight, flight_date, bbch, n_bands, n_row, n_col by flight."""
        spark = self.pixels.sparkSession
        size = self.pixels.groupBy("flight").agg((F.max("y") + 1).cast("int").alias("n_row"), (F.max("x") + 1).cast("int").alias("n_col"))
        known = spark.createDataFrame([(f.number, f.date, f.bbch) for f in self.flights], "flight int, flight_date date, bbch string")
        return known.join(size, "flight", "left").select("flight", "flight_date", "bbch", F.lit(len(self.bands)).alias("n_bands"), "n_row", "n_col")

    def flights_frame(self) -> DataFrame:
        return self.pixels.sparkSession.createDataFrame([(f.number, f.date, f.bbch) for f in self.flights], "flight int, flight_date date, bbch string")


def lookup(col: str, values: dict) -> F.Column:
    """A literal map's value for a column: driver metadata without a join."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(col)]


def band_names(wavelengths: Sequence[float]) -> tuple[str, ...]:
    """``B<nm>nm``, halves to even; a repeated name gets its place behind."""
    names = [f"B{round(w)}nm" for w in wavelengths]
    return tuple(n if names.count(n) == 1 else f"{n}_{k}" for k, n in enumerate(names, 1))


def flight_stack(rasters: Sequence[DataFrame], dates: Sequence, wavelengths: Sequence[float], bbch: Sequence | None = None, meta: Sequence | None = None, align: bool = True, grids: Sequence[Grid] | None = None) -> FlightStack:
    """One stack from a raster frame (y, x, then the bands) per flight, in order of date.

    With grids given and align, a raster whose grid differs from the first input's is resampled to it.
    """
    if not rasters:
        raise ValueError("rasters must be a non-empty list")
    dates = [d if isinstance(d, date) else date.fromisoformat(str(d)) for d in dates]
    if len(dates) != len(rasters):
        raise ValueError(f"dates length ({len(dates)}) must equal rasters length ({len(rasters)})")
    own = [[c for c in r.columns if c not in ("y", "x")] for r in rasters]
    if len(wavelengths) != len(own[0]):
        raise ValueError(f"wavelengths length ({len(wavelengths)}) must equal the band count ({len(own[0])})")
    for name, values in (("bbch", bbch), ("meta", meta)):
        if values is not None and len(values) != len(rasters):
            raise ValueError(f"{name} length ({len(values)}) must equal rasters length ({len(rasters)})")
    if len({len(b) for b in own}) > 1:
        raise ValueError("all rasters must have the same number of bands")
    bands = band_names(wavelengths)
    named = [r.select("y", "x", *[no_nan(F.col(f"`{c}`")).alias(b) for c, b in zip(cols, bands, strict=True)]) for r, cols in zip(rasters, own, strict=True)]
    if grids is not None and align:
        named = [r if g == grids[0] else resample(r, g, grids[0], list(bands)) for r, g in zip(named, grids, strict=True)]
    order = sorted(range(len(dates)), key=lambda k: (dates[k], k))
    flights = tuple(Flight(n, dates[k], bbch and bbch[k], meta and meta[k]) for n, k in enumerate(order, 1))
    parts = [named[k].select("y", "x", F.lit(f.number).alias("flight"), F.lit(f.date).alias("flight_date"), *bands) for f, k in zip(flights, order, strict=True)]
    return FlightStack(reduce(DataFrame.union, parts), flights, tuple(wavelengths), bands)


def stack_table(pixels: DataFrame, bands: Sequence[str], wavelengths: Sequence[float], keys: Sequence[str] = ("y", "x"), dates: Sequence[date] | None = None) -> FlightStack:
    """A stack over one table with keys, ``flight_date`` and band columns; dates that aren't given are read."""
    if len(bands) != len(wavelengths):
        raise ValueError("wavelengths length must equal the band count")
    if dates is None:
        dates = [r[0] for r in pixels.select("flight_date").distinct().collect() if r[0]]
    dates = sorted(dates)
    if not dates:
        raise ValueError("a stack needs a flight")
    number = {d: k for k, d in enumerate(dates, 1)}
    rows = pixels.select(*keys, lookup("flight_date", number).cast("int").alias("flight"), "flight_date", *[no_nan(F.col(b)).alias(b) for b in bands])
    return FlightStack(rows, tuple(Flight(k, d) for d, k in number.items()), tuple(wavelengths), tuple(bands), tuple(keys))


@dataclass(frozen=True)
class VIStack:
    """Pixels with a double column per index instead of bands."""

    pixels: DataFrame
    flights: tuple[Flight, ...]
    indices: tuple[str, ...]
    keys: tuple[str, ...] = ("y", "x")

    def __repr__(self) -> str:
        return f"VIStack: {', '.join(self.indices)} on {len(self.flights)} flights"

    def resolve(self, index: str | None) -> str:
        if index is None:
            return self.indices[0]
        if index not in self.indices:
            raise ValueError(f"Unknown index {index!r}; there are {', '.join(self.indices)}")
        return index

    def long(self) -> DataFrame:
        """keys, flight, flight_date, index, vi: a row per value."""
        return self.pixels.unpivot([*self.keys, "flight", "flight_date"], list(self.indices), "index", "vi")


def compute_vi(stack: FlightStack, indices: Sequence[str] | str = ("NDVI",), custom: Index | None = None, clamped: bool = True) -> VIStack:
    """Every index on every flight. custom joins as ``CUSTOM`` and is never clamped."""
    names = [indices] if isinstance(indices, str) else list(indices)
    known = dict(INDICES) | ({"CUSTOM": custom} if custom else {})
    if custom and "CUSTOM" not in names:
        names.append("CUSTOM")
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"Unknown indices: {', '.join(unknown)}")
    cols = []
    for n in names:
        v = index_column(known[n], list(stack.bands), list(stack.wavelengths))
        cols.append((clamp(v, -1.0, 1.0) if clamped and known[n].clamped and n != "CUSTOM" else v).alias(n))
    return VIStack(stack.pixels.select(*stack.keys, "flight", "flight_date", *cols), stack.flights, tuple(names), stack.keys)


def field_means(vi: VIStack) -> DataFrame:
    """flight_date, index, mean over all pixels."""
    wide = vi.pixels.groupBy("flight_date").agg(*[F.avg(n).alias(n) for n in vi.indices])
    return wide.unpivot(["flight_date"], list(vi.indices), "index", "mean_vi")

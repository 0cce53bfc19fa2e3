"""Raster files as pixel tables, and tables as files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tiff import Raster, read_tiff, write_tiff

PIXELS = "label string, flight_date date, error string, xmin double, ymax double, res double, y int, x int, bands array<double>"


def _decoded(n_bands: int | None):
    def run(batches):
        for batch in batches:
            for path, day, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                label = path.rsplit("/", 1)[-1]
                try:
                    r = read_tiff(raw.as_py())
                except Exception as e:  # noqa: BLE001  whatever is wrong with a file, the others go on
                    yield from pa.Table.from_pylist([{"label": label, "flight_date": day, "error": str(e)[:500]}], schema=SCHEMA).to_batches()
                    continue
                v = r.values[:n_bands]
                for y in range(v.shape[1]):
                    n = v.shape[2]
                    flat = pa.array(v[:, y].T.ravel(), from_pandas=True)
                    bands = pa.ListArray.from_arrays(pa.array(range(0, (n + 1) * len(v), len(v)), pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * n), pa.array([day] * n, pa.date32()), pa.nulls(n, pa.string()), *(pa.array([z] * n, pa.float64()) for z in (r.xmin, r.ymax, r.res)), pa.array([y] * n, pa.int32()), pa.array(range(n), pa.int32()), bands], schema=SCHEMA)

    return run


SCHEMA = pa.schema([("label", pa.string()), ("flight_date", pa.date32()), ("error", pa.string()), ("xmin", pa.float64()), ("ymax", pa.float64()), ("res", pa.float64()), ("y", pa.int32()), ("x", pa.int32()), ("bands", pa.list_(pa.float64()))])


def date_of_name(path: Column) -> Column:
    """A date from the first eight digits of a file's name (yyyyMMdd), else NULL."""
    return F.try_to_date(F.regexp_extract(path, r"(?:^|/)([0-9]{8})[^/]*$", 1), "yyyyMMdd")


def scan_rasters(spark: SparkSession, path: str, pattern: str = "*.tif", n_bands: int | None = None) -> DataFrame:
    """A row per pixel of every file below path; a file that can't be read is one row with its error.

    label is the file's name; flight_date its first eight digits; only the first n_bands are kept.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = files.select("path", date_of_name(F.col("path")).alias("flight_date"), "content")
    return named.mapInArrow(_decoded(n_bands), PIXELS)


def readable(pixels: DataFrame, names: list[str]) -> DataFrame:
    """Pixels of the files that were read, a column per band: array elements aren't pruned, columns are."""
    return pixels.where("error is null").select("label", "flight_date", "y", "x", *[F.try_element_at("bands", F.lit(k)).alias(n) for k, n in enumerate(names, 1)])


def unreadable(pixels: DataFrame) -> DataFrame:
    """label, error of the files that couldn't be read."""
    return pixels.where("error is not null").select("label", "error")


def write_pixels(pixels: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, replaced; by flight date where asked, so later date windows read only their folders."""
    pixels.write.mode("overwrite").parquet(path, partitionBy=partition_by)


def to_tiff(pixels: DataFrame, bands: list[str], grid, path: str) -> str:
    """One raster, small enough for the driver, as a GeoTIFF at a local path."""
    import numpy as np

    t = pixels.select("y", "x", *bands).toArrow()
    out = np.full((len(bands), grid.n_row, grid.n_col), np.nan)
    y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
    for k, b in enumerate(bands):
        out[k, y, x] = t.column(b).to_pandas().to_numpy(float)
    with open(path, "wb") as f:
        f.write(write_tiff(Raster(out, grid.xmin, grid.ymax, grid.res)))
    return path


def wkt(ring: Column) -> Column:
    """A ring of points as a POLYGON."""
    pair = F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(pair, ", "), F.lit("))"))


def geojson(plots: DataFrame) -> DataFrame:
    """``value``: a GeoJSON feature per plot, its ring (and its holes and parts)
    as one Polygon, the other columns as properties."""
    point = lambda p: F.array(p["x"], p["y"])
    rings = F.array("ring")
    if "parts" in plots.columns:
        rings = F.concat(rings, F.coalesce("parts", F.array().cast(plots.schema["parts"].dataType)))
    shape = F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(r, point)).alias("coordinates"))
    rest = [c for c in plots.columns if c not in ("ring", "parts")]
    return plots.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), shape.alias("geometry"))).alias("value"))


def write_plots(plots: DataFrame, path: str, form: str = "csv") -> None:
    """Plots, replaced: CSV with the ring as WKT (``csv``), or a GeoJSON feature a line (``geojson``), which GIS
    software reads."""
    if form == "geojson":
        geojson(plots).write.mode("overwrite").text(path)
    elif form == "csv":
        plots.withColumn("geometry", wkt(F.col("ring"))).drop("ring", "parts").write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError("form must be geojson or csv")

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators.resample import Grid
from furrow.sources import rasters
from furrow.sources.tiff import Raster, read_tiff, write_tiff
from furrow.streaming.flights import daily_means, qc_stream, read_flights


def test_tiff_round_trip():
    a = np.random.default_rng(1).random((3, 5, 7))
    a[1, 2, 3] = np.nan
    r = read_tiff(write_tiff(Raster(a, 10.0, 20.0, 0.5)))
    assert np.array_equal(r.values, a, equal_nan=True) and (r.xmin, r.ymax, r.res) == (10.0, 20.0, 0.5)
    with pytest.raises(ValueError):
        read_tiff(b"no tiff at all")


def test_a_folder_of_rasters(spark, tmp_path):
    a = np.random.default_rng(2).random((5, 4, 6))
    (tmp_path / "20240401_field.tif").write_bytes(write_tiff(Raster(a)))
    (tmp_path / "20240501_field.tif").write_bytes(b"II*\0broken")
    (tmp_path / "notes.txt").write_text("x")
    px = rasters.scan_rasters(spark, str(tmp_path), n_bands=4)
    assert [(r["label"]) for r in rasters.unreadable(px).collect()] == ["20240501_field.tif"]
    good = rasters.readable(px, ["g", "r", "e", "n"])
    assert good.count() == 24 and good.first()["flight_date"] == date(2024, 4, 1)
    assert good.where("y = 2 and x = 3").first()["e"] == pytest.approx(a[2, 2, 3])


def test_sinks(spark, tmp_path):
    px = spark.createDataFrame([(y, x, float(y * 3 + x), date(2024, 1, 1 + y)) for y in range(2) for x in range(3)], "y int, x int, v double, flight_date date")
    rasters.write_pixels(px, str(tmp_path / "px"), ["flight_date"])
    rasters.write_pixels(px, str(tmp_path / "px"), ["flight_date"])
    assert spark.read.parquet(str(tmp_path / "px")).where("flight_date = '2024-01-02'").count() == 3
    with open(rasters.to_tiff(px, ["v"], Grid(2, 3, 0.0, 2.0, 1.0), str(tmp_path / "a.tif")), "rb") as f:
        assert read_tiff(f.read()).values[0, 1, 2] == 5
    plots = spark.createDataFrame([("P1", [(0.0, 1.0), (2.0, 1.0)])], "plot_id string, ring array<struct<x:double,y:double>>")
    rasters.write_plots(plots, str(tmp_path / "plots"))
    assert spark.read.option("header", True).csv(str(tmp_path / "plots")).first()["geometry"] == "POLYGON ((0.0 1.0, 2.0 1.0))"
    rasters.write_plots(plots.withColumn("parts", F.array("ring")), str(tmp_path / "json"), "geojson")
    (feature,) = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert feature == {"type": "Feature", "properties": {"plot_id": "P1"}, "geometry": {"type": "Polygon", "coordinates": [[[0.0, 1.0], [2.0, 1.0]]] * 2}}
    with pytest.raises(ValueError, match="form"):
        rasters.write_plots(plots, str(tmp_path / "x"), "shp")


def test_quality_of_a_stream(spark, tmp_path):
    schema = "flight int, y int, x int, b double"
    for f in (1, 2):
        spark.createDataFrame([(f, y, x, 0.1 * f + 0.01 * ((y * 7 + x * 3) % 5)) for y in range(5) for x in range(5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = qc_stream(read_flights(spark, str(tmp_path / "in"), schema), ["b"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"1", "2"}


def test_daily_means_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", 1.0), ("2024-01-01 05:00:00", 3.0), ("2024-01-02 01:00:00", 5.0)], "t string, v double").select(F.to_timestamp("t").alias("t"), "v")
    rows.write.parquet(str(tmp_path / "in"))
    s = daily_means(read_flights(spark, str(tmp_path / "in"), rows.schema), "t", "v")
    q = s.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["n"], r["mean"]) for r in spark.table("daily").collect()) == [(1, 5.0), (2, 2.0)]

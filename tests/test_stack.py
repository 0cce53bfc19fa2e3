from datetime import date

import pytest
from pyspark.sql import functions as F

from furrow.functions.indices import INDICES, Index, list_vi, match_band
from furrow.functions.safe import clamp, divide
from furrow.operators.resample import Grid, resample
from furrow.operators.stack import band_names, compute_vi, flight_stack

NM = [450.0 + 50 * k for k in range(10)]


def raster(spark, value=0.5, n=3, bands=10):
    rows = [(y, x, *[value + 0.01 * k + 0.001 * (y * n + x) for k in range(bands)]) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "y int, x int, " + ", ".join(f"c{k} double" for k in range(bands)))


@pytest.fixture(scope="module")
def stack(spark):
    dates = ["2024-06-01", "2024-03-01", "2024-09-01"]
    return flight_stack([raster(spark, v) for v in (0.2, 0.1, 0.3)], dates, NM, bbch=["41", "21", "65"])


def test_flights_are_in_order_of_date_with_their_stages(stack):
    assert [(f.number, f.date, f.bbch) for f in stack.flights] == [(1, date(2024, 3, 1), "21"), (2, date(2024, 6, 1), "41"), (3, date(2024, 9, 1), "65")]
    first = stack.pixels.where("flight = 1 and y = 0 and x = 0").first()
    assert first["flight_date"] == date(2024, 3, 1) and first["B450nm"] == pytest.approx(0.1)
    assert len(stack) == 3 and "3 flights" in repr(stack)


def test_subset_is_numbered_anew(stack):
    part = stack[[2, 0]]
    assert [f.number for f in part.flights] == [1, 2] and [f.date.month for f in part.flights] == [3, 9]
    assert {r["flight"] for r in part.pixels.select("flight").distinct().collect()} == {1, 2}
    with pytest.raises(ValueError):
        stack[[]]


def test_summary(stack):
    rows = {r["flight"]: r for r in stack.summary().collect()}
    assert len(rows) == 3 and rows[2]["bbch"] == "41" and (rows[2]["n_row"], rows[2]["n_col"], rows[2]["n_bands"]) == (3, 3, 10)


def test_lengths_must_agree(spark):
    r = raster(spark, bands=3)
    with pytest.raises(ValueError, match="length"):
        flight_stack([r, r], ["2024-01-01"], NM[:3])
    with pytest.raises(ValueError, match="wavelengths"):
        flight_stack([r], ["2024-01-01"], NM)
    with pytest.raises(ValueError, match="bands"):
        flight_stack([r, raster(spark, bands=4)], ["2024-01-01", "2024-02-01"], NM[:3])
    with pytest.raises(ValueError, match="bbch"):
        flight_stack([r], ["2024-01-01"], NM[:3], bbch=["1", "2"])
    with pytest.raises(ValueError):
        flight_stack([], [], [])


def test_bands_match_within_the_tolerance_and_ties_go_first():
    assert match_band([650.0, 690.0], 670, 20) == 0
    with pytest.raises(ValueError):
        match_band([649.9], 670, 20)
    assert band_names([452.5, 453.5]) == ("B452nm", "B454nm") and band_names([5.0, 5.0]) == ("B5nm_1", "B5nm_2")


def test_ndvi_by_hand_and_clamped(spark):
    df = spark.createDataFrame([(0, 0, 0.1, 0.5), (0, 1, 0.0, 0.0), (0, 2, -0.5, 0.5), (0, 3, None, 0.5), (0, 4, float("nan"), 0.5)], "y int, x int, red double, nir double")
    s = flight_stack([df], ["2024-01-01"], [670.0, 800.0])
    got = [r["NDVI"] for r in compute_vi(s).pixels.orderBy("x").collect()]
    assert got[0] == pytest.approx(0.4 / 0.6) and got[1] is None and got[2] == 1.0 and got[3] is None and got[4] is None


def test_custom_and_unknown_indices(stack):
    savi = Index({"nir": 800, "red": 670}, 30, lambda c: divide(c["nir"] - c["red"], c["nir"] + c["red"] + 0.5), "soil adjusted")
    assert compute_vi(stack, (), savi).indices == ("CUSTOM",)
    with pytest.raises(ValueError, match="Unknown"):
        compute_vi(stack, "NOPE")
    with pytest.raises(ValueError):
        Index({}, 1, lambda c: c, "")
    assert list_vi(stack.pixels.sparkSession).count() == len(INDICES) == 10


def test_division_like_numeric_rasters(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    d = divide(F.col("a"), F.col("b"))
    assert [r[0] for r in df.select(d).collect()] == [float("inf"), float("-inf"), None, 0.5, None]
    assert [r[0] for r in df.select(clamp(d, -1.0, 1.0)).collect()] == [1.0, -1.0, None, 0.5, None]


def test_indices_don_t_change_under_scaling(spark, stack):
    a = compute_vi(stack, ("NDVI", "GNDVI")).pixels.orderBy("flight", "y", "x").collect()
    scaled = stack.pixels.select("y", "x", "flight", "flight_date", *[(F.col(b) * 7).alias(b) for b in stack.bands])
    from dataclasses import replace

    b = compute_vi(replace(stack, pixels=scaled), ("NDVI", "GNDVI")).pixels.orderBy("flight", "y", "x").collect()
    assert all(p["NDVI"] == pytest.approx(q["NDVI"]) and p["GNDVI"] == pytest.approx(q["GNDVI"]) for p, q in zip(a, b, strict=True))


def test_a_raster_on_another_grid_is_resampled_onto_the_first(spark):
    plane = lambda g: spark.createDataFrame([(y, x, 3.0 + 2 * (g.xmin + (x + 0.5) * g.res) - (g.ymax - (y + 0.5) * g.res)) for y in range(g.n_row) for x in range(g.n_col)], "y int, x int, v double")
    a, b = Grid(4, 4, 0.0, 4.0, 1.0), Grid(6, 6, -0.7, 4.9, 1.0)
    s = flight_stack([plane(a), plane(b)], ["2024-01-01", "2024-02-01"], [800.0], grids=[a, b])
    rows = {(r["flight"], r["y"], r["x"]): r["B800nm"] for r in s.pixels.collect()}
    assert all(rows[2, y, x] == pytest.approx(rows[1, y, x]) for y in range(4) for x in range(4))


def test_resampling_leaves_cells_beyond_the_source_null(spark):
    src = spark.createDataFrame([(y, x, 1.0) for y in range(2) for x in range(2)], "y int, x int, v double")
    got = resample(src, Grid(2, 2, 0, 2, 1.0), Grid(3, 3, 0.25, 2.0, 1.0), ["v"]).collect()
    assert {(r["y"], r["x"]) for r in got if r["v"] is not None} == {(0, 0), (1, 0)}

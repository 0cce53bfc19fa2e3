"""Physical plans: what is read, how often rows move, what is joined how."""

import re
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from furrow.operators import fuse, qc, rank, temporal, zonal
from furrow.operators.plots import PlotGrid
from furrow.operators.resample import Grid
from furrow.operators.stack import compute_vi, stack_table
from furrow.operators.stencil import sobel

NM, BANDS = (550.0, 660.0, 735.0, 790.0), ("green", "red", "rededge", "nir")


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def count(text: str, node: str) -> int:
    tree = text.split("\n\n")[0]
    return len(re.findall(rf"[ +*-] ?{node} \(", tree))


@pytest.fixture(scope="module")
def stack(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("px") / "t")
    px = spark.range(4000).select((F.col("id") / 20 % 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), F.expr("date_add(date'2024-03-01', cast(id div 400 as int) * 10)").alias("flight_date"), *[(F.rand(k) + 0.1).alias(b) for k, b in enumerate(BANDS)], F.lit("unused").alias("note"))
    px.write.parquet(path)
    return stack_table(spark.read.parquet(path), BANDS, NM)


def test_a_season_reads_two_bands_of_its_dates_and_moves_pixels_once(stack):
    text = plan(temporal.integrate_season(compute_vi(stack, "NDVI"), date_from=date(2024, 3, 11), date_to=date(2024, 5, 1)))
    schema = re.search(r"ReadSchema: (.*)", text)[1]
    assert "red:double" in schema and "nir:double" in schema and "green" not in schema and "note" not in schema
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(flight_date,2024-03-11\), LessThanOrEqual\(flight_date,2024-04-30\)", text)
    assert count(text, "Exchange") == 1 and count(text, "HashAggregate") == 2 and not count(text, "Sort") and not count(text, "Window")


def test_a_derivative_moves_pixels_once(stack):
    text = plan(temporal.vi_derivative(compute_vi(stack, "NDVI"), smoothed=True))
    assert count(text, "Exchange") == 1  # smoothing and differences share the partitioning by pixel


def test_regular_grids_need_no_join(stack):
    located = zonal.join_grid(compute_vi(stack, "NDVI").pixels, PlotGrid(4, 4, 5.0, 5.0, 0, 0), Grid(20, 20, 0.0, 0.0, 1.0))
    text = plan(zonal.plot_stats(located, ["row", "col", "flight_date"], "NDVI"))
    assert "Join" not in text and count(text, "Exchange") == 1


def test_stencils_add_up_before_they_move(stack):
    text = plan(sobel(stack.pixels, ["flight"], "nir"))
    assert "Join" not in text and count(text, "Exchange") == 1 and count(text, "HashAggregate") == 2 and not count(text, "Window")


def test_fusion_meets_in_one_pass(spark, stack):
    vi = spark.createDataFrame([("A", date(2024, 5, 1), 0.5)], "plot_id string, flight_date date, mean double")
    truth = spark.createDataFrame([(1, "A", date(2024, 5, 2), 1.0)], "seq int, plot_id string, date date, yld double")
    text = plan(fuse.fuse_ground(vi, truth))
    assert "Join" not in text and count(text, "Window") >= 1 and count(text, "Exchange") <= 2
    assert "unboundedfollowing" not in text.lower()  # such a frame is read anew for every row


def test_fusion_of_many_dates_is_linear(spark):
    began = time.time()
    vi = spark.range(20_000).selectExpr("'A' AS plot_id", "date_add(date'1980-01-01', cast(id as int)) AS flight_date", "1.0D AS mean")
    truth = spark.range(20_000).selectExpr("cast(id as int) AS seq", "'A' AS plot_id", "date_add(date'1980-01-01', cast(id as int)) AS date", "cast(id as double) AS yld")
    got = fuse.fuse_ground(vi, truth).agg(F.count("*"), F.sum("date_lag_days"), F.sum("yld")).first()
    assert tuple(got) == (20_000, 0, 199_990_000.0) and time.time() - began < 60


def test_windows_of_many_flights_are_not_in_the_plan(spark):
    flights = [date.fromordinal(date(2024, 1, 1).toordinal() + k) for k in range(60)]
    px = spark.createDataFrame([(0, x, d, 1.0 + x, 2.0, 3.0, 4.0) for x in range(3) for d in flights], "y int, x int, flight_date date, green double, red double, rededge double, nir double")
    vi = compute_vi(stack_table(px, BANDS, NM), "NDVI")
    means = rank.window_means(vi, vi.pixels.withColumn("plot_id", F.lit("A")), "NDVI")
    assert len(plan(means)) < 100_000 and means.count() == 60 * 59 // 2


def test_no_python_on_the_main_paths(stack):
    for df in (temporal.integrate_season(compute_vi(stack, "NDVI")), sobel(stack.pixels, ["flight"], "nir"), qc.flight_metrics(stack.pixels, BANDS)):
        assert not re.search("Python|Pandas|Arrow", plan(df).split("\n\n")[0])

import itertools
import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import stats
from furrow.functions.stats import correlation_p, incomplete_beta, rank_distances, spearman_p
from furrow.operators import rank, views, zonal
from furrow.operators.fuse import fuse_ground
from furrow.operators.plots import PlotGrid, generate_plot_grid, pick_anchor
from furrow.operators.resample import Grid
from furrow.operators.stack import Flight, VIStack


def ids(spark, **kw):
    return {(r["row"], r["col"]): r["plot_id"] for r in generate_plot_grid(spark, PlotGrid(2, 3, 2.0, 1.0, 0, 0, **kw)).collect()}


def test_ids_by_order(spark):
    assert ids(spark)[2, 1] == "P004" and ids(spark, order="col_major")[2, 1] == "P002"
    assert ids(spark, order="snake")[2, 1] == "P006" and ids(spark, order="snake", compat="reference")[2, 1] == "P004"


def test_rings_area_and_rotation(spark):
    g = {r["plot_id"]: r for r in generate_plot_grid(spark, PlotGrid(2, 3, 2.0, 1.0, 434825, 6668735, 0.5, 0.25)).collect()}
    nw = g["P006"]["ring"][0]
    assert (nw["x"], nw["y"]) == (434827.5, 6668732.5) and g["P006"]["area_m2"] == pytest.approx(2.0, abs=1e-6)
    turned = {r["plot_id"]: r["ring"] for r in generate_plot_grid(spark, PlotGrid(2, 3, 2.0, 1.0, 0, 0, orientation_deg=90)).collect()}
    ne = turned["P001"][1]  # a quarter turn clockwise sends east to south
    assert (ne["x"], ne["y"]) == (pytest.approx(0, abs=1e-12), pytest.approx(-1.0))


@pytest.mark.parametrize("corner,west,north", [("nw", 0, 0), ("ne", -3, 0), ("sw", 0, 4), ("se", -3, 4)])
def test_corners(spark, corner, west, north):
    p = generate_plot_grid(spark, PlotGrid(2, 3, 2.0, 1.0, 0, 0, corner=corner)).where("plot_id = 'P001'").first()["ring"][0]
    assert (p["x"], p["y"]) == (west, north)


@pytest.mark.parametrize("bad", [{"n_row": 0}, {"length": 0}, {"alley_row": -1}, {"order": "odd"}])
def test_bad_grids(bad):
    with pytest.raises(ValueError):
        PlotGrid(**({"n_row": 1, "n_col": 1, "length": 1, "width": 1, "anchor_x": 0, "anchor_y": 0} | bad))
    with pytest.raises(ValueError):
        pick_anchor()


def test_closed_form_and_polygon_join_agree(spark):
    g = PlotGrid(3, 4, 2.5, 1.7, 3.1, 17.3, 0.4, 0.3, orientation_deg=23)
    grid = Grid(60, 60, 0.0, 20.0, 0.33)
    px = spark.range(3600).select((F.col("id") / 60).cast("int").alias("y"), (F.col("id") % 60).cast("int").alias("x"))
    plots = generate_plot_grid(spark, g)
    a = {(r["y"], r["x"]): r["plot_id"] for r in zonal.join_polygons(px, plots, grid).collect()}
    names = {(r["row"], r["col"]): r["plot_id"] for r in plots.collect()}
    b = {(r["y"], r["x"]): names[r["row"], r["col"]] for r in zonal.join_grid(px, g, grid).collect()}
    assert a == b and len(a) > 300
    assert zonal.mask(px, plots, grid).count() == len(a)


def test_boundary_distance(spark):
    plots = spark.createDataFrame([("A", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "plot_id string, ring array<struct<x:double,y:double>>")
    px = spark.createDataFrame([(0, 0), (1, 1), (4, 4), (0, 4)], "y int, x int")  # centres x + .5, 4 - y - .5
    got = {(r["y"], r["x"]): r["dist"] for r in zonal.join_polygons(px, plots, Grid(9, 9, 0.0, 4.0, 1.0), margin=1.0, how="all").collect()}
    assert got == {(0, 0): 0.5, (1, 1): 1.5, (4, 4): pytest.approx(math.sqrt(0.5)), (0, 4): 0.5}


def test_extract_gates_small_plots_and_keeps_empty_ones(spark):
    rows = [("A", date(2024, 1, 1), v) for v in (1.0, 2.0, 3.0, None)] + [("B", date(2024, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "plot_id string, flight_date date, NDVI double")
    vi = VIStack(df, (Flight(1, date(2024, 1, 1)),), ("NDVI",))
    plots = spark.createDataFrame([("A",), ("B",), ("C",)], "plot_id string")
    got = {r["plot_id"]: r for r in zonal.extract_plot(vi, df, plots, stats=("mean", "sd", "median", "cv"), min_pixels=3).collect()}
    assert got["A"]["mean"] == 2.0 and got["A"]["sd"] == 1.0 and got["A"]["median"] == 2.0 and got["A"]["cv"] == 50.0
    assert got["B"]["mean"] is None and got["B"]["n_pixels"] == 1 and got["C"]["mean"] is None and got["C"]["n_pixels"] == 0
    with pytest.raises(ValueError):
        zonal.plot_stats(df, ["plot_id"], "NDVI", ["mode"])


def test_nearest_truth_with_ties_lag_and_missing_plots(spark):
    d = lambda k: date(2024, 5, k)
    vi = spark.createDataFrame([("A", d(10), 0.5), ("B", d(10), 0.6), ("C", d(10), 0.7)], "plot_id string, flight_date date, mean double")
    truth = spark.createDataFrame([(4, "A", d(8), 1.0), (2, "A", d(12), 2.0), (3, "A", d(12), 3.0), (5, "B", d(20), 4.0)], "seq int, plot_id string, date date, yld double")
    got = {r["plot_id"]: r for r in fuse_ground(vi, truth).collect()}
    assert set(got) == {"A"} and got["A"]["yld"] == 2.0 and got["A"]["date_lag_days"] == 2
    more = {r["plot_id"]: r["yld"] for r in fuse_ground(vi, truth, allow_missing=True).collect()}
    assert more == {"A": 2.0, "C": None}
    assert fuse_ground(vi, truth.where("false")).count() == 0
    with pytest.raises(ValueError):
        fuse_ground(vi, truth, ["height"])


def test_p_values():
    assert incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert correlation_p(0.5, 20) == pytest.approx(0.024769, abs=1e-6) and correlation_p(1.0, 5) == 0 and correlation_p(None, 5) is None and correlation_p(0.1, 2) is None


def test_p_of_ranks_without_ties():
    """All orders of few ranks; the series stays close to them and to Student's t."""
    for n in (4, 6):
        every = [sum((a - b) ** 2 for a, b in enumerate(p)) for p in itertools.permutations(range(n))]
        for s in range(0, n * (n * n - 1) // 3 + 1, 2):
            r = 1 - 6 * s / (n**3 - n)
            low, high = sum(x <= s for x in every) / len(every), sum(x >= s for x in every) / len(every)
            assert spearman_p(r, n) == pytest.approx(min(1, 2 * (high if r < 0 else low)))
    assert sum(rank_distances(9)) == math.factorial(9)
    exact = [2 * sum(rank_distances(9)[-(-s // 2) :]) / math.factorial(9) for s in (150, 180, 210)]
    n, stats.EXACT_RANKS = stats.EXACT_RANKS, 8
    try:
        series = [2 * stats.rank_tail(s, 9) for s in (150, 180, 210)]
    finally:
        stats.EXACT_RANKS = n
    assert series == pytest.approx(exact, abs=0.01)
    assert spearman_p(0.3, 60) == pytest.approx(correlation_p(0.3, 60), abs=0.002) and spearman_p(0.1, 2000) == correlation_p(0.1, 2000)
    assert spearman_p(None, 9) is None and spearman_p(0.5, 2) is None and spearman_p(1.0, 5) == pytest.approx(2 / 120)


def test_window_means_equal_direct_integrals(spark):
    rng, n = np.random.default_rng(1), 5
    dates = [date(2024, 1, 1), date(2024, 1, 9), date(2024, 2, 1), date(2024, 2, 20), date(2024, 3, 30)]
    v = rng.random((12, n))
    v[rng.random((12, n)) < 0.15] = np.nan
    rows = [(p, 0, k + 1, dates[k], None if np.isnan(v[p, k]) else float(v[p, k]), f"P{p % 3}") for p in range(12) for k in range(n) if (p, k) != (2, 3)]
    v[2, 3] = np.nan
    df = spark.createDataFrame(rows, "y int, x int, flight int, flight_date date, NDVI double, plot_id string")
    vi = VIStack(df, tuple(Flight(k, d) for k, d in enumerate(dates, 1)), ("NDVI",))
    got = {(r["plot_id"], r["i"], r["j"]): r["v"] for r in rank.window_means(vi, df, "NDVI").collect()}
    t = [(d - dates[0]).days for d in dates]
    for plot in range(3):
        for i in range(n):
            for j in range(i + 1, n):
                auc = [np.trapezoid(v[p, i : j + 1], t[i : j + 1]) for p in range(plot, 12, 3)]
                auc = [a for a in auc if not np.isnan(a)]
                want = got[f"P{plot}", i + 1, j + 1]
                assert want is None if not auc else want == pytest.approx(np.mean(auc))


def test_ranking_finds_the_planted_flight(spark):
    rng = np.random.default_rng(2)
    dates = [date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)]
    trait = rng.random(15)
    rows = [(p, x, k + 1, dates[k], float(trait[p] if k == 1 else rng.random()), f"P{p:02d}") for p in range(15) for x in range(2) for k in range(3)]
    df = spark.createDataFrame(rows, "y int, x int, flight int, flight_date date, NDVI double, plot_id string")
    vi = VIStack(df, tuple(Flight(k, d) for k, d in enumerate(dates, 1)), ("NDVI",))
    gt = spark.createDataFrame([(f"P{p:02d}", float(v)) for p, v in enumerate(trait)], "plot_id string, yld double")
    for method in ("pearson", "spearman"):
        top = rank.optimal_window(vi, gt, "yld", df, method=method, n_top=4).collect()
        assert len(top) == 4 and top[0]["type"] == "single" and top[0]["date_from"] == dates[1] and top[0]["r"] == pytest.approx(1.0) and top[0]["p_value"] < 1e-6 and top[0]["n_plots"] == 15
    constant = gt.withColumn("yld", F.lit(1.0))
    assert all(r["r"] is None for r in rank.optimal_window(vi, constant, "yld", df).collect())
    with pytest.raises(ValueError):
        rank.optimal_window(vi, gt, "height", df)


def test_trait_views(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k + 1, "a") for k in range(6)] + [(None, 1.0, "a")], "mean double, yld double, f string")
    out = views.plot_vi_traits(df, "yld", colour_by=None, facet_by="f")
    line = out["fit"].first()
    assert out["points"].count() == 6 and line["slope"] == pytest.approx(2) and line["r2"] == pytest.approx(1)
    curve = views.plot_vi_traits(df, "yld", colour_by=None, facet_by="f", fit="loess")["fit"].collect()
    assert all(r["y"] == pytest.approx(2 * r["x"] + 1) for r in curve)
    with pytest.raises(ValueError):
        views.plot_vi_traits(df, "height")
    with pytest.raises(ValueError):
        views.plot_vi_traits(df, "yld", fit="cubic")


def test_grid_preview_hides_ids_of_many_plots(spark):
    px = spark.createDataFrame([(0, 0, 1.0)], "y int, x int, b double")
    few, many = (generate_plot_grid(spark, PlotGrid(n, 10, 1, 1, 0, 0)) for n in (2, 6))
    assert views.preview_plot_grid(few, px, ["b"])["outlines"].first()["label"] is not None
    assert views.preview_plot_grid(many, px, ["b"])["outlines"].first()["label"] is None

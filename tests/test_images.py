from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions.quantiles import exact_quantile
from furrow.operators import components, panels, qc, segment, views
from furrow.operators.components import connected_components, label_cells, meet
from furrow.operators.outline import outlines
from furrow.operators.resample import Grid
from furrow.operators.stencil import LAPLACIAN, focal, sobel
from furrow.operators.zonal import join_polygons
from furrow.sources.report import flight_qc_report

NM = [450.0, 550.0, 650.0, 750.0, 850.0]
BANDS = [f"b{k}" for k in range(5)]


def frame(spark, a, flight=1):
    """(bands, rows, columns) as a pixel table."""
    rows = [(flight, y, x, *[None if np.isnan(v) else float(v) for v in a[:, y, x]]) for y in range(a.shape[1]) for x in range(a.shape[2])]
    return spark.createDataFrame(rows, "flight int, y int, x int, " + ", ".join(f"b{k} double" for k in range(len(a))))


def field(panels_on=True, seed=1):
    rng = np.random.default_rng(seed)
    a = np.full((5, 60, 80), 0.05)
    a[:, 20:52, :] += 0.3
    a[3:] *= 1.5
    if panels_on:
        a[:, 2:8, 2:10] = 0.5
        a[:, 50:57, 70:79] = 0.45
    return np.clip(a + rng.normal(0, 0.002, a.shape), 0, 1)


def test_stencils_against_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.random((1, 7, 9))
    a[0, 2, 3] = a[0, 0, 0] = np.nan
    px = frame(spark, a)
    z = np.pad(np.nan_to_num(a[0]), 1)
    kx = np.array([[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
    want = {(y, x): ((z[y : y + 3, x : x + 3] * kx).sum(), (z[y : y + 3, x : x + 3] * kx.T).sum()) for y in range(7) for x in range(9) if not np.isnan(a[0, y, x])}
    got = {(r["y"], r["x"]): (r["gx"], r["gy"]) for r in sobel(px, ["flight"], "b0").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    lap = {(r["y"], r["x"]): r["l"] for r in focal(px, [], "b0", {"l": LAPLACIAN}, need_centre=False).collect()}
    assert len(lap) == 63 and lap[3, 3] == pytest.approx(z[3, 4] + z[5, 4] + z[4, 3] + z[4, 5] - 4 * z[4, 4])


@pytest.mark.parametrize("values", [[1.0, 2, 3, 10], list(range(1000)), [5.0] * 300, [1.0] * 50 + [2.0] * 50, [7.0]])
@pytest.mark.parametrize("q", [0.0, 0.2, 0.5, 0.95, 1.0])
def test_exact_quantiles(spark, values, q):
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(1, None)], "g int, v double")
    assert exact_quantile(df, ["g"], "v", q).first()["q"] == pytest.approx(np.quantile(values, q))
    assert exact_quantile(df, [], "v", q).first()["q"] == pytest.approx(np.quantile(values, q))


@pytest.mark.parametrize("hot", [None, 1 / 50])
def test_components_of_random_graphs(spark, monkeypatch, hot):
    """Also where the centres of two stars count as hot."""
    if hot:
        monkeypatch.setattr(components, "HOT_LEAST", 0)
        monkeypatch.setattr(components, "HOT_SHARE", hot)
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + k, 201 + k) for k in range(40)]
    edges += [(300, k) for k in range(301, 340)] + [(399, k) for k in range(340, 399)]
    root = list(range(400))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for e in edges if e[0] != e[1] for k in e}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_of_a_hot_key_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_LEAST", 0)
    rows = spark.range(20_000).selectExpr("case when id % 3 = 0 then 7 else id + 10 end AS u", "id AS v")
    few = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
    got, want = meet(rows, few, ["u"], 20_000), rows.join(few.drop("size"), "u")
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())
    text = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "BroadcastHashJoin [u" in text and "LeftAnti" in text


def test_patches_are_labelled_by_their_first_cell(spark):
    cells = [(0, 0), (0, 1), (1, 2), (3, 3), (5, 5), (4, 4), (7, 0), (7, 2), (8, 1)]
    got = {(r["y"], r["x"]): r["label"] for r in label_cells(spark.createDataFrame(cells, "y int, x int"), []).collect()}
    assert got[1, 2] == got[0, 1] == got[0, 0] == 0 and got[5, 5] == got[3, 3] == 3 * 2**32 + 3 and got[7, 0] == got[7, 2] == got[8, 1] == 7 * 2**32
    four = {(r["y"], r["x"]): r["label"] for r in label_cells(spark.createDataFrame(cells, "y int, x int"), [], 4).collect()}
    assert four[1, 2] != four[0, 1] == four[0, 0]


def test_panels_are_found_and_calibrate_to_their_values(spark):
    px, grid = frame(spark, field()), Grid(60, 80, 0.0, 6.0, 0.1)
    df = panels.detect_panels(px, BANDS, grid, 2, (0.1, 2.0), quantile=0.97).cache()
    found = df.collect()
    assert [r["panel_id"] for r in found] == ["panel_1", "panel_2"]
    assert sorted(round(r["area_m2"], 2) for r in found) == [0.48, 0.63] and all(0 <= r["confidence"] <= 1 and r["spectral_cv"] < 0.08 for r in found)
    known = {r["panel_id"]: 0.6 if r["area_m2"] < 0.5 else 0.3 for r in found}
    out = panels.calibrate_reflectance(px, df, grid, BANDS, known)
    inside = out.where("y between 2 and 7 and x between 2 and 9").agg(F.avg("b2")).first()[0]
    assert inside == pytest.approx(0.6, abs=1e-6)
    low, high = out.agg(F.min("b3"), F.max("b3")).first()
    assert low >= 0 and high <= 1
    one = panels.calibrate_reflectance(px, df.limit(1), grid, BANDS, [0.5])
    assert one.count() == 4800
    with pytest.raises(ValueError, match="matching panel"):
        panels.calibrate_reflectance(px, df, grid, BANDS, {"other": 0.5})
    same = panels.fit_coefficients(spark.createDataFrame([("panel_1", 0.5, 0.1), ("panel_2", 0.2, 0.3)], "panel_id string, b0 double, b1 double"), ["b0", "b1"], [0.5, 0.2], per_band=False)
    assert same[0][1:] == same[1][1:]
    spectra = views.panel_qc_plot(px, df, BANDS, NM)["spectra"]
    assert spectra.count() == 10 and {r["x"] for r in spectra.collect()} == set(NM)


def test_no_panel_or_no_flat_one(spark):
    px, grid = frame(spark, field()), Grid(60, 80, 0.0, 6.0, 0.1)
    with pytest.raises(ValueError):
        panels.detect_panels(px, BANDS, grid, 1, (50.0, 60.0))
    with pytest.warns(UserWarning):
        assert panels.detect_panels(px, BANDS, grid, 1, flatness=1e-9).count() == 1
    single = panels.panel_candidates(px, BANDS, grid, (0.0, 2.0), 0.97, compat="reference")
    assert {round(r["area_m2"], 4) for r in single.select("area_m2").distinct().collect()} == {0.01}


def test_segmentation_refinement_and_quality(spark):
    a = np.full((3, 48, 64), 0.1)
    for y in (4, 28):
        for x in (4, 36):
            a[:, y : y + 16, x : x + 24] = 0.5
            a[1, y : y + 16, x : x + 24] = 0.65
    px, grid = frame(spark, a), Grid(48, 64, 0.0, 4.8, 0.1)
    for method in ("profile", "gradient", "combined"):
        plots = segment.segment_plots(px, BANDS[:3], grid, method=method, expected_rows=2, expected_cols=2, min_area_m2=0.5, sigma=1).cache()
        got = plots.collect()
        assert got and all(0 <= r["quality"] <= 1 for r in got) and {"plot_id", "row_idx", "col_idx", "area_m2", "ring"} <= set(got[0].asDict())
    moved = segment.refine_plot_boundaries(plots, px, "b1", grid).collect()
    assert all(0 <= r["shift_m"] <= 0.3 for r in moved) and len(moved) == len(got)
    qc_view = views.plot_segmentation_qc(plots, px, BANDS[:3])
    assert {r["good"] for r in qc_view["outlines"].collect()} <= {True, False}
    with pytest.raises(ValueError, match="wavelengths"):
        segment.segment_plots(frame(spark, field()), BANDS, grid)
    with pytest.raises(ValueError):
        segment.gap_mask(px, "other")


def test_patches_of_the_interior_are_plots(spark):
    gap = lambda y, x: int(y % 5 == 0 or x % 5 == 0)
    df = spark.createDataFrame([(y, x, 0.5, gap(y, x)) for y in range(11) for x in range(11)], "y int, x int, contrast double, gap int")
    grid = Grid(11, 11, 0.0, 11.0, 1.0)
    got = {r["plot_id"]: r for r in segment.plot_polygons(df, grid, expected_rows=2, expected_cols=2).collect()}
    assert sorted(got) == ["P1", "P2", "P3", "P4"] and (got["P2"]["row_idx"], got["P2"]["col_idx"]) == (1, 2) and (got["P3"]["row_idx"], got["P3"]["col_idx"]) == (2, 1)
    assert all(r["area_m2"] == 16 for r in got.values())
    assert segment.plot_polygons(df, grid, compat="reference").count() == 1


def test_orientation_of_stripes(spark):
    rows = frame(spark, np.tile((np.arange(40) // 4 % 2)[None, :, None] * 0.5, (1, 1, 40)))
    across = segment.orientation(rows, [], "b0").first()["orientation_deg"]
    cols = frame(spark, np.tile((np.arange(40) // 4 % 2)[None, None, :] * 0.5, (1, 40, 1)))
    along = segment.orientation(cols, [], "b0").first()["orientation_deg"]
    assert across == pytest.approx(92.5) and along == pytest.approx(177.5)


def test_flat_cells_only_count_in_the_reference(spark):
    wide = frame(spark, np.tile((np.arange(40) // 8 % 2)[None, None, :] * 0.5, (1, 40, 1)))
    assert segment.orientation(wide, [], "b0").first()["orientation_deg"] == pytest.approx(177.5)
    assert segment.orientation(wide, [], "b0", compat="reference").first()["orientation_deg"] == pytest.approx(92.5)


def inside_rings(rings, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for r in rings for a, b in zip(r, r[1:])) % 2 == 1


def test_outlines_hold_their_cells_and_no_others(spark):
    """With holes, parts that touch at a corner and several rasters."""
    rng = np.random.default_rng(7)
    cells = {(f, y, x) for f in (1, 2) for y in range(14) for x in range(14) if rng.random() < 0.62}
    cells |= {(1, y, x) for y in range(20, 26) for x in range(6) if not (2 <= y - 20 <= 3 and 2 <= x <= 3)}
    df = spark.createDataFrame(sorted(cells), "flight int, y int, x int")
    labels = label_cells(df, ["flight"]).cache()
    by = {(r["flight"], r["y"], r["x"]): r["label"] for r in labels.collect()}
    got = outlines(labels, Grid(30, 14, 100.0, 50.0, 0.5), ["flight"]).collect()
    assert {(r["flight"], r["label"]) for r in got} == {(k[0], v) for k, v in by.items()}
    for r in got:
        rings = [[(p["x"], p["y"]) for p in ring] for ring in [r["ring"], *r["parts"]]]
        assert all(ring[0] == ring[-1] and len(ring) >= 5 for ring in rings)
        for y in range(27):
            for x in range(14):
                assert inside_rings(rings, 100 + (x + 0.5) * 0.5, 50 - (y + 0.5) * 0.5) == (by.get((r["flight"], y, x)) == r["label"])
    frame_ = next(r for r in got if r["label"] == 20 * 2**32)
    assert len(frame_["ring"]) == 5 and len(frame_["parts"]) == 1
    sizes = {(r["flight"], r["plot_id"]): r["ring_area_m2"] for r in segment.outlines(spark.createDataFrame([(r["flight"], str(r["label"]), r["ring"], r["parts"]) for r in got], "flight int, plot_id string, ring array<struct<x:double,y:double>>, parts array<array<struct<x:double,y:double>>>")).collect()}
    for (f, label), area in sizes.items():
        assert area == pytest.approx(0.25 * sum(k[0] == f and v == int(label) for k, v in by.items()))


def test_no_plot_large_enough_is_an_error(spark):
    px = frame(spark, np.random.default_rng(1).random((1, 12, 12)))
    with pytest.raises(ValueError, match="no plots"):
        segment.segment_plots(px, ["b0"], Grid(12, 12, 0.0, 1.2, 0.1), min_area_m2=50.0, sigma=1)


def test_a_field_sized_polygon_among_plots(spark):
    """Bins follow the ordinary plot, so a large one doesn't put all pixels beside all plots."""
    px = spark.createDataFrame([(y, x) for y in range(60) for x in range(60)], "y int, x int")
    ring = lambda x, y, w: [(x, y), (x + w, y), (x + w, y - w), (x, y - w), (x, y)]
    rows = [("all", ring(0.0, 60.0, 60.0))] + [(f"p{k}_{j}", ring(4.0 * k, 60.0 - 4 * j, 3.0)) for k in range(15) for j in range(15)]
    plots = spark.createDataFrame(rows, "plot_id string, ring array<struct<x:double,y:double>>")
    got = {r["plot_id"]: r["count"] for r in join_polygons(px, plots, Grid(60, 60, 0.0, 60.0, 1.0)).groupBy("plot_id").count().collect()}
    assert got.pop("all") == 3600 and len(got) == 225 and set(got.values()) == {9}


def test_what_is_printed_of_a_summary(spark):
    s = spark.createDataFrame([("a", "Accept"), ("b", "Reject"), ("c", "Reject")], "label string, recommendation string")
    with pytest.warns(UserWarning, match="b, c"):
        assert qc.describe(s).splitlines() == ["Flights checked: 3", "  Accept: 1", "  Caution: 0", "  Reject: 2", "Rejected: b, c"]
    assert "Rejected" not in qc.describe(s.where("label = 'a'"))


def test_gaussian_smoothing_keeps_the_edges(spark):
    p = spark.createDataFrame([(k, float(k == 10)) for k in range(21)], "at int, mean double")
    got = {r["at"]: r["smooth"] for r in segment.gaussian_smooth(p, [], "at", "mean", 1.0).collect()}
    assert got[10] == pytest.approx(segment.kernel(1.0)[3]) and got[0] == 0 and sum(got.values()) == pytest.approx(1)
    assert segment.gaussian_smooth(p, [], "at", "mean", 0).where("smooth <> mean").count() == 0


def qc_row(spark, a, **kw):
    return qc.flight_qc(frame(spark, a), [f"b{k}" for k in range(len(a))], qc.QCParams(**kw)).first()


def test_quality_of_flights(spark):
    a = field(panels_on=False)[:4]
    clean, blurred = qc_row(spark, a), qc_row(spark, np.full((4, 20, 20), 0.5))
    assert 0 <= clean["overall_score"] <= 100 and clean["recommendation"] in ("Accept", "Caution", "Reject")
    assert blurred["flag_blur"] and blurred["flag_saturation"] and blurred["sat_frac_pct"] == 100
    holes = a.copy()
    holes[:, ::2] = np.nan
    assert qc_row(spark, holes)["flag_nodata"] and qc_row(spark, holes)["nodata_pct"] == 50
    assert qc_row(spark, a, expected_bands=5)["flag_bands"] and not qc_row(spark, a, expected_bands=4)["flag_bands"]
    everything = qc_row(spark, np.full((2, 4, 4), np.nan))
    assert everything["nodata_pct"] == 100 and everything["mean_brightness"] is None


def test_laplacian_variance_by_numpy(spark):
    a = np.random.default_rng(5).random((1, 6, 8)) * 100
    z = np.pad(a[0], 1)
    lap = z[:-2, 1:-1] + z[2:, 1:-1] + z[1:-1, :-2] + z[1:-1, 2:] - 4 * a[0]
    assert qc.laplacian_variance(frame(spark, a), ["flight"], "b0").first()["lap_var"] == pytest.approx(lap.var(ddof=1))


def test_report(spark, tmp_path):
    two = frame(spark, field()[:4]).union(frame(spark, np.full((4, 8, 8), 0.5), 2)).withColumn("label", F.concat(F.lit("<b>"), F.col("flight"))).withColumn("day", F.lit(date(2024, 4, 1)))
    s = qc.flight_qc(two, BANDS[:4], keys=("label",), label="label", date="day")
    path = flight_qc_report(s, str(tmp_path / "qc.html"))
    text = open(path).read()
    assert text.startswith("<!DOCTYPE html>") and "&lt;b&gt;1" in text and "<b>1" not in text.replace("<b>Flights", "")
    assert sum(r["flights"] for r in qc.qc_counts(s).collect()) == 2
    with pytest.raises(ValueError):
        flight_qc_report(s.drop("label"), str(tmp_path / "no.html"))

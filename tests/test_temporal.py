from datetime import date
from functools import reduce

import pytest
from pyspark.sql import functions as F

from furrow.operators import temporal
from furrow.operators.stack import Flight, FlightStack, VIStack

DATES = (date(2024, 3, 1), date(2024, 3, 11), date(2024, 3, 31))
#: Values of three flights by pixel; the second has a NULL, the third no row on the last flight.
VALUES = {(0, 0): (0.2, 0.4, 0.1), (0, 1): (0.3, None, 0.5), (0, 2): (0.6, 0.6)}


@pytest.fixture(scope="module")
def vi(spark):
    rows = [(y, x, k + 1, DATES[k], v) for (y, x), vs in VALUES.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "y int, x int, flight int, flight_date date, NDVI double")
    return VIStack(df, tuple(Flight(k, d, s) for k, (d, s) in enumerate(zip(DATES, ("21", "41", None), strict=True), 1)), ("NDVI",))


def by_pixel(df, col="auc"):
    return {(r["y"], r["x"]): r[col] for r in df.collect()}


def test_trapezoid_and_step_by_hand(vi):
    got = by_pixel(temporal.integrate_season(vi))
    assert got[0, 0] == pytest.approx(0.3 * 10 + 0.25 * 20) and got[0, 1] is None and got[0, 2] is None
    step = by_pixel(temporal.integrate_season(vi, method="step"))
    assert step[0, 0] == pytest.approx(0.2 * 10 + 0.4 * 20) and step[0, 1] is None and step[0, 2] == pytest.approx(18)


def test_integrals_of_adjacent_windows_add_up(vi):
    part = lambda a, b: by_pixel(temporal.integrate_season(vi, date_from=a, date_to=b))[0, 0]
    assert part(DATES[0], DATES[1]) + part(DATES[1], DATES[2]) == pytest.approx(by_pixel(temporal.integrate_season(vi))[0, 0])
    assert by_pixel(temporal.integrate_season(vi, units="doy")) == pytest.approx(by_pixel(temporal.integrate_season(vi)))


def test_stage_windows(vi):
    got = by_pixel(temporal.integrate_season(vi, bbch_from=20, bbch_to=45))
    assert got[0, 0] == pytest.approx(3.0) and got[0, 2] == pytest.approx(6.0)
    with pytest.raises(ValueError, match="2 flights"):
        temporal.integrate_season(vi, bbch_from=41, bbch_to=41)


def test_errors(vi):
    with pytest.raises(ValueError, match="2 flights"):
        temporal.integrate_season(vi, date_from=date(2025, 1, 1))
    with pytest.raises(ValueError, match="Unknown"):
        temporal.integrate_season(vi, "EVI")
    with pytest.raises(ValueError):
        temporal.integrate_season(vi, method="simpson")
    with pytest.raises(ValueError):
        temporal.vi_derivative(vi, units="years")


def test_derivatives_by_hand(vi):
    rows = {(r["x"], r["interval"]): r["ddt"] for r in temporal.vi_derivative(vi).collect()}
    assert rows[0, "2024-03-01_to_2024-03-11"] == pytest.approx(0.02) and rows[0, "2024-03-11_to_2024-03-31"] == pytest.approx(-0.015)
    assert rows[1, "2024-03-01_to_2024-03-11"] is None and rows[2, "2024-03-11_to_2024-03-31"] is None
    weeks = {(r["x"], r["interval"]): r["ddt"] for r in temporal.vi_derivative(vi, units="weeks").collect()}
    assert weeks[0, "2024-03-01_to_2024-03-11"] == pytest.approx(0.14)


def test_derivatives_telescope(vi):
    steps = temporal.vi_derivative(vi).where("x = 0").select(F.sum(F.col("ddt") * F.datediff("date_to", "date_from"))).first()[0]
    assert steps == pytest.approx(0.1 - 0.2)


def test_smoothing_needs_all_values(vi):
    got = {(r["x"], r["flight"]): r["NDVI"] for r in temporal.smooth(vi).pixels.collect()}
    assert got[0, 1] == pytest.approx(0.3) and got[0, 2] == pytest.approx(0.7 / 3) and got[0, 3] == pytest.approx(0.25)
    assert got[1, 1] is None and got[1, 2] is None and got[2, 1] == pytest.approx(0.6) and got[2, 2] is None


def test_stages_of_flights(spark, vi):
    obs = spark.createDataFrame([(1, date(2024, 3, 16), "30"), (2, date(2024, 3, 6), "20"), (3, None, "99")], "seq int, date date, bbch string")
    flights = spark.createDataFrame([(f.number, f.date) for f in vi.flights], "flight int, flight_date date")
    near = {r["flight"]: r["bbch"] for r in temporal.tag_flights(flights, obs).collect()}
    assert near == {1: "20", 2: "30", 3: "30"}  # the second flight is as near to both: the first listed
    lin = {r["flight"]: r["bbch"] for r in temporal.tag_flights(flights, obs, "linear").collect()}
    assert lin == {1: "20", 2: "25", 3: "30"}
    stack = FlightStack(vi.pixels, vi.flights, (800.0,), ("NDVI",))
    assert [f.bbch for f in temporal.phenostage_tag(stack, obs).flights] == ["20", "30", "30"]


def test_more_key_columns_keep_fields_apart(spark, vi):
    both = reduce(lambda a, b: a.union(b), [vi.pixels.select(F.lit(f).alias("field"), "y", "x", "flight", "flight_date", (F.col("NDVI") * f).alias("NDVI")) for f in (1, 2)])
    got = {(r["field"], r["x"]): r["auc"] for r in temporal.integrate_season(VIStack(both, vi.flights, vi.indices, ("field", "y", "x"))).collect()}
    assert got[2, 0] == pytest.approx(2 * got[1, 0])


def test_extremes_of_the_rate(spark):
    rows = [("a", date(2024, 1, 1), 0.1), ("a", date(2024, 1, 1), 0.3), ("b", date(2024, 2, 1), 0.2), ("c", date(2024, 3, 1), -0.5), ("d", date(2024, 4, 1), -0.5), ("e", date(2024, 5, 1), None)]
    rates = spark.createDataFrame(rows, "interval string, date_from date, ddt double")
    got = {r["kind"]: (r["interval"], r["rate"]) for r in temporal.rate_extremes(rates).collect()}
    assert got == {"fastest": ("a", pytest.approx(0.2)), "slowest": ("c", -0.5)}
    assert temporal.rate_extremes(rates.where("ddt is null")).count() == 0

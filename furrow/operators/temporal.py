"""Seasonal integrals, derivatives, smoothing and growth stages."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stack import Flight, FlightStack, VIStack, lookup


def season(flights: tuple[Flight, ...], date_from: date | None = None, date_to: date | None = None, bbch_from: int | None = None, bbch_to: int | None = None) -> list[Flight]:
    """Flights between two dates, both included; stages given override the dates."""
    staged = []
    for f in flights:
        try:
            staged.append((int(f.bbch), f.date))
        except (TypeError, ValueError):
            pass
    if bbch_from is not None or bbch_to is not None:
        if not staged:
            raise ValueError("a growth stage window needs a stack whose flights have stages")
        if bbch_from is not None:
            date_from = min((d for s, d in staged if s >= bbch_from), default=None)
        if bbch_to is not None:
            date_to = max((d for s, d in staged if s <= bbch_to), default=None)
        if (bbch_from is not None and date_from is None) or (bbch_to is not None and date_to is None):
            raise ValueError("at least 2 flights must lie in the growth stage window")
    out = [f for f in flights if (date_from is None or f.date >= date_from) and (date_to is None or f.date <= date_to)]
    if len(out) < 2:
        raise ValueError(f"at least 2 flights must lie in the window, found {len(out)}")
    return out


def days(flights: list[Flight], units: str = "days") -> list[float]:
    if units == "days":
        return [float((f.date - flights[0].date).days) for f in flights]
    if units == "doy":
        return [float(f.date.timetuple().tm_yday) for f in flights]
    raise ValueError("units must be days or doy")


def integrate_season(vi: VIStack, index: str | None = None, date_from: date | None = None, date_to: date | None = None, bbch_from: int | None = None, bbch_to: int | None = None, stack: FlightStack | None = None, method: str = "trapezoid", units: str = "days") -> DataFrame:
    """keys, auc: the integral over the season of each pixel; NULL where a used flight has none.

    Both rules are weighted sums with weights from the dates alone, so one partial aggregate by pixel
    does it, without sorting a pixel's flights.
    """
    name = vi.resolve(index)
    used = season(stack.flights if stack else vi.flights, date_from, date_to, bbch_from, bbch_to)
    t = days(used, units)
    if method == "trapezoid":
        gaps = [b - a for a, b in zip(t, t[1:])]
        weights = [((gaps[k - 1] if k else 0.0) + (gaps[k] if k < len(gaps) else 0.0)) / 2 for k in range(len(t))]
    elif method == "step":
        used, weights = used[:-1], [b - a for a, b in zip(t, t[1:])]
    else:
        raise ValueError("method must be trapezoid or step")
    numbers = [f.number for f in used]
    rows = vi.pixels.where(F.col("flight_date").between(used[0].date, used[-1].date) & F.col("flight").isin(numbers))
    weight = lookup("flight", dict(zip(numbers, weights, strict=True)))
    total = rows.groupBy(*vi.keys).agg(F.sum(F.col(name) * weight).alias("s"), F.count(name).alias("n"))
    return total.select(*vi.keys, F.when(F.col("n") == len(used), F.col("s")).alias("auc"))


def smooth(vi: VIStack, index: str | None = None) -> VIStack:
    """Centred three-flight means, two-flight at the ends; NULL where a flight of the three has none."""
    name, n = vi.resolve(index), len(vi.flights)
    w = Window.partitionBy(*vi.keys).orderBy("flight").rangeBetween(-1, 1)
    wanted = F.least(F.lit(n), F.col("flight") + 1) - F.greatest(F.lit(1), F.col("flight") - 1) + 1
    mean = F.when(F.count(name).over(w) == wanted, F.sum(name).over(w) / wanted)
    return replace(vi, pixels=vi.pixels.select(*vi.keys, "flight", "flight_date", mean.alias(name)), indices=(name,))


def vi_derivative(vi: VIStack, index: str | None = None, smoothed: bool = False, units: str = "days") -> DataFrame:
    """keys, interval (``d1_to_d2``), date_from, date_to, ddt between neighbouring flights.

    Rows stand for pixels of the first flight of an interval; ddt is NULL where either flight has none.
    """
    if len(vi.flights) < 2:
        raise ValueError("at least 2 flights are needed for a derivative")
    if units not in ("days", "weeks"):
        raise ValueError("units must be days or weeks")
    name = vi.resolve(index)
    rows = smooth(vi, name).pixels if smoothed else vi.pixels
    w = Window.partitionBy(*vi.keys).orderBy("flight")
    after = {f.number: g.date for f, g in zip(vi.flights, vi.flights[1:])}
    gap = F.datediff("date_to", "date_from") / (7.0 if units == "weeks" else 1.0)
    step = rows.select(*vi.keys, "flight", F.col("flight_date").alias("date_from"), F.col(name).alias("v"), F.when(F.lead("flight").over(w) == F.col("flight") + 1, F.lead(name).over(w)).alias("next"))
    step = step.where(F.col("flight") < len(vi.flights)).withColumn("date_to", lookup("flight", after))
    label = F.concat(F.col("date_from").cast("string"), F.lit("_to_"), F.col("date_to").cast("string"))
    return step.select(*vi.keys, label.alias("interval"), "date_from", "date_to", F.try_divide(F.col("next") - F.col("v"), gap).alias("ddt"))


def rate_extremes(rates: DataFrame) -> DataFrame:
    """kind (fastest, slowest), interval, rate: the intervals of the largest and the least mean rate of
    change over all pixels (fastest green-up, peak senescence); of equal ones the earlier.

    rates: what vi_derivative returns.
    """
    mean = rates.groupBy("interval", "date_from").agg(F.avg("ddt").alias("rate")).where("rate is not null")
    row = F.struct("interval", "rate")
    later = F.datediff("date_from", F.lit(date(1970, 1, 1)))
    both = mean.agg(F.max_by(row, F.struct("rate", -later)).alias("fastest"), F.min_by(row, F.struct("rate", later)).alias("slowest"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("r")) for k in ("fastest", "slowest")]))
    return both.select(kinds.alias("e")).select("e.kind", "e.r.interval", "e.r.rate").where("interval is not null")


def tag_flights(flights: DataFrame, obs: DataFrame, method: str = "nearest") -> DataFrame:
    """flight, flight_date, bbch from observations (seq, date, bbch).

    nearest: the stage observed nearest in time, of equally near ones the first by seq. linear: between
    the means of neighbouring dates, constant beyond them, rounded half to even. The observations of a
    season are one array beside each flight.
    """
    day = F.datediff("date", F.lit(date(1970, 1, 1)))
    own = F.datediff("flight_date", F.lit(date(1970, 1, 1)))
    clean = obs.where("date is not null and bbch is not null")
    if method == "nearest":
        listed = clean.agg(F.collect_list(F.struct("seq", day.alias("d"), F.col("bbch").cast("string").alias("b"))).alias("o"))
        stage = F.array_min(F.transform("o", lambda x: F.struct(F.abs(x["d"] - own).alias("lag"), x["seq"].alias("seq"), x["b"].alias("b"))))["b"]
    elif method == "linear":
        by_day = clean.select(day.alias("d"), F.expr("try_cast(bbch AS double)").alias("b")).where("b is not null").groupBy("d").agg(F.avg("b").alias("b"))
        listed = by_day.agg(F.collect_list(F.struct("d", "b")).alias("o"))
        before = F.array_max(F.filter("o", lambda x: x["d"] <= own))
        after = F.array_min(F.filter("o", lambda x: x["d"] >= own))
        a, z = F.coalesce(before, after), F.coalesce(after, before)
        value = F.coalesce(a["b"] + (z["b"] - a["b"]) * F.try_divide(own - a["d"], z["d"] - a["d"]), a["b"])
        stage = F.bround(value, 0).cast("int").cast("string")
    else:
        raise ValueError("method must be nearest or linear")
    met = flights.withColumn("one", F.lit(1)).join(F.broadcast(listed.withColumn("one", F.lit(1))), "one")
    return met.select("flight", "flight_date", stage.alias("bbch"))


def phenostage_tag(stack: FlightStack, obs: DataFrame, method: str = "nearest") -> FlightStack:
    """The stack with stages from observations on its flights."""
    stages = {r["flight"]: r["bbch"] for r in tag_flights(stack.flights_frame(), obs, method).collect()}
    return replace(stack, flights=tuple(replace(f, bbch=stages[f.number]) for f in stack.flights))

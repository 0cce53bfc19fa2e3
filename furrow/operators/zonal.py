"""Pixels and plots: zonal joins, masks and per-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import divide
from .plots import PlotGrid
from .resample import Grid
from .stack import VIStack

#: Bins that plots lie in on average at most.
BINS = 100
STATS = {"mean": "avg", "sd": "stddev_samp", "median": "median"}


def edges(ring: Column) -> Column:
    """The ring's sides as x1, y1, x2, y2."""
    nxt = lambda i: F.element_at(ring, (i + 1) % F.size(ring) + 1)
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), nxt(i)["x"].alias("x2"), nxt(i)["y"].alias("y2")))


def inside(px: Column, py: Column, sides: Column) -> Column:
    """Whether a point lies in a ring: an odd number of sides to its east."""
    crossed = F.filter(sides, lambda s: ((s["y1"] > py) != (s["y2"] > py)) & (px < (s["x2"] - s["x1"]) * F.try_divide(py - s["y1"], s["y2"] - s["y1"]) + s["x1"]))
    return F.size(crossed) % 2 == 1


def boundary_distance(px: Column, py: Column, sides: Column) -> Column:
    """Distance of a point from the nearest side of a ring."""

    def to(s: Column) -> Column:
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        t = F.coalesce(F.try_divide((px - s["x1"]) * dx + (py - s["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(px - s["x1"] - t * dx, py - s["y1"] - t * dy)

    return F.array_min(F.transform(sides, to))


def all_sides(plots: DataFrame) -> Column:
    """The sides of a plot's ring and, where it has such, of its other parts and holes."""
    if "parts" not in plots.columns:
        return edges(F.col("ring"))
    return F.flatten(F.transform(F.concat(F.array("ring"), F.coalesce("parts", F.array().cast(plots.schema["parts"].dataType))), edges))


def join_polygons(pixels: DataFrame, plots: DataFrame, grid: Grid, margin: float = 0.0, how: str = "inside", bin_m: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """pixels with the plot_id (and dist, from the boundary) of each plot that holds their centre.

    how: inside; boundary (within margin of the boundary); or all of both. keys: columns of both, such as
    the flight whose plots they are. Plots and pixels meet on square bins, an equi-join that Catalyst
    broadcasts if plots are small. Bins are as wide as an ordinary plot, and a large one lies in many;
    they are wider only where plots would lie in more than BINS bins on average.
    """
    keys = list(keys)
    box = plots.select(*keys, "plot_id", all_sides(plots).alias("sides"))
    xs, ys = F.transform("sides", lambda p: p["x1"]), F.transform("sides", lambda p: p["y1"])
    box = box.select(*keys, "plot_id", "sides", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    if bin_m is None:
        wide, high = F.col("x1") - F.col("x0") + 2 * margin, F.col("y1") - F.col("y0") + 2 * margin
        r = box.agg(F.percentile_approx(F.greatest(wide, high), 0.5).alias("w"), F.avg(wide * high).alias("area")).first()
        bin_m = max(r["w"] or 0.0, ((r["area"] or 0.0) / BINS) ** 0.5, grid.res)
    bins = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - margin) / bin_m), F.floor((F.col(b) + margin) / bin_m)))
    dealt = box.withColumn("bx", bins("x0", "x1")).withColumn("by", bins("y0", "y1")).select(*keys, "plot_id", "sides", "bx", "by")
    cx, cy = grid.centre()
    at = pixels.withColumn("px", cx).withColumn("py", cy)
    at = at.withColumn("bx", F.floor(F.col("px") / bin_m)).withColumn("by", F.floor(F.col("py") / bin_m))
    met = at.join(dealt, [*keys, "bx", "by"])
    held, dist = inside(F.col("px"), F.col("py"), F.col("sides")), boundary_distance(F.col("px"), F.col("py"), F.col("sides"))
    if how == "inside" and not margin:
        return met.where(held).drop("bx", "by", "sides")
    met = met.withColumn("dist", dist).withColumn("held", held)
    near = {"inside": F.col("held"), "boundary": F.col("dist") <= margin, "all": F.col("held") | (F.col("dist") <= margin)}[how]
    return met.where(near).drop("bx", "by", "sides")


def mask(pixels: DataFrame, plots: DataFrame, grid: Grid) -> DataFrame:
    """Pixels whose centre some plot holds (crop and mask)."""
    return join_polygons(pixels, plots, grid).select(*pixels.columns).distinct()


def join_grid(pixels: DataFrame, plots: PlotGrid, grid: Grid) -> DataFrame:
    """pixels with row, col of their plot of a regular grid; no join at all."""
    row, col = plots.cell(*grid.centre())
    return pixels.withColumn("row", row).withColumn("col", col).where("row is not null")


def plot_stats(values: DataFrame, by: list[str], value: str, stats: Sequence[str] = ("mean",), min_pixels: int = 5) -> DataFrame:
    """by, n_pixels and the statistics of non-NULL values; all NULL below min_pixels."""
    if bad := set(stats) - {*STATS, "cv"}:
        raise ValueError(f"unknown statistics: {', '.join(sorted(bad))}")
    n = F.count(value)
    made = {"mean": F.avg(value), "sd": F.stddev_samp(value), "median": F.median(value)}
    made["cv"] = divide(made["sd"], made["mean"]) * 100
    return values.groupBy(*by).agg(n.alias("n_pixels"), *[F.when(n >= min_pixels, made[s]).alias(s) for s in stats])


def extract_plot(vi: VIStack, located: DataFrame, plots: DataFrame, indices: Sequence[str] | None = None, stats: Sequence[str] = ("mean",), min_pixels: int = 5) -> DataFrame:
    """index, flight_date, plot_id, n_pixels and statistics of every plot on every flight and index.

    located: vi's pixels with plot_id. plots: the plot_ids; a plot without a pixel has NULL statistics.
    """
    names = [vi.resolve(i) for i in indices] if indices else list(vi.indices)
    long = located.unpivot(["plot_id", "flight_date"], names, "index", "v")
    found = plot_stats(long, ["index", "flight_date", "plot_id"], "v", stats, min_pixels)
    dates = F.explode(F.array(*[F.lit(f.date) for f in vi.flights]))
    wanted = plots.select("plot_id").distinct().withColumn("flight_date", dates).withColumn("index", F.explode(F.array(*map(F.lit, names))))
    out = wanted.join(found, ["index", "flight_date", "plot_id"], "left")
    return out.select("index", "flight_date", "plot_id", F.coalesce("n_pixels", F.lit(0)).alias("n_pixels"), *stats)

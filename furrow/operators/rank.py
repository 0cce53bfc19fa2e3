"""Which flight or window of flights predicts a trait best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import pearson
from ..functions.stats import correlation_p_udf
from .stack import VIStack, lookup
from .temporal import days

RANKING = ["type", "date_from", "date_to", "r", "r2", "p_value", "n_plots"]


def single_means(vi: VIStack, located: DataFrame, index: str) -> DataFrame:
    """plot_id, i, j (both the flight), v: plot means by flight."""
    return located.groupBy("plot_id", "flight").agg(F.avg(index).alias("v")).select("plot_id", F.col("flight").alias("i"), F.col("flight").alias("j"), "v")


def window_means(vi: VIStack, located: DataFrame, index: str) -> DataFrame:
    """plot_id, i, j, v: per plot the mean over pixels of the integral from flight i to j.

    A pixel has an integral if it has a value on every flight of the window. One aggregate gathers a
    pixel's values by flight in one array; running sums of the trapezoids and of missing values turn
    every window into a difference. The windows come from sequences, not from the plan, and are made per
    plot and set of missing flights, not per pixel.
    """
    n, t = len(vi.flights), days(list(vi.flights))
    values = located.groupBy("plot_id", *vi.keys).agg(F.map_from_entries(F.collect_list(F.struct("flight", index))).alias("m"))
    values = values.select("plot_id", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.try_element_at("m", k)).alias("a"))
    halves = F.array(*[F.lit((b - x) / 2) for x, b in zip(t, t[1:])])
    segment = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.coalesce((F.element_at("a", k) + F.element_at("a", k + 1)) * F.element_at(halves, k), F.lit(0.0)))
    grow = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    sums = values.select("plot_id", F.aggregate(segment, F.array(F.lit(0.0)), grow).alias("c"), F.aggregate(F.transform("a", lambda v: v.isNull().cast("int")), F.array(F.lit(0)), grow).alias("n"))
    # Pixels of a plot with the same flights missing have the same windows: their running sums add up first.
    alike = sums.groupBy("plot_id", "n").agg(F.count("*").alias("k"), *[F.sum(F.element_at("c", j)).alias(f"c{j}") for j in range(1, n + 1)])
    alike = alike.select("plot_id", "n", "k", F.array(*[f"c{j}" for j in range(1, n + 1)]).alias("c"))
    area = lambda i, j: F.when(F.element_at("n", j + 1) == F.element_at("n", i), F.element_at("c", j) - F.element_at("c", i))
    to = lambda i: F.transform(F.sequence(i + 1, F.lit(n)), lambda j: F.struct(i.alias("i"), j.alias("j"), area(i, j).alias("v")))
    each = alike.select("plot_id", "k", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), to))).alias("w"))
    held = F.when(F.col("w.v").isNotNull(), F.col("k"))
    return each.groupBy("plot_id", "w.i", "w.j").agg(F.try_divide(F.sum("w.v"), F.sum(held)).alias("v")).select("plot_id", "i", "j", "v")


def ranked(df: DataFrame, col: str) -> F.Column:
    """Average rank of col among complete pairs of the same window."""
    w, same = Window.partitionBy("i", "j").orderBy(col), Window.partitionBy("i", "j", col)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def correlate(means: DataFrame, truth: DataFrame, trait: str, method: str = "pearson") -> DataFrame:
    """i, j, r, n_plots (joined rows), n (complete pairs) and tied (spearman: whether values repeat) of
    windows with at least three rows."""
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be pearson or spearman")
    met = means.join(truth.select("plot_id", F.col(trait).cast("double").alias("t")), "plot_id")
    rows = met.groupBy("i", "j").agg(F.count("*").alias("n_plots"))
    pairs = met.where("v is not null and t is not null")
    tied = F.lit(None).cast("boolean")
    if method == "spearman":
        pairs = pairs.select("i", "j", ranked(pairs, "v").alias("v"), ranked(pairs, "t").alias("t"))
        # Ranks 1 to n without ties have the largest sum of squares.
        whole = F.count("*") * (F.count("*") + 1) * (2 * F.count("*") + 1) / 6
        tied = (F.sum(F.col("v") * F.col("v")) < whole) | (F.sum(F.col("t") * F.col("t")) < whole)
    r = pairs.groupBy("i", "j").agg(pearson("v", "t").alias("r"), F.count("*").alias("n"), tied.alias("tied"))
    return rows.where("n_plots >= 3").join(r, ["i", "j"], "left")


def optimal_window(vi: VIStack, truth: DataFrame, trait: str, located: DataFrame, index: str | None = None, method: str = "pearson", n_top: int = 10) -> DataFrame:
    """The n_top flights and windows by |r|: type, date_from, date_to, r, r2, p_value, n_plots.

    located: vi's pixels with plot_id. Ties keep their order: single flights by date, then windows.
    p-values are Student's t, for ranks without ties those of Spearman's statistic.
    """
    if "plot_id" not in truth.columns or trait not in truth.columns:
        raise ValueError(f"ground truth needs plot_id and {trait}")
    name = vi.resolve(index)
    means = single_means(vi, located, name)
    if len(vi.flights) > 1:
        means = means.union(window_means(vi, located, name))
    dates = {f.number: f.date for f in vi.flights}
    r = correlate(means, truth, trait, method)
    kind = F.when(F.col("i") == F.col("j"), "single").otherwise("window")
    top = r.orderBy(F.desc_nulls_last(F.abs("r")), kind, "i", "j").limit(n_top)
    return top.select(kind.alias("type"), lookup("i", dates).alias("date_from"), lookup("j", dates).alias("date_to"), "r", (F.col("r") * F.col("r")).alias("r2"), correlation_p_udf("r", F.coalesce("n", F.lit(0)), ~F.coalesce("tied", F.lit(True))).alias("p_value"), "n_plots")

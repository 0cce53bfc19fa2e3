"""Nearest-date fusion of index statistics with ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse_ground(vi: DataFrame, truth: DataFrame, traits: Sequence[str] | None = None, max_lag_days: int = 7, allow_missing: bool = False) -> DataFrame:
    """vi (plot_id, flight_date, ...) with date_lag_days and traits of the plot's nearest truth.

    truth: plot_id, date, traits and, for ties, seq (its input order): of equally near rows the first
    counts. Rows beyond max_lag_days go. A plot without any truth goes too, or stays with NULL traits
    if allow_missing. Both tables meet in one pass over each plot's dates either way, so a plot with many
    truth rows costs no more than their number.
    """
    traits = [c for c in truth.columns if c not in ("plot_id", "date", "seq")] if traits is None else list(traits)
    if missing := [c for c in ("plot_id", "date", *traits) if c not in truth.columns]:
        raise ValueError(f"ground truth lacks {', '.join(missing)}")
    seq = F.col("seq").cast("long") if "seq" in truth.columns else F.monotonically_increasing_id()
    order = truth.where("plot_id is not null and date is not null").select("plot_id", "date", F.struct(seq.alias("seq"), F.col("date").alias("d"), F.struct(*traits).alias("t")).alias("g"))
    first = order.groupBy("plot_id", "date").agg(F.min_by("g", F.col("g.seq")).alias("g"))  # of a day, the first
    rows = vi.select("plot_id", F.col("flight_date").alias("date"), F.struct(*vi.columns).alias("v"))
    both = rows.unionByName(first, allowMissingColumns=True)
    # Both frames grow from their begin, so each is one pass; frames that shrink would be read anew for every row.
    up_to = lambda order: F.last("g", ignorenulls=True).over(Window.partitionBy("plot_id").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    before, after = up_to(F.asc("date")), up_to(F.desc("date"))
    met = both.select("v", "date", before.alias("a"), after.alias("z")).where("v is not null")
    lag = lambda c: F.abs(F.datediff(F.col(f"{c}.d"), F.col("date")))
    second = F.col("a").isNull() | (lag("z") < lag("a")) | ((lag("z") == lag("a")) & (F.col("z.seq") < F.col("a.seq")))
    near = met.select("v", F.when(second & F.col("z").isNotNull(), F.col("z")).otherwise(F.col("a")).alias("g"), "date")
    near = near.select("v.*", F.abs(F.datediff(F.col("g.d"), F.col("date"))).alias("date_lag_days"), *[F.col(f"g.t.{c}").alias(c) for c in traits])
    keep = F.col("date_lag_days") <= max_lag_days
    return near.where(keep | F.col("date_lag_days").isNull() if allow_missing else keep)

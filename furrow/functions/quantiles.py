"""Exact quantiles of large groups: linear interpolation between order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantile(df: DataFrame, by: list[str], col: str, q: float, alias: str = "q") -> DataFrame:
    """by and the quantile q of each group's non-NULL values.

    A mergeable sketch brackets the two order statistics; only values in the bracket are counted
    exactly. So no group's values meet in one task, as ``percentile`` would have it.
    """
    v = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("v"))
    wide, narrow = 0.05, 2 / ACCURACY
    at = [max(q - wide, 0.0), max(q - narrow, 0.0), min(q + narrow, 1.0), min(q + wide, 1.0)]
    sketch = v.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", at, ACCURACY).alias("b"))
    # In ranks the bracket must exceed the sketch's error and hold both neighbours; small groups count whole.
    by_size = lambda k, w, none: F.when(F.col("n") < 1000, F.lit(none)).when(F.col("n") < 50 * ACCURACY, F.col("b")[w]).otherwise(F.col("b")[k])
    sketch = sketch.select(*by, "n", by_size(1, 0, float("-inf")).alias("lo"), by_size(2, 3, float("inf")).alias("hi"))
    met = v.join(sketch, by) if by else v.join(F.broadcast(sketch))  # without groups the sketch is one row
    held = F.when(F.col("v") < F.col("lo"), F.lit(float("-inf"))).when(F.col("v") > F.col("hi"), F.lit(float("inf"))).otherwise(F.col("v"))
    counts = met.groupBy(*by, held.alias("v")).agg(F.count("*").alias("c"), F.first("n").alias("n"))
    w = Window.partitionBy(*by).orderBy("v")
    h = (F.col("n") - 1) * F.lit(q)
    upto = counts.withColumn("upto", F.sum("c").over(w)).withColumn("k", F.floor(h)).withColumn("part", h - F.floor(h))
    order = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    both = upto.groupBy(*by).agg(order(F.col("k")).alias("a"), order(F.least(F.col("k") + 1, F.col("n") - 1)).alias("z"), F.first("part").alias("part"))
    return both.select(*by, (F.col("a") + (F.col("z") - F.col("a")) * F.col("part")).alias(alias))

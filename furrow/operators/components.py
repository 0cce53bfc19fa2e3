"""Connected components, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: Share of all rows that makes a key hot; rows below which none is worth a path of its own.
HOT_SHARE, HOT_LEAST = 1 / 1000, 1_000_000


def meet(rows: DataFrame, few: DataFrame, on: list[str], n: int) -> DataFrame:
    """rows joined with few, which has one row a key and, as ``size``, at most as many rows as it meets.

    n: rows in all. Keys of more than HOT_SHARE of them, fewer than 1 / HOT_SHARE, are broadcast, so rows
    of a hot key stay where they are; the others move by key.
    """
    if n < HOT_LEAST:
        return rows.join(few.drop("size"), on)
    hot = F.col("size") > n * HOT_SHARE
    top = F.broadcast(few.where(hot).drop("size"))
    rest = rows.join(top.select(*on), on, "left_anti").join(few.where(~hot).drop("size"), on)
    return rows.join(top, on).unionByName(rest)


def connected_components(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, node, root (the least node reachable) for every node of the undirected edges u, v.

    Alternating large-star and small-star steps; each is written to the shared folder, so a lost
    executor costs one step. The driver only sees the number of links and a hash sum. A node of very many
    links doesn't gather them in one task.
    """
    by = by or []
    state, edges = None, materialize(edges.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    n, least = edges.count(), [F.min("v").alias("m"), F.count("*").alias("size")]
    flip = [F.col("v").alias("u"), F.col("m").alias("v")]
    while True:
        both = edges.union(edges.select(*by, "v", "u"))
        low = both.groupBy(*by, "u").agg(*least).select(*by, "u", F.least("u", "m").alias("m"), "size")
        large = meet(both, low, [*by, "u"], 2 * n).where("v > u").select(*by, *flip).distinct()
        low = large.groupBy(*by, "u").agg(*least)
        small = meet(large, low, [*by, "u"], 2 * n).where("v > m").select(*by, *flip).union(low.select(*by, "u", "m"))
        edges = materialize(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state, n = now, now[0]
    return edges.select(*by, F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(*by, "v", "v").distinct())


def label_cells(cells: DataFrame, keys: list[str], directions: int = 8) -> DataFrame:
    """keys, y, x, label: cells of one patch share the label of their first cell in row-major order.

    Runs along a row are one node from the start, so a patch enters with few nodes.
    """
    from pyspark.sql import Window

    at = cells.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    w = Window.partitionBy(*keys, "y").orderBy("x")
    begin = F.when(F.coalesce(F.col("x") - F.lag("x").over(w) > 1, F.lit(True)), F.col("x"))
    runs = at.withColumn("start", F.last(begin, ignorenulls=True).over(w)).withColumn("node", F.shiftleft("y", 32) + F.col("start"))
    below = runs.select(*keys, (F.col("y") + 1).alias("y"), F.explode(F.array(*[F.col("x") + d for d in ((-1, 0, 1) if directions == 8 else (0,))])).alias("x"), F.col("node").alias("u"))
    links = below.join(runs.select(*keys, "y", "x", F.col("node").alias("v")), [*keys, "y", "x"]).select(*keys, "u", "v").distinct()
    roots = connected_components(links, keys)
    return runs.join(roots, [*keys, "node"], "left").select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce("root", "node").alias("label"))

"""Outlines of patches of cells: closed rings around them, parts and holes included."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import Grid

#: Directions of a side that runs along a cell with the cell on its right: east, south, west, north.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))
POINT = "struct<x:double,y:double>"


def sides(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, x, y, turn: the sides of patches, from a corner in a direction (of STEPS).

    A side between two cells of a patch comes from both and goes; one aggregate tells.
    """
    keys = list(keys)
    own = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("turn"), F.lit(k % 2).alias("upright")) for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    each = labels.select(*keys, "label", "y", "x", F.explode(own).alias("s"))
    corner = [(F.col("x") + F.col("s.a")).alias("x0"), (F.col("y") + F.col("s.b")).alias("y0")]
    each = each.select(*keys, "label", F.col("s.turn").alias("turn"), F.col("s.upright").alias("upright"), *corner)
    # A side is known by its west or north end.
    ends = [F.when(F.col("turn") == 2, F.col("x0") - 1).otherwise(F.col("x0")).alias("ex"), F.when(F.col("turn") == 3, F.col("y0") - 1).otherwise(F.col("y0")).alias("ey")]
    named = each.select(*keys, "label", "upright", *ends, "turn", "x0", "y0")
    once = named.groupBy(*keys, "label", "upright", "ex", "ey").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("x0", "y0", "turn")])
    return once.where("n = 1").select(*keys, "label", F.col("x0").alias("x"), F.col("y0").alias("y"), "turn")


def rings_of(rows: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of corners from (x, y, turn) sides, the largest first; where a patch touches itself at a
    corner the way turns right, so its parts are rings of their own."""
    after: dict[tuple[int, int], list[int]] = {}
    for x, y, turn in sorted(rows):
        after.setdefault((x, y), []).append(turn)
    out = []
    for start in sorted(after):
        while after[start]:
            at, turn, ring, last = start, after[start].pop(0), [], None
            while True:
                if turn != last:
                    ring.append(at)
                at, last = (at[0] + STEPS[turn][0], at[1] + STEPS[turn][1]), turn
                if at == start:
                    break
                ways = after[at]
                turn = next(t for t in ((last + 1) % 4, last, (last + 3) % 4) if t in ways)
                ways.remove(turn)
            out.append([*ring, ring[0]])
    return sorted(out, key=lambda r: (-abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))), r))


def outlines(labels: DataFrame, grid: Grid, keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, ring and parts (its other rings: holes, and parts that touch at a corner) of each patch.

    A patch's sides meet in one task: as many as its circumference is long.
    """
    keys = list(keys)
    found = sides(labels, keys)
    names = [*keys, "label"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*names).schema)
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def run(t: pa.Table) -> pa.Table:
        rings = rings_of(list(zip(*(t.column(c).to_pylist() for c in ("x", "y", "turn")), strict=True)))
        placed = [[{"x": grid.xmin + x * grid.res, "y": grid.ymax - y * grid.res} for x, y in r] for r in rings]
        cols = [t.column(c).slice(0, 1).combine_chunks() for c in names]
        return pa.Table.from_arrays([*cols, pa.array([placed[0]], pa.list_(point)), pa.array([placed[1:]], pa.list_(pa.list_(point)))], names=[*names, "ring", "parts"])

    return found.groupBy(*names).applyInArrow(run, f"{schema}, ring array<{POINT}>, parts array<array<{POINT}>>")

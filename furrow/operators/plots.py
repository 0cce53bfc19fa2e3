"""Plot grids: closed-form rings and ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORNERS = ("nw", "ne", "sw", "se")
ORDERS = ("row_major", "col_major", "snake")
POINT = "struct<x:double,y:double>"


@dataclass(frozen=True)
class PlotGrid:
    """n_row x n_col plots of length (north-south) by width (east-west) metres around an anchor.

    compat: ``reference`` numbers ``snake`` like ``row_major``; ``intent`` turns every other row.
    A positive angle turns clockwise.
    """

    n_row: int
    n_col: int
    length: float
    width: float
    anchor_x: float
    anchor_y: float
    alley_row: float = 0.0
    alley_col: float = 0.0
    orientation_deg: float = 0.0
    prefix: str = "P"
    order: str = "row_major"
    corner: str = "nw"
    compat: str = "intent"

    def __post_init__(self) -> None:
        if self.n_row < 1 or self.n_col < 1:
            raise ValueError("n_row and n_col must be at least 1")
        if self.length <= 0 or self.width <= 0:
            raise ValueError("plot length and width must be positive")
        if self.alley_row < 0 or self.alley_col < 0:
            raise ValueError("alleys must not be negative")
        if self.corner not in CORNERS or self.order not in ORDERS:
            raise ValueError(f"corner is one of {CORNERS}, order one of {ORDERS}")

    def number(self) -> Column:
        """A plot's number from 1, from its row and col from 1."""
        r, c = F.col("row") - 1, F.col("col") - 1
        if self.order == "col_major":
            return c * self.n_row + r + 1
        if self.order == "snake" and self.compat == "intent":
            c = F.when(r % 2 == 1, self.n_col - 1 - c).otherwise(c)
        return r * self.n_col + c + 1

    def turned(self, x: Column, y: Column) -> tuple[Column, Column]:
        """A point of the unturned grid (its north-west corner at 0, 0) on the ground."""
        a = F.radians(F.lit(float(self.orientation_deg)))
        dx, dy = self.offset()
        return x * F.cos(a) + y * F.sin(a) + self.anchor_x + dx, -x * F.sin(a) + y * F.cos(a) + self.anchor_y + dy

    def offset(self) -> tuple[float, float]:
        """From the anchor to the north-west corner, along unturned axes."""
        wide = self.n_col * self.width + (self.n_col - 1) * self.alley_col
        high = self.n_row * self.length + (self.n_row - 1) * self.alley_row
        return (-wide if self.corner[1] == "e" else 0.0), (high if self.corner[0] == "s" else 0.0)

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, col) from 1 of the plot that holds a ground point, NULL in an alley or outside: an
        inverse turn and two divisions, so pixels meet their plots without a spatial join."""
        a = F.radians(F.lit(float(self.orientation_deg)))
        dx, dy = self.offset()
        u, v = x - (self.anchor_x + dx), y - (self.anchor_y + dy)
        east, south = u * F.cos(a) - v * F.sin(a), -(u * F.sin(a) + v * F.cos(a))
        step_x, step_y = self.width + self.alley_col, self.length + self.alley_row
        col, row = F.floor(east / step_x), F.floor(south / step_y)
        inside = (col >= 0) & (col < self.n_col) & (row >= 0) & (row < self.n_row) & (east - col * step_x < self.width) & (south - row * step_y < self.length)
        return F.when(inside, (row + 1).cast("int")), F.when(inside, (col + 1).cast("int"))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed or open ring of points, from its first one: coordinates are large."""
    nxt = lambda i: F.element_at(ring, (i + 1) % F.size(ring) + 1)
    x0, y0 = F.element_at(ring, 1)["x"], F.element_at(ring, 1)["y"]
    parts = F.transform(ring, lambda p, i: (p["x"] - x0) * (nxt(i)["y"] - y0) - (nxt(i)["x"] - x0) * (p["y"] - y0))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)) / 2


def generate_plot_grid(spark: SparkSession, g: PlotGrid) -> DataFrame:
    """plot_id, row, col, area_m2, quality, ring (NW, NE, SE, SW, NW) of every plot."""
    ids = spark.range(g.n_row * g.n_col).select((F.floor(F.col("id") / g.n_col) + 1).cast("int").alias("row"), (F.col("id") % g.n_col + 1).cast("int").alias("col"))
    west, north = (F.col("col") - 1) * (g.width + g.alley_col), -(F.col("row") - 1) * (g.length + g.alley_row)
    corners = [(west, north), (west + g.width, north), (west + g.width, north - g.length), (west, north - g.length), (west, north)]
    points = [F.struct(*[c.cast("double").alias(n) for c, n in zip(g.turned(x, y), "xy", strict=True)]) for x, y in corners]
    plot_id = F.concat(F.lit(g.prefix), F.format_string("%03d", g.number().cast("int")))
    return ids.select(plot_id.alias("plot_id"), "row", "col", F.array(*points).alias("ring")).select("plot_id", "row", "col", ring_area(F.col("ring")).alias("area_m2"), F.lit(1.0).alias("quality"), "ring")


def pick_anchor() -> tuple[float, float]:
    """An anchor can't be clicked here."""
    raise ValueError("give the anchor's coordinates; there is no interactive map")

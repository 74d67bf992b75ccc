"""Stencils: joins of a sparse layer with its neighbourhood through a small table of lattice offsets.

The offsets are a literal array that is exploded on the sparser side, so a stencil is one hash shuffle by cell with
map-side combine, and no window or cross join over the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastra.grid import GridSpec

ALPHA, BETA, RADIUS = 0.2, 0.8, 3.0


def kernel(d: float, radius: float = RADIUS) -> float:
    return max(1.0 - d / radius, 0.0)


def lattice(radius: float, inside) -> list[tuple[int, int]]:
    r = math.ceil(radius)
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if inside(a, b)]


def kernel_offsets(radius: float = RADIUS) -> list[tuple[int, int, float]]:
    """Offsets of positive triangular weight (d < radius) and their weights."""
    return [(a, b, kernel(math.hypot(a, b), radius)) for a, b in lattice(radius, lambda a, b: math.hypot(a, b) < radius)]


def disk_offsets(radius: float) -> list[tuple[int, int]]:
    """Offsets within a closed disk."""
    return lattice(radius, lambda a, b: a * a + b * b <= radius * radius)


def diamond_offsets(steps: int) -> list[tuple[int, int]]:
    """What `steps` dilations by the cross-shaped structure reach."""
    return lattice(steps, lambda a, b: abs(a) + abs(b) <= steps)


def square_offsets(steps: int) -> list[tuple[int, int]]:
    return lattice(steps, lambda a, b: True)


def _offset_array(offsets: list[tuple]) -> Column:
    names = ("dr", "dc", "k")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, o)]) for o in offsets])


def spread(cells: DataFrame, offsets: list[tuple], grid: GridSpec | None = None) -> DataFrame:
    """cells with src_row, src_col, and a row for each offset at (row, col); with a weight k if the offsets have one."""
    o = F.explode(_offset_array(offsets)).alias("o")
    rest = [c for c in cells.columns if c not in ("row", "col")]
    out = cells.select(*rest, F.col("row").alias("src_row"), F.col("col").alias("src_col"), o)
    more = [F.col("o.k").alias("k")] if len(offsets[0]) == 3 else []
    out = out.select(*rest, "src_row", "src_col", (F.col("src_row") + F.col("o.dr")).alias("row"), (F.col("src_col") + F.col("o.dc")).alias("col"), *more)
    if grid:
        out = out.where((F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width))
    return out


def dilate(mask: DataFrame, offsets: list[tuple], grid: GridSpec) -> DataFrame:
    return spread(mask.select("row", "col"), offsets, grid).select("row", "col").distinct()


def erode(mask: DataFrame, offsets: list[tuple], grid: GridSpec) -> DataFrame:
    """Cells whose whole neighbourhood is in the mask; what lies outside the grid is not."""
    hits = spread(mask.select("row", "col"), offsets, grid).groupBy("row", "col").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(offsets)).select("row", "col")


def neighbour_count(mask: DataFrame, offsets: list[tuple]) -> DataFrame:
    """row, col, n for every cell of the mask: mask cells among its offsets."""
    mask = mask.select("row", "col")
    hits = spread(mask, offsets).groupBy("row", "col").agg(F.count("*").alias("n"))
    return mask.join(hits, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("n"))


def junctions(mask: DataFrame) -> DataFrame:
    """Cells with at least three of eight neighbours."""
    return neighbour_count(mask, [o for o in square_offsets(1) if o != (0, 0)]).where("n >= 3")


def tips(mask: DataFrame) -> DataFrame:
    """Cells with at most one of eight neighbours."""
    return neighbour_count(mask, [o for o in square_offsets(1) if o != (0, 0)]).where("n <= 1")


def disc_density(mask: DataFrame, grid: GridSpec, radius: float = 5.0) -> DataFrame:
    """row, col, n: mask cells within a closed disk, for every cell that has any."""
    return spread(mask.select("row", "col"), disk_offsets(radius), grid).groupBy("row", "col").agg(F.count("*").alias("n"))


def kernel_sum(cells: DataFrame, grid: GridSpec, radius: float = RADIUS) -> DataFrame:
    """row, col, value: the sum of value * kernel over the neighbourhood (expected credit)."""
    out = spread(cells.select("row", "col", "value"), kernel_offsets(radius), grid)
    return out.groupBy("row", "col").agg(F.sum(F.col("value") * F.col("k")).alias("value"))


def within(cells: DataFrame, mask: DataFrame, radius: float) -> DataFrame:
    """The cells that have a mask cell within a closed radius."""
    return cells.join(spread(mask.select("row", "col"), disk_offsets(radius)).select("row", "col").distinct(), ["row", "col"], "left_semi")

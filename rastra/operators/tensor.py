"""Gradients, Gaussian smoothing and structure tensors on dense or sparse layers, as separable weighted stencils."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators.blocks import Window, by_blocks, smoothed
from rastra.operators.stencil import spread


def gradient(dense: DataFrame, value: str = "value") -> DataFrame:
    """dense (every cell of a grid) with g_row and g_col: central differences, one-sided at the edges."""
    out = dense
    for axis, other in (("row", "col"), ("col", "row")):
        w = Over.partitionBy(other).orderBy(axis)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        out = out.withColumn(f"g_{axis}", F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2))
    return out


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(cells: DataFrame, grid: GridSpec, sigma: float, values: list[str], truncate: float = 4.0) -> DataFrame:
    """row, col and the smoothed values of a sparse layer, zero outside it: one pass along rows, one along columns."""
    w = gaussian_weights(sigma, truncate)
    r = len(w) // 2
    out = cells.select("row", "col", *values)
    for axis in (0, 1):
        offsets = [((i - r, 0, k) if axis == 0 else (0, i - r, k)) for i, k in enumerate(w)]
        out = spread(out, offsets, grid).groupBy("row", "col").agg(*[F.sum(F.col(v) * F.col("k")).alias(v) for v in values])
    return out


def structure_tensor(dense: DataFrame, grid: GridSpec, sigma: float, value: str = "value") -> DataFrame:
    """row, col, coherence, strike_deg: from smoothed products of gradients; null strike where there is no structure."""
    g = gradient(dense, value).select("row", "col", (F.col("g_row") ** 2).alias("rr"), (F.col("g_col") ** 2).alias("cc"), (F.col("g_row") * F.col("g_col")).alias("rc"))
    s = gaussian(g, grid, sigma, ["rr", "cc", "rc"])
    size = F.col("rr") + F.col("cc")
    spin = F.sqrt((F.col("rr") - F.col("cc")) ** 2 + 4 * F.col("rc") ** 2)
    # the gradient's axis as an azimuth; the strike is at a right angle to it
    across = F.degrees(F.lit(0.5) * F.atan2(-2 * F.col("rc"), F.col("rr") - F.col("cc")))
    some = size > 1e-12
    return s.select("row", "col", F.when(some, spin / size).otherwise(0.0).alias("coherence"), F.when(some, F.pmod(across + 90, F.lit(180.0))).alias("strike_deg"))


def box_contrast(dense: DataFrame, half: int, value: str = "value") -> DataFrame:
    """dense with contrast: (value - box mean) / box deviation over (2 half + 1)^2 cells, cut off at the grid's edge."""
    out = dense.select("row", "col", value, F.col(value).alias("s"), (F.col(value) ** 2).alias("q"), F.lit(1).alias("n"))
    for axis, other in (("row", "col"), ("col", "row")):
        w = Over.partitionBy(other).orderBy(axis).rangeBetween(-half, half)
        out = out.withColumns({c: F.sum(c).over(w) for c in ("s", "q", "n")})
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return out.select("row", "col", value, F.when(sd > 1e-9, (F.col(value) - mean) / sd).otherwise(0.0).alias("contrast"))


def reflected(cells: DataFrame, axis: str, size: int, reach: int) -> DataFrame:
    """cells and their mirror images beyond both edges of an axis, as far as reach: the edge cell is mirrored too."""
    at = F.col(axis)
    images = F.filter(F.array(at, -1 - at, 2 * size - 1 - at), lambda v: (v >= -reach) & (v < size + reach))
    return cells.withColumn(axis, F.explode(images))


def gaussian_reflected(cells: DataFrame, grid: GridSpec, sigma: float, values: list[str], truncate: float = 4.0) -> DataFrame:
    """gaussian() with the layer mirrored at the grid's edges instead of zero beyond them."""
    w = gaussian_weights(sigma, truncate)
    r = len(w) // 2
    out = cells.select("row", "col", *values)
    for axis, size in (("row", grid.height), ("col", grid.width)):
        offsets = [((i - r, 0, k) if axis == "row" else (0, i - r, k)) for i, k in enumerate(w)]
        out = spread(reflected(out, axis, size, r), offsets, grid).groupBy("row", "col").agg(*[F.sum(F.col(v) * F.col("k")).alias(v) for v in values])
    return out


def sparse_gradient(cells: DataFrame, grid: GridSpec, value: str = "value") -> DataFrame:
    """row, col, g_row, g_col of a sparse layer that is zero elsewhere: every cell sends its share to its neighbours, so no grid
    is made and no column or row is a window."""
    parts = []
    for axis, size in (("row", grid.height), ("col", grid.width)):
        at, v = F.col(axis), F.col(value)
        sent = F.array(
            F.struct((at - 1).alias("to"), (v * F.when(at - 1 == 0, 1.0).otherwise(0.5)).alias("g")),
            F.struct((at + 1).alias("to"), (v * F.when(at + 1 == size - 1, -1.0).otherwise(-0.5)).alias("g")),
            F.struct(at.alias("to"), (v * F.when(at == 0, -1.0).when(at == size - 1, 1.0).otherwise(0.0)).alias("g")),
        )
        out = cells.select("row", "col", F.explode(sent).alias("s")).where((F.col("s.to") >= 0) & (F.col("s.to") < size))
        zero = F.lit(0.0)
        parts.append(out.withColumn(axis, F.col("s.to")).select("row", "col", (F.col("s.g") if axis == "row" else zero).alias("g_row"), (F.col("s.g") if axis == "col" else zero).alias("g_col")))
    return parts[0].unionByName(parts[1]).groupBy("row", "col").agg(F.sum("g_row").alias("g_row"), F.sum("g_col").alias("g_col"))


def strikes(mask: DataFrame, grid: GridSpec, sigmas: list[float]) -> DataFrame:
    """row, col, then strike_0, coherence_0, ... for each sigma, of every mask cell: the structure tensor of the smoothed mask, smoothed
    by sigma, mirrored at the grid's edges.

    Differences below 1e-12 count as none, so that rounding gives no direction: a cell without one (of coherence 0) has strike 0."""
    first, reach = gaussian_weights(1.0), max(len(gaussian_weights(s)) // 2 for s in sigmas)

    def run(w: Window) -> pd.DataFrame:
        if not (w.there & w.inner).any():
            return w.cells(w.there)
        y, x = np.gradient(smoothed(w.there.astype(float), first, True))
        out = {}
        for i, sigma in enumerate(sigmas):
            rr, cc, rc = (smoothed(a, gaussian_weights(sigma), True) for a in (y * y, x * x, y * x))
            diff, cross = np.round(cc - rr, 12) + 0.0, np.round(2 * rc, 12) + 0.0  # -0.0 would turn the axis
            across = 0.5 * np.arctan2(cross, diff) + np.pi / 2
            out[f"strike_{i}"] = np.degrees(np.arctan2(np.round(np.cos(across), 12), -np.sin(across))) % 180.0
            out[f"coherence_{i}"] = np.sqrt(diff * diff + cross * cross) / np.maximum(rr + cc, 1e-12)
        return w.cells(w.there, **out)

    names = ", ".join(f"strike_{i} double, coherence_{i} double" for i in range(len(sigmas)))
    return by_blocks(mask.select("row", "col"), [], grid, len(first) // 2 + 1 + reach, run, names)


def local_strike(mask: DataFrame, grid: GridSpec, sigma: float = 3.0) -> DataFrame:
    """row, col, strike_deg, coherence of every mask cell (see strikes)."""
    return strikes(mask, grid, [sigma]).toDF("row", "col", "strike_deg", "coherence")


def laplacian(dense: DataFrame, value: str = "value") -> DataFrame:
    """dense with laplacian (mirrored at the edges) and slope (the gradient's size)."""
    out = gradient(dense, value)
    terms = F.lit(0.0)
    for axis, other in (("row", "col"), ("col", "row")):
        w = Over.partitionBy(other).orderBy(axis)
        out = out.withColumn(f"_{axis}", F.coalesce(F.lag(value).over(w), value) + F.coalesce(F.lead(value).over(w), value) - 2 * F.col(value))
        terms = terms + F.col(f"_{axis}")
    return out.withColumns({"laplacian": terms, "slope": F.hypot("g_row", "g_col")}).drop("_row", "_col", "g_row", "g_col")

"""Orientation fields: the tangent of a scalar field with holes, turning between two scales, and mixing of two senses."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators import components, features, frames, tensor
from rastra.operators.blocks import Window, by_blocks, smoothed
from rastra.storage import stage_table

#: The columns that relays, bends and senses add to the geometry, in order.
RELAY_BEND = ["turn", "bend_asym", "edge_relative", "d_second", "relay_ratio", "relay_facing", "host_cos2", "log_len_second", "sense_mix"]
#: The columns of a scalar field relative to the nearest trace.
EDGE = ["edge_relative_cos2", "edge_log_gradient", "edge_coherence"]


def _clipped(column, low: float = -1.0, high: float = 1.0):
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def edge_tangent(cells: DataFrame, grid: GridSpec, margin: int = 4) -> DataFrame:
    """row, col, cos2, sin2 (of the edge's doubled strike), log_gradient, coherence of a scalar field with holes.

    cells: row, col, value, a row for each valid cell (null and non-finite values are holes). The field is smoothed by the ratio of
    two truncated convolutions, of the values and of the mask, so a hole neither pulls nor counts. Only cells whose neighbourhood
    of `margin` cells each way is valid, and where the gradient is not flat, have a row.
    """
    valid = cells.where(F.col("value").isNotNull() & (F.abs("value") < float("inf"))).select("row", "col", F.col("value").cast("double").alias("value"))
    one, two = tensor.gaussian_weights(1.0, 3.0), tensor.gaussian_weights(2.0, 3.0)

    def run(w: Window) -> pd.DataFrame:
        mass, total = smoothed(w.there.astype(float), one, False), smoothed(w.arrays["value"], one, False)
        y, x = np.gradient(np.divide(total, mass, out=np.zeros_like(total), where=mass > 1e-8))
        norm2 = x * x + y * y
        xx, yy, xy = (smoothed(a, two, True) for a in (x * x, y * y, x * y))
        outside = np.pad(~w.there, margin, constant_values=True)  # beyond the grid nothing is valid; cut edges lie in the margin
        near = np.lib.stride_tricks.sliding_window_view(outside, (2 * margin + 1, 2 * margin + 1)).any((2, 3))
        good = ~near & (norm2 > 1e-12)
        safe = np.where(good, norm2, 1.0)
        coherence = np.clip(np.sqrt((xx - yy) ** 2 + 4 * xy * xy) / np.maximum(xx + yy, 1e-12), 0, 1)
        return w.cells(good, cos2=(x * x - y * y) / safe, sin2=2 * x * y / safe, log_gradient=np.log1p(np.sqrt(norm2)), coherence=coherence)

    halo = max(margin, len(one) // 2 + 1 + len(two) // 2)
    return by_blocks(valid, ["value"], grid, halo, run, "cos2 double, sin2 double, log_gradient double, coherence double")


def bend_turn(mask: DataFrame, grid: GridSpec, fine: float = 3.0, coarse: float = 9.0) -> DataFrame:
    """row, col, strike_deg, coherence (at the fine scale), turn and sin2_turn of every mask cell: the distance and the cross product
    of the directors coherence * (cos, sin)(2 strike) at two scales. Turns on a bend's limbs and lost coherence at its hinge both
    count."""
    part = lambda i, f: _clipped(F.col(f"coherence_{i}"), 0.0) * f(F.radians(2 * F.col(f"strike_{i}")))
    x1, y1, x2, y2 = part(0, F.cos), part(0, F.sin), part(1, F.cos), part(1, F.sin)
    out = tensor.strikes(mask, grid, [fine, coarse])
    return out.select("row", "col", F.col("strike_0").alias("strike_deg"), F.col("coherence_0").alias("coherence"), F.hypot(x1 - x2, y1 - y2).alias("turn"), (y1 * x2 - x1 * y2).alias("sin2_turn"))


def sense_mixing(coded: DataFrame, grid: GridSpec, sigma: float = 15.0) -> DataFrame:
    """row, col, mix in [0, 1]: where traces of strike slip (codes 2 and 3) and of normal slip (code 1) lie together. 4ab/(a + b)^2 of
    their smoothed densities a and b, times a + b over its 90th percentile, clipped. Without both kinds there are no rows."""
    senses = coded.where("code in (1, 2, 3)").groupBy("row", "col").agg(F.max((F.col("code") > 1).cast("double")).alias("a"), F.max((F.col("code") == 1).cast("double")).alias("b"))
    kinds = senses.agg(F.max("a").alias("_a"), F.max("b").alias("_b")).where("_a > 0 and _b > 0")
    weights = tensor.gaussian_weights(sigma, 3.0)

    def run(w: Window) -> pd.DataFrame:
        a, b = (smoothed(w.arrays[c], weights, False) for c in "ab")
        return w.cells(a + b > 0, a=a, b=b)

    density = stage_table(by_blocks(senses, ["a", "b"], grid, len(weights) // 2, run, "a double, b double"), "density")
    total = F.col("a") + F.col("b")
    scale = density.where(total > 1e-7).agg(F.greatest(F.percentile(total, 0.9), F.lit(1e-7)).alias("_p90"))
    mix = F.when(total * total > 1e-12, 4 * F.col("a") * F.col("b") / (total * total)).otherwise(0.0)
    # one row each
    return density.join(F.broadcast(scale)).join(F.broadcast(kinds)).select("row", "col", _clipped(mix * _clipped(total / F.col("_p90"), 0.0), 0.0).alias("mix"))


def relay_bend(cells: DataFrame, mask: DataFrame, coded: DataFrame, scalar: DataFrame, grid: GridSpec) -> DataFrame:
    """row, col, the geometry and sense columns of features.geometry, and RELAY_BEND: turning at the nearest mask cell, also times
    the side; the scalar field's edge relative to that cell's strike, times the edge's coherence; the second component's distance,
    the share of the first in both, how far the two face each other, the angle between their strikes, the second's size; and
    the mixing of senses at the cell. coded: row, col, code of mask cells; scalar: as in edge_tangent, 0 where it has no edge.

    With a single component there is no second one: its five columns are null.
    """
    base = features.geometry(cells, mask, grid, coded)
    labelled = stage_table(components.label8(mask, grid), "labelled")
    turn = stage_table(bend_turn(mask, grid), "turn")
    sizes = labelled.groupBy(F.col("comp_id").alias("comp_2")).agg(F.count("*").alias("_n2"))
    near = frames.component_frame(labelled, grid).join(cells.select("row", "col"), ["row", "col"])
    host = lambda i: turn.select(*[F.col(c).cast("long").alias(f"near_{c}_{i}") for c in ("row", "col")], F.col("strike_deg").alias(f"_s{i}"), *([F.col("turn"), F.col("sin2_turn")] if i == 1 else []))
    near = near.join(host(1), ["near_row_1", "near_col_1"]).join(host(2), ["near_row_2", "near_col_2"], "left").join(sizes, "comp_2", "left")
    d1, d2 = F.sqrt(F.col("d2_1").cast("double")), F.sqrt(F.col("d2_2").cast("double"))
    dot = sum((F.col(c) - F.col(f"near_{c}_1")) * (F.col(c) - F.col(f"near_{c}_2")) for c in ("row", "col"))
    near = near.select(
        "row", "col", "turn", "sin2_turn", d2.alias("d_second"), _clipped(d1 / F.greatest(d1 + d2, F.lit(1e-6)), 0.0, 0.5).alias("relay_ratio"),
        _clipped(-dot / F.greatest(d1 * d2, F.lit(1e-6))).alias("relay_facing"), _clipped(F.cos(F.radians(2 * (F.col("_s1") - F.col("_s2"))))).alias("host_cos2"), F.log1p("_n2").alias("log_len_second"),
    )
    near = near.withColumns({c: F.when(F.col("d_second").isNotNull(), F.col(c)) for c in ("relay_ratio", "relay_facing", "host_cos2")})
    edge = edge_tangent(scalar, grid).select("row", "col", F.col("cos2").alias("_e_cos"), F.col("sin2").alias("_e_sin"), F.col("coherence").alias("_e_coh"))
    out = base.join(near, ["row", "col"]).join(edge, ["row", "col"], "left").join(sense_mixing(coded, grid), ["row", "col"], "left").fillna(0.0, ["_e_cos", "_e_sin", "_e_coh", "mix"])
    relative = (F.col("_e_cos") * F.col("cos2") + F.col("_e_sin") * F.col("sin2")) * F.col("_e_coh")
    more = {"bend_asym": _clipped(F.col("side") * F.col("sin2_turn")), "edge_relative": _clipped(relative), "sense_mix": F.col("mix")}
    return out.withColumns(more).select("row", "col", *features.GEOMETRY, *features.SENSE, *RELAY_BEND)


def edge_features(cells: DataFrame, geometry: DataFrame, scalar: DataFrame, grid: GridSpec) -> DataFrame:
    """geometry with EDGE: the cosine of the doubled angle between the field's edge at the cell and the strike of the nearest trace,
    and the edge's gradient and coherence; 0 where the field has no edge."""
    edge = edge_tangent(scalar, grid).select("row", "col", F.col("cos2").alias("_c"), F.col("sin2").alias("_s"), F.col("log_gradient").alias(EDGE[1]), F.col("coherence").alias(EDGE[2]))
    out = geometry.join(cells.select("row", "col"), ["row", "col"], "left_semi").join(edge, ["row", "col"], "left").fillna(0.0, ["_c", "_s", *EDGE[1:]])
    return out.withColumn(EDGE[0], _clipped(F.col("_c") * F.col("cos2") + F.col("_s") * F.col("sin2"))).select(*geometry.columns, *EDGE)


def interaction(mask: DataFrame, grid: GridSpec, radius: float = 15.0, tip: float = 2.0, scale: float = 0.5) -> DataFrame:
    """row, col, value of the cells outside the mask: what its traces add up to. Each mask cell counts its component's size ** scale,
    falling linearly to 0 at radius; near a tip (at most one of eight neighbours) tip / sqrt(distance) is added, up to half the
    radius and 8 cells; and around bends (coherence below 1/2) the mean of 2 (1 - coherence) over 5 x 5 cells. Cells of value 0 are
    left out."""
    labelled = components.label8(mask, grid)
    sizes = labelled.groupBy("comp_id").agg(F.pow(F.count("*").cast("double"), F.lit(scale)).alias("weight"))
    bend = F.when(F.col("coherence") < 0.5, 2 * (1 - F.col("coherence"))).otherwise(0.0)
    cells = labelled.join(sizes, "comp_id").join(tensor.local_strike(mask, grid), ["row", "col"]).select("row", "col", "weight", bend.alias("bend"))
    reach, near = math.ceil(radius), min(8.0, radius / 2)
    far = [(a, b, max(1.0 - math.hypot(a, b) / radius, 0.0)) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]

    def run(w: Window) -> pd.DataFrame:
        total = _summed(w.arrays["weight"], [o for o in far if o[2] > 0]) + _summed(w.arrays["bend"], [(a, b, 1 / 25) for a in range(-2, 3) for b in range(-2, 3)])
        tips = w.there & (_summed(w.there.astype(float), [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]) <= 1)
        d = np.full(tips.shape, np.inf)
        for a in range(-int(near), int(near) + 1):
            for b in range(-int(near), int(near) + 1):
                if math.hypot(a, b) <= near:
                    np.minimum(d, np.where(_moved(tips, a, b), math.hypot(a, b), np.inf), out=d)
        total += np.where((d > 0) & (d <= near), tip / np.sqrt(np.maximum(d, 0.5)), 0.0)
        return w.cells(~w.there & (total > 0), value=total)

    return by_blocks(cells, ["weight", "bend"], grid, reach + 1, run, "value double")


def _moved(a: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """a moved by (dr, dc); what comes in is 0."""
    h, w = a.shape
    out = np.zeros_like(a)
    if abs(dr) < h and abs(dc) < w:
        out[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)] = a[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)]
    return out


def _summed(a: np.ndarray, offsets: list[tuple[int, int, float]]) -> np.ndarray:
    return sum(k * _moved(a, dr, dc) for dr, dc, k in offsets)


def system_intensity(systems: DataFrame, grid: GridSpec, classes: list[tuple[float, float]]) -> DataFrame:
    """row, col, value: the sum over cells of sqrt(their system's length) smoothed by a Gaussian whose width goes with the length.

    systems: row, col, length. classes: (greatest length, sigma), ascending; a length above all is not counted. Mirrored at the
    grid's edges."""
    bounds = [0.0, *[upper for upper, _ in classes]]
    weights = [F.when((F.col("length") > a) & (F.col("length") <= b), F.sqrt(F.col("length").cast("double"))).otherwise(0.0).alias(f"w{i}") for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    cells = systems.select("row", "col", *weights)
    kernels = [tensor.gaussian_weights(sigma) for _, sigma in classes]

    def run(w: Window) -> pd.DataFrame:
        total = sum(smoothed(w.arrays[f"w{i}"], k, True) for i, k in enumerate(kernels))
        return w.cells(total > 0, value=total)

    return by_blocks(cells, [f"w{i}" for i in range(len(classes))], grid, max(len(k) // 2 for k in kernels), run, "value double")


def axial_orientation(cells: DataFrame, grid: GridSpec, sigma: float = 9.0) -> DataFrame:
    """row, col, angle_deg of the layer's cells: the axis of the gradient of the smoothed layer (0 where there is none), from products
    smoothed once more. The layer is 0 where it has no cell, and mirrored at the grid's edges."""
    kernel = tensor.gaussian_weights(sigma)

    def run(w: Window) -> pd.DataFrame:
        y, x = np.gradient(smoothed(w.arrays["value"], kernel, True))
        xx, yy, xy = (smoothed(a, kernel, True) for a in (x * x, y * y, x * y))
        return w.cells(w.there, angle_deg=0.5 * np.degrees(np.arctan2(np.round(2 * xy, 12), np.round(xx - yy, 12))))

    return by_blocks(cells.select("row", "col", "value"), ["value"], grid, 2 * (len(kernel) // 2) + 1, run, "angle_deg double")

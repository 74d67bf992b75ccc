"""Nearest-cell joins: the exact Euclidean distance transform in two separable passes, and bounded nearest joins.

Pass 1 runs down each column with window functions (nearest mask row above and below). Pass 2 needs, for each cell, the
least of dc^2 + g(col)^2 over its row: a grouped map per row, whose size is the grid's width whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastra.grid import GridSpec, cells_in
from rastra.operators.stencil import disk_offsets, spread


def distance_transform(mask: DataFrame, grid: GridSpec) -> DataFrame:
    """row, col, d2 (squared distance), near_row, near_col of every grid cell; ties to the least (near_row, near_col).

    An empty mask gives nulls.
    """
    dense = cells_in(grid, mask.sparkSession).join(mask.select("row", "col").distinct().withColumn("at", F.col("row")), ["row", "col"], "left")
    down = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("col").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    dense = dense.select("row", "col", F.last("at", True).over(down).alias("above"), F.first("at", True).over(up).alias("below"))
    nearer_below = F.col("above").isNull() | ((F.col("below") - F.col("row")) < (F.col("row") - F.col("above")))
    column = dense.select("row", "col", F.when(nearer_below, F.col("below")).otherwise(F.col("above")).alias("near"))

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        col, near, row = pdf["col"].to_numpy(), pdf["near"].to_numpy(float), int(pdf["row"].iloc[0])
        there = np.flatnonzero(~np.isnan(near))
        if not len(there):
            return pd.DataFrame({"row": row, "col": col, "d2": pd.NA, "near_row": pd.NA, "near_col": pd.NA})
        order = there[np.lexsort((col[there], near[there]))]  # so that the first minimum has the least (row, col)
        g2 = (near[order] - row) ** 2
        best, d2 = np.empty(len(col), int), np.empty(len(col))
        for i in range(0, len(col), 512):
            d = (col[i : i + 512, None] - col[order][None, :]) ** 2 + g2
            best[i : i + 512] = d.argmin(1)
            d2[i : i + 512] = d.min(1)
        return pd.DataFrame({"row": row, "col": col, "d2": d2.astype(int), "near_row": near[order][best].astype(int), "near_col": col[order][best]})

    return column.groupBy("row").applyInPandas(rows, "row int, col int, d2 long, near_row int, near_col int")


def nearest_within(cells: DataFrame, mask: DataFrame, radius: float) -> DataFrame:
    """cells with d2, near_row, near_col of the nearest mask cell within a closed radius; cells without one are left out.

    A hash join through the disk's offsets: no grid is made, so it suits small radii on sparse layers of any extent. The order of
    distance, row and column is one of the offsets, so the least place in it is a number that hashing sums up; no pair is sorted.
    """
    offsets = sorted(disk_offsets(radius), key=lambda o: (o[0] ** 2 + o[1] ** 2, -o[0], -o[1]))
    reach = spread(mask.select("row", "col"), [(*o, i) for i, o in enumerate(offsets)])
    best = reach.groupBy("row", "col").agg(F.min("k").alias("_k"))
    dr, dc = (F.get(F.array(*[F.lit(o[i]) for o in offsets]), F.col("_k")) for i in (0, 1))
    near = [(dr * dr + dc * dc).cast("long").alias("d2"), (F.col("row") - dr).alias("near_row"), (F.col("col") - dc).alias("near_col")]
    return cells.join(best, ["row", "col"]).select(*cells.columns, *near)


def two_nearest_components(cells: DataFrame, labelled: DataFrame, radius: float) -> DataFrame:
    """row, col, d2_1, comp_1, d2_2, comp_2: the two nearest components within radius (nulls for a missing second)."""
    reach = spread(labelled.select("row", "col", "comp_id"), disk_offsets(radius))
    d2 = ((F.col("row") - F.col("src_row")) ** 2 + (F.col("col") - F.col("src_col")) ** 2).cast("long")
    by_comp = reach.groupBy("row", "col", "comp_id").agg(F.min(d2).alias("d2"))
    near = cells.select("row", "col").join(by_comp, ["row", "col"])
    rank = F.row_number().over(Window.partitionBy("row", "col").orderBy("d2", "comp_id"))
    first_two = near.withColumn("k", rank).where("k <= 2").groupBy("row", "col")
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    return first_two.agg(pick("d2", 1).alias("d2_1"), pick("comp_id", 1).alias("comp_1"), pick("d2", 2).alias("d2_2"), pick("comp_id", 2).alias("comp_2"))


def offset_frame(near: DataFrame, strike: str = "strike_deg") -> DataFrame:
    """near (row, col, near_row, near_col, strike) with d_par, d_perp and side relative to the nearest segment's strike."""
    dr, dc, s = F.col("row") - F.col("near_row"), F.col("col") - F.col("near_col"), F.radians(strike)
    par, perp = dc * F.sin(s) - dr * F.cos(s), -(dc * F.cos(s) + dr * F.sin(s))
    return near.withColumns({"d_par": par, "d_perp": F.abs(perp), "side": F.signum(perp)})




def spacing(dots: DataFrame, radius: float) -> DataFrame:
    """row, col, d of the nearest other dot; null where none is within radius."""
    around = [o for o in disk_offsets(radius) if o != (0, 0)]
    dots = dots.select("row", "col").distinct()
    d2 = (F.col("row") - F.col("src_row")) ** 2 + (F.col("col") - F.col("src_col")) ** 2
    best = spread(dots, around).groupBy("row", "col").agg(F.min(F.sqrt(d2.cast("double"))).alias("d"))
    return dots.join(best, ["row", "col"], "left")


def nearest_other_component(labelled: DataFrame, radius: float) -> DataFrame:
    """row, col, comp_id, d2, other: for every cell the nearest cell of another component within radius (the first in order of
    distance, row and column); cells without one are left out."""
    reach = spread(labelled.select("row", "col", F.col("comp_id").alias("other")), disk_offsets(radius))
    d2 = ((F.col("row") - F.col("src_row")) ** 2 + (F.col("col") - F.col("src_col")) ** 2).cast("long")
    met = labelled.join(reach.withColumn("d2", d2), ["row", "col"]).where("other <> comp_id")
    best = met.groupBy("row", "col", "comp_id").agg(F.min(F.struct("d2", "src_row", "src_col", "other")).alias("m"))
    return best.select("row", "col", "comp_id", "m.d2", F.col("m.other").alias("other"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, key: str, value: str) -> DataFrame:
    """points with the value and squared distance d2 of the nearest centroid (key, cy, cx, value); ties to the least key.

    The centroids are one for each segment of a fixed grid's table, so they are broadcast and scanned as one array.
    """
    table = centroids.agg(F.collect_list(F.struct("cy", "cx", F.col(key).alias("key"), F.col(value).alias("v"))).alias("_all"))
    d2 = lambda c: (F.col("row") - c["cy"]) ** 2 + (F.col("col") - c["cx"]) ** 2
    best = F.array_min(F.transform("_all", lambda c: F.struct(d2(c).alias("d2"), c["key"].alias("key"), c["v"].alias("v"))))
    out = points.join(F.broadcast(table)).withColumn("_b", best)
    return out.select(*points.columns, F.col("_b.key").alias(key), F.col("_b.v").alias(value), F.col("_b.d2").alias("d2"))

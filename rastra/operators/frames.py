"""Frames of two components: for every cell the nearest mask cell and the nearest one of another component, without a bound on
the distance, and the k nearest cells with a condition on them.

The transform has two passes, each a grouped map over a line of the grid, whatever the number of lines. A line's place keeps two
candidates of unlike components: a third one is never nearer than both, and one of those two is of another component than the
nearest. Ties go to the least (row, column).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.storage import drop_staged, stage_table

_NONE = 1 << 40


def _two_of_column(rows: np.ndarray, comps: np.ndarray, height: int) -> tuple[np.ndarray, ...]:
    """(row, comp) of the nearest cell and (row, comp) of the nearest of another component, for each place of a column; -1: none."""
    n = len(rows)
    change = np.r_[True, comps[1:] != comps[:-1]]
    start = np.maximum.accumulate(np.where(change, np.arange(n), 0))  # of the run of equal components that a cell is in
    stop = np.r_[np.flatnonzero(change)[1:], n][np.cumsum(change) - 1]
    at = np.arange(height)
    below = np.searchsorted(rows, at)  # the first cell that is not above
    above = np.searchsorted(rows, at, side="right") - 1
    ends = [np.where(above >= 0, above, -1), np.where(below < n, below, -1)]
    ends += [np.where(above >= 0, start[np.maximum(above, 0)] - 1, -1), np.where(below < n, stop[np.minimum(below, n - 1)], n)]
    ends[3] = np.where(ends[3] < n, ends[3], -1)
    near = np.stack(ends)
    there = near >= 0
    r, k = np.where(there, rows[np.maximum(near, 0)], -1), np.where(there, comps[np.maximum(near, 0)], -1)
    far = np.where(there, np.abs(r - at), _NONE) * 2 * height + np.maximum(r, 0)  # ties to the upper cell
    first = far.argmin(0)[None, :]
    pick = lambda x, i: np.take_along_axis(x, i, 0)[0]
    far = np.where(k == pick(k, first), _NONE * 4 * height, far)
    second = far.argmin(0)[None, :]
    lost = pick(far, second) >= _NONE
    return pick(r, first), pick(k, first), np.where(lost, -1, pick(r, second)), np.where(lost, -1, pick(k, second))


def component_frame(labelled: DataFrame, grid: GridSpec) -> DataFrame:
    """row, col, then d2, near_row, near_col and comp of the nearest labelled cell (suffix _1) and of the nearest one of another
    component (suffix _2, null with a single component), for every cell of the grid.

    labelled: row, col, comp_id. Repeated cells count once, with their least component. Without a labelled cell there are no rows.
    """
    labelled = labelled.groupBy("row", "col").agg(F.min("comp_id").cast("long").alias("comp_id"))
    height, width = grid.height, grid.width

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        r1, k1, r2, k2 = _two_of_column(pdf["row"].to_numpy(np.int64), pdf["comp_id"].to_numpy(np.int64), height)
        return pd.DataFrame({"row": np.arange(height), "col": pdf["col"].iloc[0], "r1": r1, "k1": k1, "r2": r2, "k2": k2})

    lines = labelled.groupBy("col").applyInPandas(columns, "row int, col int, r1 long, k1 long, r2 long, k2 long")

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        y = int(pdf["row"].iloc[0])
        r, k = (np.concatenate([pdf[f"{c}1"].to_numpy(), pdf[f"{c}2"].to_numpy()]) for c in "rk")
        c = np.tile(pdf["col"].to_numpy(np.int64), 2)
        some = r >= 0
        order = np.lexsort((c[some], r[some]))  # so that the first minimum has the least (row, column)
        r, k, c = r[some][order], k[some][order], c[some][order]
        out = {n: np.empty(width, np.int64) for n in ("a", "b", "da", "db")}
        for at in range(0, width, 256):
            x = np.arange(at, min(width, at + 256))
            d = (x[:, None] - c[None, :]) ** 2 + ((r - y) ** 2)[None, :]
            a = d.argmin(1)
            out["a"][x], out["da"][x] = a, d[np.arange(len(x)), a]
            d = np.where(k[None, :] == k[a][:, None], _NONE, d)
            b = d.argmin(1)
            out["b"][x], out["db"][x] = b, d[np.arange(len(x)), b]
        a, b, lost = out["a"], out["b"], out["db"] >= _NONE
        hidden = lambda v: pd.array(np.where(lost, 0, v), dtype="Int64").copy() if not lost.any() else pd.Series(v).where(~lost).astype("Int64")
        return pd.DataFrame({
            "row": y, "col": np.arange(width), "d2_1": out["da"], "near_row_1": r[a], "near_col_1": c[a], "comp_1": k[a],
            "d2_2": hidden(out["db"]), "near_row_2": hidden(r[b]), "near_col_2": hidden(c[b]), "comp_2": hidden(k[b]),
        })

    kind = "row int, col int, " + ", ".join(f"d2_{i} long, near_row_{i} long, near_col_{i} long, comp_{i} long" for i in (1, 2))
    return lines.groupBy("row").applyInPandas(rows, kind)


def k_nearest(asked: DataFrame, cells: DataFrame, k: int, grid: GridSpec, first: int = 8, by: tuple[str, ...] = ()) -> DataFrame:
    """row, col, place (from 1), d2, then near_row, near_col and the other columns of the k nearest cells of each asked cell (itself
    too, where it is one of them), nearest first, ties to the least (row, column); fewer where there are fewer.

    asked: row, col. by: columns of both that a cell and its nearest ones share, a layer for instance; they are kept. Cells meet in
    square blocks as wide as the radius, three by three around an asked one. Whoever has k cells within the radius is done; the
    others go on with four times the radius, until it exceeds the grid.
    """
    at, rest = [*by, "row", "col"], [c for c in cells.columns if c not in ("row", "col", *by)]
    todo, done, radius = asked.select(*at).distinct(), None, first
    while True:
        block = lambda c: F.floor(F.col(c) / radius)
        around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        near = cells.select(*by, F.col("row").alias("near_row"), F.col("col").alias("near_col"), *rest, block("row").alias("_y"), block("col").alias("_x"))
        ask = todo.withColumn("o", around).select(*at, (block("row") + F.col("o.a")).alias("_y"), (block("col") + F.col("o.b")).alias("_x"))
        d2 = (F.col("row") - F.col("near_row")).cast("long") ** 2 + (F.col("col") - F.col("near_col")).cast("long") ** 2
        met = ask.join(near, [*by, "_y", "_x"]).withColumn("d2", d2.cast("long")).where(F.col("d2") <= radius * radius).drop("_y", "_x")
        place = F.row_number().over(Window.partitionBy(*at).orderBy("d2", "near_row", "near_col"))
        found = stage_table(met.withColumn("place", place).where(F.col("place") <= k).select(*at, "place", "d2", "near_row", "near_col", *rest), "near")
        last = radius >= grid.height + grid.width
        full = found if last else found.join(found.where(F.col("place") == k).select(*at), at, "left_semi")
        done = full if done is None else done.unionByName(full)
        if last:
            return done
        todo = stage_table(todo.join(full.select(*at).distinct(), at, "left_anti"), "todo")
        if todo.isEmpty():
            drop_staged(todo)
            return done
        radius *= 4


def folded(a: Column, b: Column) -> Column:
    """The unsigned difference of two axes in degrees, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.when(d > 90, 180 - d).otherwise(d)


def strike_against_null(hidden: DataFrame, visible: DataFrame, grid: GridSpec, bins: int = 9, k: int = 13, coherent: float = 0.2) -> DataFrame:
    """bin, n_hidden, n_null, enrichment: the angles between hidden cells and the nearest visible cell, against the same angles
    between visible cells and the nearest cell of another component, in equal bins of 0 to 90 degrees.

    hidden, visible: row, col, strike_deg, coherence; visible also comp_id. Both cells of an angle are coherent. A visible cell
    counts only if one of its k nearest (itself included) is of another component: it is censored otherwise. Where the null is
    empty the enrichment is 1; where all of hidden is empty it is 0.
    """
    nearest = k_nearest(hidden, visible, 1, grid).select("row", "col", F.col("strike_deg").alias("host"), F.col("coherence").alias("host_coherence"))
    both = (F.col("coherence") > coherent) & (F.col("host_coherence") > coherent)
    angles = hidden.join(nearest, ["row", "col"]).where(both).select(folded(F.col("strike_deg"), F.col("host")).alias("angle"), F.lit(1).alias("is_hidden"))
    own = visible.select("row", "col", F.col("comp_id").alias("_comp"), F.col("strike_deg").alias("_strike"), F.col("coherence").alias("_coherence"))
    others = k_nearest(visible, visible, k, grid).join(own, ["row", "col"]).where("comp_id <> _comp")
    first = others.groupBy("row", "col", "_strike", "_coherence").agg(F.min_by(F.struct("strike_deg", "coherence"), "place").alias("m"))
    null = first.where((F.col("_coherence") > coherent) & (F.col("m.coherence") > coherent)).select(folded(F.col("_strike"), F.col("m.strike_deg")).alias("angle"), F.lit(0).alias("is_hidden"))
    at = F.least(F.lit(bins - 1), F.floor(F.round(F.col("angle"), 9) / (90 / bins))).cast("int").alias("bin")
    counts = angles.unionByName(null).groupBy(at).agg(F.sum("is_hidden").alias("n_hidden"), F.sum(1 - F.col("is_hidden")).alias("n_null"))
    table = hidden.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)
    whole = Window.partitionBy()  # a row for each bin
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1))
    ratio = F.when(F.col("n_null") > 0, F.try_divide(share("n_hidden"), share("n_null"))).otherwise(1.0)
    return table.select("bin", "n_hidden", "n_null", ratio.alias("enrichment"))

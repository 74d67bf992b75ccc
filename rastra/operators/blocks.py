"""Dense neighbourhood work on sparse layers: square blocks with a margin, each one small dense array in one task.

A cell is sent to the blocks whose window it lies in, in one shuffle; several passes over the window then need no other. What a
window's cut edges make wrong stays within the margin. Blocks without cells are never made, and their number grows with the layer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastra.grid import GridSpec


def smoothed(a: np.ndarray, weights: list[float], mirrored: bool) -> np.ndarray:
    """A separable convolution with symmetric weights; beyond the array it is mirrored or 0."""
    r = len(weights) // 2
    for axis in (0, 1):
        pad = [(r, r) if k == axis else (0, 0) for k in (0, 1)]
        wide = np.pad(a, pad, mode="symmetric" if mirrored else "constant")
        n = a.shape[axis]
        a = sum(w * (wide[i : i + n] if axis == 0 else wide[:, i : i + n]) for i, w in enumerate(weights))
    return a


class Window:
    """A block's window: dense arrays by name (0 where there is no cell), and the block's own part of them."""

    def __init__(self, pdf: pd.DataFrame, values: list[str], grid: GridSpec, side: int, halo: int):
        top, left = int(pdf["block_row"].iloc[0]) * side, int(pdf["block_col"].iloc[0]) * side
        self.row, self.col = max(0, top - halo), max(0, left - halo)
        shape = (min(grid.height, top + side + halo) - self.row, min(grid.width, left + side + halo) - self.col)
        at = (pdf["row"].to_numpy() - self.row, pdf["col"].to_numpy() - self.col)
        self.there = np.zeros(shape, bool)
        self.there[at] = True
        self.arrays = {v: np.zeros(shape) for v in values}
        for v in values:
            self.arrays[v][at] = pdf[v].to_numpy(float)
        self.inner = np.zeros(shape, bool)
        self.inner[top - self.row : top - self.row + side, left - self.col : left - self.col + side] = True

    def cells(self, which: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
        """Rows for the block's own cells in which."""
        y, x = np.nonzero(which & self.inner)
        return pd.DataFrame({"row": y + self.row, "col": x + self.col, **{n: a[y, x] for n, a in columns.items()}})


def by_blocks(cells: DataFrame, values: list[str], grid: GridSpec, halo: int, run: Callable[[Window], pd.DataFrame], more: str, side: int = 128) -> DataFrame:
    """row, col and the columns `more` that run makes of each block's window. cells: row, col (inside the grid) and values."""
    last = {"row": (grid.height - 1) // side, "col": (grid.width - 1) // side}
    blocks = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / side)).cast("int"), F.least(F.lit(last[c]), F.floor((F.col(c) + halo) / side)).cast("int"))
    dealt = cells.select("row", "col", *values, F.explode(blocks("row")).alias("block_row")).withColumn("block_col", F.explode(blocks("col")))
    return dealt.groupBy("block_row", "block_col").applyInPandas(lambda pdf: run(Window(pdf, values, grid, side, halo)), f"row int, col int, {more}")

"""Mask algebra on sparse cells: and, and-not, or."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELL = ["row", "col"]


def mask_and(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return cells.join(mask.select(*_CELL), _CELL, "left_semi")


def mask_and_not(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return cells.join(mask.select(*_CELL), _CELL, "left_anti")


def mask_or(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*_CELL)
    for m in masks[1:]:
        out = out.unionByName(m.select(*_CELL))
    return out.distinct()


def same_mask(a: DataFrame, b: DataFrame) -> bool:
    """Both differences are empty."""
    return not (a.select(*_CELL).exceptAll(b.select(*_CELL)).limit(1).count() or b.select(*_CELL).exceptAll(a.select(*_CELL)).limit(1).count())


def block_max(cells: DataFrame, factor: int) -> DataFrame:
    """Downsample by the greatest value of factor x factor blocks; absent cells are 0."""
    return cells.groupBy((F.col("row") / factor).cast("int").alias("row"), (F.col("col") / factor).cast("int").alias("col")).agg(F.max("value").alias("value"))


def priority_overlay(layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """row, col, source: the first of several masks that has the cell."""
    out = None
    for k, (name, mask) in enumerate(layers):
        one = mask.select("row", "col", F.struct(F.lit(k).alias("k"), F.lit(name).alias("source")).alias("_s"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("row", "col").agg(F.min("_s").alias("_s")).select("row", "col", "_s.source")


def footprint(cells: DataFrame) -> DataFrame:
    """row, col of the cells whose value is finite."""
    v = F.col("value").cast("double")
    return cells.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select("row", "col").distinct()

"""Checks of a surface before it is written, as rows (check, passed)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastra.grid import GridSpec


def checks(cells: DataFrame, grid: GridSpec, catalogue: DataFrame | None = None) -> DataFrame:
    """One pass over the cells: finite, in range, inside the grid, once each, and clear of the catalogue."""
    v = F.col("value")
    inside = (F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width)
    per_cell = cells.groupBy("row", "col").agg(
        F.count("*").alias("n"),
        F.max((v.isNull() | F.isnan(v) | (F.abs(v) > 1e18)).cast("int")).alias("bad"),
        F.max(((v < 0) | (v > 1)).cast("int")).alias("out"),
    )
    if catalogue is None:
        marked = per_cell.withColumn("hit", F.lit(0))
    else:
        marked = per_cell.join(catalogue.select("row", "col").distinct().withColumn("_c", F.lit(1)), ["row", "col"], "left").withColumn("hit", F.coalesce("_c", F.lit(0)))
    none = lambda c: F.coalesce(F.max(c), F.lit(0)) == 0
    one = marked.agg(
        none("bad").alias("finite"),
        none("out").alias("in_range"),
        none((~inside).cast("int")).alias("inside_grid"),
        (F.coalesce(F.max("n"), F.lit(1)) <= 1).alias("unique_cells"),
        none("hit").alias("clear_of_catalogue"),
        (F.count("*") > 0).alias("not_empty"),
    )
    names = one.columns
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n in names])).alias("r")).select("r.check", "r.passed")


def assert_valid(checked: DataFrame) -> None:
    failed = [r["check"] for r in checked.where("not passed").collect()]  # at most one row for each check
    if failed:
        raise ValueError("failed checks: " + ", ".join(sorted(failed)))

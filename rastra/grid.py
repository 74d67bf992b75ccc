"""The data model: a fixed grid, and layers, masks and traces as sparse DataFrames of cells (row, col)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A study grid: its size in cells and the affine transform (x per col, skew, x0, skew, y per row, y0)."""

    height: int
    width: int
    affine: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    epsg: int | None = None


#: The published study grid.
STUDY_GRID = GridSpec(3730, 3292, (100.0, 0.0, 243350.0, 0.0, -100.0, 4508550.0), 32611)
EVENT_GRID = GridSpec(720, 256)
LAYER_GRID = GridSpec(400, 128)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells_in(grid: GridSpec, spark: SparkSession) -> DataFrame:
    """Every cell of a grid, made where it is needed: range() is split over tasks."""
    at = spark.range(grid.height * grid.width)
    return at.select((F.col("id") / grid.width).cast("int").alias("row"), (F.col("id") % grid.width).cast("int").alias("col"))


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer (event type), row (hour of January 2024), col (user_id % 256), value (the cell's greatest, capped at 1)."""
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    value = F.least(F.lit(1.0), F.col("value") / 500)
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), hour.alias("row"), (F.col("user_id") % 256).cast("int").alias("col"), value.alias("v"))
    return events.groupBy("layer", "row", "col").agg(F.max("v").alias("value"))


def event_roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth (purchases) and prediction (clicks with their value), both without the catalogue's cells (errors).

    One aggregate by cell tells all three roles, so the masks need no joins and share one scan and one shuffle.
    """
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    kind, value = F.col("event_type"), F.least(F.lit(1.0), F.col("value") / 500)
    events = table(spark, sf_dir, "events").where(kind.isin("click", "purchase", "error"))
    cells = events.select(hour.alias("row"), (F.col("user_id") % 256).cast("int").alias("col"), kind, value.alias("value")).groupBy("row", "col").agg(
        F.max(F.when(kind == "click", F.col("value"))).alias("click"), F.max(kind == "purchase").alias("bought"), F.max(kind == "error").alias("known")
    )
    return cells.where("bought and not known").select("row", "col"), cells.where("click is not null and not known").select("row", "col", F.col("click").alias("value"))


def layer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer (supplier % 16), row (week of shipping), col (part % 128), value (ten times the greatest discount, capped)."""
    week = (F.datediff("l_shipdate", F.lit("1995-01-01")) / 7).cast("int")
    value = F.least(F.lit(1.0), 10 * F.col("l_discount"))
    items = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).cast("int").alias("layer"), week.alias("row"), (F.col("l_partkey") % 128).cast("int").alias("col"), value.alias("v"))
    return items.groupBy("layer", "row", "col").agg(F.max("v").alias("value"))


def order_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, row_no, x0, y0, x1, y1, sense: lines between a customer's consecutive orders."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = (F.datediff("o_orderdate", F.lit("1995-01-01")) % 400).cast("double")
    y = (F.col("o_orderkey") % 300).cast("double")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", x.alias("x0"), y.alias("y0"), F.left("o_orderpriority", F.lit(1)).alias("sense"))
    out = orders.withColumns({"x1": F.lead("x0").over(w), "y1": F.lead("y0").over(w)}).where("x1 is not null")
    return out.select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("row_no"), "x0", "y0", "x1", "y1", "sense")


def mask_of(cells: DataFrame, layer: str | int) -> DataFrame:
    return cells.where(F.col("layer") == layer).select("row", "col")

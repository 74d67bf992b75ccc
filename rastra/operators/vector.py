"""Vector traces on the grid: pixelising segments, record summaries, sense rasters, feature offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators.components import axis_angle

#: Slip-sense codes.
SENSE_CODES = {"N": 1, "RL": 2, "LL": 3}


def pixelise(traces: DataFrame, grid: GridSpec) -> DataFrame:
    """traces with (row, col) of every sample on each segment: max(|dr|, |dc|) + 1 evenly spaced ones, clipped to the grid.

    The affine transform must have no skew. Segments with a null or non-finite end raise when they are read.
    """
    a, _, x0, _, e, y0 = grid.affine
    cell = lambda v, origin, step: F.floor((F.col(v) - origin) / step)
    bad = F.exists(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("x0", "y0", "x1", "y1")]), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    ends = traces.withColumns({"_c0": cell("x0", x0, a), "_r0": cell("y0", y0, e), "_c1": cell("x1", x0, a), "_r1": cell("y1", y0, e)})
    n = F.when(bad, F.raise_error(F.lit("a trace has a null or non-finite end")).cast("long")).otherwise(F.greatest(F.abs(F.col("_r1") - F.col("_r0")), F.abs(F.col("_c1") - F.col("_c0"))))
    steps = ends.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    at = lambda lo, hi: F.col(lo) + F.when(F.col("_n") > 0, F.floor((F.col(hi) - F.col(lo)) * F.col("_i") / F.col("_n") + 0.5)).otherwise(0)
    clip = lambda v, size: F.greatest(F.lit(0), F.least(F.lit(size - 1), v)).cast("int")
    return steps.select(*traces.columns, clip(at("_r0", "_r1"), grid.height).alias("row"), clip(at("_c0", "_c1"), grid.width).alias("col"))


def rasterise(traces: DataFrame, grid: GridSpec) -> DataFrame:
    return pixelise(traces, grid).select("row", "col").distinct()


def sense_raster(traces: DataFrame, grid: GridSpec, codes: dict[str, int] = SENSE_CODES) -> DataFrame:
    """row, col, code: the last row (row_no) that has a known sense wins."""
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    coded = pixelise(traces, grid).withColumn("code", F.try_element_at(known, F.col("sense"))).where("code is not null")
    return coded.groupBy("row", "col").agg(F.max_by("code", "row_no").alias("code"))


def record_segments(traces: DataFrame, grid: GridSpec, known: list[str], scale: float = 100.0) -> DataFrame:
    """record_id, n_fragments, size, length, span, strike_deg, sense. size, span and strike (array frame) are of all pixels of
    the record's lines, length sums the lines' own lengths over scale, and sense is the commonest one (a missing sense is the
    class unk; ties: first seen), unk if it is none of known.

    Pixels are made twice and summed as they are made, once for the axis and once along it: only lines are joined and sorted."""
    axis = pixelise(traces, grid).groupBy("record_id").agg(F.count("*").alias("size"), F.avg("row").alias("cy"), F.avg("col").alias("cx"), axis_angle().alias("_a"))
    along = (F.col("row") - F.col("cy")) * F.cos("_a") + (F.col("col") - F.col("cx")) * F.sin("_a")
    ends = pixelise(traces.join(axis, "record_id"), grid).groupBy("record_id").agg(*[F.first(c).alias(c) for c in ("size", "_a")], (F.max(along) - F.min(along)).alias("span"))
    shape = ends.select("record_id", "size", "span", F.pmod(F.degrees("_a"), F.lit(180.0)).alias("strike_deg"))
    lines = traces.groupBy("record_id").agg(F.count("*").alias("n_fragments"), (F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))) / scale).alias("length"))
    named = traces.select("record_id", "row_no", F.coalesce("sense", F.lit("unk")).alias("sense"))
    counts = named.groupBy("record_id", "sense").agg(F.count("*").alias("_c"), F.min("row_no").alias("_f"))
    mode = counts.groupBy("record_id").agg(F.max_by("sense", F.struct("_c", (-F.col("_f")).alias("f"))).alias("_m"))
    sense = F.when(F.col("_m").isin(known), F.col("_m")).otherwise("unk")
    return lines.join(shape, "record_id").join(mode, "record_id").select("record_id", "n_fragments", "size", "length", "span", "strike_deg", sense.alias("sense"))


def trace_ids(traces: DataFrame, grid: GridSpec) -> DataFrame:
    """row, col, row_no of the last line through each pixel."""
    return pixelise(traces, grid).groupBy("row", "col").agg(F.max("row_no").alias("row_no"))


def azimuth(dr: Column, dc: Column) -> Column:
    """Degrees modulo 180; rows grow south."""
    return F.pmod(F.degrees(F.atan2(dc, -dr)), F.lit(180.0))


def axial_difference(a: Column, b: Column) -> Column:
    """The acute angle between two axes."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def obliquity(ray: Column, strike: Column) -> Column:
    """Ray minus strike in [-90, 90); 0 where there is no strike."""
    return F.when(strike.isNull(), 0.0).otherwise(F.pmod(ray - strike + 90, F.lit(180.0)) - 90)


def strike_from_double_angle(sin2: Column, cos2: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(sin2, cos2)) / 2, F.lit(180.0))


def last_known(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """value carried forward over nulls."""
    return df.withColumn(value, F.last(value, True).over(Window.partitionBy(*by).orderBy(order)))

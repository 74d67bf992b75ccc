"""Connected components of masks, segments along them, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators.graph import connected_components
from rastra.operators.masks import mask_and_not
from rastra.operators.stencil import dilate, disk_offsets, junctions, spread, square_offsets


def label8(mask: DataFrame, grid: GridSpec) -> DataFrame:
    """row, col, comp_id: 8-connected components; the id is the least row * width + col of the component."""
    key = lambda r, c: (F.col(r).cast("long") * grid.width + F.col(c))
    cells = mask.select("row", "col").distinct()
    half = [(0, 1), (1, -1), (1, 0), (1, 1)]  # each edge once
    edges = spread(cells, half, grid).join(cells, ["row", "col"]).select(key("src_row", "src_col").alias("a"), key("row", "col").alias("b"))
    found = connected_components(edges).withColumnRenamed("node", "_k")
    out = cells.withColumn("_k", key("row", "col")).join(found, "_k", "left")
    return out.select("row", "col", F.coalesce("component", "_k").alias("comp_id"))


def axis_strike() -> Column:
    """Degrees in [0, 180) of the principal axis of (row, col), as an azimuth (row grows south)."""
    rr, cc, rc = F.var_pop("row"), F.var_pop("col"), F.covar_pop("row", "col")
    return F.pmod(F.degrees(F.lit(0.5) * F.atan2(F.round(-2 * rc, 9), F.round(rr - cc, 9))), F.lit(180.0))


def segment_table(labelled: DataFrame) -> DataFrame:
    """comp_id, n, cy, cx, strike_deg (null for a single cell)."""
    out = labelled.groupBy("comp_id").agg(F.count("*").alias("n"), F.avg("row").alias("cy"), F.avg("col").alias("cx"), axis_strike().alias("_s"))
    return out.select("comp_id", "n", "cy", "cx", F.when(F.col("n") >= 2, F.col("_s")).alias("strike_deg"))


def branches(mask: DataFrame, grid: GridSpec, chunk: int = 12) -> DataFrame:
    """row, col, comp_id, chunk_no: branches between junctions, cut along their principal axis every `chunk` cells."""
    labelled = label8(mask_and_not(mask.select("row", "col"), junctions(mask)), grid)
    axis = segment_table(labelled).select("comp_id", "cy", "cx", F.radians(F.coalesce("strike_deg", F.lit(0.0))).alias("_s"))
    along = (F.col("col") - F.col("cx")) * F.sin("_s") - (F.col("row") - F.col("cy")) * F.cos("_s")
    w = Window.partitionBy("comp_id").orderBy(F.round(along, 6), "row", "col")
    return labelled.join(axis, "comp_id").select("row", "col", "comp_id", ((F.row_number().over(w) - 1) / chunk).cast("int").alias("chunk_no"))


def detached(labelled: DataFrame, gap: float = 4.0) -> DataFrame:
    """comp_id of the components no other component comes within a closed radius of."""
    reach = spread(labelled.select("row", "col", F.col("comp_id").alias("other")), disk_offsets(gap)).select("row", "col", "other")
    touched = labelled.join(reach, ["row", "col"]).where("comp_id <> other").select("comp_id").distinct()
    return labelled.select("comp_id").distinct().join(touched, "comp_id", "left_anti")


def axis_angle(dr: str = "row", dc: str = "col") -> Column:
    """Radians of the principal axis of (row, col) in the array's frame; 0 where there is none."""
    return F.lit(0.5) * F.atan2(F.round(2 * F.covar_pop(dr, dc), 9), F.round(F.var_pop(dr) - F.var_pop(dc), 9))


def extents(cells: DataFrame, key: str) -> DataFrame:
    """key, size, cy, cx, strike_deg (array frame, [0, 180)), span and the ends p0 (r0, c0) and p1 (r1, c1) of the cells'
    principal axis, which points to growing rows."""
    axis = cells.groupBy(key).agg(F.count("*").alias("size"), F.avg("row").alias("cy"), F.avg("col").alias("cx"), axis_angle().alias("_a"))
    v0, v1 = F.cos("_a"), F.sin("_a")  # the angle is in (-90, 90] degrees, so v0 >= 0
    along = (F.col("row") - F.col("cy")) * v0 + (F.col("col") - F.col("cx")) * v1
    ends = cells.join(axis, key).groupBy(key).agg(F.min(along).alias("_lo"), F.max(along).alias("_hi"))
    at = lambda c, v, e: F.col(c) + v * F.col(e)
    return axis.join(ends, key).select(
        key, "size", "cy", "cx", F.pmod(F.degrees("_a"), F.lit(180.0)).alias("strike_deg"), (F.col("_hi") - F.col("_lo")).alias("span"),
        at("cy", v0, "_lo").alias("r0"), at("cx", v1, "_lo").alias("c0"), at("cy", v0, "_hi").alias("r1"), at("cx", v1, "_hi").alias("c1"),
    )


def links(fragments: DataFrame, gap: float = 4.0, turn: float = 30.0, link_angle: float = 45.0) -> DataFrame:
    """a, b (a < b): fragments (from extents, by comp_id) linked end to end: an end of a has b's nearer end within gap, their
    strikes are within turn, and the way between the ends is within link_angle of a's axis.

    Ends meet in square cells of more than the gap, so the candidate join is a hash join by cell.
    """
    side = max(2 * gap, 8.0)
    cell = lambda c: F.floor(F.col(c) / side).cast("int")
    ends = fragments.select("comp_id", "strike_deg", "r0", "c0", "r1", "c1", F.explode(F.array(F.struct(F.col("r0").alias("r"), F.col("c0").alias("c")), F.struct(F.col("r1").alias("r"), F.col("c1").alias("c")))).alias("e"))
    ends = ends.select("*", F.col("e.r").alias("r"), F.col("e.c").alias("c")).withColumns({"row": cell("r"), "col": cell("c")})
    mine = spread(ends.select(F.col("comp_id").alias("a"), F.col("strike_deg").alias("sa"), "r", "c", "row", "col"), square_offsets(1))
    other = ends.select(F.col("comp_id").alias("b"), F.col("strike_deg").alias("sb"), "r0", "c0", "r1", "c1", "row", "col").distinct()
    met = mine.join(other, ["row", "col"]).where("a < b")
    far = lambda k: F.hypot(F.col("r") - F.col(f"r{k}"), F.col("c") - F.col(f"c{k}"))
    first = far(0) <= far(1)
    dr = F.when(first, F.col("r0")).otherwise(F.col("r1")) - F.col("r")
    dc = F.when(first, F.col("c0")).otherwise(F.col("c1")) - F.col("c")
    met = met.withColumns({"_g": F.least(far(0), far(1)), "_dr": dr, "_dc": dc, "_s": F.radians("sa")})
    d = F.pmod(F.abs(F.col("sa") - F.col("sb")), F.lit(180.0))
    cosine = F.abs(F.col("_dr") * F.cos("_s") + F.col("_dc") * F.sin("_s")) / F.greatest("_g", F.lit(1e-9))
    along = (F.col("_g") < 1e-9) | (F.degrees(F.acos(F.least(cosine, F.lit(1.0)))) <= link_angle)
    return met.where((F.col("_g") <= gap) & (F.least(d, 180 - d) <= turn) & along).select("a", "b").distinct()


def linked(labelled: DataFrame, gap: float = 4.0, turn: float = 30.0, link_angle: float = 45.0) -> DataFrame:
    """comp_id, system_id (the least comp_id that links reach)."""
    found = connected_components(links(extents(labelled, "comp_id"), gap, turn, link_angle)).withColumnRenamed("node", "comp_id")
    return labelled.select("comp_id").distinct().join(found, "comp_id", "left").select("comp_id", F.coalesce("component", "comp_id").alias("system_id"))


def system_table(labelled: DataFrame, systems: DataFrame) -> DataFrame:
    """system_id, n_fragments, size, length (the sum of the fragments' spans), span and strike_deg of all its cells."""
    spans = extents(labelled, "comp_id").join(systems, "comp_id").groupBy("system_id").agg(F.count("*").alias("n_fragments"), F.sum("span").alias("length"))
    whole = extents(labelled.join(systems, "comp_id").select("system_id", "row", "col"), "system_id")
    return spans.join(whole, "system_id").select("system_id", "n_fragments", "size", "length", "span", "strike_deg")


def systems_by_dilation(mask: DataFrame, grid: GridSpec, steps: int = 2) -> DataFrame:
    """row, col, comp_id of mask cells: components of the mask dilated by squares, so that near pieces are one system."""
    grown = label8(dilate(mask, square_offsets(steps), grid), grid)
    return grown.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")

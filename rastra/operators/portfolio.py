"""Portfolios of layers: their placement against a catalogue, what goes with their scores, halos and nested shells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators import fits, frames, nearest, stats, stencil

#: The measures of a layer that scores are compared with.
MEASURES = ["dots", "d_median", "d_p10", "near_share", "spacing_median", "hit_share"]


def portfolio(layers: DataFrame, catalogue: DataFrame, grid: GridSpec, by: str = "layer", near: float = 3.0) -> DataFrame:
    """by, dots, least, most (values), d_median, d_p10, d_least (distance to the catalogue), near_share (of the dots within `near`),
    spacing_median (distance to the nearest other dot of the layer; null for a single dot), hit_share (of the catalogue's cells).

    layers: by, row, col, value; catalogue: row, col. Distances are exact however far; without a catalogue they are null."""
    catalogue = catalogue.select("row", "col").distinct()
    layers = layers.select(by, "row", "col", "value")
    d = nearest.distance_transform(catalogue, grid).select("row", "col", F.sqrt(F.col("d2").cast("double")).alias("_d"))
    size = catalogue.agg(F.count("*").alias("_all"))
    spacing = frames.k_nearest(layers, layers.select(by, "row", "col"), 2, grid, by=(by,)).where("place = 2")
    spacing = spacing.groupBy(by).agg(F.percentile(F.sqrt(F.col("d2").cast("double")), 0.5).alias("spacing_median"))
    out = layers.join(d, ["row", "col"], "left").groupBy(by).agg(
        F.count("*").alias("dots"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("_d", 0.5).alias("d_median"), F.percentile("_d", 0.1).alias("d_p10"),
        F.min("_d").alias("d_least"), F.avg((F.col("_d") <= near).cast("double")).alias("near_share"), F.count_if(F.col("_d") == 0).alias("_hit"),
    )
    out = out.join(F.broadcast(size)).withColumn("hit_share", F.col("_hit") / F.greatest("_all", F.lit(1)))  # one row
    return out.join(spacing, by, "left").select(by, "dots", "least", "most", "d_median", "d_p10", "d_least", "near_share", "spacing_median", "hit_share")


def score_correlations(table: DataFrame, score: str, measures: list[str] = MEASURES) -> DataFrame:
    """measure, n, rho, p: the rank correlation of each measure with the score over the rows that have both, and its p-value; null for
    a constant measure or fewer than three rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("m")
    long = table.select(F.col(score).cast("double").alias("_score"), pairs).select("m.measure", "m.value", "_score")
    out = stats.correlations(long, "value", "_score", ["measure"])
    return out.select("measure", "n", F.col("spearman").alias("rho"), fits.rank_p_value(F.col("spearman"), F.col("n")).alias("p"))


def halo_decision(layers: DataFrame, panel: DataFrame, footprint: DataFrame, by: str = "layer", radius: float = 3.0, blind: float = 0.5) -> DataFrame:
    """by, dots, halo (share of the footprint within radius of the layer), overlap (the greatest share of a panel layer's cells within
    radius of it), is_blind: a halo of at least `blind` makes an overlap say nothing.

    layers, panel: by, row, col. The halo is a dilation of each layer, counted against the footprint: one aggregate by layer and cell."""
    reach = stencil.spread(layers.select(by, "row", "col"), stencil.disk_offsets(radius)).select(by, "row", "col").distinct()
    halo = reach.join(footprint.select("row", "col").distinct(), ["row", "col"], "left_semi").groupBy(by).agg(F.count("*").alias("_in"))
    size = footprint.select("row", "col").distinct().agg(F.count("*").alias("_all"))
    mine = panel.select(F.col(by).alias("_mine"), "row", "col").distinct()
    sizes = mine.groupBy("_mine").agg(F.count("*").alias("_n"))
    met = mine.join(reach, ["row", "col"]).where(F.col("_mine") != F.col(by)).groupBy(by, "_mine").agg(F.count("*").alias("_met"))
    overlap = met.join(sizes, "_mine").groupBy(by).agg(F.max(F.col("_met") / F.col("_n")).alias("overlap"))
    out = layers.groupBy(by).agg(F.count("*").alias("dots")).join(halo, by, "left").join(overlap, by, "left").fillna(0, ["_in", "overlap"]).join(F.broadcast(size))  # one row
    share = F.col("_in") / F.greatest("_all", F.lit(1))
    return out.select(by, "dots", share.alias("halo"), "overlap", (share >= blind).alias("is_blind"))


def shells(chain: DataFrame, credits: DataFrame, distances: DataFrame, order: str = "step") -> DataFrame:
    """step, n, credit, mean_credit, d_median: of a chain of nested layers, what each step has beyond the next one.

    chain: step, row, col, the greatest layer first; credits: step, credit (of the whole layer); distances: row, col, d. Reading it
    raises where a layer holds a cell that the one before it does not."""
    chain = chain.select(order, "row", "col").distinct()
    cells = chain.groupBy("row", "col").agg(F.min(order).alias("_first"), F.max(order).alias(order), F.count("*").alias("_n"))
    steps = credits.select(order, "credit").withColumn("_place", F.row_number().over(Window.orderBy(order)))  # one row for each step
    steps = steps.withColumn("_more", F.col("credit") - F.coalesce(F.lead("credit").over(Window.orderBy(order)), F.lit(0.0)))
    whole = F.when((F.col("_place") != F.col("_n")), F.raise_error(F.lit("the layers are not nested")).cast("int")).otherwise(0)
    # a row for each step; a cell of step k must be in all k layers up to it
    out = cells.join(F.broadcast(steps), order).withColumn("_ok", whole).where("_ok = 0").join(distances.select("row", "col", "d"), ["row", "col"], "left")
    out = out.groupBy(order).agg(F.count("*").alias("n"), F.max("_more").alias("credit"), F.percentile("d", 0.5).alias("d_median"))
    return out.select(order, "n", "credit", (F.col("credit") / F.col("n")).alias("mean_credit"), "d_median")

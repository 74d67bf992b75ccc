"""Spatially blocked splits: quadrants, component folds, buffered draws, weighted negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators.allocate import prefix_to_mass
from rastra.operators.stencil import diamond_offsets, disk_offsets, spread


def quadrants(footprint: DataFrame) -> DataFrame:
    """row, col, quadrant: 0 to 3 by the footprint's median row and column, truncated."""
    middle = footprint.agg(F.percentile("row", 0.5).cast("int").alias("_r"), F.percentile("col", 0.5).cast("int").alias("_c"))
    below = lambda c, m: (F.col(c) >= F.col(m)).cast("int")
    return footprint.join(F.broadcast(middle)).select("row", "col", (2 * below("row", "_r") + below("col", "_c")).alias("quadrant"))


def component_folds(labelled: DataFrame, quads: DataFrame) -> DataFrame:
    """comp_id, quadrant: where most of a component's cells lie; ties to the lowest."""
    counts = labelled.join(quads, ["row", "col"]).groupBy("comp_id", "quadrant").agg(F.count("*").alias("c"))
    return counts.groupBy("comp_id").agg(F.max_by("quadrant", F.struct("c", (-F.col("quadrant")).alias("q"))).alias("quadrant"))


def buffered_draw(labelled: DataFrame, share: float, collar: float, seed: int) -> DataFrame:
    """row, col, role: hidden (whole components in hash order up to the share), collar (visible within it), visible."""
    sizes = labelled.groupBy("comp_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hidden = labelled.join(prefix_to_mass(sizes, "comp_id", "n", share * total, seed), "comp_id", "left_semi").select("row", "col")
    near = spread(hidden, disk_offsets(collar)).select("row", "col").distinct().withColumn("_near", F.lit(True))
    out = labelled.join(hidden.withColumn("_hidden", F.lit(True)), ["row", "col"], "left").join(near, ["row", "col"], "left")
    role = F.when(F.col("_hidden"), "hidden").when(F.col("_near"), "collar").otherwise("visible")
    return out.select("row", "col", role.alias("role"))


def hash_order(key: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def weighted_negatives(rows: DataFrame, label: str, by: str, key: list[str], cap: int, seed: int) -> DataFrame:
    """rows with weight: all positives, and per group `cap` negatives in hash order, each weighing for those left out."""
    w = Window.partitionBy(by).orderBy("_h", *key)
    neg = rows.where(F.col(label) == 0).withColumn("_h", hash_order(key, seed))
    size = neg.groupBy(by).agg(F.count("*").alias("_n"))
    kept = neg.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).join(size, by)
    kept = kept.withColumn("weight", F.col("_n") / F.least(F.col("_n"), F.lit(cap))).drop("_h", "_k", "_n")
    return rows.where(F.col(label) == 1).withColumn("weight", F.lit(1.0)).unionByName(kept)


def label_blind_folds(labelled: DataFrame, quads: DataFrame, buffer: float, reach_of: DataFrame) -> DataFrame:
    """fold, row, col, role over the cells of reach_of: held (cells of components that meet the fold's quadrant), region (other
    cells of the quadrant), buffer (within a closed radius of both), train. Components meet any number of folds."""
    met = labelled.join(quads, ["row", "col"]).select("comp_id", F.col("quadrant").alias("fold")).distinct()
    held = labelled.join(met, "comp_id").select("fold", "row", "col").withColumn("_held", F.lit(True))
    folds = quads.select(F.col("quadrant").alias("fold")).distinct()
    cells = reach_of.select("row", "col").join(F.broadcast(folds))  # four folds
    region = quads.withColumnRenamed("quadrant", "fold").withColumn("_in", F.lit(True))
    out = cells.join(held, ["fold", "row", "col"], "left").join(region, ["fold", "row", "col"], "left")
    closed = out.where("_held or _in").select("fold", "row", "col")
    near = spread(closed, disk_offsets(buffer)).select("fold", "row", "col").distinct().withColumn("_near", F.lit(True))
    role = F.when(F.col("_held"), "held").when(F.col("_in"), "region").when(F.col("_near"), "buffer").otherwise("train")
    return out.join(near, ["fold", "row", "col"], "left").select("fold", "row", "col", role.alias("role"))


def eroded_domains(footprint: DataFrame, truth: DataFrame, grid: GridSpec, steps: int) -> DataFrame:
    """fold, row, col, is_truth: each quadrant of the footprint less `steps` diamond layers from its edge."""
    quads = quadrants(footprint).withColumnRenamed("quadrant", "fold")
    offsets = diamond_offsets(steps)
    hits = spread(quads, offsets, grid).groupBy("fold", "row", "col").agg(F.count("*").alias("_n")).where(F.col("_n") == len(offsets))
    marked = hits.join(truth.select("row", "col").distinct().withColumn("_t", F.lit(True)), ["row", "col"], "left")
    return marked.select("fold", "row", "col", F.coalesce("_t", F.lit(False)).alias("is_truth"))


def whole_segments(labelled: DataFrame, block: int, forbidden: DataFrame, cap: int) -> DataFrame:
    """comp_id, n, block_row, block_col: components that lie in one block and touch no forbidden cell, in order of id up to cap."""
    at = [F.floor(F.col(c) / block).cast("int").alias(f"block_{c}") for c in ("row", "col")]
    bad = labelled.join(forbidden.select("row", "col"), ["row", "col"], "left_semi").select("comp_id").distinct()
    sizes = labelled.select("comp_id", *at).groupBy("comp_id").agg(F.count("*").alias("n"), *[f(f"block_{c}").alias(f"_{k}{c}") for c in ("row", "col") for k, f in (("a", F.min), ("z", F.max))])
    one = sizes.where("_arow = _zrow and _acol = _zcol").join(bad, "comp_id", "left_anti")
    return one.orderBy("comp_id").limit(cap).select("comp_id", "n", F.col("_arow").alias("block_row"), F.col("_acol").alias("block_col"))


def block_folds(footprint: DataFrame, block: int, per_row: int, folds: int = 4) -> DataFrame:
    """row, col, fold: blocks numbered row by row, dealt to folds in turn."""
    number = F.floor(F.col("row") / block) * per_row + F.floor(F.col("col") / block)
    return footprint.select("row", "col", (number % folds).cast("int").alias("fold"))


def matched_removal(cells: DataFrame, k: int, seed: int) -> DataFrame:
    """cells less k of them, drawn by hash: the control of a removal of the same size."""
    gone = cells.orderBy(hash_order(["row", "col"], seed), "row", "col").limit(k).select("row", "col")
    return cells.join(gone, ["row", "col"], "left_anti")


def hide_and_recover(labelled: DataFrame, quads: DataFrame, share: float, collar: float, seeds: list[int], modes: dict[str, DataFrame]) -> DataFrame:
    """fold_key, row, col, role for every seed, mode and quadrant: hidden, collar or visible, as buffered_draw within the
    quadrant's components of the mode (comp_id allowed in it)."""
    home = component_folds(labelled, quads)
    out = None
    for mode, allowed in sorted(modes.items()):
        some = labelled.join(allowed.select("comp_id"), "comp_id", "left_semi").join(home, "comp_id")
        for seed in seeds:
            for q in range(4):  # a fixed number of fold cells
                drawn = buffered_draw(some.where(F.col("quadrant") == q).select("row", "col", "comp_id"), share, collar, seed)
                one = drawn.select(F.lit(f"{mode}:{seed}:{q}").alias("fold_key"), "row", "col", "role")
                out = one if out is None else out.unionByName(one)
    return out

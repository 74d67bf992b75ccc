"""Density ratios out of fold, their calibration, and the scores of folds.

The model is a product of one ratio for each feature: the smoothed share of a bin among positive cells over that among the others.
It is made of counts, so one aggregate by (fold, feature, bin) holds the models of all folds: the counts of all folds less the
fold's own. No cell is scored by a model that has seen its fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastra.operators.metric import dti
from rastra.operators.stats import bin_of
from rastra.operators.stencil import RADIUS, kernel_offsets, spread


def density_ratio(cells: DataFrame, fold: str, label: str, edges: dict[str, list[float]]) -> DataFrame:
    """cells with log_ratio (positive over other cells, by the other folds) and p (its posterior at the other folds' base rate).

    edges: the bin edges of each feature; values outside, and nulls, are one more bin. Cells without a fold or label are not scored.
    A single fold has no other ones: every ratio is 1 and p is 1/2.
    """
    names = sorted(edges)
    bin_ = lambda f: F.concat(F.lit(f"{f}:"), F.coalesce(bin_of(F.col(f), edges[f]).cast("string"), F.lit("-")))
    cells = cells.where(F.col(fold).isNotNull() & F.col(label).isNotNull())
    seen = cells.select(F.col(fold).alias("_fold"), F.col(label).cast("long").alias("_y"), F.explode(F.array(*[bin_(f) for f in names], F.lit("all"))).alias("_bin"))
    own = seen.groupBy("_fold", "_bin").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))  # folds x bins rows
    total = own.groupBy("_bin").agg(F.sum("_pos").alias("_all_pos"), F.sum("_neg").alias("_all_neg"))
    # folds x bins, both bounded by the arguments
    both = own.select("_fold").distinct().crossJoin(F.broadcast(total)).join(own, ["_fold", "_bin"], "left").fillna(0)
    counts = F.struct((F.col("_all_pos") - F.col("_pos")).alias("pos"), (F.col("_all_neg") - F.col("_neg")).alias("neg"))
    model = both.groupBy("_fold").agg(F.map_from_entries(F.collect_list(F.struct("_bin", counts.alias("n")))).alias("_model"))
    scored = cells.join(F.broadcast(model), F.col(fold) == F.col("_fold"))  # a row for each fold
    every = F.element_at("_model", F.lit("all"))
    share = lambda f, side: (F.coalesce(F.element_at("_model", bin_(f))[side], F.lit(0)) + 1) / (every[side] + len(edges[f]))
    ratio = sum((F.ln(share(f, "pos") / share(f, "neg")) for f in names), F.lit(0.0))
    prior = F.ln((every["pos"] + 1) / (every["neg"] + 1))
    p = 1 / (1 + F.exp(-(F.col("log_ratio") + prior)))
    return scored.withColumn("log_ratio", ratio).withColumn("p", p).drop("_fold", "_model")


def quantile_calibration(scored: DataFrame, value: str, label: str, n: int = 8) -> DataFrame:
    """bin, n, positives, mean_value of n bins between equally spaced quantiles of value; a value at a cut is in the lower bin."""
    cuts = scored.agg(F.percentile(value, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("_cuts"))
    binned = scored.join(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("_cuts", lambda c: c < F.col(value))))  # one row
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum(label).alias("positives"), F.avg(value).alias("mean_value"))


def fold_scores(truth: DataFrame, prediction: DataFrame, fold: str, radius: float = RADIUS) -> DataFrame:
    """fold, n_truth, n_dots, tp, fp, fn, dti of each fold by itself: credit never crosses from one fold to another. Folds with
    truth or prediction alone have a row; without truth the index is 0. truth: fold, row, col; prediction: also value."""
    truth, prediction = truth.select(fold, "row", "col").distinct(), prediction.where("value > 0 and not isnan(value)").select(fold, "row", "col", "value")
    pairs = spread(truth, kernel_offsets(radius)).join(prediction, [fold, "row", "col"])
    covered = pairs.groupBy(fold, "src_row", "src_col").agg(F.max(F.col("value") * F.col("k")).alias("credit")).groupBy(fold).agg(F.sum("credit").alias("tp"))
    near = pairs.groupBy(fold, "row", "col").agg(F.max("k").alias("q"))
    dots = prediction.join(near, [fold, "row", "col"], "left").groupBy(fold).agg(F.count("*").alias("n_dots"), F.sum(F.col("value") * (1 - F.coalesce("q", F.lit(0.0)))).alias("fp"))
    out = truth.groupBy(fold).agg(F.count("*").alias("n_truth")).join(dots, fold, "full").join(covered, fold, "left").fillna(0, ["n_truth", "n_dots", "tp", "fp"])
    return out.select(fold, "n_truth", "n_dots", "tp", "fp", (F.col("n_truth") - F.col("tp")).alias("fn")).withColumn("dti", dti(F.col("tp"), F.col("fp"), F.col("fn")))

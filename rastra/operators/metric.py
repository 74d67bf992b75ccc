"""Distance-weighted Tversky index between truth cells and predicted cells, its block terms and resampling.

tp sums, over truth, the best value * kernel(distance) of a prediction; fp sums, over predictions, value * (1 - the best
kernel of a truth cell); fn is what is left of truth. One stencil join gives both maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.operators.stencil import ALPHA, BETA, RADIUS, kernel_offsets, spread

EPS = 1e-12


def dti(tp: Column, fp: Column, fn: Column) -> Column:
    return tp / (tp + ALPHA * fp + BETA * fn + EPS)


def credits(truth: DataFrame, prediction: DataFrame, radius: float = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(row, col, credit) of every truth cell and (row, col, value, q) of every predicted cell."""
    truth, prediction = truth.select("row", "col"), prediction.where("value > 0 and not isnan(value)").select("row", "col", "value")
    pairs = spread(truth, kernel_offsets(radius)).join(prediction, ["row", "col"])
    best = pairs.groupBy("src_row", "src_col").agg(F.max(F.col("value") * F.col("k")).alias("credit"))
    best = best.withColumnsRenamed({"src_row": "row", "src_col": "col"})
    near = pairs.groupBy("row", "col").agg(F.max("k").alias("q"))  # the join has dealt pairs by these columns already
    return (
        truth.join(best, ["row", "col"], "left").select("row", "col", F.coalesce("credit", F.lit(0.0)).alias("credit")),
        prediction.join(near, ["row", "col"], "left").select("row", "col", "value", F.coalesce("q", F.lit(0.0)).alias("q")),
    )


def block_terms(truth: DataFrame, prediction: DataFrame, block: int, radius: float = RADIUS) -> DataFrame:
    """block_row, block_col, tp, fp, fn, n_truth: additive, so any union of blocks can be scored from them."""
    t, p = credits(truth, prediction, radius)
    at = [(F.col(c) / block).cast("int").alias(f"block_{c}") for c in ("row", "col")]
    zero = F.lit(0.0)
    t = t.select(*at, F.col("credit").alias("tp"), zero.alias("fp"), F.lit(1).alias("n"))
    p = p.select(*at, zero.alias("tp"), (F.col("value") * (1 - F.col("q"))).alias("fp"), F.lit(0).alias("n"))
    out = t.unionByName(p).groupBy("block_row", "block_col").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("n").alias("n_truth"))
    return out.select("block_row", "block_col", "tp", "fp", (F.col("n_truth") - F.col("tp")).alias("fn"), "n_truth")


def score(truth: DataFrame, prediction: DataFrame, radius: float = RADIUS) -> DataFrame:
    """One row: n_truth, tp, fp, fn, dti. Without truth the index is 0."""
    t, p = credits(truth, prediction, radius)
    t = t.agg(F.count("*").alias("n_truth"), F.coalesce(F.sum("credit"), F.lit(0.0)).alias("tp"))
    p = p.agg(F.coalesce(F.sum(F.col("value") * (1 - F.col("q"))), F.lit(0.0)).alias("fp"))
    # one row each
    return t.join(F.broadcast(p)).select("n_truth", "tp", "fp", (F.col("n_truth") - F.col("tp")).alias("fn")).withColumn("dti", dti(F.col("tp"), F.col("fp"), F.col("fn")))


def jackknife(terms: DataFrame, by: str) -> DataFrame:
    """by, dti: the index of everything but one group, from the groups' sums and their total."""
    groups = terms.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    total = groups.agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")])
    rest = [F.col(f"all_{c}") - F.col(c) for c in ("tp", "fp", "fn")]
    return groups.join(F.broadcast(total)).select(by, dti(*rest).alias("dti"))


def bootstrap(terms: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """draw, tp, fp, fn, dti: blocks (block_id 0..n-1) resampled with replacement; pick i of a draw is a hash of both.

    Every block counts how often each draw picks it, so the blocks stay where they are and draws are summed by partial
    aggregation; the picks are draws * n rows of two numbers.
    """
    n = terms.agg(F.count("*").alias("n"))
    spark = terms.sparkSession
    picks = spark.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(n)).select("draw", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    hexes = F.substring(F.md5(F.concat_ws(":", "draw", "i", F.lit(seed))), 1, 8)
    picks = picks.select("draw", (F.conv(hexes, 16, 10).cast("long") % F.col("n")).alias("block_id"))
    counts = picks.groupBy("draw", "block_id").agg(F.count("*").alias("times"))
    out = counts.join(terms, "block_id").groupBy("draw").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("tp", "fp", "fn")])
    return out.withColumn("dti", dti(F.col("tp"), F.col("fp"), F.col("fn")))


def wilson(successes: Column, total: Column, z: float = 1.959963985) -> tuple[Column, Column]:
    p = successes / total
    scale = 1 + z * z / total
    centre = (p + z * z / (2 * total)) / scale
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / scale
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(total > 0, low).otherwise(0.0), F.when(total > 0, high).otherwise(0.0)


def paired_bootstrap(terms: DataFrame, candidate: str, draws: int, seed: int = 1) -> DataFrame:
    """arm, dti, low, high, delta, delta_low, delta_high: each arm's index over all blocks with its 95 % interval, and the
    candidate's lead over it.

    terms: arm, block_id, tp, fp, fn; folds' terms of one block are summed before the draws. Every draw picks the same blocks
    for all arms; blocks without a term in any arm take no part. Blocks are cells of a fixed grid.
    """
    names = ("tp", "fp", "fn")
    merged = terms.groupBy("arm", "block_id").agg(*[F.sum(c).alias(c) for c in names])
    active = merged.groupBy("block_id").agg(F.sum(F.col("tp") + F.col("fp") + F.col("fn")).alias("_s")).where("_s > 0")
    numbered = active.select("block_id", (F.row_number().over(Window.orderBy("block_id")) - 1).alias("_i"))
    blocks = merged.join(numbered, "block_id").select("arm", F.col("_i").cast("long").alias("_i"), *names)
    n = numbered.agg(F.count("*").alias("n"))
    picks = terms.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(n)).select("draw", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    hexes = F.substring(F.md5(F.concat_ws(":", "draw", "i", F.lit(seed))), 1, 8)
    times = picks.select("draw", (F.conv(hexes, 16, 10).cast("long") % F.col("n")).alias("_i")).groupBy("draw", "_i").agg(F.count("*").alias("_t"))
    drawn = times.join(blocks, "_i").groupBy("draw", "arm").agg(dti(*[F.sum(F.col(c) * F.col("_t")) for c in names]).alias("d"))
    lead = drawn.where(F.col("arm") == candidate).select("draw", F.col("d").alias("_best"))
    ends = drawn.join(lead, "draw").groupBy("arm").agg(
        F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"),
        F.percentile(F.col("_best") - F.col("d"), 0.025).alias("delta_low"), F.percentile(F.col("_best") - F.col("d"), 0.975).alias("delta_high"),
    )
    whole = merged.groupBy("arm").agg(dti(*[F.sum(c) for c in names]).alias("dti"))
    first = whole.where(F.col("arm") == candidate).select(F.col("dti").alias("_best"))
    out = whole.join(ends, "arm").join(F.broadcast(first))
    return out.select("arm", "dti", "low", "high", (F.col("_best") - F.col("dti")).alias("delta"), "delta_low", "delta_high")


def pooled(terms: DataFrame, by: str) -> DataFrame:
    """by, dti, recall, low, high: groups and, as a null group, all of them; recall is tp over truth with its Wilson interval."""
    out = terms.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_truth")])
    every = out.agg(F.lit(None).cast(terms.schema[by].dataType).alias(by), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_truth")])
    low, high = wilson(F.col("tp"), F.col("n_truth"))
    recall = F.when(F.col("n_truth") > 0, F.col("tp") / F.col("n_truth")).otherwise(0.0)
    return out.unionByName(every).select(by, dti(F.col("tp"), F.col("fp"), F.col("fn")).alias("dti"), recall.alias("recall"), low.alias("low"), high.alias("high"))


def surrogate_terms(dots: DataFrame, probability: DataFrame, n_truth: float, radius: float = RADIUS) -> DataFrame:
    """One row: n_dots, t, m, dti. t sums probability times the best kernel of a dot, m the dots' own best kernels."""
    best = spread(dots.select("row", "col"), kernel_offsets(radius)).groupBy("row", "col").agg(F.max("k").alias("k"))
    t = probability.join(best, ["row", "col"]).agg(F.coalesce(F.sum(F.col("value") * F.col("k")), F.lit(0.0)).alias("t"))
    m = dots.select("row", "col").join(best, ["row", "col"]).agg(F.count("*").alias("n_dots"), F.coalesce(F.sum("k"), F.lit(0.0)).alias("m"))
    index = F.col("t") / (ALPHA * (F.col("t") + F.col("n_dots") - F.col("m")) + BETA * n_truth + EPS)
    return t.join(F.broadcast(m)).select("n_dots", "t", "m", index.alias("dti"))  # one row each


def thinned_scores(truth: DataFrame, prediction: DataFrame, scales: list[float], seed: int = 1) -> DataFrame:
    """scale, n_dots, dti: the index of Bernoulli subsamples of the prediction, nested by one hash of the cell. Dots of value 0 are
    counted too; null and NaN values are none."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "row", "col", F.lit(seed))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    steps = truth.sparkSession.createDataFrame([(s,) for s in scales], "scale double")  # as many rows as scales
    kept = prediction.where("value is not null and not isnan(value)").withColumn("_u", draw).join(F.broadcast(steps), F.col("_u") < F.col("scale"))
    near = spread(truth.select("row", "col"), kernel_offsets()).join(kept.select("row", "col", "value", "scale"), ["row", "col"])
    q = near.groupBy("row", "col").agg(F.max("k").alias("q"))
    missed = F.col("value") * (1 - F.coalesce("q", F.lit(0.0)))
    fp = kept.join(q, ["row", "col"], "left").groupBy("scale").agg(F.count("*").alias("n_dots"), F.sum(missed).alias("fp"))
    tp = near.groupBy("scale", "src_row", "src_col").agg(F.max(F.col("value") * F.col("k")).alias("c")).groupBy("scale").agg(F.sum("c").alias("tp"))
    out = steps.join(fp, "scale", "left").join(tp, "scale", "left").fillna(0, ["n_dots", "fp", "tp"]).join(F.broadcast(truth.agg(F.count("*").alias("n"))))
    return out.select("scale", "n_dots", dti(F.col("tp"), F.col("fp"), F.col("n") - F.col("tp")).alias("dti"))

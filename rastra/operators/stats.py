"""Ranks, correlations, histograms and robust statistics as window functions and partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.storage import stage_table


def average_rank(df: DataFrame, value: str, by: list[str], parts: int = 64) -> DataFrame:
    """df with rank: ties share the mean of their places, within groups. Null values have no rank (null) and count for none;
    a null group is a group.

    Values are counted first, so windows run over distinct values; a group's values are cut at `parts` quantiles of all
    values, so that a group of any size is ranked by many tasks and only the parts' totals are summed in one place.
    """
    bounds = df.select(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(value))) if bounds else F.lit(0)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn("_part", part)
    totals = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate([*by, "_part"])], "_start")
    ranks = ranks.join(starts, [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate([*by, "_part"])])
    keys = [*by, value]
    ranks = ranks.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], (F.col("_start") + F.col("_before") + (F.col("_n") + 1) / 2).alias("rank"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return df.join(ranks.where(F.col(f"_k{len(by)}").isNotNull()), same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def with_group(df: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of a table that has a row for each group; a null group is a group."""
    names = [f"_g{i}" for i in range(len(by))]
    table = table.select(*[F.col(c).alias(n) for c, n in zip(by, names)], *[c for c in table.columns if c not in by])
    return df.join(table, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)]).drop(*names)


def pearson(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate, null where a column is constant."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, rho: null for constant columns or fewer than three rows."""
    ranked = average_rank(average_rank(df, a, by).withColumnRenamed("rank", "_ra"), b, by)
    out = ranked.groupBy(*by).agg(pearson("_ra", "rank").alias("rho"), F.count("*").alias("_n"))
    return out.select(*by, F.when(F.col("_n") >= 3, F.col("rho")).alias("rho"))


def auc(df: DataFrame, value: str, label: str, by: list[str], least: int = 10) -> DataFrame:
    """by, n_pos, n_neg, auc (Mann-Whitney from average ranks), canary (the larger of auc and 1 - auc)."""
    ranked = average_rank(df.where(F.col(value).isNotNull()), value, by)
    pos = F.col(label) == 1
    out = ranked.groupBy(*by).agg(F.sum(F.when(pos, 1).otherwise(0)).alias("n_pos"), F.sum(F.when(pos, 0).otherwise(1)).alias("n_neg"), F.sum(F.when(pos, F.col("rank")).otherwise(0.0)).alias("_r"))
    out = out.where((F.col("n_pos") >= least) & (F.col("n_neg") >= least))
    a = (F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return out.select(*by, "n_pos", "n_neg", a.alias("auc"), F.greatest(a, 1 - a).alias("canary"))


def rank_to_byte(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with byte: the average rank scaled to 0..254."""
    ranked = average_rank(df, value, by)
    df = df.where(F.col(value).isNotNull())
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    scaled = F.when(F.col("_n") > 1, (F.col("rank") - 1) / (F.col("_n") - 1) * 254).otherwise(0.0)
    return with_group(ranked, sizes, by).withColumn("byte", F.rint(scaled).cast("int")).drop("rank", "_n")


def robust_z(df: DataFrame, value: str, by: list[str], clip: float = 10.0) -> DataFrame:
    """df with z: (value - median) / (1.4826 MAD), the standard deviation where MAD is 0, clipped; 0 where that is 0 too."""
    center = df.groupBy(*by).agg(F.percentile(value, 0.5).alias("_med"), F.stddev_pop(value).alias("_sd"))
    off = with_group(df, center, by)
    spread = off.groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("_med")), 0.5).alias("_mad"))
    scale = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.col("_sd"))
    z = F.when(scale > 0, (F.col(value) - F.col("_med")) / scale).otherwise(0.0)
    return with_group(off, spread, by).withColumn("z", F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).drop("_med", "_sd", "_mad")


def bin_of(value: Column, edges: list[float]) -> Column:
    """Right-open bin number by edges (the last is closed), null outside."""
    inside = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value)) - 1
    last = len(edges) - 2
    return F.when((value >= edges[0]) & (value < edges[-1]), inside).when(value == edges[-1], last)


def enrichment(df: DataFrame, value: str, label: str, edges: list[float]) -> DataFrame:
    """bin, n_all, n_pos, rate and ratio (rate over the total rate) for every bin, empty ones included."""
    spark = df.sparkSession
    counts = df.withColumn("bin", bin_of(F.col(value), edges)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n_all"), F.sum(label).alias("n_pos"))
    total = counts.agg((F.sum("n_pos") / F.sum("n_all")).alias("_base"))
    bins = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    out = bins.join(counts, "bin", "left").fillna(0, ["n_all", "n_pos"]).join(F.broadcast(total))
    rate = F.when(F.col("n_all") > 0, F.col("n_pos") / F.col("n_all")).otherwise(0.0)
    return out.select("bin", "n_all", "n_pos", rate.alias("rate"), F.when(F.col("_base") > 0, rate / F.col("_base")).otherwise(0.0).alias("ratio"))


def joint_enrichment(df: DataFrame, a: str, b: str, label: str, edges_a: list[float], edges_b: list[float]) -> DataFrame:
    """bin_a, bin_b, n_all, n_pos, rate of two measures' joint bins, empty ones included; rows outside either's bins don't count."""
    spark = df.sparkSession
    counts = df.select(bin_of(F.col(a), edges_a).alias("bin_a"), bin_of(F.col(b), edges_b).alias("bin_b"), F.col(label).alias("_y")).where("bin_a is not null and bin_b is not null")
    counts = counts.groupBy("bin_a", "bin_b").agg(F.count("*").alias("n_all"), F.sum("_y").alias("n_pos"))
    at = F.col("id").cast("int")
    bins = spark.range((len(edges_a) - 1) * (len(edges_b) - 1)).select((at / (len(edges_b) - 1)).cast("int").alias("bin_a"), (at % (len(edges_b) - 1)).alias("bin_b"))
    out = bins.join(counts, ["bin_a", "bin_b"], "left").fillna(0, ["n_all", "n_pos"])
    return out.withColumn("rate", F.when(F.col("n_all") > 0, F.col("n_pos") / F.col("n_all")).otherwise(0.0))


def side_rates(df: DataFrame, side: str, label: str) -> DataFrame:
    """One row: n_left, n_right (positive cells of a side), rate_left, rate_right and log_ratio (right over left; null without a rate)."""
    of = lambda s, c: F.coalesce(F.sum(F.when(F.signum(side) == s, c)), F.lit(0))
    one = df.agg(of(-1, F.col(label)).alias("n_left"), of(1, F.col(label)).alias("n_right"), of(-1, F.lit(1)).alias("_l"), of(1, F.lit(1)).alias("_r"))
    rate = lambda n, all_: F.col(n) / F.greatest(F.col(all_), F.lit(1))
    out = one.select("n_left", "n_right", rate("n_left", "_l").alias("rate_left"), rate("n_right", "_r").alias("rate_right"))
    return out.withColumn("log_ratio", F.when((F.col("rate_left") > 0) & (F.col("rate_right") > 0), F.ln(F.col("rate_right") / F.nullif("rate_left", F.lit(0.0)))))


def entropy(df: DataFrame, category: str, by: list[str]) -> DataFrame:
    """by, entropy: of the categories' shares, in nats."""
    counts = df.groupBy(*by, category).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    p = F.col("_n") / F.col("_all")
    return with_group(counts, total, by).groupBy(*by).agg((-F.sum(p * F.ln(p))).alias("entropy"))


def power_law(df: DataFrame, x: str, y: str, edges: list[float], quantile: float = 0.9, least: int = 5) -> DataFrame:
    """One row: gamma, log_scale. Weighted least squares of log(quantile of y) on log(mean x) over bins of x; both are null where
    fewer than two bins have `least` rows."""
    bins = df.where((F.col(x) > 0) & (F.col(y) > 0)).withColumn("_b", bin_of(F.col(x), edges)).where("_b is not null")
    points = bins.groupBy("_b").agg(F.ln(F.avg(x)).alias("u"), F.ln(F.percentile(y, quantile)).alias("v"), F.count("*").alias("w")).where(F.col("w") >= least)
    sums = points.agg(*[F.sum(e).alias(n) for n, e in (("w", F.col("w")), ("wu", F.col("w") * F.col("u")), ("wv", F.col("w") * F.col("v")), ("wuu", F.col("w") * F.col("u") * F.col("u")), ("wuv", F.col("w") * F.col("u") * F.col("v")))])
    spread = F.col("w") * F.col("wuu") - F.col("wu") * F.col("wu")
    gamma = F.try_divide(F.col("w") * F.col("wuv") - F.col("wu") * F.col("wv"), F.when(spread > 1e-9 * F.col("w") * F.col("wuu"), spread))
    return sums.select(gamma.alias("gamma"), F.try_divide(F.col("wv") - gamma * F.col("wu"), F.col("w")).alias("log_scale"))


def quantile_table(df: DataFrame, value: str, by: list[str], at: list[float]) -> DataFrame:
    names = [f"p{round(100 * q):02d}" for q in at]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(value, q).alias(n) for q, n in zip(at, names)])


def staged_percentile(df: DataFrame, value: str, q: float) -> float | None:
    """A percentile that later steps use as a literal."""
    return stage_table(df.agg(F.percentile(value, q).alias("p")), "percentile").first()["p"]


def correlations(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, n, pearson, spearman over rows where both are finite: null for constant columns or fewer than three rows."""
    fine = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))  # noqa: E731  NaN is above infinity
    rows = df.where(fine(a) & fine(b)).select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    ranked = average_rank(average_rank(rows, "_a", by).withColumnRenamed("rank", "_ra"), "_b", by)
    spans = (F.max("_a") - F.min("_a") > 1e-14) & (F.max("_b") - F.min("_b") > 1e-14) & (F.count("*") >= 3)
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson("_a", "_b").alias("_p"), pearson("_ra", "rank").alias("_s"), spans.alias("_ok"))
    return out.select(*by, "n", F.when(F.col("_ok"), F.col("_p")).alias("pearson"), F.when(F.col("_ok"), F.col("_s")).alias("spearman"))


def negative_block_errors(df: DataFrame, a: str, b: str, limits: tuple[float, float], side: int = 50, least: int = 32) -> DataFrame:
    """block_row, block_col, n, mse_a, mse_b, fpr_a, fpr_b of two surfaces over negative cells, for blocks of enough cells."""
    at = [(F.col(c) / side).cast("int").alias(f"block_{c}") for c in ("row", "col")]
    rate = lambda c, limit: F.avg((F.col(c) >= limit).cast("double"))
    out = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*at).agg(
        F.count("*").alias("n"), F.avg(F.col(a) * F.col(a)).alias("mse_a"), F.avg(F.col(b) * F.col(b)).alias("mse_b"), rate(a, limits[0]).alias("fpr_a"), rate(b, limits[1]).alias("fpr_b")
    )
    return out.where(F.col("n") >= least)


def independence(blocks: DataFrame, threshold: float = 0.6, least: int = 20) -> DataFrame:
    """One row: n_blocks, strongest (absolute correlation of the two surfaces' block errors), measured, allow."""
    one = blocks.withColumn("_all", F.lit(1))
    mse, fpr = (correlations(one, f"{c}_a", f"{c}_b", ["_all"]).select(F.col("n"), F.col("pearson").alias(f"{c}_p"), F.col("spearman").alias(f"{c}_s")) for c in ("mse", "fpr"))
    both = mse.join(F.broadcast(fpr.drop("n")))  # one row each
    four = [F.abs(F.col(f"{c}_{k}")) for c in ("mse", "fpr") for k in "ps"]
    whole = F.forall(F.array(*four), lambda x: x.isNotNull())
    measured = whole & (F.col("n") >= least)
    strongest = F.greatest(*four)
    return both.select(F.col("n").alias("n_blocks"), strongest.alias("strongest"), measured.alias("measured"), (measured & (strongest < threshold)).alias("allow"))


def dense_rank_of(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with dense: the number of distinct values up to the row's own (not Spearman's rank on ties)."""
    distinct = df.where(F.col(value).isNotNull()).select(*by, value).distinct()
    ranks = distinct.withColumn("dense", F.dense_rank().over(Window.partitionBy(*by).orderBy(value)))
    return with_group(df, ranks, [*by, value])


def surface_profile(cells: DataFrame, by: list[str], cells_of_grid: int, dense_from: float = 0.2) -> DataFrame:
    """by, n_finite, n_positive, least, most, n_values, dense: a layer of which more than a share of the grid is positive is
    dense, otherwise a layer of dots."""
    v = F.col("value")
    fine = v.isNotNull() & ~F.isnan(v)
    out = cells.where(fine).groupBy(*by).agg(F.count("*").alias("n_finite"), F.count_if(v > 0).alias("n_positive"), F.min(v).alias("least"), F.max(v).alias("most"), F.count_distinct(v).alias("n_values"))
    return out.withColumn("dense", F.col("n_positive") / cells_of_grid > dense_from)

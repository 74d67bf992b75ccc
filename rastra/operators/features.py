"""Per-cell feature tables: geometry relative to the nearest mapped segment, relay between two, density, calibration, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators import components, nearest, stencil, tensor

#: The geometry columns, in order.
GEOMETRY = ["d", "d_perp", "d_par_abs", "side", "log_len", "sin2", "cos2", "coherence", "density", "sin2d", "cos2d"]
#: The columns that records of slip sense add (2 is right-lateral, 3 left-lateral).
SENSE = ["sense_sgn", "sense_side"]


def geometry(cells: DataFrame, mask: DataFrame, grid: GridSpec, sense: DataFrame | None = None) -> DataFrame:
    """row, col and GEOMETRY of cells: the offset to the nearest mask cell in the frame of the strike there, the size of that
    cell's component, strike (as a doubled angle) and coherence of the structure tensor there, the mask's density around the
    cell, and the strike's sine and cosine times the distance. With sense (row, col, code) also SENSE: the code of a mask cell
    within one cell of the nearest one, with and without the side."""
    anchors = components.label8(mask, grid).join(tensor.local_strike(mask, grid), ["row", "col"])
    sizes = anchors.groupBy("comp_id").agg(F.count("*").alias("_len"))
    anchors = anchors.join(sizes, "comp_id").select(F.col("row").alias("near_row"), F.col("col").alias("near_col"), "_len", "strike_deg", "coherence")
    if sense is None:
        anchors = anchors.withColumn("_code", F.lit(0))
    else:
        coded = sense.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi").where("code > 0")
        at = anchors.select(F.col("near_row").alias("row"), F.col("near_col").alias("col"))
        near = nearest.nearest_within(at, coded, 1.0).join(coded.select(F.col("row").alias("near_row"), F.col("col").alias("near_col"), F.col("code").alias("_code")), ["near_row", "near_col"])
        anchors = anchors.join(near.select(F.col("row").alias("near_row"), F.col("col").alias("near_col"), "_code"), ["near_row", "near_col"], "left")
    near = nearest.distance_transform(mask, grid).join(cells.select("row", "col"), ["row", "col"])
    framed = nearest.offset_frame(near.join(anchors, ["near_row", "near_col"]))
    out = framed.join(stencil.disc_density(mask, grid).withColumnRenamed("n", "_dens"), ["row", "col"], "left")
    twice, d = F.radians(2 * F.col("strike_deg")), F.sqrt(F.col("d2").cast("double"))
    sign = F.when(F.col("_code") == 2, 1.0).when(F.col("_code") == 3, -1.0).otherwise(0.0)
    more = [] if sense is None else [sign.alias("sense_sgn"), (sign * F.col("side")).alias("sense_side")]
    return out.select(
        "row", "col", d.alias("d"), "d_perp", F.abs("d_par").alias("d_par_abs"), "side", F.log1p(F.col("_len")).alias("log_len"),
        F.sin(twice).alias("sin2"), F.cos(twice).alias("cos2"), "coherence", F.coalesce("_dens", F.lit(0)).alias("density"),
        (F.sin(twice) * d).alias("sin2d"), (F.cos(twice) * d).alias("cos2d"), *more,
    )


def relay(cells: DataFrame, mask: DataFrame, grid: GridSpec, radius: float) -> DataFrame:
    """row, col, d1, d2, relay_ratio: distances to the two nearest components within radius; the ratio d1 / (d1 + d2) is 1/2
    midway between them, and null where there is no second one."""
    two = nearest.two_nearest_components(cells, components.label8(mask, grid), radius)
    a, b = F.sqrt(F.col("d2_1").cast("double")), F.sqrt(F.col("d2_2").cast("double"))
    return two.select("row", "col", a.alias("d1"), b.alias("d2"), F.when(a + b > 0, a / (a + b)).alias("relay_ratio"))


def boosted_surface(train: DataFrame, cells: DataFrame, columns: list[str], label: str = "y", weight: str = "weight", trees: int = 20, depth: int = 5) -> DataFrame:
    """row, col, value: gradient-boosted probability, scaled so that its mean over the training rows is their base rate."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembler = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep")
    model = GBTClassifier(featuresCol="_x", labelCol=label, weightCol=weight, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=1).fit(assembler.transform(train))
    p = vector_to_array("probability").getItem(1)
    scored = model.transform(assembler.transform(train)).agg(F.sum(p * F.col(weight)).alias("p"), F.sum(F.col(label) * F.col(weight)).alias("y")).first()
    scale = scored["y"] / scored["p"] if scored["p"] else 1.0
    return model.transform(assembler.transform(cells)).select("row", "col", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p * scale)).alias("value"))


def catalogue_covariates(cells: DataFrame, mask: DataFrame, coded: DataFrame, footprint: DataFrame, grid: GridSpec) -> DataFrame:
    """row, col, d, log_len, strike_deg, coherence, side, sense, d_second, theta_deg of cells off the mask: predictors that come from
    the mask alone. The distance, component size, strike, coherence and code (0: none) at the nearest mask cell, the side of it, the
    distance to another component (null without one), and the strike of the footprint less the mask at the cell."""
    from rastra.operators import frames
    from rastra.storage import stage_table

    labelled = stage_table(components.label8(mask, grid), "labelled")
    sizes = labelled.groupBy(F.col("comp_id").alias("comp_1")).agg(F.count("*").alias("_n"))
    near = frames.component_frame(labelled, grid).join(cells.select("row", "col"), ["row", "col"]).withColumnsRenamed({"near_row_1": "near_row", "near_col_1": "near_col"})
    host = tensor.local_strike(mask, grid).join(coded.select("row", "col", "code"), ["row", "col"], "left")
    host = host.select(F.col("row").cast("long").alias("near_row"), F.col("col").cast("long").alias("near_col"), "strike_deg", "coherence", F.coalesce("code", F.lit(0)).alias("sense"))
    near = nearest.offset_frame(near.join(host, ["near_row", "near_col"]).join(sizes, "comp_1"))
    open_ = footprint.select("row", "col").join(mask.select("row", "col"), ["row", "col"], "left_anti")
    local = tensor.local_strike(open_, grid, 5.0).select("row", "col", F.col("strike_deg").alias("theta_deg"))
    d = lambda i: F.sqrt(F.col(f"d2_{i}").cast("double"))
    out = near.select("row", "col", d(1).alias("d"), F.log1p("_n").alias("log_len"), "strike_deg", "coherence", "side", "sense", d(2).alias("d_second"))
    return out.join(local, ["row", "col"], "left")


def interpolated(x: Column, at: list[float], values: list[float]) -> Column:
    """The piecewise linear function through (at, values), constant beyond both ends."""
    out = F.lit(float(values[-1]))
    for a, b, u, v in reversed(list(zip(at, at[1:], values, values[1:]))):
        out = F.when(x < b, u + (v - u) * (x - a) / (b - a)).otherwise(out)
    return F.when(x < at[0], float(values[0])).otherwise(out)


def analytic_intensity(cells: DataFrame, value: str, length_rates: list[float], length_at: list[float], sense_rates: dict[int, float], farthest: float) -> DataFrame:
    """cells with intensity in [0, 1]: value (a distance profile's rate at the cell), times the rate of its host's length (between
    the classes' centres, clipped to 0 to 8), times that of its host's sense (1 for others); 0 beyond farthest."""
    by_length = interpolated(F.col("log_len"), length_at, [min(8.0, max(0.0, r)) for r in length_rates])
    by_sense = F.lit(1.0)
    for code, rate in sense_rates.items():
        by_sense = F.when(F.col("sense") == code, float(rate)).otherwise(by_sense)
    p = F.when(F.col("d") > farthest, 0.0).otherwise(F.col(value)) * by_length * by_sense
    return cells.withColumn("intensity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))

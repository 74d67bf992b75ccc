"""Scalar expressions of the gridded analytics as Column functions, and their registration as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bounds of a half width in cells.
WIDTH_BOUNDS = (2.0, 60.0)


def kernel(d: Column, radius: float = 3.0) -> Column:
    return F.greatest(1 - d / radius, F.lit(0.0))


def strike_of_spin(sin2: Column, cos2: Column) -> Column:
    """The strike whose doubled angle has this sine and cosine."""
    return F.pmod(F.degrees(F.atan2(sin2, cos2)) / 2, F.lit(180.0))


def off_flank(d: Column, flank: float) -> Column:
    """Strictly beyond the flank of a trace."""
    return d > flank


def half_width(length: Column, gamma: float, log_w0: float, l0: float = 40.0) -> Column:
    """A power law of length, clipped to WIDTH_BOUNDS; lengths below 1 count as 1."""
    law = F.exp(F.lit(log_w0)) * F.pow(F.greatest(length, F.lit(1.0)) / l0, F.lit(gamma))
    return F.greatest(F.lit(WIDTH_BOUNDS[0]), F.least(F.lit(WIDTH_BOUNDS[1]), law))


def scrubbed(value: Column, fill: Column, limit: float = 1e18) -> Column:
    """value, or fill where it is null, not finite or a sentinel beyond limit."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) > limit), fill).otherwise(value)


def canonical_prior(value: Column) -> Column:
    """value in [0, 1], 0 for anything else."""
    return F.when(value.isNull() | F.isnan(value) | (value < 0) | (value > 1), 0.0).otherwise(value)


def consensus_plane(*planes: Column) -> Column:
    """The greatest of several planes."""
    return F.greatest(*planes)


def width_feature(d_perp: Column, length: Column) -> Column:
    return d_perp / F.sqrt(1 + length)


def length_weight(length: Column) -> Column:
    return F.sqrt(length)


def implied_credit(dti: Column, dots: Column, truths: Column) -> Column:
    """The covered credit that an index, a number of dots and a number of truth cells imply."""
    return dti * (0.2 * dots + 0.8 * truths)


def allowed_sources(names: list[str], prefixes: tuple[str, ...] = ("catalogue:", "ingenious:")) -> None:
    """Raise unless every predictor comes from an allowed source."""
    bad = [n for n in names if not n.startswith(prefixes)]
    if bad:
        raise ValueError("predictors of other sources: " + ", ".join(sorted(bad)))


#: SQL functions: name, parameters, body.
SQL_FUNCTIONS = [
    ("grid_kernel", "d DOUBLE, radius DOUBLE", "greatest(1 - d / radius, 0D)"),
    ("grid_azimuth", "dr DOUBLE, dc DOUBLE", "pmod(degrees(atan2(dc, -dr)), 180D)"),
    ("axial_difference", "a DOUBLE, b DOUBLE", "least(pmod(abs(a - b), 180D), 180D - pmod(abs(a - b), 180D))"),
    ("along_strike", "dr DOUBLE, dc DOUBLE, strike DOUBLE", "dc * sin(radians(strike)) - dr * cos(radians(strike))"),
    ("across_strike", "dr DOUBLE, dc DOUBLE, strike DOUBLE", "-(dc * cos(radians(strike)) + dr * sin(radians(strike)))"),
    ("strike_of_spin", "s DOUBLE, c DOUBLE", "pmod(degrees(atan2(s, c)) / 2, 180D)"),
    ("signed_obliquity", "ray DOUBLE, strike DOUBLE", "coalesce(pmod(ray - strike + 90, 180D) - 90, 0D)"),
    ("dti", "tp DOUBLE, fp DOUBLE, fn DOUBLE", "tp / (tp + 0.2D * fp + 0.8D * fn + 1e-12D)"),
]


def register(spark: SparkSession) -> None:
    """Make SQL_FUNCTIONS available to spark.sql in this session."""
    for name, parameters, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {body}")

"""Fits and tests: non-negative least squares with each row left out, and the p-value of a rank correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nonnegative(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The x >= 0 that minimises x'Qx / 2 - c'x, by an active set: the variable of steepest descent is freed, and those that the
    free solution would make negative are bound again, where they are met on the way to it."""
    n = len(c)
    x, free = np.zeros(n), np.zeros(n, bool)
    slack = 1e-10 * max(1.0, float(np.abs(c).max(initial=0.0)))
    for _ in range(30 * n + 1):
        descent = np.where(free, -np.inf, c - q @ x)
        if not n or descent.max() <= slack:
            break
        free[descent.argmax()] = True
        while free.any():
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(q[np.ix_(free, free)], c[free], rcond=None)[0]
            bad = free & (z <= 0)
            if not bad.any():
                x = z
                break
            step = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-14 * max(1.0, float(np.abs(x).max()))
            x = np.where(free, x, 0.0)
    return x


def nonnegative_fit(rows: DataFrame, key: str, columns: list[str], target: str, weight: str) -> DataFrame:
    """key, fitted, left_out and weights: rows' totals fitted as non-negative combinations of columns, by weighted least squares over
    all rows; the prediction of each row's total by the fit without it; and the weights of the fit over all rows.

    The normal equations are one aggregate over all rows, of len(columns)^2 sums. A row's own share is taken off it to leave it
    out, so no row needs the others, and rows are solved where they lie. Rows with a null have no part and no result.
    """
    some = rows.dropna(subset=[*columns, target, weight]).select(key, *[F.col(c).cast("double").alias(c) for c in (*columns, target, weight)])
    w2 = F.col(weight) * F.col(weight)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = [F.sum(w2 * F.col(a) * F.col(b)) for a, b in pairs] + [F.sum(w2 * F.col(a) * F.col(target)) for a in columns]
    total = some.agg(F.array(*sums).alias("_sums"))
    n = len(columns)
    upper = np.triu_indices(n)

    def solve(sums: np.ndarray) -> np.ndarray:
        q = np.zeros((n, n))
        q[upper] = sums[: len(pairs)]
        return nonnegative(q + np.triu(q, 1).T, sums[len(pairs) :])

    def run(batches):
        whole = None
        for pdf in batches:
            x, b, w = pdf[columns].to_numpy(float), pdf[target].to_numpy(float), pdf[weight].to_numpy(float)
            fitted, left = [], []
            for i in range(len(pdf)):
                sums = np.asarray(pdf["_sums"].iloc[i], float)
                whole = solve(sums) if whole is None else whole
                own = np.concatenate([w[i] ** 2 * np.outer(x[i], x[i])[upper], w[i] ** 2 * x[i] * b[i]])
                fitted.append(float(x[i] @ whole))
                left.append(float(x[i] @ solve(sums - own)))
            yield pd.DataFrame({key: pdf[key], "fitted": fitted, "left_out": left, "weights": [whole.tolist()] * len(pdf)})

    kind = some.schema[key].dataType.simpleString()
    # one row of len(columns)^2 sums
    return some.join(F.broadcast(total)).mapInPandas(run, f"{key} {kind}, fitted double, left_out double, weights array<double>")


def rank_p_value(rho: Column, n: Column) -> Column:
    """The two-sided p-value of a rank correlation of n pairs: Student's t with n - 2 degrees of freedom, as its finite series in the
    cosine of atan(t / sqrt(n - 2)). Null for fewer than three pairs or a null rho; 0 where |rho| is 1."""
    df = (n - 2).cast("int")
    r2 = rho * rho
    # t / sqrt(df) = rho / sqrt(1 - rho^2), so the angle's sine is |rho| and its squared cosine 1 - rho^2
    c2, sine = F.greatest(1 - r2, F.lit(0.0)), F.abs(rho)
    odd = df % 2 == 1
    # odd: 1 + 2/3 c2 + 2*4/(3*5) c2^2 + ..., (df - 1) / 2 terms; even: 1 + 1/2 c2 + 1*3/(2*4) c2^2 + ..., df / 2 terms
    terms = F.floor(df / 2).cast("int")
    top = lambda k: F.when(odd, 2 * k).otherwise(2 * k - 1)
    series = F.aggregate(
        F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, k: F.struct((s["term"] * c2 * top(k) / (top(k) + 1)).alias("term"), (s["sum"] + s["term"] * c2 * top(k) / (top(k) + 1)).alias("sum")),
        lambda s: s["sum"],
    )
    inside = F.when(odd, 2 / F.lit(np.pi) * (F.asin(F.least(sine, F.lit(1.0))) + F.when(df > 1, sine * F.sqrt(c2) * series).otherwise(0.0))).otherwise(sine * series)
    p = F.when(sine >= 1, 0.0).otherwise(F.greatest(1 - inside, F.lit(0.0)))
    return F.when((n >= 3) & rho.isNotNull(), p)

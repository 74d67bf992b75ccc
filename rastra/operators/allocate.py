"""Dot budgets: stable top-k, tile-decimated ranking, prefixes, quotas, and the marginal-gain pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.operators.stencil import ALPHA, BETA, kernel_offsets


def _by_value(value: str) -> list[Column | str]:
    return [F.desc(value), "row", "col"]


def top_cells(cells: DataFrame, k: int, value: str = "value") -> DataFrame:
    """The k cells of greatest value; ties row by row."""
    return cells.orderBy(*_by_value(value)).limit(k)


def tile_best(cells: DataFrame, tile: int, value: str = "value") -> DataFrame:
    """tile_row, tile_col, row, col, value: the best cell of each tile; ties to the first in the tile."""
    at = [(F.col(c) / tile).cast("int").alias(f"tile_{c}") for c in ("row", "col")]
    least = F.max(F.struct(F.col(value).alias("value"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("m")
    best = cells.groupBy(*at).agg(least)  # an aggregate combines before the shuffle, a window would not
    return best.select("tile_row", "tile_col", (-F.col("m.r")).alias("row"), (-F.col("m.c")).alias("col"), F.col("m.value").alias("value"))


def decimated_ranking(cells: DataFrame, tile: int, budget: int, value: str = "value") -> DataFrame:
    """row, col, value, rank of the `budget` best tiles: the rank is wanted, and no more rows than the budget get one."""
    best = tile_best(cells, tile, value).orderBy(F.desc("value"), "tile_row", "tile_col").limit(budget)
    w = Window.orderBy(F.desc("value"), "tile_row", "tile_col")
    return best.select("row", "col", "value", F.row_number().over(w).alias("rank"))


def prefix_to_mass(items: DataFrame, key: str, size: str, target: float, seed: int) -> DataFrame:
    """Items in hash order until their sizes reach target; the one that reaches it is included.

    The running sum is taken within ranges of the hash (its first three digits); only the 4096 ranges' totals are summed in
    one place, so the window holds at any number of items.
    """
    hashed = items.select(key, size).withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("_b", F.left("_h", F.lit(3)))
    totals = hashed.groupBy("_b").agg(F.sum(size).alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start")).where(F.col("_start") < target)
    within = Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most 4096 rows of two columns
    run = hashed.join(F.broadcast(starts), "_b").withColumn("_run", F.col("_start") + F.sum(size).over(within))
    return run.where(F.col("_run") - F.col(size) < target).select(key, size)


def quotas(shares: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """key, quota: largest remainders; ties by key. Strata are few: a fixed table of classes."""
    all_ = shares.agg(F.sum(weight).alias("_w"))
    exact = F.col(weight) / F.col("_w") * total
    parts = shares.join(F.broadcast(all_)).select(key, F.floor(exact).alias("_f"), F.round(exact - F.floor(exact), 9).alias("_r"))
    w = Window.orderBy(F.desc("_r"), key)
    left = F.lit(total) - F.sum("_f").over(Window.partitionBy())
    return parts.select(key, (F.col("_f") + F.when(F.row_number().over(w) <= left, 1).otherwise(0)).alias("quota"))


def budget_curve(ranked: DataFrame, budgets: list[int]) -> DataFrame:
    """budget, n, mass: nested prefixes of a ranking, from one pass with conditional sums."""
    spark = ranked.sparkSession
    steps = spark.createDataFrame([(b,) for b in budgets], "budget int")
    out = ranked.join(F.broadcast(steps), F.col("rank") <= F.col("budget"))
    return out.groupBy("budget").agg(F.count("*").alias("n"), F.sum("value").alias("mass"))


def marginal_pass(cells: DataFrame, fold: str, n_truth: float, patience: int = 0, cap: int | None = None, floor: float = 0.0) -> DataFrame:
    """fold, row, col, rank: per fold, cells by descending expected credit are accepted while they raise the expected index.

    cells: fold, row, col, value (probability, 0 where there is credit alone) and credit (its kernel sum); cells of less credit
    than floor are no candidates. Acceptance depends on all dots before it, so a fold is one group of a grid of fixed size;
    `cap` is the budget of dots, if there is one. Without patience the first rejection after the first dot ends the pass, else
    so many in a row.
    """
    offs = kernel_offsets()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[fold].iloc[0]
        pdf = pdf.sort_values(["credit", "row", "col"], ascending=[False, True, True], kind="stable")
        p = {(r, c): v for r, c, v in zip(pdf["row"], pdf["col"], pdf["value"])}
        covered: dict[tuple[int, int], float] = {}
        t = m = 0.0
        out, misses = [], 0
        pdf = pdf[pdf["credit"] >= floor]
        for r, c, own in zip(pdf["row"], pdf["col"], pdf["credit"]):
            gain = sum(p.get((r + a, c + b), 0.0) * max(0.0, k - covered.get((r + a, c + b), 0.0)) for a, b, k in offs)
            own = min(1.0, own)
            before = t / (ALPHA * (t + len(out) - m) + BETA * n_truth + 1e-12)
            after = (t + gain) / (ALPHA * (t + gain + len(out) + 1 - m - own) + BETA * n_truth + 1e-12)
            if (gain <= 0.0) if not out else (after <= before):
                misses += bool(out)
                if misses >= max(1, patience):
                    break
                continue
            misses, t, m = 0, t + gain, m + own
            for a, b, k in offs:
                covered[(r + a, c + b)] = max(k, covered.get((r + a, c + b), 0.0))
            out.append((r, c))
            if cap is not None and len(out) >= cap:
                break
        rows = np.array(out, dtype="int64").reshape(-1, 2)
        return pd.DataFrame({fold: name, "row": rows[:, 0], "col": rows[:, 1], "rank": np.arange(1, len(rows) + 1)})

    kind = cells.schema[fold].dataType.simpleString()
    return cells.select(fold, "row", "col", "value", "credit").groupBy(fold).applyInPandas(run, f"{fold} {kind}, row int, col int, rank int")


def greedy_rounds(
    cells: DataFrame, fold: str, n_truth: float, floor: float = 0.02, cap: int | None = None, per_round: int = 20_000, max_rounds: int = 400,
) -> DataFrame:
    """fold, row, col, rank, round: per fold, cells are accepted while their marginal credit pays the bar c * (1 - own credit),
    c = a / (1 - a), a = alpha * index, which moves with every acceptance.

    cells: fold, row, col, value (probability) and credit (its kernel sum), as in marginal_pass. A round visits, by falling credit,
    the open candidates whose last known marginal credit still exceeds the bar. One that is visited is settled until a dot comes
    within two kernel radii of it, which opens all of that window again. A round that accepts nothing ends the fold. The bar
    depends on all dots of the fold, so a fold is one group of a grid of fixed size, held as small arrays.
    """
    offs = kernel_offsets()
    reach = max(abs(a) for a, *_ in offs)
    weights = np.zeros((2 * reach + 1, 2 * reach + 1))
    for a, b, k in offs:
        weights[a + reach, b + reach] = k

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, pad = pdf[fold].iloc[0], 2 * reach
        row, col = (pdf[c].to_numpy() - pdf[c].min() + pad for c in ("row", "col"))
        shape = (row.max() + pad + 1, col.max() + pad + 1)
        p, cover, which = np.zeros(shape), np.zeros(shape), np.full(shape, -1)
        p[row, col] = pdf["value"].to_numpy()
        ranked = pdf.assign(_r=row, _c=col)[pdf["credit"] >= floor].sort_values(["credit", "row", "col"], ascending=[False, True, True], kind="stable")
        y, x, upper = ranked["_r"].to_numpy(), ranked["_c"].to_numpy(), ranked["credit"].to_numpy(float).copy()
        which[y, x] = np.arange(len(y))
        own, open_, taken = np.minimum(upper, 1.0), np.ones(len(y), bool), np.zeros(len(y), bool)
        t = m = 0.0
        out: list[tuple[int, int]] = []
        for turn in range(1, max_rounds + 1):
            a = ALPHA * (t / (ALPHA * (t + len(out) - m) + BETA * n_truth + 1e-12))
            visit = np.flatnonzero(open_ & (upper > a / (1 - a) * (1 - own)))[:per_round] if a < 1 else ()
            before = len(out)
            for i in visit:
                if a >= 1 or (cap is not None and len(out) >= cap):
                    break
                open_[i] = False
                if taken[i]:
                    continue
                near = (slice(y[i] - reach, y[i] + reach + 1), slice(x[i] - reach, x[i] + reach + 1))
                upper[i] = gain = (p[near] * np.maximum(weights - cover[near], 0.0)).sum()
                if gain <= a / (1 - a) * (1 - own[i]):
                    continue
                taken[i], t, m = True, t + gain, m + own[i]
                out.append((int(i), turn))
                np.maximum(cover[near], weights, out=cover[near])
                window = which[y[i] - pad : y[i] + pad + 1, x[i] - pad : x[i] + pad + 1]
                open_[window[window >= 0]] = True
                open_[i] = False
                a = ALPHA * (t / (ALPHA * (t + len(out) - m) + BETA * n_truth + 1e-12))
            if len(out) == before:
                break
        at = ranked.iloc[[i for i, _ in out]]
        return pd.DataFrame({fold: name, "row": at["row"].to_numpy(), "col": at["col"].to_numpy(), "rank": np.arange(1, len(out) + 1), "round": [turn for _, turn in out]})

    kind = cells.schema[fold].dataType.simpleString()
    return cells.select(fold, "row", "col", "value", "credit").groupBy(fold).applyInPandas(run, f"{fold} {kind}, row int, col int, rank int, round int")


def exclusion_sweep(cells: DataFrame, radii: list[float], n_truth: float, patience: int) -> DataFrame:
    """radius, row, col, rank: marginal_pass once for each radius, over the cells of more than that distance d. cells: row, col, value,
    credit and d; nearer cells still hold probability that dots beside them cover. The radii are groups side by side."""
    swept = cells.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    open_ = F.when(F.col("d") > F.col("radius"), F.col("credit")).otherwise(-1.0)
    return marginal_pass(swept.withColumn("credit", open_), "radius", n_truth, patience)


def zone_limits(cells: DataFrame, fold: str, label: str, d: str, cap: int, quantile: float = 0.9) -> DataFrame:
    """fold, zone, fraction, cap, base_rate, n_expected: what the other folds say of a fold. The zone is a quantile of their positive
    cells' distance, fraction the share of these inside it, by which the cap is cut (1 at least); n_expected is their base rate
    times the fold's cells. Without a positive cell elsewhere zone and fraction are null and the cap is 1."""
    folds = cells.groupBy(F.col(fold).alias("_f")).agg(F.count("*").alias("_n"))
    others = cells.select(fold, d, F.col(label).alias("_y")).join(F.broadcast(folds), F.col(fold) != F.col("_f"))  # a row for each fold
    hit = F.when(F.col("_y") == 1, F.col(d))
    zones = others.groupBy("_f", "_n").agg(F.percentile(hit, quantile).alias("zone"), F.avg("_y").alias("base_rate"))
    inside = others.where("_y = 1").join(F.broadcast(zones.select("_f", "zone")), "_f").groupBy("_f").agg(F.avg((F.col(d) <= F.col("zone")).cast("double")).alias("fraction"))
    out = zones.join(inside, "_f", "left")
    share = F.greatest(F.lit(1), F.floor(cap * F.coalesce("fraction", F.lit(0.0)))).cast("long")
    return out.select(F.col("_f").alias(fold), "zone", "fraction", share.alias("cap"), "base_rate", (F.col("base_rate") * F.col("_n")).alias("n_expected"))


def stratified_fill(cells: DataFrame, stratum: str, quota: DataFrame, gap: float) -> DataFrame:
    """stratum, row, col, value: what filling the strata one after the other (in their order) chooses: within a stratum cells by
    falling value, ties row by row, none within a closed radius of one chosen before, until the stratum's quota is met.

    quota: stratum, quota; a stratum without one gets no cell. All strata are filled at once. In a round the first open cells of
    a stratum, as many as it lacks, can be told apart from those that its quota may cut off: whatever becomes of the others, they
    are within it. Those of them that no open cell within the radius comes before are chosen and close their neighbours; a
    stratum whose quota is met closes. The first open cell of the whole order is always chosen, so every round gets on.
    """
    from rastra.operators.stencil import disk_offsets, spread
    from rastra.storage import drop_staged, stage_table

    need = quota.select(F.col(stratum).alias("_s"), F.col("quota").cast("long").alias("_need")).where("_need > 0")
    rows = cells.select(stratum, "row", "col", "value").join(need, F.col(stratum) == F.col("_s")).drop("_s")
    open_ = stage_table(rows.withColumn("_got", F.lit(0).cast("long")), "open")
    around, order = [o for o in disk_offsets(gap) if o != (0, 0)], F.struct(F.col(stratum).alias("s"), (-F.col("value")).alias("v"), F.col("row").alias("r"), F.col("col").alias("c"))
    chosen: list[DataFrame] = []
    while not open_.isEmpty():
        first = F.row_number().over(Window.partitionBy(stratum).orderBy(F.desc("value"), "row", "col"))
        sure = open_.withColumn("_k", first).where(F.col("_k") <= F.col("_need") - F.col("_got")).drop("_k")
        earlier = spread(open_.select("row", "col", order.alias("_o")), around).groupBy("row", "col").agg(F.min("_o").alias("_o"))
        tops = stage_table(sure.join(earlier, ["row", "col"], "left").where(F.col("_o").isNull() | (order < F.col("_o"))).drop("_o"), "tops")
        chosen.append(tops.select(stratum, "row", "col", "value"))
        got = tops.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_more"))
        taken = spread(tops.select("row", "col"), disk_offsets(gap)).select("row", "col").distinct()
        rest = open_.join(taken, ["row", "col"], "left_anti").join(got, F.col(stratum) == F.col("_s"), "left").drop("_s")
        rest = rest.withColumn("_got", F.col("_got") + F.coalesce("_more", F.lit(0))).drop("_more").where("_got < _need")
        after = stage_table(rest, "open")
        drop_staged(open_)
        open_ = after
    out = cells.sparkSession.createDataFrame([], rows.select(stratum, "row", "col", "value").schema)
    for tops in chosen:
        out = out.unionByName(tops)
    return out


def spaced(cells: DataFrame, gap: float) -> DataFrame:
    """row, col, value: cells by falling value (ties row by row), none within a closed radius of one chosen before.

    Rounds over the whole layer at once: a cell is chosen when no open cell within the radius comes before it, and its
    neighbours close; the result is that of one cell after the other.
    """
    from rastra.operators.stencil import disk_offsets, spread
    from rastra.storage import stage_table

    open_ = stage_table(cells.select("row", "col", "value"), "open")
    around = [o for o in disk_offsets(gap) if o != (0, 0)]
    order = F.struct(F.col("value"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))
    chosen = open_.limit(0)
    while not open_.isEmpty():
        best = spread(open_.withColumn("_o", order).select("row", "col", "_o"), around).groupBy("row", "col").agg(F.max("_o").alias("_o"))
        tops = stage_table(open_.join(best, ["row", "col"], "left").where(F.col("_o").isNull() | (F.col("_o") < order)).drop("_o"), "tops")
        chosen = chosen.unionByName(tops)
        taken = spread(tops.select("row", "col"), disk_offsets(gap)).select("row", "col").distinct()
        open_ = stage_table(open_.join(taken, ["row", "col"], "left_anti"), "open")
    return chosen


def candidates(cells: DataFrame, floor: float, cap: int | None = None, value: str = "credit") -> DataFrame:
    """The cells of at least `floor`: all of them, or the cap best, where a pass has a budget."""
    open_ = cells.where(F.col(value) >= floor)
    return open_ if cap is None else top_cells(open_, cap, value)

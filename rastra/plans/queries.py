"""The registered queries of the gridded analytics and their SQL, side by side.

Spark and SQL compute the same thing by different means: hash joins through offsets here, range joins there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastra.grid import EVENT_GRID, LAYER_GRID, cells_in, event_cells, event_roles, layer_cells, mask_of, order_traces, table
from rastra.operators import allocate, components, features, masks, metric, nearest, profiles, registry, split, stats, stencil, tensor, validate, vector
from rastra.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_EVENTS = """
ev AS (SELECT event_type AS layer, ((epoch_us(ts) - 1704067200000000) // 3600000000)::INTEGER AS r, (user_id % 256)::INTEGER AS c,
              max(least(1.0, value / 500)) AS v FROM events GROUP BY ALL),
err AS (SELECT r, c FROM ev WHERE layer = 'error'),
truth AS (SELECT r, c FROM ev WHERE layer = 'purchase' AND NOT EXISTS (SELECT 1 FROM err WHERE err.r = ev.r AND err.c = ev.c)),
pred AS (SELECT r, c, v FROM ev WHERE layer = 'click' AND NOT EXISTS (SELECT 1 FROM err WHERE err.r = ev.r AND err.c = ev.c)),
buy AS (SELECT r, c FROM ev WHERE layer = 'purchase'), click AS (SELECT r, c, v FROM ev WHERE layer = 'click'),
near AS (SELECT t.r AS tr, t.c AS tc, p.r AS pr, p.c AS pc, p.v, 1 - sqrt((t.r - p.r) ** 2 + (t.c - p.c) ** 2) / 3.0 AS k
         FROM truth t JOIN pred p ON p.r BETWEEN t.r - 3 AND t.r + 3 AND p.c BETWEEN t.c - 3 AND t.c + 3
         WHERE (t.r - p.r) ** 2 + (t.c - p.c) ** 2 < 9),
tcredit AS (SELECT t.r, t.c, coalesce(max(v * k), 0) AS credit FROM truth t LEFT JOIN near ON tr = t.r AND tc = t.c GROUP BY ALL),
pcredit AS (SELECT p.r, p.c, p.v, coalesce(max(k), 0) AS q FROM pred p LEFT JOIN near ON pr = p.r AND pc = p.c GROUP BY ALL)"""
_LAYERS = """
ly AS (SELECT (l_suppkey % 16)::INTEGER AS layer, (datediff('day', DATE '1995-01-01', l_shipdate::DATE) // 7)::INTEGER AS r, (l_partkey % 128)::INTEGER AS c,
              max(least(1.0, 10 * l_discount)) AS v FROM lineitem GROUP BY ALL),
cand AS (SELECT r, c FROM ly WHERE layer = 0 AND v >= 1.0), reg AS (SELECT layer, r, c FROM ly WHERE layer <> 0 AND v >= 1.0),
hit AS (SELECT DISTINCT layer, cand.r, cand.c FROM cand JOIN reg ON reg.r BETWEEN cand.r - 3 AND cand.r + 3 AND reg.c BETWEEN cand.c - 3 AND cand.c + 3
        WHERE (cand.r - reg.r) ** 2 + (cand.c - reg.c) ** 2 <= 9)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def r6(column: Column | str) -> Column:
    """Rounded for comparison; -0.0 becomes 0.0."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells = layer_cells(spark, sf_dir).where("value >= 1.0")
    return mask_of(cells, 0), cells.where("layer <> 0").select("layer", "row", "col")


# --- metric ---


@query("grid_metric", f"""WITH {_EVENTS}, s AS (SELECT (SELECT count(*) FROM tcredit) AS n_truth, (SELECT coalesce(sum(credit), 0) FROM tcredit) AS tp,
  (SELECT coalesce(sum(v * (1 - q)), 0) FROM pcredit) AS fp)
SELECT n_truth, round(tp, 6) AS tp, round(fp, 6) AS fp, round(n_truth - tp, 6) AS fn, round(tp / (tp + 0.2 * fp + 0.8 * (n_truth - tp) + 1e-12), 6) AS dti FROM s""")
def grid_metric(spark, sf_dir):
    return metric.score(*event_roles(spark, sf_dir)).select("n_truth", *[r6(c).alias(c) for c in ("tp", "fp", "fn", "dti")])


@query("binary_metric", f"""WITH {_EVENTS}, s AS (SELECT (SELECT count(*) FROM truth) AS n_truth,
  (SELECT coalesce(sum(k), 0) FROM (SELECT max(k) AS k FROM near GROUP BY tr, tc)) AS tp, (SELECT coalesce(sum(1 - q), 0) FROM pcredit) AS fp)
SELECT n_truth, round(tp, 6) AS tp, round(fp, 6) AS fp, round(tp / (tp + 0.2 * fp + 0.8 * (n_truth - tp) + 1e-12), 6) AS dti FROM s""")
def binary_metric(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    return metric.score(truth, prediction.withColumn("value", F.lit(1.0))).select("n_truth", *[r6(c).alias(c) for c in ("tp", "fp", "dti")])


_TERMS = f"""{_EVENTS}, terms AS (SELECT br, bc, sum(tp) AS tp, sum(fp) AS fp, sum(n) - sum(tp) AS fn, sum(n)::BIGINT AS n_truth FROM (
  SELECT r // 48 AS br, c // 64 AS bc, credit AS tp, 0.0 AS fp, 1 AS n FROM tcredit UNION ALL SELECT r // 48, c // 64, 0.0, v * (1 - q), 0 FROM pcredit)
  GROUP BY ALL)"""


def _terms(spark, sf_dir):
    t, p = event_roles(spark, sf_dir)
    out = metric.block_terms(t, p, 16).withColumns({"br": (F.col("block_row") / 3).cast("int"), "bc": (F.col("block_col") / 4).cast("int")})
    return out.groupBy("br", "bc").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n_truth")])


@query("block_terms", f"WITH {_TERMS} SELECT br, bc, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, n_truth FROM terms")
def block_terms(spark, sf_dir):
    return _terms(spark, sf_dir).select("br", "bc", *[r6(c).alias(c) for c in ("tp", "fp", "fn")], "n_truth")


@query("jackknife", f"""WITH {_TERMS}, g AS (SELECT br, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM terms GROUP BY br), a AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM g)
SELECT br, round((a.tp - g.tp) / ((a.tp - g.tp) + 0.2 * (a.fp - g.fp) + 0.8 * (a.fn - g.fn) + 1e-12), 6) AS dti FROM g, a""")
def jackknife(spark, sf_dir):
    return metric.jackknife(_terms(spark, sf_dir), "br").select("br", r6("dti").alias("dti"))


@query("bootstrap", f"""WITH {_TERMS}, b AS (SELECT br * 4 + bc AS block_id, tp, fp, fn FROM terms), n AS (SELECT count(*) AS n FROM b),
k AS (SELECT block_id, row_number() OVER (ORDER BY block_id) - 1 AS i, tp, fp, fn FROM b),
picks AS (SELECT d.range AS draw, ('0x' || substr(md5(d.range || ':' || i.range || ':1'), 1, 8))::BIGINT % (SELECT n FROM n) AS pick
  FROM range(200) d, range((SELECT n FROM n)) i),
s AS (SELECT draw, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM picks JOIN k ON pick = k.i GROUP BY draw)
SELECT draw, round(tp / (tp + 0.2 * fp + 0.8 * fn + 1e-12), 6) AS dti FROM s""")
def bootstrap(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    ids = terms.withColumn("block_id", F.row_number().over(Window.orderBy("br", "bc")) - 1)  # blocks of a fixed grid
    return metric.bootstrap(ids, 200).select("draw", r6("dti").alias("dti"))


@query("wilson", f"""WITH {_EVENTS}, s AS (SELECT r // 72 AS decade, sum((q > 0)::INTEGER) AS k, count(*) AS n FROM pcredit GROUP BY ALL), z AS (SELECT *, k / n AS p, 1.959963985 AS z FROM s),
w AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM z)
SELECT decade, round(greatest(0, m - h), 6) AS low, round(least(1, m + h), 6) AS high FROM w""")
def wilson(spark, sf_dir):
    _, p = metric.credits(*event_roles(spark, sf_dir))
    s = p.groupBy((F.col("row") / 72).cast("int").alias("decade")).agg(F.sum((F.col("q") > 0).cast("int")).alias("k"), F.count("*").alias("n"))
    low, high = metric.wilson(F.col("k"), F.col("n"))
    return s.select("decade", r6(low).alias("low"), r6(high).alias("high"))


@query("kernel_offsets", """SELECT dr::INTEGER AS dr, dc::INTEGER AS dc, round(1 - sqrt(dr ** 2 + dc ** 2) / 3.0, 6) AS k FROM range(-3, 4) a(dr), range(-3, 4) b(dc) WHERE dr ** 2 + dc ** 2 < 9""")
def kernel_offsets(spark, sf_dir):
    return spark.createDataFrame(stencil.kernel_offsets(), "dr int, dc int, k double").select("dr", "dc", r6("k").alias("k"))


# --- masks and stencils ---


@query("mask_and", f'WITH {_EVENTS} SELECT r AS "row", c AS col FROM buy WHERE EXISTS (SELECT 1 FROM click WHERE click.r = buy.r AND click.c = buy.c)')
def mask_and(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    return masks.mask_and(mask_of(e, "purchase"), mask_of(e, "click"))


@query("mask_and_not", f'WITH {_EVENTS} SELECT r AS "row", c AS col FROM truth')
def mask_and_not(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    return masks.mask_and_not(mask_of(e, "purchase"), mask_of(e, "error"))


@query("mask_or", f'WITH {_EVENTS} SELECT r AS "row", c AS col FROM buy UNION SELECT r, c FROM click UNION SELECT r, c FROM err')
def mask_or(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    return masks.mask_or(*[mask_of(e, x) for x in ("purchase", "click", "error")])


@query("block_max", f'WITH {_EVENTS} SELECT r // 8 AS "row", c // 8 AS col, round(max(v), 6) AS "value" FROM click GROUP BY ALL')
def block_max(spark, sf_dir):
    return masks.block_max(event_cells(spark, sf_dir).where("layer = 'click'"), 8).select("row", "col", r6("value").alias("value"))


def _around(inside: str, reach: int, weight: str = "1") -> str:
    """Neighbour pairs of buy: (r, c) the cell reached, (sr, sc) its source."""
    span = f"range(-{reach}, {reach + 1})"
    return f"reach AS (SELECT b.r + dr AS r, b.c + dc AS c, b.r AS sr, b.c AS sc, {weight} AS k FROM buy b, {span} x(dr), {span} y(dc) WHERE {inside})"


_ON_GRID = "r BETWEEN 0 AND 719 AND c BETWEEN 0 AND 255"


@query("dilate_diamond", f'WITH {_EVENTS}, {_around("abs(dr) + abs(dc) <= 2", 2)} SELECT DISTINCT r::INTEGER AS "row", c::INTEGER AS col FROM reach WHERE {_ON_GRID}')
def dilate_diamond(spark, sf_dir):
    return stencil.dilate(mask_of(event_cells(spark, sf_dir), "purchase"), stencil.diamond_offsets(2), EVENT_GRID)


@query("dilate_disk", f'WITH {_EVENTS}, {_around("dr * dr + dc * dc <= 9", 3)} SELECT DISTINCT r::INTEGER AS "row", c::INTEGER AS col FROM reach WHERE {_ON_GRID}')
def dilate_disk(spark, sf_dir):
    return stencil.dilate(mask_of(event_cells(spark, sf_dir), "purchase"), stencil.disk_offsets(3), EVENT_GRID)


@query("erode_diamond", f"""WITH {_EVENTS}, {_around("dr * dr + dc * dc <= 9", 3)}, big AS (SELECT DISTINCT r, c FROM reach WHERE {_ON_GRID})
SELECT b.r::INTEGER AS "row", b.c::INTEGER AS col FROM big b JOIN big n ON abs(n.r - b.r) + abs(n.c - b.c) <= 1 GROUP BY ALL HAVING count(*) = 5""")
def erode_diamond(spark, sf_dir):
    return stencil.erode(dilate_disk(spark, sf_dir), stencil.diamond_offsets(1), EVENT_GRID)


_EIGHT = _around("(dr <> 0 OR dc <> 0)", 1)
_COUNTED = "counted AS (SELECT b.r, b.c, count(reach.sr) AS n FROM buy b LEFT JOIN reach ON reach.r = b.r AND reach.c = b.c GROUP BY ALL)"


@query("junctions", f'WITH {_EVENTS}, {_EIGHT}, {_COUNTED} SELECT r AS "row", c AS col, n FROM counted WHERE n >= 3')
def junctions(spark, sf_dir):
    return stencil.junctions(mask_of(event_cells(spark, sf_dir), "purchase"))


@query("tips", f'WITH {_EVENTS}, {_EIGHT}, {_COUNTED} SELECT r AS "row", c AS col, n FROM counted WHERE n <= 1')
def tips(spark, sf_dir):
    return stencil.tips(mask_of(event_cells(spark, sf_dir), "purchase"))


@query("disc_density", f'WITH {_EVENTS}, {_around("dr * dr + dc * dc <= 25", 5)} SELECT r::INTEGER AS "row", c::INTEGER AS col, count(*) AS n FROM reach WHERE {_ON_GRID} GROUP BY ALL')
def disc_density(spark, sf_dir):
    return stencil.disc_density(mask_of(event_cells(spark, sf_dir), "purchase"), EVENT_GRID)


@query("expected_credit", f"""WITH {_EVENTS} SELECT (r + dr)::INTEGER AS "row", (c + dc)::INTEGER AS col, round(sum(v * (1 - sqrt(dr * dr + dc * dc) / 3.0)), 6) AS "value"
FROM click, range(-3, 4) x(dr), range(-3, 4) y(dc) WHERE dr * dr + dc * dc < 9 AND r + dr BETWEEN 0 AND 719 AND c + dc BETWEEN 0 AND 255 GROUP BY ALL""")
def expected_credit(spark, sf_dir):
    out = stencil.kernel_sum(event_cells(spark, sf_dir).where("layer = 'click'"), EVENT_GRID)
    return out.select("row", "col", r6("value").alias("value"))


# --- ranks and aggregates ---


def _features(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("y"), F.posexplode("embedding").alias("feature", "x"))
    return rows.select("vec_id", "feature", "y", F.round(F.col("x").cast("double"), 2).alias("x"))


_FEATURES = """f AS (SELECT vec_id, (unnest(generate_series(1, len(embedding))) - 1)::INTEGER AS feature, label % 2 AS y, round(unnest(embedding)::DOUBLE, 2) AS x FROM embeddings)"""
_RANKS = f"{_FEATURES}, rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rnk FROM f)"


@query("average_rank", f"WITH {_RANKS} SELECT vec_id, feature, rnk::DOUBLE AS \"rank\" FROM rk")
def average_rank(spark, sf_dir):
    return stats.average_rank(_features(spark, sf_dir), "x", ["feature"]).select("vec_id", "feature", F.col("rank").cast("double").alias("rank"))


@query("spearman", f"""WITH {_LAYERS}, p AS (SELECT a.layer, a.v AS x, b.v AS y FROM ly a JOIN ly b ON a.r = b.r AND a.c = b.c WHERE b.layer = 0 AND a.layer <> 0),
rk AS (SELECT layer, rank() OVER (PARTITION BY layer ORDER BY x) + (count(*) OVER (PARTITION BY layer, x) - 1) / 2 AS a,
              rank() OVER (PARTITION BY layer ORDER BY y) + (count(*) OVER (PARTITION BY layer, y) - 1) / 2 AS b FROM p)
SELECT layer, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS rho FROM rk GROUP BY layer""")
def spearman(spark, sf_dir):
    cells = layer_cells(spark, sf_dir)
    mine = cells.where("layer = 0").select("row", "col", F.col("value").alias("y"))
    pairs = cells.where("layer <> 0").join(mine, ["row", "col"])
    return stats.spearman(pairs, "value", "y", ["layer"]).select("layer", r6("rho").alias("rho"))


@query("auc_canary", f"""WITH {_RANKS}, s AS (SELECT feature, sum((y = 1)::INT) AS p, sum((y <> 1)::INT) AS q, sum(CASE WHEN y = 1 THEN rnk ELSE 0 END) AS w FROM rk GROUP BY feature),
a AS (SELECT *, (w - p * (p + 1) / 2) / (p * q) AS auc FROM s WHERE p >= 10 AND q >= 10)
SELECT feature, p::BIGINT AS n_pos, q::BIGINT AS n_neg, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS canary FROM a""")
def auc_canary(spark, sf_dir):
    return stats.auc(_features(spark, sf_dir), "x", "y", ["feature"]).select("feature", "n_pos", "n_neg", r6("auc").alias("auc"), r6("canary").alias("canary"))


@query("rank_to_byte", f"""WITH {_RANKS}, n AS (SELECT feature, count(*) AS n FROM f GROUP BY feature)
SELECT vec_id, feature, CASE WHEN n > 1 THEN round_even((rnk - 1) / (n - 1) * 254, 0) ELSE 0 END::INTEGER AS byte FROM rk JOIN n USING (feature)""")
def rank_to_byte(spark, sf_dir):
    return stats.rank_to_byte(_features(spark, sf_dir), "x", ["feature"]).select("vec_id", "feature", "byte")


@query("robust_z", f"""WITH {_FEATURES}, m AS (SELECT feature, quantile_cont(x, 0.5) AS med, stddev_pop(x) AS sd FROM f GROUP BY feature),
d AS (SELECT feature, quantile_cont(abs(x - med), 0.5) AS mad FROM f JOIN m USING (feature) GROUP BY feature),
s AS (SELECT vec_id, feature, x, med, CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END AS sc FROM f JOIN m USING (feature) JOIN d USING (feature))
SELECT vec_id, feature, round(CASE WHEN sc > 0 THEN greatest(-10, least(10, (x - med) / sc)) ELSE 0 END, 5) + 0.0 AS z FROM s""")
def robust_z(spark, sf_dir):
    out = stats.robust_z(_features(spark, sf_dir), "x", ["feature"])
    return out.select("vec_id", "feature", (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query("quantile_table", f"""WITH {_EVENTS} SELECT layer, count(*) AS n, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90 FROM ev GROUP BY layer""")
def quantile_table(spark, sf_dir):
    out = stats.quantile_table(event_cells(spark, sf_dir), "value", ["layer"], [0.1, 0.5, 0.9])
    return out.select("layer", "n", *[r6(c).alias(c) for c in ("p10", "p50", "p90")])


_EDGES = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


@query("enrichment", f"""WITH {_EVENTS}, m AS (SELECT v, (t.r IS NOT NULL)::INT AS y FROM click LEFT JOIN truth t ON t.r = click.r AND t.c = click.c),
b AS (SELECT CASE WHEN v >= 0.75 THEN 4 WHEN v >= 0.5 THEN 3 WHEN v >= 0.25 THEN 2 WHEN v >= 0.1 THEN 1 ELSE 0 END AS bin, y FROM m),
s AS (SELECT i::INTEGER AS bin, count(y) AS n_all, coalesce(sum(y), 0)::BIGINT AS n_pos FROM range(5) g(i) LEFT JOIN b ON b.bin = i GROUP BY i), t AS (SELECT sum(n_pos) / sum(n_all) AS base FROM s)
SELECT bin, n_all, n_pos, round(CASE WHEN n_all > 0 THEN n_pos / n_all ELSE 0 END, 6) AS rate, round(CASE WHEN n_all > 0 AND base > 0 THEN n_pos / n_all / base ELSE 0 END, 6) AS ratio FROM s, t""")
def enrichment(spark, sf_dir):
    truth, _ = event_roles(spark, sf_dir)
    click = event_cells(spark, sf_dir).where("layer = 'click'").join(truth.withColumn("y", F.lit(1)), ["row", "col"], "left").fillna(0, ["y"])
    return stats.enrichment(click, "value", "y", _EDGES).select("bin", "n_all", "n_pos", r6("rate").alias("rate"), r6("ratio").alias("ratio"))


@query("entropy", f"""WITH {_EVENTS}, q AS (SELECT layer, (r >= 360)::INT * 2 + (c >= 128)::INT AS q, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT layer, sum(n) AS a FROM q GROUP BY layer)
SELECT layer, round(-sum(n / a * ln(n / a)), 6) AS entropy FROM q JOIN t USING (layer) GROUP BY layer""")
def entropy(spark, sf_dir):
    cells = event_cells(spark, sf_dir).withColumn("q", (F.col("row") >= 360).cast("int") * 2 + (F.col("col") >= 128).cast("int"))
    return stats.entropy(cells, "q", ["layer"]).select("layer", r6("entropy").alias("entropy"))


@query("power_law", """WITH o AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), b AS (SELECT *, CASE WHEN x = 50 THEN 4 ELSE (x >= 10)::INT + (x >= 20)::INT + (x >= 30)::INT + (x >= 40)::INT END AS b FROM o WHERE x BETWEEN 1 AND 50 AND y > 0),
p AS (SELECT b, ln(avg(x)) AS u, ln(quantile_cont(y, 0.9)) AS v, count(*) AS w FROM b GROUP BY b HAVING count(*) >= 5),
s AS (SELECT sum(w) AS w, sum(w * u) AS wu, sum(w * v) AS wv, sum(w * u * u) AS wuu, sum(w * u * v) AS wuv FROM p), g AS (SELECT *, (w * wuv - wu * wv) / (w * wuu - wu * wu) AS gamma FROM s)
SELECT round(gamma, 5) AS gamma, round((wv - gamma * wu) / w, 5) AS log_scale FROM g""")
def power_law(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return stats.power_law(items, "x", "y", [1.0, 10.0, 20.0, 30.0, 40.0, 50.0]).select(F.round("gamma", 5).alias("gamma"), F.round("log_scale", 5).alias("log_scale"))


# --- nearest, components ---


@query("nearest_truth", f"""WITH {_EVENTS}, d AS (SELECT p.r, p.c, (p.r - t.r) ** 2 + (p.c - t.c) ** 2 AS d2, t.r AS tr, t.c AS tc FROM pred p, truth t)
SELECT r AS "row", c AS col, min(d2)::BIGINT AS d2, (arg_min(tr, (d2, tr, tc)))::INTEGER AS near_row, (arg_min(tc, (d2, tr, tc)))::INTEGER AS near_col FROM d GROUP BY r, c""")
def nearest_truth(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    return nearest.distance_transform(truth, EVENT_GRID).join(prediction.select("row", "col"), ["row", "col"])


@query("nearest_within", f"""WITH {_EVENTS}, d AS (SELECT p.r, p.c, (p.r - t.r) ** 2 + (p.c - t.c) ** 2 AS d2, t.r AS tr, t.c AS tc FROM pred p JOIN truth t
  ON t.r BETWEEN p.r - 6 AND p.r + 6 AND t.c BETWEEN p.c - 6 AND p.c + 6 WHERE (p.r - t.r) ** 2 + (p.c - t.c) ** 2 <= 36)
SELECT r AS "row", c AS col, min(d2)::BIGINT AS d2, (arg_min(tr, (d2, tr, tc)))::INTEGER AS near_row, (arg_min(tc, (d2, tr, tc)))::INTEGER AS near_col FROM d GROUP BY r, c""")
def nearest_within(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    return nearest.nearest_within(prediction.select("row", "col"), truth, 6)


_LABELS = f"""{_EVENTS}, lk AS (SELECT a.r * 256 + a.c AS a, b.r * 256 + b.c AS b FROM buy a JOIN buy b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1),
reach AS (SELECT a, b FROM lk UNION SELECT reach.a, lk.b FROM reach JOIN lk ON reach.b = lk.a),
lab AS (SELECT (a // 256)::INTEGER AS r, (a % 256)::INTEGER AS c, min(b)::BIGINT AS comp FROM reach GROUP BY a)"""


@query("label8", f'WITH RECURSIVE {_LABELS} SELECT r AS "row", c AS col, comp AS comp_id FROM lab')
def label8(spark, sf_dir):
    return components.label8(mask_of(event_cells(spark, sf_dir), "purchase"), EVENT_GRID)


@query("segment_table", f"""WITH RECURSIVE {_LABELS}, s AS (SELECT comp, count(*) AS n, avg(r) AS cy, avg(c) AS cx, round(var_pop(r) - var_pop(c), 9) AS spread, round(2 * covar_pop(r, c), 9) AS crs FROM lab GROUP BY comp),
t AS (SELECT *, CASE WHEN n >= 2 THEN degrees(atan2(-crs, spread)) / 2 END AS a FROM s)
SELECT comp AS comp_id, n, round(cy, 6) AS cy, round(cx, 6) AS cx, round(CASE WHEN a < 0 THEN a + 180 ELSE a END, 4) + 0.0 AS strike_deg FROM t""")
def segment_table(spark, sf_dir):
    out = components.segment_table(label8(spark, sf_dir))
    return out.select("comp_id", "n", r6("cy").alias("cy"), r6("cx").alias("cx"), (F.round("strike_deg", 4) + F.lit(0.0)).alias("strike_deg"))


@query("detached", f"""WITH RECURSIVE {_LABELS} SELECT DISTINCT comp AS comp_id FROM lab WHERE comp NOT IN (
  SELECT a.comp FROM lab a JOIN lab b ON a.comp <> b.comp AND b.r BETWEEN a.r - 4 AND a.r + 4 AND b.c BETWEEN a.c - 4 AND a.c + 4 WHERE (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 16)""")
def detached(spark, sf_dir):
    return components.detached(label8(spark, sf_dir))


@query("two_nearest_components", f"""WITH RECURSIVE {_LABELS}, d AS (SELECT p.r, p.c, comp, min((p.r - l.r) ** 2 + (p.c - l.c) ** 2)::BIGINT AS d2 FROM pred p JOIN lab l
  ON l.r BETWEEN p.r - 8 AND p.r + 8 AND l.c BETWEEN p.c - 8 AND p.c + 8 WHERE (p.r - l.r) ** 2 + (p.c - l.c) ** 2 <= 64 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d2, comp) AS k FROM d)
SELECT r AS "row", c AS col, max(CASE WHEN k = 1 THEN d2 END) AS d2_1, max(CASE WHEN k = 1 THEN comp END) AS comp_1, max(CASE WHEN k = 2 THEN d2 END) AS d2_2, max(CASE WHEN k = 2 THEN comp END) AS comp_2
FROM k WHERE k <= 2 GROUP BY r, c""")
def two_nearest_components(spark, sf_dir):
    return nearest.two_nearest_components(event_roles(spark, sf_dir)[1], label8(spark, sf_dir), 8)


# --- registry ---


@query("overlap", f"""WITH {_LAYERS}, n AS (SELECT count(*) AS n FROM cand) SELECT l.layer, round(coalesce(h, 0) / n, 6) AS overlap FROM (SELECT DISTINCT layer FROM reg) l LEFT JOIN (SELECT layer, count(*) AS h FROM hit GROUP BY layer) USING (layer), n""")
def overlap(spark, sf_dir):
    return registry.overlap(*_layers(spark, sf_dir)).select("layer", r6("overlap").alias("overlap"))


_AUDIT = f"""{_LAYERS}, n AS (SELECT count(*) AS n FROM cand),
fw AS (SELECT layer, count(*) AS h FROM hit GROUP BY layer),
bk AS (SELECT layer, avg(EXISTS (SELECT 1 FROM cand WHERE cand.r BETWEEN reg.r - 3 AND reg.r + 3 AND cand.c BETWEEN reg.c - 3 AND reg.c + 3 AND (cand.r - reg.r) ** 2 + (cand.c - reg.c) ** 2 <= 9)::INT) AS b,
              count(*) AS m, sum(EXISTS (SELECT 1 FROM cand WHERE cand.r = reg.r AND cand.c = reg.c)::INT) AS s FROM reg GROUP BY layer),
au AS (SELECT layer, coalesce(h, 0) / n AS f, b, s / (m + n - s) AS j FROM bk LEFT JOIN fw USING (layer), n)"""


@query("registry_audit", f"WITH {_AUDIT} SELECT layer, round(f, 6) AS overlap, round(b, 6) AS reverse_overlap, round(j, 6) AS jaccard, greatest(f, b) > 0.7 AS duplicate FROM au")
def registry_audit(spark, sf_dir):
    out = registry.audit(*_layers(spark, sf_dir))
    return out.select("layer", *[r6(c).alias(c) for c in ("overlap", "reverse_overlap", "jaccard")], "duplicate")


@query("audit_summary", f"""WITH {_AUDIT} SELECT count(*) AS n, arg_max(layer, (f, -layer))::INTEGER AS worst_layer, round(max(f), 6) AS worst_overlap, sum((greatest(f, b) > 0.7)::INT)::BIGINT AS duplicates, sum((greatest(f, b) > 0.7)::INT) = 0 AS "unique" FROM au""")
def audit_summary(spark, sf_dir):
    out = registry.audit_summary(registry.audit(*_layers(spark, sf_dir)), True)
    return out.select("n", "worst_layer", r6("worst_overlap").alias("worst_overlap"), "duplicates", "unique")


@query("certificate", f"""WITH {_LAYERS}, n AS (SELECT count(*) AS n FROM cand) SELECT l.layer, n - coalesce(h, 0) AS uncovered, n = coalesce(h, 0) AS saturated FROM (SELECT DISTINCT layer FROM reg) l LEFT JOIN (SELECT layer, count(*) AS h FROM hit GROUP BY layer) USING (layer), n""")
def certificate(spark, sf_dir):
    return registry.certificate(*_layers(spark, sf_dir))


@query("consensus", f"""WITH {_LAYERS}, nr AS (SELECT DISTINCT layer, r + dr AS r, c + dc AS c FROM reg, range(-1, 2) x(dr), range(-1, 2) y(dc) WHERE dr * dr + dc * dc <= 1)
SELECT r::INTEGER AS "row", c::INTEGER AS col, count(*) AS n_layers FROM nr GROUP BY ALL HAVING count(*) >= 4""")
def consensus(spark, sf_dir):
    return registry.consensus(_layers(spark, sf_dir)[1], 4, 1.0)


@query("containment", f"""WITH {_EVENTS} SELECT count(*) FILTER (c2 IS NULL) AS removed, count(*) FILTER (c1 IS NULL) AS added, count(*) FILTER (c1 IS NOT NULL AND c2 IS NOT NULL) AS shared
FROM (SELECT buy.c AS c1, click.c AS c2 FROM buy FULL JOIN click ON buy.r = click.r AND buy.c = click.c)""")
def containment(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    return registry.containment(mask_of(e, "purchase"), mask_of(e, "click"))


@query("merge_aliases", "SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS first_key, count(*) AS n_sources FROM documents GROUP BY 1")
def merge_aliases(spark, sf_dir):
    return registry.merge_aliases(table(spark, sf_dir, "documents"), "doc_id", "text")


# --- allocation ---


@query("top_cells", f'WITH {_EVENTS} SELECT r AS "row", c AS col, round(v, 6) AS "value" FROM click ORDER BY v DESC, r, c LIMIT 500')
def top_cells(spark, sf_dir):
    return allocate.top_cells(event_cells(spark, sf_dir).where("layer = 'click'").select("row", "col", "value"), 500).select("row", "col", r6("value").alias("value"))


_TILES = f"""{_EVENTS}, b AS (SELECT r // 9 AS tr, c // 9 AS tc, arg_max(r, (v, -r, -c)) AS r, arg_max(c, (v, -r, -c)) AS c, max(v) AS v FROM click GROUP BY ALL),
k AS (SELECT r, c, v, row_number() OVER (ORDER BY v DESC, tr, tc) AS k FROM b)"""


@query("decimated_ranking", f'WITH {_TILES} SELECT r AS "row", c AS col, round(v, 6) AS "value", k::INTEGER AS "rank" FROM k WHERE k <= 400')
def decimated_ranking(spark, sf_dir):
    out = allocate.decimated_ranking(event_cells(spark, sf_dir).where("layer = 'click'"), 9, 400)
    return out.select("row", "col", r6("value").alias("value"), "rank")


@query("budget_curve", f"""WITH {_EVENTS}, b AS (SELECT r // 9 AS tr, c // 9 AS tc, max(v) AS v FROM click GROUP BY ALL), k AS (SELECT v, row_number() OVER (ORDER BY v DESC, tr, tc) AS k FROM b)
SELECT b::INTEGER AS budget, count(*) AS n, round(sum(v), 6) AS mass FROM k JOIN (VALUES (50), (100), (200), (400)) x(b) ON k <= b GROUP BY b""")
def budget_curve(spark, sf_dir):
    ranked = allocate.decimated_ranking(event_cells(spark, sf_dir).where("layer = 'click'"), 9, 400)
    return allocate.budget_curve(ranked, [50, 100, 200, 400]).select("budget", "n", r6("mass").alias("mass"))


@query("quotas", f"""WITH {_EVENTS}, w AS (SELECT layer, sum(v) AS w FROM ev GROUP BY layer), e AS (SELECT layer, w / sum(w) OVER () * 1000 AS x FROM w), f AS (SELECT layer, floor(x) AS f, round(x - floor(x), 9) AS m FROM e)
SELECT layer, (f + CASE WHEN row_number() OVER (ORDER BY m DESC, layer) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""")
def quotas(spark, sf_dir):
    w = event_cells(spark, sf_dir).groupBy("layer").agg(F.sum("value").alias("w"))
    return allocate.quotas(w, "layer", "w", 1000).select("layer", F.col("quota").cast("long").alias("quota"))


@query("prefix_to_mass", f"""WITH RECURSIVE {_LABELS}, s AS (SELECT comp, count(*) AS n FROM lab GROUP BY comp), o AS (SELECT comp, n, sum(n) OVER (ORDER BY md5(comp || ':7'), comp ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT comp AS comp_id, n FROM o WHERE run - n < 300""")
def prefix_to_mass(spark, sf_dir):
    sizes = label8(spark, sf_dir).groupBy("comp_id").agg(F.count("*").alias("n"))
    return allocate.prefix_to_mass(sizes, "comp_id", "n", 300, 7)


@query("marginal_pass")
def marginal_pass(spark, sf_dir):
    click = event_cells(spark, sf_dir).where("layer = 'click'").select("row", "col", "value")
    credit = stencil.kernel_sum(click, EVENT_GRID).withColumnRenamed("value", "credit")
    cells = credit.join(click, ["row", "col"], "left").fillna(0.0, ["value"]).withColumn("fold", (F.col("row") / 180).cast("int") * 4 + (F.col("col") / 64).cast("int"))
    return allocate.marginal_pass(cells, "fold", 120.0, patience=100_000)  # more than the cells of a fold: all are visited


@query("spaced_cells")
def spaced_cells(spark, sf_dir):
    return allocate.spaced(event_cells(spark, sf_dir).where("layer = 'click'"), 3.0)


# --- vector, split, tensor ---


_PIXELS = """o AS (SELECT o_custkey AS id, o_orderkey AS k, o_orderdate AS d, (datediff('day', DATE '1995-01-01', o_orderdate::DATE) % 400)::BIGINT AS x, (o_orderkey % 300)::BIGINT AS y, left(o_orderpriority, 1) AS sense FROM orders),
t AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM o WINDOW w AS (PARTITION BY id ORDER BY d, k)), s AS (SELECT *, greatest(abs(x1 - x), abs(y1 - y)) AS n FROM t WHERE x1 IS NOT NULL),
e AS (SELECT k, sense, y, y1, x, x1, n, unnest(generate_series(0, n)) AS i FROM s),
px AS (SELECT k, sense, greatest(0, least(299, CASE WHEN n > 0 THEN y + floor((y1 - y) * i / n + 0.5) ELSE y END))::INTEGER AS r, greatest(0, least(399, CASE WHEN n > 0 THEN x + floor((x1 - x) * i / n + 0.5) ELSE x END))::INTEGER AS c FROM e)"""


def _trace_grid():
    from rastra.grid import GridSpec

    return GridSpec(300, 400)


@query("rasterise", f'WITH {_PIXELS} SELECT DISTINCT r AS "row", c AS col FROM px')
def rasterise(spark, sf_dir):
    return vector.rasterise(order_traces(spark, sf_dir), _trace_grid())


_RECORDS = f"""{_PIXELS.replace("e AS (SELECT k, ", "e AS (SELECT id, k, ").replace("px AS (SELECT k, ", "px AS (SELECT id, k, ")},
a AS (SELECT id, count(*) AS size, avg(r) AS cy, avg(c) AS cx, atan2(round(2 * covar_pop(r, c), 9), round(var_pop(r) - var_pop(c), 9)) / 2 AS a FROM px GROUP BY id),
x AS (SELECT id, max((r - cy) * cos(a) + (c - cx) * sin(a)) - min((r - cy) * cos(a) + (c - cx) * sin(a)) AS span FROM px JOIN a USING (id) GROUP BY id),
l AS (SELECT id, count(*) AS n, sum(sqrt((x1 - x) ** 2 + (y1 - y) ** 2)) / 100 AS len FROM s GROUP BY id),
m AS (SELECT id, coalesce(sense, 'unk') AS sense, count(*) AS c, min(k) AS f FROM s GROUP BY ALL), md AS (SELECT id, arg_max(sense, (c, -f)) AS sense FROM m GROUP BY id)"""


@query("record_segments", f"""WITH {_RECORDS} SELECT id AS record_id, n AS n_fragments, size, round(len, 4) AS length, round(span, 4) AS span, round(CASE WHEN a < 0 THEN degrees(a) + 180 ELSE degrees(a) END, 4) + 0.0 AS strike_deg,
CASE WHEN sense IN ('1', '2', '5') THEN sense ELSE 'unk' END AS sense FROM l JOIN a USING (id) JOIN x USING (id) JOIN md USING (id)""")
def record_segments(spark, sf_dir):
    out = vector.record_segments(order_traces(spark, sf_dir), _trace_grid(), ["1", "2", "5"])
    return out.select("record_id", "n_fragments", "size", F.round("length", 4).alias("length"), F.round("span", 4).alias("span"), (F.round("strike_deg", 4) + F.lit(0.0)).alias("strike_deg"), "sense")


@query("sense_raster", f"""WITH {_PIXELS} SELECT r AS "row", c AS col, arg_max(CASE sense WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '5' THEN 3 END, k)::INTEGER AS code FROM px WHERE sense IN ('1', '2', '5') GROUP BY r, c""")
def sense_raster(spark, sf_dir):
    return vector.sense_raster(order_traces(spark, sf_dir), _trace_grid(), {"1": 1, "2": 2, "5": 3})


@query("quadrants", f"""WITH {_EVENTS}, m AS (SELECT trunc(quantile_cont(r, 0.5)) AS mr, trunc(quantile_cont(c, 0.5)) AS mc FROM buy) SELECT r AS "row", c AS col, (2 * (r >= mr)::INT + (c >= mc)::INT)::INTEGER AS quadrant FROM buy, m""")
def quadrants(spark, sf_dir):
    return split.quadrants(mask_of(event_cells(spark, sf_dir), "purchase"))


@query("component_folds", f"""WITH RECURSIVE {_LABELS}, m AS (SELECT trunc(quantile_cont(r, 0.5)) AS mr, trunc(quantile_cont(c, 0.5)) AS mc FROM buy),
q AS (SELECT comp, (2 * (r >= mr)::INT + (c >= mc)::INT)::INTEGER AS q, count(*) AS n FROM lab, m GROUP BY ALL) SELECT comp AS comp_id, arg_max(q, (n, -q)) AS quadrant FROM q GROUP BY comp""")
def component_folds(spark, sf_dir):
    return split.component_folds(label8(spark, sf_dir), quadrants(spark, sf_dir))


@query("buffered_draw", f"""WITH RECURSIVE {_LABELS}, s AS (SELECT comp, count(*) AS n FROM lab GROUP BY comp), o AS (SELECT comp, n, sum(n) OVER (ORDER BY md5(comp || ':3'), comp ROWS UNBOUNDED PRECEDING) AS run FROM s),
h AS (SELECT r, c FROM lab WHERE comp IN (SELECT comp FROM o WHERE run - n < 0.2 * (SELECT sum(n) FROM s)))
SELECT r AS "row", c AS col, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.r = lab.r AND h.c = lab.c) THEN 'hidden'
  WHEN EXISTS (SELECT 1 FROM h WHERE h.r BETWEEN lab.r - 3 AND lab.r + 3 AND h.c BETWEEN lab.c - 3 AND lab.c + 3 AND (h.r - lab.r) ** 2 + (h.c - lab.c) ** 2 <= 9) THEN 'collar' ELSE 'visible' END AS "role" FROM lab""")
def buffered_draw(spark, sf_dir):
    return split.buffered_draw(label8(spark, sf_dir), 0.2, 3.0, 3)


@query("weighted_negatives", """WITH e AS (SELECT vec_id, label, label % 3 AS g, (label % 2)::INT AS y FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5(vec_id || ':5'), vec_id) AS k, count(*) OVER (PARTITION BY g) AS n FROM e WHERE y = 0)
SELECT vec_id, g, y, round(n / least(n, 20), 6) AS weight FROM k WHERE k <= 20 UNION ALL SELECT vec_id, g, y, 1.0 FROM e WHERE y = 1""")
def weighted_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("g"), (F.col("label") % 2).alias("y"))
    return split.weighted_negatives(rows, "y", "g", ["vec_id"], 20, 5).select("vec_id", "g", "y", r6("weight").alias("weight"))


def _dense(spark, sf_dir):
    grid = cells_in(LAYER_GRID, spark)
    counts = layer_cells(spark, sf_dir).groupBy("row", "col").agg(F.sum("value").alias("value"))
    return grid.join(counts, ["row", "col"], "left").select("row", "col", F.round(F.coalesce("value", F.lit(0.0)), 4).alias("value"))


_DENSE = f"""{_LAYERS}, g AS (SELECT a.r::INTEGER AS r, b.c::INTEGER AS c FROM range(400) a(r), range(128) b(c)), s AS (SELECT r, c, sum(v) AS v FROM ly GROUP BY ALL),
dn AS (SELECT g.r, g.c, round(coalesce(v, 0), 4) AS v FROM g LEFT JOIN s ON s.r = g.r AND s.c = g.c),
gr AS (SELECT r, c, v, CASE WHEN lag(v) OVER a IS NULL THEN lead(v) OVER a - v WHEN lead(v) OVER a IS NULL THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END AS gr,
  CASE WHEN lag(v) OVER b IS NULL THEN lead(v) OVER b - v WHEN lead(v) OVER b IS NULL THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END AS gc FROM dn WINDOW a AS (PARTITION BY c ORDER BY r), b AS (PARTITION BY r ORDER BY c))"""


@query("gradient", f'WITH {_DENSE} SELECT r AS "row", c AS col, round(gr, 5) + 0.0 AS g_row, round(gc, 5) + 0.0 AS g_col FROM gr')
def gradient(spark, sf_dir):
    out = tensor.gradient(_dense(spark, sf_dir))
    return out.select("row", "col", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("g_row", "g_col")])


@query("gaussian", f"""WITH {_EVENTS}, w AS (SELECT i, exp(-0.5 * i * i) / (SELECT sum(exp(-0.5 * j * j)) FROM range(-4, 5) x(j)) AS k FROM range(-4, 5) y(i)),
a AS (SELECT r + i AS r, c, sum(v * k) AS v FROM click, w WHERE r + i BETWEEN 0 AND 719 GROUP BY ALL), b AS (SELECT r, c + i AS c, sum(v * k) AS v FROM a, w WHERE c + i BETWEEN 0 AND 255 GROUP BY ALL)
SELECT r::INTEGER AS "row", c::INTEGER AS col, round(v, 6) AS "value" FROM b""")
def gaussian(spark, sf_dir):
    out = tensor.gaussian(event_cells(spark, sf_dir).where("layer = 'click'"), EVENT_GRID, 1.0, ["value"])
    return out.select("row", "col", r6("value").alias("value"))


@query("structure_tensor", f"""WITH {_DENSE}, w AS (SELECT i, exp(-0.5 * i * i) / (SELECT sum(exp(-0.5 * j * j)) FROM range(-4, 5) x(j)) AS k FROM range(-4, 5) y(i)),
a AS (SELECT r + i AS r, c, sum(gr * gr * k) AS rr, sum(gc * gc * k) AS cc, sum(gr * gc * k) AS rc FROM gr, w WHERE r + i BETWEEN 0 AND 399 GROUP BY ALL),
b AS (SELECT r, c + i AS c, sum(rr * k) AS rr, sum(cc * k) AS cc, sum(rc * k) AS rc FROM a, w WHERE c + i BETWEEN 0 AND 127 GROUP BY ALL)
SELECT r::INTEGER AS "row", c::INTEGER AS col, round(CASE WHEN rr + cc > 1e-12 THEN sqrt((rr - cc) ** 2 + 4 * rc ** 2) / (rr + cc) ELSE 0 END, 5) AS coherence,
CASE WHEN rr + cc > 1e-12 AND sqrt((rr - cc) ** 2 + 4 * rc ** 2) / (rr + cc) > 1e-3 THEN round((cc - rr) / sqrt((rr - cc) ** 2 + 4 * rc ** 2), 4) + 0.0 END AS strike_cos2,
CASE WHEN rr + cc > 1e-12 AND sqrt((rr - cc) ** 2 + 4 * rc ** 2) / (rr + cc) > 1e-3 THEN round(2 * rc / sqrt((rr - cc) ** 2 + 4 * rc ** 2), 4) + 0.0 END AS strike_sin2 FROM b""")
def structure_tensor(spark, sf_dir):
    """The strike by its doubled angle, which does not jump at 180 degrees, where there is one."""
    out = tensor.structure_tensor(_dense(spark, sf_dir), LAYER_GRID, 1.0)
    twice = lambda f: F.when(F.col("coherence") > 1e-3, F.round(f(F.radians(2 * F.col("strike_deg"))), 4) + F.lit(0.0))
    return out.select("row", "col", F.round("coherence", 5).alias("coherence"), twice(F.cos).alias("strike_cos2"), twice(F.sin).alias("strike_sin2"))


@query("box_contrast", f"""WITH {_DENSE}, bx AS (SELECT a.r, a.c, a.v, avg(b.v) AS m, stddev_pop(b.v) AS sd FROM dn a JOIN dn b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY ALL)
SELECT r AS "row", c AS col, round(CASE WHEN sd > 1e-6 THEN (v - m) / sd ELSE 0 END + 1e-7, 4) + 0.0 AS contrast FROM bx""")
def box_contrast(spark, sf_dir):
    out = tensor.box_contrast(_dense(spark, sf_dir), 2)
    return out.select("row", "col", (F.round(F.col("contrast") + 1e-7, 4) + F.lit(0.0)).alias("contrast"))


# --- validation and sources ---


@query("surface_checks", f"""WITH {_EVENTS} SELECT * FROM (VALUES ('finite', (SELECT coalesce(bool_and(v IS NOT NULL AND isfinite(v)), true) FROM click)), ('in_range', (SELECT coalesce(bool_and(v BETWEEN 0 AND 1), true) FROM click)),
('inside_grid', (SELECT coalesce(bool_and({_ON_GRID}), true) FROM click)), ('unique_cells', (SELECT count(*) = count(DISTINCT (r, c)) FROM click)),
('clear_of_catalogue', (SELECT count(*) = 0 FROM click JOIN err ON err.r = click.r AND err.c = click.c)), ('not_empty', (SELECT count(*) > 0 FROM click))) t("check", passed)""")
def surface_checks(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    return validate.checks(e.where("layer = 'click'"), EVENT_GRID, mask_of(e, "error"))


@query("page_links", r"""SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '<a\s[^>]*href="([^"]*)"', 1, 'i'))::INTEGER AS n_links, len(regexp_extract_all(coalesce(html, ''), '<h[12][^>]*>', 0, 'i'))::INTEGER AS n_headings,
trim(regexp_extract(coalesce(html, ''), '<title[^>]*>(.*?)</title>', 1, 'is')) AS title FROM pages""")
def page_links(spark, sf_dir):
    return files.page_links(table(spark, sf_dir, "pages"))


@query("file_hashes", "SELECT page_id, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL")
def file_hashes(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.sha2("html", 256).alias("sha256"))


@query("table_rows", """WITH r AS (SELECT page_id, 'p' || page_id AS a FROM pages) SELECT page_id, 0 AS row_no, a || '|x' AS cells FROM r UNION ALL SELECT page_id, 1, 'y|z|w' FROM r""")
def table_rows(spark, sf_dir):
    """The parser on made-up tables, as the test pages hold none."""
    html = F.concat(F.lit("<table class=t><tr><td>p"), F.col("page_id"), F.lit("</td><th> <b>x</b></tr><TR><td>y<td>z<td>w</table>"))
    out = files.table_rows(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))
    return out.select("page_id", "row_no", F.array_join("cells", "|").alias("cells"))


# --- features and models ---


def _mirror(source: str, sigma: int, values: list[str], name: str) -> str:
    """SQL of a Gaussian over the event grid with mirrored edges, by rows and then by columns."""
    reach = 4 * sigma
    w = f"(SELECT i, exp(-0.5 * i * i / {sigma * sigma}.0) / (SELECT sum(exp(-0.5 * j * j / {sigma * sigma}.0)) FROM range({-reach}, {reach + 1}) x(j)) AS k FROM range({-reach}, {reach + 1}) y(i))"
    sums, keep = ", ".join(f"sum({v} * k) AS {v}" for v in values), ", ".join(values)
    rows = " UNION ALL ".join(f"SELECT {e} AS r, c, {keep} FROM {source}" for e in ("r", "-1 - r", "1439 - r"))
    cols = " UNION ALL ".join(f"SELECT r, {e} AS c, {keep} FROM {name}_a" for e in ("c", "-1 - c", "511 - c"))
    return f"""{name}_a AS (SELECT r + i AS r, c, {sums} FROM ({rows}), {w} WHERE r + i BETWEEN 0 AND 719 GROUP BY ALL),
{name} AS (SELECT r, c + i AS c, {sums} FROM ({cols}), {w} WHERE c + i BETWEEN 0 AND 255 GROUP BY ALL)"""


_STRIKE = f"""{_mirror("one", 1, ["v"], "sm")}, gd AS (SELECT a.r::INTEGER AS r, b.c::INTEGER AS c FROM range(720) a(r), range(256) b(c)),
dn AS (SELECT gd.r, gd.c, coalesce(v, 0) AS v FROM gd LEFT JOIN sm ON sm.r = gd.r AND sm.c = gd.c),
gr AS (SELECT r, c, CASE WHEN r = 0 THEN lead(v) OVER a - v WHEN r = 719 THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END AS y,
  CASE WHEN c = 0 THEN lead(v) OVER b - v WHEN c = 255 THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END AS x FROM dn WINDOW a AS (PARTITION BY c ORDER BY r), b AS (PARTITION BY r ORDER BY c)),
pr AS (SELECT r, c, y * y AS yy, x * x AS xx, x * y AS xy FROM gr WHERE y <> 0 OR x <> 0), {_mirror("pr", 3, ["yy", "xx", "xy"], "js")},
st AS (SELECT r, c, round(xx - yy, 12) AS d, round(2 * xy, 12) AS e, xx + yy AS t FROM js WHERE EXISTS (SELECT 1 FROM one WHERE one.r = js.r AND one.c = js.c)),
sk AS (SELECT r, c, sqrt(d * d + e * e) / greatest(t, 1e-12) AS coh, degrees(atan2(round(cos(atan2(e, d) / 2 + pi() / 2), 12), -sin(atan2(e, d) / 2 + pi() / 2))) AS s FROM st)"""
_TRUTH_LABELS = """lk AS (SELECT a.r * 256 + a.c AS a, b.r * 256 + b.c AS b FROM one a JOIN one b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1),
reach AS (SELECT a, b FROM lk UNION SELECT reach.a, lk.b FROM reach JOIN lk ON reach.b = lk.a),
lab AS (SELECT (a // 256)::INTEGER AS r, (a % 256)::INTEGER AS c, min(b)::BIGINT AS comp FROM reach GROUP BY a)"""
_GEOMETRY = f"""{_EVENTS}, one AS (SELECT r, c, 1.0 AS v FROM truth), {_TRUTH_LABELS}, {_STRIKE}, sz AS (SELECT comp, count(*) AS n FROM lab GROUP BY comp),
nr AS (SELECT p.r, p.c, min((p.r - t.r) ** 2 + (p.c - t.c) ** 2) AS d2, arg_min([t.r, t.c], ((p.r - t.r) ** 2 + (p.c - t.c) ** 2, t.r, t.c)) AS nt FROM pred p, truth t GROUP BY p.r, p.c),
fr AS (SELECT nr.r, nr.c, sqrt(d2) AS d, nr.r - nt[1] AS dy, nr.c - nt[2] AS dx, ln(1 + n) AS ll, coh, radians(CASE WHEN s < 0 THEN s + 180 WHEN s >= 180 THEN s - 180 ELSE s END) AS s
  FROM nr JOIN lab ON lab.r = nt[1] AND lab.c = nt[2] JOIN sz USING (comp) JOIN sk ON sk.r = nt[1] AND sk.c = nt[2]),
ds AS (SELECT p.r, p.c, count(*) AS n FROM pred p JOIN truth t ON t.r BETWEEN p.r - 5 AND p.r + 5 AND t.c BETWEEN p.c - 5 AND p.c + 5 WHERE (p.r - t.r) ** 2 + (p.c - t.c) ** 2 <= 25 GROUP BY ALL),
ft AS (SELECT fr.r, fr.c, d, abs(dy * sin(s) + dx * cos(s)) AS d_perp, abs(dx * sin(s) - dy * cos(s)) AS d_par_abs, sign(round(-dy * sin(s) - dx * cos(s), 9)) AS side, ll AS log_len, sin(2 * s) AS sin2, cos(2 * s) AS cos2,
  coh AS coherence, coalesce(n, 0) AS density, sin(2 * s) * d AS sin2d, cos(2 * s) * d AS cos2d FROM fr LEFT JOIN ds ON ds.r = fr.r AND ds.c = fr.c)"""


def r4(column: str) -> Column:
    return F.round(F.col(column), 4) + F.lit(0.0)


@query("geometry_features", f"""WITH RECURSIVE {_GEOMETRY} SELECT r AS "row", c AS col, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in features.GEOMETRY)} FROM ft""")
def geometry_features(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    return features.geometry(prediction, truth, EVENT_GRID).select("row", "col", *[r4(c).alias(c) for c in features.GEOMETRY])


@query("relay_ratio", f"""WITH RECURSIVE {_LABELS}, d AS (SELECT p.r, p.c, comp, min((p.r - l.r) ** 2 + (p.c - l.c) ** 2) AS d2 FROM pred p JOIN lab l
  ON l.r BETWEEN p.r - 8 AND p.r + 8 AND l.c BETWEEN p.c - 8 AND p.c + 8 WHERE (p.r - l.r) ** 2 + (p.c - l.c) ** 2 <= 64 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d2, comp) AS k FROM d),
t AS (SELECT r, c, sqrt(max(CASE WHEN k = 1 THEN d2 END)) AS a, sqrt(max(CASE WHEN k = 2 THEN d2 END)) AS b FROM k WHERE k <= 2 GROUP BY r, c)
SELECT r AS "row", c AS col, round(a, 6) AS d1, round(b, 6) AS d2, CASE WHEN a + b > 0 THEN round(a / (a + b), 6) END AS relay_ratio FROM t""")
def relay_ratio(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    out = features.relay(event_roles(spark, sf_dir)[1], mask_of(e, "purchase"), EVENT_GRID, 8)
    return out.select("row", "col", *[r6(c).alias(c) for c in ("d1", "d2", "relay_ratio")])


_ZONE_ROWS = f"""{_EVENTS}, n AS (SELECT e.r, e.c, e.v, min((e.r - b.r) ** 2 + (e.c - b.c) ** 2) AS d2 FROM (SELECT * FROM ev WHERE layer = 'view') e JOIN buy b
  ON b.r BETWEEN e.r - 6 AND e.r + 6 AND b.c BETWEEN e.c - 6 AND e.c + 6 WHERE (e.r - b.r) ** 2 + (e.c - b.c) ** 2 <= 36 GROUP BY ALL),
f AS (SELECT r, c, least(2, floor(sqrt(d2) / 2))::INTEGER AS db, CASE WHEN v >= 0.6 THEN 2 WHEN v >= 0.2 THEN 1 ELSE 0 END AS sb, EXISTS (SELECT 1 FROM click WHERE click.r = n.r AND abs(click.c - n.c) <= 1)::INT AS y FROM n)"""
_D_EDGES, _S_EDGES = [0.0, 2.0, 4.0, 6.0], [0.0, 0.2, 0.6, 1.0]


def _zone_rows(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    near = nearest.nearest_within(e.where("layer = 'view'").select("row", "col", "value"), mask_of(e, "purchase"), 6)
    beside = stencil.spread(mask_of(e, "click"), [(0, i) for i in range(-1, 2)]).select("row", "col").distinct().withColumn("y", F.lit(1))
    return near.join(beside, ["row", "col"], "left").fillna(0, ["y"]).withColumn("d", F.sqrt(F.col("d2").cast("double")))


def _zone_sql(strike: str, extra: str) -> str:
    return f"""{_ZONE_ROWS}, g AS (SELECT db, sb, count(*) AS n, sum(y) AS p FROM f GROUP BY ALL), al AS (SELECT a::INTEGER AS db, b::INTEGER AS sb, coalesce(n, 0)::BIGINT AS n, coalesce(p, 0)::BIGINT AS p FROM range(3) x(a) CROSS JOIN range(3) z(b) LEFT JOIN g ON db = a AND sb = b),
q AS (SELECT db, sb, {strike} FROM al), rt AS (SELECT *, CASE WHEN n > 0 THEN p / n ELSE 0 END AS rate, (SELECT sum(p) / sum(n) FROM q) AS base FROM q), zm AS (SELECT *, (rate >= 1.05 * base AND n >= 40{extra}) AS kp FROM rt)"""


_ZONE = _zone_sql("n, p", "")
_OUTER = _zone_sql("(sum(n) OVER (PARTITION BY db))::BIGINT AS n, (sum(p) OVER (PARTITION BY db))::BIGINT AS p", " AND db >= 1")
_ZONE_OUT = 'SELECT db AS d_bin, sb AS s_bin, n, p, round(rate, 6) AS rate, kp AS keep, round(CASE WHEN kp THEN rate ELSE 0 END, 6) AS "value" FROM zm'


def _zone(spark, sf_dir, **how):
    return profiles.zone_model(_zone_rows(spark, sf_dir), "d", "value", "y", _D_EDGES, _S_EDGES, min_ratio=1.05, **how)


@query("zone_table", f"WITH {_ZONE} {_ZONE_OUT}")
def zone_table(spark, sf_dir):
    return _zone(spark, sf_dir).select("d_bin", "s_bin", "n", "p", r6("rate").alias("rate"), "keep", r6("value").alias("value"))


@query("zone_outer", f"WITH {_OUTER} {_ZONE_OUT}")
def zone_outer(spark, sf_dir):
    return _zone(spark, sf_dir, outer=True, isotropic=True).select("d_bin", "s_bin", "n", "p", r6("rate").alias("rate"), "keep", r6("value").alias("value"))


@query("zone_intensity", f'WITH {_ZONE} SELECT r AS "row", c AS col, round(CASE WHEN kp THEN rate ELSE 0 END, 6) AS intensity FROM f JOIN zm USING (db, sb)')
def zone_intensity(spark, sf_dir):
    out = profiles.zone_intensity(_zone_rows(spark, sf_dir), "d", "value", _zone(spark, sf_dir), _D_EDGES, _S_EDGES)
    return out.select("row", "col", r6("intensity").alias("intensity"))


@query("boosted_surface")
def boosted_surface(spark, sf_dir):
    """A probability for every click cell that a purchase lies within two cells, from its geometry to views and its value."""
    e = event_cells(spark, sf_dir)
    click = e.where("layer = 'click'").select("row", "col", "value")
    table_ = features.geometry(click, mask_of(e, "view"), EVENT_GRID).join(click, ["row", "col"])
    near = stencil.spread(mask_of(e, "purchase"), stencil.disk_offsets(2)).select("row", "col").distinct().withColumn("y", F.lit(1))
    rows = table_.join(near, ["row", "col"], "left").fillna(0, ["y"]).withColumn("g", (F.col("row") / 180).cast("int"))
    columns = [*features.GEOMETRY, "value"]
    train = split.weighted_negatives(rows, "y", "g", ["row", "col"], 2000, 5)
    return features.boosted_surface(train, rows.select("row", "col", *columns), columns, trees=5)


@query("branches", f"""WITH RECURSIVE {_EVENTS}, gw AS (SELECT DISTINCT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c FROM buy, range(-1, 2) x(dr), range(-1, 2) y(dc) WHERE abs(dr) + abs(dc) <= 1 AND r + dr BETWEEN 0 AND 719 AND c + dc BETWEEN 0 AND 255),
nb AS (SELECT a.r, a.c, count(*) - 1 AS n FROM gw a JOIN gw b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL), one AS (SELECT r, c FROM nb WHERE n < 3), {_TRUTH_LABELS},
sg AS (SELECT comp, count(*) AS n, avg(r) AS cy, avg(c) AS cx, atan2(round(-2 * covar_pop(r, c), 9), round(var_pop(r) - var_pop(c), 9)) / 2 AS a FROM lab GROUP BY comp),
al AS (SELECT comp, r, c, round((c - cx) * sin(a) - (r - cy) * cos(a), 6) AS t FROM lab JOIN sg USING (comp))
SELECT r AS "row", c AS col, comp AS comp_id, ((row_number() OVER (PARTITION BY comp ORDER BY t, r, c) - 1) // 12)::INTEGER AS chunk_no FROM al""")
def branches(spark, sf_dir):
    return components.branches(stencil.dilate(mask_of(event_cells(spark, sf_dir), "purchase"), stencil.diamond_offsets(1), EVENT_GRID), EVENT_GRID)


_EXTENTS = f"""{_LABELS}, ax AS (SELECT comp, count(*) AS size, avg(r) AS cy, avg(c) AS cx, atan2(round(2 * covar_pop(r, c), 9), round(var_pop(r) - var_pop(c), 9)) / 2 AS a FROM lab GROUP BY comp),
ed AS (SELECT comp, min((r - cy) * cos(a) + (c - cx) * sin(a)) AS lo, max((r - cy) * cos(a) + (c - cx) * sin(a)) AS hi FROM lab JOIN ax USING (comp) GROUP BY comp),
fg AS (SELECT comp, size, a, degrees(a) + CASE WHEN a < 0 THEN 180 ELSE 0 END AS s, hi - lo AS span, cy + cos(a) * lo AS r0, cx + sin(a) * lo AS c0, cy + cos(a) * hi AS r1, cx + sin(a) * hi AS c1 FROM ax JOIN ed USING (comp))"""
_LINKS = f"""{_EXTENTS}, en AS (SELECT comp, s, a, r0 AS r, c0 AS c FROM fg UNION ALL SELECT comp, s, a, r1, c1 FROM fg),
mt AS (SELECT e.comp AS a, f.comp AS b, e.a AS ang, abs(e.s - f.s) AS ds, sqrt((e.r - f.r0) ** 2 + (e.c - f.c0) ** 2) AS g0, sqrt((e.r - f.r1) ** 2 + (e.c - f.c1) ** 2) AS g1, f.r0 - e.r AS y0, f.c0 - e.c AS x0, f.r1 - e.r AS y1, f.c1 - e.c AS x1
  FROM en e JOIN fg f ON e.comp < f.comp),
ok AS (SELECT DISTINCT a, b FROM mt WHERE least(g0, g1) <= 4 AND least(ds, 180 - ds) <= 30 AND (least(g0, g1) < 1e-9 OR
  degrees(acos(least(1.0, abs(CASE WHEN g0 <= g1 THEN y0 * cos(ang) + x0 * sin(ang) ELSE y1 * cos(ang) + x1 * sin(ang) END) / greatest(least(g0, g1), 1e-9)))) <= 45)),
ek AS (SELECT a, b FROM ok UNION ALL SELECT b, a FROM ok), rs AS (SELECT comp AS a, comp AS b FROM fg UNION SELECT rs.a, ek.b FROM rs JOIN ek ON rs.b = ek.a), sy AS (SELECT a AS comp, min(b) AS sys FROM rs GROUP BY a)"""


@query("fragment_table", f"""WITH RECURSIVE {_EXTENTS} SELECT comp AS comp_id, size, round(s, 4) + 0.0 AS strike_deg, round(span, 4) + 0.0 AS span, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("r0", "c0", "r1", "c1"))} FROM fg""")
def fragment_table(spark, sf_dir):
    return components.extents(label8(spark, sf_dir), "comp_id").select("comp_id", "size", *[r4(c).alias(c) for c in ("strike_deg", "span", "r0", "c0", "r1", "c1")])


@query("linked", f"WITH RECURSIVE {_LINKS} SELECT comp AS comp_id, sys AS system_id FROM sy")
def linked(spark, sf_dir):
    return components.linked(label8(spark, sf_dir))


@query("system_table", f"""WITH RECURSIVE {_LINKS}, sp AS (SELECT sys, count(*) AS n, sum(size)::BIGINT AS size, sum(span) AS len FROM fg JOIN sy USING (comp) GROUP BY sys) SELECT sys AS system_id, n AS n_fragments, size, round(len, 4) + 0.0 AS length FROM sp""")
def system_table(spark, sf_dir):
    labelled = label8(spark, sf_dir)
    return components.system_table(labelled, components.linked(labelled)).select("system_id", "n_fragments", "size", r4("length").alias("length"))

"""Registered queries of profiles, resampling, registry work, splits and sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastra.functions import scalars
from rastra.grid import EVENT_GRID, LAYER_GRID, cells_in, event_cells, event_roles, layer_cells, mask_of, order_traces, table
from rastra.operators import allocate, components, masks, metric, nearest, profiles, registry, split, stats, stencil, tensor, vector
from rastra.plans.queries import ORACLE_SQL, QUERIES, _DENSE, _EVENTS, _LABELS, _LAYERS, _PIXELS, _TERMS, _dense, _layers, _terms, _trace_grid, label8, query, r4, r6
from rastra.sources import feeds

__all__ = ["ORACLE_SQL", "QUERIES"]  # both modules' queries

_ON = "r BETWEEN 0 AND 719 AND c BETWEEN 0 AND 255"

# --- scalar functions ---

_ANGLES = "x AS (SELECT o_orderkey AS k, (o_orderkey % 360)::DOUBLE AS a, (o_custkey % 360)::DOUBLE AS b, o_totalprice / 1000 AS v, (o_orderkey % 7)::DOUBLE AS y, (o_custkey % 5)::DOUBLE AS w FROM orders)"
_MOD = lambda e: f"((({e}) % 180.0) + 180.0) % 180.0"


@query("scalar_functions", f"""WITH {_ANGLES} SELECT k, round(greatest(0, 1 - w / 3), 6) AS kernel, round({_MOD('degrees(atan2(w, -y))')}, 5) AS azimuth, round(least({_MOD('abs(a - b)')}, 180 - {_MOD('abs(a - b)')}), 5) AS axial,
round(w * sin(radians(a)) - y * cos(radians(a)), 5) + 0.0 AS along, round(-w * cos(radians(a)) - y * sin(radians(a)), 5) + 0.0 AS across, round({_MOD('a - b + 90')} - 90, 5) + 0.0 AS oblique, round(y / (y + 0.2 * w + 0.8 * v + 1e-12), 6) AS dti FROM x""")
def scalar_functions(spark, sf_dir):
    scalars.register(spark)
    o = table(spark, sf_dir, "orders")
    d = lambda c: c.cast("double")
    o.select(F.col("o_orderkey").alias("k"), d(F.col("o_orderkey") % 360).alias("a"), d(F.col("o_custkey") % 360).alias("b"), (F.col("o_totalprice") / 1000).alias("v"), d(F.col("o_orderkey") % 7).alias("y"), d(F.col("o_custkey") % 5).alias("w")).createOrReplaceTempView("rastra_angles")
    return spark.sql("""SELECT k, round(grid_kernel(w, 3), 6) AS kernel, round(grid_azimuth(y, w), 5) AS azimuth, round(axial_difference(a, b), 5) AS axial,
        round(along_strike(y, w, a), 5) + 0D AS along, round(across_strike(y, w, a), 5) + 0D AS across, round(signed_obliquity(a, b), 5) + 0D AS oblique, round(dti(y, w, v), 6) AS dti FROM rastra_angles""")


# Distances d to the nearest truth cell, values v, and lengths of ten cells for each cell of the distance.
_COLUMNS = lambda near: f"""WITH {near} SELECT r AS "row", c AS col, round(greatest(2, least(60, exp(1.2) * (greatest(10 * d, 1) / 40) ** 0.6)), 5) AS half_width, v AS prior, round(greatest(d, v, 2.5), 6) AS plane,
round(d / sqrt(1 + 10 * d), 6) AS width, round(sqrt(10 * d), 6) AS weight, round(v * (0.2 * d + 0.8 * 10 * d), 6) AS credit, round(CASE WHEN d > 8 THEN -1 ELSE d END, 6) AS scrubbed, d > 5 AS beyond FROM nn"""  # noqa: E731


def column_functions(spark, sf_dir):
    near = _near(spark, sf_dir)
    d, v, length = F.col("d"), F.col("v"), 10 * F.col("d")
    out = {
        "half_width": F.round(scalars.half_width(length, 0.6, 1.2), 5), "prior": scalars.canonical_prior(v), "plane": r6(scalars.consensus_plane(d, v, F.lit(2.5))), "width": r6(scalars.width_feature(d, length)),
        "weight": r6(scalars.length_weight(length)), "credit": r6(scalars.implied_credit(v, d, length)), "scrubbed": r6(scalars.scrubbed(d, F.lit(-1.0), 8.0)), "beyond": scalars.off_flank(d, 5.0),
    }
    return near.select("row", "col", *[e.alias(n) for n, e in out.items()])


# --- profiles ---

_NEAR = f"""{_EVENTS}, nn AS (SELECT p.r, p.c, p.v, sqrt(min((p.r - t.r) ** 2 + (p.c - t.c) ** 2)) AS d, EXISTS (SELECT 1 FROM err WHERE err.r = p.r AND abs(err.c - p.c) <= 2)::INT AS y
  FROM pred p JOIN truth t ON t.r BETWEEN p.r - 12 AND p.r + 12 AND t.c BETWEEN p.c - 12 AND p.c + 12 WHERE (p.r - t.r) ** 2 + (p.c - t.c) ** 2 <= 144 GROUP BY ALL)"""


def _near(spark, sf_dir):
    """Prediction cells with the distance to truth and y: an error within two columns."""
    truth, prediction = event_roles(spark, sf_dir)
    near = nearest.nearest_within(prediction, truth, 12)
    beside = stencil.spread(mask_of(event_cells(spark, sf_dir), "error"), [(0, i) for i in range(-2, 3)]).select("row", "col").distinct().withColumn("y", F.lit(1))
    out = near.join(beside, ["row", "col"], "left").fillna(0, ["y"])
    return out.select("row", "col", F.col("value").alias("v"), F.sqrt(F.col("d2").cast("double")).alias("d"), "y")


query("column_functions", _COLUMNS(_NEAR))(column_functions)

_UNIT_EDGES = [float(i) for i in range(13)]
_HIST = "h AS (SELECT i::INTEGER AS bin, count(d) AS n FROM range(12) g(i) LEFT JOIN nn ON least(11, floor(d)) = i GROUP BY i), dn0 AS (SELECT bin, n, n / sum(n) OVER () AS density FROM h)"


@query("radial_density", f"WITH {_NEAR}, {_HIST} SELECT bin, n, round(density, 6) AS density FROM dn0")
def radial_density(spark, sf_dir):
    return profiles.density(_near(spark, sf_dir), "d", _UNIT_EDGES).select("bin", "n", r6("density").alias("density"))


_SPLICE = f"""{_NEAR}, {_HIST}, h2 AS (SELECT i::INTEGER AS bin, count(d) AS n FROM range(3) g(i) LEFT JOIN (SELECT * FROM nn WHERE y = 1 AND d <= 3) ON least(2, floor(d)) = i GROUP BY i), d2 AS (SELECT bin, n / sum(n) OVER () AS q FROM h2),
sp AS (SELECT dn0.bin, CASE WHEN dn0.bin < 3 THEN q * (SELECT density FROM dn0 WHERE bin = 3) / (SELECT q FROM d2 WHERE bin = 2) ELSE density END AS density FROM dn0 LEFT JOIN d2 USING (bin))"""


def _spliced(spark, sf_dir):
    near = _near(spark, sf_dir)
    return profiles.spliced(profiles.density(near, "d", _UNIT_EDGES), profiles.density(near.where("y = 1"), "d", [0.0, 1.0, 2.0, 3.0]), 3)


@query("near_band_splice", f"WITH {_SPLICE} SELECT bin, round(density, 6) AS density FROM sp")
def near_band_splice(spark, sf_dir):
    return _spliced(spark, sf_dir).select("bin", r6("density").alias("density"))


@query("density_lookup", f'WITH {_SPLICE} SELECT r AS "row", c AS col, round(density, 6) AS density FROM nn JOIN sp ON bin = least(11, floor(d))')
def density_lookup(spark, sf_dir):
    return profiles.density_at(_near(spark, sf_dir), "d", _UNIT_EDGES, _spliced(spark, sf_dir)).select("row", "col", r6("density").alias("density"))


@query("tip_split", f"WITH {_NEAR} SELECT round(avg((d / 6 <= 1)::INT), 6) AS frac_inside, round(avg((d / 6 > 1)::INT), 6) AS frac_beyond FROM nn")
def tip_split(spark, sf_dir):
    return profiles.tip_split(_near(spark, sf_dir).withColumn("u", F.col("d") / 6), "u").select(r6("frac_inside").alias("frac_inside"), r6("frac_beyond").alias("frac_beyond"))


@query("length_scaling", f"""WITH {_NEAR}, b AS (SELECT CASE WHEN v >= 0.6 THEN 2 WHEN v >= 0.2 THEN 1 ELSE 0 END AS bin, d FROM nn), m AS (SELECT quantile_cont(d, 0.5) AS base FROM nn)
SELECT bin, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(greatest(0.2, quantile_cont(d, 0.5) / any_value(base)), 6) AS scale FROM b, m GROUP BY bin HAVING count(*) >= 30""")
def length_scaling(spark, sf_dir):
    return profiles.length_scaling(_near(spark, sf_dir), "d", "v", [0.0, 0.2, 0.6, 1.0]).select("bin", "n", r6("median").alias("median"), r6("scale").alias("scale"))


@query("class_rates", f"""WITH {_NEAR}, k AS (SELECT (r % 5)::INTEGER AS kind, y FROM nn WHERE r % 5 <> 4), t AS (SELECT avg(y) AS q FROM k)
SELECT i::INTEGER AS kind, count(y) AS area, coalesce(sum(y), 0)::BIGINT AS positive, round(avg(y), 6) AS rate, round(avg(y) / greatest(any_value(q), 1e-12), 6) AS ratio FROM t, range(5) g(i) LEFT JOIN k ON kind = i GROUP BY i""")
def class_rates(spark, sf_dir):
    rows = _near(spark, sf_dir).withColumn("kind", (F.col("row") % 5).cast("int")).where("kind <> 4")
    return profiles.class_rates(rows, "kind", "y", list(range(5))).select("kind", "area", "positive", r6("rate").alias("rate"), r6("ratio").alias("ratio"))


_BANDS = [0.0, 1.0, 2.0, 4.0, 8.0, 12.0]
_PROFILE = "pf AS (SELECT i::INTEGER AS bin, count(y) AS area, coalesce(sum(y), 0)::BIGINT AS positive, coalesce(sum(y), 0) / greatest(count(y), 1) AS rate FROM range(5) g(i) LEFT JOIN nn ON CASE WHEN d >= 8 THEN 4 WHEN d >= 4 THEN 3 WHEN d >= 2 THEN 2 WHEN d >= 1 THEN 1 ELSE 0 END = i GROUP BY i)"


@query("distance_profile", f"WITH {_NEAR}, {_PROFILE} SELECT bin, area, positive, round(rate, 6) AS rate FROM pf")
def distance_profile(spark, sf_dir):
    """Pooled over two folds, which gives the profile of all rows."""
    rows = _near(spark, sf_dir)
    folds = [profiles.distance_profile(rows.where(F.col("row") % 2 == k), "d", "y", _BANDS) for k in (0, 1)]
    return profiles.pooled_profile(folds[0].unionByName(folds[1])).select("bin", "area", "positive", r6("rate").alias("rate"))


@query("profile_field", f"""WITH {_NEAR}, {_PROFILE}, q AS (SELECT bin, CASE bin WHEN 0 THEN 0 WHEN 1 THEN sqrt(2) WHEN 2 THEN sqrt(8) WHEN 3 THEN sqrt(32) ELSE 12 END AS x, max(rate) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS y FROM pf),
s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY bin) AS x1, lead(y) OVER (ORDER BY bin) AS y1 FROM q)
SELECT r AS "row", c AS col, round(y0 + (y1 - y0) * (d - x0) / (x1 - x0), 6) AS field FROM nn JOIN s ON (d >= x0 AND d < x1) OR (d = 12 AND x1 = 12)""")
def profile_field(spark, sf_dir):
    rows = _near(spark, sf_dir)
    return profiles.profile_field(rows, "d", profiles.distance_profile(rows, "d", "y", _BANDS), _BANDS).select("row", "col", r6("field").alias("field"))


@query("target_strata", f"""WITH {_NEAR}, b AS (SELECT CASE WHEN v >= 0.5 THEN 1 ELSE 0 END AS a, CASE WHEN d >= 4 THEN 2 WHEN d >= 2 THEN 1 ELSE 0 END AS b FROM nn), n AS (SELECT a, b, count(*) * CASE WHEN b = 0 THEN 1.6 ELSE 1 END AS w FROM b GROUP BY a, b)
SELECT a AS a_bin, b AS d_bin, round(w / sum(w) OVER (), 6) AS share FROM n""")
def target_strata(spark, sf_dir):
    return profiles.target_strata(_near(spark, sf_dir), "v", "d", [0.0, 0.5, 1.0], [0.0, 2.0, 4.0, 12.0]).select("a_bin", "d_bin", r6("share").alias("share"))


@query("conditioned", f"""WITH {_NEAR}, k AS (SELECT (r // 72)::INTEGER AS decade, d FROM nn) SELECT decade, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(quantile_cont(d, 0.5), 6) END AS p50, CASE WHEN count(*) >= 30 THEN round(avg(d), 6) END AS mean, CASE WHEN count(*) < 30 THEN 'too few rows' END AS note FROM k GROUP BY decade""")
def conditioned(spark, sf_dir):
    rows = _near(spark, sf_dir).withColumn("decade", (F.col("row") / 72).cast("int"))
    return profiles.conditioned(rows, "decade", "d", 30).select("decade", "n", r6("p50").alias("p50"), r6("mean").alias("mean"), "note")


@query("pure_groups", f"WITH {_NEAR} SELECT r AS \"row\", count(*) AS n, round(avg((d <= 3)::INT), 6) AS purity FROM nn GROUP BY r HAVING avg((d <= 3)::INT) >= 0.5")
def pure_groups(spark, sf_dir):
    rows = _near(spark, sf_dir).withColumn("close", F.col("d") <= 3)
    return profiles.pure_groups(rows, "row", "close", 0.5).select("row", "n", r6("purity").alias("purity"))


@query("calibrated", f"""WITH {_EVENTS}, e AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM click), x AS (SELECT r, c, least(1, greatest(0, (v - lo) / (hi - lo))) AS x FROM click, e), m AS (SELECT avg(x) AS m FROM x)
SELECT r AS "row", c AS col, round(least(1, x * 0.3 / m), 5) AS calibrated FROM x, m""")
def calibrated(spark, sf_dir):
    out = profiles.calibrated(event_cells(spark, sf_dir).where("layer = 'click'"), "value", 0.05, 0.95, 0.3)
    return out.select("row", "col", F.round("calibrated", 5).alias("calibrated"))


# --- metric and resampling ---

_ARMS = """ar AS (SELECT br * 4 + bc AS b, 'soft' AS arm, tp, fp, fn FROM terms UNION ALL SELECT br * 4 + bc, 'half', tp / 2, fp / 2, n_truth - tp / 2 FROM terms)"""


def _arms(spark, sf_dir):
    t = _terms(spark, sf_dir).withColumn("block_id", F.col("br") * 4 + F.col("bc"))
    soft = t.select(F.lit("soft").alias("arm"), "block_id", "tp", "fp", "fn")
    return soft.unionByName(t.select(F.lit("half").alias("arm"), "block_id", (F.col("tp") / 2).alias("tp"), (F.col("fp") / 2).alias("fp"), (F.col("n_truth") - F.col("tp") / 2).alias("fn")))


@query("paired_bootstrap", f"""WITH {_TERMS}, {_ARMS}, ac AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i FROM (SELECT b FROM ar GROUP BY b HAVING sum(tp + fp + fn) > 0)), n AS (SELECT count(*) AS n FROM ac),
pk AS (SELECT d.range AS draw, ('0x' || substr(md5(d.range || ':' || i.range || ':1'), 1, 8))::BIGINT % (SELECT n FROM n) AS i FROM range(100) d, range((SELECT n FROM n)) i),
dr AS (SELECT draw, arm, sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-12) AS d FROM pk JOIN ac USING (i) JOIN ar USING (b) GROUP BY ALL), ld AS (SELECT draw, d AS best FROM dr WHERE arm = 'soft'),
en AS (SELECT arm, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, quantile_cont(best - d, 0.025) AS dl, quantile_cont(best - d, 0.975) AS dh FROM dr JOIN ld USING (draw) GROUP BY arm),
wh AS (SELECT arm, sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * sum(fn) + 1e-12) AS d FROM ar GROUP BY arm)
SELECT arm, round(d, 6) AS dti, round(low, 6) AS low, round(high, 6) AS high, round((SELECT d FROM wh WHERE arm = 'soft') - d, 6) AS delta, round(dl, 6) AS delta_low, round(dh, 6) AS delta_high FROM wh JOIN en USING (arm)""")
def paired_bootstrap(spark, sf_dir):
    out = metric.paired_bootstrap(_arms(spark, sf_dir), "soft", 100)
    return out.select("arm", *[r6(c).alias(c) for c in ("dti", "low", "high", "delta", "delta_low", "delta_high")])


@query("pooled", f"""WITH {_TERMS}, g AS (SELECT br, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(n_truth) AS n FROM terms GROUP BY br UNION ALL SELECT -1, sum(tp), sum(fp), sum(fn), sum(n_truth) FROM terms),
w AS (SELECT *, tp / n AS p, 1.959963985 AS z FROM g WHERE n > 0), x AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM w)
SELECT g.br, round(g.tp / (g.tp + 0.2 * g.fp + 0.8 * g.fn + 1e-12), 6) AS dti, round(coalesce(p, 0), 6) AS recall, round(coalesce(greatest(0, m - h), 0), 6) AS low, round(coalesce(least(1, m + h), 0), 6) AS high FROM g LEFT JOIN x ON x.br = g.br""")
def pooled(spark, sf_dir):
    return metric.pooled(_terms(spark, sf_dir), "br").select(F.coalesce("br", F.lit(-1)).alias("br"), *[r6(c).alias(c) for c in ("dti", "recall", "low", "high")])


@query("surrogate_terms", f"""WITH {_EVENTS}, cv AS (SELECT b.r + dr AS r, b.c + dc AS c, max(1 - sqrt(dr * dr + dc * dc) / 3.0) AS k FROM truth b, range(-3, 4) x(dr), range(-3, 4) y(dc) WHERE dr * dr + dc * dc < 9 GROUP BY ALL),
t AS (SELECT sum(v * k) AS t FROM pred JOIN cv USING (r, c)), m AS (SELECT count(*) AS n, sum(k) AS m FROM truth JOIN cv USING (r, c))
SELECT n AS n_dots, round(t, 6) AS t, round(m, 6) AS m, round(t / (0.2 * (t + n - m) + 0.8 * 500 + 1e-12), 6) AS dti FROM t, m""")
def surrogate_terms(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    return metric.surrogate_terms(truth, prediction, 500.0).select("n_dots", *[r6(c).alias(c) for c in ("t", "m", "dti")])


@query("thinned_scores", f"""WITH {_EVENTS}, u AS (SELECT r, c, v, ('0x' || substr(md5(r || ':' || c || ':1'), 1, 8))::BIGINT / 4294967296.0 AS u FROM pred), sc AS (SELECT unnest([0.1, 0.25, 0.5, 1.0]) AS scale), k AS (SELECT scale, r, c, v FROM u JOIN sc ON u < scale),
fp AS (SELECT scale, count(*) AS n, sum(k.v * (1 - q)) AS fp FROM k JOIN pcredit USING (r, c) GROUP BY scale),
tp AS (SELECT scale, sum(m) AS tp FROM (SELECT scale, tr, tc, max(k.v * near.k) AS m FROM k JOIN near ON pr = r AND pc = c GROUP BY ALL) GROUP BY scale)
SELECT scale, n AS n_dots, round(tp / (tp + 0.2 * fp + 0.8 * ((SELECT count(*) FROM truth) - tp) + 1e-12), 6) AS dti FROM fp JOIN tp USING (scale)""")
def thinned_scores(spark, sf_dir):
    return metric.thinned_scores(*event_roles(spark, sf_dir), [0.1, 0.25, 0.5, 1.0]).select("scale", "n_dots", r6("dti").alias("dti"))


# --- statistics ---

_AVG = lambda part, v: f"rank() OVER (PARTITION BY {part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2"
_PAIRS = f"{_LAYERS}, p AS (SELECT a.layer, a.v AS x, b.v AS y FROM ly a JOIN ly b ON a.r = b.r AND a.c = b.c WHERE b.layer = 0 AND a.layer <> 0)"


@query("correlations", f"""WITH {_PAIRS}, k AS (SELECT *, {_AVG('layer', 'x')} AS a, {_AVG('layer', 'y')} AS b FROM p)
SELECT layer, count(*) AS n, CASE WHEN count(*) >= 3 AND max(x) > min(x) AND max(y) > min(y) THEN round(corr(x, y), 6) END AS pearson, CASE WHEN count(*) >= 3 AND max(x) > min(x) AND max(y) > min(y) THEN round(corr(a, b), 6) END AS spearman FROM k GROUP BY layer""")
def correlations(spark, sf_dir):
    cells = layer_cells(spark, sf_dir)
    pairs = cells.where("layer <> 0").join(cells.where("layer = 0").select("row", "col", F.col("value").alias("y")), ["row", "col"])
    return stats.correlations(pairs, "value", "y", ["layer"]).select("layer", "n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


_BLOCKS = f"""{_EVENTS}, sg AS (SELECT r, c, v FROM ev WHERE layer = 'signup'), vw AS (SELECT r, c, v FROM ev WHERE layer = 'view'), bt AS (SELECT coalesce(sg.r, vw.r) AS r, coalesce(sg.c, vw.c) AS c, coalesce(sg.v, 0) AS a, coalesce(vw.v, 0) AS b FROM sg FULL JOIN vw ON sg.r = vw.r AND sg.c = vw.c),
bl AS (SELECT r // 50 AS block_row, c // 50 AS block_col, count(*) AS n, avg(a * a) AS mse_a, avg(b * b) AS mse_b, avg((a >= 0.4)::INT) AS fpr_a, avg((b >= 0.3)::INT) AS fpr_b FROM bt GROUP BY ALL HAVING count(*) >= 32)"""


def _blocks(spark, sf_dir):
    e = event_cells(spark, sf_dir).where("layer in ('signup', 'view')")
    both = e.groupBy("row", "col").agg(*[F.coalesce(F.max(F.when(F.col("layer") == n, F.col("value"))), F.lit(0.0)).alias(c) for n, c in (("signup", "a"), ("view", "b"))])
    return stats.negative_block_errors(both, "a", "b", (0.4, 0.3))


@query("negative_block_errors", f"WITH {_BLOCKS} SELECT block_row::INTEGER AS block_row, block_col::INTEGER AS block_col, n, round(mse_a, 6) AS mse_a, round(mse_b, 6) AS mse_b, round(fpr_a, 6) AS fpr_a, round(fpr_b, 6) AS fpr_b FROM bl")
def negative_block_errors(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block_row", "block_col", "n", *[r6(c).alias(c) for c in ("mse_a", "mse_b", "fpr_a", "fpr_b")])


@query("independence", f"""WITH {_BLOCKS}, k AS (SELECT *, {_AVG('1', 'mse_a')} AS ra, {_AVG('1', 'mse_b')} AS rb, {_AVG('1', 'fpr_a')} AS qa, {_AVG('1', 'fpr_b')} AS qb FROM bl),
s AS (SELECT count(*) AS n, [abs(corr(mse_a, mse_b)), abs(corr(ra, rb)), abs(corr(fpr_a, fpr_b)), abs(corr(qa, qb))] AS four FROM k), f AS (SELECT n, [x FOR x IN four IF x IS NOT NULL AND NOT isnan(x)] AS four FROM s), g AS (SELECT n, list_max(four) AS m, n >= 20 AND len(four) = 4 AS measured FROM f) SELECT n AS n_blocks, round(m, 5) AS strongest, measured, measured AND m < 0.6 AS allow FROM g""")
def independence(spark, sf_dir):
    return stats.independence(_blocks(spark, sf_dir)).select("n_blocks", F.round("strongest", 5).alias("strongest"), "measured", "allow")


@query("dense_rank", f"WITH {_LAYERS} SELECT layer, r AS \"row\", c AS col, dense_rank() OVER (PARTITION BY layer ORDER BY v)::INTEGER AS dense FROM ly")
def dense_rank(spark, sf_dir):
    return stats.dense_rank_of(layer_cells(spark, sf_dir), "value", ["layer"]).select("layer", "row", "col", "dense")


@query("surface_profile", f"WITH {_LAYERS} SELECT layer, count(*) AS n_finite, count(*) FILTER (v > 0) AS n_positive, round(min(v), 6) AS least, round(max(v), 6) AS most, count(DISTINCT v) AS n_values, count(*) FILTER (v > 0) / 51200 > 0.05 AS dense FROM ly GROUP BY layer")
def surface_profile(spark, sf_dir):
    out = stats.surface_profile(layer_cells(spark, sf_dir), ["layer"], LAYER_GRID.height * LAYER_GRID.width, 0.05)
    return out.select("layer", "n_finite", "n_positive", r6("least").alias("least"), r6("most").alias("most"), "n_values", "dense")


# --- registry ---


@query("direct_coverage", f"WITH {_LAYERS}, n AS (SELECT count(*) AS n FROM cand) SELECT l.layer, round(coalesce(h, 0) / n, 6) AS coverage FROM (SELECT DISTINCT layer FROM reg) l LEFT JOIN (SELECT layer, count(*) AS h FROM reg JOIN cand USING (r, c) GROUP BY layer) USING (layer), n")
def direct_coverage(spark, sf_dir):
    return registry.direct_coverage(*_layers(spark, sf_dir)).select("layer", r6("coverage").alias("coverage"))


@query("blanket", f"WITH {_LAYERS}, n AS (SELECT count(*) AS n FROM cand) SELECT l.layer, round(coalesce(h, 0) / n, 6) AS covered, coalesce(h, 0) / n >= 0.3 AS blanket FROM (SELECT DISTINCT layer FROM reg) l LEFT JOIN (SELECT layer, count(*) AS h FROM hit GROUP BY layer) USING (layer), n")
def blanket(spark, sf_dir):
    return registry.blanket(*_layers(spark, sf_dir), least=0.3).select("layer", r6("covered").alias("covered"), "blanket")


@query("panel_overlap", f"""WITH {_LAYERS}, pn AS (SELECT layer AS candidate, r, c FROM ly WHERE v >= 1.0 AND layer IN (0, 1, 2)), rg AS (SELECT layer, r, c FROM ly WHERE v >= 1.0 AND layer > 2), n AS (SELECT candidate, count(*) AS n FROM pn GROUP BY ALL),
h AS (SELECT DISTINCT candidate, layer, pn.r, pn.c FROM pn JOIN rg ON rg.r BETWEEN pn.r - 3 AND pn.r + 3 AND rg.c BETWEEN pn.c - 3 AND pn.c + 3 WHERE (pn.r - rg.r) ** 2 + (pn.c - rg.c) ** 2 <= 9), g AS (SELECT candidate, layer, count(*) AS h FROM h GROUP BY ALL)
SELECT candidate, layer, round(coalesce(h, 0) / n, 6) AS overlap FROM n CROSS JOIN (SELECT DISTINCT layer FROM rg) LEFT JOIN g USING (candidate, layer)""")
def panel_overlap(spark, sf_dir):
    cells = layer_cells(spark, sf_dir).where("value >= 1.0")
    out = registry.panel_overlap(cells.where("layer <= 2").select(F.col("layer").alias("candidate"), "row", "col"), cells.where("layer > 2").select("layer", "row", "col"))
    return out.select("candidate", "layer", r6("overlap").alias("overlap"))


@query("support_matched", f"""WITH {_LAYERS}, n AS (SELECT count(*) AS n FROM cand), s AS (SELECT layer, count(*) AS m FROM reg GROUP BY layer), o AS (SELECT layer, coalesce(h, 0) / n AS f FROM s LEFT JOIN (SELECT layer, count(*) AS h FROM hit GROUP BY layer) USING (layer), n)
SELECT layer, round(f, 6) AS overlap, m AS n, (m >= n.n / 3 AND m <= n.n * 3) AS matched, least(9, floor(f * 10))::INTEGER AS band FROM s JOIN o USING (layer), n""")
def support_matched(spark, sf_dir):
    candidate, layers = _layers(spark, sf_dir)
    return registry.support_matched(candidate, registry.overlap(candidate, layers), layers).select("layer", r6("overlap").alias("overlap"), "n", "matched", "band")


@query("tied_spearman", f"""WITH {_LAYERS}, gd AS (SELECT a.r::INTEGER AS r, b.c::INTEGER AS c, EXISTS (SELECT 1 FROM cand WHERE cand.r = a.r AND cand.c = b.c)::INT AS x FROM range(400) a(r), range(128) b(c)),
z AS (SELECT l.layer, gd.x, (reg.r IS NOT NULL)::INT AS y FROM gd CROSS JOIN (SELECT DISTINCT layer FROM reg) l LEFT JOIN reg ON reg.layer = l.layer AND reg.r = gd.r AND reg.c = gd.c), k AS (SELECT layer, {_AVG('layer', 'x')} AS a, {_AVG('layer', 'y')} AS b FROM z)
SELECT layer, round(corr(a, b), 6) AS rho FROM k GROUP BY layer""")
def tied_spearman(spark, sf_dir):
    return registry.tied_spearman(*_layers(spark, sf_dir), LAYER_GRID.height * LAYER_GRID.width).select("layer", r6("rho").alias("rho"))


@query("removed_distances", f"""WITH {_EVENTS}, rm AS (SELECT r, c FROM buy WHERE NOT EXISTS (SELECT 1 FROM click WHERE click.r = buy.r AND click.c = buy.c)), d AS (SELECT rm.r, rm.c, sqrt(min((rm.r - k.r) ** 2 + (rm.c - k.c) ** 2)) AS d FROM rm JOIN click k
  ON k.r BETWEEN rm.r - 4 AND rm.r + 4 AND k.c BETWEEN rm.c - 4 AND rm.c + 4 WHERE (rm.r - k.r) ** 2 + (rm.c - k.c) ** 2 <= 16 GROUP BY ALL)
SELECT (SELECT count(*) FROM rm) AS removed, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest, (SELECT count(*) FROM rm) - count(*) AS beyond FROM d""")
def removed_distances(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    return registry.removed_distances(mask_of(e, "purchase"), mask_of(e, "click"), 4).select("removed", r6("nearest").alias("nearest"), r6("farthest").alias("farthest"), "beyond")


@query("merge_rows", """WITH d AS (SELECT sha256(coalesce(text, '')) AS sha256, length(coalesce(text, '')) AS n, source FROM documents) SELECT sha256, max(n) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM d GROUP BY sha256""")
def merge_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.array("source").alias("sources"))
    out = registry.merge_rows(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["n"])
    return out.select("sha256", "n", F.array_join("sources", ",").alias("sources"))


@query("united_aliases", "SELECT sha256(coalesce(text, '')) AS sha256, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY 1")
def united_aliases(spark, sf_dir):
    return registry.united_aliases(table(spark, sf_dir, "documents"), "text", "source").select("sha256", F.array_join("sources", ",").alias("sources"))


_HASHED = "f AS (SELECT 'p' || page_id AS name, sha256(coalesce(html, '')) AS sha256, page_id AS id FROM pages)"


def _files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("name"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"), F.col("page_id").alias("id"))


@query("without_own", f"WITH {_HASHED} SELECT name, sha256 FROM f WHERE sha256 NOT IN (SELECT sha256 FROM f WHERE id % 3 = 0)")
def without_own(spark, sf_dir):
    f = _files(spark, sf_dir)
    return registry.without_own(f, f.where("id % 3 = 0")).select("name", "sha256")


@query("pinned", f"""WITH {_HASHED}, p AS (SELECT name, CASE WHEN id % 5 = 0 THEN sha256(name) ELSE sha256 END AS sha256 FROM f), l AS (SELECT name, sha256 AS h FROM f WHERE id % 7 <> 0)
SELECT name, sha256, CASE WHEN h IS NULL THEN 'missing' WHEN h = sha256 THEN 'ok' ELSE 'changed' END AS state FROM p LEFT JOIN l USING (name)""")
def pinned(spark, sf_dir):
    f = _files(spark, sf_dir)
    pins = f.select("name", F.when(F.col("id") % 5 == 0, F.sha2("name", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return registry.pinned(f.where("id % 7 <> 0"), pins)


@query("delta", f"""WITH {_HASHED}, b AS (SELECT name, sha256 AS x FROM f WHERE id % 4 <> 0), n AS (SELECT name, CASE WHEN id % 5 = 0 THEN 'new' ELSE sha256 END AS y FROM f WHERE id % 6 <> 0)
SELECT name, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'changed' END AS "change" FROM b FULL JOIN n USING (name) WHERE x IS NULL OR y IS NULL OR x <> y""")
def delta(spark, sf_dir):
    f = _files(spark, sf_dir)
    now = f.where("id % 6 <> 0").select("name", F.when(F.col("id") % 5 == 0, "new").otherwise(F.col("sha256")).alias("sha256"))
    return registry.delta(f.where("id % 4 <> 0"), now, "name", "sha256")


@query("within_bytes", """WITH s AS (SELECT page_id, strlen(coalesce(html, '')) AS n FROM pages), o AS (SELECT *, sum(n) OVER (ORDER BY n, page_id ROWS UNBOUNDED PRECEDING) AS run FROM s WHERE n <= 3000) SELECT page_id, n FROM o WHERE run <= 100000""")
def within_bytes(spark, sf_dir):
    sizes = table(spark, sf_dir, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n"))
    return registry.within_bytes(sizes, "page_id", "n", 100_000, 3000)


# --- neighbours, components, splits ---


@query("spacing", f"""WITH {_EVENTS}, d AS (SELECT a.r, a.c, sqrt(min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) AS d FROM buy a JOIN buy b ON (a.r <> b.r OR a.c <> b.c) AND b.r BETWEEN a.r - 6 AND a.r + 6 AND b.c BETWEEN a.c - 6 AND a.c + 6 WHERE (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 36 GROUP BY ALL)
SELECT buy.r AS "row", buy.c AS col, round(d, 6) AS d FROM buy LEFT JOIN d ON d.r = buy.r AND d.c = buy.c""")
def spacing(spark, sf_dir):
    return nearest.spacing(mask_of(event_cells(spark, sf_dir), "purchase"), 6).select("row", "col", r6("d").alias("d"))


@query("nearest_other_component", f"""WITH RECURSIVE {_LABELS}, d AS (SELECT a.r, a.c, a.comp, (a.r - b.r) ** 2 + (a.c - b.c) ** 2 AS d2, b.r AS br, b.c AS bc, b.comp AS o FROM lab a JOIN lab b ON a.comp <> b.comp AND b.r BETWEEN a.r - 8 AND a.r + 8 AND b.c BETWEEN a.c - 8 AND a.c + 8 WHERE (a.r - b.r) ** 2 + (a.c - b.c) ** 2 <= 64)
SELECT r AS "row", c AS col, comp AS comp_id, min(d2)::BIGINT AS d2, arg_min(o, (d2, br, bc)) AS other FROM d GROUP BY ALL""")
def nearest_other_component(spark, sf_dir):
    return nearest.nearest_other_component(label8(spark, sf_dir), 8)


@query("nearest_centroid", f"""WITH RECURSIVE {_LABELS}, s AS (SELECT comp, avg(r) AS cy, avg(c) AS cx, count(*) AS n FROM lab GROUP BY comp HAVING count(*) >= 2), d AS (SELECT p.r, p.c, comp, n, round((p.r - cy) ** 2 + (p.c - cx) ** 2, 6) AS d2 FROM pred p, s)
SELECT r AS "row", c AS col, round(min(d2), 4) AS d2 FROM d GROUP BY r, c""")
def nearest_centroid(spark, sf_dir):
    table_ = components.segment_table(label8(spark, sf_dir)).where("n >= 2")
    return nearest.nearest_centroid(event_roles(spark, sf_dir)[1].select("row", "col"), table_, "comp_id", "n").select("row", "col", r4("d2").alias("d2"))


@query("systems_by_dilation", f"""WITH RECURSIVE {_EVENTS}, one AS (SELECT DISTINCT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c FROM truth, range(-1, 2) x(dr), range(-1, 2) y(dc) WHERE r + dr BETWEEN 0 AND 719 AND c + dc BETWEEN 0 AND 255),
lk AS (SELECT a.r * 256 + a.c AS a, b.r * 256 + b.c AS b FROM one a JOIN one b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1), reach AS (SELECT a, b FROM lk WHERE (a // 256, a % 256) IN (SELECT (r, c) FROM truth) UNION SELECT reach.a, lk.b FROM reach JOIN lk ON reach.b = lk.a)
SELECT (a // 256)::INTEGER AS "row", (a % 256)::INTEGER AS col, min(b)::BIGINT AS comp_id FROM reach GROUP BY a""")
def systems_by_dilation(spark, sf_dir):
    return components.systems_by_dilation(event_roles(spark, sf_dir)[0], EVENT_GRID, 1)


@query("whole_segments", f"""WITH RECURSIVE {_LABELS}, s AS (SELECT comp, count(*) AS n, min(r // 48) AS a, max(r // 48) AS z, min(c // 48) AS b, max(c // 48) AS y FROM lab GROUP BY comp), bad AS (SELECT DISTINCT comp FROM lab JOIN err ON err.r = lab.r AND err.c = lab.c)
SELECT comp AS comp_id, n, a::INTEGER AS block_row, b::INTEGER AS block_col FROM s WHERE a = z AND b = y AND comp NOT IN (SELECT comp FROM bad) ORDER BY comp LIMIT 300""")
def whole_segments(spark, sf_dir):
    return split.whole_segments(label8(spark, sf_dir), 48, mask_of(event_cells(spark, sf_dir), "error"), 300)


@query("label_blind_folds", f"""WITH RECURSIVE {_LABELS}, m AS (SELECT trunc(quantile_cont(r, 0.5)) AS mr, trunc(quantile_cont(c, 0.5)) AS mc FROM buy), qd AS (SELECT r, c, (2 * (r >= mr)::INT + (c >= mc)::INT)::INTEGER AS q FROM buy, m),
mt AS (SELECT DISTINCT comp, q FROM lab JOIN qd USING (r, c)), hd AS (SELECT q, r, c FROM lab JOIN mt USING (comp)), cl AS (SELECT q, r, c FROM hd UNION SELECT q, r, c FROM qd)
SELECT f.q AS fold, b.r AS "row", b.c AS col, CASE WHEN hd.q IS NOT NULL THEN 'held' WHEN qd.q IS NOT NULL THEN 'region'
  WHEN EXISTS (SELECT 1 FROM cl WHERE cl.q = f.q AND cl.r BETWEEN b.r - 5 AND b.r + 5 AND cl.c BETWEEN b.c - 5 AND b.c + 5 AND (cl.r - b.r) ** 2 + (cl.c - b.c) ** 2 <= 25) THEN 'buffer' ELSE 'train' END AS "role"
FROM buy b CROSS JOIN (SELECT DISTINCT q FROM qd) f LEFT JOIN hd ON hd.q = f.q AND hd.r = b.r AND hd.c = b.c LEFT JOIN qd ON qd.q = f.q AND qd.r = b.r AND qd.c = b.c""")
def label_blind_folds(spark, sf_dir):
    buy = mask_of(event_cells(spark, sf_dir), "purchase")
    return split.label_blind_folds(label8(spark, sf_dir), split.quadrants(buy), 5.0, buy)


@query("eroded_domains", f"""WITH {_EVENTS}, ft AS (SELECT DISTINCT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c FROM buy, range(-3, 4) x(dr), range(-3, 4) y(dc) WHERE dr * dr + dc * dc <= 9 AND {_ON.replace('r BETWEEN', 'r + dr BETWEEN').replace('c BETWEEN', 'c + dc BETWEEN')}),
m AS (SELECT trunc(quantile_cont(r, 0.5)) AS mr, trunc(quantile_cont(c, 0.5)) AS mc FROM ft), q AS (SELECT r, c, (2 * (r >= mr)::INT + (c >= mc)::INT)::INTEGER AS q FROM ft, m),
er AS (SELECT a.q, a.r, a.c FROM q a JOIN q b ON a.q = b.q AND abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY ALL HAVING count(*) = 5) SELECT q AS fold, er.r AS "row", er.c AS col, EXISTS (SELECT 1 FROM truth t WHERE t.r = er.r AND t.c = er.c) AS is_truth FROM er""")
def eroded_domains(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    foot = stencil.dilate(mask_of(e, "purchase"), stencil.disk_offsets(3), EVENT_GRID)
    return split.eroded_domains(foot, event_roles(spark, sf_dir)[0], EVENT_GRID, 1)


@query("block_folds", f'WITH {_EVENTS} SELECT r AS "row", c AS col, ((r // 48 * 6 + c // 48) % 4)::INTEGER AS fold FROM buy')
def block_folds(spark, sf_dir):
    return split.block_folds(mask_of(event_cells(spark, sf_dir), "purchase"), 48, 6)


@query("matched_removal", f"WITH {_EVENTS}, k AS (SELECT r, c, row_number() OVER (ORDER BY md5(r || ':' || c || ':4'), r, c) AS k FROM buy) SELECT r AS \"row\", c AS col FROM k WHERE k > 100")
def matched_removal(spark, sf_dir):
    return split.matched_removal(mask_of(event_cells(spark, sf_dir), "purchase"), 100, 4)


@query("hide_and_recover", f"""WITH RECURSIVE {_LABELS}, m AS (SELECT trunc(quantile_cont(r, 0.5)) AS mr, trunc(quantile_cont(c, 0.5)) AS mc FROM buy), qc AS (SELECT comp, (2 * (r >= mr)::INT + (c >= mc)::INT)::INTEGER AS q, count(*) AS n FROM lab, m GROUP BY ALL),
hm AS (SELECT comp, arg_max(q, (n, -q)) AS q, sum(n) AS n FROM qc GROUP BY comp), md AS (SELECT 'all' AS mode, comp FROM hm UNION ALL SELECT 'long', comp FROM hm WHERE n >= 2), sd AS (SELECT unnest([3, 4]) AS seed),
o AS (SELECT mode, seed, q, comp, n, sum(n) OVER (PARTITION BY mode, seed, q ORDER BY md5(comp || ':' || seed), comp ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY mode, seed, q) AS t FROM hm JOIN md USING (comp), sd),
x AS (SELECT mode, seed, q, r, c, run - n < 0.2 * t AS hid FROM o JOIN lab USING (comp))
SELECT mode || ':' || seed || ':' || q AS fold_key, r AS "row", c AS col, CASE WHEN hid THEN 'hidden' WHEN EXISTS (SELECT 1 FROM x h WHERE h.hid AND h.mode = x.mode AND h.seed = x.seed AND h.q = x.q AND h.r BETWEEN x.r - 3 AND x.r + 3 AND h.c BETWEEN x.c - 3 AND x.c + 3
  AND (h.r - x.r) ** 2 + (h.c - x.c) ** 2 <= 9) THEN 'collar' ELSE 'visible' END AS "role" FROM x""")
def hide_and_recover(spark, sf_dir):
    from rastra.storage import stage_table

    labelled = stage_table(label8(spark, sf_dir), "labels")
    sizes = labelled.groupBy("comp_id").agg(F.count("*").alias("n"))
    quads = split.quadrants(mask_of(event_cells(spark, sf_dir), "purchase"))
    return split.hide_and_recover(labelled, quads, 0.2, 3.0, [3, 4], {"all": sizes, "long": sizes.where("n >= 2")})


@query("candidates", f"""WITH {_EVENTS}, k AS (SELECT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c, sum(v * (1 - sqrt(dr * dr + dc * dc) / 3.0)) AS k FROM click, range(-3, 4) x(dr), range(-3, 4) y(dc) WHERE dr * dr + dc * dc < 9 AND r + dr BETWEEN 0 AND 719 AND c + dc BETWEEN 0 AND 255 GROUP BY ALL)
SELECT r AS "row", c AS col, round(k, 6) AS credit FROM (SELECT r, c, round(k, 9) AS k FROM k) WHERE k >= 0.5""")
def candidates(spark, sf_dir):
    credit = stencil.kernel_sum(event_cells(spark, sf_dir).where("layer = 'click'"), EVENT_GRID).select("row", "col", F.round("value", 9).alias("credit"))
    millionths = F.round(F.col("credit") * 1e6)  # of nine decimals rounded before, so ties are common: cut as SQL cuts them
    return allocate.candidates(credit, 0.5).select("row", "col", (millionths / 1e6).alias("credit"))


@query("laplacian", f"""WITH {_DENSE} SELECT r AS "row", c AS col, round(coalesce(lag(v) OVER a, v) + coalesce(lead(v) OVER a, v) + coalesce(lag(v) OVER b, v) + coalesce(lead(v) OVER b, v) - 4 * v, 4) + 0.0 AS laplacian, round(sqrt(gr * gr + gc * gc), 5) AS slope
FROM gr WINDOW a AS (PARTITION BY c ORDER BY r), b AS (PARTITION BY r ORDER BY c)""")
def laplacian(spark, sf_dir):
    return tensor.laplacian(_dense(spark, sf_dir)).select("row", "col", r4("laplacian").alias("laplacian"), F.round("slope", 5).alias("slope"))


@query("erosion_tips", f"""WITH {_EVENTS}, bg AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM buy, range(-1, 2) x(dr), range(-1, 2) y(dc) WHERE r + dr BETWEEN 0 AND 719 AND c + dc BETWEEN 0 AND 255), er AS (SELECT a.r, a.c FROM bg a JOIN bg b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL HAVING count(*) = 9)
SELECT r::INTEGER AS "row", c::INTEGER AS col FROM bg WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.r = bg.r AND er.c = bg.c)""")
def erosion_tips(spark, sf_dir):
    grown = stencil.dilate(mask_of(event_cells(spark, sf_dir), "purchase"), stencil.square_offsets(1), EVENT_GRID)
    return masks.mask_and_not(grown, stencil.erode(grown, stencil.square_offsets(1), EVENT_GRID))


@query("distance_kernel", f"""WITH {_EVENTS} SELECT (r + dr)::INTEGER AS "row", (c + dc)::INTEGER AS col, round(sum(1 - sqrt(dr * dr + dc * dc) / 8.0), 5) AS "value" FROM buy, range(-8, 9) x(dr), range(-8, 9) y(dc) WHERE dr * dr + dc * dc < 64 AND r + dr BETWEEN 0 AND 719 AND c + dc BETWEEN 0 AND 255 GROUP BY ALL""")
def distance_kernel(spark, sf_dir):
    ones = mask_of(event_cells(spark, sf_dir), "purchase").withColumn("value", F.lit(1.0))
    return stencil.kernel_sum(ones, EVENT_GRID, 8.0).select("row", "col", F.round("value", 5).alias("value"))


@query("trace_ids", f'WITH {_PIXELS} SELECT r AS "row", c AS col, max(k) AS row_no FROM px GROUP BY r, c')
def trace_ids(spark, sf_dir):
    return vector.trace_ids(order_traces(spark, sf_dir), _trace_grid())


@query("sense_counts", f"""WITH {_PIXELS}, sn AS (SELECT r, c, arg_max(CASE sense WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '5' THEN 3 END, k)::INTEGER AS code FROM px WHERE sense IN ('1', '2', '5') GROUP BY r, c) SELECT code, count(*) AS n FROM sn GROUP BY code""")
def sense_counts(spark, sf_dir):
    return vector.sense_raster(order_traces(spark, sf_dir), _trace_grid(), {"1": 1, "2": 2, "5": 3}).groupBy("code").agg(F.count("*").alias("n"))


@query("proxy_truth", f"""WITH {_EVENTS}, vw AS (SELECT r, c FROM ev WHERE layer = 'view'), ft AS (SELECT DISTINCT r + dr AS r, c + dc AS c FROM buy, range(-3, 4) x(dr), range(-3, 4) y(dc) WHERE dr * dr + dc * dc <= 9) SELECT r AS "row", c AS col FROM vw WHERE NOT EXISTS (SELECT 1 FROM err WHERE err.r = vw.r AND err.c = vw.c)
AND EXISTS (SELECT 1 FROM ft WHERE ft.r = vw.r AND ft.c = vw.c)""")
def proxy_truth(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    foot = stencil.dilate(mask_of(e, "purchase"), stencil.disk_offsets(3), EVENT_GRID)
    return masks.mask_and(masks.mask_and_not(mask_of(e, "view"), mask_of(e, "error")), foot)


# --- sources ---

_FEED = """t AS (SELECT page_id, '<table><tr><td>1<td>x<td>ann<td>0.' || lpad((9000 - page_id % 100)::VARCHAR, 4, '0') || '<tr><td>#2<td>y<td>bob<td>0.' || lpad((5000 - page_id % 50)::VARCHAR, 4, '0') || '<tr><td>note<td>z</table>' AS html FROM pages)"""


@query("leaderboard", f"""WITH {_FEED} SELECT page_id, 1 AS "rank", 'ann' AS participant, (9000 - page_id % 100) / 10000 AS score FROM t UNION ALL SELECT page_id, 2, 'bob', (5000 - page_id % 50) / 10000 FROM t""")
def leaderboard(spark, sf_dir):
    """The parser on a table of made-up leaderboard pages, as the test pages hold no table."""
    number = lambda n, m: F.lpad((F.lit(n) - F.col("page_id") % m).cast("string"), 4, "0")
    html = F.concat(F.lit("<table><tr><td>1<td>x<td>ann<td>0."), number(9000, 100), F.lit("<tr><td>#2<td>y<td>bob<td>0."), number(5000, 50), F.lit("<tr><td>note<td>z</table>"))
    return feeds.leaderboard(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


@query("owner_reports", r"""WITH l AS (SELECT conv_id AS k, turn AS n, CASE WHEN turn % 3 = 0 THEN 'see https://x.github.io/r' || (conv_id % 7) || '/' WHEN turn % 3 = 1 THEN ' f' || (turn % 4) || '.tif: 0.5' || turn ELSE 'chat' END AS line FROM conversations),
c AS (SELECT *, last_value(nullif(regexp_extract(line, 'github\.io/([^/\s)]+)', 1), '') IGNORE NULLS) OVER (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING) AS repo FROM l)
SELECT DISTINCT k, repo, regexp_extract(line, '^\s*([^\s:]+):\s*(0\.\d+)?\s*$', 1) AS file, nullif(regexp_extract(line, '^\s*([^\s:]+):\s*(0\.\d+)?\s*$', 2), '')::DOUBLE AS score FROM c WHERE repo IS NOT NULL AND regexp_matches(line, '^\s*([^\s:]+):\s*(0\.\d+)?\s*$')""")
def owner_reports(spark, sf_dir):
    t = F.col("turn")
    line = F.when(t % 3 == 0, F.concat(F.lit("see https://x.github.io/r"), F.col("conv_id") % 7, F.lit("/"))).when(t % 3 == 1, F.concat(F.lit(" f"), t % 4, F.lit(".tif: 0.5"), t)).otherwise("chat")
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), t.alias("n"), line.alias("line"))
    return feeds.owner_reports(lines, "k", "n", "line", "github\\.io/")


@query("parts_check", """WITH p AS (SELECT conv_id AS k, turn AS n, coalesce(text, '') AS t FROM conversations) SELECT k, count(*) AS parts, sum(strlen(t))::BIGINT AS bytes, sha256(string_agg(t, '' ORDER BY n)) AS sha256 FROM p GROUP BY k""")
def parts_check(spark, sf_dir):
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("n"), F.coalesce("text", F.lit("")).alias("t"))
    return feeds.assembled(parts, "k", "n", "t")


@query("layer_union", f'WITH {_EVENTS} SELECT r AS "row", c AS col, arg_min(layer, CASE layer WHEN \'purchase\' THEN 0 WHEN \'click\' THEN 1 ELSE 2 END) AS source FROM ev WHERE layer IN (\'purchase\', \'click\', \'error\') GROUP BY r, c')
def layer_union(spark, sf_dir):
    e = event_cells(spark, sf_dir)
    return masks.priority_overlay([(n, mask_of(e, n)) for n in ("purchase", "click", "error")])


@query("footprint", f"WITH {_LAYERS}, cr AS (SELECT 1) SELECT count(*) AS cells, count(*) FILTER (EXISTS (SELECT 1 FROM ly WHERE ly.layer = 0 AND ly.r = g.r AND ly.c = g.c)) AS inside FROM (SELECT a.r, b.c FROM range(400) a(r), range(128) b(c)) g")
def footprint(spark, sf_dir):
    foot = masks.footprint(layer_cells(spark, sf_dir).where("layer = 0"))
    every = cells_in(LAYER_GRID, spark).join(foot.withColumn("_in", F.lit(1)), ["row", "col"], "left")
    return every.agg(F.count("*").alias("cells"), F.count("_in").alias("inside"))

"""Registered queries of allocation in order, two-component frames, orientation fields and fits, and their SQL.

What depends on an order is a recursive query here: one candidate after the other, where Spark works in rounds or by fold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rastra.grid import EVENT_GRID, LAYER_GRID, cells_in, event_cells, event_roles, layer_cells, table
from rastra.operators import allocate, components, crossfit, features, fields, fits, frames, metric, nearest, portfolio, registry, stats, stencil, tensor
from rastra.plans.more import _AVG, _NEAR, _PAIRS, ORACLE_SQL, QUERIES, _near, query
from rastra.plans.queries import _EVENTS, _GEOMETRY, _LABELS, _LAYERS, _mirror, label8, r4, r6
from rastra.sources import sink
from rastra.storage import new_path, remove_path

__all__ = ["ORACLE_SQL", "QUERIES"]  # all modules' queries


# --- allocation in order ---

#: Candidates of a fold by falling credit (rounded, so that the order of sums decides nothing), each with the cells it can cover.
_CANDIDATES = lambda floor: f"""{_EVENTS},
k AS (SELECT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c, round(sum(v * (1 - sqrt(dr * dr + dc * dc) / 3.0)), 9) AS credit FROM click, range(-3, 4) x(dr), range(-3, 4) y(dc)
  WHERE dr * dr + dc * dc < 9 AND r + dr BETWEEN 0 AND 719 AND c + dc BETWEEN 0 AND 255 GROUP BY ALL),
f AS (SELECT (r // 180 * 4 + c // 64)::INTEGER AS fold, r, c, credit FROM k),
cand AS (SELECT fold, r, c, credit, least(1.0, credit) AS own, row_number() OVER (PARTITION BY fold ORDER BY credit DESC, r, c) AS i FROM f WHERE credit >= {floor}),
nb AS (
  SELECT a.fold, a.i, list({{'r': p.r, 'c': p.c, 'p': p.v, 'k': 1 - sqrt((a.r - p.r) ** 2 + (a.c - p.c) ** 2) / 3.0}} ORDER BY p.r, p.c) AS nb
  FROM cand a JOIN click p ON p.r BETWEEN a.r - 3 AND a.r + 3 AND p.c BETWEEN a.c - 3 AND a.c + 3 AND p.r // 180 = a.r // 180 AND p.c // 64 = a.c // 64
  WHERE (a.r - p.r) ** 2 + (a.c - p.c) ** 2 < 9 GROUP BY a.fold, a.i),
cn AS MATERIALIZED (SELECT cand.*, coalesce(nb, []) AS nb FROM cand LEFT JOIN nb USING (fold, i))"""  # noqa: E731
#: What a candidate cn adds to the credit that the dots s.acc cover.
_GAIN = """coalesce(list_sum([x.p * greatest(0, x.k - coalesce(list_max([1 - sqrt((a.r - x.r) ** 2 + (a.c - x.c) ** 2) / 3.0
  FOR a IN s.acc IF abs(a.r - x.r) < 3 AND abs(a.c - x.c) < 3]), 0)) FOR x IN cn.nb]), 0)"""


def _candidates(spark, sf_dir):
    click = event_cells(spark, sf_dir).where("layer = 'click'").select("row", "col", "value")
    credit = stencil.kernel_sum(click, EVENT_GRID).select("row", "col", F.round("value", 9).alias("credit"))
    fold = (F.col("row") / 180).cast("int") * 4 + (F.col("col") / 64).cast("int")
    return credit.join(click, ["row", "col"], "left").fillna(0.0, ["value"]).withColumn("fold", fold)


_PASS = f"""WITH RECURSIVE {_CANDIDATES(0)},
s(fold, i, t, m, n, miss, ended, acc) USING KEY (fold) AS (
  SELECT DISTINCT fold, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, 0::BIGINT, false, []::STRUCT(r INTEGER, c INTEGER)[] FROM cand
  UNION ALL
  SELECT fold, i, CASE WHEN yes THEN t + gain ELSE t END, CASE WHEN yes THEN m + own ELSE m END, n + yes::INTEGER, CASE WHEN yes OR n = 0 THEN 0 ELSE miss + 1 END,
    NOT yes AND (CASE WHEN n = 0 THEN 0 ELSE miss + 1 END) >= $PATIENCE, CASE WHEN yes THEN list_append(acc, {{'r': r, 'c': c}}) ELSE acc END
  FROM (
    SELECT *, CASE WHEN n = 0 THEN gain > 0 ELSE (t + gain) / (0.2 * (t + gain + n + 1 - m - own) + 0.8 * 120.0 + 1e-12) > t / (0.2 * (t + n - m) + 0.8 * 120.0 + 1e-12) END AS yes
    FROM (SELECT s.fold, cn.i, s.t, s.m, s.n, s.miss, s.acc, cn.r, cn.c, cn.own, {_GAIN} AS gain FROM s JOIN cn ON cn.fold = s.fold AND cn.i = s.i + 1 WHERE NOT s.ended)))
SELECT fold, unnest(acc).r AS "row", unnest(acc).c AS col, unnest(range(1, n + 1))::INTEGER AS rank FROM s"""


@query("single_pass", _PASS.replace("$PATIENCE", "1"))
def single_pass(spark, sf_dir):
    return allocate.marginal_pass(_candidates(spark, sf_dir), "fold", 120.0)


@query("patient_pass", _PASS.replace("$PATIENCE", "40"))
def patient_pass(spark, sf_dir):
    return allocate.marginal_pass(_candidates(spark, sf_dir), "fold", 120.0, patience=40)


_BAR = "(0.2 * t / (0.2 * (t + n - m) + 0.8 * 120.0 + 1e-12)) / (1 - 0.2 * t / (0.2 * (t + n - m) + 0.8 * 120.0 + 1e-12))"


@query("greedy_rounds", f"""WITH RECURSIVE {_CANDIDATES(0.02)}, al AS (SELECT fold, list(credit ORDER BY i) AS upper, list(own ORDER BY i) AS own, list({{'r': r, 'c': c}} ORDER BY i) AS spot FROM cand GROUP BY fold),
s(fold, t, m, n, round, todo, fresh, upper, open, acc, taken) USING KEY (fold) AS (
  SELECT fold, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, 0::INTEGER, []::BIGINT[], true, upper, [true FOR x IN upper], []::STRUCT(r INTEGER, c INTEGER, round INTEGER)[], []::BIGINT[] FROM al
  UNION ALL (
  SELECT fold, t, m, n, round, todo, fresh, upper, open, acc, taken FROM (
    -- a new round: the open candidates whose last known credit exceeds the bar
    SELECT s.fold, t, m, n, round + 1 AS round, [i FOR i IN range(1, len(s.upper) + 1) IF open[i] AND s.upper[i] > {_BAR} * (1 - al.own[i])] AS todo, false AS fresh, s.upper, open, acc, taken
    FROM s JOIN al USING (fold) WHERE len(todo) = 0 AND fresh AND round < 400)
  WHERE len(todo) > 0
  UNION ALL
  SELECT fold, CASE WHEN yes THEN t + gain ELSE t END, CASE WHEN yes THEN m + own ELSE m END, n + yes::INTEGER, round, todo[2:], fresh OR yes,
    CASE WHEN seen THEN upper ELSE upper[:i - 1] || [gain] || upper[i + 1:] END,
    CASE WHEN yes THEN [(open[j] OR (abs(spot[j].r - r) <= 6 AND abs(spot[j].c - c) <= 6)) AND j <> i FOR j IN range(1, len(open) + 1)] ELSE open[:i - 1] || [false] || open[i + 1:] END,
    CASE WHEN yes THEN list_append(acc, {{'r': r, 'c': c, 'round': round}}) ELSE acc END, CASE WHEN yes THEN list_append(taken, i) ELSE taken END
  FROM (
    SELECT *, NOT seen AND gain > {_BAR} * (1 - own) AS yes
    FROM (SELECT s.*, cn.i, cn.r, cn.c, cn.own, spot, list_contains(s.taken, cn.i) AS seen, {_GAIN} AS gain FROM s JOIN cn ON cn.fold = s.fold AND cn.i = s.todo[1] JOIN al ON al.fold = s.fold))))
SELECT fold, unnest(acc).r AS "row", unnest(acc).c AS col, unnest(range(1, n + 1))::INTEGER AS rank, unnest(acc).round AS round FROM s""")
def greedy_rounds(spark, sf_dir):
    return allocate.greedy_rounds(_candidates(spark, sf_dir), "fold", 120.0)


#: Cells in an order i, with a stratum and its quota, chosen one by one.
_FILL = """s(one, i, acc) USING KEY (one) AS (
  SELECT 1, 0::BIGINT, []::STRUCT(s INTEGER, r INTEGER, c INTEGER, v DOUBLE)[]
  UNION ALL
  SELECT 1, o.i, CASE WHEN len([a FOR a IN s.acc IF (a.r - o.r) ** 2 + (a.c - o.c) ** 2 <= 9]) = 0 AND len([a FOR a IN s.acc IF a.s = o.s]) < o.quota
    THEN list_append(s.acc, {'s': o.s, 'r': o.r, 'c': o.c, 'v': o.v}) ELSE s.acc END
  FROM s JOIN o ON o.i = s.i + 1)"""


@query("spaced_order", f"""WITH RECURSIVE {_EVENTS}, o AS MATERIALIZED (SELECT 0 AS s, r, c, v, 1000000 AS quota, row_number() OVER (ORDER BY v DESC, r, c) AS i FROM click), {_FILL}
SELECT unnest(acc).r AS "row", unnest(acc).c AS col, round(unnest(acc).v, 6) AS value FROM s""")
def spaced_order(spark, sf_dir):
    return allocate.spaced(event_cells(spark, sf_dir).where("layer = 'click'"), 3.0).select("row", "col", F.round("value", 6).alias("value"))


#: Strata: the quadrant of the offset to the nearest truth cell, and the class of the distance; quotas by their values' sums.
_STRATA = f"""{_NEAR},
w AS (SELECT p.r, p.c, p.v, min({{'d2': (p.r - t.r) ** 2 + (p.c - t.c) ** 2, 'r': t.r, 'c': t.c}}) AS m
  FROM pred p JOIN truth t ON t.r BETWEEN p.r - 12 AND p.r + 12 AND t.c BETWEEN p.c - 12 AND p.c + 12 WHERE (p.r - t.r) ** 2 + (p.c - t.c) ** 2 <= 144 GROUP BY ALL),
st AS (SELECT r, c, v, (((r >= m.r)::INTEGER * 2 + (c >= m.c)::INTEGER) * 3 + (m.d2 >= 4)::INTEGER + (m.d2 >= 25)::INTEGER)::INTEGER AS s FROM w),
q0 AS (SELECT s, sum(v) / sum(sum(v)) OVER () * 150 AS x FROM st GROUP BY s), q1 AS (SELECT s, floor(x) AS f, round(x - floor(x), 9) AS m FROM q0),
q AS (SELECT s, f + (row_number() OVER (ORDER BY m DESC, s) <= 150 - sum(f) OVER ())::INTEGER AS quota FROM q1),
o AS MATERIALIZED (SELECT s, r, c, v, quota, row_number() OVER (ORDER BY s, v DESC, r, c) AS i FROM st JOIN q USING (s))"""


@query("stratified_fill", f"""WITH RECURSIVE {_STRATA}, {_FILL} SELECT unnest(acc).s AS stratum, unnest(acc).r AS "row", unnest(acc).c AS col, round(unnest(acc).v, 6) AS value FROM s""")
def stratified_fill(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    near = nearest.nearest_within(prediction, truth, 12)
    quadrant = (F.col("row") >= F.col("near_row")).cast("int") * 2 + (F.col("col") >= F.col("near_col")).cast("int")
    cells = near.withColumn("stratum", quadrant * 3 + (F.col("d2") >= 4).cast("int") + (F.col("d2") >= 25).cast("int"))
    quota = allocate.quotas(cells.groupBy("stratum").agg(F.sum("value").alias("w")), "stratum", "w", 150)
    return allocate.stratified_fill(cells, "stratum", quota, 3.0).select("stratum", "row", "col", F.round("value", 6).alias("value"))


# --- frames of two components ---

#: For every cell of `of`: the nearest labelled cell, and the nearest one of another component.
_FRAME = lambda of: f"""fr0 AS (SELECT p.r, p.c, l.r AS lr, l.c AS lc, comp, ((p.r - l.r) ** 2 + (p.c - l.c) ** 2)::BIGINT AS d2 FROM {of} p, lab l),
fr1 AS (SELECT r, c, min({{'d2': d2, 'r': lr, 'c': lc, 'k': comp}}) AS one FROM fr0 GROUP BY r, c),
fr2 AS (SELECT a.r, a.c, any_value(one) AS one, min({{'d2': d2, 'r': lr, 'c': lc, 'k': comp}}) FILTER (comp <> one.k) AS two FROM fr0 a JOIN fr1 USING (r, c) GROUP BY a.r, a.c)"""  # noqa: E731


@query("component_frame", f"""WITH RECURSIVE {_LABELS}, {_FRAME("pred")}
SELECT r AS "row", c AS col, one.d2 AS d2_1, one.r::BIGINT AS near_row_1, one.c::BIGINT AS near_col_1, one.k AS comp_1, two.d2 AS d2_2, two.r::BIGINT AS near_row_2, two.c::BIGINT AS near_col_2, two.k AS comp_2 FROM fr2""")
def component_frame(spark, sf_dir):
    whole = frames.component_frame(label8(spark, sf_dir), EVENT_GRID)
    return whole.join(event_roles(spark, sf_dir)[1].select("row", "col"), ["row", "col"])


@query("k_nearest", f"""WITH {_EVENTS}, d AS (SELECT p.r, p.c, t.r AS tr, t.c AS tc, ((p.r - t.r) ** 2 + (p.c - t.c) ** 2)::BIGINT AS d2 FROM pred p, truth t),
k AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d2, tr, tc)::INTEGER AS place FROM d)
SELECT r AS "row", c AS col, place, d2, tr AS near_row, tc AS near_col FROM k WHERE place <= 5""")
def k_nearest(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    return frames.k_nearest(prediction, truth, 5, EVENT_GRID, first=4)


#: Strikes of two masks over the event grid, both by the structure tensor: the rows of _GEOMETRY's chain, with names of their own.
def _strikes(mask: str, name: str, sigma: int = 3) -> str:
    return f"""{_mirror(f"(SELECT r, c, 1.0 AS v FROM {mask})", 1, ["v"], f"{name}sm")}, {name}gd AS (SELECT a.r::INTEGER AS r, b.c::INTEGER AS c FROM range(720) a(r), range(256) b(c)),
{name}dn AS (SELECT g.r, g.c, coalesce(v, 0) AS v FROM {name}gd g LEFT JOIN {name}sm m ON m.r = g.r AND m.c = g.c),
{name}gr AS (SELECT r, c, CASE WHEN r = 0 THEN lead(v) OVER a - v WHEN r = 719 THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END AS y,
  CASE WHEN c = 0 THEN lead(v) OVER b - v WHEN c = 255 THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END AS x FROM {name}dn WINDOW a AS (PARTITION BY c ORDER BY r), b AS (PARTITION BY r ORDER BY c)),
{name}pr AS (SELECT r, c, y * y AS yy, x * x AS xx, x * y AS xy FROM {name}gr WHERE y <> 0 OR x <> 0), {_mirror(f"{name}pr", sigma, ["yy", "xx", "xy"], f"{name}js")},
{name}st AS (SELECT r, c, round(xx - yy, 12) AS d, round(2 * xy, 12) AS e, xx + yy AS t FROM {name}js j WHERE EXISTS (SELECT 1 FROM {mask} m WHERE m.r = j.r AND m.c = j.c)),
{name} AS (SELECT r, c, sqrt(d * d + e * e) / greatest(t, 1e-12) AS coh, (degrees(atan2(round(cos(atan2(e, d) / 2 + pi() / 2), 12), -sin(atan2(e, d) / 2 + pi() / 2))) + 360) % 180 AS s FROM {name}st)"""


_AXIAL = lambda a, b: f"least(abs({a} - {b}) % 180, 180 - abs({a} - {b}) % 180)"


@query("strike_against_null", f"""WITH RECURSIVE {_EVENTS}, one AS (SELECT r, c FROM truth), lk AS (SELECT a.r * 256 + a.c AS a, b.r * 256 + b.c AS b FROM one a JOIN one b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1),
reach AS (SELECT a, b FROM lk UNION SELECT reach.a, lk.b FROM reach JOIN lk ON reach.b = lk.a), lab AS (SELECT (a // 256)::INTEGER AS r, (a % 256)::INTEGER AS c, min(b)::BIGINT AS comp FROM reach GROUP BY a),
{_strikes("err", "sh")}, {_strikes("truth", "sv")},
hn AS (SELECT h.r, h.c, min({{'d2': (h.r - t.r) ** 2 + (h.c - t.c) ** 2, 'r': t.r, 'c': t.c}}) AS m FROM err h, truth t GROUP BY h.r, h.c),
ha AS (SELECT {_AXIAL("sh.s", "sv.s")} AS angle FROM hn JOIN sh USING (r, c) JOIN sv ON sv.r = m.r AND sv.c = m.c WHERE sh.coh > 0.2 AND sv.coh > 0.2),
nk AS (SELECT a.r, a.c, a.comp, b.r AS br, b.c AS bc, b.comp AS other, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.r - b.r) ** 2 + (a.c - b.c) ** 2, b.r, b.c) AS k FROM lab a, lab b QUALIFY k <= 13),
nf AS (SELECT r, c, br, bc FROM nk WHERE other <> comp QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY k) = 1),
na AS (SELECT {_AXIAL("x.s", "y.s")} AS angle FROM nf JOIN sv x USING (r, c) JOIN sv y ON y.r = br AND y.c = bc WHERE x.coh > 0.2 AND y.coh > 0.2),
h AS (SELECT least(8, floor(round(angle, 9) / 10))::INTEGER AS bin, count(*) AS n FROM ha GROUP BY bin), n AS (SELECT least(8, floor(round(angle, 9) / 10))::INTEGER AS bin, count(*) AS n FROM na GROUP BY bin),
t AS (SELECT i::INTEGER AS bin, coalesce(h.n, 0) AS a, coalesce(n.n, 0) AS b FROM range(9) x(i) LEFT JOIN h ON h.bin = i LEFT JOIN n ON n.bin = i)
SELECT bin, a::BIGINT AS n_hidden, b::BIGINT AS n_null, round(CASE WHEN b > 0 THEN a / greatest(sum(a) OVER (), 1) / (b / greatest(sum(b) OVER (), 1)) ELSE 1 END, 6) AS enrichment FROM t""")
def strike_against_null(spark, sf_dir):
    truth, _ = event_roles(spark, sf_dir)
    errors = event_cells(spark, sf_dir).where("layer = 'error'").select("row", "col")
    visible = components.label8(truth, EVENT_GRID).join(tensor.local_strike(truth, EVENT_GRID), ["row", "col"])
    out = frames.strike_against_null(tensor.local_strike(errors, EVENT_GRID), visible, EVENT_GRID)
    return out.select("bin", "n_hidden", "n_null", r6("enrichment").alias("enrichment"))


# --- orientation fields ---


def _scalar(spark, sf_dir):
    """A field with holes: the views' weighted number within six cells, where there is one."""
    return stencil.kernel_sum(event_cells(spark, sf_dir).where("layer = 'view'").select("row", "col", "value"), EVENT_GRID, 6.0)


def _coded(spark, sf_dir):
    """Truth cells with a sense by the value of their purchase."""
    buys = event_cells(spark, sf_dir).where("layer = 'purchase'").select("row", "col", (F.least(F.lit(2), F.floor(F.col("value") * 3)) + 1).cast("int").alias("code"))
    return buys.join(event_roles(spark, sf_dir)[0], ["row", "col"], "left_semi")


def _flat(source: str, sigma: float, values: list[str], name: str, mirrored: bool) -> str:
    """SQL of a Gaussian cut at three sigma over the event grid, zero or mirrored beyond the edges."""
    reach = int(3 * sigma + 0.5)
    w = f"(SELECT i, exp(-0.5 * i * i / {sigma * sigma}) / (SELECT sum(exp(-0.5 * j * j / {sigma * sigma})) FROM range({-reach}, {reach + 1}) x(j)) AS k FROM range({-reach}, {reach + 1}) y(i))"
    sums, keep = ", ".join(f"sum({v} * k) AS {v}" for v in values), ", ".join(values)
    rows = " UNION ALL ".join(f"SELECT {e} AS r, c, {keep} FROM {source}" for e in ("r", "-1 - r", "1439 - r")[: 3 if mirrored else 1])
    cols = " UNION ALL ".join(f"SELECT r, {e} AS c, {keep} FROM {name}_a" for e in ("c", "-1 - c", "511 - c")[: 3 if mirrored else 1])
    return f"""{name}_a AS (SELECT r + i AS r, c, {sums} FROM ({rows}), {w} WHERE r + i BETWEEN 0 AND 719 GROUP BY ALL),
{name} AS (SELECT r, c + i AS c, {sums} FROM ({cols}), {w} WHERE c + i BETWEEN 0 AND 255 GROUP BY ALL)"""


_EDGE = f"""vl AS (SELECT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c, sum(v * (1 - sqrt(dr * dr + dc * dc) / 6.0)) AS v, 1.0 AS m FROM ev, range(-6, 7) x(dr), range(-6, 7) y(dc)
  WHERE layer = 'view' AND dr * dr + dc * dc < 36 AND r + dr BETWEEN 0 AND 719 AND c + dc BETWEEN 0 AND 255 GROUP BY ALL),
{_flat("vl", 1.0, ["v", "m"], "vs", False)}, vd AS (SELECT a.r::INTEGER AS r, b.c::INTEGER AS c, CASE WHEN m > 1e-8 THEN vs.v / m ELSE 0 END AS v FROM range(720) a(r) CROSS JOIN range(256) b(c) LEFT JOIN vs ON vs.r = a.r AND vs.c = b.c),
vg AS (SELECT r, c, CASE WHEN r = 0 THEN lead(v) OVER a - v WHEN r = 719 THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END AS y,
  CASE WHEN c = 0 THEN lead(v) OVER b - v WHEN c = 255 THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END AS x FROM vd WINDOW a AS (PARTITION BY c ORDER BY r), b AS (PARTITION BY r ORDER BY c)),
vp AS (SELECT r, c, x * x AS xx, y * y AS yy, x * y AS xy FROM vg), {_flat("vp", 2.0, ["xx", "yy", "xy"], "vj", True)},
vi AS (SELECT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c FROM vl, range(-4, 5) x(dr), range(-4, 5) y(dc) GROUP BY ALL HAVING count(*) = 81),
eg AS (SELECT vp.r, vp.c, (vp.xx - vp.yy) / (vp.xx + vp.yy) AS cos2, 2 * vp.xy / (vp.xx + vp.yy) AS sin2, ln(1 + sqrt(vp.xx + vp.yy)) AS log_gradient,
  greatest(0, least(1, sqrt((vj.xx - vj.yy) ** 2 + 4 * vj.xy ** 2) / greatest(vj.xx + vj.yy, 1e-12))) AS coherence
  FROM vp JOIN vi USING (r, c) JOIN vj USING (r, c) WHERE vp.xx + vp.yy > 1e-12)"""


@query("edge_tangent", f"""WITH {_EVENTS}, {_EDGE} SELECT r AS "row", c AS col, round(cos2, 4) + 0.0 AS cos2, round(sin2, 4) + 0.0 AS sin2, round(log_gradient, 4) AS log_gradient, round(coherence, 4) AS coherence FROM eg""")
def edge_tangent(spark, sf_dir):
    return fields.edge_tangent(_scalar(spark, sf_dir), EVENT_GRID).select("row", "col", *[r4(c).alias(c) for c in ("cos2", "sin2", "log_gradient", "coherence")])


@query("edge_features", f"""WITH RECURSIVE {_GEOMETRY}, {_EDGE}, x AS (SELECT ft.*, coalesce(eg.cos2, 0) AS ec, coalesce(eg.sin2, 0) AS es, coalesce(log_gradient, 0) AS lg, coalesce(eg.coherence, 0) AS co FROM ft LEFT JOIN eg USING (r, c))
SELECT r AS "row", c AS col, round(greatest(-1, least(1, ec * cos2 + es * sin2)), 4) + 0.0 AS edge_relative_cos2, round(lg, 4) AS edge_log_gradient, round(co, 4) AS edge_coherence FROM x""")
def edge_features(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    base = features.geometry(prediction, truth, EVENT_GRID)
    return fields.edge_features(prediction, base, _scalar(spark, sf_dir), EVENT_GRID).select("row", "col", *[r4(c).alias(c) for c in fields.EDGE])


_CODES = "cd AS (SELECT r, c, (least(2, floor(v * 3)) + 1)::INTEGER AS code FROM ev JOIN truth USING (r, c) WHERE layer = 'purchase')"
_MIX = f"""{_CODES},
sn AS (SELECT r, c, (code > 1)::INTEGER::DOUBLE AS a, (code = 1)::INTEGER::DOUBLE AS b FROM cd), {_flat("sn", 15.0, ["a", "b"], "sd", False)},
mx AS (SELECT r, c, greatest(0, least(1, CASE WHEN (a + b) ** 2 > 1e-12 THEN 4 * a * b / (a + b) ** 2 ELSE 0 END
  * least(1, (a + b) / greatest((SELECT quantile_cont(a + b, 0.9) FROM sd WHERE a + b > 1e-7), 1e-7)))) AS mix FROM sd WHERE (SELECT max(a) > 0 AND max(b) > 0 FROM sn))"""


@query("sense_mixing", f"""WITH {_EVENTS}, {_MIX} SELECT r::INTEGER AS "row", c::INTEGER AS col, round(mix, 5) AS mix FROM mx""")
def sense_mixing(spark, sf_dir):
    return fields.sense_mixing(_coded(spark, sf_dir), EVENT_GRID).select("row", "col", F.round("mix", 5).alias("mix"))


_BEND = f"""{_mirror("pr", 9, ["yy", "xx", "xy"], "jn")}, sn9 AS (SELECT r, c, round(xx - yy, 12) AS d, round(2 * xy, 12) AS e, xx + yy AS t FROM jn WHERE EXISTS (SELECT 1 FROM one WHERE one.r = jn.r AND one.c = jn.c)),
s9 AS (SELECT r, c, sqrt(d * d + e * e) / greatest(t, 1e-12) AS coh, degrees(atan2(round(cos(atan2(e, d) / 2 + pi() / 2), 12), -sin(atan2(e, d) / 2 + pi() / 2))) AS s FROM sn9),
bd AS (SELECT sk.r, sk.c, sk.s, least(1, sk.coh) * cos(radians(2 * sk.s)) AS x1, least(1, sk.coh) * sin(radians(2 * sk.s)) AS y1, least(1, s9.coh) * cos(radians(2 * s9.s)) AS x2, least(1, s9.coh) * sin(radians(2 * s9.s)) AS y2 FROM sk JOIN s9 USING (r, c))"""
_RELAY = f"""{_FRAME("pred")}, rb AS (
  SELECT f.r, f.c, sqrt((a.x1 - a.x2) ** 2 + (a.y1 - a.y2) ** 2) AS turn, a.y1 * a.x2 - a.x1 * a.y2 AS sin2_turn, sqrt(two.d2) AS d_second, sqrt(one.d2) AS d1,
    -((f.r - one.r) * (f.r - two.r) + (f.c - one.c) * (f.c - two.c)) AS dot, cos(radians(2 * (a.s - b.s))) AS host_cos2, ln(1 + n) AS log_len_second
  FROM fr2 f JOIN bd a ON a.r = one.r AND a.c = one.c LEFT JOIN bd b ON b.r = two.r AND b.c = two.c LEFT JOIN sz ON sz.comp = two.k),
ss AS (SELECT nr.r, nr.c, CASE code WHEN 2 THEN 1.0 WHEN 3 THEN -1.0 ELSE 0.0 END AS sgn FROM nr JOIN cd ON cd.r = nt[1] AND cd.c = nt[2]),
al AS (
  SELECT ft.*, sgn AS sense_sgn, sgn * side AS sense_side, turn, greatest(-1, least(1, side * sin2_turn)) AS bend_asym,
    greatest(-1, least(1, (coalesce(eg.cos2, 0) * ft.cos2 + coalesce(eg.sin2, 0) * ft.sin2) * coalesce(eg.coherence, 0))) AS edge_relative, d_second,
    CASE WHEN d_second IS NOT NULL THEN greatest(0, least(0.5, d1 / greatest(d1 + d_second, 1e-6))) END AS relay_ratio, CASE WHEN d_second IS NOT NULL THEN greatest(-1, least(1, dot / greatest(d1 * d_second, 1e-6))) END AS relay_facing,
    CASE WHEN d_second IS NOT NULL THEN greatest(-1, least(1, host_cos2)) END AS host_cos2, log_len_second, coalesce(mix, 0) AS sense_mix
  FROM ft JOIN rb USING (r, c) JOIN ss USING (r, c) LEFT JOIN eg USING (r, c) LEFT JOIN mx USING (r, c))"""
_ALL = [*features.GEOMETRY, *features.SENSE, *fields.RELAY_BEND]


@query("relay_bend", f"""WITH RECURSIVE {_GEOMETRY}, {_BEND}, {_EDGE}, {_MIX}, {_RELAY} SELECT r AS "row", c AS col, {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in _ALL)} FROM al""")
def relay_bend(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    return fields.relay_bend(prediction, truth, _coded(spark, sf_dir), _scalar(spark, sf_dir), EVENT_GRID).select("row", "col", *[r4(c).alias(c) for c in _ALL])


# --- fits and tests ---

_SHELL_EDGES = [0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 1e9]
_SHELLS = [f"n{i}" for i in range(len(_SHELL_EDGES) - 1)]
#: The layers' cells by distance to layer 0, and the credit that layer 1 gives them.
_SHELL_SQL = f"""{_LAYERS}, cl AS (SELECT layer, r, c FROM ly WHERE layer >= 2 AND v >= 1.0), one AS (SELECT r, c FROM ly WHERE layer = 1 AND v >= 1.0),
ds AS (SELECT cl.layer, cl.r, cl.c, sqrt(min((cl.r - cand.r) ** 2 + (cl.c - cand.c) ** 2)) AS d FROM cl, cand GROUP BY ALL),
cr AS (SELECT cl.layer, cl.r, cl.c, greatest(0, 1 - sqrt(min((cl.r - one.r) ** 2 + (cl.c - one.c) ** 2)) / 3.0) AS k FROM cl, one GROUP BY ALL),
sh AS (SELECT layer, {", ".join(f"sum((d >= {a} AND d < {b})::INTEGER)::DOUBLE AS {n}" for n, a, b in zip(_SHELLS, _SHELL_EDGES, _SHELL_EDGES[1:]))} FROM ds GROUP BY layer),
ct AS (SELECT layer, round(sum(k), 9) AS b FROM cr GROUP BY layer), rw AS (SELECT layer, [{", ".join(_SHELLS)}] AS a, b, 1 / greatest(b, 5.0) AS w FROM sh JOIN ct USING (layer))"""
_N = len(_SHELLS)


@query("nonnegative_fit", f"""WITH RECURSIVE {_SHELL_SQL}, ks AS (SELECT layer AS out FROM rw UNION ALL SELECT -1),
ne AS (SELECT out, i, list(q ORDER BY j) AS q, any_value(g) AS g FROM (
  SELECT out, i, j, coalesce(sum(w * w * a[i] * a[j]) FILTER (layer <> out), 0) AS q, coalesce(sum(w * w * a[i] * b) FILTER (layer <> out), 0) AS g FROM ks, rw, range(1, {_N + 1}) x(i), range(1, {_N + 1}) y(j) GROUP BY out, i, j) GROUP BY out, i),
s(out, k, x) USING KEY (out) AS (
  SELECT out, 0, [0.0::DOUBLE FOR i IN range({_N})] FROM ks
  UNION ALL
  SELECT s.out, s.k + 1, s.x[:ne.i - 1] || [CASE WHEN ne.q[ne.i] > 0 THEN greatest(0.0, s.x[ne.i] + (ne.g - list_inner_product(ne.q, s.x)) / ne.q[ne.i]) ELSE 0.0 END] || s.x[ne.i + 1:]
  FROM s JOIN ne ON ne.out = s.out AND ne.i = s.k % {_N} + 1 WHERE s.k < {_N} * 1500)
SELECT rw.layer, round(rw.b, 4) AS b, round(list_inner_product(rw.a, whole.x), 3) AS fitted, round(list_inner_product(rw.a, own.x), 3) AS left_out FROM rw JOIN s whole ON whole.out = -1 JOIN s own ON own.out = rw.layer""")
def nonnegative_fit(spark, sf_dir):
    cells = layer_cells(spark, sf_dir).where("value >= 1.0")
    mine, one = (cells.where(F.col("layer") == i).select("row", "col") for i in (0, 1))
    others = cells.where("layer >= 2").select("layer", "row", "col")
    near = others.join(nearest.distance_transform(mine, LAYER_GRID).select("row", "col", F.sqrt(F.col("d2").cast("double")).alias("d")), ["row", "col"])
    credit = nearest.distance_transform(one, LAYER_GRID).select("row", "col", F.greatest(F.lit(0.0), 1 - F.sqrt(F.col("d2").cast("double")) / 3.0).alias("k"))
    shells = [F.sum(((F.col("d") >= a) & (F.col("d") < b)).cast("double")).alias(n) for n, a, b in zip(_SHELLS, _SHELL_EDGES, _SHELL_EDGES[1:])]
    rows = near.join(credit, ["row", "col"]).groupBy("layer").agg(*shells, F.round(F.sum("k"), 9).alias("b")).withColumn("w", 1 / F.greatest("b", F.lit(5.0)))
    out = fits.nonnegative_fit(rows, "layer", _SHELLS, "b", "w").join(rows.select("layer", "b"), "layer")
    return out.select("layer", F.round("b", 4).alias("b"), F.round("fitted", 3).alias("fitted"), F.round("left_out", 3).alias("left_out"))


#: Student's density integrated by Simpson's rule up to t, where Spark adds a finite series.
@query("rank_p_values", f"""WITH {_PAIRS}, k AS (SELECT *, {_AVG('layer', 'x')} AS a, {_AVG('layer', 'y')} AS b FROM p),
c AS (SELECT layer, count(*) AS n, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN corr(a, b) END AS rho FROM k GROUP BY layer),
t AS (SELECT layer, n, rho, (n - 2)::DOUBLE AS f, abs(rho) * sqrt((n - 2) / greatest(1 - rho * rho, 1e-300)) AS t FROM c WHERE n >= 3),
i AS (SELECT layer, sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((f + 1) / 2) - lgamma(f / 2) - 0.5 * ln(f * pi()) - (f + 1) / 2 * ln(1 + (t * i / 4000) ** 2 / f))) * any_value(t) / 4000 / 3 AS m FROM t, range(4001) x(i) GROUP BY layer)
SELECT layer, n, round(rho, 6) AS rho, CASE WHEN rho IS NOT NULL THEN round(greatest(0, 1 - 2 * m), 6) + 0.0 END AS p FROM c LEFT JOIN i USING (layer)""")
def rank_p_values(spark, sf_dir):
    cells = layer_cells(spark, sf_dir)
    pairs = cells.where("layer <> 0").join(cells.where("layer = 0").select("row", "col", F.col("value").alias("y")), ["row", "col"])
    out = stats.correlations(pairs, "value", "y", ["layer"])
    return out.select("layer", "n", r6("spearman").alias("rho"), r6(fits.rank_p_value(F.col("spearman"), F.col("n"))).alias("p"))


# --- sinks and state ---


@query("committed_surface", f"""WITH {_EVENTS} SELECT count(*) AS n_cells, count(*) FILTER (v > 0) AS n_positive, round(sum(v), 4) AS total, 1 AS read_back FROM pred""")
def committed_surface(spark, sf_dir):
    """Commit the prediction, read it back, and tell the receipt; the folder goes when its rows are counted."""
    path = new_path(spark, "surface")
    receipt = sink.commit_surface(event_roles(spark, sf_dir)[1], path, EVENT_GRID, "prediction", "clicks with their value")
    read = sink.read_receipt(spark, path)
    remove_path(spark, path)
    row = [(read["n_cells"], read["n_positive"], round(read["total"], 4), int(read == receipt))]
    return spark.createDataFrame(row, "n_cells long, n_positive long, total double, read_back int")


def _files(spark, sf_dir):
    """Documents as files: source:doc_id, their content's hash, their bytes."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("lang", F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("source"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"))


#: The state has the files in one language, the listing has all; those of the benchmark are the candidate's own.
_STATE = """f AS (SELECT lang, concat_ws(':', source, doc_id::VARCHAR) AS source, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents),
own AS (SELECT sha256(text) AS sha256 FROM benchmark), st AS (SELECT sha256, list(DISTINCT source) AS sources FROM f WHERE lang = 'en' GROUP BY sha256),
lg AS (SELECT DISTINCT source, f.sha256, bytes, CASE WHEN f.sha256 IN (FROM own) THEN 'own' WHEN source LIKE '%:1_' THEN 'input' WHEN list_contains(st.sources, source) THEN 'known' WHEN st.sha256 IS NOT NULL THEN 'alias' WHEN bytes > 20000 THEN 'too_large' ELSE 'new' END AS kind
  FROM f LEFT JOIN st USING (sha256))"""


def _merged(spark, sf_dir):
    files = _files(spark, sf_dir)
    state = files.where("lang = 'en'").groupBy("sha256").agg(F.collect_set("source").alias("sources"))
    own = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("sha256"))
    return registry.merged_state(state, files, own, ":1.$", 20_000), files, own


@query("merge_log", f"WITH {_STATE} SELECT source, sha256, kind FROM lg")
def merge_log(spark, sf_dir):
    (_, log), _, _ = _merged(spark, sf_dir)
    return log.select("source", "sha256", "kind")


@query("merged_state", f"""WITH {_STATE}, al AS (SELECT sha256, unnest(sources) AS source FROM st UNION ALL SELECT sha256, source FROM lg WHERE kind IN ('alias', 'new'))
SELECT sha256, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM al GROUP BY sha256""")
def merged_state(spark, sf_dir):
    """Twice: the second merge of the same listing must change nothing."""
    (state, _), files, own = _merged(spark, sf_dir)
    again, _ = registry.merged_state(state, files, own, ":1.$", 20_000)
    return again.select("sha256", F.array_join("sources", ",").alias("sources"))


# --- expressions on offsets ---


#: Offsets of cells to the nearest truth cell within 12, with the cell's value as an angle.
_OFFSETS = f"""{_EVENTS}, w AS (SELECT p.r, p.c, p.v, min({{'d2': (p.r - t.r) ** 2 + (p.c - t.c) ** 2, 'r': t.r, 'c': t.c}}) AS m
  FROM pred p JOIN truth t ON t.r BETWEEN p.r - 12 AND p.r + 12 AND t.c BETWEEN p.c - 12 AND p.c + 12 WHERE (p.r - t.r) ** 2 + (p.c - t.c) ** 2 <= 144 GROUP BY ALL),
x AS (SELECT r, c, (r - m.r)::DOUBLE AS dy, (c - m.c)::DOUBLE AS dx, sqrt(m.d2) AS d, v * 180 AS s, v FROM w)"""


def _offsets(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    near = nearest.nearest_within(prediction, truth, 12)
    d = lambda c: (F.col(c) - F.col(f"near_{c}")).cast("double")
    return near.select("row", "col", d("row").alias("dy"), d("col").alias("dx"), F.sqrt(F.col("d2").cast("double")).alias("d"), (F.col("value") * 180).alias("s"), F.col("value").alias("v"))


_TURN = lambda e: f"((({e}) % 180.0) + 180.0) % 180.0"


@query("offset_expressions", f"""WITH {_OFFSETS} SELECT r AS "row", c AS col, round(greatest(0, 1 - d / 3), 6) AS kernel, round({_TURN('degrees(atan2(dx, -dy))')}, 5) % 180 AS azimuth,
round(dx * sin(radians(s)) - dy * cos(radians(s)), 5) + 0.0 AS along, round(-dx * cos(radians(s)) - dy * sin(radians(s)), 5) + 0.0 AS across, round(d / (d + 0.2 * v + 0.8 * s + 1e-12), 5) AS dti FROM x""")
def offset_expressions(spark, sf_dir):
    from rastra.functions import scalars

    scalars.register(spark)
    _offsets(spark, sf_dir).createOrReplaceTempView("rastra_offsets")
    return spark.sql("""SELECT row, col, round(grid_kernel(d, 3), 6) AS kernel, round(grid_azimuth(dy, dx), 5) % 180D AS azimuth, round(along_strike(dy, dx, s), 5) + 0D AS along,
        round(across_strike(dy, dx, s), 5) + 0D AS across, round(dti(d, v, s), 5) AS dti FROM rastra_offsets""")


@query("offset_credit", f"""WITH {_EVENTS}, o AS (SELECT dr::INTEGER AS dr, dc::INTEGER AS dc, 1 - sqrt(dr * dr + dc * dc) / 3.0 AS k FROM range(-3, 4) x(dr), range(-3, 4) y(dc) WHERE dr * dr + dc * dc < 9)
SELECT dr, dc, round(any_value(k), 6) AS k, count(t.r) AS n, round(coalesce(sum(p.v * k) FILTER (t.r IS NOT NULL), 0), 5) AS credit FROM o CROSS JOIN pred p LEFT JOIN truth t ON t.r = p.r + dr AND t.c = p.c + dc GROUP BY dr, dc""")
def offset_credit(spark, sf_dir):
    """What each offset of the kernel is worth: the truth cells that prediction cells have there, and the credit."""
    truth, prediction = event_roles(spark, sf_dir)
    spread = stencil.spread(prediction, stencil.kernel_offsets(), EVENT_GRID)
    hit = spread.join(truth, ["row", "col"]).groupBy((F.col("row") - F.col("src_row")).alias("dr"), (F.col("col") - F.col("src_col")).alias("dc")).agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("k")).alias("credit"))
    offsets = spark.createDataFrame(stencil.kernel_offsets(), "dr int, dc int, k double")
    return offsets.join(hit, ["dr", "dc"], "left").fillna(0).select("dr", "dc", r6("k").alias("k"), "n", F.round("credit", 5).alias("credit"))


# --- out of fold ---

_OOF_EDGES = {"d": [0.0, 2.0, 4.0, 6.0, 9.0, 12.5], "v": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]}
_BIN = lambda f: "CASE " + " ".join(f"WHEN {f} >= {a} AND {f} < {b} THEN {i}" for i, (a, b) in enumerate(zip(_OOF_EDGES[f], _OOF_EDGES[f][1:]))) + f" WHEN {f} = {_OOF_EDGES[f][-1]} THEN {len(_OOF_EDGES[f]) - 2} ELSE -1 END"
_SHARE = lambda f, side: f"((SELECT count(*) FROM b o WHERE o.fold <> b.fold AND o.y = {side} AND o.{f}b = b.{f}b) + 1) / ((SELECT count(*) FROM b o WHERE o.fold <> b.fold AND o.y = {side}) + {len(_OOF_EDGES[f])})"
_OOF = f"""{_NEAR}, b AS (SELECT r, c, v, d, y, ((r >= 360)::INTEGER * 2 + (c >= 128)::INTEGER)::INTEGER AS fold, {_BIN("d")} AS db, {_BIN("v")} AS vb FROM nn),
lr AS (SELECT *, ln({_SHARE("d", 1)} / ({_SHARE("d", 0)})) + ln({_SHARE("v", 1)} / ({_SHARE("v", 0)})) AS l, (SELECT count(*) FROM b o WHERE o.fold <> b.fold AND o.y = 1) AS np, (SELECT count(*) FROM b o WHERE o.fold <> b.fold AND o.y = 0) AS nn_ FROM b),
oof AS (SELECT r, c, y, l, round(1 / (1 + exp(-(l + ln((np + 1) / (nn_ + 1))))), 9) AS v FROM lr)"""


def _scored(spark, sf_dir):
    """Cells with the quadrant as fold, scored by the model of the other quadrants; p rounded, so that sums' order decides nothing."""
    fold = (F.col("row") >= 360).cast("int") * 2 + (F.col("col") >= 128).cast("int")
    out = crossfit.density_ratio(_near(spark, sf_dir).withColumn("fold", fold), "fold", "y", _OOF_EDGES)
    return out.withColumn("p", F.round("p", 9))


@query("density_ratio", f"""WITH {_OOF} SELECT r AS "row", c AS col, round(l, 6) + 0.0 AS log_ratio, round(v, 6) AS p FROM oof""")
def density_ratio(spark, sf_dir):
    return _scored(spark, sf_dir).select("row", "col", r6("log_ratio").alias("log_ratio"), r6("p").alias("p"))


@query("quantile_calibration", f"""WITH {_OOF}, q AS (SELECT quantile_cont(v, [{", ".join(str(i / 8) for i in range(1, 8))}]) AS cuts FROM oof), e AS (SELECT oof.*, len([x FOR x IN cuts IF x < v]) AS bin FROM oof, q)
SELECT bin::INTEGER AS bin, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(v), 6) AS mean_value FROM e GROUP BY bin""")
def quantile_calibration(spark, sf_dir):
    out = crossfit.quantile_calibration(_scored(spark, sf_dir), "p", "y")
    return out.select("bin", "n", F.col("positives").cast("long").alias("positives"), r6("mean_value").alias("mean_value"))


_FOLD_SQL = ORACLE_SQL["greedy_rounds"].replace(_EVENTS, _OOF).replace("FROM click,", "FROM oof,").replace("JOIN click p", "JOIN oof p").replace("120.0", "25.0")
_DOTS = _FOLD_SQL[: _FOLD_SQL.rindex("SELECT fold, unnest(acc).r")]


@query("fold_scores", f"""{_DOTS}, dots AS (SELECT fold, unnest(acc).r AS r, unnest(acc).c AS c FROM s), tr AS (SELECT r // 180 * 4 + c // 64 AS fold, r, c FROM oof WHERE y = 1),
pk AS (SELECT t.fold, t.r AS tr, t.c AS tc, d.r AS dr, d.c AS dc, 1 - sqrt((t.r - d.r) ** 2 + (t.c - d.c) ** 2) / 3.0 AS k FROM tr t JOIN dots d ON t.fold = d.fold WHERE (t.r - d.r) ** 2 + (t.c - d.c) ** 2 < 9),
cv AS (SELECT fold, sum(k) AS tp FROM (SELECT fold, tr, tc, max(k) AS k FROM pk GROUP BY ALL) GROUP BY fold),
dq AS (SELECT fold, count(*) AS n_dots, sum(1 - coalesce(q, 0)) AS fp FROM dots LEFT JOIN (SELECT fold, dr AS r, dc AS c, max(k) AS q FROM pk GROUP BY ALL) USING (fold, r, c) GROUP BY fold),
fs AS (SELECT fold::INTEGER AS fold, coalesce(n_truth, 0) AS n_truth, coalesce(n_dots, 0) AS n_dots, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp FROM (SELECT fold, count(*) AS n_truth FROM tr GROUP BY fold) FULL JOIN dq USING (fold) LEFT JOIN cv USING (fold))
SELECT fold, n_truth, n_dots, round(tp, 5) AS tp, round(fp, 5) AS fp, round(tp / (tp + 0.2 * fp + 0.8 * (n_truth - tp) + 1e-12), 5) AS dti FROM fs
UNION ALL SELECT -1, sum(n_truth)::BIGINT, sum(n_dots)::BIGINT, round(sum(tp), 5), round(sum(fp), 5), round(sum(tp) / (sum(tp) + 0.2 * sum(fp) + 0.8 * (sum(n_truth) - sum(tp)) + 1e-12), 5) FROM fs""")
def fold_scores(spark, sf_dir):
    """Fit, score, allocate and pool: probabilities out of fold, dots by greedy rounds in blocks, each block's index and (-1) the pooled one."""
    layer = _scored(spark, sf_dir)
    block = (F.col("row") / 180).cast("int") * 4 + (F.col("col") / 64).cast("int")
    value = layer.select("row", "col", F.col("p").alias("value"))
    credit = stencil.kernel_sum(value, EVENT_GRID).select("row", "col", F.round("value", 9).alias("credit"))
    cells = credit.join(value, ["row", "col"], "left").fillna(0.0, ["value"]).withColumn("fold", block)
    dots = allocate.greedy_rounds(cells, "fold", 25.0).withColumn("value", F.lit(1.0))
    own = crossfit.fold_scores(layer.where("y = 1").withColumn("fold", block), dots, "fold").drop("fn", "dti")
    pooled = own.agg(F.lit(-1).alias("fold"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_truth", "n_dots", "tp", "fp")])
    both = own.unionByName(pooled).withColumn("fn", F.col("n_truth") - F.col("tp"))
    index = metric.dti(F.col("tp"), F.col("fp"), F.col("fn"))
    return both.select("fold", "n_truth", "n_dots", F.round("tp", 5).alias("tp"), F.round("fp", 5).alias("fp"), F.round(index, 5).alias("dti"))


# --- intensities ---


@query("interaction", f"""WITH RECURSIVE {_GEOMETRY}, wt AS (SELECT lab.r, lab.c, sqrt(n) AS w, CASE WHEN coh < 0.5 THEN 2 * (1 - coh) ELSE 0 END AS b FROM lab JOIN sz USING (comp) JOIN sk USING (r, c)),
fa AS (SELECT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c, sum(w * (1 - sqrt(dr * dr + dc * dc) / 15.0)) AS v FROM wt, range(-15, 16) x(dr), range(-15, 16) y(dc) WHERE dr * dr + dc * dc < 225 AND r + dr BETWEEN 0 AND 719 AND c + dc BETWEEN 0 AND 255 GROUP BY ALL),
be AS (SELECT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c, sum(b / 25) AS v FROM wt, range(-2, 3) x(dr), range(-2, 3) y(dc) GROUP BY ALL),
ti AS (SELECT a.r, a.c FROM one a LEFT JOIN one b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND NOT (a.r = b.r AND a.c = b.c) GROUP BY a.r, a.c HAVING count(b.r) <= 1),
tf AS (SELECT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c, 2 / sqrt(sqrt(min(dr * dr + dc * dc))) AS v FROM ti, range(-7, 8) x(dr), range(-7, 8) y(dc) WHERE dr * dr + dc * dc <= 56.25 GROUP BY ALL HAVING min(dr * dr + dc * dc) > 0)
SELECT fa.r AS "row", fa.c AS col, round(fa.v + coalesce(be.v, 0) + coalesce(tf.v, 0), 4) AS value FROM fa LEFT JOIN be USING (r, c) LEFT JOIN tf USING (r, c) WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.r = fa.r AND one.c = fa.c)""")
def interaction(spark, sf_dir):
    return fields.interaction(event_roles(spark, sf_dir)[0], EVENT_GRID).select("row", "col", r4("value").alias("value"))


_CLASSES = [(2.0, 2.0), (8.0, 3.0), (1e9, 5.0)]


@query("system_intensity", f"""WITH RECURSIVE {_LABELS}, sz AS (SELECT comp, count(*) AS n FROM lab GROUP BY comp), {", ".join(f"q{i} AS (SELECT r, c, sqrt(n) AS v FROM lab JOIN sz USING (comp) WHERE n > {a} AND n <= {b})" for i, (a, b) in enumerate(zip([0.0, 2.0, 8.0], [2.0, 8.0, 1e9])))},
{", ".join(_mirror(f"q{i}", int(sigma), ["v"], f"g{i}") for i, (_, sigma) in enumerate(_CLASSES))}
SELECT r::INTEGER AS "row", c::INTEGER AS col, round(sum(v), 6) AS value FROM ({" UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(3))}) GROUP BY r, c""")
def system_intensity(spark, sf_dir):
    labelled = label8(spark, sf_dir)
    lengths = labelled.join(labelled.groupBy("comp_id").agg(F.count("*").alias("length")), "comp_id")
    return fields.system_intensity(lengths, EVENT_GRID, _CLASSES).select("row", "col", r6("value").alias("value"))


@query("axial_orientation", f"""WITH {_EVENTS}, {_mirror("click", 2, ["v"], "sm")}, dn AS (SELECT a.r::INTEGER AS r, b.c::INTEGER AS c, coalesce(v, 0) AS v FROM range(720) a(r) CROSS JOIN range(256) b(c) LEFT JOIN sm ON sm.r = a.r AND sm.c = b.c),
gr AS (SELECT r, c, CASE WHEN r = 0 THEN lead(v) OVER a - v WHEN r = 719 THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END AS y,
  CASE WHEN c = 0 THEN lead(v) OVER b - v WHEN c = 255 THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END AS x FROM dn WINDOW a AS (PARTITION BY c ORDER BY r), b AS (PARTITION BY r ORDER BY c)),
pr AS (SELECT r, c, x * x AS xx, y * y AS yy, x * y AS xy FROM gr WHERE x <> 0 OR y <> 0), {_mirror("pr", 2, ["xx", "yy", "xy"], "js")}
SELECT click.r AS "row", click.c AS col, round(0.5 * degrees(atan2(round(2 * xy, 12), round(xx - yy, 12))), 3) + 0.0 AS angle_deg FROM click JOIN js USING (r, c)""")
def axial_orientation(spark, sf_dir):
    clicks = event_cells(spark, sf_dir).where("layer = 'click'").select("row", "col", "value")
    return fields.axial_orientation(clicks, EVENT_GRID, 2.0).select("row", "col", (F.round("angle_deg", 3) + F.lit(0.0)).alias("angle_deg"))


# --- joint tables, sweeps and zones ---

_JOINT = [0.0, 1.0, 2.0, 4.0, 8.0, 12.0]
_JBIN = lambda e: "CASE " + " ".join(f"WHEN {e} >= {a} AND {e} < {b} THEN {i}" for i, (a, b) in enumerate(zip(_JOINT, _JOINT[1:]))) + " WHEN " + e + " = 12.0 THEN 4 END"
_SIDED = f"{_OFFSETS}, z AS (SELECT x.*, abs(dy) AS a, abs(dx) AS b, sign(dx) AS side, EXISTS (SELECT 1 FROM err WHERE err.r = x.r AND abs(err.c - x.c) <= 2)::INT AS y FROM x)"


def _sided(spark, sf_dir):
    beside = stencil.spread(event_cells(spark, sf_dir).where("layer = 'error'").select("row", "col"), [(0, i) for i in range(-2, 3)]).select("row", "col").distinct().withColumn("y", F.lit(1))
    out = _offsets(spark, sf_dir).join(beside, ["row", "col"], "left").fillna(0, ["y"])
    return out.withColumns({"a": F.abs("dy"), "b": F.abs("dx"), "side": F.signum("dx")})


@query("joint_enrichment", f"""WITH {_SIDED}, k AS (SELECT {_JBIN("a")} AS i, {_JBIN("b")} AS j, y FROM z)
SELECT p.i::INTEGER AS bin_a, q.j::INTEGER AS bin_b, count(k.y) AS n_all, coalesce(sum(k.y), 0)::BIGINT AS n_pos, round(coalesce(avg(k.y), 0), 6) AS rate FROM range(5) p(i) CROSS JOIN range(5) q(j) LEFT JOIN k ON k.i = p.i AND k.j = q.j GROUP BY p.i, q.j""")
def joint_enrichment(spark, sf_dir):
    out = stats.joint_enrichment(_sided(spark, sf_dir), "a", "b", "y", _JOINT, _JOINT)
    return out.select("bin_a", "bin_b", "n_all", F.col("n_pos").cast("long").alias("n_pos"), r6("rate").alias("rate"))


@query("side_rates", f"""WITH {_SIDED}, s AS (SELECT coalesce(sum(y) FILTER (side < 0), 0) AS nl, coalesce(sum(y) FILTER (side > 0), 0) AS nr, count(*) FILTER (side < 0) AS al, count(*) FILTER (side > 0) AS ar FROM z)
SELECT nl::BIGINT AS n_left, nr::BIGINT AS n_right, round(nl / greatest(al, 1), 6) AS rate_left, round(nr / greatest(ar, 1), 6) AS rate_right, CASE WHEN nl > 0 AND nr > 0 THEN round(ln((nr / ar) / (nl / al)), 5) END AS log_ratio FROM s""")
def side_rates(spark, sf_dir):
    out = stats.side_rates(_sided(spark, sf_dir), "side", "y")
    return out.select(F.col("n_left").cast("long").alias("n_left"), F.col("n_right").cast("long").alias("n_right"), r6("rate_left").alias("rate_left"), r6("rate_right").alias("rate_right"), F.round("log_ratio", 5).alias("log_ratio"))


@query("zone_limits", f"""WITH {_NEAR}, z AS (SELECT d, y, ((r >= 360)::INTEGER * 2 + (c >= 128)::INTEGER)::INTEGER AS fold FROM nn), f AS (SELECT fold, count(*) AS n FROM z GROUP BY fold),
o AS (SELECT f.fold, any_value(n) AS n, quantile_cont(d, 0.9) FILTER (y = 1) AS zone, avg(y) AS rate FROM f JOIN z ON z.fold <> f.fold GROUP BY f.fold),
i AS (SELECT o.fold, avg((d <= zone)::INT) AS fraction FROM o JOIN z ON z.fold <> o.fold WHERE y = 1 GROUP BY o.fold)
SELECT fold, round(zone, 6) AS zone, round(fraction, 6) AS fraction, greatest(1, floor(200 * coalesce(fraction, 0)))::BIGINT AS cap, round(rate, 6) AS base_rate, round(rate * n, 5) AS n_expected FROM o LEFT JOIN i USING (fold)""")
def zone_limits(spark, sf_dir):
    fold = (F.col("row") >= 360).cast("int") * 2 + (F.col("col") >= 128).cast("int")
    out = allocate.zone_limits(_near(spark, sf_dir).withColumn("fold", fold), "fold", "y", "d", 200)
    return out.select("fold", r6("zone").alias("zone"), r6("fraction").alias("fraction"), "cap", r6("base_rate").alias("base_rate"), F.round("n_expected", 5).alias("n_expected"))


_SWEEP = _PASS.replace("$PATIENCE", "30").replace(_CANDIDATES(0), f"""{_EVENTS},
k AS (SELECT (r + dr)::INTEGER AS r, (c + dc)::INTEGER AS c, round(sum(v * (1 - sqrt(dr * dr + dc * dc) / 3.0)), 9) AS credit FROM pred, range(-3, 4) x(dr), range(-3, 4) y(dc)
  WHERE dr * dr + dc * dc < 9 AND r + dr BETWEEN 0 AND 719 AND c + dc BETWEEN 0 AND 255 GROUP BY ALL),
kd AS (SELECT k.r, k.c, credit, sqrt(min((k.r - t.r) ** 2 + (k.c - t.c) ** 2)) AS d FROM k, truth t GROUP BY ALL),
cand AS (SELECT radius AS fold, r, c, least(1.0, credit) AS own, row_number() OVER (PARTITION BY radius ORDER BY credit DESC, r, c) AS i FROM kd, (SELECT unnest([2.0, 8.0])::DOUBLE AS radius) WHERE d > radius),
nb AS (SELECT a.r, a.c, list({{'r': p.r, 'c': p.c, 'p': p.v, 'k': 1 - sqrt((a.r - p.r) ** 2 + (a.c - p.c) ** 2) / 3.0}} ORDER BY p.r, p.c) AS nb
  FROM kd a JOIN pred p ON p.r BETWEEN a.r - 3 AND a.r + 3 AND p.c BETWEEN a.c - 3 AND a.c + 3 WHERE (a.r - p.r) ** 2 + (a.c - p.c) ** 2 < 9 GROUP BY a.r, a.c),
cn AS MATERIALIZED (SELECT cand.*, coalesce(nb, []) AS nb FROM cand LEFT JOIN nb USING (r, c))""").replace("120.0", "300.0").replace("SELECT fold, unnest(acc).r", "SELECT fold AS radius, unnest(acc).r")


@query("exclusion_sweep", _SWEEP)
def exclusion_sweep(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    credit = stencil.kernel_sum(prediction, EVENT_GRID).select("row", "col", F.round("value", 9).alias("credit"))
    near = nearest.distance_transform(truth, EVENT_GRID).select("row", "col", F.sqrt(F.col("d2").cast("double")).alias("d"))
    cells = credit.join(prediction, ["row", "col"], "left").fillna(0.0, ["value"]).join(near, ["row", "col"])
    return allocate.exclusion_sweep(cells, [2.0, 8.0], 300.0, 30)


# --- portfolios ---

#: The layers' full cells against those of layer 0.
_PORTFOLIO = f"""{_LAYERS}, cl AS (SELECT layer, r, c, v FROM ly WHERE layer <> 0 AND v >= 0.5),
cd AS (SELECT layer, cl.r, cl.c, cl.v, sqrt(min((cl.r - cand.r) ** 2 + (cl.c - cand.c) ** 2)) AS d FROM cl, cand GROUP BY ALL),
sp AS (SELECT layer, quantile_cont(s, 0.5) AS spacing_median FROM (SELECT a.layer, sqrt(min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) AS s FROM cl a JOIN cl b ON a.layer = b.layer AND NOT (a.r = b.r AND a.c = b.c) GROUP BY a.layer, a.r, a.c) GROUP BY layer),
pf AS (SELECT layer, count(*) AS dots, min(v) AS least, max(v) AS most, quantile_cont(d, 0.5) AS d_median, quantile_cont(d, 0.1) AS d_p10, min(d) AS d_least, avg((d <= 3)::INT) AS near_share,
  any_value(spacing_median) AS spacing_median, count(*) FILTER (d = 0) / greatest(1, (SELECT count(*) FROM cand)) AS hit_share FROM cd LEFT JOIN sp USING (layer) GROUP BY layer)"""


def _portfolio(spark, sf_dir):
    cells = layer_cells(spark, sf_dir)
    catalogue = cells.where("layer = 0 and value >= 1.0")
    return portfolio.portfolio(cells.where("layer <> 0 and value >= 0.5"), catalogue, LAYER_GRID)


@query("portfolio", f"""WITH {_PORTFOLIO} SELECT layer, dots, round(least, 6) AS least, round(most, 6) AS most, round(d_median, 6) AS d_median, round(d_p10, 6) AS d_p10, round(d_least, 6) AS d_least, round(near_share, 6) AS near_share, round(spacing_median, 6) AS spacing_median, round(hit_share, 6) AS hit_share FROM pf""")
def portfolio_table(spark, sf_dir):
    return _portfolio(spark, sf_dir).select("layer", "dots", *[r6(c).alias(c) for c in ("least", "most", "d_median", "d_p10", "d_least", "near_share", "spacing_median", "hit_share")])


#: Ranks of a measure and of the score (the layer's mean discount) among the layers, and the p-value by integrating Student's density.
_RANKED = " UNION ALL ".join(f"SELECT '{m}' AS measure, round({m}, 9)::DOUBLE AS value, round(score, 9) AS score FROM pf JOIN sc USING (layer)" for m in portfolio.MEASURES)


@query("score_correlations", f"""WITH {_PORTFOLIO}, sc AS (SELECT layer, avg(v) AS score FROM ly GROUP BY layer), lg AS ({_RANKED}), k AS (SELECT *, {_AVG('measure', 'value')} AS a, {_AVG('measure', 'score')} AS b FROM lg WHERE value IS NOT NULL),
c AS (SELECT measure, count(*) AS n, CASE WHEN count(*) >= 3 AND max(value) > min(value) AND max(score) > min(score) THEN corr(a, b) END AS rho FROM k GROUP BY measure),
t AS (SELECT measure, n, rho, (n - 2)::DOUBLE AS f, abs(rho) * sqrt((n - 2) / greatest(1 - rho * rho, 1e-300)) AS t FROM c WHERE n >= 3),
i AS (SELECT measure, sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((f + 1) / 2) - lgamma(f / 2) - 0.5 * ln(f * pi()) - (f + 1) / 2 * ln(1 + (t * i / 4000) ** 2 / f))) * any_value(t) / 4000 / 3 AS m FROM t, range(4001) x(i) GROUP BY measure)
SELECT measure, n, round(rho, 6) AS rho, CASE WHEN rho IS NOT NULL THEN round(greatest(0, 1 - 2 * m), 5) + 0.0 END AS p FROM c LEFT JOIN i USING (measure)""")
def score_correlations(spark, sf_dir):
    score = layer_cells(spark, sf_dir).groupBy("layer").agg(F.round(F.avg("value"), 9).alias("score"))
    table_ = _portfolio(spark, sf_dir).join(score, "layer").withColumns({m: F.round(m, 9) for m in portfolio.MEASURES if m != "dots"})
    out = portfolio.score_correlations(table_, "score")
    return out.select("measure", "n", r6("rho").alias("rho"), (F.round("p", 5) + F.lit(0.0)).alias("p"))


@query("halo_decision", f"""WITH {_LAYERS}, cl AS (SELECT layer, r, c FROM ly WHERE layer >= 2 AND v >= 1.0), pn AS (SELECT layer, r, c FROM ly WHERE layer IN (0, 1) AND v >= 1.0),
rc AS (SELECT DISTINCT layer, r + dr AS r, c + dc AS c FROM cl, range(-3, 4) x(dr), range(-3, 4) y(dc) WHERE dr * dr + dc * dc <= 9), fp AS (SELECT DISTINCT r, c FROM ly),
h AS (SELECT layer, count(*) AS n FROM rc SEMI JOIN fp USING (r, c) GROUP BY layer), m AS (SELECT rc.layer, pn.layer AS mine, count(*) AS n FROM pn JOIN rc USING (r, c) GROUP BY ALL), z AS (SELECT layer AS mine, count(*) AS n FROM pn GROUP BY layer),
o AS (SELECT m.layer, max(m.n / z.n) AS overlap FROM m JOIN z USING (mine) GROUP BY m.layer)
SELECT d.layer, dots, round(coalesce(h.n, 0) / (SELECT count(*) FROM fp), 6) AS halo, round(coalesce(overlap, 0), 6) AS overlap, coalesce(h.n, 0) / (SELECT count(*) FROM fp) >= 0.5 AS is_blind
FROM (SELECT layer, count(*) AS dots FROM cl GROUP BY layer) d LEFT JOIN h USING (layer) LEFT JOIN o USING (layer)""")
def halo_decision(spark, sf_dir):
    cells = layer_cells(spark, sf_dir)
    full = cells.where("value >= 1.0").select("layer", "row", "col")
    out = portfolio.halo_decision(full.where("layer >= 2"), full.where("layer < 2"), cells)
    return out.select("layer", "dots", r6("halo").alias("halo"), r6("overlap").alias("overlap"), "is_blind")


@query("shells", f"""WITH {_EVENTS}, st AS (SELECT unnest([1, 2, 3])::INTEGER AS step, unnest([0.0, 0.3, 0.7]) AS low), cr AS (SELECT step, sum(v) AS credit FROM st JOIN pred ON v >= low GROUP BY step),
x AS (SELECT r, c, (1 + (v >= 0.3)::INT + (v >= 0.7)::INT)::INTEGER AS step FROM pred), d AS (SELECT x.r, x.c, x.step, sqrt(min((x.r - t.r) ** 2 + (x.c - t.c) ** 2)) AS d FROM x, truth t GROUP BY ALL),
n AS (SELECT step, count(*) AS n, quantile_cont(d, 0.5) AS m FROM d GROUP BY step), g AS (SELECT step, credit - coalesce(lead(credit) OVER (ORDER BY step), 0) AS credit FROM cr)
SELECT step, n, round(credit, 5) AS credit, round(credit / n, 6) AS mean_credit, round(m, 6) AS d_median FROM n JOIN g USING (step)""")
def shells(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    chain = prediction.withColumn("step", F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(low).alias("low")) for i, low in ((1, 0.0), (2, 0.3), (3, 0.7))]), lambda s: F.col("value") >= s["low"])))
    chain = chain.select(F.col("step.i").alias("step"), "row", "col", "value")
    d = nearest.distance_transform(truth, EVENT_GRID).select("row", "col", F.sqrt(F.col("d2").cast("double")).alias("d"))
    out = portfolio.shells(chain, chain.groupBy("step").agg(F.sum("value").alias("credit")), d)
    return out.select("step", "n", F.round("credit", 5).alias("credit"), r6("mean_credit").alias("mean_credit"), r6("d_median").alias("d_median"))


# --- audits and covariates ---

_LEGS = f"""{_LAYERS}, cs AS (SELECT count(*) AS n FROM cand), sz AS (SELECT layer, count(*) AS n FROM reg GROUP BY layer), fo AS (SELECT layer, count(*) AS h FROM hit GROUP BY layer),
bk AS (SELECT layer, count(*) FILTER (EXISTS (SELECT 1 FROM cand WHERE (cand.r - reg.r) ** 2 + (cand.c - reg.c) ** 2 <= 9)) / count(*) AS b FROM reg GROUP BY layer),
sh AS (SELECT layer, count(*) AS s FROM reg JOIN cand USING (r, c) GROUP BY layer),
au AS (SELECT layer, sz.n, coalesce(h, 0) / cs.n AS f, b, coalesce(s, 0) / (sz.n + cs.n - coalesce(s, 0)) AS j, (51200.0 * coalesce(s, 0) - cs.n * sz.n) / (sqrt(cs.n * (51200.0 - cs.n)) * sqrt(sz.n * (51200.0 - sz.n))) AS rho, cs.n AS mine
  FROM sz JOIN bk USING (layer) LEFT JOIN fo USING (layer) LEFT JOIN sh USING (layer), cs)"""


def _audited(spark, sf_dir):
    cells = layer_cells(spark, sf_dir).where("value >= 1.0").select("layer", "row", "col")
    candidate, layers = cells.where("layer = 0").select("row", "col"), cells.where("layer <> 0")
    audited = registry.audit(candidate, layers).join(registry.tied_spearman(candidate, layers, LAYER_GRID.height * LAYER_GRID.width), "layer")
    return audited, layers.groupBy("layer").agg(F.count("*").alias("n")), candidate


@query("four_legs", f"""WITH {_LEGS}, l AS (
  SELECT 'literal' AS leg, f, true AS peer, rho > 0.5 OR f > 0.1 AS flag FROM au UNION ALL SELECT 'representation', f, n <= 512, rho > 0.5 OR f > 0.1 FROM au
  UNION ALL SELECT 'scale_free', f, true, b > 0.1 OR j > 0.05 OR rho > 0.5 FROM au UNION ALL SELECT 'support_matched', f, n * 3 >= mine AND n <= 3 * mine, f > 0.1 OR b > 0.1 OR j > 0.05 OR rho > 0.5 FROM au)
SELECT leg, count(*) FILTER (peer) AS peers, count(*) FILTER (peer AND flag) AS flags, round(max(f) FILTER (peer), 6) AS worst, count(*) FILTER (peer AND flag) = 0 AS passed FROM l GROUP BY leg""")
def four_legs(spark, sf_dir):
    out = registry.four_legs(*_audited(spark, sf_dir), LAYER_GRID.height * LAYER_GRID.width, overlap_limit=0.1, jaccard_limit=0.05, dense_from=0.01)
    return out.select("leg", "peers", "flags", r6("worst").alias("worst"), "passed")


@query("size_bands", f"""WITH {_LEGS}, e AS (SELECT unnest([0, 50, 200, 800, 100000])::BIGINT AS low, unnest([50, 200, 800, 100000, 10000000])::BIGINT AS high)
SELECT low, high, count(*) AS peers, round(max(f), 6) AS worst_overlap, round(max(j), 6) AS worst_jaccard FROM e JOIN au ON n >= low AND n < high GROUP BY low, high""")
def size_bands(spark, sf_dir):
    audited, sizes, _ = _audited(spark, sf_dir)
    out = registry.size_bands(audited, sizes, [0, 50, 200, 800, 100_000, 10_000_000])
    return out.select("low", "high", "peers", r6("worst_overlap").alias("worst_overlap"), r6("worst_jaccard").alias("worst_jaccard"))


#: Covariates of _GEOMETRY's chain, the second component and the host's code; the class rates of the intensity are fixed here.
_COVARIATES = f"""{_GEOMETRY}, {_CODES}, {_FRAME("pred")},
cv AS (SELECT ft.r, ft.c, d, log_len, cos2, sin2, ft.coherence, side, code AS sense, sqrt(two.d2) AS d_second FROM ft JOIN fr2 USING (r, c) JOIN nr USING (r, c) JOIN cd ON cd.r = nt[1] AND cd.c = nt[2])"""


def _covariates(spark, sf_dir):
    truth, prediction = event_roles(spark, sf_dir)
    every = cells_in(EVENT_GRID, spark)
    return features.catalogue_covariates(prediction, truth, _coded(spark, sf_dir), every, EVENT_GRID)


@query("catalogue_covariates", f"""WITH RECURSIVE {_COVARIATES} SELECT r AS "row", c AS col, round(d, 4) AS d, round(log_len, 4) AS log_len, round(cos2, 4) + 0.0 AS strike_cos2, round(sin2, 4) + 0.0 AS strike_sin2, round(coherence, 4) AS coherence, side::DOUBLE AS side, sense, round(d_second, 4) AS d_second FROM cv""")
def catalogue_covariates(spark, sf_dir):
    twice = F.radians(2 * F.col("strike_deg"))
    out = _covariates(spark, sf_dir).withColumns({"strike_cos2": F.cos(twice), "strike_sin2": F.sin(twice)})
    return out.select("row", "col", *[r4(c).alias(c) for c in ("d", "log_len", "strike_cos2", "strike_sin2", "coherence")], "side", "sense", r4("d_second").alias("d_second"))


@query("analytic_intensity", f"""WITH RECURSIVE {_COVARIATES}, i AS (SELECT r, c, CASE WHEN d > 30 THEN 0 ELSE 0.6 / (1 + d) END * CASE WHEN log_len < 0.7 THEN 0.5 WHEN log_len < 1.4 THEN 0.5 + 0.5 * (log_len - 0.7) / 0.7 WHEN log_len < 3 THEN 1 + 7 * (log_len - 1.4) / 1.6 ELSE 8 END
  * CASE sense WHEN 1 THEN 0.8 WHEN 2 THEN 1.5 ELSE 1 END AS p FROM cv)
SELECT r AS "row", c AS col, round(greatest(0, least(1, p)), 6) AS intensity FROM i""")
def analytic_intensity(spark, sf_dir):
    cells = _covariates(spark, sf_dir).withColumn("rate", 0.6 / (1 + F.col("d")))
    out = features.analytic_intensity(cells, "rate", [0.5, 1.0, 9.0], [0.7, 1.4, 3.0], {1: 0.8, 2: 1.5}, 30.0)
    return out.select("row", "col", r6("intensity").alias("intensity"))

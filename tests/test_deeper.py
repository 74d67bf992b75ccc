"""Brute force for the ordered, framed and fitted operators, and their edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators import allocate, crossfit, features, fields, fits, frames, portfolio, registry, stats, stencil, tensor
from rastra.operators.graph import connected_components
from rastra.sources import files, sink

GRID = GridSpec(40, 40)


def cells(spark, rows):
    return spark.createDataFrame(rows, "row int, col int")


def scattered(seed, n, size=40):
    rng = random.Random(seed)
    return sorted({(rng.randrange(size), rng.randrange(size)) for _ in range(n)})


def one_at_a_time(p, credit, n_truth, floor):
    """Rounds over plain dictionaries: the rule of greedy_rounds, candidate by candidate."""
    offs = stencil.kernel_offsets()
    order = sorted((rc for rc in credit if credit[rc] >= floor), key=lambda rc: (-credit[rc], rc))
    upper, open_, cover, out = dict(credit), set(order), {}, []
    t = m = 0.0
    bar = lambda: (lambda a: a / (1 - a))(0.2 * t / (0.2 * (t + len(out) - m) + 0.8 * n_truth + 1e-12))
    while True:
        before = len(out)
        for rc in [x for x in order if x in open_ and upper[x] > bar() * (1 - min(1, credit[x]))]:
            open_.discard(rc)
            if rc in out:
                continue
            gain = sum(p.get((rc[0] + a, rc[1] + b), 0) * max(0, k - cover.get((rc[0] + a, rc[1] + b), 0)) for a, b, k in offs)
            upper[rc] = gain
            if gain <= bar() * (1 - min(1, credit[rc])):
                continue
            out.append(rc)
            t, m = t + gain, m + min(1, credit[rc])
            for a, b, k in offs:
                cover[rc[0] + a, rc[1] + b] = max(k, cover.get((rc[0] + a, rc[1] + b), 0))
            open_ |= {x for x in order if abs(x[0] - rc[0]) <= 4 and abs(x[1] - rc[1]) <= 4 and x != rc}
        if len(out) == before:
            return out


def test_greedy_rounds_equal_one_candidate_after_the_other(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        p = {rc: round(rng.random(), 3) for rc in scattered(seed, 60, 20)}
        layer = spark.createDataFrame([(r, c, v) for (r, c), v in p.items()], "row int, col int, value double")
        credit = stencil.kernel_sum(layer, GRID).withColumn("credit", F.round("value", 9)).drop("value")
        table = credit.join(layer, ["row", "col"], "left").fillna(0.0, ["value"]).withColumn("fold", F.lit(1))
        got = allocate.greedy_rounds(table, "fold", 12.0).orderBy("rank").collect()
        known = {(r.row, r.col): r.credit for r in table.collect()}
        assert [(r.row, r.col) for r in got] == one_at_a_time(p, known, 12.0, 0.02) and len(got) > 5
        capped = allocate.greedy_rounds(table, "fold", 12.0, cap=3).orderBy("rank").collect()
        assert [(r.row, r.col) for r in capped] == [(r.row, r.col) for r in got[:3]]


def test_stratified_fill_equals_one_stratum_after_the_other(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), r, c, rng.randint(1, 9) / 10) for r, c in scattered(4, 500, 30)]
    quota = {0: 9, 1: 0, 2: 1000, 3: 12}
    kept, got = [], {s: 0 for s in quota}
    for s, r, c, v in sorted(rows, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if got[s] < quota[s] and all((r - a) ** 2 + (c - b) ** 2 > 9 for _, a, b in kept):
            kept.append((s, r, c))
            got[s] += 1
    table = spark.createDataFrame(rows, "stratum int, row int, col int, value double")
    out = allocate.stratified_fill(table, "stratum", spark.createDataFrame(list(quota.items()), "stratum int, quota int"), 3.0)
    assert sorted((r.stratum, r.row, r.col) for r in out.collect()) == sorted(kept)
    assert allocate.stratified_fill(table.limit(0), "stratum", spark.createDataFrame([(0, 1)], "stratum int, quota int"), 3.0).count() == 0


def test_component_frame_equals_brute_force_with_far_components(spark):
    for rows in ([(r, c, (r * 7 + c) % 5) for r, c in scattered(7, 60)], [(0, 0, 3), (39, 39, 1), (39, 38, 1), (0, 39, 2)], [(5, 5, 1), (6, 5, 1)]):
        out = {(r.row, r.col): r for r in frames.component_frame(spark.createDataFrame(rows, "row int, col int, comp_id long"), GRID).collect()}
        assert len(out) == 1600
        for y in range(0, 40, 3):
            for x in range(40):
                order = sorted(((y - r) ** 2 + (x - c) ** 2, r, c, k) for r, c, k in rows)
                second = next((o for o in order if o[3] != order[0][3]), (None,) * 4)
                got = out[y, x]
                assert (got.d2_1, got.near_row_1, got.near_col_1, got.comp_1) == order[0]
                assert (got.d2_2, got.near_row_2, got.near_col_2, got.comp_2) == second
    assert frames.component_frame(spark.createDataFrame([], "row int, col int, comp_id long"), GRID).count() == 0


def test_k_nearest_equals_a_sort(spark):
    there, asked = scattered(8, 30), [(0, 0), (20, 20), (39, 5)]
    got = frames.k_nearest(cells(spark, asked), cells(spark, there), 4, GRID, first=2).collect()
    for y, x in asked:
        want = sorted(((y - r) ** 2 + (x - c) ** 2, r, c) for r, c in there)[:4]
        assert [(r.d2, r.near_row, r.near_col) for r in sorted(got, key=lambda r: r.place) if (r.row, r.col) == (y, x)] == want
    assert frames.k_nearest(cells(spark, asked), cells(spark, there[:2]), 4, GRID).count() == 6


def test_strikes_without_another_component_are_censored(spark):
    visible = spark.createDataFrame([(5, c, 90.0, 0.9, 1) for c in range(20)] + [(30, c, 90.0, 0.9, 2) for c in range(3)], "row int, col int, strike_deg double, coherence double, comp_id long")
    hidden = spark.createDataFrame([(10, 10, 45.0, 0.9), (11, 10, 90.0, 0.1)], "row int, col int, strike_deg double, coherence double")
    out = {r.bin: (r.n_hidden, r.n_null, r.enrichment) for r in frames.strike_against_null(hidden, visible, GRID).collect()}
    assert out[4] == (1, 0, 1.0)  # 45 degrees: no null there; the incoherent cell does not count
    assert out[0] == (0, 3, 0.0)  # the cells of the short bar see the long one among their 13; the long bar's see themselves


def dense_gaussian(a, sigma, truncate, mirrored):
    w = np.array(tensor.gaussian_weights(sigma, truncate))
    r = len(w) // 2
    for axis in (0, 1):
        wide = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric" if mirrored else "constant")
        a = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, wide)
    return a


def test_edge_tangent_equals_the_dense_form_with_holes(spark):
    grid = GridSpec(150, 140)
    y, x = np.mgrid[0:150, 0:140]
    field = np.hypot(y - 70.0, x - 20.0) + 0.1 * x
    valid = np.ones(field.shape, bool)
    valid[40:44, 60:70] = False
    valid[129:, 100:] = False
    rows = [(int(r), int(c), float(field[r, c])) for r, c in zip(*np.nonzero(valid))] + [(41, 61, float("nan"))]
    got = {(r.row, r.col): r for r in fields.edge_tangent(spark.createDataFrame(rows, "row int, col int, value double"), grid).collect()}
    mass, total = dense_gaussian(valid.astype(float), 1.0, 3.0, False), dense_gaussian(np.where(valid, field, 0.0), 1.0, 3.0, False)
    gy, gx = np.gradient(np.divide(total, mass, out=np.zeros_like(total), where=mass > 1e-8))
    jxx, jyy, jxy = (dense_gaussian(v, 2.0, 3.0, True) for v in (gx * gx, gy * gy, gx * gy))
    inner = np.zeros(valid.shape, bool)
    inner[4:-4, 4:-4] = np.lib.stride_tricks.sliding_window_view(valid, (9, 9)).all((2, 3))
    assert set(got) == set(zip(*map(lambda v: v.tolist(), np.nonzero(inner & (gx * gx + gy * gy > 1e-12)))))
    for (r, c), g in got.items():
        n = gx[r, c] ** 2 + gy[r, c] ** 2
        coherence = min(1.0, math.sqrt((jxx[r, c] - jyy[r, c]) ** 2 + 4 * jxy[r, c] ** 2) / max(jxx[r, c] + jyy[r, c], 1e-12))
        assert np.allclose([g.cos2, g.sin2, g.log_gradient, g.coherence], [(gx[r, c] ** 2 - gy[r, c] ** 2) / n, 2 * gx[r, c] * gy[r, c] / n, math.log1p(math.sqrt(n)), coherence], atol=1e-9)


def test_a_straight_bar_does_not_turn_and_a_corner_does(spark):
    bar = cells(spark, [(20, c) for c in range(40)])
    corner = cells(spark, [(20, c) for c in range(21)] + [(r, 20) for r in range(20)])
    at = lambda mask: {(r.row, r.col): r for r in fields.bend_turn(mask, GRID).collect()}
    assert max(r.turn for r in at(bar).values()) < 1e-3
    turned = at(corner)
    assert turned[20, 20].turn > turned[20, 2].turn


def test_two_parallel_bars_face_each_other(spark):
    bars = [(r, c) for r in range(40) for c in (10, 30)]
    coded = spark.createDataFrame([(r, c, 1 if c == 10 else 2) for r, c in bars], "row int, col int, code int")
    scalar = spark.createDataFrame([(r, c, float(c)) for r in range(40) for c in range(40)], "row int, col int, value double")
    out = fields.relay_bend(cells(spark, [(20, 20), (20, 12)]), cells(spark, bars), coded, scalar, GRID)
    assert out.columns == ["row", "col", *features.GEOMETRY, *features.SENSE, *fields.RELAY_BEND]
    rows = {r.col: r for r in out.collect()}
    mid, near = rows[20], rows[12]
    assert math.isclose(mid.d_second, 10) and math.isclose(mid.relay_ratio, 0.5) and math.isclose(mid.relay_facing, 1) and math.isclose(mid.host_cos2, 1, abs_tol=1e-6)
    assert math.isclose(near.d_second, 18) and math.isclose(near.relay_ratio, 0.1) and math.isclose(near.log_len_second, math.log1p(40))
    assert math.isclose(mid.edge_relative, 1, abs_tol=1e-6) and mid.sense_mix > near.sense_mix > 0
    alone = fields.relay_bend(cells(spark, [(20, 20)]), cells(spark, bars[::2]), coded, scalar, GRID).first()
    assert alone.d_second is None and alone.relay_ratio is None and alone.host_cos2 is None and alone.sense_mix == 0.0 or alone.d_second is None


def test_nonnegative_fit_meets_its_conditions(spark):
    r = np.random.default_rng(3)
    for _ in range(30):
        n, m = int(r.integers(1, 7)), int(r.integers(1, 12))
        a, b = r.normal(0, 1, (m, n)), r.normal(0, 1, m)
        q, c = a.T @ a, a.T @ b
        x = fits.nonnegative(q, c)
        slack = q @ x - c
        assert (x >= 0).all() and (slack > -1e-6).all() and abs(x @ slack) < 1e-6
    a, b = np.abs(r.normal(0, 1, (9, 3))), np.abs(r.normal(0, 1, 9))
    rows = spark.createDataFrame([(i, *map(float, a[i]), float(b[i]), 1.0 + i) for i in range(9)] + [(99, None, 1.0, 1.0, 1.0, 1.0)], "k int, x double, y double, z double, b double, w double")
    got = {g.k: g for g in fits.nonnegative_fit(rows, "k", ["x", "y", "z"], "b", "w").collect()}
    w2 = np.diag((1.0 + np.arange(9)) ** 2)
    whole = fits.nonnegative(a.T @ w2 @ a, a.T @ w2 @ b)
    assert set(got) == set(range(9)) and all(math.isclose(got[i].fitted, float(a[i] @ whole), abs_tol=1e-9) for i in range(9))
    keep = [i for i in range(9) if i != 4]
    left = fits.nonnegative(a[keep].T @ w2[np.ix_(keep, keep)] @ a[keep], a[keep].T @ w2[np.ix_(keep, keep)] @ b[keep])
    assert math.isclose(got[4].left_out, float(a[4] @ left), abs_tol=1e-9)


def test_rank_p_values_equal_the_tabulated_ones(spark):
    # rho for which Student's t with n - 2 degrees of freedom is at its tabulated two-sided 5 % and 1 % points
    table = [(1, 12.7062, 0.05), (2, 4.30265, 0.05), (3, 3.18245, 0.05), (8, 2.30600, 0.05), (8, 3.35539, 0.01), (25, 2.05954, 0.05), (60, 2.66028, 0.01), (998, 1.96234, 0.05), (998, 2.58077, 0.01)]
    rows = [(f + 2, t / math.sqrt(f + t * t), p) for f, t, p in table] + [(3, 1.0, 0.0), (10, 0.0, 1.0), (5, -1.0, 0.0)]
    out = spark.createDataFrame(rows, "n long, rho double, p double").select("p", fits.rank_p_value(F.col("rho"), F.col("n")).alias("got")).collect()
    assert all(math.isclose(r.got, r.p, abs_tol=2e-6) for r in out)
    assert spark.range(1).select(fits.rank_p_value(F.lit(0.5), F.lit(2)).alias("a"), fits.rank_p_value(F.lit(None).cast("double"), F.lit(9)).alias("b")).first() == (None, None)


def test_undefined_statistics_are_null_and_null_groups_stay(spark):
    rows = spark.createDataFrame([("a", 1.0, float(i)) for i in range(4)] + [(None, float(i), float(i * i)) for i in range(4)] + [("c", float("inf"), 1.0)], "g string, x double, y double")
    got = {r.g: (r.n, r.pearson, r.spearman) for r in stats.correlations(rows, "x", "y", ["g"]).collect()}
    assert got["a"] == (4, None, None) and got[None][2] == pytest.approx(1.0) and "c" not in got
    rho = {r.g: r.rho for r in stats.spearman(rows.where("g is null or g = 'a'"), "x", "y", ["g"]).collect()}
    assert rho["a"] is None and rho[None] == pytest.approx(1.0)
    finite = rows.where("x < 1e9")
    assert stats.rank_to_byte(finite, "x", ["g"]).count() == stats.robust_z(finite, "x", ["g"]).count() == stats.dense_rank_of(finite, "x", ["g"]).count() == 8
    assert stats.power_law(finite.where("x > 0"), "x", "y", [0.5, 1.5], least=1).first() == (None, None)


def test_components_by_rounds_equal_those_in_one_task(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(300, 400)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = [sorted(map(tuple, connected_components(df, small=n).select("node", "component").collect())) for n in (0, 10**6)]
    assert found[0] == found[1] and len(found[0]) > 300


def test_surfaces_are_committed_whole_or_not_at_all(spark, tmp_path):
    grid, path = GridSpec(400, 400), str(tmp_path / "s")
    good = spark.createDataFrame([(0, 0, 0.5), (300, 1, 1.0), (2, 2, 0.0)], "row int, col int, value double")
    failing = good.withColumn("value", F.when(F.col("row") == 300, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    foot = cells(spark, [(0, 0)])
    for bad, more in ((failing, {}), (good.withColumn("value", F.lit(2.0)), {}), (good, {"footprint": foot}), (good, {"catalogue": foot}), (good.unionByName(good), {})):
        with pytest.raises(Exception):
            sink.commit_surface(bad, path, grid, "n", "note", **more)
        assert list(tmp_path.iterdir()) == []
    for name, note in (("", "x"), ("x", " "), ("x" * 141, "x")):
        with pytest.raises(ValueError, match="140"):
            sink.commit_surface(good, path, grid, name, note)
    receipt = sink.commit_surface(good, path, grid, "n", "note", metadata={"seed": "1"})
    assert sink.read_receipt(spark, path) == receipt and receipt["n_cells"] == 3 and receipt["n_positive"] == 2
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["s"]
    with pytest.raises(FileExistsError):
        sink.commit_surface(good, path, grid, "n", "note")
    good.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="receipt"):
        sink.read_receipt(spark, path)


def test_merging_a_listing_twice_changes_nothing(spark):
    state = spark.createDataFrame([("h1", ["a:1"]), ("h2", ["a:2", "b:2"])], "sha256 string, sources array<string>")
    rows = [("a:1", "h1", 5), ("c:1", "h1", 5), ("c:3", "h3", 5), ("d:3", "h3", 5), ("c:own", "h4", 5), ("in/x", "h5", 5), ("c:big", "h6", 500)]
    listing, own = spark.createDataFrame(rows, "source string, sha256 string, bytes long"), spark.createDataFrame([("h4",)], "sha256 string")
    merged, log = registry.merged_state(state, listing, own, "^in/", 100)
    assert {r.source: r.kind for r in log.collect()} == {"a:1": "known", "c:1": "alias", "c:3": "new", "d:3": "new", "c:own": "own", "in/x": "input", "c:big": "too_large"}
    want = {"h1": ["a:1", "c:1"], "h2": ["a:2", "b:2"], "h3": ["c:3", "d:3"]}
    assert {r.sha256: r.sources for r in merged.collect()} == want
    again, log = registry.merged_state(merged, listing, own, "^in/", 100)
    assert {r.sha256: r.sources for r in again.collect()} == want and not log.where("kind in ('new', 'alias')").count()
    assert registry.same_keys(merged, again, "sha256").count() == 3
    with pytest.raises(Exception, match="keys differ"):
        registry.same_keys(merged, state, "sha256").collect()


def test_no_fold_scores_itself(spark):
    rng = random.Random(11)
    rows = [(i, i % 4, rng.random(), rng.randrange(2)) for i in range(400)]
    make = lambda rows: {r.k: r for r in crossfit.density_ratio(spark.createDataFrame(rows, "k int, fold int, x double, y int"), "fold", "y", {"x": [0.0, 0.25, 0.5, 1.0]}).collect()}
    before = make(rows)
    after = make([(k, f, x, 1 - y if f == 2 else y) for k, f, x, y in rows])  # other labels in fold 2
    assert all(before[k].p == after[k].p for k, f, *_ in rows if f == 2)
    assert any(before[k].p != after[k].p for k, f, *_ in rows if f != 2)
    bins = lambda x: 0 if x < 0.25 else 1 if x < 0.5 else 2
    k, f, x, _ = rows[5]
    n = lambda y, b=None: sum(r[1] != f and r[3] == y and (b is None or bins(r[2]) == b) for r in rows)
    want = math.log((n(1, bins(x)) + 1) / (n(1) + 4) / ((n(0, bins(x)) + 1) / (n(0) + 4)))
    assert math.isclose(before[k].log_ratio, want)
    alone = make([(k, 0, x, y) for k, _, x, y in rows[:20]])
    assert all(math.isclose(r.p, 0.5) for r in alone.values())


def test_credit_does_not_cross_folds(spark):
    truth = spark.createDataFrame([(1, 5, 5), (2, 5, 6), (3, 9, 9)], "fold int, row int, col int")
    dots = spark.createDataFrame([(1, 5, 6, 1.0), (4, 0, 0, 1.0)], "fold int, row int, col int, value double")
    got = {r.fold: r for r in crossfit.fold_scores(truth, dots, "fold").collect()}
    assert math.isclose(got[1].tp, 2 / 3) and math.isclose(got[1].fp, 1 / 3) and got[2].tp == 0 and got[3].dti == 0
    assert (got[4].n_truth, got[4].n_dots, got[4].fp, got[4].dti) == (0, 1, 1.0, 0.0)


def test_layers_that_are_not_nested_raise(spark):
    chain = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 2), (2, 0, 1), (2, 0, 2), (3, 0, 2)], "step int, row int, col int")
    credits = spark.createDataFrame([(1, 6.0), (2, 5.0), (3, 3.0)], "step int, credit double")
    d = spark.createDataFrame([(0, c, float(c)) for c in range(4)], "row int, col int, d double")
    got = [tuple(r) for r in portfolio.shells(chain, credits, d).orderBy("step").collect()]
    assert got == [(1, 1, 1.0, 1.0, 0.0), (2, 1, 2.0, 2.0, 1.0), (3, 1, 3.0, 3.0, 2.0)]
    with pytest.raises(Exception, match="not nested"):
        portfolio.shells(chain.unionByName(spark.createDataFrame([(3, 0, 3)], chain.schema)), credits, d).collect()


def test_portfolio_of_far_and_single_dots(spark):
    layers = spark.createDataFrame([("a", 0, 0, 0.5), ("a", 0, 39, 1.0), ("b", 20, 20, 0.25)], "layer string, row int, col int, value double")
    got = {r.layer: r for r in portfolio.portfolio(layers, cells(spark, [(0, 0), (39, 39)]), GRID).collect()}
    assert (got["a"].dots, got["a"].d_least, got["a"].spacing_median, got["a"].hit_share, got["a"].near_share) == (2, 0.0, 39.0, 0.5, 0.5)
    assert got["b"].spacing_median is None and math.isclose(got["b"].d_median, math.hypot(19, 19))
    table = spark.createDataFrame([(i, 5.0, float(i * i)) for i in range(6)], "score int, flat double, up double")
    out = {r.measure: r for r in portfolio.score_correlations(table, "score", ["flat", "up"]).collect()}
    assert out["flat"].rho is None and out["flat"].p is None and math.isclose(out["up"].rho, 1) and out["up"].p < 1e-9


def test_prior_files_leave_out_inputs_own_and_copies(spark, tmp_path):
    for name, text in (("a/x.tif", "same"), ("b/y.tif", "same"), ("b/own.tif", "mine"), ("a/input_z.tif", "input"), ("a/small.tif", ""), ("a/n.txt", "other")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    own = spark.createDataFrame([("mine",)], "t string").select(F.sha2("t", 256).alias("sha256"))
    got = files.prior_files(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path)], "*.tif", "input_", own, 1).collect()
    assert [(r.path.rsplit("/", 2)[1:], r.copies, r.bytes) for r in got] == [(["a", "x.tif"], 2, 4)]
    with pytest.raises(Exception):
        files.prior_files(spark, [str(tmp_path / "none")]).collect()
    here = files.hashed_files(spark, str(tmp_path), "*.tif")
    want = here.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    assert files.require_files(here, want).count() == here.count() > 2
    for name, what in (("gone.tif", "gone.tif: missing"), ("x.tif", "x.tif: another content")):
        with pytest.raises(Exception, match=what):
            files.require_files(here, want.unionByName(spark.createDataFrame([(name, "0")], "name string, sha256 string"))).collect()

"""Hand-checkable cases and brute force on small grids."""

import math
import random

import pytest

from rastra.grid import GridSpec
from rastra.operators import allocate, components, masks, metric, nearest, registry, split, stats, stencil, tensor, validate, vector

GRID = GridSpec(30, 30)


def cells(spark, rows):
    return spark.createDataFrame(rows, "row int, col int")


def valued(spark, rows):
    return spark.createDataFrame(rows, "row int, col int, value double")


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def scattered(seed, n, size=30):
    rng = random.Random(seed)
    return sorted({(rng.randrange(size), rng.randrange(size)) for _ in range(n)})


def test_kernel_and_offsets():
    assert [round(stencil.kernel(d), 9) for d in (0, 1, 3)] == [1, round(2 / 3, 9), 0]
    offsets = stencil.kernel_offsets()
    assert len(offsets) == 25 and math.isclose(sum(k for *_, k in offsets), 9.380298, abs_tol=1e-6)
    assert len(stencil.disk_offsets(3)) == 29


def test_two_dots_one_truth(spark):
    out = metric.score(cells(spark, [(15, 15)]), valued(spark, [(15, 15, 1.0), (15, 16, 1.0)])).first()
    assert out.n_truth == 1 and math.isclose(out.tp, 1) and math.isclose(out.fp, 1 / 3)


def test_metric_equals_brute_force_and_blocks_add_up(spark):
    truth, dots = scattered(1, 40), [(r, c, round(random.Random(r * 31 + c).random(), 3) + 0.001) for r, c in scattered(2, 60)]
    k = lambda a, b: stencil.kernel(math.hypot(a[0] - b[0], a[1] - b[1]))
    tp = sum(max(v * k(t, (r, c)) for r, c, v in dots) for t in truth)
    fp = sum(v * (1 - max(k(t, (r, c)) for t in truth)) for r, c, v in dots)
    out = metric.score(cells(spark, truth), valued(spark, dots)).first()
    assert math.isclose(out.tp, tp) and math.isclose(out.fp, fp) and math.isclose(out.fn, len(truth) - tp)
    blocks = metric.block_terms(cells(spark, truth), valued(spark, dots), 7).collect()
    assert math.isclose(sum(b.tp for b in blocks), tp) and sum(b.n_truth for b in blocks) == len(truth)


def test_metric_without_truth_or_dots(spark):
    assert metric.score(cells(spark, []), valued(spark, [(1, 1, 1.0)])).first().dti == 0
    out = metric.score(cells(spark, [(1, 1)]), valued(spark, [])).first()
    assert out.fn == 1 and out.dti == 0


def test_expected_credit(spark):
    out = {(r, c): v for r, c, v in got(stencil.kernel_sum(valued(spark, [(10, 10, 1.0)]), GRID), "row", "col", "value")}
    assert out[10, 10] == 1 and math.isclose(out[10, 11], 2 / 3) and (10, 13) not in out


def test_dilation_shapes_and_erosion(spark):
    one = cells(spark, [(5, 5)])
    assert stencil.dilate(one, stencil.diamond_offsets(1), GRID).count() == 5
    square = stencil.dilate(one, stencil.square_offsets(1), GRID)
    assert square.count() == 9
    assert got(stencil.erode(square, stencil.square_offsets(1), GRID), "row", "col") == [(5, 5)]
    corner = stencil.dilate(cells(spark, [(0, 0)]), stencil.square_offsets(1), GRID)
    assert corner.count() == 4 and stencil.erode(corner, stencil.square_offsets(1), GRID).count() == 0


def test_mask_algebra(spark):
    a, b = cells(spark, [(1, 1), (2, 2)]), cells(spark, [(2, 2), (3, 3)])
    assert got(masks.mask_and(a, b), "row", "col") == [(2, 2)]
    assert got(masks.mask_and_not(a, b), "row", "col") == [(1, 1)]
    assert masks.mask_or(a, b).count() == 3
    assert masks.same_mask(a, a) and not masks.same_mask(a, b)


@pytest.mark.parametrize("rows", [[(0, 0)], scattered(3, 25), [(29, 0), (0, 29)]])
def test_distance_transform_equals_brute_force(spark, rows):
    out = nearest.distance_transform(cells(spark, rows), GRID).collect()
    assert len(out) == 900
    for o in out:
        d, r, c = min(((o.row - r) ** 2 + (o.col - c) ** 2, r, c) for r, c in rows)
        assert (o.d2, o.near_row, o.near_col) == (d, r, c)


def test_distance_transform_of_nothing(spark):
    out = nearest.distance_transform(cells(spark, []), GridSpec(3, 4)).collect()
    assert len(out) == 12 and all(o.d2 is None for o in out)


def test_components_against_flood_fill(spark):
    rows = scattered(5, 250)
    left, want = set(rows), {}
    while left:
        seed = min(left)
        todo, group = [seed], []
        left.discard(seed)
        while todo:
            r, c = todo.pop()
            group.append((r, c))
            for n in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    todo.append(n)
        want |= {x: seed[0] * 30 + seed[1] for x in group}
    labelled = components.label8(cells(spark, rows), GRID)
    assert {(r, c): k for r, c, k in got(labelled, "row", "col", "comp_id")} == want


def test_segments_and_strike(spark):
    bars = cells(spark, [(10, c) for c in range(5, 12)] + [(r, 20) for r in range(5, 12)] + [(25, 25)])
    table = {r.comp_id: r for r in components.segment_table(components.label8(bars, GRID)).collect()}
    assert math.isclose(table[10 * 30 + 5].strike_deg, 90) and math.isclose(table[5 * 30 + 20].strike_deg % 180, 0, abs_tol=1e-9)
    assert table[25 * 30 + 25].strike_deg is None
    assert components.detached(components.label8(bars, GRID)).count() == 3


def test_overlap_radius_is_closed(spark):
    candidate = cells(spark, [(10, 10)])
    layers = spark.createDataFrame([(1, 10, 13), (2, 13, 13)], "layer int, row int, col int")
    assert got(registry.overlap(candidate, layers), "layer", "overlap") == [(1, 1.0), (2, 0.0)]
    assert got(registry.certificate(candidate, layers), "layer", "uncovered", "saturated") == [(1, 0, True), (2, 1, False)]


def test_incomplete_registry_is_never_unique(spark):
    layers = spark.createDataFrame([(1, 20, 20)], "layer int, row int, col int")
    audited = registry.audit(cells(spark, [(1, 1)]), layers)
    assert registry.audit_summary(audited, True).first().unique and not registry.audit_summary(audited, False).first().unique


def test_average_rank_and_auc(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("a", 2.0, 0), ("a", 3.0, 1)], "g string, x double, y int")
    assert sorted(r["rank"] for r in stats.average_rank(df, "x", ["g"]).collect()) == [1, 2.5, 2.5, 4]
    assert math.isclose(stats.auc(df, "x", "y", ["g"], 1).first().auc, 0.875)


def test_tile_best_and_budget(spark):
    surface = valued(spark, [(0, 0, 0.5), (0, 1, 0.5), (9, 9, 0.7), (20, 20, 0.1)])
    ranked = allocate.decimated_ranking(surface, 8, 2)
    assert got(ranked, "rank", "row", "col") == [(1, 9, 9), (2, 0, 0)]


def test_quotas_sum_to_total(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double")
    assert [q for _, q in got(allocate.quotas(w, "k", "w", 10), "k", "quota")] == [4, 3, 3]


def test_marginal_pass_accepts_only_gains(spark):
    rows = [(1, 10, c, 0.9, 0.9) for c in (5, 15, 25)] + [(1, 2, 2, 0.001, 0.001)]
    out = allocate.marginal_pass(spark.createDataFrame(rows, "fold int, row int, col int, value double, credit double"), "fold", 3.0)
    assert got(out, "row", "col") == [(10, 5), (10, 15), (10, 25)]


def test_registered_marginal_pass_goes_on_after_a_run_of_rejections(spark, monkeypatch):
    from rastra.plans import queries

    block = [(r, c, 0.9) for r in range(10, 16) for c in range(10, 16)]
    ring = [(r, c, 0.0) for i in range(11, 15) for r, c in ((8, i), (17, i), (i, 8), (i, 17))]  # all credit from the block
    rows = [("click", *x) for x in [*block, *ring, (40, 40, 0.6)]]
    cells = spark.createDataFrame(rows, "layer string, row int, col int, value double")
    monkeypatch.setattr(queries, "event_cells", lambda *_: cells)
    used = {}
    real = allocate.marginal_pass
    monkeypatch.setattr(allocate, "marginal_pass", lambda c, *a, **k: used.update(cells=c) or real(c, *a, **k))
    whole = got(queries.marginal_pass(spark, ""), "row", "col")
    assert whole == [(r, c) for r, c, _ in block] + [(40, 40)]
    assert (40, 40) not in got(real(used["cells"], "fold", 120.0, patience=5), "row", "col")
    assert set(got(real(used["cells"], "fold", 120.0), "row", "col")) <= set(whole)


def test_rasterise_and_sense(spark):
    rows = [(1, 0, 0.0, 0.0, 3.0, 0.0, "RL"), (2, 1, 3.0, 0.0, 3.0, 3.0, "LL"), (3, 2, 1.0, 0.0, 1.0, 0.0, None)]
    traces = spark.createDataFrame(rows, "record_id int, row_no int, x0 double, y0 double, x1 double, y1 double, sense string")
    assert vector.rasterise(traces, GRID).count() == 7
    codes = {(r, c): k for r, c, k in got(vector.sense_raster(traces, GRID), "row", "col", "code")}
    assert codes[0, 0] == 2 and codes[0, 3] == 3 and codes[0, 1] == 2


def test_non_finite_trace_raises(spark):
    traces = spark.createDataFrame([(1, 0, float("nan"), 0.0, 1.0, 1.0, "N")], "record_id int, row_no int, x0 double, y0 double, x1 double, y1 double, sense string")
    with pytest.raises(Exception, match="non-finite"):
        vector.rasterise(traces, GRID).count()


def test_buffered_draw_hides_whole_components(spark):
    bars = cells(spark, [(r, c) for r in range(0, 30, 5) for c in range(6)])
    labelled = components.label8(bars, GRID)
    roles = {(r, c): x for r, c, x in got(split.buffered_draw(labelled, 0.3, 3.0, 1), "row", "col", "role")}
    by_comp = {}
    for (r, _), role in roles.items():
        by_comp.setdefault(r, set()).add(role == "hidden")
    assert all(len(x) == 1 for x in by_comp.values()) and any(True in x for x in by_comp.values())


def test_gradient_and_tensor_of_a_ramp(spark):
    dense = valued(spark, [(r, c, float(c)) for r in range(12) for c in range(12)])
    g = tensor.gradient(dense).collect()
    assert all(x.g_col == 1 and x.g_row == 0 for x in g)
    mid = {(r.row, r.col): r for r in tensor.structure_tensor(dense, GridSpec(12, 12), 1.0).collect()}[6, 6]
    assert math.isclose(mid.coherence, 1) and math.isclose(mid.strike_deg % 180, 0, abs_tol=1e-9)


def test_checks_name_what_fails(spark):
    bad = valued(spark, [(0, 0, 2.0), (40, 0, 0.5), (1, 1, float("nan"))])
    failed = {c for c, ok in got(validate.checks(bad, GRID), "check", "passed") if not ok}
    assert failed == {"in_range", "inside_grid", "finite"}
    with pytest.raises(ValueError, match="finite"):
        validate.assert_valid(validate.checks(bad, GRID))

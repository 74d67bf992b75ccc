"""Whole jobs and edge cases that a review found."""

import math

from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators import allocate, metric, nearest, profiles, tensor, vector
from rastra.plans import more


def test_candidates_are_all_cells_of_the_floor_without_a_budget(spark):
    cells = spark.range(30).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), (F.col("id") / 20).alias("credit"))
    assert sorted(r.row for r in allocate.candidates(cells, 0.5).collect()) == list(range(10, 30))
    assert sorted(r.row for r in allocate.candidates(cells, 0.5, 3).collect()) == [27, 28, 29]
    assert more.QUERIES["candidates"](spark, "/root/testdata/sf0.1").count() > 10
    assert "LIMIT" not in more.ORACLE_SQL["candidates"]


def test_thinned_scores_count_dots_of_value_zero(spark):
    truth = spark.createDataFrame([(5, 5)], "row int, col int")
    dots = spark.createDataFrame([(5, 6, 0.5), (9, 9, 0.0), (20, 20, 0.25), (21, 21, None), (22, 22, float("nan"))], "row int, col int, value double")
    out = metric.thinned_scores(truth, dots, [1.0]).first()
    tp, fp = 0.5 * 2 / 3, 0.5 / 3 + 0.25
    assert out.n_dots == 3 and abs(out.dti - tp / (tp + 0.2 * fp + 0.8 * (1 - tp))) < 1e-9


def by_bin(df, column):
    return [r[column] for r in df.orderBy("bin").collect()]


def test_a_splice_without_an_edge_is_not_a_number(spark):
    at = lambda values: spark.createDataFrame([(v,) for v in values], "d double")
    edges, inner = [0.0, 1.0, 2.0, 3.0], [0.0, 1.0, 2.0]
    far = profiles.density(at([0.5, 2.5, 2.5, 2.5]), "d", edges)
    for near, want in (([], ["nan", "nan", 0.75]), ([0.5], ["inf", "nan", 0.75]), ([0.5, 0.5, 1.5], [1.5, 0.75, 0.75])):
        got = by_bin(profiles.spliced(far, profiles.density(at(near), "d", inner), 2), "density")
        assert repr(got) == repr([float(x) for x in want])
    assert all(math.isnan(x) for x in by_bin(profiles.density(at([]), "d", edges), "density"))


def test_medians_over_a_zero_median_have_no_scale(spark):
    rows = spark.createDataFrame([(0.0, 0.1)] * 60 + [(2.0, 0.9)] * 40, "d double, v double")
    assert repr(by_bin(profiles.length_scaling(rows, "d", "v", [0.0, 0.5, 1.0]), "scale")) == "[nan, inf]"


def test_cells_without_a_direction_have_strike_0(spark):
    square = [(r, c) for r in (36, 40, 44) for c in (36, 40, 44)]  # rounding leaves its centre a difference just below 0
    out = tensor.local_strike(spark.createDataFrame(square, "row int, col int"), GridSpec(80, 80)).where("row = 40 and col = 40").first()
    assert (out.strike_deg, out.coherence) == (0.0, 0.0)


def under_joins(plan):
    """Names of the nodes right under a logical plan's joins, projections and filters apart."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    out = [x for c in children for x in under_joins(c)]
    if "Join" in plan.nodeName():
        for c in children:
            while c.nodeName() in ("Project", "Filter"):
                c = c.children().apply(0)
            out.append(c.nodeName())
    return out


def test_records_join_lines_and_not_their_pixels(spark):
    lines = [(1, 1, 0.0, 0.0, 9.0, 9.0, "1"), (1, 2, 9.0, 9.0, 9.0, 3.0, "2"), (1, 3, 9.0, 3.0, 12.0, 3.0, "2"), (2, 4, 5.0, 5.0, 5.0, 5.0, None)]
    traces = spark.createDataFrame(lines, "record_id int, row_no int, x0 double, y0 double, x1 double, y1 double, sense string")
    out = vector.record_segments(traces, GridSpec(20, 20), ["1", "2"], 1.0)
    one, two = sorted(out.collect())
    pixels = vector.pixelise(traces.where("record_id = 1"), GridSpec(20, 20)).toPandas()
    dr, dc = pixels["row"] - pixels["row"].mean(), pixels["col"] - pixels["col"].mean()
    a = 0.5 * math.atan2(2 * (dr * dc).mean(), (dr * dr).mean() - (dc * dc).mean())
    along = dr * math.cos(a) + dc * math.sin(a)
    assert (one.n_fragments, one.size, one.sense) == (3, 21, "2") and abs(one.span - (along.max() - along.min())) < 1e-9
    assert abs(one.strike_deg - math.degrees(a) % 180) < 1e-9 and abs(one.length - (162**0.5 + 9)) < 1e-9
    assert (two.n_fragments, two.size, two.span, two.strike_deg, two.sense) == (1, 1, 0.0, 0.0, "unk")
    assert "Generate" not in under_joins(out._jdf.queryExecution().optimizedPlan())


def test_nearest_within_sorts_no_pairs(spark):
    mask = [(r, c) for r in range(0, 30, 3) for c in range(0, 30, 4)] + [(1, 1), (31, 45)]
    asked = [(r, c) for r in range(-4, 40) for c in range(-4, 40)]
    out = nearest.nearest_within(spark.createDataFrame(asked, "row int, col int"), spark.createDataFrame(mask, "row int, col int"), 4.5)
    best = {q: min(((q[0] - r) ** 2 + (q[1] - c) ** 2, r, c) for r, c in mask) for q in asked}
    assert {(r.row, r.col): (r.d2, r.near_row, r.near_col) for r in out.collect()} == {q: b for q, b in best.items() if b[0] <= 4.5**2}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()

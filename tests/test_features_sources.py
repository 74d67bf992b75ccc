"""Feature tables, sources and sinks, and the streaming extension."""

import hashlib
import json
import math
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from rastra.grid import GridSpec
from rastra.operators import allocate, components, features, registry, split, stats, tensor
from rastra.sources import feeds, files
from rastra.streaming.cells import append_layer, cell_windows, read_events


def cells(spark, rows):
    return spark.createDataFrame(rows, "row int, col int")


def test_offset_frame_of_an_east_west_bar(spark):
    bar = cells(spark, [(20, c) for c in range(40)])
    out = features.geometry(cells(spark, [(10, 20)]), bar, GridSpec(40, 40)).first()
    assert math.isclose(out.d, 10) and math.isclose(out.d_perp, 10) and math.isclose(out.d_par_abs, 0, abs_tol=1e-9)
    assert math.isclose(out.cos2, -1) and math.isclose(out.coherence, 1) and math.isclose(out.cos2d, -10)  # the product with the distance


def test_relay_midpoint(spark):
    bars = cells(spark, [(r, c) for r in range(48) for c in (12, 34)])
    out = features.relay(cells(spark, [(24, 23), (24, 12)]), bars, GridSpec(48, 48), 22)
    assert {r.col: r.relay_ratio for r in out.collect()} == {23: 0.5, 12: 0.0}


def test_branches_are_cut_in_chunks(spark):
    bar = cells(spark, [(5, c) for c in range(30)])
    chunks = [r["count"] for r in components.branches(bar, GridSpec(10, 30)).groupBy("chunk_no").count().orderBy("chunk_no").collect()]
    assert chunks == [12, 12, 6]


def test_sense_is_taken_within_one_cell_of_the_anchor(spark):
    bar = cells(spark, [(20, c) for c in range(40)])
    sense = spark.createDataFrame([(20, 5, 2), (20, 30, 3), (1, 1, 2)], "row int, col int, code int")
    out = features.geometry(cells(spark, [(10, 5), (30, 31), (10, 15)]), bar, GridSpec(40, 40), sense)
    assert {r.col: r.sense_sgn for r in out.collect()} == {5: 1.0, 31: -1.0, 15: 0.0}
    assert all(r.sense_side == r.sense_sgn * r.side for r in out.collect())


def test_links_need_gap_strike_and_way(spark):
    rows = [(1, 0.0, 0.0, 0.0, 10.0, 90.0), (2, 0.0, 12.0, 0.0, 20.0, 85.0), (3, 0.0, 22.0, 9.0, 22.0, 0.0), (4, 3.0, 0.0, 3.0, 10.0, 90.0), (5, 30.0, 0.0, 30.0, 9.0, 90.0)]
    out = components.links(spark.createDataFrame(rows, "comp_id long, r0 double, c0 double, r1 double, c1 double, strike_deg double"))
    assert [tuple(r) for r in out.collect()] == [(1, 2)]  # 3 turns, 4 lies beside 1, 5 is far


def test_spaced_cells_equal_one_after_the_other(spark):
    rng = random.Random(2)
    rows = [(r, c, rng.randint(1, 9) / 10) for r in range(14) for c in range(14)]
    kept = []
    for r, c, _ in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if all((r - a) ** 2 + (c - b) ** 2 > 9 for a, b in kept):
            kept.append((r, c))
    out = allocate.spaced(spark.createDataFrame(rows, "row int, col int, value double"), 3.0)
    assert sorted((r.row, r.col) for r in out.collect()) == sorted(kept)


def test_ranks_keep_null_values_and_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0), (None, 2.0)], "g string, x double")
    assert sorted((r.g or "", r.x or 0.0, r["rank"]) for r in stats.average_rank(df, "x", ["g"]).collect() if r.x) == [("", 2.0, 1.0), ("", 3.0, 2.0), ("a", 1.0, 1.0)]
    assert [r["rank"] for r in stats.average_rank(df, "x", ["g"]).where("x is null").collect()] == [None]


def test_local_strike_of_diagonals(spark):
    mask = cells(spark, [(i, i) for i in range(10, 70)])
    out = tensor.local_strike(mask, GridSpec(80, 80)).where("row = 40").first()
    assert math.isclose(out.strike_deg, 135.0, abs_tol=1e-6) and out.coherence > 0.9


def test_leaderboard_is_checked(spark):
    page = lambda rows: "<table>" + "".join(f"<tr><td>{r}<td>x<td>{n}<td>{s}" for r, n, s in rows) + "</table>"
    make = lambda *rows: spark.createDataFrame([(1, page(rows))], "page_id long, html string")
    good = feeds.leaderboard(make(("1", "ann", "0.9000"), ("#2", "bob", "0.5000"), ("x", "c", "0.1000"))).collect()
    assert [(r["rank"], r.participant, r.score) for r in good] == [(1, "ann", 0.9), (2, "bob", 0.5)]
    for bad in ((("2", "a", "0.9000"),), (("1", "a", "0.5000"), ("2", "b", "0.9000")), (("1", "a", "0.9000"), ("1", "b", "0.5000"))):
        with pytest.raises(Exception, match="leaderboard"):
            feeds.leaderboard(make(*bad)).collect()


def test_merged_rows_must_agree(spark):
    old = spark.createDataFrame([("h", 1.0, ["b"]), ("i", 2.0, ["a"])], "sha256 string, m double, sources array<string>")
    new = spark.createDataFrame([("h", 1.0, ["a", "b"])], "sha256 string, m double, sources array<string>")
    assert sorted(tuple(r) for r in registry.merge_rows(old, new, ["m"]).collect()) == [("h", 1.0, ["a", "b"]), ("i", 2.0, ["a"])]
    with pytest.raises(Exception, match="unlike"):
        registry.merge_rows(old, new.withColumn("m", F.lit(3.0)), ["m"]).collect()


def test_weighted_negatives_keep_the_mass(spark):
    rows = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(200)], "id int, g int, y int")
    out = split.weighted_negatives(rows, "y", "g", ["id"], 30, 1)
    assert math.isclose(out.agg(F.sum("weight")).first()[0], 200)


def test_trace_csv_and_hashes(spark, tmp_path):
    (tmp_path / "t.csv").write_text("record_id,x0,y0,x1,y1,sense\n1,0,0,3,0,RL\n1,3,0,3,2,\n")
    rows = files.read_traces(spark, str(tmp_path / "t.csv")).orderBy("row_no").collect()
    assert [(r.record_id, r.x1, r.sense) for r in rows] == [(1, 3.0, "RL"), (1, 3.0, None)]
    out = files.hashed_files(spark, str(tmp_path), "*.csv").first()
    data = (tmp_path / "t.csv").read_bytes()
    assert out.bytes == len(data) and out.sha256 == hashlib.sha256(data).hexdigest()
    want = subprocess.run(["git", "hash-object", str(tmp_path / "t.csv")], capture_output=True, text=True).stdout.strip()
    got = spark.createDataFrame([(bytearray(data),)], "c binary").select(files.blob_id("c").alias("id")).first().id
    assert got == want or not want


def test_registry_certificate(spark, tmp_path):
    (tmp_path / "full.json").write_text(json.dumps({"complete_accessible_scan": True, "errors": [], "rasters": [{"sha256": "a"}, {"sha256": "b"}]}))
    (tmp_path / "list.json").write_text(json.dumps([{"sha256": "a"}]))
    assert [r.complete for r in files.read_registry(spark, str(tmp_path / "full.json")).collect()] == [True, True]
    assert [r.complete for r in files.read_registry(spark, str(tmp_path / "list.json")).collect()] == [False]


def test_pages(spark):
    html = '<title> A </title><h1 id="x">t</h1><a href="#x">1</a><a class="c" href="#y">2</a><table><tr><td>1<td><b>n</b> 0.5</tr></table>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in files.page_links(pages).orderBy("page_id").collect()] == [(1, 2, 1, "A"), (2, 0, 0, "")]
    assert [tuple(r) for r in files.broken_anchors(pages).collect()] == [(1, "y")]
    assert [r.cells for r in files.table_rows(pages).collect()] == [["1", "n 0.5"]]


def test_surface_sink_checks_first_and_never_overwrites(spark, tmp_path):
    good = spark.createDataFrame([(0, 0, 0.5), (300, 1, 1.0)], "row int, col int, value double")
    files.write_surface(good, str(tmp_path / "s"), GridSpec(400, 400))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_surface(good, str(tmp_path / "s"), GridSpec(400, 400))
    with pytest.raises(ValueError, match="inside_grid"):
        files.write_surface(good, str(tmp_path / "t"), GridSpec(10, 10))
    with pytest.raises(ValueError, match="NaN"):
        files.write_report(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "r"))


def test_stream_appends_finished_hours(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{h}:30:00", u, "click", v) for i, (h, u, v) in enumerate([(0, 1, 100.0), (0, 257, 250.0), (1, 2, 9000.0), (9, 3, 1.0)])]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    append_layer(cell_windows(read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("row").collect()
    assert [(r.col, r.value, r.n) for r in out] == [(1, 0.5, 2), (2, 1.0, 1)]  # the last hour is still open

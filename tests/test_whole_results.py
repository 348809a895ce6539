"""Small inputs that must not be lost, linked wrongly or averaged away."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvion.catalog import registry
from fluvion.operators import joins, masks, revisions, running, trend, zonal
from fluvion.plans import replay
from fluvion.session import shared_dir
from fluvion.sources import documents, forecasts, gauges, notices
from fluvion.streaming import ingest, windows


def test_revision_links_name_written_rows(spark):
    batch = spark.createDataFrame([("k", 1, 1, "A"), ("k", 2, 2, "A"), ("k", 3, 3, "B"), ("k", 4, 4, "B"), ("k", 5, 5, "A")], "k string, id long, at long, v string")
    none = batch.limit(0).select("k", "id", "v", F.lit(0).alias("revision_seq"))
    got = {r.id: (r.revision_seq, r.revises) for r in revisions.new_revisions(none, batch, ["k"], ["v"], "at").collect()}
    assert got == {1: (0, None), 3: (1, 1), 5: (2, 3)}
    stored = spark.createDataFrame([("k", 9, "A", 4)], "k string, id long, v string, revision_seq int")
    got = {r.id: (r.revision_seq, r.revises) for r in revisions.new_revisions(stored, batch, ["k"], ["v"], "at").collect()}
    assert got == {3: (5, 9), 5: (6, 3)}


def test_absent_cells_count_against_the_mask(spark):
    mask = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (0, 2, 1.0), (1, 0, 1.0)], "basin int, flat_index int, weight double")
    cells = spark.createDataFrame([(7, 0, 5.0)], "field int, flat_index int, value double")
    strict = {r.basin: (r.value, r.reason, r.missing_cells) for r in zonal.strict_mean(cells, mask, 3, F.lit(False)).collect()}
    assert strict == {0: (None, "missing_values", 2), 1: (5.0, "ok", 0)}
    for stats in (zonal.radar_stats, zonal.snow_stats, zonal.forecast_stats):
        got = {r.basin: (r.valid_fraction, r["mean"], r.cell_count) for r in stats(cells, mask).collect()}
        assert got == {0: (0.25, None, 3), 1: (1.0, 5.0, 1)}
    assert {r.reason for r in zonal.strict_mean(cells, mask, 2, F.lit(False)).collect()} == {"cell_out_of_range", "ok"}


def test_null_and_nan_cells_and_absent_basins_are_refusals(spark):
    nan = float("nan")
    mask = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 2, 1.0), (2, 0, 0.0)], "basin int, flat_index int, weight double")
    cells = spark.createDataFrame([(1, 0, 5.0), (1, 1, None), (2, 0, 5.0), (2, 1, nan), (3, 0, 5.0), (3, 1, 7.0), (3, 2, 1.0), (4, 0, 1.0), (4, 1, 1.0), (4, 2, 1.0), (4, 3, 1.0)], "field int, flat_index int, value double")
    fields = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "field int")
    got = {(r.field, r.basin): (r.value, r.reason, r.missing_cells) for r in zonal.strict_mean(cells, mask, 3, F.col("value") < 0, fields).collect()}
    assert got == {
        (1, 0): (None, "missing_values", 1), (1, 1): (None, "missing_values", 1), (2, 0): (None, "missing_values", 1), (2, 1): (None, "missing_values", 1),
        (3, 0): (6.0, "ok", 0), (3, 1): (1.0, "ok", 0), (4, 0): (None, "wrong_grid_size", 0), (4, 1): (None, "wrong_grid_size", 0),
        (9, 0): (None, "missing_values", 2), (9, 1): (None, "missing_values", 1), **{(f, 2): (None, "empty_weight" if f != 4 else "wrong_grid_size", 1 if f == 9 else 0) for f in (1, 2, 3, 4, 9)},
    }
    for stats, flag in ((zonal.radar_stats, "insufficient_radar_coverage"), (zonal.snow_stats, "insufficient_grid_coverage"), (zonal.forecast_stats, "insufficient_grid_coverage")):
        rows = {(r.field, r.basin): r for r in stats(cells, mask.filter("basin < 2"), fields).collect()}
        assert len(rows) == 10 and rows[3, 0]["mean"] == 6.0 and rows[3, 0].flags == []
        for k in ((1, 0), (2, 0), (1, 1), (9, 0), (9, 1)):
            assert rows[k]["mean"] is None and rows[k]["max"] is None and flag in rows[k].flags
        assert rows[2, 0].valid_fraction == 0.5 and rows[9, 1].valid_fraction == 0.0


def test_null_parts_of_a_key_are_equal(spark):
    """A feature without a window is met again: null equals null wherever stored rows are looked up."""
    stored = spark.createDataFrame([(None, "flow", 7, 5, 0)], "win string, feature string, id long, state int, revision_seq int")
    batch = spark.createDataFrame([(None, "flow", 8, 8, 5), (None, "flow", 9, 9, 6), ("24h", "flow", 10, 10, 6)], "win string, feature string, id long, at long, state int")
    got = {r.id: (r.revision_seq, r.revises) for r in revisions.new_revisions(stored, batch, ["win", "feature"], ["state"], "at").collect()}
    assert got == {9: (1, 7), 10: (0, None)}
    marks = revisions.above_high_water(batch, stored.withColumn("at", F.lit(8)), ["win", "feature"], "at")
    assert {r.id for r in marks.collect()} == {9, 10}
    dated = stored.withColumn("effective_from", F.lit(datetime(2024, 1, 1)))
    got = {r.id: r.change for r in revisions.changed_dimension_rows(dated, batch, ["win", "feature"], ["state"]).collect()}
    assert got == {9: "changed", 10: "new"}


def test_unreadable_documents_are_refused(spark):
    docs = spark.createDataFrame([("a", "{not json"), ("b", "[]"), ("c", "[[]]")], "path string, content string")
    got = {(r.path, r.group_no): r.refusal for r in forecasts.ensembles(docs).collect()}
    assert got == {("a", None): "malformed"}
    one = '{"reach": "r", "mediumRange": {"member1": {"referenceTime": "2024-01-01T00:00:00Z", "units": %s, "data": [{"validTime": "2024-01-01T06:00:00Z", "flow": 3}]}}}'
    docs = spark.createDataFrame([("a", one % "null"), ("b", one % '"ft³/s"')], "path string, content string")
    assert {r.path for r in forecasts.medium_range(docs).collect()} <= {"b"}


@pytest.mark.parametrize("at,vertex", [((0.0, 80.0), (0.18, 80.0)), ((179.99, 10.0), (-179.99, 10.0)), ((0.0, -89.99), (179.0, -89.99)), ((-0.001, 0.0), (0.03, 0.03))])
def test_nearest_vertex_anywhere(spark, at, vertex):
    p = spark.createDataFrame([(1, *at), (2, at[0], 45.0)], "pid int, lon double, lat double")
    v = spark.createDataFrame([vertex], "lon double, lat double")
    got = {r.pid: r.d_m for r in joins.nearest_within(p, v, "pid", 5000.0).collect()}
    near = got[1] is not None
    # at the pole the flat distance of half a turn is still short enough
    assert near and got[1] < 5000 and got[2] is None


def test_store_errors_are_not_an_empty_store(spark):
    like = spark.range(0).withColumn("batch", F.lit(0))
    base = shared_dir(spark)
    assert ingest.earlier_batches(spark, f"{base}/nothing-here", 1, like).count() == 0
    clash = f"{base}/clash"
    spark.range(3).write.parquet(f"{clash}/part=1")
    with pytest.raises(Exception):
        ingest.earlier_batches(spark, clash, 1, like).count()


def test_tie_term_only_in_rounding():
    assert registry.with_ties("round(a, 6)") == "round(a + 1e-09, 6)"
    assert registry.with_ties("round(sum(greatest(x, 6)), 6), pmod(x, 6)") == "round(sum(greatest(x, 6)) + 1e-09, 6), pmod(x, 6)"


def test_latest_daily_reads_only_mean_discharge(spark):
    f = lambda code, stat, v: {"properties": {"monitoring_location_id": "USGS-1", "parameter_code": code, "statistic_id": stat, "time": "2024-01-01", "value": v}}
    page = {"features": [f("00060", "00003", "5"), f("00060", None, "6"), f("00060", "00001", "7"), f("00065", "00003", "8")]}
    docs = spark.createDataFrame([("p", json.dumps(page))], "path string, content string")
    assert sorted(r.value for r in gauges.latest_daily(docs).collect()) == [5.0, 6.0]


def test_bulletins_are_refused_not_guessed(spark):
    event = "/ABCW1.2.ER.251209T1701Z.251210T1200Z.251211T0000Z.NO/\n"
    head, zone = "WGUS46 KSEW 091701\n", "WAC033-\n"
    texts = {
        "good": head + "FLWSEW\n\n" + zone + "/O.CAN.KSEW.FL.W.0041.251209T1701Z-000000T0000Z/\n/O.NEW.KSEW.FL.W.0042.251209T1701Z-000000T0000Z/\n" + event + "* At noon the stage was 9.5 feet.\n* Flood stage is 10.0 feet.\n$$\n",
        "no_product_line": head + "\nnot a name\n" + zone + event + "$$\n",
        "several_event_lines": head + "FLWSEW\n" + zone + event + event + "$$\n",
        "two_segments": head + "FLWSEW\n" + event + zone + event + "$$\n" + zone + event + "$$\n",
        "no_heading": "FLWSEW\n",
    }
    products = notices.bulletins(spark.createDataFrame(list(texts.items()), "path string, content string"))
    assert {r.path: r.refusal for r in products.collect()} == {k: None if k in ("good", "two_segments") else k for k in texts}
    s = notices.segments(products).filter("path = 'good'").first()
    assert (s.pil, s.actions, s.observed, s.flood_stage, s.lid) == ("FLWSEW", ["CAN", "NEW"], 9.5, 10.0, "ABCW1")


def test_broken_listing_is_refused(spark):
    whole = "<ListBucketResult><Contents><Key>a/20240101-000000.grib2</Key><LastModified>2024-01-01T00:00:00Z</LastModified><Size>3</Size></Contents></ListBucketResult>"
    rows = [("whole", whole), ("cut", whole[:-30]), ("other", "<Error/>"), ("text", "no"), ("null", None), ("empty", "<ListBucketResult></ListBucketResult>"), ("keyless", whole.replace("<Key>a/20240101-000000.grib2</Key>", ""))]
    pages = spark.createDataFrame(rows, "path string, content string")
    refused = {r.path: r.refusal for r in documents.refusals(notices.listing_pages(pages)).collect()}
    assert refused == {"cut": "malformed", "other": "malformed", "text": "malformed", "null": "malformed", "keyless": "missing_key"}
    assert [r.size_bytes for r in notices.listing(pages).collect()] == [3]


def test_grid_trend_sees_its_closed_window_only(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(minutes=15 * i), float(i) * 100) for i in range(24 * 4 + 1)]
    rows += [(2, t0 + timedelta(hours=h), 1.0) for h in (0, 5, 6)]
    series = spark.createDataFrame(rows, "site long, t timestamp, v double")
    got = {(r.site, r.as_of): (r.trend_direction, r.trend_refusal) for r in replay.grid_trends(series, ("2024-01-01 00:00:00", "2024-01-02 12:00:00", 12)).collect()}
    assert got[1, t0] == ("unknown", "INSUFFICIENT_OBSERVATIONS") and got[1, t0 + timedelta(hours=12)] == ("rising", "ok")
    assert got[1, t0 + timedelta(hours=24)] == ("rising", "ok") and (1, t0 + timedelta(hours=36)) not in got
    assert (2, t0 + timedelta(hours=12)) in got and got[2, t0 + timedelta(hours=12)][0] == "unknown"


def test_streamed_rates_are_the_batch_rates(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i % 2, t0 + timedelta(minutes=15 * (i // 2)), float(i * i % 91)) for i in range(160)], "station long, t timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ingest.open_stream(spark, str(tmp_path / "in"), df.schema)
    ingest.run_to_table(windows.rates(s, "station", "t", "v", "1 hour", F.lit("flow")), str(tmp_path / "cp"), str(tmp_path / "out"))
    batch = {(r.station, r.t): r.repeated_median_slope for r in trend.slopes(trend.trailing_windows(df), ("repeated_median",)).collect()}
    seen = {(r.station, r.window_end): r.slope for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    shared = seen.keys() & batch.keys()
    assert len(shared) > 80 and all(seen[k] == pytest.approx(batch[k]) for k in shared)


def test_ring_with_a_hole_and_many_edges(spark):
    import math

    circle = lambda r, n: [(r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    rings = spark.createDataFrame([("a", circle(10, 300)), ("a", circle(4, 60)), ("b", [(20.0, 0.0), (22.0, 0.0), (22.0, 2.0), (20.0, 2.0)])], "ring_id string, ring array<struct<x: double, y: double>>")
    pts = [(i, 0.37 * (i % 80) - 12.0, 0.41 * (i // 80) - 11.0) for i in range(80 * 54)] + [(10_000, 21.0, 1.0), (10_001, None, 1.0)]
    got = {(r.pid, r.ring_id) for r in joins.points_in_rings(spark.createDataFrame(pts, "pid long, x double, y double"), rings, "pid", "ring_id", cell=3.0).collect()}
    inner, outer = math.cos(math.pi / 60), math.cos(math.pi / 300)
    for i, x, y in pts[:-2]:
        r = math.hypot(x, y)
        if r < 10 * outer and (r > 4 or r < 4 * inner):  # not between a chord and its arc
            assert ((i, "a") in got) == (r > 4)
        elif r > 10:
            assert (i, "a") not in got
    assert (10_000, "b") in got and not any(p == 10_001 for p, _ in got)


def test_sentence_names_its_denominator(spark):
    from fluvion.functions import labels

    row = spark.range(1).select(
        labels.magnitude_phrase(F.lit(0.014), F.lit(84.6), F.lit(6000.0)).alias("flow"), labels.basis_phrase(F.lit(0.014), F.lit(6000.0)).alias("share"),
        labels.magnitude_phrase(F.lit(-0.287), F.lit(-84.6), F.lit(None).cast("double")).alias("relative"), labels.basis_phrase(F.lit(-0.287), F.lit(None).cast("double")).alias("none"),
    ).first()
    assert tuple(row) == ("85 cfs above", " (1% of the action flow of 6,000 cfs)", "29% below", "")


def _inside(rings, px, py):
    """Even-odd test of many points against the rings of one polygon."""
    held = np.zeros(px.shape, bool)
    for pts in rings:
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            if y1 != y2:
                held ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return held


def test_polygon_overlap_is_exact(spark):
    """Concave rings, holes, several rows of tiles, negative places, and neighbours that do not meet."""
    left = {1: [[(0.3, 0.2), (9.1, 1.0), (6.0, 4.0), (9.5, 8.2), (1.0, 7.7), (3.0, 4.1)], [(4.0, 3.0), (4.2, 5.5), (5.1, 3.3)]], 2: [[(20, 20), (30, 21), (25, 30)]], 4: [[(-5.2, -5.1), (-1.0, -4.4), (-2.2, 0.7)]]}
    right = {7: [[(2.0, -1.0), (8.0, 3.0), (4.5, 9.3), (-1.0, 5.0)]], 8: [[(100, 100), (101, 100), (100, 101)]], 9: [[(-4, -6), (-4, -3), (40, -3), (40, -6)]], 10: [[(26, 22), (28, 29), (22, 25)]], 11: [[(0, 10), (9, 10), (9, 12), (0, 12)]]}

    def table(polygons):
        rows = [(k, 0, i, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, rings in polygons.items() for i, ring in enumerate(rings)]
        return spark.createDataFrame(rows, "basin int, part int, ring int, pts array<struct<x double, y double>>")

    got = {(r.left, r.right): (r.overlap_km2, r.of_left, r.of_right) for r in masks.polygon_overlaps(table(left), table(right), 8.0, 1.0, 0.01).collect()}
    px, py = np.meshgrid(np.arange(-7, 41, 0.02) + 0.01, np.arange(-7, 41, 0.02) + 0.01)
    held = {k: _inside(v, px, py) for k, v in (left | right).items()}
    expected = {}
    for a in left:
        for b in right:
            shared = (held[a] & held[b]).sum() * 4e-4
            if shared > 0.01:
                expected[a, b] = (shared, (held[a] & held[b]).sum() / held[a].sum(), (held[a] & held[b]).sum() / held[b].sum())
    assert got.keys() == expected.keys() == {(1, 7), (2, 10), (4, 9)}
    for k, values in expected.items():
        assert got[k] == pytest.approx(values, rel=2e-3)
    # two halves of one cell do not overlap
    half = lambda x0, x1: {0: [[(x0, 0.0), (x1, 0.0), (x1, 1.0), (x0, 1.0)]]}
    assert masks.polygon_overlaps(table(half(0.0, 0.5)), table(half(0.5, 1.0)), 8.0, 1.0, 0.01).count() == 0


def test_numbers_run_across_blocks(spark):
    rows = [("a", 1, 5), ("a", 1, 2), ("a", None, 9), ("a", 3, 1), (None, 2, 4), (None, 1, 4), ("b", 7, 7)]
    df = spark.createDataFrame(rows, "k string, block int, x int")
    got = {(r.k, r.block, r.x): r.n for r in running.numbered(df, ["k"], ["block"], ["x"], "n").collect()}
    assert got == {("a", None, 9): 1, ("a", 1, 2): 2, ("a", 1, 5): 3, ("a", 3, 1): 4, (None, 1, 4): 1, (None, 2, 4): 2, ("b", 7, 7): 1}
    assert running.numbered(df.limit(0), ["k"], ["block"], ["x"], "n").collect() == []


def test_supersession_keeps_runs_without_a_key_or_a_time(spark):
    runs = spark.createDataFrame([(1, None, datetime(2024, 1, 1)), (2, None, datetime(2024, 3, 1)), (3, "p", None), (4, "p", datetime(2024, 1, 5))], "run_id int, fp string, issued_at timestamp")
    got = {r.run_id: r.supersedes for r in revisions.link_supersession(runs, ["fp"]).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 3}


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    at = datetime(2024, 1, 1)
    # rows are held late against the watermark of the batch before theirs
    for k, hours in (("a", 0), ("a", 30), ("b", 31), ("a", 2)):
        one = spark.createDataFrame([(k, at + timedelta(hours=hours), 1.0)], "k string, t timestamp, v double")
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
    s = ingest.open_stream(spark, str(tmp_path / "land"), "k string, t timestamp, v double", 1)
    q = ingest.run_to_table(windows.hourly(s, "k", "t", "v", "1 hour"), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert ingest.late_rows(q) == 1
    assert [r.n_dropped for r in spark.read.parquet(str(tmp_path / "out_late")).collect()] == [1]

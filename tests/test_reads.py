"""Provenance, dated levels, drivers, run documents and distances to paths, against plain versions."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fluvion.operators import joins
from fluvion.plans import basin, replay, river

T = datetime(2024, 1, 10)


def distance(p, s):
    """From the point to the segment, in a plane around the point."""
    lon, lat = p
    side = 360.0 * round((lon - s[0]) / 360.0)
    m = 111320.0 * math.cos(math.radians(lat))
    x1, y1, x2, y2 = (s[0] + side - lon) * m, (s[1] - lat) * 111320.0, (s[2] + side - lon) * m, (s[3] - lat) * 111320.0
    dx, dy = x2 - x1, y2 - y1
    t = 0.0 if dx == dy == 0 else min(1.0, max(0.0, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy)))
    return math.hypot(x1 + t * dx, y1 + t * dy)


@pytest.mark.parametrize("limit", [400.0, 5000.0])
def test_distance_to_paths_is_that_of_every_segment(spark, limit):
    """Long, slanted, vertical and empty segments, at several latitudes and over the date line; far from any vertex."""
    r = random.Random(3)
    segments = [(-122 + r.random(), 47 + r.random(), -122 + r.random(), 47 + r.random()) for _ in range(12)]
    segments += [(10.0, 0.0, 10.0, 2.0), (5.0, 5.0, 5.0, 5.0), (179.9, -10.0, 180.2, -10.1), (20.0, 79.0, 24.0, 79.5), segments[0]]
    points = []
    for a, b, c, d in segments:
        for _ in range(25):
            t = r.random()
            off = limit / 111320.0 * r.choice([0.2, 0.9, 1.5])
            lon, lat = a + (c - a) * t + r.uniform(-off, off), b + (d - b) * t + r.uniform(-off, off)
            points.append((len(points), lon - 360 if lon > 180 else lon, lat))
    df = spark.createDataFrame([*points, (9999, 0.0, -60.0)], "pid int, lon double, lat double")
    got = {x.pid: x.d_m for x in joins.nearest_segment(df, spark.createDataFrame(segments, "lon1 double, lat1 double, lon2 double, lat2 double"), "pid", limit).collect()}
    near = 0
    for pid, lon, lat in points:
        want = min(distance((lon, lat), s) for s in segments)
        if want < limit - 1e-6:
            near += 1
            assert got[pid] == pytest.approx(want, abs=1e-6)
        elif want > limit:
            assert got[pid] is None
    assert near > 150 and got[9999] is None


def test_paths_meet_points_of_their_own_group_only(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 0.0, 0.0, "b"), (3, 0.0, 0.0, None)], "pid int, lon double, lat double, basin string")
    s = spark.createDataFrame([(-1.0, 0.001, 1.0, 0.001, "a")], "lon1 double, lat1 double, lon2 double, lat2 double, basin string")
    got = {x.pid: x.d_m for x in joins.nearest_segment(p, s, "pid", 1000.0, "basin").collect()}
    assert got[1] == pytest.approx(111.32) and got[2] is None and got[3] is None


def at(h):
    return T + timedelta(hours=h)


def test_published_numbers_name_their_rows(spark):
    obs = [
        (1, "stage", 5.0, 10, at(-3), at(-3)), (1, "stage", 6.0, 11, at(-2), at(-1)), (1, "stage", 6.5, 12, at(-2), at(-1)),
        (1, "stage", 9.0, 13, at(-1), at(2)),  # not known yet
        (1, "flow", 70.0, 14, at(-2), at(0)), (2, "stage", 1.0, 20, at(-30), at(-29)),
    ]
    table = spark.createDataFrame([(*x, x[5]) for x in obs], "point long, variable string, value double, id long, valid_time timestamp, available_at timestamp, retrieved_at timestamp")
    runs = spark.createDataFrame([(1, 100, at(-20), at(-19)), (1, 101, at(-10), at(3))], "point long, run_id long, issued_at timestamp, available_at timestamp")
    values = spark.createDataFrame([(100, 24, 8.0), (101, 12, 99.0)], "run_id long, after_h int, stage double")
    levels = [(1, "minor", 6.0, at(-100), at(-90), 1), (1, "minor", 6.4, at(-50), at(-40), 2), (1, "minor", 1.0, at(-10), at(5), 3), (1, "major", 20.0, at(1), at(-5), 4)]
    dated = river.dated_levels(spark.createDataFrame(levels, "point long, category string, level double, effective_from timestamp, known_at timestamp, id long"), F.lit(T))
    state = river.evidence(table, F.lit(T), runs, values, F.lit("FLUVIAL"))
    got = {(x.point, x.part): (x.n, x.first_id, x.last_id, x.valid_time, x.known_at) for x in river.provenance(state, dated).collect()}
    assert got == {
        (1, "value"): (1, 12, 12, at(-2), at(-1)), (1, "companion"): (1, 14, 14, at(-2), at(0)), (1, "trend"): (2, 10, 12, at(-2), at(-1)),
        (1, "hazard"): (1, 100, 100, at(4), at(-19)), (1, "level:minor"): (1, 2, 2, at(-50), at(-40)), (2, "value"): (1, 20, 20, at(-30), at(-29)),
    }
    row = river.published(state.join(dated, "point", "left"), {c: F.col(c) for c in ("action", "minor", "moderate", "major")}, F.lit(T), F.lit(3600), F.lit(600))
    told = {x.point: (x.value, x.category, x.hazard) for x in row.collect()}
    assert told == {1: (6.5, "minor", "minor"), 2: (1.0, "unknown", "unknown")}


def test_drivers_are_renumbered_over_surfaces(spark):
    schema = "basin long, rank int, feature string, value double, clock timestamp"
    a = spark.createDataFrame([(1, 1, "p", 3.0, T), (1, 2, "q", 4.0, T)], schema)
    b = spark.createDataFrame([(1, 2, "y", 2.0, None), (1, 1, "x", 1.0, None), (2, 1, "x", 9.0, T)], schema)
    got = sorted((x.basin, x.rank, x.surface, x.feature) for x in basin.headline_drivers([("s", a), ("f", b)]).collect())
    assert got == [(1, 1, "s", "p"), (1, 2, "s", "q"), (1, 3, "f", "x"), (1, 4, "f", "y"), (2, 1, "f", "x")]


def test_run_document_changes_with_what_was_read(spark):
    schema = "as_of timestamp, site long, arm string, role string, p double"
    rows = [(at(i), i % 3, "old" if i % 2 else "new", "event" if i < 4 else "control", None if i == 2 else i / 10) for i in range(9)]
    grid, event = ("a", "b", 12), ("c", "d")

    def document(rows, read, mode=replay.RETROSPECTIVE):
        evals = spark.createDataFrame(rows, schema).repartition(3)
        daily = spark.createDataFrame([(x,) for x in read], "v long")
        return replay.run_document(evals, [F.col(c) for c in ("as_of", "site", "arm", "role", "p")], mode, grid, event, {"daily": (daily, [F.col("v")])}).first()

    one = document(rows, [1, 2, 3])
    assert (one.n_evaluations, one.n_event, one.n_control, one.n_sites, one.first_as_of, one.last_as_of) == (9, 4, 5, 3, at(0), at(8))
    assert document(rows[::-1], [3, 2, 1]).run_id == one.run_id
    others = [document(rows[:-1], [1, 2, 3]), document([*rows[:-1], (*rows[-1][:4], 0.5)], [1, 2, 3]), document(rows, [1, 2, 4]), document(rows, [1, 2, 3], replay.KNOWLEDGE_TIME)]
    assert len({x.run_id for x in [one, *others]}) == 5
    assert document([], []).n_evaluations == 0

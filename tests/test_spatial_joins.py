"""Points in rings and nearest segments against plain loops, on rows that repeat and shapes of many edges."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fluvion.operators import joins

RING = "ring_id long, ring array<struct<x: double, y: double>>"


def star(r, x, y, n):
    return [(x + math.cos(2 * math.pi * i / n) * (k := r.uniform(2, 9)), y + math.sin(2 * math.pi * i / n) * k) for i in range(n)]


def crossings(x, y, ring):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1]))


@pytest.mark.parametrize("cell", [0.7, 8.0])
def test_points_in_rings_of_any_number_of_edges(spark, cell):
    r = random.Random(3)
    rings = [(i, star(r, r.uniform(0, 60), r.uniform(0, 20), n)) for i, n in enumerate((3, 4, 4, 5, 9, 40, 200))]
    rings += [(4, star(r, 30, 10, 6)), (None, star(r, 30, 10, 6))]
    points = [(i, r.uniform(-5, 65), r.uniform(-5, 25)) for i in range(400)] + [(3, 30.0, 10.0), (7, 30.5, 9.0), (None, 30.0, 10.0), (500, None, 1.0)]
    points += points[:5]
    p = spark.createDataFrame([(*x, f"t{i}") for i, x in enumerate(points)], "pid long, x double, y double, note string")
    found = joins.points_in_rings(p, spark.createDataFrame(rings, RING), "pid", "ring_id", cell).collect()
    n = {}
    for i, x, y in points:
        for k, ring in rings:
            if x is not None and k is not None:
                n[i, k] = n.get((i, k), 0) + crossings(x, y, ring)
    want = sorted((i is None, i or 0, k) for (i, k), c in n.items() if c % 2)
    assert len(want) > 50 and sorted((x.pid is None, x.pid or 0, x.ring_id) for x in found) == want
    carried = joins.points_in_rings(p, spark.createDataFrame(rings, RING), "pid", "ring_id", cell, carry=("note",)).collect()
    assert sorted((x.ring_id, x.note) for x in carried) == sorted((k, f"t{j}") for j, (i, *_) in enumerate(points) for (q, k), c in n.items() if q == i and c % 2)


def away(lon, lat, s):
    side, wide = 360 * round((lon - s[0]) / 360), 111_320 * math.cos(math.radians(lat))
    x1, y1, x2, y2 = (s[0] + side - lon) * wide, (s[1] - lat) * 111_320, (s[2] + side - lon) * wide, (s[3] - lat) * 111_320
    dx, dy = x2 - x1, y2 - y1
    t = min(max(-(x1 * dx + y1 * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
    return math.hypot(x1 + t * dx, y1 + t * dy)


def places(r, lon, lat, n=150):
    segments = [(a := lon + r.uniform(-0.3, 0.3), b := lat + r.uniform(-0.3, 0.3), a + r.uniform(-0.5, 0.5), b + r.uniform(-0.2, 0.2)) for _ in range(60)]
    turned = lambda x: (x + 180) % 360 - 180
    return [(turned(lon + r.uniform(-0.5, 0.5)), lat + r.uniform(-0.5, 0.5)) for _ in range(n)] + [(turned(segments[0][0]), segments[0][1])], segments


@pytest.mark.parametrize("lon,lat", [(-122, 46), (179.9, -40), (0, 0), (10, 88.5)])
def test_nearest_segment_leaves_out_no_nearest_one(spark, lon, lat):
    points, segments = places(random.Random(5), lon, lat)
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "pid long, lon double, lat double")
    s = spark.createDataFrame([*segments, segments[0]], "lon1 double, lat1 double, lon2 double, lat2 double")
    found = {x.pid: x.d_m for x in joins.nearest_segment(p, s, "pid", 5000.0).collect()}
    assert len(found) == len(points) and any(x is not None for x in found.values())
    for i, x in enumerate(points):
        least = min(away(*x, k) for k in segments)
        assert found[i] == (pytest.approx(least, abs=1e-5) if least < 5000 else None)


def test_no_distance_is_part_of_a_join_condition(spark):
    """A filter pushed into the join spells the formula out many times, in code that is never compiled."""
    points, segments = places(random.Random(5), -122, 46)
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "pid long, lon double, lat double")
    s = spark.createDataFrame(segments, "lon1 double, lat1 double, lon2 double, lat2 double")
    plan = joins.nearest_segment(p, s, "pid", 5000.0)._jdf.queryExecution().optimizedPlan().toString()
    conditions = re.findall(r"^[ :+-]*Join .*$", plan, re.M)
    assert conditions and not any(re.search(r"HYPOT|SQRT|COS\(", c, re.I) for c in conditions)


def test_pairs_that_are_decided_where_they_meet_are_not_counted_again(spark):
    """Of rings of four edges and points of one row no pair goes through the count by (point, ring)."""
    r = random.Random(4)
    rings = spark.createDataFrame([(i, star(r, r.uniform(0, 60), r.uniform(0, 20), 4)) for i in range(20)], RING)
    p = spark.createDataFrame([(i, r.uniform(0, 60), r.uniform(0, 20)) for i in range(200)], "pid long, x double, y double")
    found = joins.points_in_rings(p, rings, "pid", "ring_id", 4.0)
    direct = found._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert found.count() > 0 and not re.search(r"Aggregate \[pid#\d+L?, ring_id#", direct)


@pytest.mark.parametrize("cell", [0.7, 8.0])
def test_merged_points_add_up_to_the_pairs(spark, monkeypatch, cell):
    """Blocks wholly inside or outside, blocks an edge divides, crowded places, ids that repeat or are null."""
    monkeypatch.setattr(joins, "BLOCK", 64)
    r = random.Random(6)
    rings = [(i, star(r, r.uniform(0, 60), r.uniform(0, 20), n)) for i, n in enumerate((3, 4, 4, 5, 9, 40))] + [(None, star(r, 30, 10, 6)), (9, [(20.0, 3.0), (40.0, 3.5), (41.0, 18.0), (19.0, 17.0)])]
    places = [(r.uniform(-5, 65), r.uniform(-5, 25)) for _ in range(500)] + [(30.0, 10.0)] * 300 + [(30.0 + i / 1e4, 11.0) for i in range(300)] + [(20.0, 3.0), (41.0, 18.0), (None, 1.0), (2.0, None)]
    points = [(i, x, y, i % 3 if i % 7 else None, float(i % 5)) for i, (x, y) in enumerate(places)]
    points += points[:7] + [(None, 30.0, 10.0, 1, 2.0)] + [(8, 30.0, 10.0, 2, 77.0)]
    p = spark.createDataFrame([(*x, x[4], x[4], 1) for x in points], "pid long, x double, y double, kind int, area double, lo double, hi double, n long")
    rows = spark.createDataFrame(rings, RING)
    merged = {"area": F.sum, "lo": F.min, "hi": F.max, "n": F.sum}
    found = joins.points_in_rings(p, rows, "pid", "ring_id", cell, carry=("kind", *merged), merged=merged)
    pairs = joins.points_in_rings(p, rows, "pid", "ring_id", cell, carry=("kind", *merged)).groupBy("ring_id", "kind").agg(*[f(c).alias(c) for c, f in merged.items()])
    got, want = ({(x.ring_id, x.kind): (x.area, x.lo, x.hi, x.n) for x in df.collect()} for df in (found, pairs))
    inside = {}
    for i, x, y, kind, area in points:
        if x is None or y is None:
            continue
        for k, ring in rings:
            same = sum(crossings(*q[1:3], ring) for q in points if q[0] == i and q[1] is not None and q[2] is not None)
            if k is not None and same % 2:
                inside.setdefault((k, kind), []).append(area)
    assert got == want == {k: (sum(v), min(v), max(v), len(v)) for k, v in inside.items()} and len(got) > 15


def test_unpacked_points_are_never_broadcast(spark, tmp_path):
    """Files of packed cells look far smaller than the points in them; a join planned by their size holds all points in the driver."""
    spark.range(3).selectExpr("id", "transform(sequence(0, 63), i -> double(i)) as cells").write.parquet(f"{tmp_path}/packed")
    p = spark.read.parquet(f"{tmp_path}/packed").select("id", F.posexplode("cells").alias("k", "x")).selectExpr("concat_ws(':', id, k) as pid", "x", "id + 0.5D as y", "x as area")
    rings = spark.createDataFrame([(1, [(0.5, 0.0), (9.5, 0.0), (9.5, 2.0), (0.5, 2.0)])], RING)
    for merged in (None, {"area": F.sum}):
        df = joins.points_in_rings(p, rings, "pid", "ring_id", 2.0, carry=("area",), merged=merged)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.agg(F.sum("area")).first()[0] == 90.0


def rows_given_out(df):
    """By generators and joins of the plan that ran."""

    def nodes(plan):
        yield plan
        kids, name = plan.children(), plan.nodeName()
        more = [kids.apply(i) for i in range(kids.size())]
        more += [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else []
        for x in more:
            yield from nodes(x)

    df.collect()
    of = ("Generate", "SortMergeJoin", "BroadcastHashJoin")
    return [x.metrics().apply("numOutputRows").value() for x in nodes(df._jdf.queryExecution().executedPlan()) if x.nodeName() in of and x.metrics().contains("numOutputRows")]


def test_points_meet_rings_as_blocks(spark):
    """Pairs of a crowded place and a ring around it are not made one by one."""
    p = spark.range(2000).selectExpr("id as pid", "5 + id % 10 / 1000D as x", "5D as y", "1L as n")
    rings = spark.createDataFrame([(i, [(0.5, 0.5), (9.5, 0.5), (9.5, 9.5 + i), (0.5, 9.5)]) for i in range(8)], RING)
    df = joins.points_in_rings(p, rings, "pid", "ring_id", 2.0, carry=("n",), merged={"n": F.sum})
    assert {x.ring_id: x.n for x in df.collect()} == {i: 2000 for i in range(8)}
    assert max(rows_given_out(df)) <= 2000


def test_hypsometry_of_parcels_is_that_of_their_pixels(spark):
    from fluvion.operators import rasters

    r = random.Random(8)
    pixels = spark.createDataFrame([(i % 4, r.uniform(-60, 400), r.randrange(1, 9) / 4) for i in range(600)] + [(9, 300.0, 1.0), (9, 0.0, 1.0)], "basin long, elevation double, area double")
    parcels = rasters.binned(pixels, 0.0, 300.0)
    once = parcels.groupBy("basin", "slot").agg(*[f(c).alias(c) for c, f in rasters.PARCEL.items()])
    want = sorted(map(tuple, rasters.hypsometry(pixels, 0.0, 300.0).collect()))
    assert len(want) == 5 and want[4][1:4] == ([1.0] + [0.0] * 14, 0.0, 1.0) and want[4][4:8] == (2.0, 0.0, 300.0, 2)
    for rows in (parcels, once):
        assert sorted(map(tuple, rasters.hypsometry(rows, 0.0, 300.0).collect())) == want


@pytest.mark.parametrize("cell", [0.7, 8.0])
def test_flags_are_those_of_the_pairs(spark, cell):
    """Blocks whole in a ring that has the flag, whole in one that has not, divided, and ids that repeat or are null."""
    r = random.Random(9)
    rings = [(i, star(r, r.uniform(0, 60), r.uniform(0, 20), n)) for i, n in enumerate((3, 4, 4, 5, 9, 40))] + [(None, star(r, 30, 10, 6)), (10, [(20.0, 3.0), (40.0, 3.5), (41.0, 18.0), (19.0, 17.0)]), (11, [(30.0, 3.0), (60.0, 3.5), (61.0, 18.0), (29.0, 17.0)])]
    places = [(r.uniform(-5, 65), r.uniform(-5, 25)) for _ in range(600)] + [(30.0, 10.0)] * 50 + [(20.0, 3.0), (41.0, 18.0), (None, 1.0), (2.0, None)]
    points = [(i, x, y) for i, (x, y) in enumerate(places)]
    points += points[:7] + [(None, 30.0, 10.0), (8, 30.0, 10.0)]
    p, rows = spark.createDataFrame(points, "pid long, x double, y double"), spark.createDataFrame(rings, RING)
    found = joins.points_in_rings(p, rows, "pid", "ring_id", cell, flag=F.col("ring_id") % 5 == 0).collect()
    want = joins.points_in_rings(p, rows, "pid", "ring_id", cell).groupBy("pid").agg(F.bool_or(F.col("ring_id") % 5 == 0).alias("flag")).collect()
    assert len(found) == len({x.pid for x in found}) and {x.pid: x.flag for x in found} == {x.pid: x.flag for x in want}
    assert {x.flag for x in found} == {True, False} and len(found) > 100


def test_points_of_covered_blocks_meet_no_more_rings(spark):
    """Where a flagged ring covers a block, its points are not paired with the rings around."""
    p = spark.range(2000).selectExpr("id as pid", "5 + id % 10 / 1000D as x", "5D as y")
    rings = spark.createDataFrame([(i, [(0.5, 0.5), (9.5, 0.5), (9.5, 9.5 + i), (0.5, 9.5)]) for i in range(8)], RING)
    df = joins.points_in_rings(p, rings, "pid", "ring_id", 2.0, flag=F.col("ring_id") % 5 == 0)
    assert [x.flag for x in df.collect()] == [True] * 2000
    assert max(rows_given_out(df)) <= 2000

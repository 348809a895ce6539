"""Bitemporal reads: ties, both clocks, lookback, null identities, supersession."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from fluvion.operators import joins, revisions, selection
from fluvion.plans import river

T = "2024-01-10 12:00:00"
H = lambda h, d=10: dt(2024, 1, d, h)


def obs(spark, rows):
    return spark.createDataFrame(rows, "station string, valid_time timestamp, available_at timestamp, revision_seq int, id long, value double")


def newest(df):
    return selection.newest(df, ["station"], [F.desc("valid_time"), F.desc("revision_seq"), F.desc("id")])


def test_ties_fall_to_revision_then_id(spark):
    df = obs(spark, [("a", H(9), H(9), 0, 7, 1.0), ("a", H(9), H(9), 1, 3, 2.0), ("a", H(9), H(9), 1, 5, 3.0)])
    assert [r.value for r in newest(df).collect()] == [3.0]


def test_a_late_known_row_does_not_hide_an_earlier_one(spark):
    df = obs(spark, [("a", H(11), H(13), 0, 2, 9.0), ("a", H(8), H(8), 0, 1, 4.0)])
    known = selection.as_known_at(df, T)
    assert [r.value for r in newest(known).collect()] == [4.0]


def test_lookback_is_inclusive(spark):
    df = spark.createDataFrame([("p", "stage", 1.0, 1, dt(2023, 12, 27, 12), dt(2023, 12, 27, 12), dt(2023, 12, 27, 12)), ("q", "stage", 1.0, 2, dt(2023, 12, 27, 11), dt(2023, 12, 27, 12), dt(2023, 12, 27, 12))],
                               "point string, variable string, value double, id long, valid_time timestamp, available_at timestamp, retrieved_at timestamp")
    assert {r.point for r in river.admissible(df, F.lit(T).cast("timestamp")).collect()} == {"p"}


def brute_latest(rows, t, lookback_h):
    ok = [r for r in rows if r[2] <= t and r[1] <= t and (t - r[1]).total_seconds() <= lookback_h * 3600]
    return max(ok, key=lambda r: (r[1], r[4]))[5] if ok else None


def test_grid_equals_one_read_per_instant(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(300):
        v = dt(2024, 1, 1 + rng.randrange(8), rng.randrange(24))
        a = v.replace(day=min(28, v.day + rng.randrange(2)), hour=v.hour)
        rows.append((rng.choice("ab"), v, max(v, a), 0, i, float(i)))
    out = joins.latest_at_grid(obs(spark, rows), ["station"], ["valid_time", "id"], ["value"], "2024-01-02 00:00:00", "2024-01-12 00:00:00", 6, 24)
    got = {(r.station, r.as_of): r.value for r in out.collect()}
    from datetime import timedelta

    for s in "ab":
        mine = [r for r in rows if r[0] == s]
        for k in range(41):
            t = dt(2024, 1, 2) + timedelta(hours=6 * k)
            assert got.get((s, t)) == brute_latest(mine, t, 24), (s, t)


def test_superseder_outlives_its_row(spark):
    cols = "alert_id string, available_at timestamp, ends timestamp, expires timestamp, sent timestamp, status string, message_type string, references array<string>"
    rows = [
        ("a", H(1), H(23, 20), None, H(1), "Actual", "Alert", []),
        ("cancel", H(2), H(3), None, H(2), "Actual", "Cancel", ["a"]),  # already ended, still cancels
        ("b", H(1), None, None, dt(2024, 1, 8, 11), "Actual", "Alert", []),  # endless and too old
        ("c", H(1), None, None, dt(2024, 1, 8, 13), "Actual", "Alert", []),
        ("later", H(20), H(23), None, H(20), "Actual", "Alert", ["c"]),  # not known yet
    ]
    df = spark.createDataFrame(rows, cols)
    assert {r.alert_id for r in joins.not_superseded(df, T).collect()} == {"c"}


def test_null_key_parts_are_equal(spark):
    cols = "feature string, window string, id long"
    stored = spark.createDataFrame([("q", None, 1)], cols)
    batch = spark.createDataFrame([("q", None, 2), ("q", "24h", 3), ("q", "24h", 4)], cols)
    out = revisions.absent(batch, stored, ["feature", "window"], [F.asc("id")])
    assert [(r.window, r.id) for r in out.collect()] == [("24h", 3)]


def test_revisions_link_and_count_inside_a_batch(spark):
    cols = "k string, id long, v int, revision_seq int"
    stored = spark.createDataFrame([("a", 1, 5, 0), ("a", 2, 6, 1)], cols)
    batch = spark.createDataFrame([("a", 10, 6, 1), ("a", 11, 7, 2), ("a", 12, 7, 3), ("b", 13, None, 4), ("b", 14, 1, 5)], "k string, id long, v int, arrived int")
    out = revisions.new_revisions(stored, batch, ["k"], ["v"], "arrived").orderBy("id").collect()
    assert [(r.id, r.revision_seq, r.revises) for r in out] == [(11, 2, 2), (13, 0, None), (14, 1, 13)]  # 10 repeats the stored state and is not written


def test_nearest_never_interpolates_and_prefers_the_earlier_instant(spark):
    left = spark.createDataFrame([(1, "s", H(12)), (2, "s", H(23))], "lid int, k string, target timestamp")
    right = spark.createDataFrame([("s", H(10), 1.0), ("s", H(14), 2.0)], "k string, t timestamp, v double")
    out = joins.nearest_in_time(left, right, ["k"], "target", "t", ["t", "v"], 2.0, ["lid"]).orderBy("lid").collect()
    assert [r.near_v for r in out] == [1.0, None]


@pytest.mark.parametrize("mode,visible", [("KNOWLEDGE_TIME", 0), ("RETROSPECTIVE", 1)])
def test_replay_clock_is_a_view(spark, mode, visible):
    from fluvion.plans import replay

    df = obs(spark, [("a", H(9), H(20), 0, 1, 1.0)])
    p = replay.projected(df, mode, "valid_time")
    assert selection.as_known_at(p, T).count() == visible
    assert [r.available_at for r in replay.restored(p).collect()] == [H(20)]

"""Runs, lags and segments over the borders of blocks, against plain loops over whole keys."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fluvion.operators import hydrograph, running, trend

T0 = datetime(2023, 12, 25)


def series(seed, hot=900):
    """Runs longer than several blocks, blocks that are one break, empty blocks, a key with most rows, a null key."""
    r = random.Random(seed)
    rows = []
    for k, n in (("hot", hot), ("b", 40), (None, 60), ("one", 1)):
        t, up = T0, True
        for _ in range(n):
            t += timedelta(minutes=r.choice([15, 15, 60, 60 * 24 * r.choice([0, 0, 1, 5]) + 15]))
            if r.random() < 0.02:
                up = not up
            rows.append((k, t, up and r.random() > 0.004))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_are_those_of_one_loop(spark, seed):
    rows = series(seed)
    df = spark.createDataFrame(rows, "k string, t timestamp, up boolean").repartition(5)
    got = {(x.k, x.t): (x.run, x.nth) for x in running.runs(df, ["k"], running.day_block(), "t", F.col("up")).collect()}
    want, state = {}, defaultdict(lambda: [0, 0])
    for k, t, up in rows:
        s = state[k]
        if up:
            s[1] += 1
            want[k, t] = (s[0], s[1])
        else:
            s[0], s[1] = s[0] + 1, 0
    assert got == want and max(n for _, n in want.values()) > 60
    assert running.runs(df.limit(0), ["k"], running.day_block(), "t", F.col("up")).count() == 0


@pytest.mark.parametrize("days", [1, 16])
def test_lags_are_those_of_one_loop(spark, days):
    rows = [(*x, None if i % 7 == 0 else i) for i, x in enumerate(series(4))]
    df = spark.createDataFrame(rows, "k string, t timestamp, up boolean, v int").repartition(5)
    got = {(x.k, x.t): (x.was, x.at) for x in running.lagged(df, ["k"], running.day_block("t", days), "t", {"was": "v", "at": "t"}).collect()}
    want, last = {}, {}
    for k, t, _, v in rows:
        want[k, t] = last.get(k, (None, None))
        last[k] = (v, t)
    assert got == want


def test_segments_and_sustained_rises(spark):
    rows = series(5)
    df = spark.createDataFrame([(k, t, 1.0 if up else None, "rising" if up else "steady") for k, t, up in rows], "k string, t timestamp, v double, direction string").repartition(4)
    want, onsets, state = [], set(), {}
    for k, t, up in rows:
        if up:
            s = state.setdefault(k, [])
            s.append(t)
            if len(s) == 8:
                onsets.add((k, t, t - timedelta(hours=2)))
        elif state.get(k):
            want.append((k, state.pop(k)))
    want += list(state.items())
    number, expected = defaultdict(int), set()
    for k, s in sorted(want, key=lambda x: (str(x[0]), x[1][0])):
        number[k] += 1
        expected.add((k, number[k], len(s), s[0], s[-1]))
    assert {tuple(x) for x in hydrograph.segments(df.select("k", "t", "v"), "k").collect()} == expected
    assert {tuple(x) for x in trend.sustained(df.select("k", "t", "direction"), 8, "k").collect()} == onsets and len(onsets) > 5

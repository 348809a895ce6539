"""Streams whose rows come in any order end with the tables of the batch operators."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fluvion.functions import flood
from fluvion.operators import trend
from fluvion.streaming import ingest, repair
from fluvion.streaming.state import KeyedTable

T0 = datetime(2024, 1, 30, 12)


@pytest.fixture(scope="module")
def readings():
    """Two months border, three stations (one without a name), steady climbs, a gap, repeated instants."""
    r = random.Random(5)
    rows = []
    for k in (1, 2, None):
        v = 50.0
        for i in range(220):
            if 90 <= i < 110 or (k == 2 and 150 <= i < 152):
                continue
            v += r.choice([6.0, 5.0, 7.0]) if 20 < i % 80 < 50 else r.choice([-5.0, 0.0, 4.0])
            rows.append((len(rows), k, T0 + timedelta(minutes=15 * i + r.randint(0, 14)), v))
            if i % 17 == 0:
                rows.append((len(rows), k, T0 + timedelta(minutes=15 * i), v - 9))
    return rows


SCHEMA = "id long, station long, ts timestamp, value double"


def arrivals(readings, seed, n):
    r = random.Random(seed)
    parts = [[] for _ in range(n)]
    for row in readings:
        parts[min(n - 1, max(0, row[0] * n // len(readings) + r.choice([0, 0, 0, -1, 1, 2, -n, n])))].append(row)
    return parts


def batches(spark, parts):
    for i, rows in enumerate(parts):
        yield i, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed,n", [(2, 5)])
def test_rates_and_rises_equal_the_batch(spark, tmp_path, readings, seed, n):
    table = repair.Rates(spark, str(tmp_path), "station")
    write = table.writer("ts", "value", F.lit("flow"), 2.0)
    for i, batch in batches(spark, arrivals(readings, seed, n)):
        write(batch, i)
        if i == 1:
            write(batch, i)  # run again after a failure
    df = spark.createDataFrame(readings, SCHEMA)
    quarter = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900)
    series = df.groupBy("station", quarter.alias("t")).agg(F.max("value").alias("v"))
    want = {(x.station, x.window_end): x for x in repair.rated(trend.trailing_windows(series), "station", F.lit("flow")).collect()}
    got = {(x.station, x.window_end): x for x in table.rates.current(n - 1).collect()}
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert (got[k].n, got[k].direction, got[k].refusal) == (x.n, x.direction, x.refusal) and got[k].slope == pytest.approx(x.slope)
    rising, newest = defaultdict(list), {}
    for (k, at), x in sorted(want.items(), key=lambda y: (y[0][0] or 0, y[0][1])):
        newest[k] = at
        if x.direction == "rising":
            runs = rising[k]
            if runs and (at - runs[-1][-1]).total_seconds() <= repair.RISE_GAP_S:
                runs[-1].append(at)
            else:
                runs.append([at])
    want = {(k, run[0], run[-1], len(run), "closed" if newest[k] > run[-1] else "open") for k, runs in rising.items() for run in runs}
    assert {tuple(x) for x in table.rises.current(n - 1).collect()} == want
    # what was told adds up to the long rises: the last word on each is its status
    last = {}
    for x in spark.read.parquet(str(tmp_path / "told")).orderBy("batch").collect():
        assert last.get((x.station, x.first_window)) != x.status
        last[x.station, x.first_window] = x.status
    long = {(k, a): status for k, a, b, _, status in want if b - a >= timedelta(hours=2)}
    assert {k: v for k, v in last.items() if v != "withdrawn"} == long and len(long) >= 3


def test_an_open_rise_is_told_once_and_closed_later(spark, tmp_path):
    table = repair.Rates(spark, str(tmp_path), "station")
    write = table.writer("ts", "value", F.lit("flow"), 2.0)
    rows = [(i, 1, T0 + timedelta(minutes=15 * i), 50.0 + (20 * i if i < 40 else 800 - 30 * (i - 40))) for i in range(70)]
    for i in range(7):
        write(spark.createDataFrame(rows[10 * i : 10 * i + 10], SCHEMA), i)
    told = spark.read.parquet(str(tmp_path / "told")).orderBy("batch").collect()
    assert [x.status for x in told] == ["open", "closed"]


def test_hours_take_late_readings(spark, tmp_path, readings):
    table = repair.hours_table(spark, str(tmp_path), "station")
    write = repair.hourly(table, "station", "ts", "value")
    for i, batch in batches(spark, arrivals(readings, 3, 5)):
        write(batch, i)
        write(batch, i)
    want = spark.createDataFrame(readings, SCHEMA).groupBy("station", F.date_trunc("hour", "ts").alias("valid_time")).agg(F.max("value").alias("value"), F.count("*").alias("n"))
    assert {tuple(x) for x in table.current(4).collect()} == {tuple(x) for x in want.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_silences_are_taken_back_by_late_readings(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([1, 2, None]), T0 + timedelta(minutes=r.choice([5, 37, 400]) * r.randint(0, 40)), 0.0) for i in range(120)]
    parts = [rows[i::6] for i in range(6)] if seed % 2 else arrivals(rows, seed, 6)
    table = repair.Silences(spark, str(tmp_path), "station", 3 * 3600)
    write = table.writer("ts")
    seen = []
    for i, batch in batches(spark, parts):
        write(batch, i)
        seen += parts[i]
        by = defaultdict(set)
        for _, k, t, _ in seen:
            by[k].add(t)
        want = set()
        for k, times in by.items():
            order = sorted(times)
            want.add((k, None, order[0]))
            want |= {(k, a, b) for a, b in zip(order, [*order[1:], None]) if b is None or b - a > timedelta(hours=3)}
        if i in (0, 2, 5):
            assert {tuple(x) for x in table.gaps.current(i).collect()} == want
    now = max(t for _, _, t, _ in rows)
    got = {tuple(x) for x in table.announced(5, {"stale": 3 * 3600, "degraded": 9 * 3600}, F.lit(now)).collect()}
    assert got == {(k, s, a + timedelta(hours=h), a) for k, a, b in want if a for s, h in (("stale", 3), ("degraded", 9)) if a + timedelta(hours=h) <= now and (b is None or a + timedelta(hours=h) < b)}


def test_keyed_table_over_many_versions(spark, tmp_path):
    """30 batches of two keys among many: few runs, every version readable, a batch run again changes nothing."""
    r = random.Random(1)
    table = KeyedTable(spark, str(tmp_path), "k long, t timestamp, v long", ["k", "t"], "t", buckets=2)
    now, versions = {}, []
    for i in range(30):
        for _ in range(1 + (i == 29)):
            rows = {(r.choice([None, *range(30)]), T0 + timedelta(days=r.randint(0, 3))): i for _ in range(2 if i else 60)} if _ == 0 else rows
            gone = [k for k in now if r.random() < 0.02 and k not in rows] if _ == 0 else gone
            table.commit(spark.createDataFrame([(*k, v) for k, v in rows.items()], "k long, t timestamp, v long"), i, spark.createDataFrame(gone, "k long, t timestamp"))
        now = {k: v for k, v in (now | rows).items() if k not in gone}
        versions.append(now)
    assert table.latest() == 29 and len(table.runs(29)) <= 8
    for i in (0, 7, 23, 29):
        assert {(x.k, x.t): x.v for x in table.current(i).collect()} == versions[i]
    wanted = spark.createDataFrame([(None, T0), (3, T0)], "k long, t timestamp")
    assert {(x.k, x.t): x.v for x in table.lookup(wanted, 29).collect()} == {k: v for k, v in now.items() if k in ((None, T0), (3, T0))}


def test_one_late_row_opens_one_place(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), "k long, t timestamp, v long", ["k", "t"], "t", buckets=4)
    table.commit(spark.range(4000).select((F.col("id") % 40).alias("k"), (F.lit(T0) + F.make_dt_interval(days=(F.col("id") / 40).cast("int"))).alias("t"), F.col("id").alias("v")), 0)
    late = spark.createDataFrame([(7, T0 + timedelta(days=1)), (7, T0 + timedelta(days=95))], "k long, t timestamp")
    assert len(table.touched(late)) == 2
    read = table._rows(table.runs(0), table.touched(late))
    files = read.inputFiles()
    assert read.count() < 4000 / 5 and {x.v for x in table.lookup(late, 0).collect()} == {47, 3807}
    assert "PartitionFilters" in read._jdf.queryExecution().toString() and len(files) >= 1


def test_appends_and_revisions_with_null_keys(spark, tmp_path):
    rows = [(1, None, T0, "A"), (2, None, T0, "A"), (3, 5, None, "B")]
    schema = "id long, k long, t timestamp, v string"
    write = ingest.append_absent(str(tmp_path / "a"), ["k", "t"], ["id"], "t")
    again = ingest.append_revisions(str(tmp_path / "r"), ["k", "t"], ["v"], "t")
    for i in range(3):
        batch = spark.createDataFrame([(10 * i + a, b, c, d + str(i // 2)) for a, b, c, d in rows], schema)
        write(batch, i)
        again(batch, i)
    assert sorted(x.id for x in spark.read.parquet(str(tmp_path / "a")).collect()) == [1, 3]
    got = {x.id: (x.revision_seq, x.revises) for x in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert got == {1: (0, None), 3: (0, None), 21: (1, 1), 23: (1, 3)}


def test_levels_changed_between_batches_change_later_rows_only(spark, tmp_path):
    level = lambda i, v, known: (i, 1, "minor", v, T0, known)
    schema = "id long, station long, category string, level double, effective_from timestamp, known_at timestamp"
    spark.createDataFrame([level(1, 10.0, T0)], schema).write.parquet(str(tmp_path / "levels"))
    rows = lambda i: spark.createDataFrame([(i, 1, 15.0, T0 + timedelta(hours=i), T0 + timedelta(hours=i))], "event_id long, station long, value double, valid_time timestamp, available_at timestamp")
    judge = lambda b, d: ingest.as_of(b, d, "station", "event_id", "category", "level", flood.CATEGORIES).select("event_id", flood.category(F.col("value"), flood.level_columns()).alias("c"))
    write = ingest.beside_dimension(str(tmp_path / "out"), lambda: spark.read.schema(schema).parquet(str(tmp_path / "levels")), judge)
    write(rows(1), 0)
    spark.createDataFrame([level(2, 20.0, T0 + timedelta(hours=2))], schema).write.mode("append").parquet(str(tmp_path / "levels"))
    write(rows(2), 1)
    write(rows(0), 2)  # late: the level was not known then
    assert {x.event_id: x.c for x in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "minor", 2: "none", 0: "minor"}

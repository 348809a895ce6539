"""Documents from disk, refusals, and streams against their batch answers."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fluvion.operators import revisions
from fluvion.sources import documents, forecasts, gauges, notices
from fluvion.streaming import ingest, windows


def reading(**over):
    base = {"monitoring_location_id": "USGS-1", "parameter_code": "00060", "time": "2024-01-01T00:00:00+02:00", "value": "12.5", "unit_of_measure": "ft^3/s"}
    return {"properties": {**base, **over}}


def test_directory_of_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.json").write_text(json.dumps({"features": [reading(), reading(value="Ice")]}, indent=1))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "short.json").write_text(json.dumps({"features": [reading(time=None)]}))
    (tmp_path / "naive.json").write_text(json.dumps({"features": [reading(time="2024-01-01T00:00:00")]}))
    pages = gauges.continuous(documents.read_directory(spark, str(tmp_path)))
    rows = gauges.continuous_rows(pages).orderBy("value").collect()
    assert [(r.site, r.variable, r.value, r.valid_time) for r in rows] == [("USGS-1", "flow", None, datetime(2023, 12, 31, 22)), ("USGS-1", "flow", 12.5, datetime(2023, 12, 31, 22))]
    why = {r.path.rsplit("/", 1)[1]: r.refusal for r in documents.refusals(pages).collect()}
    assert why == {"bad.json": "malformed", "short.json": "missing_required_field", "naive.json": "naive_instant"}


def test_catalog_without_reading_content(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"12345")
    assert [r.size_bytes for r in documents.catalog_directory(spark, str(tmp_path)).collect()] == [5]


def test_csv_columns_are_found_by_name(spark):
    text = "approval_status,time,value\nApproved,2024-01-02,\nProvisional,2024-01-01,3.5\n"
    df = spark.createDataFrame([("p", "S1", text), ("q", "S2", "time,value\n2024-01-01,1\n")], "path string, site string, content string")
    files = gauges.daily_csv(df)
    rows = gauges.daily_rows(files).orderBy("day").collect()
    assert [(str(r.day), r.raw, r.approval) for r in rows] == [("2024-01-01", "3.5", "Provisional"), ("2024-01-02", None, "Approved")]
    assert [r.refusal for r in documents.refusals(files).collect()] == ["missing_column"]


def test_empty_ensemble_list_is_an_answer(spark):
    g = forecasts.ensembles(spark.createDataFrame([("p", "[]")], "path string, content string"))
    assert g.count() == 0


def test_crest_is_read_only_from_the_forecast_bullet(spark):
    text = (
        "\x01WGUS46 KSEW 091701 CCA\nFLWSEW\n\nWAC033-\n/O.NEW.KSEW.FL.W.0042.251209T1701Z-000000T0000Z/\n/ABCW1.2.ER.251209T1701Z.251210T1200Z.251211T0000Z.NO/\n"
        "* Flood stage is 10.0 feet.\n- Forecast...rising to 1,234.5 cfs then\n  to a crest of 12 feet.\n* Impact...at 99 feet flooding to 88 feet.\n$$\n\x03"
    )
    s = notices.segments(notices.bulletins(spark.createDataFrame([("p", text)], "path string, content string"))).first()
    assert (s.lid, s.severity, s.wmo, s.mentions, s.crest) == ("ABCW1", "2", "091701", [1234.5, 12.0], 1234.5)
    assert s.crest_time == datetime(2025, 12, 10, 12)


@pytest.fixture()
def landing(spark, tmp_path):
    """Three landings of readings of two stations; the third repeats and corrects."""
    rows, t0 = [], datetime(2024, 1, 1)
    for i in range(240):
        rows.append((i, i % 2, t0 + timedelta(minutes=15 * (i // 2)), float(i % 37), i // 80))
    df = spark.createDataFrame(rows, "id long, station long, ts timestamp, value double, part int")
    for p in range(3):
        df.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df.drop("part"), str(tmp_path / "in"), tmp_path


def test_streamed_revisions_equal_one_batch(spark, landing):
    df, path, tmp = landing
    keyed = lambda d: d.select("station", F.to_date("ts").alias("day"), "id", F.floor(F.col("value") / 10).cast("int").alias("v"))
    s = keyed(ingest.open_stream(spark, path, df.schema, 1))
    ingest.run_available(s, str(tmp / "cp"), ingest.append_revisions(str(tmp / "out"), ["station", "day"], ["v"], "day"))
    got = {(r.id, r.revision_seq) for r in spark.read.parquet(str(tmp / "out")).collect()}
    batch = keyed(df).withColumn("arrived", F.col("id"))
    empty = batch.limit(0).withColumn("revision_seq", F.lit(0))
    want = {(r.id, r.revision_seq) for r in revisions.new_revisions(empty, batch, ["station", "day"], ["v"], "arrived").collect()}
    assert got == want


def test_first_look_primes_silently(spark, landing):
    df, path, tmp = landing
    s = ingest.open_stream(spark, path, df.schema, 1).select(F.col("station").cast("string").alias("product"), "ts")
    ingest.run_available(s, str(tmp / "cp"), ingest.change_events(str(tmp / "anchors"), str(tmp / "events"), "product", "ts"))
    out = spark.read.parquet(str(tmp / "events"))
    assert {(r.product, r.batch) for r in out.collect()} == {("0", 1), ("1", 1), ("0", 2), ("1", 2)}
    assert out.filter("previous IS NULL").count() == 0


def test_streamed_rates_match_the_windows(spark, landing):
    import numpy as np

    df, path, tmp = landing
    r = windows.rates(ingest.open_stream(spark, path, df.schema, 1), "station", "ts", "value", "1 hour", F.lit("flow"))
    ingest.run_to_table(r, str(tmp / "cp"), str(tmp / "rates"))
    pts = {}
    for x in df.collect():
        pts.setdefault(x.station, {})[x.ts] = x.value
    seen = spark.read.parquet(str(tmp / "rates")).filter("refusal = 'ok'").collect()
    assert len(seen) > 50
    for row in seen:
        win = sorted((t, v) for t, v in pts[row.station].items() if row.window_end - timedelta(hours=6) <= t <= row.window_end)
        x = np.array([t.timestamp() / 3600 for t, _ in win])
        y = np.array([v for _, v in win])
        inner = [np.median([(y[j] - y[i]) / (x[j] - x[i]) for j in range(len(x)) if j != i]) for i in range(len(x))]
        assert row.n == len(win) and row.slope == pytest.approx(np.median(inner))


def test_silent_station_is_announced_by_timer(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    parts = [[("a", t0), ("b", t0)], [("b", t0 + timedelta(hours=6))], [("b", t0 + timedelta(hours=12))], [("b", t0 + timedelta(hours=13))]]
    for rows in parts:
        spark.createDataFrame(rows, "station string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = ingest.open_stream(spark, str(tmp_path / "in"), "station string, ts timestamp", 1)
    ingest.run_to_table(windows.staleness(s, "station", "ts", 3600, 3600, "0 seconds"), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {(r.key, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("a", "stale") in got and ("a", "degraded") in got


def test_stations_share_states_and_keep_their_own_timers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(windows, "KEY_GROUPS", 3, raising=False)
    r, t0, at, batches = random.Random(1), datetime(2024, 1, 1), 0, []
    for _ in range(8):
        at += r.choice([0, 1, 2, 4])
        # whole hours, so that timers also fall on the watermark itself; no reading is behind it
        batches.append([(r.choice([None, "None", *"abcdefgh"]), t0 + timedelta(hours=at - r.choice([0, 0, 1, 2]))) for _ in range(r.choice([2, 4, 6]))])
        spark.createDataFrame(batches[-1], "station string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # what a timer for each station does, batch by batch and once more without rows
    steps, tick, mark = [("stale", timedelta(hours=2)), ("degraded", timedelta(hours=4))], timedelta(milliseconds=1), datetime(1970, 1, 1)
    known, want = {}, []
    for rows in [*batches, []]:
        heard = {k: max(t for x, t in rows if x == k) for k, _ in rows}
        for k, (last, n, timer) in list(known.items()):
            if k not in heard and n < 2 and timer < mark:
                want.append((str(k), steps[n][0], last + steps[n][1], last))
                known[k] = (last, n + 1, max(last + steps[n + 1][1], mark + tick) if n == 0 else None)
        for k, t in heard.items():
            last, n, _ = known.get(k, (datetime(1970, 1, 1), 0, None))
            last, n = (t, 0) if t > last else (last, n)
            known[k] = (last, n, max(last + steps[n][1], mark + tick) if n < 2 else None)
        mark = max([mark, *(t - timedelta(hours=2) for _, t in rows)])
    s = ingest.open_stream(spark, str(tmp_path / "in"), "station string, ts timestamp", 1)
    q = ingest.run_to_table(windows.staleness(s, "station", "ts", 3600, 3600, "2 hours"), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(want) and len(want) == 12
    assert len(known) > 6 and q.lastProgress.stateOperators[0].numRowsTotal <= 3

"""Documents of the first prototype: sentinels, missing parts, broken payloads, empty tables."""

import json

from fluvion.sources import documents, prototype


def reading(code, points, unit="ft3/s"):
    return {"variable": {"variableCode": [{"value": code}], "unit": {"unitCode": unit}}, "values": [{"value": [{"value": v, "dateTime": t} for v, t in points]}]}


def series(spark, *bodies):
    rows = [(f"d{i}", 1, b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)]
    out = prototype.series(spark.createDataFrame(rows, "path string, site int, content string")).collect()
    assert len(out) == 2 * len(bodies)
    return {(r["path"], r["variable"]): r for r in out}


def test_points_that_count(spark):
    body = {"value": {"timeSeries": [
        reading("00065", [("2.5", "2024-01-02T00:00"), ("-999998", "2024-01-03T00:00"), ("-999997.5", "2024-01-01T00:00"), ("Ice", "2024-01-04T00:00"), ("7", None), ("8", ""), (None, "2024-01-05T00:00")], "ft"),
        reading("00060", [("1", "2024-01-02T00:00"), ("2", "2024-01-02T00:00")]), reading("00010", [("9", "2024-01-02T00:00")]),
    ]}}
    got = series(spark, body)
    stage, flow = got["d0", "stage"], got["d0", "flow"]
    assert [(p["t"], p["v"]) for p in stage["points"]] == [("2024-01-01T00:00", -999997.5), ("2024-01-02T00:00", 2.5)]
    assert (stage["latest"], stage["latest_at"], stage["unit"], stage["note"]) == (2.5, "2024-01-02T00:00", "ft", "ok")
    # of two points at the latest time the first of the document is the latest
    assert (flow["latest"], flow["unit"], len(flow["points"])) == (1.0, "cfs", 2)


def test_last_series_stands_and_blocks_are_joined(spark):
    twice = reading("00060", [("3", "b")])
    twice["values"].append({"value": [{"value": "4", "dateTime": "a"}]})
    twice["values"].append({"value": None})
    got = series(spark, {"value": {"timeSeries": [reading("00060", [("1", "z")]), twice]}})["d0", "flow"]
    assert [(p["t"], p["v"]) for p in got["points"]] == [("a", 4.0), ("b", 3.0)]


def test_why_there_is_no_value(spark):
    got = series(spark, '{"value": {"time', None, {}, {"value": {"timeSeries": []}}, {"value": {"timeSeries": [reading("00065", [("Ice", "a")])]}})
    assert [got[f"d{i}", "stage"]["note"] for i in range(5)] == ["malformed", "malformed", "no_data", "no_data", "empty_series"]
    assert [got[f"d{i}", "flow"]["note"] for i in range(5)] == ["malformed", "malformed", "no_data", "no_data", "no_data"]
    assert all(r["latest"] is None and r["points"] == [] for r in got.values())


def test_first_number_of_a_category_decides(spark):
    cats = {"action": {"stage": None, "value": "x", "ft": 3}, "minor": {"stage": -9000, "value": 5}, "moderate": 7, "major": {"stage": "-8999.5"}}
    rows = [("a", json.dumps({"flood": {"categories": cats}})), ("b", "{}"), ("c", '{"flood": {"categories": {"minor": {"stage": -9999}}}}'), ("d", "<html>"), ("e", '{"flood": null}')]
    got = {r["path"]: r for r in prototype.levels(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert [got["a"][c] for c in ("action", "minor", "moderate", "major")] == [3.0, None, None, -8999.5]
    assert {k: r["refusal"] for k, r in got.items()} == {"a": None, "b": "missing_categories", "c": "missing_categories", "d": "malformed", "e": "missing_categories"}


def entry(station, *blocks):
    return {"stationTriplet": station, "data": [{"stationElement": {"elementCode": c}, "values": [{"date": d, "value": v} for d, v in vs]} for c, vs in blocks]}


def test_snow_of_asked_stations(spark):
    body = [
        entry("1:WA", ("WTEQ", [("2024-01-01", 1)])),
        entry("1:WA", ("SMS", [("2024-01-01", 9)]), ("WTEQ", [("2024-01-02", 2.5), ("2024-01-03", None), (None, 4), ("2024-01-04", "M"), ("2024-01-05", 0)]), ("WTEQ", [("2024-01-06", 6)])),
        entry("1:WA", ("SMS", [("2024-01-07", 9)])), entry("2:WA", ("WTEQ", [("2024-01-01", 8)])), entry(None, ("WTEQ", [("2024-01-01", 8)])),
    ]
    rows = [("a", ["1:WA", "3:WA"], json.dumps(body)), ("b", ["1:WA"], "[{"), ("c", ["1:WA"], "[]"), ("d", [], json.dumps(body))]
    out = prototype.snow(spark.createDataFrame(rows, "path string, stations array<string>, content string"))
    assert sorted((r["path"], r["station"], str(r["day"]), r["value"]) for r in out.collect()) == [("a", "1:WA", "2024-01-02", 2.5), ("a", "1:WA", "2024-01-05", 0.0)]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "path string, site int, stations array<string>, content string")
    assert prototype.series(empty).count() == prototype.levels(empty).count() == prototype.snow(empty).count() == 0
    assert documents.refusals(prototype.levels(empty)).count() == 0

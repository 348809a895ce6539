"""What grows with the tables: documents parsed once, windows copied only where asked, values dealt by run, bounded n-grams."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fluvion.llm import language
from fluvion.operators import doy
from fluvion.sources import bindings, documents, forecasts, gauges, notices


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_xml_is_parsed_once(spark):
    row = '<observedValue petype="HF" tsCode="RZ"><dataDateTime>{}</dataDateTime><forebay units="ft">{}</forebay></observedValue>'
    page = lambda site, *rows: f'<HydroMetData><SiteData id="{site}">{"".join(rows)}</SiteData></HydroMetData>'
    docs = spark.createDataFrame([
        ("good", "D1", "HF", page("D1", row.format("2001-01-01T08:00:00Z", 3), row.format("2001-01-02T08:00:00Z", 4))),
        ("other", "D1", "HF", page("D2", row.format("2001-01-01T08:00:00Z", 3))),
        ("naive", "D1", "HF", page("D1", row.format("2001-01-01T08:00:00", 3))),
        ("none", "D1", "HF", None),
    ], "path string, lid string, pe string, content string")
    parsed = notices.reservoir_xml(docs)
    assert optimized(notices.reservoir_rows(parsed)).count("from_xml(") == 1
    assert optimized(documents.refusals(parsed)).count("from_xml(") == 1
    assert sorted(r.value for r in notices.reservoir_rows(parsed).collect()) == [3.0, 4.0]
    assert {r.path: r.refusal for r in documents.refusals(parsed).collect()} == {"other": "wrong_site", "naive": "naive_instant", "none": "no_site"}


def test_json_and_lines_are_parsed_once(spark):
    docs = spark.createDataFrame([("q", "x", "s")], "path string, content string, site string")
    for df, call in (
        (forecasts.quantile_rows(forecasts.quantiles(docs)), "from_json("), (forecasts.ensemble_rows(forecasts.ensembles(docs)), "from_json("),
        (forecasts.medium_range(docs), "from_json("), (gauges.daily_rows(gauges.daily_csv(docs)), "split(content"),
    ):
        assert optimized(df).count(call) == 1


def test_bulletin_patterns_are_matched_once(spark):
    event = "/{}.1.ER.250101T0000Z.250102T0{}00Z.250103T0000Z.NO/\n"
    segment = lambda lid, n: f"WAC00{n}-\n" + event.format(lid, n) + f"  - Forecast...The river will rise to {n}.5 feet and then\n    to a crest of 1,00{n} feet tomorrow.\n$$\n"
    head = "\x01WGUS46 KSEW 010000\r\nFLWSEW\n\n"
    texts = [
        ("good", head + segment("ABCD1", 1) + segment("ABCD2", 2) + "\x03"),
        ("before", head + event.format("AAAA1", 1) + segment("ABCD1", 1) + "\x03"),  # the first event line stands before any zone line
        ("two", head + segment("ABCD1", 1).replace("  - F", event.format("ABCD9", 3) + "  - F") + "\x03"),
        ("bare", "\x01no heading\n" + segment("ABCD1", 1)), ("line", "\x01WGUS46 KSEW 010000\n\n" + segment("ABCD1", 1)),
    ]
    products = notices.bulletins(spark.createDataFrame(texts, "path string, content string"))
    plan = optimized(notices.segments(products).select("lid", "crest_time", "begin_time", "forecast_text", "mentions", "crest"))
    assert plan.count(notices.FORECAST_BULLET.split("\n")[0][:30]) == 1
    rows = {(r.path, r.lid): r for r in notices.segments(products).collect()}
    assert {k for k in rows if k[0] == "good"} == {("good", "ABCD1"), ("good", "ABCD2")}
    assert rows["good", "ABCD2"].mentions == [2.5, 1002.0] and rows["good", "ABCD2"].crest == 1002.0 and rows["good", "ABCD2"].severity == "1"
    assert str(rows["good", "ABCD2"].crest_time) == "2025-01-02 02:00:00"
    assert {r.path: r.refusal for r in documents.refusals(products).collect()} == {"two": "several_event_lines", "bare": "no_heading", "line": "no_product_line"}


def test_only_asked_windows_are_copied(spark):
    days = [(s, d, float(s + d)) for s in (1, 2, 3) for d in range(0, 366, 3)] + [(None, 1, 0.0), (1, None, 0.0)]
    daily = spark.createDataFrame(days, "site int, doy int, value double")
    keys = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 365), (9, 5), (2, None), (None, 1)], "site int, key int")
    met = doy.site_windows(daily, keys)
    whole = {tuple(r) for r in doy.site_windows(daily).select("site", "key", "doy", "value").collect()}
    expected = sorted(x for x in whole if x[:2] in {(1, 0), (1, 2), (2, 365)})
    assert sorted(map(tuple, met.select("site", "key", "doy", "value").collect())) == expected
    # copies made: what the generators of the plan give out
    plan = optimized(met)
    assert "LeftSemi" not in plan and plan.count("explode(") == 1 and "array_intersect" in plan


def test_values_are_dealt_by_run_as_the_table_grows(spark, tmp_path, monkeypatch):
    spark.range(600).selectExpr("id div 4 as l_orderkey", "cast(id % 4 + 1 as int) as l_linenumber", "id as l_partkey", "id as l_suppkey", "1.0D as l_extendedprice", "2.0D as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(140).selectExpr("id as o_orderkey", "id as o_custkey", "'x' as o_orderpriority", "date'2001-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    t = bindings.Tables(spark, str(tmp_path))
    monkeypatch.setattr(bindings, "TASK_VALUES", 10)
    assert t.dealt_values().rdd.getNumPartitions() == 60
    assert t.run_values().count() == t.run_values(t.forecast_runs(), most=True).count() == 560
    monkeypatch.setattr(bindings, "TASK_VALUES", 600)
    assert t.dealt_values().rdd.getNumPartitions() < 60


def test_language_holds_few_vectors():
    rng = np.random.default_rng(7)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 3000)) for _ in range(20)]
    profile = np.eye(language.DIM)[:, :2]
    run = language._predict(["a", "b"], profile)
    part = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], ["doc_id", "_text"])
    tracemalloc.start()
    (out,) = run(iter([part]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    # the bundle of a text is the sum of its n-grams' vectors
    found, n = np.unique(language.grams(texts[0]), return_counts=True)
    bundle = sum(n[i : i + 500].astype(float) @ language.gram_vectors(found[i : i + 500]) for i in range(0, len(found), 500))
    assert abs(out.column(2)[0].as_py() - max(0.0, *(bundle[:2] / np.linalg.norm(bundle)))) < 1e-9


def test_basins_that_are_not_asked_for_bring_no_pixels_or_runs(spark, tmp_path):
    from fluvion.catalog import grids, surfaces

    at = str(tmp_path)
    spark.range(40).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey", "100.0D as s_acctbal").write.parquet(f"{at}/supplier.parquet")
    spark.range(70).selectExpr("id as vec_id", "id as label", "transform(sequence(0, 63), i -> float(i % 9) / 30) as embedding").write.parquet(f"{at}/embeddings.parquet")
    spark.range(160).selectExpr("id as o_orderkey", "id % 40 as o_custkey", "'1-URGENT' as o_orderpriority", "timestamp'2001-01-01' + make_dt_interval(cast(id % 3 as int)) as o_orderdate").write.parquet(f"{at}/orders.parquet")
    spark.range(1120).selectExpr("id div 7 as l_orderkey", "cast(id % 7 + 1 as int) as l_linenumber", "id as l_partkey", "id as l_suppkey", "1.0D as l_extendedprice", "cast(id % 50 as double) as l_quantity").write.parquet(f"{at}/lineitem.parquet")
    t, asked = bindings.Tables(spark, at), spark.createDataFrame([(3,), (7,), (31,), (99,)], "basin long")
    assert {x.basin for x in grids.pixels(t, basins=asked.withColumnRenamed("basin", "ring_id")).collect()} == {3, 7, 31}
    assert {x.basin for x in surfaces.forcing_inputs(t, asked)[1].collect()} == {3, 7, 31}
    some, all_ = (sorted(map(tuple, df.collect())) for df in (surfaces.forcing_rows(t, asked), surfaces.forcing_rows(t).join(asked, "basin", "left_semi")))
    assert some == all_ and len(some) == 3 and all(x[8] is not None for x in some)

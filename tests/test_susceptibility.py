"""Susceptibility in company: the published ladder's doubt, snow as context, and what a refused gauge says."""

from datetime import date, datetime as dt, timedelta

import pytest
from pyspark.sql import functions as F

from fluvion.functions.clocks import doy_index, water_year
from fluvion.plans import susceptibility

AT = dt(2001, 10, 26, 6)
LAST = date(2001, 10, 25)


def daily(spark, last=LAST, site=1):
    """Twelve years of the five days around the last one, values 10, 11, 12, …; the last day 30, the two before 20 and 15."""
    rows = []
    for y in range(1, 13):
        for k in range(-2, 3):
            rows.append((site, date(last.year - y, last.month, last.day) + timedelta(days=k), float(10 + (y * 5 + k) % 20)))
    rows += [(site, last - timedelta(days=2), 15.0), (site, last - timedelta(days=1), 20.0), (site, last, 30.0)]
    d = spark.createDataFrame(rows, "site int, day date, value double")
    return d.withColumn("doy", doy_index(F.col("day"))).withColumn("wy", water_year(F.col("day")))


def published(site, key, median):
    return [] if median == "absent" else [(site, key, median)]


def assessed(spark, sites):
    """``sites``: number → (last day, ceiling, published median or "absent"); all in one run."""
    d = None
    for site, (last, _, _) in sites.items():
        one = daily(spark, last, site)
        d = one if d is None else d.unionByName(one)
    keys = {date(2001, 10, 25): 298, date(2001, 10, 20): 293}
    median = spark.createDataFrame([r for n, (last, _, m) in sites.items() for r in published(n, keys[last], m)], "site int, doy int, published_p50 double")
    ceilings = spark.createDataFrame([(n, c) for n, (_, c, _) in sites.items()], "site int, ceiling string")
    return susceptibility.assess(d, F.lit(AT).cast("timestamp"), ceilings, 86400, 14400, "0.2.0", median)


OLD = date(2001, 10, 20)


@pytest.fixture(scope="module")
def states(spark):
    median = 1.0 + assessed(spark, {1: (LAST, "high", 1.0)}).first()["disagreement_pct"] / 100
    sites = {1: (LAST, "high", 1.0), 2: (OLD, "high", 1.0), 3: (LAST, "low", 1.0), 4: (LAST, "high", "absent"), 5: (LAST, "high", None), 6: (LAST, "high", 0.0)}
    sites |= {10 + i: (LAST, "high", median * f) for i, f in enumerate((1.0, 1 / 1.09, 1 / 1.12, 1 / 0.88))}
    folder = spark.conf.get("spark.checkpoint.dir") + "/states"
    assessed(spark, sites).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def test_a_tenth_of_disagreement_lowers_confidence(states):
    rows = {r["site"]: (r["confidence"], r["disagreement_pct"] is not None) for r in states.filter("site >= 10").collect()}
    assert rows == {10: ("high", False), 11: ("high", False), 12: ("moderate", True), 13: ("moderate", True)}


def test_without_a_usable_published_median_nothing_is_disputed(states):
    assert {(r["confidence"], r["disagreement_pct"]) for r in states.filter("site IN (4, 5, 6)").collect()} == {("high", None)}


def test_low_is_the_floor_and_refusals_stay_unknown(states):
    assert states.filter("site = 3").first()["confidence"] == "low"
    old = states.filter("site = 2").first()
    assert (old["reason"], old["confidence"], old["disagreement_pct"]) == ("daily_mean_too_old", "unknown", None)


def drivers(spark, state, site, swe=(), precip=(), snow=()):
    sites = spark.createDataFrame([(site, 7)], "site int, basin int")
    one = lambda rows: spark.createDataFrame(list(rows), "basin int, clock timestamp, value double")
    grid = spark.createDataFrame(list(snow), "basin int, clock timestamp, swe_mm double, covered double")
    rows = susceptibility.drivers(state.filter(F.col("site") == site), sites, one(swe), one(precip), grid).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return {r["feature"]: r for r in rows}, [r["feature"] for r in rows]


def test_all_drivers_in_their_order(spark, states):
    day = dt(2001, 10, 24)
    found, order = drivers(spark, states, 1, [(7, day, 80.0)], [(7, day, 120.0), (8, day, 5.0)], [(7, day, 42.0, 0.123456)])
    assert order == [
        "streamflow_doy_percentile", "streamflow_seasonal_multiple", "streamflow_growth_24h", "streamflow_growth_48h", "basin_swe_percent_of_median",
        "basin_swe_mm", "basin_snow_covered_fraction", "snotel_precip_14d_percent_of_median", "soil_saturation_percentile", "climatology_p50_disagreement",
    ]
    assert (found["streamflow_growth_24h"]["value"], found["streamflow_growth_48h"]["value"]) == (1.5, 2.0)
    assert found["basin_snow_covered_fraction"]["value"] == 12.35
    assert found["snotel_precip_14d_percent_of_median"]["value"] == 120.0
    assert {found[f]["direction"] for f in order[4:8]} == {"context_not_scored"}
    assert found["soil_saturation_percentile"]["value"] is None


def test_missing_snow_is_said_and_a_missing_field_is_silent(spark, states):
    found, order = drivers(spark, states, 4)
    assert "basin_swe_mm" not in order and "climatology_p50_disagreement" not in order
    assert found["basin_swe_percent_of_median"]["value"] is None and found["basin_swe_percent_of_median"]["clock"] is None
    # a field that was read and refused keeps its row and clock, its covered share has none
    found, order = drivers(spark, states, 4, snow=[(7, dt(2001, 10, 24), None, None)])
    assert found["basin_swe_mm"]["clock"] == dt(2001, 10, 24) and "basin_snow_covered_fraction" not in order


def test_a_refused_gauge_has_the_soil_row_alone(spark, states):
    _, order = drivers(spark, states, 2, [(7, dt(2001, 10, 24), 80.0)])
    assert order == ["soil_saturation_percentile"]


def test_context_is_newest_known_and_at_most_a_week_old(spark):
    rows = [
        (1, dt(2001, 10, 20), dt(2001, 10, 21), 1.0), (1, dt(2001, 10, 22), dt(2001, 10, 26, 6), 2.0), (1, dt(2001, 10, 24), dt(2001, 10, 26, 7), 3.0),
        (2, dt(2001, 10, 19, 6), dt(2001, 10, 20), 4.0), (3, dt(2001, 10, 19, 5), dt(2001, 10, 20), 5.0), (4, dt(2001, 10, 27), dt(2001, 10, 26), 6.0),
        (5, dt(2001, 10, 20), dt(2001, 10, 21), 7.0), (5, dt(2001, 10, 20), dt(2001, 10, 22), 8.0), (6, None, dt(2001, 10, 20), 9.0),
    ]
    df = spark.createDataFrame(rows, "basin int, clock timestamp, known_at timestamp, value double")
    got = susceptibility.current_context(df, F.lit(AT).cast("timestamp"))
    assert {r["basin"]: r["value"] for r in got.collect()} == {1: 2.0, 2: 4.0, 5: 8.0}

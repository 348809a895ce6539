"""Day-of-year statistics, slopes, shapes and masks against brute force."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvion.functions import bands, clocks, flood, values
from fluvion.operators import agreement, doy, masks, trend


def daily(spark, rows):
    df = spark.createDataFrame(rows, "site string, day date, value double")
    return df.withColumn("doy", clocks.doy_index(F.col("day"))).withColumn("wy", clocks.water_year(F.col("day")))


@pytest.fixture(scope="module")
def record(spark):
    rng = np.random.default_rng(5)
    rows = []
    for y in range(1996, 2005):
        for k in range(365):
            if rng.random() < 0.8:
                rows.append(("s", date(y, 1, 1) + timedelta(days=k), float(rng.integers(1, 60))))
    return rows


def keys_around(index):
    return {(index + o) % 366 for o in range(-2, 3)}


def index_of(d):
    return (date(2000, d.month, d.day) - date(2000, 1, 1)).days


def test_ladder_is_type_7_and_wraps(spark, record):
    got = {r.key: r for r in doy.ladder(daily(spark, record)).collect()}
    ref = {r.key: r for r in doy.reference(daily(spark, record)).collect()}
    for key in (0, 1, 59, 200, 364, 365):
        pool = sorted(v for _, d, v in record if index_of(d) in keys_around(key))
        assert got[key].n == ref[key].n == len(pool)
        for level in doy.LEVELS:
            assert got[key][doy.P[level]] == pytest.approx(np.percentile(pool, level))
            assert ref[key][doy.P[level]] == pytest.approx(np.percentile(pool, level))


def test_record_prefers_the_later_day(spark):
    rows = [("s", date(2000 + i, 3, 1), 5.0) for i in range(9)] + [("s", date(2003, 3, 2), 9.0), ("s", date(2001, 3, 1) + timedelta(days=1), 9.0)]
    ctx = {r.key: r for r in doy.record_context(daily(spark, rows)).collect()}
    assert ctx[60].maximum == 9.0 and ctx[60].maximum_day == date(2003, 3, 2)


def test_small_samples_give_no_ladder(spark):
    rows = [("s", date(2000 + i, 7, 1), 1.0 + i) for i in range(9)]
    assert doy.ladder(daily(spark, rows)).count() == 0


def test_calendar_lag_is_not_a_row_lag(spark):
    rows = [("s", date(2000, 1, 1), 2.0), ("s", date(2000, 1, 3), 4.0), ("s", date(2000, 1, 4), 8.0)]
    out = doy.growth_ratios(daily(spark, rows), 24).collect()
    assert [(r.day, r.growth) for r in out] == [(date(2000, 1, 4), 2.0)]


def test_growth_keeps_the_largest_tenth_with_the_whole_denominator(spark, record):
    ref = doy.growth_reference(daily(spark, record), 24).collect()
    by_day = {d: v for _, d, v in record}
    ratios = sorted(round(v / by_day[d - timedelta(days=1)], 4) for d, v in by_day.items() if d - timedelta(days=1) in by_day)
    keep = math.ceil(0.1 * len(ratios))
    assert {r.n for r in ref} == {len(ratios)}
    assert sorted(r.growth for r in ref) == pytest.approx(ratios[-keep:])


def test_percentile_clamps_and_steps(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 3.0, 5.0, 6.0, 7.0)], ", ".join(f"{c} double" for c in doy.P.values()))
    for v, want in ((0.5, 5.0), (1.5, 7.5), (3.0, 25.0), (4.0, 62.5), (9.0, 95.0)):
        assert df.select(doy.percentile_of(F.lit(v)).alias("p")).first().p == pytest.approx(want)


def brute_slopes(x, y):
    n = len(x)
    pairs = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(i + 1, n) if x[j] != x[i]]
    inner = [np.median([(y[j] - y[i]) / (x[j] - x[i]) for j in range(n) if x[j] != x[i]]) for i in range(n)]
    return np.median(pairs), np.median(inner), *np.percentile(pairs, [25, 75])


def test_slopes_of_every_window(spark):
    rng = np.random.default_rng(1)
    t0 = datetime(2024, 1, 1)
    pts, t = [], t0
    for _ in range(300):
        pts.append(("s", t, float(rng.integers(0, 100))))
        t += timedelta(minutes=15 * int(rng.integers(1, 7)))
    series = spark.createDataFrame(pts, "station string, t timestamp, v double")
    est = trend.estimate(trend.trailing_windows(series), F.lit("FLUVIAL"), F.lit("flow"))
    ts = {r.t: r for r in est.collect()}
    ols = {r.t: r.ols_slope for r in trend.slopes(trend.trailing_windows(series), ("ols",)).collect()}
    assert len(ts) == len(pts)
    for _, end, last in pts:
        win = [((p[1] - t0).total_seconds() / 3600, p[2]) for p in pts if end - timedelta(hours=6) <= p[1] <= end]
        x, y = zip(*win)
        gaps = [b - a for a, b in zip(x, x[1:])] or [0]
        r = ts[end]
        assert r.n == len(win)
        want = "INSUFFICIENT_OBSERVATIONS" if len(win) < 3 else "GAP_EXCEEDS_TOLERANCE" if max(gaps) > 2 else "SPAN_BELOW_MINIMUM" if x[-1] - x[0] < 3 else "ok"
        assert r.refusal == want
        if want == "ok":
            _, rm, q25, q75 = brute_slopes(x, y)
            assert (r.slope, r.q25, r.q75) == pytest.approx((rm, q25, q75))
            assert ols[end] == pytest.approx(np.polyfit(x, y, 1)[0], abs=1e-9)
            eps = max(1.0, abs(last) * 0.01)
            assert r.direction == ("steady" if abs(rm) <= eps else "rising" if rm > 0 else "falling")


def test_tide_refuses_before_counting(spark):
    series = spark.createDataFrame([("s", datetime(2024, 1, 1), 1.0)], "station string, t timestamp, v double")
    w = trend.trailing_windows(series)
    codes = [trend.estimate(w, c, F.lit("stage")).first().refusal for c in (F.lit("TIDAL"), F.lit(None).cast("string"), F.lit("FLUVIAL"))]
    assert codes == ["TIDAL_CONTAMINATION", "TIDAL_CLASS_UNVERIFIED", "INSUFFICIENT_OBSERVATIONS"]


def clip(poly, axis, bound, keep_less):
    out = []
    for a, b in zip(poly, poly[1:] + poly[:1]):
        ka, kb = ((p[axis] <= bound) == keep_less or p[axis] == bound for p in (a, b))
        if ka:
            out.append(a)
        if ka != kb:
            s = (bound - a[axis]) / (b[axis] - a[axis])
            p = [a[0] + s * (b[0] - a[0]), a[1] + s * (b[1] - a[1])]
            p[axis] = bound
            out.append(tuple(p))
    return out


def area(poly):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(poly, poly[1:] + poly[:1]))) / 2


def test_mask_equals_clipping_each_cell(spark):
    outer = [(1.2, 0.7), (9.6, 2.3), (8.1, 7.9), (4.4, 5.5), (0.3, 8.8)]
    hole = [(3.1, 3.3), (3.4, 4.9), (5.2, 4.1)]
    ring = lambda r: [{"x": x, "y": y} for x, y in r]
    df = spark.createDataFrame([("b", 0, 0, ring(outer[::-1])), ("b", 0, 1, ring(hole))], "basin string, part int, ring int, pts array<struct<x: double, y: double>>")
    got = {(r.i, r.j): r.weight for r in masks.coverage(df, 20).collect()}

    def cell(poly, i, j):
        for axis, k in ((0, i), (1, j)):
            poly = clip(poly, axis, k - 0.5, False)
            poly = clip(poly, axis, k + 0.5, True) if poly else poly
        return area(poly) if len(poly) > 2 else 0.0

    for i in range(12):
        for j in range(12):
            want = cell(outer, i, j) - cell(hole, i, j)
            assert got.get((i, j), 0.0) == pytest.approx(want, abs=2e-6), (i, j)


def shape(spark, vs):
    t0 = datetime(2024, 1, 1)
    rows = [("p", t0 + timedelta(hours=6 * i), float(v)) for i, v in enumerate(vs)]
    return agreement.hydrographs(spark.createDataFrame(rows, "p string, t timestamp, v double"), ["p"]).first()


@pytest.mark.parametrize("vs,name", [([100, 101, 100], "flat"), ([50, 100, 60], "crest"), ([50, 60, 100], "rising"), ([100, 60, 50], "receding"), ([97, 100, 60], "receding"), ([100, 50, 100], "rising")])
def test_hydrograph_shapes(spark, vs, name):
    assert shape(spark, vs).shape == name


def test_first_maximum_wins(spark):
    assert shape(spark, [5, 9, 9, 1]).crest_time == datetime(2024, 1, 1, 6)


def test_numbers_in_java_notation_are_refused(spark):
    df = spark.createDataFrame([(x,) for x in ("12f", "1d", "nan", "Infinity", " 7.5 ", "1e3", "", None)], "raw string")
    assert [r.v for r in df.select(values.number(F.col("raw")).alias("v")).collect()] == [None, None, None, None, 7.5, 1000.0, None, None]


def test_category_with_missing_levels(spark):
    lv = {"action": F.lit(None).cast("double"), "minor": F.lit(10.0), "moderate": F.lit(None).cast("double"), "major": F.lit(30.0)}
    got = [spark.range(1).select(flood.category(F.lit(float(v)), lv)).first()[0] for v in (5, 10, 29, 30)]
    assert got == ["none", "minor", "minor", "major"]
    none = {c: F.lit(None).cast("double") for c in flood.CATEGORIES}
    assert spark.range(1).select(flood.category(F.lit(1.0), none)).first()[0] == "unknown"


def test_confidence_floor(spark):
    got = [spark.range(1).select(bands.one_level_down(F.lit(x))).first()[0] for x in ("high", "moderate", "low", "unknown")]
    assert got == ["moderate", "low", "low", "low"]

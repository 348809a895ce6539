"""Window, ranking and time-series functions."""

from pyspark.sql import Window as W, functions as F

from fluvion.catalog.aggregates import daily
from fluvion.catalog.expressions import T, now
from fluvion.catalog.joins import KEY
from fluvion.catalog.registry import BINDINGS, query
from fluvion.functions import clocks
from fluvion.operators import agreement, doy, joins, running, selection, snow, trend
from fluvion.session import staged

BINDINGS["b_wpt"] = """SELECT a.station, a.t, a.v AS last_v, b.t AS bt, (epoch(b.t) - epoch(TIMESTAMP '2024-01-01')) / 3600.0::DOUBLE AS x, b.v AS y,
  (epoch(b.t) - epoch(lag(b.t) OVER (PARTITION BY a.station, a.t ORDER BY b.t))) / 3600.0::DOUBLE AS gap
  FROM b_fast a JOIN b_fast b ON b.station = a.station AND b.t BETWEEN a.t - INTERVAL 6 HOUR AND a.t"""
BINDINGS["b_w"] = """SELECT station, t, any_value(last_v) AS last_v, count(*) AS n, max(x) - min(x) AS span_h, coalesce(max(gap), 0) AS max_gap_h,
  (arg_max(y, x) - arg_min(y, x)) / nullif(max(x) - min(x), 0) AS endpoint, regr_slope(y, x) AS ols FROM b_wpt GROUP BY ALL"""
BINDINGS["b_ok"] = "SELECT * FROM b_w WHERE n >= 3 AND max_gap_h <= 2 AND span_h >= 3"
BINDINGS["b_pair"] = """SELECT p.station, p.t, p.x AS xi, (q.y - p.y) / (q.x - p.x) AS s, q.x > p.x AS upper FROM b_wpt p JOIN b_wpt q ON q.station = p.station AND q.t = p.t AND q.x <> p.x JOIN b_ok o ON o.station = p.station AND o.t = p.t"""
BINDINGS["b_ts"] = "SELECT station, t, quantile_cont(s, [0.25, 0.5, 0.75]) AS q FROM b_pair WHERE upper GROUP BY ALL"
BINDINGS["b_rm"] = "SELECT station, t, median(m) AS slope FROM (SELECT station, t, xi, median(s) AS m FROM b_pair GROUP BY ALL) GROUP BY ALL"


def windows(t):
    return trend.trailing_windows(t.fast_series())


def flow():
    return F.lit("flow")


@query(
    "F1_best_revision",
    """SELECT station, variable, CAST(valid_time AS VARCHAR) AS valid_time, id, value FROM b_obs QUALIFY row_number() OVER (PARTITION BY station, variable, valid_time ORDER BY revision_seq DESC, id DESC) = 1""",
)
def f1(t):
    return selection.newest(t.observations(True), KEY, [F.desc("revision_seq"), F.desc("id")]).select(*KEY, "id", "value")


@query(
    "F2_latest_runs",
    """SELECT fp, run_id, CAST(issued_at AS VARCHAR) AS issued_at FROM b_run WHERE available_at <= TIMESTAMP '2000-06-01' AND product <> '5-LOW' QUALIFY row_number() OVER (PARTITION BY fp ORDER BY issued_at DESC, run_id DESC) = 1""",
)
def f2(t):
    runs = selection.as_known_at(t.forecast_runs(), "2000-06-01").filter("product <> '5-LOW'")
    return selection.newest(runs, ["fp"], [F.desc("issued_at"), F.desc("run_id")]).select("fp", "run_id", "issued_at")


@query(
    "F3_latest_feature",
    f"""SELECT feature, scope, CAST(valid_time AS VARCHAR) AS valid_time, value FROM b_feat WHERE available_at <= TIMESTAMP '{T}' AND valid_time >= TIMESTAMP '{T}' - INTERVAL 5 DAY QUALIFY row_number() OVER (PARTITION BY feature, scope ORDER BY valid_time DESC, available_at DESC, id DESC) = 1""",
)
def f3(t):
    rows = selection.as_known_at(t.derived_features(), T).filter(F.col("valid_time") >= clocks.plus_hours(now(), -120))
    order = [F.desc("valid_time"), F.desc("available_at"), F.desc("id")]
    return selection.newest(rows, ["feature", "scope"], order).select("feature", "scope", "valid_time", "value")


@query(
    "F4_latest_thresholds",
    """SELECT o_custkey AS fp, o_orderkey % 4 AS category, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01' GROUP BY ALL""",
)
def f4(t):
    rows = t.read("orders").withColumn("effective_from", F.col("o_orderdate").cast("timestamp")).filter(F.col("effective_from") <= F.lit("2000-01-01").cast("timestamp"))
    return rows.groupBy(F.col("o_custkey").alias("fp"), (F.col("o_orderkey") % 4).alias("category")).agg(
        F.max(F.struct("effective_from", F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))).alias("m")
    ).select("fp", "category", "m.value", "m.id")


@query("F5_trailing_windows", "SELECT station, CAST(t AS VARCHAR) AS t, CAST(n AS INTEGER) AS n, round(span_h, 6) AS span_h, round(max_gap_h, 6) AS max_gap_h FROM b_ok")
def f5(t):
    return trend.admissible(windows(t)).select("station", "t", "n", "span_h", "max_gap_h")


@query(
    "F6_endpoint_rate",
    """SELECT station, CAST(t AS VARCHAR) AS t, CASE WHEN n < 2 THEN 'INSUFFICIENT_OBSERVATIONS' WHEN max_gap_h > 2 THEN 'GAP_EXCEEDS_TOLERANCE' WHEN span_h < 3 THEN 'SPAN_BELOW_MINIMUM' ELSE 'ok' END AS refusal,
      round(CASE WHEN n >= 2 AND max_gap_h <= 2 AND span_h >= 3 THEN endpoint END, 6) AS rate FROM b_w""",
)
def f6(t):
    return trend.endpoint_rate(windows(t), flow()).select("station", "t", "refusal", "rate")


@query("F7_ols_slope", "SELECT station, CAST(t AS VARCHAR) AS t, round(ols, 6) AS slope FROM b_ok")
def f7(t):
    return trend.slopes(windows(t), ("ols",)).select("station", "t", F.col("ols_slope").alias("slope"))


@query("F8_theil_sen_slope", "SELECT station, CAST(t AS VARCHAR) AS t, round(q[2], 6) AS slope FROM b_ts")
def f8(t):
    return trend.slopes(windows(t), ("theil_sen",)).select("station", "t", F.col("theil_sen_slope").alias("slope"))


@query("F9_repeated_median_slope", "SELECT station, CAST(t AS VARCHAR) AS t, round(slope, 6) AS slope FROM b_rm")
def f9(t):
    return trend.slopes(windows(t), ("repeated_median",)).select("station", "t", F.col("repeated_median_slope").alias("slope"))


@query("F10_slope_spread", "SELECT station, CAST(t AS VARCHAR) AS t, round(q[1], 6) AS q25, round(q[2], 6) AS q50, round(q[3], 6) AS q75 FROM b_ts")
def f10(t):
    from fluvion.functions.arrays import slope_spread

    w = trend.admissible(windows(t)).withColumn("s", slope_spread(F.col("pts")))
    return w.select("station", "t", "s.q25", "s.q50", "s.q75")


def tidal_class():
    return F.when(F.col("station") < 7, "FLUVIAL").when(F.col("station") < 9, "TIDAL")


TREND_SQL = """(SELECT w.station, w.t, w.n, CASE WHEN w.station IN (7, 8) THEN 'TIDAL_CONTAMINATION' WHEN w.station = 9 THEN 'TIDAL_CLASS_UNVERIFIED' WHEN w.n < 3 THEN 'INSUFFICIENT_OBSERVATIONS' WHEN w.max_gap_h > 2 THEN 'GAP_EXCEEDS_TOLERANCE' WHEN w.span_h < 3 THEN 'SPAN_BELOW_MINIMUM' ELSE 'ok' END AS refusal,
    CASE WHEN w.station < 7 THEN r.slope END AS slope, q, greatest(1.0, abs(w.last_v) * 0.01::DOUBLE) AS eps, greatest(3, floor(w.span_h / 0.25)) AS expected FROM b_w w LEFT JOIN b_rm r USING (station, t) LEFT JOIN b_ts s USING (station, t))"""


@query(
    "F11_full_trend",
    f"""SELECT station, CAST(t AS VARCHAR) AS t, refusal, round(slope, 6) AS slope, CASE WHEN slope IS NULL THEN 'unknown' WHEN abs(slope) <= eps THEN 'steady' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction,
      CASE WHEN slope IS NULL THEN NULL WHEN n < expected * 0.75 THEN 'SPARSE_SUPPORT' WHEN abs(slope) > 0 AND q[3] - q[1] > 2 * abs(slope) THEN 'WIDE_SLOPE_SPREAD' ELSE 'OK' END AS quality FROM {TREND_SQL}""",
)
def f11(t):
    return trend.estimate(windows(t), tidal_class(), flow()).select("station", "t", "refusal", "slope", "direction", "quality")


@query(
    "E25_estimator_jitter",
    """WITH s AS (SELECT station, t, slope, last_v, CASE WHEN abs(slope) <= greatest(1.0, abs(last_v) * 0.01::DOUBLE) THEN 'steady' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS d FROM b_rm JOIN b_ok USING (station, t)),
      j AS (SELECT station, abs(slope - lag(slope) OVER w) / greatest(abs(last_v), 1e-9) AS step, d, lag(d) OVER w AS pd FROM s WINDOW w AS (PARTITION BY station ORDER BY t))
      SELECT station, count(*) AS windows, round(median(step), 6) AS median_step, round(quantile_cont(step, 0.95), 6) AS p95_step, count_if(coalesce(d <> pd AND d <> 'steady' AND pd <> 'steady', false)) AS flips FROM j GROUP BY ALL""",
)
def e25(t):
    j = trend.jitter(trend.slopes(windows(t), ("repeated_median",)), "repeated_median", flow())
    return j.groupBy("station").agg(
        F.count(F.lit(1)).alias("windows"), F.percentile("step", 0.5).alias("median_step"), F.percentile("step", 0.95).alias("p95_step"), F.count_if("flip").alias("flips")
    )


@query(
    "F12_forecast_crest",
    """SELECT run_id, max(flow) AS crest, CAST(arg_min(valid_time, (-flow, valid_time)) AS VARCHAR) AS crest_time FROM b_val WHERE valid_time > issued_at + INTERVAL 18 HOUR - INTERVAL 6 HOUR AND valid_time <= issued_at + INTERVAL 18 HOUR + INTERVAL 72 HOUR GROUP BY ALL""",
)
def f12(t):
    from fluvion.operators import hydrograph

    return hydrograph.crests(t.run_values().withColumn("as_of", clocks.plus_hours(F.col("issued_at"), 18)), ["run_id"], "flow")


@query(
    "F13_hydrograph_shape",
    """WITH p AS (SELECT run_id, valid_time AS t, max(flow) AS v FROM b_val GROUP BY ALL), s AS (SELECT *, (epoch(t) - epoch(lag(t) OVER (PARTITION BY run_id ORDER BY t))) / 3600.0::DOUBLE AS st FROM p),
      g AS (SELECT run_id, count(*) AS n, max(v) AS crest, arg_min(t, (-v, t)) AS ct, min(v) AS low, arg_min(v, t) AS fv, arg_max(v, t) AS lv, min(t) AS t0, max(t) AS t1, min(st) AS step_h FROM s GROUP BY ALL)
      SELECT run_id, n, crest, CAST(ct AS VARCHAR) AS crest_time, ct > t0 AND ct < t1 AS interior, round((crest - greatest(fv, lv)) / crest, 6) AS prominence, round((crest - low) / crest, 6) AS amplitude, step_h,
        CASE WHEN (crest - low) / crest < 0.05 THEN 'flat' WHEN ct > t0 AND ct < t1 AND (crest - greatest(fv, lv)) / crest >= 0.05 THEN 'crest' WHEN lv >= fv THEN 'rising' ELSE 'receding' END AS shape FROM g""",
)
def f13(t):
    p = t.run_values().groupBy("run_id", F.col("valid_time").alias("t")).agg(F.max("flow").alias("v"))
    return agreement.hydrographs(p, ["run_id"])


@query(
    "F14_median_member",
    """WITH m AS (SELECT run_id, member, max(flow) AS crest, arg_min(valid_time, (-flow, valid_time)) AS crest_time FROM b_val GROUP BY ALL)
      SELECT run_id, member, crest, member_count FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS member_count, row_number() OVER (PARTITION BY run_id ORDER BY crest, crest_time, member) AS pos FROM m) WHERE pos = (member_count - 1) // 2 + 1""",
)
def f14(t):
    m = t.run_values().groupBy("run_id", "member").agg(F.max(F.struct("flow", (-F.unix_micros("valid_time")).alias("k"))).alias("p"))
    m = m.select("run_id", "member", F.col("p.flow").alias("crest"), F.timestamp_micros(-F.col("p.k")).alias("crest_time"))
    return agreement.median_member(m, ["run_id"]).select("run_id", "member", "crest", "member_count")


@query(
    "F15_comparison_window",
    """SELECT run_id, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end", round(greatest((epoch(e) - epoch(s)) / 3600.0::DOUBLE, 0), 6) AS shared_h, round(greatest((epoch(h1) - epoch(e)) / 3600.0::DOUBLE, 0), 6) AS lost_tail_h, (epoch(as_of) - epoch(issued_at)) / 3600.0::DOUBLE AS cycle_age_h FROM (
      SELECT *, greatest(as_of - INTERVAL 6 HOUR, issued_at) AS s, least(as_of + INTERVAL 72 HOUR, issued_at + to_hours(CAST(24 + run_id % 90 AS INTEGER))) AS e, as_of + INTERVAL 72 HOUR AS h1 FROM (SELECT *, issued_at + to_hours(CAST(run_id % 40 AS INTEGER)) AS as_of FROM b_run))""",
)
def f15(t):
    r = t.forecast_runs().withColumn("as_of", clocks.plus_hours(F.col("issued_at"), F.col("run_id") % 40))
    w = agreement.comparison_window(F.col("as_of"), F.col("issued_at"), F.lit(24) + F.col("run_id") % 90)
    return r.withColumn("w", w).select("run_id", "w.*")


@query(
    "F16_window_rank",
    """WITH d AS (SELECT site, day, doy AS key, value FROM (SELECT DISTINCT site, day, doy, value FROM b_win)), k AS (SELECT t.site, (t.doy + o + 366) % 366 AS key, t.value FROM b_tail t, (VALUES (-2), (-1), (0), (1), (2)) AS w(o)),
      r AS (SELECT d.site, d.day, count(k.value) + 1 AS rank FROM d JOIN b_ctx c ON c.site = d.site AND c.key = d.key AND d.value >= c.tail_floor LEFT JOIN k ON k.site = d.site AND k.key = d.key AND k.value > d.value GROUP BY ALL)
      SELECT d.site, CAST(d.day AS VARCHAR) AS day, CAST(r.rank AS INTEGER) AS rank, c.n + 1 AS rank_of, coalesce(d.value > c.maximum, false) AS exceeds_record, coalesce(c.tail_years < 5, false) AS thin_tail,
        CASE WHEN c.n IS NULL THEN 'no_record_context' WHEN d.value < c.tail_floor THEN 'below_tail_floor' ELSE 'ok' END AS reason
      FROM d LEFT JOIN b_ctx c ON c.site = d.site AND c.key = d.key LEFT JOIN r ON r.site = d.site AND r.day = d.day""",
)
def f16(t):
    d = staged(daily(t), "daily")
    ctx = staged(doy.record_context(d), "record-context")
    out = doy.window_rank(d.select("site", "day", F.col("doy").alias("key"), "value"), ctx, doy.record_tail(d, ctx))
    return out.select("site", "day", "rank", "rank_of", "exceeds_record", "thin_tail", "reason")


@query(
    "F17_growth_rank",
    """WITH c AS (SELECT a.site, a.day, round(a.value / b.value, 4) AS g FROM b_day a JOIN b_day b ON b.site = a.site AND b.day = a.day - 1 WHERE a.value > 0 AND b.value > 0), f AS (SELECT site, min(growth) AS floor, any_value(n) AS n FROM b_growth GROUP BY ALL)
      SELECT c.site, CAST(c.day AS VARCHAR) AS day, CASE WHEN c.g >= f.floor THEN CAST((SELECT count(*) FROM b_growth x WHERE x.site = c.site AND x.growth > c.g) + 1 AS INTEGER) END AS growth_rank, f.n AS growth_rank_of, CASE WHEN c.g < f.floor THEN 'outside_stored_decile' ELSE 'ok' END AS growth_reason FROM c JOIN f ON f.site = c.site""",
)
def f17(t):
    d = daily(t)
    changes = doy.growth_ratios(d, 24).select("site", "day", "growth")
    return doy.growth_rank(changes, doy.growth_reference(d, 24)).drop("growth")


def pct_case(v):
    steps = [(5, "p05"), (10, "p10"), (25, "p25"), (50, "p50"), (75, "p75"), (90, "p90"), (95, "p95")]
    mid = " ".join(
        f"WHEN {v} BETWEEN {a} AND {b} THEN CASE WHEN {a} = {b} THEN {q}.0 ELSE {p} + ({v} - {a}) / ({b} - {a}) * {q - p} END" for (p, a), (q, b) in zip(steps, steps[1:])
    )
    return f"CASE WHEN p05 IS NULL THEN NULL WHEN {v} <= p05 THEN 5.0 WHEN {v} >= p95 THEN 95.0 {mid} END::DOUBLE"


@query(
    "F18_percentile_of",
    f"""SELECT w.site, CAST(w.day AS VARCHAR) AS day, round({pct_case('w.value')}, 6) AS percentile, coalesce(w.value < p05 OR w.value > p95, false) AS outside FROM (SELECT DISTINCT site, day, doy, value FROM b_win) w LEFT JOIN b_lad l ON l.site = w.site AND l.key = w.doy""",
)
def f18(t):
    d = daily(t)
    lad = doy.ladder(d).withColumnRenamed("key", "doy")
    j = d.join(lad, ["site", "doy"], "left")
    ok = doy.monotone()
    return j.select(
        "site", "day", F.when(ok, doy.percentile_of(F.col("value"))).alias("percentile"), F.coalesce(doy.outside_range(F.col("value")), F.lit(False)).alias("outside")
    )


@query(
    "F19_latest_daily_percentile",
    f"""WITH a AS (SELECT site, max(day) AS day FROM b_day GROUP BY ALL), v AS (SELECT DISTINCT w.site, w.day, w.doy, w.value FROM b_win w JOIN a ON a.site = w.site AND a.day = w.day),
      pub AS (SELECT site, key, quantile_cont(value, 0.5) AS pub50 FROM b_win WHERE year(day) >= 1998 GROUP BY ALL)
      SELECT v.site, CAST(v.day AS VARCHAR) AS day, round({pct_case('v.value')}, 1) AS percentile, round((l.p50 - pub50) / pub50, 6) AS disagreement, abs((l.p50 - pub50) / pub50) > 0.1 AS disagrees FROM v LEFT JOIN b_lad l ON l.site = v.site AND l.key = v.doy LEFT JOIN pub ON pub.site = v.site AND pub.key = v.doy""",
)
def f19(t):
    from fluvion.plans import climatology

    d = daily(t)
    newer = doy_medians(d.filter(F.year("day") >= 1998))
    return climatology.latest_percentile(d, doy.ladder(d), newer)


def doy_medians(d):
    w = joins.doy_windows(d)
    return w.groupBy("site", "key").agg(F.percentile("value", 0.5).alias("published_p50"))


VINTAGE_SQL = """(SELECT y AS vintage, site, key, count(*) AS n, quantile_cont(value, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q FROM b_win, (VALUES (1998), (2000)) AS v(y) WHERE year(day) < y GROUP BY ALL HAVING count(*) >= 10)"""


@query(
    "F20_percentile_in_its_vintage",
    f"""WITH l AS (SELECT vintage, site, key, q[1] AS p05, q[2] AS p10, q[3] AS p25, q[4] AS p50, q[5] AS p75, q[6] AS p90, q[7] AS p95 FROM {VINTAGE_SQL}), d AS (SELECT DISTINCT site, day, doy, value FROM b_win WHERE year(day) >= 1998)
      SELECT d.site, CAST(d.day AS VARCHAR) AS day, CASE WHEN year(d.day) >= 2000 THEN 2000 ELSE 1998 END AS vintage, round({pct_case('d.value')}, 6) AS percentile FROM d LEFT JOIN l ON l.site = d.site AND l.key = d.doy AND l.vintage = CASE WHEN year(d.day) >= 2000 THEN 2000 ELSE 1998 END""",
)
def f20(t):
    from fluvion.plans import climatology

    d = daily(t)
    return climatology.percentile_in_vintage(d, (1998, 2000)).select("site", "day", "vintage", "percentile")


@query(
    "F21_vintage_sensitivity",
    f"""WITH l AS (SELECT vintage, site, key, q[1] AS p05, q[2] AS p10, q[3] AS p25, q[4] AS p50, q[5] AS p75, q[6] AS p90, q[7] AS p95 FROM {VINTAGE_SQL}), d AS (SELECT DISTINCT site, day, doy, value FROM b_win WHERE year(day) >= 2000),
      r AS (SELECT d.site, l.vintage, min(CASE WHEN {pct_case('d.value')} >= 90 THEN d.day END) AS first_top FROM d JOIN l ON l.site = d.site AND l.key = d.doy GROUP BY ALL)
      SELECT site, count(*) AS n_vintages, CAST(min(first_top) AS VARCHAR) AS earliest, CAST(max(first_top) AS VARCHAR) AS latest, count(DISTINCT first_top) > 1 AS moves FROM r GROUP BY ALL""",
)
def f21(t):
    from fluvion.plans import climatology

    d = daily(t)
    return climatology.vintage_sensitivity(d, (1998, 2000), from_year=2000)


@query(
    "F22_observed_crest",
    """SELECT user_id % 10 AS station, max(value) AS crest, CAST(arg_min(ts, (-value, ts)) AS VARCHAR) AS crest_time FROM events GROUP BY ALL""",
)
def f22(t):
    best = F.max(F.struct("value", (-F.unix_micros("ts")).alias("k")))
    g = t.events().groupBy((F.col("user_id") % 10).alias("station")).agg(best.alias("b"))
    return g.select("station", F.col("b.value").alias("crest"), F.timestamp_micros(-F.col("b.k")).alias("crest_time"))


@query(
    "F23_visible_at_cursor",
    """SELECT fp, count(*) AS n_runs, arg_max(run_id, (issued_at, run_id)) AS current_run, CAST(max(issued_at) AS VARCHAR) AS issued_at FROM b_run WHERE product <> '5-LOW' AND issued_at <= TIMESTAMP '1999-03-15' GROUP BY ALL""",
)
def f23(t):
    runs = t.forecast_runs().filter((F.col("product") != "5-LOW") & (F.col("issued_at") <= F.lit("1999-03-15").cast("timestamp")))
    return runs.groupBy("fp").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max_by("run_id", F.struct("issued_at", "run_id")).alias("current_run"), F.max("issued_at").alias("issued_at")
    )


@query(
    "F24_segments",
    """WITH h AS (SELECT basin, valid_time AS t, value AS v FROM b_hour),
      s AS (SELECT *, sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY basin ORDER BY t) AS seg FROM h)
      SELECT basin, CAST(row_number() OVER (PARTITION BY basin ORDER BY min(t)) AS INTEGER) AS segment, count(*) AS n, CAST(min(t) AS VARCHAR) AS t0, CAST(max(t) AS VARCHAR) AS t1 FROM s WHERE v IS NOT NULL GROUP BY basin, seg""",
)
def f24(t):
    from fluvion.catalog.aggregates import basin_hours
    from fluvion.operators import hydrograph

    return hydrograph.segments(basin_hours(t).select("basin", F.col("valid_time").alias("t"), F.col("value").alias("v")), "basin")


@query(
    "F25_driver_ranks",
    """SELECT basin, feature, CAST(row_number() OVER (PARTITION BY basin ORDER BY surface, rank, feature) AS INTEGER) AS rank FROM (SELECT s_nationkey AS basin, s_suppkey % 3 AS surface, s_suppkey % 17 AS rank, s_name AS feature FROM supplier)""",
)
def f25(t):
    k = F.col("s_suppkey")
    d = t.read("supplier").select(F.col("s_nationkey").alias("basin"), (k % 3).alias("surface"), (k % 17).alias("rank"), F.col("s_name").alias("feature"))
    return running.numbered(d.withColumnRenamed("rank", "place"), ["basin"], ["surface", "place"], ["feature"], "rank").select("basin", "feature", "rank")


@query(
    "F26_minute_sequence",
    """SELECT event_id AS id, CAST(row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY event_type, event_id) - 1 AS INTEGER) AS seq FROM events""",
)
def f26(t):
    e = t.events().select(F.date_trunc("minute", "ts").alias("minute"), "event_type", F.shiftright(F.col("event_id").cast("long"), 16).alias("range"), F.col("event_id").alias("id"))
    return running.numbered(e, ["minute"], ["event_type", "range"], ["id"], "seq").select("id", (F.col("seq") - 1).alias("seq"))


@query(
    "F27_sustained_rise",
    """WITH d AS (SELECT station, t, coalesce(slope > greatest(1.0, abs(last_v) * 0.01::DOUBLE), false) AS up FROM b_rm JOIN b_ok USING (station, t)), g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY t) AS run FROM d),
      n AS (SELECT station, t, row_number() OVER (PARTITION BY station, run ORDER BY t) AS nth FROM g WHERE up), pk AS (SELECT station, arg_min(t, (-v, t)) AS peak FROM b_fast GROUP BY ALL)
      SELECT pk.station, CAST(min(CASE WHEN n.t < peak THEN n.t - INTERVAL 2 HOUR END) AS VARCHAR) AS first_rise, count(n.t) AS n_onsets, count_if(coalesce(n.t >= TIMESTAMP '2024-01-20', false)) AS n_late FROM pk LEFT JOIN n ON n.station = pk.station AND nth = 8 GROUP BY ALL""",
)
def f27(t):
    s = trend.slopes(windows(t), ("repeated_median",))
    d = s.select("station", "t", trend.direction(F.col("repeated_median_slope"), trend.steady_epsilon(flow(), F.col("last_v"))).alias("direction"))
    hits = trend.sustained(d, need=8)
    peak = F.max(F.struct("v", (-F.unix_micros("t")).alias("k")))
    peaks = t.fast_series().groupBy("station").agg(F.timestamp_micros(-peak["k"]).alias("peak"))
    j = peaks.join(hits, "station", "left")
    return j.groupBy("station").agg(
        F.min(F.when(F.col("t") < F.col("peak"), F.col("onset"))).alias("first_rise"), F.count("t").alias("n_onsets"),
        F.count_if(F.col("t") >= F.lit("2024-01-20").cast("timestamp")).alias("n_late"),
    )


@query(
    "F29_preferred_source",
    """WITH r AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, CASE l_linenumber % 4 WHEN 0 THEN 'RZ' WHEN 1 THEN 'RG' WHEN 2 THEN 'RR' ELSE 'ZZ' END AS code, max(l_quantity) AS v FROM lineitem GROUP BY ALL),
      c AS (SELECT *, row_number() OVER (PARTITION BY station, day ORDER BY CASE code WHEN 'RZ' THEN 0 WHEN 'RG' THEN 1 WHEN 'RR' THEN 2 ELSE 3 END, code) AS rn FROM r)
      SELECT station, CAST(day AS VARCHAR) AS day, max(CASE WHEN rn = 1 THEN code END) AS code, max(CASE WHEN rn = 1 THEN v END) AS value, greatest(max(v) - max(CASE WHEN rn = 1 THEN v END), max(CASE WHEN rn = 1 THEN v END) - min(v)) > 0.01 AS disagrees FROM c GROUP BY ALL""",
)
def f29(t):
    from fluvion.operators import reservoirs

    code = F.element_at(F.array(F.lit("RZ"), F.lit("RG"), F.lit("RR"), F.lit("ZZ")), F.col("l_linenumber") % 4 + 1)
    r = t.lineitem().groupBy(F.col("l_suppkey").alias("station"), "day", code.alias("code")).agg(F.max("l_quantity").alias("value"))
    return reservoirs.preferred_source(r, ["station", "day"])


@query(
    "F30_snow_signal",
    """WITH r AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, max(l_quantity) AS v FROM lineitem GROUP BY ALL), l AS (SELECT station, max(day) AS day, arg_max(v, day) AS v FROM r GROUP BY ALL),
      p AS (SELECT l.station, r.day, r.v FROM l JOIN r ON r.station = l.station AND r.day < l.day QUALIFY row_number() OVER (PARTITION BY l.station ORDER BY abs(r.day - (l.day - 7)), r.day) = 1)
      SELECT l.station, CAST(l.day AS VARCHAR) AS day, l.v AS value, CAST(p.day AS VARCHAR) AS prior_day, p.v AS prior, CASE WHEN p.v IS NULL THEN 'insufficient_history' WHEN abs(l.v - p.v) < 0.2 THEN 'holding' WHEN l.v > p.v THEN 'rising' ELSE 'melting' END AS trend,
        DATE '2001-10-20' - l.day > 3 AS stale, round(CASE WHEN DATE '2001-10-20' - l.day > 3 THEN greatest(0.3, b - 0.3) ELSE b END::DOUBLE, 6) AS confidence FROM (SELECT *, [0.85, 0.65, 0.45][CAST(station % 3 AS INTEGER) + 1] AS b FROM l) l LEFT JOIN p USING (station)""",
)
def f30(t):
    conf = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("station") % 3).cast("int") + 1)
    r = t.lineitem().groupBy(F.col("l_suppkey").alias("station"), "day").agg(F.max("l_quantity").alias("value")).withColumn("mapping_confidence", conf)
    return snow.prototype_signal(r, F.lit("2001-10-20").cast("date"))


@query(
    "F31_nearest_lead",
    """SELECT fp, run_id, lead, flow FROM b_val QUALIFY row_number() OVER (PARTITION BY fp ORDER BY issued_at DESC NULLS LAST, valid_time, run_id, part, flow) = 1""",
)
def f31(t):
    order = [F.desc_nulls_last("issued_at"), F.asc("valid_time"), F.asc("run_id"), F.asc("part"), F.asc("flow")]
    return selection.newest(t.run_values(), ["fp"], order).select("fp", "run_id", "lead", "flow")

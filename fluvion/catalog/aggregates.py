"""Aggregations."""

from pyspark.sql import functions as F

from fluvion.catalog.expressions import T, now, object_keys
from fluvion.catalog.joins import KEY, LEFT_SQL, RIGHT_SQL, river_paths, transports
from fluvion.catalog.registry import BINDINGS, query
from fluvion.functions import clocks, overlay, values
from fluvion.operators import doy, geometry, health, precipitation, snow

BINDINGS["b_win"] = """SELECT d.site, d.day, d.value, CASE WHEN month(d.day) >= 10 THEN year(d.day) + 1 ELSE year(d.day) END AS wy, (doy + o + 366) % 366 AS key, doy
  FROM (SELECT *, datediff('day', DATE '2000-01-01', make_date(2000, month(day), day(day))) AS doy FROM b_day) d, (VALUES (-2), (-1), (0), (1), (2)) AS w(o)"""
BINDINGS["b_lad"] = """SELECT site, key, n, q[1] AS p05, q[2] AS p10, q[3] AS p25, q[4] AS p50, q[5] AS p75, q[6] AS p90, q[7] AS p95 FROM (
  SELECT site, key, count(*) AS n, quantile_cont(value, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q FROM b_win GROUP BY ALL) WHERE n >= 10"""
BINDINGS["b_ctx"] = """SELECT w.site, w.key, any_value(f.n) AS n, count(DISTINCT wy) AS water_years, max(value) AS maximum, max(CASE WHEN value = f.top THEN day END) AS maximum_day,
  any_value(f.floor) AS tail_floor, count(DISTINCT CASE WHEN value > f.floor THEN wy END) AS tail_years FROM b_win w
  JOIN (SELECT site, key, count(*) AS n, max(value) AS top, quantile_cont(value, 0.9) AS floor FROM b_win GROUP BY ALL HAVING count(*) >= 10) f ON f.site = w.site AND f.key = w.key GROUP BY w.site, w.key"""
BINDINGS["b_tail"] = """SELECT w.site, w.day, w.doy, w.value, min(c.tail_floor) AS lowest_floor FROM b_win w JOIN b_ctx c ON c.site = w.site AND c.key = w.key GROUP BY w.site, w.day, w.doy, w.value HAVING w.value > min(c.tail_floor)"""


def ratio_sql(days):
    return f"(SELECT a.site, a.day, round(a.value / b.value, 4) AS growth FROM b_day a JOIN b_day b ON b.site = a.site AND b.day = a.day - {days} WHERE a.value > 0 AND b.value > 0)"


BINDINGS["b_growth"] = f"""SELECT * FROM (SELECT site, day, growth, count(*) OVER (PARTITION BY site) AS n, row_number() OVER (PARTITION BY site ORDER BY growth DESC, day DESC) AS rn FROM {ratio_sql(1)}) WHERE rn <= ceil(0.1::DOUBLE * n)"""

ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in doy.P.values())


def daily(t):
    return t.daily_key(t.daily_means())


@query("E1_doy_ladder", f"SELECT site, key, n, {ROUNDED} FROM b_lad")
def e1(t):
    return doy.ladder(daily(t)).withColumn("key", F.col("key").cast("long"))


@query(
    "E1_ladder_refusals",
    """WITH d AS (SELECT *, datediff('day', DATE '2000-01-01', make_date(2000, month(day), day(day))) AS doy FROM b_dayall), w AS (SELECT site, (doy + o + 366) % 366 AS key, value FROM d, (VALUES (-2), (-1), (0), (1), (2)) AS w(o)),
      g AS (SELECT site, key, count(*) AS n, quantile_cont(value, 0.5) AS p50 FROM w GROUP BY ALL)
      SELECT site, count_if(n >= 10) AS n_ladders, round(min(CASE WHEN n >= 10 THEN p50 END), 6) AS lowest_p50, round(max(CASE WHEN n >= 10 THEN p50 END), 6) AS highest_p50 FROM g GROUP BY ALL HAVING count_if(n >= 10) > 0""",
)
def e1b(t):
    lad = doy.ladder(t.daily_key(t.daily_means(None)))
    return lad.groupBy("site").agg(F.count(F.lit(1)).alias("n_ladders"), F.min("p50").alias("lowest_p50"), F.max("p50").alias("highest_p50"))


@query(
    "E2_record_support",
    "SELECT site, key, n, CAST(water_years AS INTEGER) AS water_years, round(maximum, 6) AS maximum, CAST(maximum_day AS VARCHAR) AS maximum_day, round(tail_floor, 6) AS tail_floor, CAST(tail_years AS INTEGER) AS tail_years FROM b_ctx",
)
def e2(t):
    return doy.record_context(daily(t)).withColumn("key", F.col("key").cast("long"))


@query("E3_record_tail", "SELECT site, CAST(day AS VARCHAR) AS day, round(value, 6) AS value, round(lowest_floor, 6) AS lowest_floor FROM b_tail")
def e3(t):
    d = daily(t)
    return doy.record_tail(d, doy.record_context(d)).select("site", "day", "value", "lowest_floor")


@query("E4_growth_reference", "SELECT site, 24 AS window_h, n, CAST(rn AS INTEGER) AS rn, growth FROM b_growth")
def e4(t):
    return doy.growth_reference(daily(t), 24)


@query(
    "E5_published_ladder",
    """SELECT site, count(*) AS n_keys, count_if(values_n = 0) AS n_without, min(first_year) AS begin_year, max(last_year) AS end_year, round(max(p50), 6) AS top_p50 FROM (
      SELECT l_suppkey AS site, month(l_shipdate) * 100 + day(l_shipdate) AS key, count(CASE WHEN l_quantity > 3 THEN 1 END) AS values_n,
      CAST(min(CASE WHEN l_quantity > 3 THEN year(l_shipdate) END) AS INTEGER) AS first_year, CAST(max(CASE WHEN l_quantity > 3 THEN year(l_shipdate) END) AS INTEGER) AS last_year,
      max(CASE WHEN l_linenumber % 7 = 3 AND l_quantity > 3 THEN l_quantity END) AS p50 FROM lineitem GROUP BY ALL) GROUP BY ALL""",
)
def e5(t):
    from fluvion.sources import gauges

    level = F.element_at(F.array(*[F.lit(x) for x in (10, 25, 50, 75, 90, 95, 5)]), F.col("l_linenumber"))
    rows = t.lineitem().select(
        F.col("l_suppkey").alias("site"), F.month("day").alias("month"), F.dayofmonth("day").alias("dom"), F.year("day").alias("year"),
        level.alias("level"), F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("value"),
    )
    lad = gauges.published_ladder(rows)
    return lad.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.size("ladder") == 0).alias("n_without"),
        F.min("begin_year").alias("begin_year"), F.max("end_year").alias("end_year"), F.max(F.try_element_at("ladder", F.lit(50))).alias("top_p50"),
    )


SNOW_SQL = """(SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, max(l_quantity) AS value, CASE WHEN min(l_linenumber) = 1 THEN NULL ELSE floor(max(l_extendedprice) / 10000) - 1 END AS median,
  CASE WHEN min(l_linenumber) = 2 THEN 'S' END AS qc FROM lineitem GROUP BY ALL)"""


def snow_readings(t):
    lead = F.min("l_linenumber")
    return t.lineitem().groupBy(F.col("l_suppkey").alias("station"), "day").agg(
        F.max("l_quantity").alias("value"),
        F.when(lead != 1, F.floor(F.max("l_extendedprice") / 10000).cast("double") - 1).alias("median"),
        F.when(lead == 2, "S").alias("qc_flag"),
    )


@query(
    "E6_swe_percent_of_median",
    f"""WITH r AS {SNOW_SQL}, s AS (SELECT s_suppkey AS station, s_nationkey AS basin FROM supplier), d AS (SELECT basin, max(day) AS day FROM r JOIN s USING (station) GROUP BY ALL),
      x AS (SELECT s.basin, d.day, r.value, r.median, CASE WHEN r.value IS NULL THEN 'no_value_on_day' WHEN r.qc = 'S' THEN 'suspect_flag' WHEN r.median IS NULL THEN 'median_absent' WHEN r.median <= 0 THEN 'median_zero' END AS cause
        FROM s JOIN d USING (basin) LEFT JOIN r ON r.station = s.station AND r.day = d.day)
      SELECT basin, CAST(day AS VARCHAR) AS day, count(*) AS n_mapped, count_if(cause IS NULL) AS n_used, round(avg(CASE WHEN cause IS NULL THEN 100.0::DOUBLE * value / median END), 1) AS value,
        count_if(coalesce(cause, '') = 'no_value_on_day') AS no_value_on_day, count_if(coalesce(cause, '') = 'suspect_flag') AS suspect_flag, count_if(coalesce(cause, '') = 'median_absent') AS median_absent, count_if(coalesce(cause, '') = 'median_zero') AS median_zero,
        CASE WHEN count_if(cause IS NULL) = 0 THEN 'no_usable_site' ELSE 'ok' END AS reason FROM x GROUP BY ALL""",
)
def e6(t):
    sites = t.stations().select("station", "basin")
    return snow.swe_percent_of_median(snow_readings(t), sites).drop("no_series").fillna("ok", ["reason"])


@query(
    "E7_precip_percent_of_median",
    f"""WITH r AS {SNOW_SQL}, s AS (SELECT s_suppkey AS station, s_nationkey AS basin FROM supplier), d AS (SELECT basin, max(day) AS day FROM r JOIN s USING (station) GROUP BY ALL),
      x AS (SELECT s.basin, d.day, a.value - b.value AS amount, a.median - b.median AS ref, CASE WHEN a.value IS NULL THEN 'no_value_on_day' WHEN b.value IS NULL THEN 'no_value_at_window_start' WHEN a.qc = 'S' OR b.qc = 'S' THEN 'suspect_flag'
        WHEN a.median IS NULL OR b.median IS NULL THEN 'median_absent' WHEN a.value - b.value < 0 OR a.median - b.median < 0 THEN 'water_year_rollover' WHEN a.median - b.median <= 0 THEN 'median_increment_zero' END AS cause
        FROM s JOIN d USING (basin) LEFT JOIN r a ON a.station = s.station AND a.day = d.day LEFT JOIN r b ON b.station = s.station AND b.day = d.day - 14)
      SELECT basin, count(*) AS n_mapped, count_if(cause IS NULL) AS n_used, round(avg(CASE WHEN cause IS NULL THEN 100.0::DOUBLE * amount / ref END), 1) AS value, count_if(coalesce(cause, '') = 'no_value_at_window_start') AS no_start,
        count_if(coalesce(cause, '') = 'water_year_rollover') AS rollover, count_if(coalesce(cause, '') = 'suspect_flag') AS suspect FROM x GROUP BY ALL""",
)
def e7(t):
    out = snow.precipitation_percent_of_median(snow_readings(t), t.stations().select("station", "basin"))
    return out.select("basin", "n_mapped", "n_used", "value", F.col("no_value_at_window_start").alias("no_start"), F.col("water_year_rollover").alias("rollover"), F.col("suspect_flag").alias("suspect"))


BINDINGS["b_hour"] = """SELECT basin, valid_time, CASE WHEN (hour(valid_time) + basin) % 7 <> 0 THEN v END AS value FROM (
  SELECT user_id % 6 AS basin, date_trunc('hour', ts) AS valid_time, max(value) AS v FROM events GROUP BY ALL)"""


def basin_hours(t):
    b, h = F.col("user_id") % 6, F.date_trunc("hour", "ts")
    g = t.events().groupBy(b.alias("basin"), h.alias("valid_time")).agg(F.max("value").alias("value"))
    return g.withColumn("value", F.when((F.hour("valid_time") + F.col("basin")) % 7 != 0, F.col("value")))


@query(
    "E8_trailing_totals",
    """WITH a AS (SELECT basin, max(valid_time) AS window_end FROM b_hour GROUP BY ALL)
      SELECT basin, CAST(window_end AS VARCHAR) AS window_end, w AS window_h, round(sum(value), 3) AS total, CAST(count(value) AS INTEGER) AS hours_present, CAST(count(*) - count(value) AS INTEGER) AS hours_refused,
        CASE WHEN count(value) = 0 THEN 'all_hours_refused' WHEN count(value) < w AND count(*) > count(value) THEN 'hours_missing_and_refused' WHEN count(value) < w THEN 'hours_missing' ELSE 'complete' END AS reason
      FROM b_hour JOIN a USING (basin), (VALUES (6), (24), (72)) AS x(w) WHERE valid_time > window_end - to_hours(w) GROUP BY basin, window_end, w""",
)
def e8(t):
    return precipitation.trailing_totals(basin_hours(t), "basin").fillna("complete", ["reason"])


@query(
    "E13_member_exceedance",
    """WITH m AS (SELECT run_id, member, max(flow) AS crest FROM b_val GROUP BY ALL)
      SELECT run_id, count(*) AS members, count(DISTINCT crest) AS distinct_crests, CASE WHEN max(crest) >= 90000 THEN 'major' WHEN max(crest) >= 70000 THEN 'moderate' WHEN max(crest) >= 50000 THEN 'minor' ELSE 'action' END AS exceeds,
        CASE WHEN max(crest) >= 90000 THEN count_if(crest >= 90000) WHEN max(crest) >= 70000 THEN count_if(crest >= 70000) WHEN max(crest) >= 50000 THEN count_if(crest >= 50000) ELSE count_if(crest >= 30000) END AS exceeding FROM m GROUP BY ALL""",
)
def e13(t):
    from fluvion.operators import agreement

    members = t.run_values().groupBy("run_id", "member").agg(F.max("flow").alias("crest"))
    levels = {"action": 30000.0, "minor": 50000.0, "moderate": 70000.0, "major": 90000.0}
    return agreement.member_exceedance(members, ["run_id"], levels).drop("fraction")


ANCHOR_PARTS = """SELECT 'observation' AS kind, 0 AS rk, 'p' || event_id % 5 AS product, max(ts) AS v, max(ts) + INTERVAL 1 HOUR AS r FROM events GROUP BY ALL
  UNION ALL SELECT 'forecast_run', 1, 'p' || o_orderkey % 8, max(o_orderdate), max(o_orderdate) + INTERVAL 2 HOUR FROM orders GROUP BY ALL
  UNION ALL SELECT 'derived_feature', 2, 'p' || l_suppkey % 3, max(l_shipdate), max(l_shipdate) + INTERVAL 3 HOUR FROM lineitem GROUP BY ALL"""
FETCHED_SQL = "SELECT 'p' || doc_id % 12 AS product, TIMESTAMP '2024-01-01' + to_hours(CAST(max(doc_id) AS INTEGER)) AS f FROM documents GROUP BY ALL"


@query(
    "E14_freshness_anchors",
    f"""WITH v AS (SELECT product, max(v) AS v, max(r) AS r, string_agg(kind, '+' ORDER BY rk) AS kinds FROM ({ANCHOR_PARTS}) GROUP BY product), f AS ({FETCHED_SQL})
      SELECT product, CASE WHEN product IN ('p6', 'p11') AND f IS NOT NULL THEN concat_ws('+', kinds, 'raw_artifact') WHEN v.product IS NULL THEN 'raw_artifact' ELSE kinds END AS kind,
        CAST(CASE WHEN product IN ('p6', 'p11') THEN greatest(v, f) WHEN v IS NULL THEN f ELSE v END AS VARCHAR) AS valid_time,
        CAST(CASE WHEN product IN ('p6', 'p11') THEN greatest(r, f) WHEN v IS NULL THEN f ELSE r END AS VARCHAR) AS retrieved_at,
        CAST(CASE WHEN product = 'p9' THEN f ELSE v END AS VARCHAR) AS content_time
      FROM v FULL OUTER JOIN f USING (product) WHERE v.product IS NOT NULL OR product IN ('p6', 'p11', 'p9')""",
)
def e14(t):
    p = lambda c: F.concat(F.lit("p"), c.cast("string")).alias("product")
    later = lambda c, h: clocks.plus_hours(F.col(c), h).alias("retrieved_at")
    orders = t.forecast_runs()
    parts = [
        ("observation", t.events().select(p(F.col("event_id") % 5), F.col("ts").alias("value_time"), later("ts", 1))),
        ("forecast_run", orders.select(p(F.col("run_id") % 8), F.col("issued_at").alias("value_time"), later("issued_at", 2))),
        ("derived_feature", t.lineitem().withColumn("s", F.col("l_shipdate").cast("timestamp")).select(p(F.col("l_suppkey") % 3), F.col("s").alias("value_time"), later("s", 3))),
    ]
    at = clocks.plus_hours(F.lit("2024-01-01").cast("timestamp"), F.col("doc_id"))
    fetched = t.read("documents").select(p(F.col("doc_id") % 12), at.alias("value_time"), at.alias("retrieved_at"))
    return health.freshness_anchors(parts, fetched, ["p9"], ["p6", "p11"])


@query(
    "E15_latest_job_runs",
    """SELECT event_type AS job, CAST(max(ts) AS VARCHAR) AS last_run, CAST(max(CASE WHEN value > 10 THEN ts END) AS VARCHAR) AS last_ok, max_by(event_id, ts) AS last_run_id FROM events GROUP BY ALL""",
)
def e15(t):
    r = health.latest_runs(t.job_runs())
    return r.select("job", F.col("last.started_at").alias("last_run"), F.col("last_ok.started_at").alias("last_ok"), F.col("last.run_id").alias("last_run_id"))


def job_catalog(t):
    """Registered jobs: one per (event type, user group of ten), and one per nation that never runs."""
    jobs = t.events().select(F.col("event_type").alias("provider"), F.concat_ws(".", "event_type", (F.col("user_id") % 10)).alias("job"), (F.col("user_id") % 10).alias("k")).distinct()
    idle = t.basins().select(F.lit("idle").alias("provider"), F.concat(F.lit("idle."), F.col("basin").cast("string")).alias("job"), F.col("basin").cast("long").alias("k"))
    return jobs.unionByName(idle).select("job", "provider", (F.lit(900) * (F.col("k") + 1)).alias("cadence_s"))


def grouped_runs(t):
    return t.events().select(
        F.concat_ws(".", "event_type", (F.col("user_id") % 10)).alias("job"), F.col("ts").alias("started_at"), F.col("event_id").alias("run_id"), (F.col("value") > 40).alias("ok")
    )


STATE_SQL = f"""(SELECT c.job, c.provider, c.cadence_s, CASE WHEN l.job IS NULL THEN 'pending' WHEN NOT last_value_ok AND last_ok IS NULL THEN 'down' WHEN NOT last_value_ok AND age > greatest(86400, 4 * cadence_s) THEN 'down' WHEN NOT last_value_ok THEN 'failing'
    WHEN age > 4 * cadence_s THEN 'late' ELSE 'ok' END AS state, age AS age_s FROM (
    SELECT DISTINCT event_type || '.' || user_id % 10 AS job, event_type AS provider, 900 * (user_id % 10 + 1) AS cadence_s FROM events UNION ALL SELECT 'idle.' || n_nationkey, 'idle', 900 * (n_nationkey + 1) FROM nation) c
  LEFT JOIN (SELECT event_type || '.' || user_id % 10 AS job, arg_max(value > 40, ts) AS last_value_ok, max(CASE WHEN value > 40 THEN ts END) AS last_ok,
    CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', max(CASE WHEN value > 40 THEN ts END))) AS BIGINT) AS age FROM events GROUP BY ALL) l USING (job))"""


def states(t):
    return health.job_states(job_catalog(t), health.latest_runs(grouped_runs(t)), F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("E16_job_states", f"SELECT job, provider, cadence_s, state, age_s FROM {STATE_SQL}")
def e16(t):
    return states(t).drop("reason")


@query(
    "E16_provider_states",
    f"""SELECT provider, CASE max(CASE state WHEN 'ok' THEN 0 WHEN 'pending' THEN 1 WHEN 'down' THEN 3 ELSE 2 END) WHEN 0 THEN 'healthy' WHEN 1 THEN 'unknown' WHEN 2 THEN 'degraded' ELSE 'down' END AS state, count(*) AS n_jobs FROM {STATE_SQL} GROUP BY ALL""",
)
def e16b(t):
    return health.provider_states(states(t))


@query(
    "E16_overall_status",
    f"""SELECT count_if(state IN ('late', 'failing', 'down')) AS n_alarming, count_if(state = 'pending') AS n_unknown, CASE WHEN count_if(state IN ('late', 'failing', 'down')) > 0 THEN 'degraded' WHEN count_if(state = 'pending') > 0 THEN 'unknown' ELSE 'ok' END AS status FROM {STATE_SQL}""",
)
def e16c(t):
    jobs = states(t)
    return health.overall(jobs, jobs.select(F.lit("current").alias("state")))


@query(
    "E17_metric_list",
    f"""SELECT metric, label, value FROM (SELECT 'job_age_seconds' AS metric, job AS label, CAST(age_s AS DOUBLE) AS value FROM {STATE_SQL} WHERE age_s IS NOT NULL
      UNION ALL SELECT 'job_ok', job, CASE WHEN state = 'ok' THEN 1.0 ELSE 0.0 END::DOUBLE FROM {STATE_SQL} UNION ALL SELECT 'job_cadence_seconds', job, CAST(cadence_s AS DOUBLE) FROM {STATE_SQL})""",
)
def e17(t):
    wide = states(t).select(
        F.col("job").alias("label"), F.col("age_s").cast("double").alias("job_age_seconds"),
        (F.col("state") == "ok").cast("double").alias("job_ok"), F.col("cadence_s").cast("double").alias("job_cadence_seconds"),
    )
    names = ["job_age_seconds", "job_ok", "job_cadence_seconds"]
    return wide.unpivot("label", names, "metric", "value").filter("value IS NOT NULL")


@query(
    "E21_approval_census",
    """SELECT site, count(*) AS n, count_if(approval = 'Approved') AS n_approved, CAST(max(CASE WHEN approval = 'Approved' THEN day END) AS VARCHAR) AS last_approved FROM b_rows WHERE day BETWEEN DATE '1997-01-01' AND DATE '2000-06-30' GROUP BY ALL""",
)
def e21(t):
    a = F.col("approval") == "Approved"
    return t.daily_rows().filter(F.col("day").between("1997-01-01", "2000-06-30")).groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a).alias("n_approved"), F.max(F.when(a, F.col("day"))).alias("last_approved")
    )


@query(
    "E22_object_inventory",
    """SELECT CAST(month AS VARCHAR) AS month, product, kind, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(min(m) AS VARCHAR) AS first_modified, CAST(max(m) AS VARCHAR) AS last_modified FROM (
      SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag AS product, CAST(l_shipdate AS DATE) AS m, CAST(l_quantity AS BIGINT) * 1000 AS bytes,
      CASE l_suppkey % 7 WHEN 0 THEN 'channel_rt' WHEN 1 THEN 'land' WHEN 2 THEN 'reservoir' WHEN 3 THEN 'terrain_rt' WHEN 4 THEN 'forcing' WHEN 5 THEN 'channel_rt' ELSE 'other' END AS kind FROM lineitem) GROUP BY ROLLUP (month, product, kind)""",
)
def e22(t):
    return (
        object_keys(t)
        .rollup(F.trunc("day", "month").alias("month"), F.col("l_returnflag").alias("product"), overlay.object_kind(F.col("key")).alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("files"), F.sum(F.col("l_quantity").cast("long") * 1000).alias("bytes"),
            F.min("day").alias("first_modified"), F.max("day").alias("last_modified"),
        )
    )


@query(
    "E22_missing_days",
    """WITH s AS (SELECT l_suppkey AS site, min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem GROUP BY ALL), c AS (SELECT site, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM s)
      SELECT site, count(*) AS n_missing, CAST(min(day) AS VARCHAR) AS first_missing FROM c ANTI JOIN (SELECT DISTINCT l_suppkey AS site, CAST(l_shipdate AS DATE) AS day FROM lineitem) h USING (site, day) GROUP BY ALL""",
)
def e22b(t):
    have = t.lineitem().select(F.col("l_suppkey").alias("site"), "day").distinct()
    span = have.groupBy("site").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = span.select("site", F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(have, ["site", "day"], "left_anti").groupBy("site").agg(F.count(F.lit(1)).alias("n_missing"), F.min("day").alias("first_missing"))


@query(
    "E23_transport_counts",
    f"""SELECT coalesce(l.station, r.station) AS station, coalesce(l.variable, r.variable) AS variable, count(l.station) AS n_left, count(r.station) AS n_right, count_if(l.station IS NOT NULL AND r.station IS NOT NULL) AS n_both,
      round((epoch(max(r.valid_time)) - epoch(max(l.valid_time))) / 60.0::DOUBLE, 1) AS lead_minutes
      FROM {LEFT_SQL} l FULL OUTER JOIN {RIGHT_SQL} r ON l.station = r.station AND l.variable = r.variable AND l.valid_time = r.valid_time GROUP BY ALL""",
)
def e23(t):
    left, right = transports(t)
    sides = left.select(*KEY, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*KEY, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = sides.groupBy(*KEY).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    newest = lambda c: F.max(F.when(F.col(c) == 1, F.col("valid_time")))
    return per.groupBy("station", "variable").agg(
        F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_both"),
        F.round(clocks.hours_between(newest("r"), newest("l")) * 60, 1).alias("lead_minutes"),
    )


@query(
    "E24_tail_representation",
    """WITH q AS (SELECT site, key, count(*) AS n, quantile_cont(value, [0.95, 0.96, 0.97, 0.98, 0.99]) AS q FROM b_win GROUP BY ALL HAVING count(*) >= 10)
      SELECT w.site, w.key, any_value(n) AS n, round(any_value(q[1]), 6) AS p95, round(any_value(q[5]), 6) AS p99, CAST(count_if(value > q[2]) AS INTEGER) AS above_96, CAST(count_if(value > q[5]) AS INTEGER) AS above_99, count_if(value > q[2]) >= 5 AS resolvable_96
      FROM b_win w JOIN q ON q.site = w.site AND q.key = w.key GROUP BY w.site, w.key""",
)
def e24(t):
    s = doy.tail_support(daily(t))
    return s.select("site", F.col("key").cast("long").alias("key"), "n", "p95", "p99", "above_96", "above_99", (F.col("above_96") >= doy.TAIL_MIN_EXCEEDANCES).alias("resolvable_96"))


@query(
    "E24_clamped_stretch",
    """WITH q AS (SELECT site, key, quantile_cont(value, 0.95) AS p95 FROM b_win GROUP BY ALL HAVING count(*) >= 10), d AS (SELECT DISTINCT site, day, doy, value FROM b_win),
      r AS (SELECT d.site, d.day, d.value, any_value(q.p95) AS p95, count_if(w.value > d.value) + 1 AS rank_from_top FROM d JOIN q ON q.site = d.site AND q.key = d.doy JOIN b_win w ON w.site = d.site AND w.key = d.doy GROUP BY d.site, d.day, d.value HAVING d.value >= any_value(q.p95))
      SELECT site, count(*) AS n_days, round(min(value), 6) AS min_flow, round(max(value), 6) AS max_flow, count(DISTINCT rank_from_top) AS n_ranks, count(DISTINCT round(value / p95, 4)) AS n_ratios FROM r GROUP BY ALL""",
)
def e24b(t):
    d = daily(t)
    s = doy.tail_support(d).select("site", F.col("key").alias("doy"), "v", "p95")
    clamped = d.join(s, ["site", "doy"]).filter(F.col("value") >= F.col("p95")).select(
        "site", "value", (F.size(F.filter("v", lambda x: x > F.col("value"))) + 1).alias("rank"), F.round(F.col("value") / F.col("p95"), 4).alias("ratio")
    )
    return clamped.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("value").alias("min_flow"), F.max("value").alias("max_flow"),
        F.countDistinct("rank").alias("n_ranks"), F.countDistinct("ratio").alias("n_ratios"),
    )


@query(
    "E26_threshold_set",
    """WITH r AS (SELECT o_custkey AS fp, ['action', 'minor', 'moderate', 'major'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS category, CASE WHEN o_orderkey % 11 = 0 THEN 'flow' ELSE 'stage' END AS basis, o_totalprice AS v, o_orderkey FROM orders)
      SELECT fp, count(DISTINCT basis) = 1 AS usable, CASE WHEN count(DISTINCT basis) = 1 THEN arg_max(v, o_orderkey) FILTER (WHERE category = 'action') END AS action, CASE WHEN count(DISTINCT basis) = 1 THEN arg_max(v, o_orderkey) FILTER (WHERE category = 'minor') END AS minor,
      CASE WHEN count(DISTINCT basis) = 1 THEN arg_max(v, o_orderkey) FILTER (WHERE category = 'moderate') END AS moderate, CASE WHEN count(DISTINCT basis) = 1 THEN arg_max(v, o_orderkey) FILTER (WHERE category = 'major') END AS major FROM r GROUP BY ALL""",
)
def e26(t):
    from fluvion.operators import thresholds

    k = F.col("o_orderkey")
    names = F.array(*[F.lit(c) for c in ("action", "minor", "moderate", "major")])
    rows = t.read("orders").select(
        F.col("o_custkey").alias("fp"), F.element_at(names, (k % 4).cast("int") + 1).alias("category"), F.when(k % 11 == 0, "flow").otherwise("stage").alias("basis"),
        F.lit("ft").alias("unit"), F.lit("NAVD88").alias("datum"), F.col("o_totalprice").alias("value"), k.alias("effective_from"), k.alias("id"),
    )
    return thresholds.threshold_set(rows, ["fp"]).select("fp", "usable", "action", "minor", "moderate", "major")


@query(
    "E27_extents",
    """SELECT user_id AS station, round(CASE WHEN lo = hi THEN lo - greatest(1, abs(lo) * 0.1::DOUBLE) ELSE lo - (hi - lo) * 0.06::DOUBLE END, 6) AS v_min, round(CASE WHEN lo = hi THEN hi + greatest(1, abs(lo) * 0.1::DOUBLE) ELSE hi + (hi - lo) * 0.06::DOUBLE END, 6) AS v_max,
      CAST(CASE WHEN t0 = t1 THEN t0 - INTERVAL 1 HOUR ELSE t0 END AS VARCHAR) AS t_min, CAST(CASE WHEN t0 = t1 THEN t1 + INTERVAL 1 HOUR ELSE t1 END AS VARCHAR) AS t_max FROM (
      SELECT user_id, least(min(value), 50.0) AS lo, greatest(max(value), 400.0) AS hi, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY ALL)""",
)
def e27(t):
    g = t.events().groupBy(F.col("user_id").alias("station")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    lo, hi = F.least("lo", F.lit(50.0)), F.greatest("hi", F.lit(400.0))
    pad = F.when(lo == hi, F.greatest(F.lit(1.0), F.abs(lo) * 0.1)).otherwise((hi - lo) * 0.06)
    same = F.col("t0") == F.col("t1")
    return g.select(
        "station", (lo - pad).alias("v_min"), (hi + pad).alias("v_max"),
        F.when(same, clocks.plus_hours(F.col("t0"), -1)).otherwise(F.col("t0")).alias("t_min"), F.when(same, clocks.plus_hours(F.col("t1"), 1)).otherwise(F.col("t1")).alias("t_max"),
    )


@query(
    "E28_system_summary",
    f"""SELECT count(*) AS stations, count_if(n > 0) AS with_data, CAST(max(latest) AS VARCHAR) AS last_refresh, count_if(n_ok > 0) AS n_passing, count_if(latest IS NULL OR epoch(TIMESTAMP '{T}') - epoch(date_trunc('second', latest)) > 5400) AS n_stale
      FROM (SELECT s_suppkey, count(event_id) AS n, max(ts) AS latest, count_if(value > 100) AS n_ok FROM supplier LEFT JOIN events ON user_id = s_suppkey AND ts <= TIMESTAMP '{T}' GROUP BY ALL)""",
)
def e28(t):
    e = t.events().filter(F.col("ts") <= now()).groupBy(F.col("user_id").alias("station")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"), F.count_if(F.col("value") > 100).alias("n_ok"))
    j = t.stations().select("station").join(e, "station", "left")
    return j.agg(
        F.count(F.lit(1)).alias("stations"), F.count_if(F.col("n") > 0).alias("with_data"), F.max("latest").alias("last_refresh"),
        F.count_if(F.col("n_ok") > 0).alias("n_passing"), F.count_if(values.is_stale(now(), F.col("latest"))).alias("n_stale"),
    )


PATH_SQL = """(SELECT o_custkey AS river, path_id, i, xy[1] / 1000.0::DOUBLE AS x, xy[2] / 100.0::DOUBLE AS y FROM (SELECT l_orderkey AS path_id, l_linenumber AS i, min((l_partkey, l_suppkey)) AS xy FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = path_id)"""


@query(
    "E29_river_lengths",
    f"""WITH s AS (SELECT river, path_id, sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) AS d FROM {PATH_SQL} WINDOW w AS (PARTITION BY path_id ORDER BY i)),
      r AS (SELECT c_nationkey AS basin, c_name AS name, sum(coalesce(d, 0)) AS length FROM s JOIN customer ON c_custkey = river GROUP BY ALL)
      SELECT basin, name, round(length, 6) AS length, length = max(length) OVER (PARTITION BY basin) OR (contains(lower(name), '00' || basin) AND length >= 0.1) AS mainstem FROM r""",
)
def e29(t):
    from fluvion.operators import rivers

    parts = river_paths(t).select(F.col("river").alias("fp"), geometry.path_length(F.col("path")).alias("length"))
    named = parts.join(t.points(), "fp").select("basin", F.col("fp_name").alias("name"), "length")
    return rivers.lengths_with_mainstem(named, stem_word=F.concat(F.lit("00"), F.col("basin").cast("string")))


@query(
    "E30_projection_state",
    """SELECT family, n_rows, n_at_own_clock FROM (SELECT 'observation' AS family, count(*) AS n_rows, count_if(available_at = valid_time) AS n_at_own_clock FROM b_obs
      UNION ALL SELECT 'forecast_run', count(*), count_if(available_at = issued_at) FROM b_run UNION ALL SELECT 'derived_feature', count(*), count_if(available_at = valid_time) FROM b_feat)""",
)
def e30(t):
    from fluvion.plans import replay

    return replay.projection_state(
        [("observation", t.observations(), "valid_time"), ("forecast_run", t.forecast_runs(), "issued_at"), ("derived_feature", t.derived_features(), "valid_time")]
    )


@query(
    "E31_events_in_window",
    """SELECT event_type AS phenomenon, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY ALL""",
)
def e31(t):
    inside = (F.col("ts") >= F.lit("2024-01-08").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-22").cast("timestamp"))
    return t.events().filter(inside).groupBy(F.col("event_type").alias("phenomenon")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "E33_product_writers",
    """SELECT product, string_agg(job, '|' ORDER BY job) AS writers, count(*) AS n FROM (SELECT n_name AS job, unnest(list_distinct(['p' || n_regionkey, 'p' || n_nationkey % 4])) AS product FROM nation) GROUP BY ALL""",
)
def e33(t):
    n = t.read("nation")
    produced = F.array_distinct(F.array(F.concat(F.lit("p"), "n_regionkey"), F.concat(F.lit("p"), (F.col("n_nationkey") % 4).cast("string"))))
    jobs = n.select(F.col("n_name").alias("job"), F.explode(produced).alias("product"))
    return jobs.groupBy("product").agg(F.sort_array(F.collect_list("job")).alias("writers"), F.count(F.lit(1)).alias("n"))


@query(
    "E34_label_lookup",
    """SELECT n_nationkey AS basin, c.name, count(s_suppkey) AS n_hits, CASE WHEN count(s_suppkey) = 0 THEN 'missing' ELSE 'ok' END AS verdict FROM nation JOIN (SELECT c_nationkey, min(c_name) AS name FROM customer GROUP BY ALL) c ON c_nationkey = n_nationkey
      LEFT JOIN supplier ON replace(s_name, 'Supplier', 'Customer') = c.name GROUP BY ALL""",
)
def e34(t):
    wanted = t.points().groupBy("basin").agg(F.min("fp_name").alias("name"))
    gazetteer = t.stations().select(F.replace("station_name", F.lit("Supplier"), F.lit("Customer")).alias("name"), "station")
    j = wanted.join(gazetteer, "name", "left").groupBy("basin", "name").agg(F.count("station").alias("n_hits"))
    return j.withColumn("verdict", F.when(F.col("n_hits") == 0, "missing").otherwise("ok"))


@query(
    "E35_first_seen",
    """SELECT product_id, event_id AS id, CAST(ts AS VARCHAR) AS seen FROM (SELECT event_type || '-' || user_id AS product_id, * FROM events WHERE ts >= TIMESTAMP '2024-01-10') QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ts, event_id) = 1""",
)
def e35(t):
    from fluvion.operators import selection

    rows = t.events().filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")).withColumn("product_id", F.concat_ws("-", "event_type", "user_id"))
    return selection.newest(rows, ["product_id"], [F.asc("ts"), F.asc("event_id")]).select("product_id", F.col("event_id").alias("id"), F.col("ts").alias("seen"))


@query(
    "E36_clean_daily",
    """SELECT site, CAST(day AS VARCHAR) AS day, arg_max(quantity - 3, file_pos) AS value FROM b_rows WHERE approval = 'Approved' AND quantity - 3 >= 0 AND quantity <> 17 GROUP BY ALL""",
)
def e36(t):
    return doy.clean_daily(raw_rows(t)).select("site", "day", "value")


def raw_rows(t):
    raw = F.when(F.col("quantity") == 17, "Ice").otherwise((F.col("quantity") - 3).cast("string"))
    return t.daily_rows().withColumn("raw", raw)


@query(
    "E36_skip_counts",
    """SELECT site, CASE WHEN approval <> 'Approved' THEN 'not_approved' WHEN quantity = 17 THEN 'unparseable' WHEN quantity - 3 < 0 THEN 'negative' ELSE 'used' END AS cause, count(*) AS n FROM b_rows GROUP BY ALL""",
)
def e36b(t):
    cause = F.coalesce(doy.row_problem(F.col("approval"), F.col("raw")), F.lit("used"))
    return raw_rows(t).groupBy("site", cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))

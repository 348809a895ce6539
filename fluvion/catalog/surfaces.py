"""Composite questions: river points, basins, susceptibility, forcing, agreement, evidence."""

from pyspark.sql import functions as F

from fluvion.catalog.aggregates import ratio_sql, snow_readings
from fluvion.catalog import grids
from fluvion.catalog.expressions import T, now
from fluvion.catalog.grids import INSIDE_SQL, pixels
from fluvion.catalog.joins import event_points, rings
from fluvion.catalog.registry import BINDINGS, ORACLES, query
from fluvion.catalog.scalars import BAND_SQL
from fluvion.catalog.series import pct_case
from fluvion.functions import flood, labels, values
from fluvion.functions.clocks import doy_index, plus_hours
from fluvion.operators import alerts, hydrograph, joins, precipitation, rasters, reservoirs, revisions, running, selection, snow, zonal
from fluvion.plans import basin as basin_plan
from fluvion.plans import cameras, climatology, comparison, forcing, river, susceptibility
from fluvion.session import staged
from fluvion.sources import gauges
from fluvion.sources.bindings import LEVELS

SHIFT_DAYS = 8213  # moves the order calendar next to the event calendar

BINDINGS["b_rbest"] = f"""SELECT point, variable, valid_time, max(id) AS id, arg_max(value, id) AS value, arg_max(available_at, id) AS retrieved_at FROM (
  SELECT user_id AS point, CASE WHEN event_type = 'click' THEN 'flow' ELSE 'stage' END AS variable, value, event_id AS id, date_trunc('hour', ts) AS valid_time, date_trunc('hour', ts) + to_hours(CAST(event_id % 7 AS INTEGER)) AS available_at FROM events)
  WHERE available_at <= TIMESTAMP '{T}' AND valid_time BETWEEN TIMESTAMP '{T}' - INTERVAL 14 DAY AND TIMESTAMP '{T}' GROUP BY ALL"""
BINDINGS["b_rwin"] = f"""SELECT point, epoch(valid_time) / 3600.0::DOUBLE AS x, value AS y, (epoch(valid_time) - epoch(lag(valid_time) OVER (PARTITION BY point ORDER BY valid_time))) / 3600.0::DOUBLE AS gap
  FROM b_rbest WHERE variable = 'stage' AND valid_time BETWEEN TIMESTAMP '{T}' - INTERVAL 6 HOUR AND TIMESTAMP '{T}'"""
BINDINGS["b_rslope"] = """SELECT point, median(m) AS slope FROM (SELECT p.point, p.x, median((q.y - p.y) / (q.x - p.x)) AS m FROM b_rwin p JOIN b_rwin q ON q.point = p.point AND q.x <> p.x GROUP BY ALL) GROUP BY ALL"""
BINDINGS["b_rtrend"] = """SELECT w.point, CASE WHEN w.point % 10 IN (7, 8) THEN 'TIDAL_CONTAMINATION' WHEN w.point % 10 = 9 THEN 'TIDAL_CLASS_UNVERIFIED' WHEN count(*) < 3 THEN 'INSUFFICIENT_OBSERVATIONS' WHEN max(gap) > 2 THEN 'GAP_EXCEEDS_TOLERANCE' WHEN max(x) - min(x) < 3 THEN 'SPAN_BELOW_MINIMUM' ELSE 'ok' END AS refusal, any_value(s.slope) AS slope
  FROM b_rwin w LEFT JOIN b_rslope s ON s.point = w.point GROUP BY w.point"""
BINDINGS["b_rrun"] = f"""SELECT o_custkey AS point, o_orderkey AS run_id, o_orderdate + INTERVAL {SHIFT_DAYS} DAY AS issued_at FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderdate + INTERVAL {SHIFT_DAYS} DAY + to_days(CAST(o_orderkey % 5 AS INTEGER)) <= TIMESTAMP '{T}'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
BINDINGS["b_rval"] = "SELECT r.point, r.run_id, r.issued_at, r.issued_at + to_hours(l.l_linenumber * 6) AS valid_time, l.l_quantity * 10 AS stage FROM b_rrun r JOIN lineitem l ON l.l_orderkey = r.run_id"
CAT = lambda v: f"CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} >= 400 THEN 'major' WHEN {v} >= 200 THEN 'moderate' WHEN {v} >= 100 THEN 'minor' WHEN {v} >= 50 THEN 'action' ELSE 'none' END"
ROOM = "CASE WHEN v < 50 THEN 50 - v WHEN v < 100 THEN 100 - v WHEN v < 200 THEN 200 - v WHEN v < 400 THEN 400 - v END"
BINDINGS["b_point"] = f"""SELECT point, valid_time, v AS value, companion, {CAT('v')} AS category, trend_refusal, rate, direction, {ROOM} AS headroom, CASE WHEN v < 50 THEN 'action' WHEN v < 100 THEN 'minor' WHEN v < 200 THEN 'moderate' ELSE 'major' END AS headroom_to,
    CASE WHEN direction = 'rising' AND rate > 0 THEN ({ROOM}) / rate END AS hours_to_level, CASE WHEN v >= 400 THEN 'above_highest_category' WHEN direction <> 'rising' THEN 'needs_rising_trend' ELSE 'ok' END AS headroom_reason,
    run_id, crest, crest_time, {CAT('crest')} AS hazard, CASE WHEN run_id IS NULL THEN 'no_official_forecast' WHEN crest IS NULL THEN 'no_value_inside_horizon' ELSE 'ok' END AS hazard_reason,
    CASE WHEN silent > 4 * 43200 THEN 'degraded' WHEN age > 43200 + 21600 THEN 'stale' ELSE 'current' END AS freshness, age AS age_s FROM (
  SELECT a.point, a.valid_time, a.value AS v, c.value AS companion, coalesce(t.refusal, 'INSUFFICIENT_OBSERVATIONS') AS trend_refusal, CASE WHEN t.refusal = 'ok' THEN t.slope END AS rate,
    CASE WHEN t.refusal IS DISTINCT FROM 'ok' THEN 'unknown' WHEN abs(t.slope) <= 0.05 THEN 'steady' WHEN t.slope > 0 THEN 'rising' ELSE 'falling' END AS direction, r.run_id, f.crest, f.crest_time,
    CAST(epoch(TIMESTAMP '{T}') - epoch(a.valid_time) AS BIGINT) AS age, epoch(TIMESTAMP '{T}') - epoch(a.retrieved_at) AS silent
  FROM (SELECT * FROM b_rbest WHERE variable = 'stage' QUALIFY row_number() OVER (PARTITION BY point ORDER BY valid_time DESC, id DESC) = 1) a LEFT JOIN b_rbest c ON c.point = a.point AND c.valid_time = a.valid_time AND c.variable = 'flow'
  LEFT JOIN b_rtrend t ON t.point = a.point LEFT JOIN b_rrun r ON r.point = a.point
  LEFT JOIN (SELECT point, max(stage) AS crest, arg_min(valid_time, (-stage, valid_time)) AS crest_time FROM b_rval WHERE valid_time > TIMESTAMP '{T}' - INTERVAL 6 HOUR AND valid_time <= TIMESTAMP '{T}' + INTERVAL 72 HOUR GROUP BY ALL) f ON f.point = a.point)"""
POINT_COLUMNS = """point, CAST(valid_time AS VARCHAR) AS valid_time, value, companion, category, trend_refusal, round(rate, 6) AS rate, direction, round(headroom, 6) AS headroom, headroom_to, round(hours_to_level, 6) AS hours_to_level, headroom_reason, run_id, crest, CAST(crest_time AS VARCHAR) AS crest_time, hazard, hazard_reason, freshness, age_s"""


def river_observations(t):
    return t.observations().select(
        F.col("station").alias("point"), F.when(F.col("variable") == "click", river.COMPANION).otherwise(river.PRIMARY).alias("variable"), "value", "id", "valid_time", "available_at", "retrieved_at"
    )


def shifted_runs(t):
    d = F.expr(f"interval {SHIFT_DAYS} days")
    return t.forecast_runs().filter("product <> '5-LOW'").select(F.col("fp").alias("point"), "run_id", (F.col("issued_at") + d).alias("issued_at"), (F.col("available_at") + d).alias("available_at"))


def shifted_values(t):
    return t.forecast_values().select("run_id", (F.col("lead") * 6).alias("after_h"), (F.col("stage") * 10).alias("stage"))


def levels():
    return {k: F.lit(v) for k, v in LEVELS.items()}


def point_tidal():
    k = F.col("point") % 10
    return F.when(k < 7, "FLUVIAL").when(k < 9, "TIDAL")


def point_states(t):
    return river.point_state(river_observations(t), levels(), now(), shifted_runs(t), shifted_values(t), point_tidal(), F.lit(43200), F.lit(21600))


@query("L1_river_point_state", f"SELECT {POINT_COLUMNS} FROM b_point")
def l1(t):
    return point_states(t)


@query(
    "L1_forecast_horizons",
    f"""WITH x AS (SELECT v.point, l AS lead_h, v.valid_time, v.stage, abs(epoch(v.valid_time) - epoch(v.issued_at) - l * 3600) / 3600.0::DOUBLE AS gap FROM b_rval v, (VALUES (6), (12), (24), (48), (72)) AS y(l)),
      b AS (SELECT * FROM x WHERE gap <= 3 QUALIFY row_number() OVER (PARTITION BY point, lead_h ORDER BY gap, valid_time, stage) = 1), e AS (SELECT point, max(epoch(valid_time) - epoch(issued_at)) / 3600.0::DOUBLE AS reach FROM b_rval GROUP BY ALL)
      SELECT e.point, l AS lead_h, CAST(b.valid_time AS VARCHAR) AS at, b.stage AS value, CASE WHEN b.point IS NOT NULL THEN 'ok' WHEN reach < l - 3 THEN 'forecast_ends' ELSE 'no_point_near' END AS reason FROM e, (VALUES (6), (12), (24), (48), (72)) AS y(l) LEFT JOIN b ON b.point = e.point AND b.lead_h = l""",
)
def l1b(t):
    newest = selection.newest(shifted_runs(t).filter(F.col("available_at") <= now()), ["point"], [F.desc("issued_at"), F.desc("run_id")]).select("point", "run_id", "issued_at")
    pts = shifted_values(t).join(newest, "run_id").select("point", F.col("issued_at").alias("as_of"), plus_hours(F.col("issued_at"), F.col("after_h")).alias("t"), F.col("stage").alias("v"))
    return hydrograph.at_leads(pts, ["point"])


def point_evidence(t):
    return river.evidence(river_observations(t), now(), shifted_runs(t), shifted_values(t), point_tidal())


def point_levels(t):
    return river.dated_levels(t.dated_levels().withColumnRenamed("station", "point"), now())


BINDINGS["b_plevel"] = f"""SELECT station AS point, category, level, effective_from, known_at, id FROM b_dated WHERE effective_from <= TIMESTAMP '{T}' AND known_at <= TIMESTAMP '{T}' QUALIFY row_number() OVER (PARTITION BY station, category ORDER BY effective_from DESC, known_at DESC, id DESC) = 1"""
NEWEST_SQL = "(SELECT * FROM b_rbest WHERE variable = 'stage' QUALIFY row_number() OVER (PARTITION BY point ORDER BY valid_time DESC, id DESC) = 1)"
DATED_CAT = lambda v: f"CASE WHEN {v} IS NULL OR coalesce(action, minor, moderate, major) IS NULL THEN 'unknown' WHEN {v} >= major THEN 'major' WHEN {v} >= moderate THEN 'moderate' WHEN {v} >= minor THEN 'minor' WHEN {v} >= action THEN 'action' ELSE 'none' END"


@query(
    "L1_dated_levels",
    f"""WITH l AS (SELECT point, max(level) FILTER (category = 'action') AS action, max(level) FILTER (category = 'minor') AS minor, max(level) FILTER (category = 'moderate') AS moderate, max(level) FILTER (category = 'major') AS major FROM b_plevel GROUP BY ALL)
      SELECT p.point, p.value, action, minor, moderate, major, {DATED_CAT('p.value')} AS category, round(CASE WHEN action > p.value THEN action - p.value WHEN minor > p.value THEN minor - p.value WHEN moderate > p.value THEN moderate - p.value WHEN major > p.value THEN major - p.value END, 6) AS headroom,
        CASE WHEN crest IS NULL THEN 'unknown' ELSE {DATED_CAT('crest')} END AS hazard FROM b_point p LEFT JOIN l USING (point)""",
)
def l1_dated(t):
    """Points judged by the levels in force and known at the time, not by constants."""
    state = point_evidence(t).join(point_levels(t), "point", "left")
    own = flood.level_columns()
    out = river.published(state, own, now(), F.lit(43200), F.lit(21600)).select("point", "value", "category", "headroom", "hazard")
    return out.join(point_levels(t).drop("level_sources"), "point", "left")


@query(
    "L1_point_provenance",
    f"""WITH a AS {NEWEST_SQL}, r AS (SELECT point, 'value' AS part, 1 AS n, id AS first_id, id AS last_id, valid_time, retrieved_at AS known_at FROM a
        UNION ALL SELECT a.point, 'companion', 1, c.id, c.id, c.valid_time, c.retrieved_at FROM a JOIN b_rbest c ON c.point = a.point AND c.valid_time = a.valid_time AND c.variable = 'flow'
        UNION ALL SELECT a.point, 'trend', count(*), min(w.id), max(w.id), max(w.valid_time), max(w.retrieved_at) FROM a JOIN b_rbest w ON w.point = a.point AND w.variable = 'stage' AND w.value IS NOT NULL AND w.valid_time BETWEEN TIMESTAMP '{T}' - INTERVAL 6 HOUR AND TIMESTAMP '{T}' GROUP BY a.point
        UNION ALL SELECT point, 'hazard', 1, run_id, run_id, crest_time, o_orderdate + INTERVAL {SHIFT_DAYS} DAY + to_days(CAST(o_orderkey % 5 AS INTEGER)) FROM b_point JOIN orders ON o_orderkey = run_id
        UNION ALL SELECT a.point, 'level:' || category, 1, l.id, l.id, effective_from, known_at FROM a JOIN b_plevel l ON l.point = a.point)
      SELECT point, part, n, first_id, last_id, CAST(valid_time AS VARCHAR) AS valid_time, CAST(known_at AS VARCHAR) AS known_at FROM r""",
)
def l1_provenance(t):
    """The row ids and clocks behind each number of a point's state."""
    return river.provenance(point_evidence(t), point_levels(t))


# --- susceptibility -----------------------------------------------------------------------------

S_T = "2001-10-26 06:00:00"
BINDINGS["b_sday"] = f"SELECT * FROM b_dayall WHERE day < CAST(TIMESTAMP '{S_T}' AS DATE)"
BINDINGS["b_swin"] = BINDINGS["b_win"].replace("b_day", "b_sday")
BINDINGS["b_slad"] = BINDINGS["b_lad"].replace("b_win", "b_swin")
BINDINGS["b_sctx"] = BINDINGS["b_ctx"].replace("b_win", "b_swin")
BINDINGS["b_stail"] = BINDINGS["b_tail"].replace("b_win", "b_swin").replace("b_ctx", "b_sctx")
BINDINGS["b_sgrow"] = BINDINGS["b_growth"].replace(ratio_sql(1), ratio_sql(1).replace("b_day", "b_sday"))
BINDINGS["b_susc"] = f"""SELECT site, day, value, p, n, doy, CASE WHEN age_h > 48 THEN 'daily_mean_too_old' WHEN p IS NULL THEN 'no_climatology' ELSE 'ok' END AS reason, clamped, p95,
  CASE least(CASE site % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END, CASE WHEN age_h * 3600 > 4 * 86400 THEN 1 WHEN age_h * 3600 > 86400 + 14400 THEN 1 ELSE 3 END) WHEN 0 THEN 'unknown' WHEN 1 THEN 'low' WHEN 2 THEN 'moderate' ELSE 'high' END AS confidence FROM (
  SELECT a.site, a.day, a.value, l.n, a.doy, l.p95, round({pct_case('a.value')} + 1e-9, 1) AS p, coalesce(a.value < p05 OR a.value > p95, false) AS clamped, (epoch(TIMESTAMP '{S_T}') - epoch((a.day + 1)::TIMESTAMP)) / 3600.0::DOUBLE AS age_h
  FROM (SELECT DISTINCT site, day, doy, value FROM b_swin QUALIFY day = max(day) OVER (PARTITION BY site)) a LEFT JOIN b_slad l ON l.site = a.site AND l.key = a.doy)"""


def s_daily(t, sites=None):
    """Daily means known at the time; with ``sites`` (site) only theirs, left out before anything is shuffled."""
    cut = F.lit(S_T).cast("timestamp").cast("date")
    means = t.daily_means(None).filter(F.col("day") < cut)
    return staged(t.daily_key(means if sites is None else means.join(sites, "site", "left_semi")), "daily")


def ceilings(t):
    k = F.col("station") % 4
    raw = F.when(k == 0, "high").when(k == 1, "moderate").when(k == 2, "low").otherwise("none")
    return t.stations().select(F.col("station").alias("site"), raw.alias("ceiling"))


def susceptibility_rows(t, version="0.2.0", days=None):
    return susceptibility.assess(s_daily(t) if days is None else days, F.lit(S_T).cast("timestamp"), ceilings(t), 86400, 14400, version)


S_BASE = f"""s.site, CAST(s.day AS VARCHAR) AS day, round(CASE WHEN s.reason = 'ok' THEN s.value END, 6) AS value, CASE WHEN s.reason = 'ok' THEN p END AS percentile, CASE WHEN s.reason = 'ok' THEN {BAND_SQL('p')} ELSE 'unknown' END AS band,
  round(CASE WHEN s.reason = 'ok' THEN p / 100 END, 4) AS score, CASE WHEN s.reason = 'ok' THEN confidence ELSE 'unknown' END AS confidence, s.reason"""
S_EXT = f"""SELECT {S_BASE}, 'susceptibility@0.2.0' AS method, round(CASE WHEN s.reason = 'ok' AND p95 > 0 THEN s.value / p95 END, 6) AS multiple,
  CASE WHEN s.reason = 'ok' THEN CASE WHEN clamped THEN 'unquantified' WHEN {BAND_SQL('greatest(0, p - se)')} = {BAND_SQL('least(100, p + se)')} THEN 'separated' ELSE 'near_band_edge' END END AS boundary,
  CAST(r.rank AS INTEGER) AS rank, CASE WHEN s.reason = 'ok' AND p >= 90 THEN c.n + 1 END AS rank_of, round(CASE WHEN s.reason = 'ok' THEN s.value / nullif(a.value, 0) END, 6) AS growth_24h, round(CASE WHEN s.reason = 'ok' THEN s.value / nullif(b.value, 0) END, 6) AS growth_48h,
  CASE WHEN s.reason <> 'ok' OR a.value IS NULL THEN 'unknown' WHEN s.value / a.value BETWEEN 1 / power(1.01, 24) AND power(1.01, 24) THEN 'steady' WHEN s.value > a.value THEN 'rising' ELSE 'falling' END AS direction_24h,
  CASE WHEN s.reason = 'ok' AND round(s.value / a.value, 4) >= g.floor THEN CAST((SELECT count(*) FROM b_sgrow x WHERE x.site = s.site AND x.growth > round(s.value / a.value, 4)) + 1 AS INTEGER) END AS growth_rank
  FROM (SELECT *, 100 * sqrt(p / 100 * (1 - p / 100) / greatest(1, n // 5)) AS se FROM b_susc) s LEFT JOIN b_sctx c ON c.site = s.site AND c.key = s.doy LEFT JOIN b_sday a ON a.site = s.site AND a.day = s.day - 1 LEFT JOIN b_sday b ON b.site = s.site AND b.day = s.day - 2
  LEFT JOIN (SELECT site, min(growth) AS floor FROM b_sgrow GROUP BY ALL) g ON g.site = s.site
  LEFT JOIN (SELECT s.site, count(k.value) + 1 AS rank FROM b_susc s JOIN b_sctx c ON c.site = s.site AND c.key = s.doy AND s.value >= c.tail_floor AND s.reason = 'ok' AND s.p >= 90
    LEFT JOIN (SELECT t.site, (t.doy + o + 366) % 366 AS key, t.value FROM b_stail t, (VALUES (-2), (-1), (0), (1), (2)) AS w(o)) k ON k.site = s.site AND k.key = s.doy AND k.value > s.value GROUP BY s.site) r ON r.site = s.site"""


@query("L3_susceptibility", S_EXT)
def l3(t):
    return susceptibility_rows(t).drop("exceeds_record")


@query("L3_susceptibility_level_only", f"SELECT {S_BASE}, 'susceptibility@0.1.0' AS method FROM b_susc s")
def l3b(t):
    return susceptibility_rows(t, "0.1.0")


# --- forcing ------------------------------------------------------------------------------------

BINDINGS["b_fbasin"] = "SELECT fp AS basin, max(issued_at) + CASE WHEN fp % 5 = 0 THEN INTERVAL 60 HOUR ELSE INTERVAL 12 HOUR END AS as_of FROM b_run GROUP BY fp"
BINDINGS["b_frow"] = """SELECT b.basin, b.as_of, v.issued_at, ['p50_72h', 'p10_72h', 'p90_72h', 'p50_24h', 'det_24h', 'det_72h', 'snow_p50'][v.lead] AS feature, v.stage * 4 AS value FROM b_fbasin b JOIN b_val v ON v.fp = b.basin AND v.issued_at <= b.as_of AND v.issued_at >= b.as_of - INTERVAL 48 HOUR"""
BINDINGS["b_fq"] = """SELECT basin, issued_at AS cycle, max(value) FILTER (feature = 'p50_72h') AS p50_72h, max(value) FILTER (feature = 'p10_72h') AS p10, max(value) FILTER (feature = 'p90_72h') AS p90, max(value) FILTER (feature = 'p50_24h') AS p50_24h, max(value) FILTER (feature = 'snow_p50') AS snow
  FROM (SELECT *, max(issued_at) OVER (PARTITION BY basin) AS c FROM b_frow) WHERE issued_at = c GROUP BY ALL"""
BINDINGS["b_foff"] = """SELECT basin, issued_at AS cycle, CASE WHEN count(*) = 3 THEN sum(v) END AS total, CASE WHEN count(*) = 3 THEN arg_min(v, lead) END AS day1 FROM (
  SELECT *, max(issued_at) OVER (PARTITION BY basin) AS c FROM (SELECT b.basin, v.issued_at, (v.lead - 1) // 3 AS lead, max(v.stage) AS v FROM b_fbasin b JOIN b_val v ON v.fp = b.basin AND v.issued_at <= b.as_of AND v.issued_at >= b.as_of - INTERVAL 48 HOUR GROUP BY ALL)) WHERE issued_at = c GROUP BY basin, issued_at"""
BINDINGS["b_fhyp"] = f"SELECT basin, sum(area) AS total, min(elevation) AS lo, max(elevation) AS hi, coalesce(sum(CASE WHEN elevation < 0 THEN area END), 0) AS under FROM {INSIDE_SQL} GROUP BY ALL"
FRAC = """CASE WHEN h.total IS NULL OR q.snow IS NULL THEN NULL WHEN q.snow >= 300 THEN CASE WHEN q.snow >= h.hi THEN 1 ELSE (SELECT sum(area) FROM {P} p WHERE p.basin = q.basin AND p.elevation < 300) / h.total END
  ELSE least(1, (coalesce((SELECT sum(area) FROM {P} p WHERE p.basin = q.basin AND p.elevation < floor(q.snow / 20) * 20), 0) + coalesce((SELECT sum(area) FROM {P} p WHERE p.basin = q.basin AND p.elevation >= floor(q.snow / 20) * 20 AND p.elevation < floor(q.snow / 20) * 20 + 20), 0) * (q.snow - floor(q.snow / 20) * 20) / 20) / h.total) END""".replace("{P}", "b_inside")
BINDINGS["b_inside"] = f"SELECT * FROM {INSIDE_SQL}"
BINDINGS["b_forcing"] = f"""SELECT b.basin, q.cycle, CASE WHEN q.p50_72h IS NULL THEN 'unknown' WHEN q.p50_72h < 25 THEN 'low' WHEN q.p50_72h < 75 THEN 'moderate' WHEN q.p50_72h < 150 THEN 'high' ELSE 'very_high' END AS level,
  CASE WHEN q.p50_72h IS NULL THEN NULL WHEN v <= 25 THEN v / 25 / 4 WHEN v <= 75 THEN (1 + (v - 25) / 50) / 4 WHEN v <= 150 THEN (2 + (v - 75) / 75) / 4 ELSE (3 + (v - 150) / 50) / 4 END AS score, q.p50_72h AS value, CASE WHEN q.p50_72h IS NOT NULL THEN q.p10 END AS p10, CASE WHEN q.p50_72h IS NOT NULL THEN q.p90 END AS p90,
  CASE WHEN q.p50_72h IS NOT NULL THEN q.snow END AS snow_level, CASE WHEN q.p50_72h IS NOT NULL THEN {FRAC} END AS rain_exposed, CASE WHEN q.p50_72h IS NOT NULL THEN o.total END AS official_total, CASE WHEN same THEN o.day1 - q.p50_24h END AS delta_24h, CASE WHEN same THEN o.total - q.p50_72h END AS delta_72h,
  CASE WHEN same AND o.total BETWEEN q.p10 AND q.p90 THEN 'inside' WHEN same THEN 'outside' END AS against_band,
  CASE WHEN q.p50_72h IS NULL THEN 'none' WHEN o.total IS NULL THEN 'no_official_total' WHEN NOT same THEN 'different_cycle' ELSE 'same_cycle' END AS agreement, CASE WHEN q.cycle IS NULL THEN 'no_cycle' WHEN q.p50_72h IS NULL THEN 'no_value' ELSE 'ok' END AS reason
  FROM b_fbasin b LEFT JOIN (SELECT *, least(greatest(p50_72h, 0), 200) AS v FROM b_fq) q USING (basin) LEFT JOIN b_foff o ON o.basin = b.basin LEFT JOIN b_fhyp h ON h.basin = b.basin, LATERAL (SELECT coalesce(q.p50_72h IS NOT NULL AND o.total IS NOT NULL AND q.cycle = o.cycle, false) AS same)"""


def forcing_inputs(t, only=None):
    """Basins with their times, rows and official windows; with ``only`` (basin) the runs of others are left out before anything is shuffled."""
    runs = t.forecast_runs()
    runs = runs if only is None else runs.join(only.select(F.col("basin").alias("fp")), "fp", "left_semi")
    extra = F.when(F.col("fp") % 5 == 0, 60).otherwise(12)
    basins = runs.groupBy("fp").agg(F.max("issued_at").alias("last")).select(F.col("fp").alias("basin"), plus_hours(F.col("last"), extra).alias("as_of"))
    names = F.array(*[F.lit(x) for x in ("p50_72h", "p10_72h", "p90_72h", "p50_24h", "det_24h", "det_72h", "snow_p50")])
    # from the headers: only the runs of the last two days before each basin's time have their values joined
    near = runs.join(basins.select(F.col("basin").alias("fp"), "as_of"), "fp").filter((F.col("issued_at") <= F.col("as_of")) & (F.col("issued_at") >= plus_hours(F.col("as_of"), -forcing.MAX_CYCLE_AGE_H)))
    v = t.run_values(near.drop("as_of"))
    rows = v.select(F.col("fp").alias("basin"), "issued_at", F.element_at(names, F.col("lead")).alias("feature"), (F.col("stage") * 4).alias("value"))
    # the official side has three windows per cycle, each with its highest value
    official = v.select(F.col("fp").alias("basin"), "issued_at", F.floor((F.col("lead") - 1) / 3).alias("lead"), F.col("stage").alias("value"))
    return basins, rows, official


def forcing_rows(t, only=None):
    """One row per basin; with ``only`` (basin) just theirs, from their own runs and pixels."""
    basins = None if only is None else only.select(F.col("basin").alias("ring_id"))
    return forcing.assess(*forcing_inputs(t, only), rasters.hypsometry(pixels(t, basins=basins), 0.0, 300.0))


@query(
    "L4_forcing",
    """SELECT basin, CAST(cycle AS VARCHAR) AS cycle, level, round(score, 6) AS score, value, p10, p90, snow_level, round(rain_exposed * 100 + 1e-9, 1) AS rain_exposed_pct, official_total, delta_24h, delta_72h, against_band, agreement, reason FROM b_forcing""",
)
def l4(t):
    return forcing_rows(t)


@query(
    "L6_official_against_blend",
    """SELECT agreement, against_band, count(*) AS n, max(delta_72h) AS largest, min(delta_24h) AS smallest FROM b_forcing GROUP BY ALL""",
)
def l6(t):
    return forcing_rows(t).groupBy("agreement", "against_band").agg(F.count(F.lit(1)).alias("n"), F.max("delta_72h").alias("largest"), F.min("delta_24h").alias("smallest"))


# --- agreement ----------------------------------------------------------------------------------

ACTION_FLOW = 30000.0

BINDINGS["b_arun"] = """SELECT fp AS point, run_id, issued_at, issued_at + INTERVAL 6 HOUR AS as_of, issued_at - to_hours(CAST(run_id % 30 AS INTEGER)) AS cycle, 30 + run_id % 60 AS coverage_h FROM b_run QUALIFY row_number() OVER (PARTITION BY fp ORDER BY issued_at DESC, run_id DESC) = 1"""
BINDINGS["b_aw"] = """SELECT *, greatest(as_of - INTERVAL 6 HOUR, cycle) AS ws, least(as_of + INTERVAL 72 HOUR, cycle + to_hours(CAST(coverage_h AS INTEGER))) AS we FROM b_arun"""
BINDINGS["b_apt"] = """SELECT point, t, max(v) AS v FROM (SELECT w.point, v.valid_time AS t, v.flow AS v FROM b_aw w JOIN b_val v USING (run_id) WHERE v.valid_time > ws AND v.valid_time <= we) GROUP BY ALL"""
BINDINGS["b_amp"] = """SELECT w.point, v.member, v.valid_time AS t, max(v.flow) AS v FROM b_aw w JOIN b_val v USING (run_id) WHERE v.valid_time > ws AND v.valid_time <= we GROUP BY ALL"""


def shape_sql(src, keys):
    return f"""(SELECT *, CASE WHEN (crest - low) / crest < 0.05 THEN 'flat' WHEN ct > t0 AND ct < t1 AND (crest - greatest(fv, lv)) / crest >= 0.05 THEN 'crest' WHEN lv >= fv THEN 'rising' ELSE 'receding' END AS shape FROM (
      SELECT {keys}, max(v) AS crest, arg_min(t, (-v, t)) AS ct, min(v) AS low, arg_min(v, t) AS fv, arg_max(v, t) AS lv, min(t) AS t0, max(t) AS t1, min(st) AS step_h FROM (SELECT *, (epoch(t) - epoch(lag(t) OVER (PARTITION BY {keys} ORDER BY t))) / 3600.0::DOUBLE AS st FROM {src}) GROUP BY ALL))"""


BINDINGS["b_amem"] = f"SELECT *, count(*) OVER (PARTITION BY point) AS mc, row_number() OVER (PARTITION BY point ORDER BY crest, ct, member) AS pos FROM {shape_sql('b_amp', 'point, member')}"
BINDINGS["b_aex"] = """SELECT point, exceeds, exceeding, exceeding / members AS fraction FROM (SELECT point, count(*) AS members, CASE WHEN max(crest) >= 90000 THEN 'major' WHEN max(crest) >= 70000 THEN 'moderate' WHEN max(crest) >= 50000 THEN 'minor' ELSE 'action' END AS exceeds,
  CASE WHEN max(crest) >= 90000 THEN count_if(crest >= 90000) WHEN max(crest) >= 70000 THEN count_if(crest >= 70000) WHEN max(crest) >= 50000 THEN count_if(crest >= 50000) ELSE count_if(crest >= 30000) END AS exceeding FROM b_amem GROUP BY ALL)"""
FCAT = lambda v: f"CASE WHEN {v} >= 90000 THEN 4 WHEN {v} >= 70000 THEN 3 WHEN {v} >= 50000 THEN 2 WHEN {v} >= 30000 THEN 1 ELSE 0 END"
BINDINGS["b_agree"] = f"""SELECT point, CASE WHEN reason <> 'ok' THEN 'unknown' WHEN abs(delta) <= 0.25 AND coalesce(dt <= 6, true) AND steps = 0 AND NOT disagree AND NOT opposed THEN 'high' WHEN abs(delta) <= 0.6 AND coalesce(dt <= 18, true) AND steps <= 1 THEN 'moderate' ELSE 'low' END AS state, reason,
  CASE WHEN reason = 'ok' THEN delta END AS delta, CASE WHEN reason = 'ok' THEN dt END AS timing_h, CASE WHEN reason = 'ok' THEN steps END AS steps, o_crest, o_ct, o_shape, m_crest, m_ct, m_shape, member, mc, shared_h, lost_h, age_h, o_step, m_step,
  CASE WHEN o_crest IS NOT NULL AND m_crest IS NOT NULL THEN concat_ws('|', CASE WHEN dc = 1 AND mc > 1 THEN 'members_identical_in_window' END, CASE WHEN lost_h > 1 THEN 'window_truncated_by_model_coverage' END, CASE WHEN coalesce(o_step, 0) > coalesce(m_step, 0) THEN 'official_series_coarser_than_model' END,
    CASE WHEN disagree THEN 'one_forecast_crests_the_other_does_not' END, CASE WHEN o_shape <> 'crest' AND m_shape <> 'crest' THEN 'timing_not_assessable_no_crest' END, CASE WHEN opposed THEN 'trends_oppose_without_a_crest' END) ELSE '' END AS quality FROM (
  SELECT w.point, o.crest AS o_crest, o.ct AS o_ct, o.shape AS o_shape, o.step_h AS o_step, m.crest AS m_crest, m.ct AS m_ct, m.shape AS m_shape, m.step_h AS m_step, m.member, m.mc, d.dc, greatest((epoch(we) - epoch(ws)) / 3600.0::DOUBLE, 0) AS shared_h, greatest((epoch(as_of + INTERVAL 72 HOUR) - epoch(we)) / 3600.0::DOUBLE, 0) AS lost_h,
    (epoch(as_of) - epoch(cycle)) / 3600.0::DOUBLE AS age_h, (m.crest - o.crest) / greatest(o.crest, 30000) AS delta, CASE WHEN o.shape = 'crest' AND m.shape = 'crest' THEN abs(epoch(m.ct) - epoch(o.ct)) / 3600.0::DOUBLE END AS dt, abs({FCAT('o.crest')} - {FCAT('m.crest')}) AS steps,
    (o.shape = 'crest') <> (m.shape = 'crest') AS disagree, (o.shape = 'rising' AND m.shape = 'receding') OR (o.shape = 'receding' AND m.shape = 'rising') AS opposed,
    CASE WHEN o.crest IS NULL THEN 'no_official_crest' WHEN m.crest IS NULL THEN 'no_members' WHEN (epoch(we) - epoch(ws)) / 3600.0::DOUBLE < 24 THEN 'window_too_short' ELSE 'ok' END AS reason
  FROM b_aw w LEFT JOIN {shape_sql('b_apt', 'point')} o ON o.point = w.point LEFT JOIN (SELECT * FROM b_amem WHERE pos = (mc - 1) // 2 + 1) m ON m.point = w.point LEFT JOIN (SELECT point, count(DISTINCT crest) AS dc FROM b_amem GROUP BY ALL) d ON d.point = w.point)"""


def agreement_rows(t):
    latest = comparison.latest_cycles(t.forecast_runs(), ["fp"])
    r = F.col("run_id")
    pts = latest.select(
        F.col("fp").alias("point"), "run_id", plus_hours(F.col("issued_at"), 6).alias("as_of"), plus_hours(F.col("issued_at"), -(r % 30)).alias("cycle"), (F.lit(30) + r % 60).alias("coverage_h")
    )
    v = t.run_values(latest).select(F.col("fp").alias("point"), "valid_time", "member", "flow")
    official = v.groupBy("point", F.col("valid_time").alias("t")).agg(F.max("flow").alias("v"))
    members = v.groupBy("point", "member", F.col("valid_time").alias("t")).agg(F.max("flow").alias("v"))
    flow_levels = {k: F.lit(x) for k, x in (("action", ACTION_FLOW), ("minor", 50000.0), ("moderate", 70000.0), ("major", 90000.0))}
    return comparison.assess(pts.drop("run_id"), official, members, flow_levels, F.lit(ACTION_FLOW))


@query(
    "L5_agreement",
    """SELECT point, state, reason, round(delta, 6) AS delta, timing_h, steps, o_crest, o_shape, round(m_crest, 6) AS m_crest, m_shape, member, round(shared_h, 6) AS shared_h, quality, exceeds, exceeding, round(fraction, 6) AS fraction FROM b_agree LEFT JOIN b_aex USING (point)""",
)
def l5(t):
    return agreement_rows(t).select("point", "state", "reason", "delta", "timing_h", "steps", "o_crest", "o_shape", "m_crest", "m_shape", "member", "shared_h", "quality", "exceeds", "exceeding", "fraction")


@query("D16_official_vs_model_window", """SELECT point, o_crest, CAST(o_ct AS VARCHAR) AS o_crest_time, round(m_crest, 6) AS m_crest, CAST(m_ct AS VARCHAR) AS m_crest_time, round(lost_h, 6) AS lost_tail_h, age_h AS cycle_age_h FROM b_agree""")
def d16(t):
    return agreement_rows(t).select("point", "o_crest", "o_crest_time", "m_crest", "m_crest_time", "lost_tail_h", "cycle_age_h")


@query("L19_agreement_explanation", """SELECT point, state, reason, quality, round(shared_h, 6) AS shared_h, o_shape, m_shape, mc AS member_count, round(delta, 6) AS delta, round(o_crest, 6) AS o_crest FROM b_agree""")
def l19(t):
    e = comparison.explanation(agreement_rows(t))
    return e.select(
        "point", "state", "reason", "quality", F.col("record.window.shared_h").alias("shared_h"), F.col("record.official.shape").alias("o_shape"), F.col("record.model.shape").alias("m_shape"),
        F.col("record.model.member_count").alias("member_count"), F.col("record.difference.delta").alias("delta"), F.col("record.official.crest").alias("o_crest"),
    )


@query(
    "L27_agreement_drivers",
    """SELECT point, 1 AS rank, 'agreement_crest_flow_official' AS feature, round(o_crest, 1) AS value, 'cfs' AS unit, 'reference' AS direction FROM b_agree WHERE reason = 'ok'
      UNION ALL SELECT point, 2, 'agreement_crest_flow_model_median', round(m_crest, 1), 'cfs', CASE WHEN delta > 0 THEN 'model_exceeds_official' WHEN delta < 0 THEN 'model_below_official' ELSE 'model_matches_official' END FROM b_agree WHERE reason = 'ok'
      UNION ALL SELECT point, 3, 'agreement_crest_timing_delta_h', round(timing_h, 2), 'h', CASE WHEN (o_shape = 'crest') <> (m_shape = 'crest') THEN 'only_one_forecast_crests_in_window' WHEN o_shape <> 'crest' THEN 'neither_forecast_crests_in_window' WHEN m_ct > o_ct THEN 'model_later' WHEN m_ct < o_ct THEN 'model_earlier' ELSE 'model_same_time' END FROM b_agree WHERE reason = 'ok'""".replace("round(o_crest, 1)", "round(o_crest + 1e-9, 1)").replace("round(m_crest, 1)", "round(m_crest + 1e-9, 1)"),
)
def l27(t):
    a = agreement_rows(t)
    return comparison.drivers(a.withColumn("o_crest", F.col("o_crest") + 1e-9).withColumn("m_crest", F.col("m_crest") + 1e-9))


PCT_SQL = "CAST(round(abs(delta) * 100) AS BIGINT)"
DIFF_SQL = "CAST(round(abs(m_crest - o_crest)) AS BIGINT)"


@query(
    "I21_agreement_sentences",
    f"""SELECT point, concat('The median model member peaks ', CASE WHEN o_crest >= 30000 AND abs(delta) * 100 < 1 THEN 'within 1% of' WHEN o_crest >= 30000 THEN concat({PCT_SQL}, '% ', CASE WHEN delta > 0 THEN 'above' ELSE 'below' END) WHEN {DIFF_SQL} = 0 THEN 'within 1 cfs of' ELSE concat(format('{{:,}}', {DIFF_SQL}), ' cfs ', CASE WHEN m_crest > o_crest THEN 'above' ELSE 'below' END) END,
        ' the official forecast', CASE WHEN o_crest < 30000 THEN concat(' (', CASE WHEN abs(delta) * 100 < 1 THEN 'under 1' ELSE CAST({PCT_SQL} AS VARCHAR) END, '% of the action flow of 30,000 cfs)') ELSE '' END, ', and ',
        CASE WHEN timing_h < 0.5 THEN 'crests at the same time' WHEN timing_h IS NOT NULL THEN concat('crests ', CAST(round(timing_h) AS BIGINT), ' h ', CASE WHEN m_ct > o_ct THEN 'later' ELSE 'earlier' END) WHEN (o_shape = 'crest') <> (m_shape = 'crest') THEN 'only one of the two crests inside this window' ELSE concat('neither crests inside this window (official ', o_shape, ', model ', m_shape, ')') END,
        coalesce('; ' || nullif(CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN c1 || ' and ' || c2 ELSE concat_ws(' and ', c1, c2, c3) END, ''), ''), '.') AS sentence
      FROM (SELECT *, CASE WHEN contains(quality, 'window_truncated_by_model_coverage') THEN concat('the model covers only the first ', CAST(round(shared_h) AS BIGINT), ' h of that window') END AS c1, CASE WHEN contains(quality, 'members_identical_in_window') THEN concat('all ', mc, ' members reach the same peak') END AS c2,
        CASE WHEN contains(quality, 'official_series_coarser_than_model') THEN 'the official series is coarser than the model''s' END AS c3 FROM b_agree WHERE reason = 'ok')""",
)
def i21(t):
    a = agreement_rows(t).filter("reason = 'ok'")
    caveats = [
        F.when(F.array_contains("quality", "window_truncated_by_model_coverage"), F.format_string("the model covers only the first %d h of that window", F.round("shared_h").cast("long"))),
        F.when(F.array_contains("quality", "members_identical_in_window"), F.format_string("all %d members reach the same peak", "member_count")),
        F.when(F.array_contains("quality", "official_series_coarser_than_model"), F.lit("the official series is coarser than the model's")),
    ]
    timing = labels.timing_phrase(F.col("timing_h"), F.col("m_crest_time") > F.col("o_crest_time"), F.col("o_shape"), F.col("m_shape"))
    return a.select("point", labels.explain("The median model member", F.col("delta"), timing, caveats, F.col("m_crest") - F.col("o_crest"), F.when(F.col("o_crest") < ACTION_FLOW, F.lit(ACTION_FLOW))).alias("sentence"))


# --- basins -------------------------------------------------------------------------------------

BASIN_SQL = f"""SELECT n.n_nationkey AS basin, n.n_name AS basin_name, coalesce(s.band, 'unknown') AS susceptibility, CASE WHEN s.site IS NULL THEN 'no_gauge' ELSE s.reason END AS susceptibility_reason, coalesce(f.level, 'unknown') AS forcing, coalesce(f.reason, 'no_basin_rows') AS forcing_reason,
  coalesce(p.hazard, 'unknown') AS hazard, coalesce(p.hazard_reason, 'no_outlet_point') AS hazard_reason, coalesce(a.state, 'unknown') AS agreement, coalesce(a.reason, 'no_outlet_point') AS agreement_reason, e.total AS rain_72h, coalesce(e.hours_present, 0) AS rain_hours, coalesce(l.n, 0) AS n_alerts
  FROM nation n LEFT JOIN (SELECT site, reason, CASE WHEN reason = 'ok' THEN {BAND_SQL('p')} ELSE 'unknown' END AS band FROM b_susc) s ON s.site = n.n_nationkey LEFT JOIN b_forcing f ON f.basin = n.n_nationkey LEFT JOIN b_point p ON p.point = n.n_nationkey LEFT JOIN b_agree a ON a.point = n.n_nationkey
  LEFT JOIN (SELECT basin, round(sum(value), 3) AS total, CAST(count(value) AS INTEGER) AS hours_present FROM b_hour JOIN (SELECT basin, max(valid_time) AS w FROM b_hour GROUP BY ALL) x USING (basin) WHERE valid_time > w - INTERVAL 72 HOUR GROUP BY basin) e ON e.basin = n.n_nationkey % 6
  LEFT JOIN (SELECT z.basin, count(*) AS n FROM (SELECT * FROM b_alert WHERE available_at <= TIMESTAMP '2024-01-06 00:00:00' AND status = 'Actual' AND message_type <> 'Cancel' AND (ends IS NULL OR ends >= TIMESTAMP '2024-01-06 00:00:00') AND (expires IS NULL OR expires >= TIMESTAMP '2024-01-06 00:00:00')
      AND (ends IS NOT NULL OR expires IS NOT NULL OR sent >= TIMESTAMP '2024-01-04 00:00:00') AND alert_id NOT IN (SELECT reference FROM b_alert WHERE reference IS NOT NULL AND available_at <= TIMESTAMP '2024-01-06 00:00:00')) a JOIN (SELECT printf('WAC%03d', n_nationkey) AS zone, n_nationkey AS basin FROM nation) z ON z.zone IN (a.ugc1, a.ugc2) GROUP BY z.basin) l ON l.basin = n.n_nationkey"""


def basin_states(t, points=None):
    from fluvion.catalog.aggregates import basin_hours

    zones = t.basins().select(F.format_string("WAC%03d", "basin").alias("zone"), F.col("basin").cast("long").alias("basin"))
    active = joins.not_superseded(t.alerts(), "2024-01-06 00:00:00")
    routed = alerts.route(active, zones).select("alert_id", F.explode("basins").alias("basin"))
    rain = precipitation.trailing_totals(basin_hours(t), "basin").filter("window_h = 72")
    dims = t.basins().select(F.col("basin").cast("long").alias("basin"), "basin_name", (F.col("basin") % 6).cast("long").alias("rain_basin"))
    # a basin asks for the gauge of its own number
    days = s_daily(t, dims.select(F.col("basin").alias("site")))
    return basin_plan.basin_state(dims, susceptibility_rows(t, "0.1.0", days), forcing_rows(t), point_states(t) if points is None else points, agreement_rows(t), rain, routed)


@query("L2_basin_state", BASIN_SQL)
def l2(t):
    return basin_states(t)


DRIVER_SQL = f"""SELECT site AS basin, 0 AS s, 1 AS place, 'susceptibility' AS surface, 'flow_percentile' AS feature, p AS value, day::TIMESTAMP AS clock FROM b_susc WHERE reason = 'ok' UNION ALL SELECT site, 0, 2, 'susceptibility', 'daily_mean', value, day::TIMESTAMP FROM b_susc WHERE reason = 'ok'
  UNION ALL SELECT basin, 1, place, 'forcing', feature, number, cycle FROM (SELECT basin, cycle, unnest([{{'place': 1, 'feature': 'value', 'number': value}}, {{'place': 2, 'feature': 'p90', 'number': p90}}, {{'place': 3, 'feature': 'p10', 'number': p10}}, {{'place': 4, 'feature': 'snow_level', 'number': snow_level}},
    {{'place': 5, 'feature': 'rain_exposed_pct', 'number': round(rain_exposed * 100 + 1e-9, 1)}}, {{'place': 6, 'feature': 'official_total', 'number': official_total}}], recursive := true) FROM b_forcing) WHERE number IS NOT NULL
  UNION ALL SELECT point, 2, 1, 'agreement', 'agreement_crest_flow_official', round(o_crest + 1e-9, 1), NULL FROM b_agree WHERE reason = 'ok' UNION ALL SELECT point, 2, 2, 'agreement', 'agreement_crest_flow_model_median', round(m_crest + 1e-9, 1), NULL FROM b_agree WHERE reason = 'ok'
  UNION ALL SELECT point, 2, 3, 'agreement', 'agreement_crest_timing_delta_h', round(timing_h, 2), NULL FROM b_agree WHERE reason = 'ok'"""


@query("L2_basin_drivers", f"SELECT basin, CAST(row_number() OVER (PARTITION BY basin ORDER BY s, place, feature) AS INTEGER) AS rank, surface, feature, round(value, 6) AS value, CAST(clock AS VARCHAR) AS clock FROM ({DRIVER_SQL}) JOIN nation ON n_nationkey = basin")
def l2_drivers(t):
    """The numbers that lead each basin's surfaces, in one ranked list, each with the clock of the row it comes from."""
    basins = t.basins().select(F.col("basin").cast("long").alias("basin"))
    # a basin asks for the gauge of its own number
    days = s_daily(t, basins.withColumnRenamed("basin", "site"))
    s = susceptibility_rows(t, "0.1.0", days).filter("reason = 'ok'").withColumnRenamed("site", "basin").join(basins, "basin", "left_semi")
    s = s.withColumn("d", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(f).alias("feature"), F.col(c).cast("double").alias("value")) for i, f, c in ((1, "flow_percentile", "percentile"), (2, "daily_mean", "value"))])))
    f = staged(forcing_rows(t, basins), "basin-forcing")
    f = forcing.driver_rows(f).join(f.select("basin", F.col("cycle").alias("clock")), "basin").withColumnRenamed("number", "value")
    a = comparison.drivers(agreement_rows(t).join(basins.withColumnRenamed("basin", "point"), "point", "left_semi").withColumns({"o_crest": F.col("o_crest") + 1e-9, "m_crest": F.col("m_crest") + 1e-9}))
    a = a.withColumnRenamed("point", "basin").withColumn("clock", F.lit(None).cast("timestamp"))
    return basin_plan.headline_drivers([("susceptibility", s.select("basin", "d.*", F.col("day").alias("clock"))), ("forcing", f), ("agreement", a)])


@query("L24_scene_summary", f"SELECT b.basin, b.basin_name, b.susceptibility, b.hazard, count(p.point) AS n_points, max(p.value) AS highest FROM ({BASIN_SQL}) b LEFT JOIN customer c ON c.c_nationkey = b.basin LEFT JOIN b_point p ON p.point = c.c_custkey GROUP BY ALL")
def l24(t):
    points = staged(point_states(t), "point-states")
    rivers = points.select(F.col("point").alias("fp"), "value").join(t.points(), "fp").groupBy(F.col("basin").cast("long").alias("basin")).agg(F.count(F.lit(1)).alias("n_points"), F.max("value").alias("highest"))
    return basin_plan.scene(basin_states(t, points), rivers)


@query(
    "L11_reservoir_state",
    f"""WITH o AS (SELECT * FROM b_obs WHERE variable IN ('view', 'click', 'error') AND available_at <= TIMESTAMP '{T}' AND valid_time BETWEEN TIMESTAMP '{T}' - INTERVAL 3 DAY AND TIMESTAMP '{T}' QUALIFY row_number() OVER (PARTITION BY station, variable ORDER BY valid_time DESC, id DESC) = 1)
      SELECT station, max(value) FILTER (variable = 'view') AS forebay, max(value) FILTER (variable = 'click') AS inflow, max(value) FILTER (variable = 'error') AS outflow, CAST(max(valid_time) AS VARCHAR) AS newest FROM o GROUP BY ALL""",
)
def l11(t):
    return reservoirs.latest_state(t.observations(), now(), {"view": "forebay", "click": "inflow", "error": "outflow"})


@query(
    "L12_exceedance_band",
    """WITH c AS (SELECT fp, run_id, issued_at FROM b_run QUALIFY row_number() OVER (PARTITION BY fp ORDER BY issued_at DESC, run_id DESC) = 1), v AS (SELECT c.fp, c.issued_at, lead, valid_time, max(flow) AS flow FROM c JOIN b_val v USING (run_id, fp, issued_at) GROUP BY ALL)
      SELECT fp, count_if(lead <= 4) AS n_inside, count_if(lead > 4) AS n_clipped, round(min(CASE WHEN lead <= 4 THEN flow / 2 END), 6) AS lowest, round(max(CASE WHEN lead <= 4 THEN flow * 2 END), 6) AS highest, CASE WHEN count_if(lead <= 4) > 0 THEN 'ok' ELSE 'every_row_outside_window' END AS reason FROM v GROUP BY ALL""",
)
def l12(t):
    latest = comparison.latest_cycles(t.forecast_runs(), ["fp"]).select("fp", "run_id", "issued_at")
    v = t.run_values(latest).groupBy("fp", "issued_at", "valid_time").agg(F.max("flow").alias("flow"))
    rows = v.withColumn("q", F.explode(F.array(*[F.struct(F.lit(p).alias("level"), (F.col("flow") * k).alias("value")) for p, k in ((0.05, 2.0), (0.5, 1.0), (0.95, 0.5))]))).select("fp", "issued_at", "valid_time", "q.*")
    return hydrograph.exceedance_band(rows, "fp", F.col("issued_at"), plus_hours(F.col("issued_at"), 24))


@query(
    "L13_latest_official_run",
    """WITH c AS (SELECT fp, run_id, issued_at FROM b_run WHERE product <> '5-LOW' QUALIFY row_number() OVER (PARTITION BY fp ORDER BY issued_at DESC, run_id DESC) = 1)
      SELECT fp, run_id, CAST(issued_at AS VARCHAR) AS issued_at, coalesce(string_agg(v.lead || '=' || CAST(v.stage AS VARCHAR), '|' ORDER BY v.lead), '') AS points FROM c LEFT JOIN (SELECT run_id, lead, max(stage) AS stage FROM b_val GROUP BY ALL) v USING (run_id) GROUP BY ALL""",
)
def l13(t):
    latest = comparison.latest_cycles(t.forecast_runs().filter("product <> '5-LOW'"), ["fp"]).select("fp", "run_id", "issued_at")
    per = t.forecast_values().groupBy("run_id", "lead").agg(F.max("stage").alias("stage"))
    pts = per.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("lead", "stage"))), lambda p: F.concat_ws("=", p["lead"], p["stage"])).alias("points"))
    return latest.join(pts, "run_id", "left").select("fp", "run_id", "issued_at", F.coalesce("points", F.array().cast("array<string>")).alias("points"))


BINDINGS["b_stem"] = """SELECT * FROM (SELECT -122 + (s_suppkey * 37 % 480) / 100.0::DOUBLE AS lon1, 46 + (s_suppkey * 7 % 24) / 10.0::DOUBLE AS lat1, lead(-122 + (s_suppkey * 37 % 480) / 100.0::DOUBLE) OVER w AS lon2, lead(46 + (s_suppkey * 7 % 24) / 10.0::DOUBLE) OVER w AS lat2 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)) WHERE lon2 IS NOT NULL"""
BINDINGS["b_stemm"] = """SELECT event_id AS pid, min(d) AS stem_m FROM (SELECT event_id, sqrt(power(x1 + t * dx, 2) + power(y1 + t * dy, 2)) AS d FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(greatest(-(x1 * dx + y1 * dy) / (dx * dx + dy * dy), 0), 1) ELSE 0 END AS t FROM (
  SELECT event_id, (lon1 - lon) * m AS x1, (lat1 - lat) * 111320 AS y1, (lon2 - lon1) * m AS dx, (lat2 - lat1) * 111320 AS dy FROM (SELECT event_id, -122 + value / 100 AS lon, 46 + (hour(ts) * 60 + minute(ts)) / 600.0::DOUBLE AS lat, 111320 * cos(radians(46 + (hour(ts) * 60 + minute(ts)) / 600.0::DOUBLE)) AS m FROM events), b_stem))) WHERE d < 5000 GROUP BY ALL"""


def camera_places(t):
    return t.events().select(F.col("event_id").alias("pid"), (F.lit(-122) + F.col("value") / 100).alias("lon"), (F.lit(46) + (F.hour("ts") * 60 + F.minute("ts")) / 600.0).alias("lat"))


def stems(t):
    """Mainstems as segments: the suppliers of a nation, in order, are the vertices of its path."""
    k = F.col("s_suppkey")
    v = t.read("supplier").select(F.col("s_nationkey").alias("basin"), k.alias("i"), (F.lit(-122) + (k * 37 % 480) / 100.0).alias("lon1"), (F.lit(46) + (k * 7 % 24) / 10.0).alias("lat1"))
    return running.lagged(v, ["basin"], F.floor(F.col("i") / 1024), "i", {"lon2": "lon1", "lat2": "lat1"}).filter("lon2 IS NOT NULL").select("lon1", "lat1", "lon2", "lat2")


@query("L14_stem_distance", "SELECT event_id AS pid, round(stem_m, 4) AS d_m FROM events LEFT JOIN b_stemm ON pid = event_id")
def l14b(t):
    return joins.nearest_segment(camera_places(t), stems(t), "pid", cameras.STEM_REPORT_M).select("pid", F.round("d_m", 4).alias("d_m"))


@query(
    "L14_camera_evidence",
    """WITH v AS (SELECT ring_id, e, cx + [-9.5, 8.0, 11.0, -4.0][e + 1] AS x1, cy + [-1.0, -2.75, 1.5, 2.875][e + 1] AS y1, cx + [8.0, 11.0, -4.0, -9.5][e + 1] AS x2, cy + [-2.75, 1.5, 2.875, -1.0][e + 1] AS y2 FROM (SELECT s_suppkey AS ring_id, unnest([0, 1, 2, 3]) AS e, (s_suppkey * 37 % 480) + 10.25::DOUBLE AS cx, (s_suppkey * 7 % 18) + 3.125::DOUBLE AS cy FROM supplier)),
      p AS (SELECT event_id AS pid, event_type AS title, value AS x, hour(ts) + minute(ts) / 60.0::DOUBLE AS y, event_id % 50 = 0 AS at_gauge FROM events), i AS (SELECT pid, ring_id FROM p JOIN v ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
      z AS (SELECT pid, bool_or(ring_id % 5 = 0) AS floodway FROM i GROUP BY ALL)
      SELECT p.pid, concat_ws('|', CASE WHEN at_gauge THEN 'at_usgs_gauge' END, CASE WHEN contains(title, 'click') THEN 'river_named_in_camera_title' END, CASE WHEN m.pid IS NOT NULL THEN CAST(round(m.stem_m / 10) * 10 AS BIGINT) || '_m_from_mainstem_river' END, CASE WHEN z.floodway THEN 'inside_floodway' WHEN z.pid IS NOT NULL THEN 'inside_1pct_floodplain' END) AS reasons,
        CASE WHEN at_gauge OR coalesce(z.floodway, false) OR (contains(title, 'click') AND coalesce(round(m.stem_m / 10) * 10 < 400, false)) THEN 'A' WHEN z.pid IS NOT NULL OR contains(title, 'click') OR coalesce(round(m.stem_m / 10) * 10 < 400, false) THEN 'B' ELSE 'C' END AS tier, at_gauge OR z.pid IS NOT NULL OR coalesce(round(m.stem_m / 10) * 10 <= 600, false) AS evidenced FROM p LEFT JOIN z USING (pid) LEFT JOIN b_stemm m USING (pid)""",
)
def l14(t):
    pts = event_points(t)
    inside = joins.points_in_rings(pts, rings(t), "pid", "ring_id", cell=2.0, flag=F.col("ring_id") % 5 == 0).withColumnRenamed("flag", "floodway")
    cams = t.events().select(F.col("event_id").alias("pid"), F.col("event_type").alias("title"), (F.col("event_id") % 50 == 0).alias("at_gauge"))
    stem = joins.nearest_segment(camera_places(t), stems(t), "pid", cameras.STEM_REPORT_M).select("pid", F.col("d_m").alias("stem_m"))
    return cameras.evidence(cams.join(stem, "pid").join(inside, "pid", "left"), words=("click",)).select("pid", "reasons", "tier", "evidenced")


@query(
    "L15_build_references",
    f"""SELECT l.site, l.n_ladders, c.n_pooled, round(c.record, 6) AS record, t.n_tail, g.n AS n_growth_24h, g.floor AS floor_24h FROM (SELECT site, count(*) AS n_ladders FROM b_lad GROUP BY ALL) l JOIN (SELECT site, CAST(sum(n) AS BIGINT) AS n_pooled, max(maximum) AS record FROM b_ctx GROUP BY ALL) c USING (site)
      LEFT JOIN (SELECT site, count(*) AS n_tail FROM b_tail GROUP BY ALL) t USING (site) LEFT JOIN (SELECT site, count(*) AS n, min(growth) AS floor FROM b_growth GROUP BY ALL) g USING (site)""",
)
def l15(t):
    return climatology.build_references(staged(t.daily_key(t.daily_means()), "daily"), (24,))


SNOW_OK = "(SELECT s_suppkey AS station, s_nationkey AS basin FROM supplier WHERE s_suppkey % 4 <> 1)"


def snow_sites(t):
    """(station, basin) of the stations that a basin's snow context reads."""
    k = F.col("station")
    code = F.format_string("1711%04d", "basin")
    assoc = F.when(k % 4 == 1, F.array(F.lit("99990001"))).otherwise(F.array(code))
    stations = t.stations().select("station", code.alias("huc"), assoc.alias("associated"), F.col("basin").alias("b")).drop("b")
    basins = t.basins().select("basin", F.array(F.format_string("1711%04d", "basin")).alias("huc8"))
    return snow.assign_basins(stations, basins).filter(~F.col("verdict").eqNullSafe(F.lit(snow.OUTSIDE_DOMAIN))).select("station", "basin")


@query(
    "L16_snow_context",
    f"""WITH r AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, max(l_quantity) AS value, CASE WHEN min(l_linenumber) = 1 THEN NULL ELSE floor(max(l_extendedprice) / 10000) - 1 END AS median, CASE WHEN min(l_linenumber) = 2 THEN 'S' END AS qc FROM lineitem GROUP BY ALL), s AS {SNOW_OK}, d AS (SELECT basin, max(day) AS day FROM r JOIN s USING (station) GROUP BY ALL)
      SELECT s.basin, count(*) AS n_mapped, count_if(r.value IS NOT NULL AND coalesce(r.qc, 'V') <> 'S' AND r.median > 0) AS n_used, round(avg(CASE WHEN coalesce(r.qc, 'V') <> 'S' AND r.median > 0 THEN 100.0::DOUBLE * r.value / r.median END), 1) AS swe_pct FROM s JOIN d USING (basin) LEFT JOIN r ON r.station = s.station AND r.day = d.day GROUP BY s.basin""".replace("count_if(r.value IS NOT NULL AND", "count_if(coalesce(r.value IS NOT NULL AND").replace("r.median > 0) AS n_used", "r.median > 0, false)) AS n_used"),
)
def l16(t):
    out = snow.swe_percent_of_median(snow_readings(t), snow_sites(t))
    return out.select("basin", "n_mapped", "n_used", F.col("value").alias("swe_pct"))


# Susceptibility in company: the published ladder lowers confidence, snow stands beside the score and never in it.
BINDINGS["b_pubp"] = """SELECT l_suppkey AS site, datediff('day', DATE '2000-01-01', make_date(2000, month(l_shipdate), day(l_shipdate))) AS doy, max(l_quantity) AS published FROM lineitem WHERE l_linenumber = 3 AND l_quantity > 3 GROUP BY ALL"""
BINDINGS["b_sdis"] = """SELECT s.*, l.p50, CASE WHEN abs((l.p50 - published) / published) > 0.1 THEN round((l.p50 - published) / published * 100 + 1e-9, 1) END AS off FROM b_susc s LEFT JOIN b_slad l ON l.site = s.site AND l.key = s.doy LEFT JOIN b_pubp p ON p.site = s.site AND p.doy = s.doy"""
BINDINGS["b_sread"] = f"""SELECT r.* FROM (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, max(l_quantity) AS value, CASE WHEN min(l_linenumber) = 1 THEN NULL ELSE floor(max(l_extendedprice) / 10000) - 1 END AS median, CASE WHEN min(l_linenumber) = 2 THEN 'S' END AS qc FROM lineitem GROUP BY ALL) r WHERE day < CAST(TIMESTAMP '{S_T}' AS DATE)"""
BINDINGS["b_swet"] = f"""SELECT s.basin, d.day, round(avg(CASE WHEN coalesce(r.qc, 'V') <> 'S' AND r.median > 0 THEN 100.0::DOUBLE * r.value / r.median END), 1) AS value FROM {SNOW_OK} s JOIN (SELECT basin, max(day) AS day FROM b_sread JOIN {SNOW_OK} s USING (station) GROUP BY ALL) d USING (basin) LEFT JOIN b_sread r ON r.station = s.station AND r.day = d.day
  WHERE d.day >= TIMESTAMP '{S_T}' - INTERVAL 7 DAY GROUP BY s.basin, d.day"""
BINDINGS["b_spre"] = f"""SELECT s.basin, d.day, round(avg(CASE WHEN coalesce(a.qc, 'V') <> 'S' AND coalesce(b.qc, 'V') <> 'S' AND a.value >= b.value AND a.median > b.median THEN 100.0::DOUBLE * (a.value - b.value) / (a.median - b.median) END), 1) AS value FROM {SNOW_OK} s JOIN (SELECT basin, max(day) AS day FROM b_sread JOIN {SNOW_OK} s USING (station) GROUP BY ALL) d USING (basin)
  LEFT JOIN b_sread a ON a.station = s.station AND a.day = d.day LEFT JOIN b_sread b ON b.station = s.station AND b.day = d.day - 14 WHERE d.day >= TIMESTAMP '{S_T}' - INTERVAL 7 DAY GROUP BY s.basin, d.day"""
BINDINGS["b_sgrid"] = f"""SELECT vec_id AS field, valid AS clock FROM (SELECT vec_id, TIMESTAMP '{S_T}' - to_days(CAST(vec_id % 11 + 1 AS INTEGER)) AS valid FROM embeddings) WHERE valid + to_days(CAST(vec_id % 5 AS INTEGER)) <= TIMESTAMP '{S_T}' AND valid >= TIMESTAMP '{S_T}' - INTERVAL 7 DAY ORDER BY valid DESC, vec_id % 5 DESC, vec_id DESC LIMIT 1"""
BINDINGS["b_sfield"] = f"""SELECT basin, clock, CASE WHEN wv / ws >= 0.93 THEN tot / wv END AS swe_mm, CASE WHEN wv / ws >= 0.93 THEN snowy / wv END AS covered FROM (SELECT basin, clock, any_value(w) AS ws, coalesce(sum(CASE WHEN value >= 0 AND value <> 32767 THEN weight END), 0) AS wv, sum(CASE WHEN value >= 0 AND value <> 32767 THEN value * weight END) AS tot,
  coalesce(sum(CASE WHEN value > 0 AND value <> 32767 THEN weight END), 0) AS snowy FROM {grids.SNOW_SQL} JOIN b_sgrid USING (field) JOIN b_mask USING (flat_index) JOIN b_masktotal USING (basin) GROUP BY basin, clock)"""


def published_medians(t):
    """(site, doy, published_p50) of the published day-of-year table."""
    level = F.element_at(F.array(*[F.lit(x) for x in (10, 25, 50, 75, 90, 95, 5)]), F.col("l_linenumber"))
    rows = t.lineitem().select(
        F.col("l_suppkey").alias("site"), F.month("day").alias("month"), F.dayofmonth("day").alias("dom"), F.year("day").alias("year"),
        level.alias("level"), F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("value"),
    )
    day = F.make_date(F.lit(2000), F.col("month"), F.col("dom"))
    return gauges.published_ladder(rows).select("site", doy_index(day).alias("doy"), F.try_element_at("ladder", F.lit(50)).alias("published_p50"))


def checked_susceptibility(t, version="0.2.0"):
    return susceptibility.assess(s_daily(t), F.lit(S_T).cast("timestamp"), ceilings(t), 86400, 14400, version, published_medians(t))


@query(
    "L3_checked_confidence",
    "SELECT site, reason, CASE WHEN reason <> 'ok' THEN 'unknown' WHEN off IS NULL THEN confidence WHEN confidence = 'high' THEN 'moderate' ELSE 'low' END AS confidence, CASE WHEN reason = 'ok' THEN off END AS disagreement_pct FROM b_sdis",
)
def l3_checked(t):
    """Confidence lowered one level where the built and the published ladder differ by more than a tenth."""
    return checked_susceptibility(t, "0.1.0").select("site", "reason", "confidence", "disagreement_pct")


def snow_context_rows(t):
    """Station and grid snow as known at the time, newest per basin: percent of median, its 14-day precipitation, gridded means."""
    at = F.lit(S_T).cast("timestamp")
    readings = staged(snow_readings(t).filter(F.col("day") < at.cast("date")), "snow-readings")
    sites = snow_sites(t)
    clocked = lambda df: susceptibility.current_context(df.select("basin", F.col("day").cast("timestamp").alias("clock"), F.col("day").cast("timestamp").alias("known_at"), "value"), at)
    valid = plus_hours(at, (F.col("field") % 11 + 1) * -24)
    fields = t.read("embeddings").select(F.col("vec_id").alias("field")).select("field", valid.alias("clock"), plus_hours(valid, F.col("field") % 5 * 24).alias("known_at"))
    # a field answers for every basin, so the newest one is chosen before any cell is read
    newest = susceptibility.current_context(fields.withColumn("basin", F.lit(0)), at).select("field", "clock")
    cells = t.delivered_cells().withColumn("value", grids.snow_coded()).join(newest.select("field"), "field", "left_semi")
    zones = t.basins().select("basin", (F.col("basin") % 6).alias("zone"))  # the mask has six zones
    grid = zonal.snow_stats(cells, t.mask()).withColumnRenamed("basin", "zone").join(newest, "field").join(zones, "zone").select("basin", "clock", F.col("mean").alias("swe_mm"), F.col("snow_covered_fraction").alias("covered"))
    return clocked(snow.swe_percent_of_median(readings, sites)), clocked(snow.precipitation_percent_of_median(readings, sites)), grid


@query(
    "L3_susceptibility_drivers",
    """WITH g AS (SELECT s.*, s.value / a.value AS up, s.value / b.value AS upp, n.s_nationkey AS basin FROM b_sdis s LEFT JOIN b_sday a ON a.site = s.site AND a.day = s.day - 1 LEFT JOIN b_sday b ON b.site = s.site AND b.day = s.day - 2 LEFT JOIN supplier n ON n.s_suppkey = s.site WHERE s.reason = 'ok'),
      d AS (SELECT site, 1 AS place, 'streamflow_doy_percentile' AS feature, p AS value, 'pct' AS unit, 'increases_susceptibility' AS direction, day::TIMESTAMP AS clock FROM g UNION ALL SELECT site, 2, 'streamflow_seasonal_multiple', round(value / p95 + 1e-9, 3), 'x', 'level_not_scored', day FROM g WHERE p95 > 0
        UNION ALL SELECT site, 3, 'streamflow_growth_24h', round(up + 1e-9, 3), 'x', 'state_change_not_scored', day FROM g WHERE up > 0 UNION ALL SELECT site, 4, 'streamflow_growth_48h', round(upp + 1e-9, 3), 'x', 'state_change_not_scored', day FROM g WHERE upp > 0
        UNION ALL SELECT site, 20, 'basin_swe_percent_of_median', x.value, 'pct', 'context_not_scored', x.day FROM g LEFT JOIN b_swet x USING (basin) UNION ALL SELECT site, 25, 'basin_swe_mm', swe_mm, 'mm', 'context_not_scored', f.clock FROM g JOIN b_sfield f ON f.basin = g.basin % 6
        UNION ALL SELECT site, 26, 'basin_snow_covered_fraction', round(covered * 100 + 1e-9, 2), 'pct', 'context_not_scored', f.clock FROM g JOIN b_sfield f ON f.basin = g.basin % 6 WHERE covered IS NOT NULL UNION ALL SELECT site, 30, 'snotel_precip_14d_percent_of_median', x.value, 'pct', 'context_not_scored', x.day FROM g LEFT JOIN b_spre x USING (basin)
        UNION ALL SELECT site, 40, 'soil_saturation_percentile', NULL, 'pct', 'unavailable', NULL FROM b_susc UNION ALL SELECT site, 50, 'climatology_p50_disagreement', off, 'pct', 'lowers_confidence', day FROM g WHERE off IS NOT NULL)
      SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY place) AS INTEGER) AS rank, feature, round(value, 6) AS value, unit, direction, CAST(clock AS VARCHAR) AS clock FROM d""",
)
def l3_drivers(t):
    """What each gauge's susceptibility rests on and what stands beside it, ranked, each with its own clock."""
    sites = t.stations().select(F.col("station").alias("site"), "basin")
    return susceptibility.drivers(checked_susceptibility(t), sites, *snow_context_rows(t))


@query(
    "L17_basin_grid_job",
    """WITH g AS (SELECT field, basin, sum(weight) AS wv, sum(abs(value) * weight) AS total FROM b_gap JOIN b_mask USING (flat_index) GROUP BY ALL) SELECT field, basin, round(CASE WHEN wv / w >= 0.995 THEN total / wv END, 6) AS value FROM g JOIN b_masktotal USING (basin) WHERE NOT (field % 3 = 0 AND basin < 3)""",
)
def l17(t):
    """Zonal means of all fields, of which only the (field, basin) pairs not yet stored are appended."""
    cells = t.delivered_cells().withColumn("value", F.abs("value"))
    means = zonal.radar_stats(cells, t.mask()).select("field", "basin", F.col("mean").alias("value"))
    stored = means.filter("field % 3 = 0 AND basin < 3").select("field", "basin")
    return revisions.absent(means, stored, ["field", "basin"], [F.asc("value")])


def grid_job(t, name, columns):
    """One gridded product's job: every listed field answers for every basin, and pairs not yet stored are appended, refusals too."""
    done = GRID_INPUTS[name](t, t.grid_cells().select("field").distinct())
    stored = done.filter("field % 3 = 0 AND basin < 3").select("field", "basin")
    return revisions.absent(done, stored, ["field", "basin"], [F.asc("cell_count")]).select("field", "basin", *columns)


GRID_INPUTS = {
    "strict": lambda t, fields: zonal.strict_mean(t.delivered_cells(), t.mask(), None, F.col("value") < -400, fields),
    "snow": lambda t, fields: zonal.snow_stats(t.delivered_cells().withColumn("value", grids.snow_coded()), t.mask(), fields),
    "forecast": lambda t, fields: zonal.forecast_stats(t.delivered_cells().withColumn("value", grids.rain_coded()), t.mask(), fields),
}
GRID_JOBS = {
    "L17_strict_grid_job": ("strict", "E9_strict_zonal_mean", ["value", "missing_cells", "reason"]),
    "L17_snow_grid_job": ("snow", "E11_snow_zonal", ["mean", "snow_covered_fraction", "flags"]),
    "L17_forecast_grid_job": ("forecast", "E12_forecast_zonal", ["mean", "negative_clamped_cells", "flags"]),
}
for _name, (_input, _of, _columns) in GRID_JOBS.items():
    query(_name)(lambda t, i=_input, c=_columns: grid_job(t, i, c))
    ORACLES[_name] = f"SELECT field, basin, {', '.join(_columns)} FROM ({ORACLES[_of]}) WHERE NOT (field % 3 = 0 AND basin < 3)"


@query(
    "L18_ensemble_archive",
    """WITH p AS (SELECT run_id, fp, issued_at, valid_time, max(flow) AS v FROM b_val WHERE run_id % 3 <> 0 GROUP BY ALL), s AS (SELECT *, epoch(valid_time) - epoch(lag(valid_time) OVER (PARTITION BY run_id ORDER BY valid_time)) AS st FROM p),
      e AS (SELECT run_id, any_value(fp) AS fp, any_value(issued_at) AS issued_at, count(*) AS n, CASE WHEN count(*) >= 2 AND count(DISTINCT st) = 1 THEN 'grid' ELSE 'points' END AS encoding FROM s GROUP BY run_id)
      SELECT run_id, fp, encoding, lag(run_id) OVER (PARTITION BY fp ORDER BY issued_at, run_id) AS supersedes FROM e""",
)
def l18(t):
    """Retained cycles that are not stored yet, encoded per series and linked to the cycle they supersede."""
    # what is missing is decided on the headers; the values of those runs are then read once
    retained = t.forecast_runs().select("run_id", "fp", "issued_at")
    stored = retained.filter("run_id % 3 = 0").select("run_id")
    missing = retained.join(stored, "run_id", "left_anti")
    series = t.run_values(missing, most=True).groupBy("run_id", F.col("valid_time").alias("t")).agg(F.max("flow").alias("v"))
    enc = hydrograph.encode(series, ["run_id"]).select("run_id", "encoding")
    return revisions.link_supersession(missing.join(enc, "run_id"), ["fp"]).select("run_id", "fp", "encoding", "supersedes")


@query(
    "L21_station_snapshot",
    f"""WITH o AS (SELECT * FROM b_obs WHERE available_at <= TIMESTAMP '{T}' AND valid_time BETWEEN TIMESTAMP '{T}' - INTERVAL 14 DAY AND TIMESTAMP '{T}' QUALIFY row_number() OVER (PARTITION BY station ORDER BY valid_time DESC, id DESC) = 1)
      , h AS (SELECT station, string_agg(printf('%s=%d', strftime(t, '%m-%d %H'), v), '|' ORDER BY t) AS series FROM (SELECT station, date_trunc('hour', valid_time) AS t, CAST(round(max(value) * 100) AS BIGINT) AS v FROM b_obs
        WHERE available_at <= TIMESTAMP '{T}' AND valid_time > TIMESTAMP '{T}' - INTERVAL 24 HOUR AND valid_time <= TIMESTAMP '{T}' GROUP BY ALL) GROUP BY station),
      r AS (SELECT s_nationkey AS basin, count(*) AS snow_stations, count_if(DATE '2001-10-20' - day <= 3) AS snow_fresh FROM (SELECT l_suppkey AS station, CAST(max(l_shipdate) AS DATE) AS day FROM lineitem GROUP BY ALL) JOIN supplier ON s_suppkey = station GROUP BY ALL)
      SELECT station, value, CASE WHEN station % 5 = 0 THEN 'unknown' WHEN value >= 200 THEN 'flood' WHEN value >= 100 THEN 'elevated' WHEN value >= 50 THEN 'watch' ELSE 'calm' END AS risk, epoch(TIMESTAMP '{T}') - epoch(valid_time) > 90 * 60 AS stale,
        coalesce(series, '') AS series, snow_stations, snow_fresh, CASE WHEN snow_stations IS NULL THEN 'no_mapping' WHEN snow_fresh = 0 THEN 'stale' ELSE 'available' END AS precursors
      FROM o LEFT JOIN h USING (station) LEFT JOIN supplier ON s_suppkey = station LEFT JOIN r ON r.basin = s_nationkey""",
)
def l21(t):
    from fluvion.catalog.joins import known

    s = selection.newest(known(t, numbered=False), ["station"], [F.desc("valid_time"), F.desc("id")])
    ok = F.col("station") % 5 != 0
    risk = flood.prototype_risk(F.col("value"), levels(), ok, F.lit("configured_pending"))
    s = s.select("station", "value", risk.alias("risk"), values.is_stale(now(), F.col("valid_time")).alias("stale"))
    # one value per hour of the last day, so a station's series is bounded however often it reports
    day = known(t, 24, numbered=False).filter(F.col("valid_time") > plus_hours(now(), -24))
    hourly = day.groupBy("station", F.date_trunc("hour", "valid_time").alias("t")).agg(F.round(F.max("value") * 100).cast("long").alias("v"))
    point = F.concat(F.date_format("t", "MM-dd HH"), F.lit("="), F.col("v").cast("string"))
    series = hourly.groupBy("station").agg(F.sort_array(F.collect_list(point)).alias("series"))
    signal = snow.prototype_signal(prototype_readings(t), F.lit("2001-10-20").cast("date")).join(t.stations(), "station")
    fresh = signal.groupBy("basin").agg(F.count(F.lit(1)).alias("snow_stations"), F.count_if(~F.col("stale")).alias("snow_fresh"))
    mapped = t.stations().select("station", "basin").join(fresh, "basin", "left")
    state = F.when(F.col("snow_stations").isNull(), "no_mapping").when(F.col("snow_fresh") == 0, "stale").otherwise("available")
    j = s.join(series, "station", "left").join(mapped, "station", "left")
    empty = F.array().cast("array<string>")
    return j.select("station", "value", "risk", "stale", F.coalesce("series", empty).alias("series"), "snow_stations", "snow_fresh", state.alias("precursors"))


LEVEL_ROWS_SQL = "(SELECT point, max(level) FILTER (category = 'action') AS action, max(level) FILTER (category = 'minor') AS minor, max(level) FILTER (category = 'moderate') AS moderate, max(level) FILTER (category = 'major') AS major FROM b_plevel GROUP BY ALL)"


@query(
    "L21_dated_levels",
    f"""WITH o AS (SELECT * FROM b_obs WHERE available_at <= TIMESTAMP '{T}' AND valid_time BETWEEN TIMESTAMP '{T}' - INTERVAL 14 DAY AND TIMESTAMP '{T}' QUALIFY row_number() OVER (PARTITION BY station ORDER BY valid_time DESC, id DESC) = 1),
      j AS (SELECT o.station, o.value, l.*, coalesce(action, minor, moderate, major) IS NULL AS bare, o.station % 5 <> 0 AS valid FROM o LEFT JOIN {LEVEL_ROWS_SQL} l ON l.point = o.station)
      SELECT station, value, action, minor, moderate, major, CASE WHEN value IS NULL OR NOT valid OR bare THEN 'unknown' WHEN value >= major OR value >= moderate THEN 'flood' WHEN value >= minor THEN 'elevated' WHEN value >= action THEN 'watch' ELSE 'calm' END AS risk,
        CASE WHEN value IS NULL THEN 'no_stage' WHEN NOT valid THEN 'thresholds_pending' WHEN bare THEN 'thresholds_empty' WHEN value >= major THEN 'above_major' WHEN value >= moderate THEN 'above_moderate' WHEN value >= minor THEN 'above_minor' WHEN value >= action THEN 'above_action' ELSE 'below_action' END AS reason FROM j""",
)
def l21_dated(t):
    """Station risk by the levels in force and known at the time; a station without any is unknown and says so."""
    from fluvion.catalog.joins import known

    s = selection.newest(known(t, numbered=False), ["station"], [F.desc("valid_time"), F.desc("id")]).select("station", "value")
    own = point_levels(t).drop("level_sources").withColumnRenamed("point", "station")
    args = (F.col("value"), flood.level_columns(), F.col("station") % 5 != 0, F.lit("configured_pending"))
    return s.join(own, "station", "left").select("station", "value", *flood.CATEGORIES, flood.prototype_risk(*args).alias("risk"), flood.prototype_reason(*args).alias("reason"))


def prototype_readings(t):
    return t.lineitem().groupBy(F.col("l_suppkey").alias("station"), "day").agg(F.max("l_quantity").alias("value")).withColumn("mapping_confidence", F.lit("high"))


@query(
    "L22_flood_zones",
    f"""WITH q AS (SELECT ring_id, cx, cy, abs((-9.5 * -2.75 - 8.0 * -1.0) + (8.0 * 1.5 - 11.0 * -2.75) + (11.0 * 2.875 + 4.0 * 1.5) + (-4.0 * -1.0 + 9.5 * 2.875)) / 2 * (ring_id % 4) / 3 AS area FROM (SELECT s_suppkey AS ring_id, (s_suppkey * 37 % 480) + 10.25::DOUBLE AS cx, (s_suppkey * 7 % 18) + 3.125::DOUBLE AS cy FROM supplier)),
      v AS (SELECT ring_id, cx + dx * sqrt((ring_id % 4) / 3.0::DOUBLE) AS x, cy + dy * sqrt((ring_id % 4) / 3.0::DOUBLE) AS y FROM q, (VALUES (-9.5, -1.0), (8.0, -2.75), (11.0, 1.5), (-4.0, 2.875)) AS c(dx, dy)),
      b AS (SELECT n_nationkey AS box, n_nationkey * 19 - 1.5 AS west, n_nationkey * 19 + 24.5 AS east, (n_nationkey * 5 % 18) AS south, (n_nationkey * 5 % 18) + 9.5 AS north FROM nation)
      SELECT b.box, v.ring_id, round(any_value(q.area), 6) AS area FROM v JOIN q USING (ring_id) JOIN b ON x BETWEEN west AND east AND y BETWEEN south AND north WHERE q.area > 1e-6 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY b.box, v.ring_id"),
)
def l22(t):
    from fluvion.operators import geometry

    k = F.col("s_suppkey")
    scale = F.sqrt((k % 4) / F.lit(3.0))
    cx, cy = (k * 37 % 480).cast("double") + 10.25, (k * 7 % 18).cast("double") + 3.125
    ring = F.array(*[F.struct((cx + scale * dx).alias("x"), (cy + scale * dy).alias("y")) for dx, dy in ((-9.5, -1.0), (8.0, -2.75), (11.0, 1.5), (-4.0, 2.875))])
    zones = t.read("supplier").select(k.alias("ring_id"), ring.alias("path")).withColumn("area", F.abs(geometry.signed_area(F.col("path")))).filter("area > 1e-6")
    n = F.col("basin")
    boxes = t.basins().select(n.alias("box"), (n * 19 - 1.5).alias("west"), (n * 19 + 24.5).alias("east"), (n * 5 % 18).cast("double").alias("south"), (n * 5 % 18 + 9.5).alias("north"))
    return cameras.zones_touching(zones, boxes, "ring_id", cell=12.0).select("box", "ring_id", "area")


@query(
    "L25_latest_field_or_reason",
    f"""WITH f AS (SELECT user_id % 12 AS layer, event_id AS id, ts FROM events WHERE ts BETWEEN TIMESTAMP '{T}' - INTERVAL 1 HOUR AND TIMESTAMP '{T}' QUALIFY row_number() OVER (PARTITION BY user_id % 12 ORDER BY ts DESC, event_id DESC) = 1)
      SELECT n_nationkey AS layer, n_name AS product, n_regionkey AS source, coalesce(r_name, 'UNKNOWN') AS kind, f.id, CAST(f.ts AS VARCHAR) AS valid_time, round((epoch_us(TIMESTAMP '{T}') - epoch_us(f.ts)) / 1e6::DOUBLE, 6) AS age_s, g.nx, g.ny,
        CASE WHEN f.id IS NULL THEN 'no_field_within_lookback' WHEN g.nx IS NULL THEN 'grid_unknown' ELSE 'ok' END AS reason FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN f ON f.layer = n_nationkey
        LEFT JOIN (SELECT grid_hash, 8::INTEGER AS nx, CAST(ceil((max(flat_index) + 1) / 8) AS INTEGER) AS ny FROM b_cell GROUP BY grid_hash) g ON g.grid_hash = f.layer""",
)
def l25(t):
    inside = F.col("ts").between(plus_hours(now(), -1), now())
    f = selection.newest(t.events().filter(inside).withColumn("layer", (F.col("user_id") % 12).cast("int")), ["layer"], [F.desc("ts"), F.desc("event_id")])
    products = t.basins().select(F.col("basin").alias("layer"), F.col("basin_name").alias("product"), "source").join(t.sources(), "source", "left")
    f = f.select("layer", F.col("event_id").alias("id"), F.col("ts").alias("valid_time"))
    # the cell table is eight columns wide; the grid of a layer is the extent of its cells
    grids = t.grid_cells().groupBy(F.col("grid_hash").alias("_grid")).agg(F.lit(8).alias("nx"), F.ceil((F.max("flat_index") + 1) / 8).cast("int").alias("ny"))
    j = products.join(f.join(grids, F.col("layer") == F.col("_grid"), "left"), "layer", "left")
    reason = F.when(F.col("id").isNull(), "no_field_within_lookback").when(F.col("nx").isNull(), "grid_unknown").otherwise("ok")
    age = (F.unix_micros(now()) - F.unix_micros("valid_time")) / 1e6
    return j.select("layer", "product", "source", F.coalesce("kind", F.lit("UNKNOWN")).alias("kind"), "id", "valid_time", age.alias("age_s"), "nx", "ny", reason.alias("reason"))


@query(
    "L28_snow_layer_status",
    """WITH r AS (SELECT l_suppkey AS station, CAST(max(l_shipdate) AS DATE) AS day FROM lineitem GROUP BY ALL) SELECT s_nationkey AS basin, count(*) AS stations, count_if(DATE '2001-10-20' - day <= 3) AS n_fresh, CASE WHEN count_if(DATE '2001-10-20' - day <= 3) = 0 THEN 'stale' WHEN count_if(DATE '2001-10-20' - day > 3) = 0 THEN 'ok' ELSE 'partial' END AS status FROM r JOIN supplier ON s_suppkey = station GROUP BY ALL""",
)
def l28(t):
    sig = snow.prototype_signal(prototype_readings(t), F.lit("2001-10-20").cast("date")).join(t.stations(), "station")
    g = sig.groupBy("basin").agg(F.count(F.lit(1)).alias("stations"), F.count_if(~F.col("stale")).alias("n_fresh"))
    status = F.when(F.col("n_fresh") == 0, "stale").when(F.col("n_fresh") == F.col("stations"), "ok").otherwise("partial")
    return g.withColumn("status", status)

"""Scalar functions, exercised over whole tables."""

from pyspark.sql import functions as F

from fluvion.catalog.aggregates import daily
from fluvion.catalog.expressions import T, now
from fluvion.catalog.joins import known
from fluvion.catalog.registry import TIE, query
from fluvion.catalog.series import pct_case
from fluvion.functions import bands, clocks, flood, geo, labels, values
from fluvion.operators import doy, geometry, selection
from fluvion.sources.bindings import Tables


@query(
    "I1_calendar",
    """SELECT DISTINCT CAST(d AS VARCHAR) AS day, CAST(CASE WHEN month(d) >= 10 THEN year(d) + 1 ELSE year(d) END AS INTEGER) AS water_year, strftime(d, '%m-%d') AS key, CAST(datediff('day', DATE '2000-01-01', make_date(2000, month(d), day(d))) AS INTEGER) AS idx, month(d) IN (11, 12, 1, 2) AS winter
      FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)""",
)
def i1(t):
    d = F.col("day")
    return t.lineitem().select("day").distinct().select(
        "day", clocks.water_year(d).alias("water_year"), clocks.doy_key(d).alias("key"), clocks.doy_index(d).alias("idx"), clocks.is_winter(d).alias("winter")
    )


@query(
    "I2_seasonal_multiple",
    """SELECT DISTINCT w.site, CAST(w.day AS VARCHAR) AS day, round(CASE WHEN p95 > 0 THEN value / p95 END, 6) AS multiple FROM b_win w LEFT JOIN b_lad l ON l.site = w.site AND l.key = w.doy""",
)
def i2(t):
    d = daily(t)
    j = d.join(doy.ladder(d).withColumnRenamed("key", "doy"), ["site", "doy"], "left")
    return j.select("site", "day", bands.seasonal_multiple(F.col("value"), F.col("p95")).alias("multiple"))


PCT_SQL = f"(SELECT DISTINCT w.site, w.day, l.n, round({pct_case('w.value')} + 1e-9, 1) AS p FROM b_win w JOIN b_lad l ON l.site = w.site AND l.key = w.doy)"
BAND_SQL = lambda v: f"CASE WHEN {v} < 25 THEN 'low' WHEN {v} < 75 THEN 'moderate' WHEN {v} < 90 THEN 'high' ELSE 'very_high' END"


def ranked_days(t):
    d = daily(t)
    j = d.join(doy.ladder(d).withColumnRenamed("key", "doy"), ["site", "doy"])
    return j.withColumn("p", F.round(doy.percentile_of(F.col("value")) + TIE, 1))


@query(
    "I3_sampling_error",
    f"""SELECT site, CAST(day AS VARCHAR) AS day, CAST(greatest(1, n // 5) AS INTEGER) AS years, round(100 * sqrt(p / 100 * (1 - p / 100) / greatest(1, n // 5)), 6) AS se FROM {PCT_SQL}""",
)
def i3(t):
    y = bands.independent_years(F.col("n"))
    return ranked_days(t).select("site", "day", y.alias("years"), bands.rank_standard_error(F.col("p"), y).alias("se"))


@query(
    "I4_band_boundary",
    f"""SELECT site, CAST(day AS VARCHAR) AS day, {BAND_SQL('p')} AS band, CASE WHEN {BAND_SQL('greatest(0, p - se)')} = {BAND_SQL('least(100, p + se)')} THEN 'separated' ELSE 'near_band_edge' END AS boundary,
      CASE WHEN {BAND_SQL('greatest(0, p - se)')} = {BAND_SQL('least(100, p + se)')} THEN '' ELSE array_to_string(list_filter(['low', 'moderate', 'high', 'very_high'], lambda x: list_position(['low', 'moderate', 'high', 'very_high'], x) BETWEEN
        list_position(['low', 'moderate', 'high', 'very_high'], {BAND_SQL('greatest(0, p - se)')}) AND list_position(['low', 'moderate', 'high', 'very_high'], {BAND_SQL('least(100, p + se)')})), '|') END AS within
      FROM (SELECT *, 100 * sqrt(p / 100 * (1 - p / 100) / greatest(1, n // 5)) AS se FROM {PCT_SQL})""",
)
def i4(t):
    se = bands.rank_standard_error(F.col("p"), bands.independent_years(F.col("n")))
    df = ranked_days(t).withColumn("se", se)
    return df.select("site", "day", bands.band(F.col("p")).alias("band"), bands.boundary(F.col("p"), F.col("se")).alias("boundary"), bands.bands_within_error(F.col("p"), F.col("se")).alias("within"))


@query(
    "I5_rain_bands",
    """SELECT event_id AS id, CASE WHEN value < 25 THEN 'low' WHEN value < 75 THEN 'moderate' WHEN value < 150 THEN 'high' ELSE 'very_high' END AS level, round(CASE WHEN v <= 25 THEN v / 25 / 4 WHEN v <= 75 THEN (1 + (v - 25) / 50) / 4 WHEN v <= 150 THEN (2 + (v - 75) / 75) / 4 ELSE (3 + (v - 150) / 50) / 4 END, 6) AS score
      FROM (SELECT *, least(greatest(value, 0), 200) AS v FROM events)""",
)
def i5(t):
    v = F.col("value")
    return t.events().select(F.col("event_id").alias("id"), bands.band(v, bands.RAIN_EDGES_MM).alias("level"), bands.piecewise_score(v).alias("score"))


@query(
    "I6_flood_category",
    """SELECT id, coalesce(any_value(c.category), 'none') AS category FROM b_obs o LEFT JOIN LATERAL (SELECT category FROM b_lvl WHERE lvl <= o.value ORDER BY ord DESC LIMIT 1) c ON true GROUP BY id""",
)
def i6(t):
    return Tables.with_levels(t.observations()).select("id", flood.category(F.col("value"), flood.level_columns()).alias("category"))


@query(
    "I7_headroom",
    """SELECT id, round(min(lvl) - any_value(value), 6) AS room, coalesce(arg_min(category, lvl), 'major') AS next, round(CASE WHEN any_value(id) % 3 = 0 THEN (min(lvl) - any_value(value)) / 2.5 END, 6) AS hours,
      CASE WHEN min(lvl) IS NULL THEN 'above_highest_category' WHEN id % 3 <> 0 THEN 'needs_rising_trend' ELSE 'ok' END AS reason FROM b_obs o LEFT JOIN b_lvl l ON l.lvl > o.value GROUP BY id""",
)
def i7(t):
    df, lv, v = Tables.with_levels(t.observations()), flood.level_columns(), F.col("value")
    d = F.when(F.col("id") % 3 == 0, "rising").otherwise("steady")
    room = flood.headroom(v, lv)
    return df.select(
        "id", room.alias("room"), flood.next_category(v, lv).alias("next"), flood.hours_to_level(room, F.lit(2.5), d).alias("hours"),
        F.coalesce(flood.headroom_reason(v, lv, F.lit(2.5), d), F.lit("ok")).alias("reason"),
    )


@query(
    "I8_prototype_risk",
    """SELECT event_id AS id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 'unknown' WHEN value >= 200 THEN 'flood' WHEN value >= 100 THEN 'elevated' WHEN value >= 50 THEN 'watch' ELSE 'calm' END AS risk,
      CASE WHEN event_id % 7 = 0 THEN 'no_stage' WHEN event_id % 5 = 0 THEN 'thresholds_pending' WHEN value >= 400 THEN 'above_major' WHEN value >= 200 THEN 'above_moderate' WHEN value >= 100 THEN 'above_minor' WHEN value >= 50 THEN 'above_action' ELSE 'below_action' END AS reason FROM events""",
)
def i8(t):
    df, lv = Tables.with_levels(t.events()), flood.level_columns()
    i = F.col("event_id")
    args = (F.when(i % 7 != 0, F.col("value")), lv, i % 5 != 0, F.when(i % 5 == 0, "configured_pending").otherwise("official"))
    return df.select(i.alias("id"), flood.prototype_risk(*args).alias("risk"), flood.prototype_reason(*args).alias("reason"))


@query(
    "I9_category_steps",
    """WITH c AS (SELECT station, valid_time, variable, CASE WHEN max(value) >= 400 THEN 4 WHEN max(value) >= 200 THEN 3 WHEN max(value) >= 100 THEN 2 WHEN max(value) >= 50 THEN 1 ELSE 0 END AS k FROM b_obs GROUP BY ALL)
      SELECT a.station, CAST(a.valid_time AS VARCHAR) AS valid_time, abs(a.k - b.k) AS steps FROM c a JOIN c b ON a.station = b.station AND a.valid_time = b.valid_time AND a.variable = 'view' AND b.variable = 'click'""",
)
def i9(t):
    c = Tables.with_levels(t.observations().groupBy("station", "valid_time", "variable").agg(F.max("value").alias("value")))
    c = c.select("station", "valid_time", "variable", flood.category(F.col("value"), flood.level_columns()).alias("cat"))
    b = c.filter("variable = 'click'").select("station", "valid_time", F.col("cat").alias("other"))
    return c.filter("variable = 'view'").join(b, ["station", "valid_time"]).select("station", "valid_time", flood.category_steps(F.col("cat"), F.col("other")).alias("steps"))


@query(
    "I10_median_disagreement",
    """WITH p AS (SELECT site, key, quantile_cont(value, 0.5) AS b FROM b_win WHERE year(day) >= 1998 GROUP BY ALL) SELECT l.site, l.key, round(CASE WHEN b <> 0 THEN (p50 - b) / b END, 6) AS disagreement FROM b_lad l LEFT JOIN p ON p.site = l.site AND p.key = l.key""",
)
def i10(t):
    from fluvion.catalog.series import doy_medians

    d = daily(t)
    j = doy.ladder(d).join(doy_medians(d.filter(F.year("day") >= 1998)), ["site", "key"], "left")
    return j.select("site", F.col("key").cast("long").alias("key"), values.relative_difference(F.col("p50"), F.col("published_p50")).alias("disagreement"))


@query(
    "I11_confidence",
    """WITH x AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low' ELSE 'unknown' END AS ceiling, CASE event_id % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'stale' ELSE 'missing' END AS f FROM events),
      y AS (SELECT *, CASE f WHEN 'current' THEN 3 WHEN 'stale' THEN 1 ELSE 0 END AS fr, CASE ceiling WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS cr FROM x)
      SELECT id, ['unknown', 'low', 'moderate', 'high'][least(fr, cr) + 1] AS confidence, ['unknown', 'low', 'moderate', 'high'][greatest(1, least(fr, cr) - 1) + 1] AS lowered FROM y""",
)
def i11(t):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, " High ").when(i % 4 == 1, "moderate").when(i % 4 == 2, "LOW").otherwise("none")
    fresh = F.when(i % 3 == 0, "current").when(i % 3 == 1, "stale").otherwise("missing")
    c = bands.lowest_confidence(bands.confidence_ceiling(raw), bands.freshness_confidence(fresh))
    return t.events().select(i.alias("id"), c.alias("confidence"), bands.one_level_down(c).alias("lowered"))


@query(
    "I12_visual_intensity",
    f"""WITH a AS (SELECT station, max(valid_time) AS vt, arg_max(value, (valid_time, id)) AS v FROM b_obs WHERE available_at <= TIMESTAMP '{T}' AND valid_time BETWEEN TIMESTAMP '{T}' - INTERVAL 14 DAY AND TIMESTAMP '{T}' GROUP BY ALL)
      SELECT station, round(CASE WHEN vt >= TIMESTAMP '{T}' - INTERVAL 48 HOUR THEN round(least(v, 95.0), 1) / 100 END, 6) AS intensity FROM a""",
)
def i12(t):
    a = selection.newest(known(t, numbered=False), ["station"], [F.desc("valid_time"), F.desc("id")])
    return a.select("station", labels.visual_intensity(F.least("value", F.lit(95.0)), F.col("valid_time"), now()).alias("intensity"))


@query(
    "I13_grid_indices",
    """SELECT field, flat_index, flat_index % 8 AS i, CAST(flat_index // 8 AS INTEGER) AS j, CAST((flat_index // 8) * 8 + flat_index % 8 AS INTEGER) AS back, CASE WHEN value < 0 THEN value + 360.0 ELSE value END AS lon360 FROM b_cell""",
)
def i13(t):
    i, j = F.col("flat_index") % 8, F.floor(F.col("flat_index") / 8).cast("int")
    return t.grid_cells().select("field", "flat_index", i.alias("i"), j.alias("j"), geo.flat_index(i, j, 8).alias("back"), geo.lon360(F.col("value")).alias("lon360"))


LATLON = geo.LatLonGrid(nx=600, ny=400, la1=50.0, lo1=235.0, dlon=0.05, dlat=0.05)
LAMBERT = geo.LambertGrid(nx=2345, ny=1597, la1=19.229, lo1=-126.2766, latin1=25.0, latin2=25.0, lad=25.0, lov=-95.0, dx_m=2539.703, dy_m=2539.703)


@query(
    "I14_latlon_grid",
    """SELECT event_id AS id, round((lon + 360 - 235) / 0.05, 6) AS i, round((50 - lat) / 0.05, 6) AS j, round(power(radians(0.05) * 6371.229, 2) * cos(radians(50 - floor((50 - lat) / 0.05) * 0.05)), 6) AS area_km2
      FROM (SELECT event_id, -125 + value / 50 AS lon, 30.013 + hour(ts) / 2.0::DOUBLE AS lat FROM events)""".replace("0.05", "0.05::DOUBLE"),
)
def i14(t):
    lon, lat = F.lit(-125) + F.col("value") / 50, F.lit(30.013) + F.hour("ts") / 2.0
    i, j = LATLON.to_grid(lon, lat)
    return t.events().select(F.col("event_id").alias("id"), i.alias("i"), j.alias("j"), LATLON.cell_area_km2(F.floor(j)).alias("area_km2"))


_C, _S, _R0 = LAMBERT.cone, LAMBERT.rho_scale, LAMBERT.rho_at(LAMBERT.lad)
_X0, _Y0 = LAMBERT.origin()


@query(
    "I15_lambert_grid",
    f"""WITH p AS (SELECT event_id, -125 + value / 50 AS lon, 30.013 + hour(ts) / 2.0::DOUBLE AS lat FROM events), q AS (SELECT *, {_S!r} / power(tan(pi() / 4 + radians(lat) / 2), {_C!r}) AS rho, {_C!r} * radians(lon + 95.0) AS th FROM p)
      SELECT event_id AS id, round((rho * sin(th) - ({_X0!r})) / 2539.703, 4) AS i, round(({_R0!r} - rho * cos(th) - ({_Y0!r})) / 2539.703, 4) AS j, round(lon, 4) AS lon, round(lat, 4) AS lat, round(6.4500913282 / power({_C!r} * rho / (6371200 * cos(radians(lat))), 2), 4) AS area_km2 FROM q""".replace("6.4500913282", "(2539.703 * 2539.703 / 1e6)"),
)
def i15(t):
    lon, lat = F.lit(-125) + F.col("value") / 50, F.lit(30.013) + F.hour("ts") / 2.0
    p = t.events().select(F.col("event_id").alias("id"), lon.alias("lon"), lat.alias("lat"))
    i, j = LAMBERT.to_grid(F.col("lon"), F.col("lat"))
    g = p.select("id", i.alias("i"), j.alias("j"))
    back_lon, back_lat = LAMBERT.to_lonlat(F.col("i"), F.col("j"))
    r4 = lambda c: F.round(c, 4)
    return g.select("id", r4(F.col("i")).alias("i"), r4(F.col("j")).alias("j"), r4(back_lon).alias("lon"), r4(back_lat).alias("lat"), r4(LAMBERT.cell_area_km2(back_lat)).alias("area_km2"))


@query(
    "I16_local_distance",
    """SELECT event_id AS id, round(sqrt(power((0.01 + value / 10000) * 111320 * cos(radians(46 + hour(ts) / 10.0::DOUBLE)), 2) + power(0.02 * 111320, 2)), 3) AS metres FROM events""",
)
def i16(t):
    lat = F.lit(46) + F.hour("ts") / 10.0
    d = geo.local_distance_m(F.lit(-122.0), lat, F.lit(-122.0) + (F.lit(0.01) + F.col("value") / 10000), lat + 0.02)
    return t.events().select(F.col("event_id").alias("id"), F.round(d, 3).alias("metres"))


@query(
    "I17_labels",
    """SELECT o_orderkey AS id, o_orderkey % 130 || CASE WHEN o_orderkey % 130 % 100 BETWEEN 10 AND 20 THEN 'th' WHEN o_orderkey % 10 = 1 AND o_orderkey % 130 % 10 = 1 THEN 'st' WHEN o_orderkey % 130 % 10 = 1 THEN 'st' WHEN o_orderkey % 130 % 10 = 2 THEN 'nd' WHEN o_orderkey % 130 % 10 = 3 THEN 'rd' ELSE 'th' END AS rank_text,
      CASE WHEN o_orderkey % 3 = 0 THEN 'basin_qpf_' || (o_orderkey % 4 + 1) * 24 || 'h_deterministic' ELSE 'basin_qpf_' || (o_orderkey % 4 + 1) * 24 || 'h_pointwise_p' || o_orderkey % 95 END AS feature, (o_orderkey % 4 + 1) * 24 || 'h' AS window_label FROM orders""",
)
def i17(t):
    k = F.col("o_orderkey")
    w = (k % 4 + 1) * 24
    return t.read("orders").select(
        k.alias("id"), values.ordinal(k % 130).alias("rank_text"), labels.rain_feature(w, F.when(k % 3 != 0, k % 95)).alias("feature"), labels.window_label(w).alias("window_label")
    )


@query(
    "I20_nested_reads",
    """SELECT event_id AS id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'absent') AS missing FROM events""",
)
def i20(t):
    doc = F.from_json("props", "k int, missing string")
    return t.events().select(F.col("event_id").alias("id"), F.coalesce(doc["k"], F.lit(-1)).alias("k"), F.coalesce(doc["missing"], F.lit("absent")).alias("missing"))


@query(
    "I22_equal_area",
    """WITH v AS (SELECT s_suppkey AS ring_id, radians(-122.0 + dx) * cos(radians(46 + (s_suppkey % 30) / 10.0::DOUBLE + dy)) * 6371.0088 AS x, radians(46 + (s_suppkey % 30) / 10.0::DOUBLE + dy) * 6371.0088 AS y, e FROM supplier, (VALUES (0, 0.0, 0.0), (1, 0.5, 0.1), (2, 0.6, 0.4), (3, 0.1, 0.3)) AS c(e, dx, dy))
      SELECT a.ring_id, round(abs(sum(a.x * b.y - b.x * a.y)) / 2, 3) AS area_km2 FROM v a JOIN v b ON b.ring_id = a.ring_id AND b.e = (a.e + 1) % 4 GROUP BY ALL""",
)
def i22(t):
    base = F.lit(46) + (F.col("s_suppkey") % 30) / 10.0
    corner = lambda dx, dy: F.struct(F.lit(-122.0 + dx).alias("x"), (base + dy).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(0.5, 0.1), corner(0.6, 0.4), corner(0.1, 0.3))
    return t.read("supplier").select(F.col("s_suppkey").alias("ring_id"), F.round(F.abs(geometry.signed_area(geometry.sinusoidal(ring))), 3).alias("area_km2"))


@query(
    "I23_reference_names",
    """SELECT site, 'daily:' || site || ':' || min(year(day)) || '-' || max(year(day)) AS climatology, 'daily:' || site || ':WY' || min(wy) || '-WY' || max(wy) AS reference, 'daily:' || site || ':unknown' AS unknown_span FROM b_win GROUP BY site""",
)
def i23(t):
    g = daily(t).groupBy("site").agg(F.min(F.year("day")).alias("y0"), F.max(F.year("day")).alias("y1"), F.min("wy").alias("w0"), F.max("wy").alias("w1"))
    none = F.lit(None).cast("int")
    return g.select(
        "site", labels.reference_name(F.lit("daily"), F.col("site"), F.col("y0"), F.col("y1")).alias("climatology"),
        labels.reference_name(F.lit("daily"), F.col("site"), F.col("w0"), F.col("w1"), prefix="WY").alias("reference"),
        labels.reference_name(F.lit("daily"), F.col("site"), none, none).alias("unknown_span"),
    )

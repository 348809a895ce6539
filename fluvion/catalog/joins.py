"""Joins: as-of, nearest, range, routing, spatial, comparison."""

from pyspark.sql import functions as F

from fluvion.catalog.expressions import T, now
from fluvion.catalog.registry import query
from fluvion.functions import clocks
from fluvion.operators import joins, selection


def known(t, lookback_h=24 * 14, numbered=True):
    """Observations admissible at T: both clocks and the lookback are filtered before any ranking."""
    lo = clocks.plus_hours(now(), -lookback_h)
    return selection.as_known_at(t.observations(numbered), T).filter(F.col("valid_time").between(lo, now()))


def newest_order():
    return [F.desc("valid_time"), F.desc("revision_seq"), F.desc("id")]


@query(
    "D1_asof_latest",
    f"""SELECT station, variable, id, value, CAST(valid_time AS VARCHAR) AS valid_time, revision_seq FROM b_obs
      WHERE available_at <= TIMESTAMP '{T}' AND valid_time BETWEEN TIMESTAMP '{T}' - INTERVAL 14 DAY AND TIMESTAMP '{T}'
      QUALIFY row_number() OVER (PARTITION BY station, variable ORDER BY valid_time DESC, revision_seq DESC, id DESC) = 1""",
)
def d1(t):
    return selection.newest(known(t), ["station", "variable"], newest_order()).select(
        "station", "variable", "id", "value", "valid_time", "revision_seq"
    )


GRID_START, GRID_END, GRID_STEP = "2024-01-05 00:00:00", "2024-01-29 18:00:00", 6


@query(
    "D2_asof_grid",
    f"""SELECT CAST(g AS VARCHAR) AS as_of, station, id, value, CAST(valid_time AS VARCHAR) AS valid_time
      FROM generate_series(TIMESTAMP '{GRID_START}', TIMESTAMP '{GRID_END}', INTERVAL {GRID_STEP} HOUR) AS x(g)
      JOIN b_obs o ON o.available_at <= g AND o.valid_time <= g AND o.valid_time >= g - INTERVAL 24 HOUR
      QUALIFY row_number() OVER (PARTITION BY g, station ORDER BY valid_time DESC, id DESC) = 1""",
)
def d2(t):
    return joins.latest_at_grid(
        t.observations(), ["station"], ["valid_time", "id"], ["value"], GRID_START, GRID_END, GRID_STEP, 24
    ).select("as_of", "station", "id", "value", "valid_time")


@query(
    "D3_nearest_with_tolerance",
    """WITH hourly AS (SELECT station, valid_time, max(value) AS value FROM b_obs GROUP BY ALL),
      l AS (SELECT *, valid_time - INTERVAL 24 HOUR AS target FROM hourly),
      m AS (SELECT l.station, l.valid_time, r.valid_time AS rt, r.value AS rv FROM l JOIN hourly r ON r.station = l.station AND abs(epoch(r.valid_time) - epoch(l.target)) <= 6 * 3600
        QUALIFY row_number() OVER (PARTITION BY l.station, l.valid_time ORDER BY abs(epoch(r.valid_time) - epoch(l.target)), r.valid_time) = 1)
      SELECT l.station, CAST(l.valid_time AS VARCHAR) AS valid_time, CAST(m.rt AS VARCHAR) AS prior_time, m.rv AS prior,
        CASE WHEN m.rt IS NULL THEN 'no_endpoint' WHEN m.rv <= 0 OR l.value <= 0 THEN 'not_positive' ELSE 'ok' END AS reason
      FROM l LEFT JOIN m ON m.station = l.station AND m.valid_time = l.valid_time""",
)
def d3(t):
    hourly = t.observations().groupBy("station", "valid_time").agg(F.max("value").alias("value"))
    left = hourly.withColumn("target", clocks.plus_hours(F.col("valid_time"), -24))
    out = joins.nearest_in_time(left, hourly, ["station"], "target", "valid_time", ["valid_time", "value"], 6.0, ["station", "valid_time"])
    reason = (
        F.when(F.col("near_valid_time").isNull(), "no_endpoint")
        .when((F.col("near_value") <= 0) | (F.col("value") <= 0), "not_positive")
        .otherwise("ok")
    )
    return out.select("station", "valid_time", F.col("near_valid_time").alias("prior_time"), F.col("near_value").alias("prior"), reason.alias("reason"))


@query(
    "D4_dimension_lookup",
    """SELECT run_id, c_name AS fp_name, n_name AS basin_name, r_name AS kind FROM b_run r LEFT JOIN customer c ON c.c_custkey = r.fp
      LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region g ON g.r_regionkey = n.n_regionkey""",
)
def d4(t):
    df = joins.lookup(t.forecast_runs(), t.points(), "fp")
    df = joins.lookup(joins.lookup(df, t.basins(), "basin"), t.sources(), "source")
    return df.select("run_id", "fp_name", "basin_name", "kind")


@query(
    "D5_range_specs",
    f"""WITH spec AS (SELECT DISTINCT station, variable, TIMESTAMP '{T}' - to_days(CAST(station % 20 + 1 AS INTEGER)) AS lo, TIMESTAMP '{T}' - to_hours(CAST(station % 30 AS INTEGER)) AS hi FROM b_obs)
      SELECT o.station, o.variable, count(*) AS n, max(value) AS top, CAST(min(valid_time) AS VARCHAR) AS first_time, CAST(max(valid_time) AS VARCHAR) AS last_time
      FROM spec s JOIN b_obs o ON o.station = s.station AND o.variable = s.variable AND o.valid_time BETWEEN lo AND hi GROUP BY ALL""",
)
def d5(t):
    s = F.col("station")
    obs = t.observations()
    specs = obs.select(
        "station", "variable", clocks.plus_hours(now(), -(s % 20 + 1) * 24).alias("lo"), clocks.plus_hours(now(), -(s % 30)).alias("hi")
    ).distinct()
    hit = joins.rows_for_specs(specs.filter("lo <= hi"), obs, ["station", "variable"], "valid_time")
    return hit.groupBy("station", "variable").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.min("valid_time").alias("first_time"), F.max("valid_time").alias("last_time")
    )


@query(
    "D5_feature_specs",
    """WITH spec AS (SELECT feature, scope, CASE WHEN scope % 2 = 0 THEN '24h' END AS win, min(valid_time) + INTERVAL 3 DAY AS lo, max(valid_time) - INTERVAL 2 DAY AS hi FROM b_feat GROUP BY feature, scope)
      SELECT f.feature, f.scope, count(*) AS n, count(f.win) AS n_windowed, max(f.value) AS top FROM spec s JOIN b_feat f ON f.feature = s.feature AND f.scope = s.scope
      AND f.valid_time BETWEEN s.lo AND s.hi AND (s.win IS NULL OR s.win = f.win) GROUP BY ALL""",
)
def d5b(t):
    feats = t.derived_features()
    specs = feats.groupBy("feature", "scope").agg(
        clocks.plus_hours(F.min("valid_time"), 72).alias("lo"), clocks.plus_hours(F.max("valid_time"), -48).alias("hi")
    ).withColumn("window", F.when(F.col("scope") % 2 == 0, "24h"))
    hit = joins.rows_for_specs(specs.filter("lo <= hi"), feats, ["feature", "scope"], "valid_time", any_match=["window"])
    return hit.groupBy("feature", "scope").agg(
        F.count(F.lit(1)).alias("n"), F.count("row_window").alias("n_windowed"), F.max("value").alias("top")
    )


@query(
    "D6_station_basin",
    """WITH st AS (SELECT s_suppkey AS station, s_nationkey AS huc, CASE s_suppkey % 4 WHEN 0 THEN [s_nationkey, 90] WHEN 1 THEN [90, 91] WHEN 2 THEN [(s_nationkey + 1) % 20, 91] ELSE [] END AS assoc FROM supplier),
      x AS (SELECT *, len(assoc) AS n_assoc, len(list_filter(assoc, lambda a: a < 20)) AS n_domain, len(list_filter(assoc, lambda a: a = huc)) AS n_basin FROM st WHERE huc < 20)
      SELECT station, huc AS basin, n_assoc, n_domain, n_basin, CASE WHEN n_assoc > 0 AND n_domain = 0 THEN 'no_associated_huc_in_any_seeded_basin'
        WHEN n_assoc > 0 AND n_basin = 0 THEN 'associated_only_with_other_seeded_basins' ELSE 'ok' END AS verdict FROM x""",
)
def d6(t):
    from fluvion.operators import snow

    huc = lambda c: F.format_string("1711%04d", c)
    k, n = F.col("s_suppkey") % 4, F.col("s_nationkey")
    a = lambda c: F.concat(huc(c), F.lit("0102"))
    assoc = (
        F.when(k == 0, F.array(a(n), a(F.lit(90))))
        .when(k == 1, F.array(a(F.lit(90)), a(F.lit(91))))
        .when(k == 2, F.array(a((n + 1) % 20), a(F.lit(91))))
        .otherwise(F.array().cast("array<string>"))
    )
    stations = t.read("supplier").select(F.col("s_suppkey").alias("station"), huc(n).alias("huc"), assoc.alias("associated"))
    basins = t.basins().filter("basin < 20").select("basin", F.array(huc(F.col("basin"))).alias("huc8"))
    return snow.assign_basins(stations, basins).select("station", "basin", "n_assoc", "n_domain", "n_basin", F.coalesce("verdict", F.lit("ok")).alias("verdict"))


@query(
    "D7_alert_routing",
    """SELECT a.alert_id, coalesce(string_agg(DISTINCT lpad(CAST(z.basin AS VARCHAR), 2, '0'), '|' ORDER BY lpad(CAST(z.basin AS VARCHAR), 2, '0')), '') AS basins FROM b_alert a
      LEFT JOIN (SELECT printf('WAC%03d', n_nationkey) AS zone, n_nationkey AS basin FROM nation WHERE n_nationkey % 5 <> 0
        UNION ALL SELECT printf('WAC%03d', n_nationkey), (n_nationkey + 7) % 25 FROM nation WHERE n_nationkey % 5 <> 0) z ON z.zone IN (a.ugc1, a.ugc2) GROUP BY ALL""",
)
def d7(t):
    from fluvion.operators import alerts

    pair = F.array(F.col("basin"), (F.col("basin") + 7) % 25)
    zones = t.basins().filter("basin % 5 <> 0").select(F.format_string("WAC%03d", "basin").alias("zone"), F.explode(pair).alias("b"))
    zones = zones.select("zone", F.lpad(F.col("b").cast("string"), 2, "0").alias("basin"))
    return alerts.route(t.alerts(), zones).select("alert_id", "basins")


@query(
    "D8_river_name_match",
    """SELECT n.n_nationkey AS basin, lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS river, max(c.c_acctbal) AS intensity FROM nation n
      JOIN customer c ON c.c_nationkey = n.n_nationkey AND contains(lower(c.c_name), lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0')) GROUP BY ALL""",
)
def d8(t):
    rivers = t.basins().select("basin", F.lpad(F.col("basin").cast("string"), 2, "0").alias("river"))
    states = t.read("customer").select(F.col("c_nationkey").alias("basin"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("intensity"))
    named = rivers.filter(F.lower("river") != "(unnamed)").withColumnRenamed("basin", "r_basin")
    on = (F.col("basin") == F.col("r_basin")) & F.contains(F.lower("name"), F.lower("river")) & F.col("intensity").isNotNull()
    return states.join(named, on).groupBy("basin", "river").agg(F.max("intensity").alias("intensity"))


@query(
    "D9_zone_basin_overlap",
    """WITH z AS (SELECT field AS zone, flat_index, least(abs(value) / 397, 1.0) AS w FROM b_cell WHERE value <> 0), zt AS (SELECT zone, sum(w) AS area FROM z GROUP BY ALL),
      bt AS (SELECT basin, sum(weight) AS area FROM b_mask GROUP BY ALL)
      SELECT z.zone, m.basin, round(sum(least(z.w, m.weight)) * 2.5, 6) AS overlap_km2, round(sum(least(z.w, m.weight)) / any_value(zt.area), 6) AS of_zone, round(sum(least(z.w, m.weight)) / any_value(bt.area), 6) AS of_basin
      FROM z JOIN b_mask m USING (flat_index) JOIN zt USING (zone) JOIN bt ON bt.basin = m.basin GROUP BY z.zone, m.basin HAVING sum(least(z.w, m.weight)) * 2.5 >= 2.0""",
)
def d9(t):
    from fluvion.operators import zonal

    zone = t.grid_cells().filter("value <> 0").select(F.col("field").alias("zone"), "flat_index", F.least(F.abs("value") / 397, F.lit(1.0)).alias("weight"))
    return zonal.overlap(zone, t.mask(), "zone", "basin", cell_km2=2.5, minimum_km2=2.0)


def boxed(df, key):
    """Rings (basin, part, ring, pts) of the boxes of a table."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    pts = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"))
    return df.select(F.col(key).alias("basin"), F.lit(0).alias("part"), F.lit(0).alias("ring"), pts.alias("pts"))


@query(
    "D9_polygon_overlap",
    """WITH z AS (SELECT s_suppkey AS zone, (s_suppkey * 37 % 480) + 0.25::DOUBLE AS west, (s_suppkey * 7 % 18) + 0.125::DOUBLE AS south, 7.5::DOUBLE + s_suppkey % 5 AS w, 2.5::DOUBLE + s_suppkey % 3 AS h FROM supplier),
      b AS (SELECT n_nationkey AS basin, n_nationkey * 19 - 1.5::DOUBLE AS west, (n_nationkey * 5 % 18)::DOUBLE AS south, 26.0::DOUBLE AS w, 9.5::DOUBLE AS h FROM nation),
      o AS (SELECT zone, basin, (least(z.west + z.w, b.west + b.w) - greatest(z.west, b.west)) * (least(z.south + z.h, b.south + b.h) - greatest(z.south, b.south)) AS area, z.w * z.h AS za, b.w * b.h AS ba
        FROM z JOIN b ON z.west < b.west + b.w AND b.west < z.west + z.w AND z.south < b.south + b.h AND b.south < z.south + z.h)
      SELECT zone, basin, round(area, 6) AS overlap_km2, round(area / za, 6) AS of_zone, round(area / ba, 6) AS of_basin FROM o WHERE area >= 2.0""",
)
def d9_polygons(t):
    from fluvion.operators import masks

    k, n = F.col("s_suppkey"), F.col("basin")
    west, south = (k * 37 % 480) + F.lit(0.25), (k * 7 % 18) + F.lit(0.125)
    zones = t.read("supplier").select(k.alias("zone"), west.alias("west"), south.alias("south"), (west + 7.5 + k % 5).alias("east"), (south + 2.5 + k % 3).alias("north"))
    basins = t.basins().select(n, (n * 19 - 1.5).alias("west"), (n * 19 + 24.5).alias("east"), (n * 5 % 18).cast("double").alias("south"), (n * 5 % 18 + 9.5).alias("north"))
    o = masks.polygon_overlaps(boxed(zones, "zone"), boxed(basins, "basin"), tile=16.0, cell_km2=1.0, minimum_km2=2.0)
    return o.select(F.col("left").alias("zone"), F.col("right").alias("basin"), "overlap_km2", F.col("of_left").alias("of_zone"), F.col("of_right").alias("of_basin"))


def rings(t):
    """One quadrilateral per supplier, in a 0-500 by 0-24 plane."""
    k = F.col("s_suppkey")
    cx, cy = (k * 37 % 480).cast("double") + 10.25, (k * 7 % 18).cast("double") + 3.125
    corner = lambda x, y: F.struct((cx + x).alias("x"), (cy + y).alias("y"))
    ring = F.array(corner(-9.5, -1.0), corner(8.0, -2.75), corner(11.0, 1.5), corner(-4.0, 2.875))
    return t.read("supplier").select(k.alias("ring_id"), ring.alias("ring"))


RING_SQL = """(SELECT s_suppkey AS ring_id, unnest([0, 1, 2, 3]) AS e, (s_suppkey * 37 % 480) + 10.25::DOUBLE AS cx, (s_suppkey * 7 % 18) + 3.125::DOUBLE AS cy FROM supplier)"""


def event_points(t):
    return t.events().select(F.col("event_id").alias("pid"), F.col("value").alias("x"), (F.hour("ts") + F.minute("ts") / 60.0).alias("y"))


@query(
    "D10_point_in_polygon",
    f"""WITH v AS (SELECT ring_id, e, cx + [-9.5, 8.0, 11.0, -4.0][e + 1] AS x1, cy + [-1.0, -2.75, 1.5, 2.875][e + 1] AS y1,
        cx + [8.0, 11.0, -4.0, -9.5][e + 1] AS x2, cy + [-2.75, 1.5, 2.875, -1.0][e + 1] AS y2 FROM {RING_SQL}),
      p AS (SELECT event_id AS pid, value AS x, hour(ts) + minute(ts) / 60.0::DOUBLE AS y FROM events)
      SELECT pid, ring_id FROM p JOIN v ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1""",
)
def d10(t):
    return joins.points_in_rings(event_points(t), rings(t), "pid", "ring_id", cell=2.0)


@query(
    "D11_nearest_vertex",
    """WITH p AS (SELECT event_id AS pid, -122 + value / 100 AS lon, 46 + (hour(ts) * 60 + minute(ts)) / 600.0::DOUBLE AS lat FROM events),
      v AS (SELECT DISTINCT -122 + (s_suppkey * 37 % 480) / 100.0::DOUBLE AS lon, 46 + (s_suppkey * 7 % 24) / 10.0::DOUBLE AS lat FROM supplier)
      SELECT pid, round(min(d), 4) AS d_m FROM (SELECT pid, CASE WHEN sqrt(power((v.lon - p.lon) * 111320 * cos(radians(p.lat)), 2) + power((v.lat - p.lat) * 111320, 2)) < 5000
        THEN sqrt(power((v.lon - p.lon) * 111320 * cos(radians(p.lat)), 2) + power((v.lat - p.lat) * 111320, 2)) END AS d FROM p, v) GROUP BY ALL""",
)
def d11(t):
    p = t.events().select(
        F.col("event_id").alias("pid"), (F.lit(-122) + F.col("value") / 100).alias("lon"),
        (F.lit(46) + (F.hour("ts") * 60 + F.minute("ts")) / 600.0).alias("lat"),
    )
    k = F.col("s_suppkey")
    v = t.read("supplier").select((F.lit(-122) + (k * 37 % 480) / 100.0).alias("lon"), (F.lit(46) + (k * 7 % 24) / 10.0).alias("lat"))
    return joins.nearest_within(p, v, "pid", 5000.0).select("pid", F.round("d_m", 4).alias("d_m"))


LEFT_SQL = "(SELECT station, variable, valid_time, value, 'cfs' AS unit FROM b_obs WHERE id % 17 <> 0 QUALIFY row_number() OVER (PARTITION BY station, variable, valid_time ORDER BY id DESC) = 1)"
RIGHT_SQL = """(SELECT station, variable, valid_time, value + CASE WHEN id % 19 = 0 THEN 0.5 WHEN id % 23 = 0 THEN 1e-12 ELSE 0 END AS value, CASE WHEN id % 29 = 0 THEN 'kcfs' ELSE 'cfs' END AS unit
  FROM b_obs WHERE id % 13 <> 0 QUALIFY row_number() OVER (PARTITION BY station, variable, valid_time ORDER BY id DESC) = 1)"""
KEY = ["station", "variable", "valid_time"]


def transports(t):
    obs = t.observations()
    i = F.col("id")
    left = selection.newest(obs.filter(i % 17 != 0), KEY, [F.desc("id")]).select(*KEY, "value", F.lit("cfs").alias("unit"))
    right = selection.newest(obs.filter(i % 13 != 0), KEY, [F.desc("id")]).select(
        *KEY, (F.col("value") + F.when(i % 19 == 0, 0.5).when(i % 23 == 0, 1e-12).otherwise(0.0)).alias("value"),
        F.when(i % 29 == 0, "kcfs").otherwise("cfs").alias("unit"),
    )
    return left, right


@query(
    "D12_transport_comparison",
    f"""SELECT coalesce(l.station, r.station) AS station, coalesce(l.variable, r.variable) AS variable, CAST(coalesce(l.valid_time, r.valid_time) AS VARCHAR) AS valid_time,
      CASE WHEN r.station IS NULL THEN 'only_left' WHEN l.station IS NULL THEN 'only_right' ELSE 'both' END AS side,
      l.station IS NOT NULL AND r.station IS NOT NULL AND l.unit IS DISTINCT FROM r.unit AS unit_differs,
      l.station IS NOT NULL AND r.station IS NOT NULL AND abs(l.value - r.value) >= 1e-9 AS value_differs
      FROM {LEFT_SQL} l FULL OUTER JOIN {RIGHT_SQL} r ON l.station = r.station AND l.variable = r.variable AND l.valid_time = r.valid_time""",
)
def d12(t):
    left, right = transports(t)
    return joins.compare_tables(left, right, KEY, exact=["unit"], close=["value"])


@query(
    "D13_supersession",
    """WITH k AS (SELECT * FROM b_alert WHERE available_at <= TIMESTAMP '2024-01-06 00:00:00')
      SELECT alert_id, status, message_type, CAST(sent AS VARCHAR) AS sent FROM k WHERE status = 'Actual' AND message_type <> 'Cancel' AND (ends IS NULL OR ends >= TIMESTAMP '2024-01-06 00:00:00')
      AND (expires IS NULL OR expires >= TIMESTAMP '2024-01-06 00:00:00') AND (ends IS NOT NULL OR expires IS NOT NULL OR sent >= TIMESTAMP '2024-01-06 00:00:00' - INTERVAL 48 HOUR)
      AND alert_id NOT IN (SELECT reference FROM k WHERE reference IS NOT NULL)""",
)
def d13(t):
    return joins.not_superseded(t.alerts(), "2024-01-06 00:00:00").select("alert_id", "status", "message_type", "sent")


@query(
    "D14_same_cycle",
    """WITH c AS (SELECT fp, issued_at, (lead - 1) // 3 AS win, max(flow) AS v FROM b_val GROUP BY ALL), m AS (SELECT *, max(issued_at) OVER (PARTITION BY fp) AS cyc FROM c)
      SELECT fp, CAST(cyc AS VARCHAR) AS cycle, count(*) AS n_windows, round(CASE WHEN count(*) = 3 THEN sum(v) END, 2) AS total,
        CASE WHEN count(*) = 3 THEN 'ok' ELSE 'incomplete_cycle' END AS reason FROM m WHERE issued_at = cyc GROUP BY fp, cyc""",
)
def d14(t):
    from fluvion.operators import precipitation

    windows = t.run_values().groupBy("fp", "issued_at", F.floor((F.col("lead") - 1) / 3).alias("window")).agg(F.max("flow").alias("value"))
    return precipitation.newest_cycle_total(windows, "fp", 3).select("fp", "cycle", "n_windows", F.round("total", 2).alias("total"), "reason")


@query(
    "D15_covariate",
    """SELECT a.field, b.field AS partner, CASE WHEN b.field IS NULL THEN 'absent' WHEN a.grid_hash <> b.grid_hash THEN 'grid_changed' ELSE 'ok' END AS reason,
      CASE WHEN a.grid_hash = b.grid_hash THEN b.v END AS influence FROM (SELECT field, any_value(grid_hash) AS grid_hash FROM b_cell GROUP BY field) a
      LEFT JOIN (SELECT field, any_value(grid_hash) AS grid_hash, max(value) AS v FROM b_cell GROUP BY field) b ON b.field = a.field + 10""",
)
def d15(t):
    f = t.grid_cells().groupBy("field", "grid_hash").agg(F.max("value").alias("v"))
    co = f.select((F.col("field") - 10).alias("field"), F.col("field").alias("partner"), F.col("grid_hash").alias("co_hash"), "v")
    same = F.col("grid_hash") == F.col("co_hash")
    return f.drop("v").join(co, "field", "left").select(
        "field", "partner", F.when(F.col("partner").isNull(), "absent").when(~same, "grid_changed").otherwise("ok").alias("reason"),
        F.when(same, F.col("v")).alias("influence"),
    )


@query(
    "D17_companion",
    """WITH best AS (SELECT * FROM b_obs QUALIFY row_number() OVER (PARTITION BY station, variable, valid_time ORDER BY revision_seq DESC, id DESC) = 1)
      SELECT a.id, a.station, b.value AS companion FROM best a LEFT JOIN best b ON b.station = a.station AND b.valid_time = a.valid_time AND b.variable = 'click' WHERE a.variable = 'view'""",
)
def d17(t):
    best = selection.newest(t.observations(True), KEY, [F.desc("revision_seq"), F.desc("id")])
    other = best.filter("variable = 'click'").select("station", "valid_time", F.col("value").alias("companion"))
    return best.filter("variable = 'view'").join(other, ["station", "valid_time"], "left").select("id", "station", "companion")


@query(
    "D18_calendar_lag",
    """SELECT a.site, CAST(a.day AS VARCHAR) AS day, round(a.value / b.value, 4) AS ratio FROM b_dayall a JOIN b_dayall b ON b.site = a.site AND b.day = a.day - 2 WHERE a.value > 0 AND b.value > 0""",
)
def d18(t):
    lag = joins.calendar_lag(t.daily_means(None), ["site"], 2).filter("value > 0 AND prior > 0")
    return lag.select("site", "day", F.round(F.col("value") / F.col("prior"), 4).alias("ratio"))


@query(
    "D19_doy_windows",
    """WITH d AS (SELECT *, datediff('day', DATE '2000-01-01', make_date(2000, month(day), day(day))) AS doy FROM b_day)
      SELECT site, (doy + o + 366) % 366 AS key, count(*) AS n, round(max(value), 6) AS top FROM d, (VALUES (-2), (-1), (0), (1), (2)) AS w(o) GROUP BY ALL""",
)
def d19(t):
    w = joins.doy_windows(t.daily_key(t.daily_means()))
    return w.groupBy("site", F.col("key").cast("long").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query(
    "D20_provenance",
    f"""SELECT run_id, n.n_name AS product, coalesce(g.r_name, 'UNKNOWN') AS kind, 'artifact-' || run_id AS artifact,
      CASE WHEN epoch(TIMESTAMP '2001-09-01') - epoch(available_at) > 4 * 86400 * 90 THEN 'degraded' WHEN epoch(TIMESTAMP '2001-09-01') - epoch(issued_at) > 86400 * 91 THEN 'stale' ELSE 'current' END AS freshness
      FROM b_run r LEFT JOIN nation n ON n.n_nationkey = r.fp % 25 LEFT JOIN region g ON g.r_regionkey = n.n_regionkey""",
)
def d20(t):
    from fluvion.operators import provenance

    runs = t.forecast_runs().drop("product").withColumn("product_id", (F.col("fp") % 25).cast("int"))
    products = t.basins().select(F.col("basin").alias("product_id"), F.col("basin_name").alias("product"), "source", F.lit(86400 * 90).alias("cadence_s"), F.lit(86400).alias("grace_s"))
    out = provenance.attach(runs, products, t.sources(), F.lit("2001-09-01").cast("timestamp"), "issued_at", "available_at", F.concat(F.lit("artifact-"), "run_id"))
    return out.select("run_id", "provenance.product", "provenance.kind", "provenance.artifact", "provenance.freshness")


@query(
    "D22_topology",
    """SELECT fp, u AS upstream, c_nationkey AS upstream_basin FROM (SELECT c_custkey AS fp, unnest([c_custkey + 1, c_custkey + 2]) AS u FROM customer WHERE c_custkey % 3 <> 0) x LEFT JOIN customer ON c_custkey = u""",
)
def d22(t):
    fp = F.col("c_custkey")
    ups = F.when(fp % 3 != 0, F.array(fp + 1, fp + 2))
    edges = t.read("customer").select(fp.alias("fp"), F.explode(ups).alias("upstream"))
    dim = t.points().select(F.col("fp").alias("upstream"), F.col("basin").alias("upstream_basin"))
    return edges.join(dim, "upstream", "left").select("fp", "upstream", "upstream_basin")


@query(
    "D23_basin_gauges",
    """SELECT n_nationkey AS basin, s_suppkey AS station, s_name AS station_name FROM nation JOIN supplier ON s_suppkey = n_nationkey * 2 + 1 WHERE s_acctbal > 0 ORDER BY basin""",
)
def d23(t):
    configured = t.basins().select("basin", (F.col("basin") * 2 + 1).cast("long").alias("station"))
    return configured.join(t.stations().drop("basin").filter("elevation > 0"), "station").select("basin", "station", "station_name").orderBy("basin")


@query(
    "D24_first_box",
    """WITH b AS (SELECT n_nationkey AS box, n_nationkey * 19 - 1.5 AS west, n_nationkey * 19 + 24.5 AS east, (n_nationkey * 5 % 18) AS south, (n_nationkey * 5 % 18) + 9.5 AS north FROM nation),
      p AS (SELECT event_id AS pid, value AS x, hour(ts) + minute(ts) / 60.0::DOUBLE AS y FROM events)
      SELECT pid, min(box) AS box FROM p LEFT JOIN b ON x BETWEEN west AND east AND y BETWEEN south AND north GROUP BY ALL""",
)
def d24(t):
    n = F.col("basin")
    boxes = t.basins().select(
        n.alias("box"), (n * 19 - 1.5).alias("west"), (n * 19 + 24.5).alias("east"),
        (n * 5 % 18).cast("double").alias("south"), (n * 5 % 18 + 9.5).alias("north"),
    )
    return joins.first_box(event_points(t), boxes, "pid", 12.0).select("pid", "box")


@query(
    "D25_consistent_cycles",
    """SELECT l_orderkey AS group_id, count(DISTINCT l_linestatus) AS n_cycles, count_if(l_linestatus <> 'F') AS n_other,
      CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'mixed_cycles' WHEN min(l_linestatus) <> 'F' THEN 'wrong_cycle' ELSE 'ok' END AS verdict FROM lineitem GROUP BY ALL""",
)
def d25(t):
    g = t.read("lineitem").groupBy(F.col("l_orderkey").alias("group_id")).agg(
        F.countDistinct("l_linestatus").alias("n_cycles"), F.count_if(F.col("l_linestatus") != "F").alias("n_other"), F.min("l_linestatus").alias("cycle")
    )
    return g.select("group_id", "n_cycles", "n_other", F.when(F.col("n_cycles") > 1, "mixed_cycles").when(F.col("cycle") != "F", "wrong_cycle").otherwise("ok").alias("verdict"))


@query(
    "D26_supersession_chain",
    """SELECT r.fp, r.run_id, CAST(r.issued_at AS VARCHAR) AS issued_at, lag(r.run_id) OVER (PARTITION BY r.fp, r.product ORDER BY r.issued_at, r.run_id) AS supersedes, coalesce(v.n, 0) AS n_values, v.crest
      FROM b_run r LEFT JOIN (SELECT run_id, count(*) AS n, max(flow) AS crest FROM b_val GROUP BY ALL) v USING (run_id)""",
)
def d26(t):
    from fluvion.operators import revisions

    chain = revisions.link_supersession(t.forecast_runs(), ["fp", "product"])
    vals = t.forecast_values().groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("flow").alias("crest"))
    return chain.join(vals, "run_id", "left").select("fp", "run_id", "issued_at", "supersedes", F.coalesce("n", F.lit(0)).alias("n_values"), "crest")


@query(
    "D27_mainstem_midpoint",
    """WITH v AS (SELECT l_orderkey AS path_id, l_linenumber, min((l_partkey, l_suppkey)) AS xy FROM lineitem GROUP BY ALL), p AS (SELECT o_custkey AS basin, path_id, count(*) AS n_vertices FROM orders JOIN v ON path_id = o_orderkey GROUP BY ALL),
      best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY basin ORDER BY n_vertices DESC, path_id) = 1), i AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY l_linenumber) - 1 AS i FROM v)
      SELECT basin, b.path_id, n_vertices, xy[1] AS mid_x, xy[2] AS mid_y FROM best b JOIN i ON i.path_id = b.path_id AND i.i = n_vertices // 2""",
)
def d27(t):
    from fluvion.operators import geometry

    mid = geometry.midpoint_of_longest(river_paths(t).withColumnRenamed("river", "basin"), "basin")
    return mid.select("basin", "path_id", "n_vertices", F.col("mid.l_partkey").alias("mid_x"), F.col("mid.l_suppkey").alias("mid_y"))


def river_paths(t):
    """One path per order: a vertex per line number, so a path is bounded before it becomes an array."""
    vertices = t.read("lineitem").groupBy(F.col("l_orderkey").alias("path_id"), "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("xy"))
    vertex = F.struct("l_linenumber", "xy.l_partkey", "xy.l_suppkey", (F.col("xy.l_partkey") / 1000.0).alias("x"), (F.col("xy.l_suppkey") / 100.0).alias("y"))
    paths = vertices.groupBy("path_id").agg(F.sort_array(F.collect_list(vertex)).alias("path"))
    return paths.join(t.forecast_runs().select(F.col("run_id").alias("path_id"), F.col("fp").alias("river")), "path_id")

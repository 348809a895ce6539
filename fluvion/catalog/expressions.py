"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from fluvion.catalog.registry import query
from fluvion.functions import clocks, flood, overlay, values
from fluvion.operators import selection

T = "2024-01-25 12:00:00"


def now():
    return F.lit(T).cast("timestamp")


@query(
    "C1_knowledge_time",
    """SELECT run_id, CAST(greatest(issued_at, available_at - INTERVAL 1 DAY) AS VARCHAR) AS known_at FROM b_run""",
)
def c1(t):
    runs = t.forecast_runs()
    retrieved = F.col("available_at") - F.expr("interval 1 day")
    return runs.select("run_id", clocks.knowledge_time(F.col("issued_at"), retrieved, F.col("issued_at")).alias("known_at"))


RAW = """CASE WHEN l_linenumber = 1 THEN 'n/a' WHEN l_linenumber = 2 THEN '-999999' WHEN l_linenumber = 3 THEN 'nan'
    WHEN l_linenumber = 4 THEN '12f' ELSE CAST(l_quantity AS VARCHAR) END"""


@query(
    "C2_safe_number",
    """SELECT l_suppkey AS site, coalesce(flag, 'ok') AS flag, count(*) AS n, round(sum(v), 6) AS total FROM (
      SELECT l_suppkey, CASE WHEN l_linenumber IN (1, 3, 4) THEN 'unparseable' WHEN l_linenumber = 2 THEN 'sentinel' END AS flag,
      CASE WHEN l_linenumber > 4 THEN l_quantity END AS v FROM lineitem) GROUP BY ALL""",
)
def c2(t):
    raw = (
        F.when(F.col("l_linenumber") == 1, "n/a")
        .when(F.col("l_linenumber") == 2, "-999999")
        .when(F.col("l_linenumber") == 3, "nan")
        .when(F.col("l_linenumber") == 4, "12f")
        .otherwise(F.col("l_quantity").cast("string"))
    )
    s = values.number_with_flag(raw, -999999.0)
    return (
        t.read("lineitem")
        .select(F.col("l_suppkey").alias("site"), s.alias("s"))
        .groupBy("site", F.coalesce("s.flag", F.lit("ok")).alias("flag"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("s.value").alias("total"))
    )


@query(
    "C3_quality_flags",
    """SELECT event_id AS id, concat_ws('|',
      CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'provisional' END, 'estimated',
      CASE WHEN event_id % 3 = 0 THEN 'ice' ELSE 'Zz' END,
      CASE WHEN event_type = 'view' AND value < 20 THEN 'out_of_range' END, 'backfilled') AS quality FROM events""",
)
def c3(t):
    id_, variable = F.col("event_id"), F.when(F.col("event_type") == "view", "flow").otherwise("stage")
    quals = F.array(F.lit("e"), F.lit("E"), F.when(id_ % 3 == 0, "Ice").otherwise("Zz"))
    approval = F.when(id_ % 2 == 0, "Approved").otherwise("Provisional")
    flags = values.quality_flags(F.lit(None).cast("string"), quals, F.col("value") - 20, variable, approval, backfilled=True)
    return t.events().select(id_.alias("id"), flags.alias("quality"))


@query(
    "C4_instantaneous_only",
    """SELECT l_suppkey AS site, count_if(l_returnflag <> 'R') AS kept, count_if(l_returnflag = 'R') AS skipped FROM lineitem GROUP BY ALL""",
)
def c4(t):
    stat = F.when(F.col("l_returnflag") == "A", "00011").when(F.col("l_returnflag") == "R", "00003")
    keep = stat.isNull() | (stat == "00011")
    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("skipped"))


@query(
    "C5_foreign_site",
    """SELECT user_id AS file, count(*) AS n_rows, count_if(event_id % 97 = 0) AS n_foreign,
      CASE WHEN count_if(event_id % 97 = 0) > 0 THEN 'refused' ELSE 'accepted' END AS verdict FROM events GROUP BY ALL""",
)
def c5(t):
    site = F.col("user_id") + (F.col("event_id") % 97 == 0).cast("int")
    df = t.events().select(F.col("user_id").alias("file"), F.col("user_id").alias("asked"), site.alias("got"))
    return selection.site_check(df, "file", "asked", "got")


@query(
    "C6_unit_conversion",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'kcfs' WHEN 'N' THEN 'cfs' ELSE 'furlong' END AS unit, count(*) AS n,
      count_if(l_returnflag = 'R') AS refused,
      round(max(CASE l_returnflag WHEN 'A' THEN l_quantity * 1000 WHEN 'N' THEN l_quantity END), 6) AS top FROM lineitem GROUP BY ALL""",
)
def c6(t):
    unit = F.when(F.col("l_returnflag") == "A", "kcfs").when(F.col("l_returnflag") == "N", " ft3/s ").otherwise("furlong")
    cfs = values.convert(F.col("l_quantity"), unit, F.lit("cfs"))
    return (
        t.read("lineitem")
        .select(values.normal_unit(unit).alias("unit"), cfs.alias("cfs"))
        .groupBy("unit")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cfs").isNull()).alias("refused"), F.max("cfs").alias("top"))
    )


@query(
    "C7_stage_flow_split",
    """SELECT run_id, lead, part, CASE WHEN product < '3' THEN stage ELSE flow END AS stage,
      round(CASE WHEN product < '3' THEN flow * 1000 ELSE stage * 1000 END, 6) AS flow, 'NAVD88' AS datum FROM b_val""",
)
def c7(t):
    # runs of product 1 and 2 are issued on stage, the others on flow
    stage, flow_k = overlay.split_pair(F.col("product") < "3", F.col("stage"), F.col("flow"))
    return t.run_values().select(
        "run_id", "lead", "part", stage.alias("stage"),
        values.convert(flow_k, F.lit("kcfs"), F.lit("cfs")).alias("flow"),
        F.when(stage.isNotNull(), "NAVD88").alias("datum"),
    )


@query(
    "C8_official_products",
    """SELECT coalesce(r.r_name, 'UNKNOWN') AS kind, count(*) AS n_runs, count_if(coalesce(r.r_name, 'UNKNOWN') IN ('AMERICA', 'EUROPE')) AS n_official
      FROM orders o LEFT JOIN nation n ON n.n_nationkey = o.o_custkey % 27 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_regionkey <> 2 GROUP BY ALL""",
)
def c8(t):
    runs = t.read("orders").select((F.col("o_custkey") % 27).cast("int").alias("product"))
    products = t.basins().withColumnRenamed("basin", "product")
    kinds = selection.with_source_kind(runs, products, t.sources().filter("source <> 2"))
    official = F.col("kind").isin("AMERICA", "EUROPE")
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(official).alias("n_official"))


@query(
    "C9_freshness",
    f"""SELECT id, CASE WHEN id % 11 = 0 THEN 'unknown'
      WHEN epoch(TIMESTAMP '{T}') - epoch(retrieved_at) > 4 * 86400 * (1 + id % 3) THEN 'degraded'
      WHEN greatest(0, epoch(TIMESTAMP '{T}') - epoch(valid_time)) > 86400 * (1 + id % 3) + 43200 THEN 'stale' ELSE 'current' END AS state,
      CAST(greatest(0, epoch(TIMESTAMP '{T}') - epoch(valid_time)) AS BIGINT) AS age_s FROM b_obs""",
)
def c9(t):
    cadence = F.when(F.col("id") % 11 != 0, F.lit(86400) * (1 + F.col("id") % 3))
    args = (now(), F.col("valid_time"), F.col("retrieved_at"))
    return t.observations().select(
        "id", values.freshness(*args, cadence, F.lit(43200)).alias("state"), values.age_seconds(*args).alias("age_s")
    )


@query(
    "C10_is_stale",
    f"""SELECT user_id AS station, epoch(TIMESTAMP '{T}') - epoch(date_trunc('second', max(ts))) > 5400 AS stale
      FROM events WHERE ts <= TIMESTAMP '{T}' GROUP BY ALL""",
)
def c10(t):
    last = t.events().filter(F.col("ts") <= now()).groupBy(F.col("user_id").alias("station")).agg(F.max("ts").alias("latest"))
    return last.select("station", values.is_stale(now(), F.col("latest")).alias("stale"))


@query(
    "C11_offset_instants",
    """SELECT event_id AS id, CAST(CASE event_id % 4 WHEN 0 THEN s WHEN 1 THEN s - INTERVAL 2 HOUR WHEN 2 THEN s + INTERVAL 8 HOUR END AS VARCHAR) AS instant,
      CASE event_id % 4 WHEN 3 THEN 'no_offset' ELSE 'ok' END AS verdict,
      CASE event_id % 4 WHEN 0 THEN strftime(s, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(s - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(s + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS printed
      FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events)""",
)
def c11(t):
    suffix = F.when(F.col("event_id") % 4 == 0, "Z").when(F.col("event_id") % 4 == 1, "+02:00").when(F.col("event_id") % 4 == 2, "-08:00").otherwise("")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), suffix)
    instant = clocks.parse_instant(text)
    return t.events().select(
        F.col("event_id").alias("id"),
        instant.alias("instant"),
        F.when(clocks.has_offset(text), "ok").otherwise("no_offset").alias("verdict"),
        clocks.iso_z(instant).alias("printed"),
    )


@query(
    "C12_day_end",
    """SELECT DISTINCT CAST(d AS VARCHAR) AS day, zone,
      CAST(CASE zone WHEN 'America/Los_Angeles' THEN ((d + 1)::TIMESTAMP AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC' ELSE (d + 1)::TIMESTAMP END AS VARCHAR) AS valid_time,
      CASE WHEN zone = 'America/Los_Angeles' THEN 'ok' ELSE 'day_boundary_assumed_utc' END AS flag,
      CAST((d + 1)::TIMESTAMP + INTERVAL 8 HOUR AS VARCHAR) AS standard_time
      FROM (SELECT CAST(l_shipdate AS DATE) AS d, CASE l_returnflag WHEN 'A' THEN 'America/Los_Angeles' ELSE 'Nowhere/Basin' END AS zone FROM lineitem)""",
)
def c12(t):
    zone = F.when(F.col("l_returnflag") == "A", "America/Los_Angeles").otherwise("Nowhere/Basin")
    df = t.lineitem().select("day", zone.alias("zone")).distinct()
    s = clocks.local_day_end(F.col("day"), F.col("zone"), ("America/Los_Angeles",))
    fixed = clocks.fixed_offset_day_end(F.col("day"), F.lit(-8.0))
    return df.select("day", "zone", s["valid_time"].alias("valid_time"), F.coalesce(s["flag"], F.lit("ok")).alias("flag"), fixed["valid_time"].alias("standard_time"))


def axis():
    return {
        "basis": F.when(F.col("run_id") % 3 == 0, "flow").otherwise("stage"),
        "unit": F.when(F.col("run_id") % 5 == 0, "kcfs").when(F.col("run_id") % 3 == 0, "cfs").otherwise("ft"),
        "datum": F.when(F.col("run_id") % 7 < 3, "NAVD88").when(F.col("run_id") % 7 < 5, "NGVD29"),
        "t_basis": F.when(F.col("fp") % 4 == 0, "flow").otherwise("stage"),
        "t_unit": F.when(F.col("fp") % 4 == 0, "cfs").otherwise("ft"),
        "t_datum": F.when(F.col("fp") % 2 == 1, "NAVD88"),
    }


AXIS_SQL = """(SELECT run_id, issued_at, available_at, fp, CASE WHEN run_id % 3 = 0 THEN 'flow' ELSE 'stage' END AS basis,
  CASE WHEN run_id % 5 = 0 THEN 'kcfs' WHEN run_id % 3 = 0 THEN 'cfs' ELSE 'ft' END AS unit,
  CASE WHEN run_id % 7 < 3 THEN 'NAVD88' WHEN run_id % 7 < 5 THEN 'NGVD29' END AS datum,
  CASE WHEN fp % 4 = 0 THEN 'flow' ELSE 'stage' END AS t_basis, CASE WHEN fp % 4 = 0 THEN 'cfs' ELSE 'ft' END AS t_unit,
  CASE WHEN fp % 2 = 1 THEN 'NAVD88' END AS t_datum FROM b_run)"""


def with_axis(t):
    return t.forecast_runs().select("*", *[c.alias(k) for k, c in axis().items()])


@query(
    "C13_comparability",
    f"""SELECT run_id, coalesce(CASE WHEN basis <> t_basis THEN 'basis_mismatch' WHEN unit <> t_unit THEN 'unit_mismatch'
      WHEN t_basis = 'stage' AND (datum IS NULL OR t_datum IS NULL OR datum <> t_datum) THEN 'datum_mismatch' END, 'comparable') AS verdict FROM {AXIS_SQL}""",
)
def c13(t):
    code = flood.comparability(*[F.col(c) for c in ("basis", "unit", "datum", "t_basis", "t_unit", "t_datum")])
    return with_axis(t).select("run_id", F.coalesce(code, F.lit("comparable")).alias("verdict"))


@query(
    "C14_overlay_refusals",
    f"""SELECT run_id,
      CASE WHEN t_basis <> basis THEN 'basis' WHEN t_unit <> unit THEN 'unit' WHEN basis = 'stage' AND t_datum <> datum THEN 'datum' ELSE 'drawn' END AS thresholds,
      CASE WHEN t_basis <> basis THEN 'basis' WHEN t_unit <> unit THEN 'unit' WHEN basis = 'stage' AND datum IS NOT NULL AND t_datum IS NULL THEN 'datum_undeclared'
        WHEN basis = 'stage' AND t_datum <> datum THEN 'datum' ELSE 'drawn' END AS forecast,
      CASE WHEN fp % 9 = 0 THEN 'no_crest' WHEN t_unit <> unit THEN 'unit' WHEN basis = 'stage' AND t_datum <> datum THEN 'datum' ELSE 'drawn' END AS crest
      FROM {AXIS_SQL}""",
)
def c14(t):
    b, u, d, tb, tu, td = [F.col(c) for c in ("basis", "unit", "datum", "t_basis", "t_unit", "t_datum")]
    crest = F.when(F.col("fp") % 9 != 0, F.lit(1.0))
    return with_axis(t).select(
        "run_id",
        overlay.threshold_refusal(b, u, d, tb, tu, td).alias("thresholds"),
        overlay.forecast_refusal(b, u, d, tb, tu, td).alias("forecast"),
        overlay.crest_refusal(b, u, d, crest, F.col("issued_at"), tu, td).alias("crest"),
    )


@query(
    "C15_basis_choice",
    """SELECT run_id, coalesce(tb, hb, CASE WHEN run_id % 4 = 1 THEN 'stage' WHEN run_id % 4 = 2 THEN 'flow' END, 'none') AS basis,
      CASE WHEN tb IS NOT NULL THEN 'thresholds' WHEN hb IS NOT NULL THEN 'headroom' WHEN run_id % 4 IN (1, 2) THEN 'observed' ELSE 'undeclared' END AS source
      FROM (SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'stage' END AS tb, CASE WHEN run_id % 5 = 0 THEN 'flow' END AS hb FROM b_run)""",
)
def c15(t):
    r = F.col("run_id")
    args = (F.when(r % 3 == 0, "stage"), F.when(r % 5 == 0, "flow"), F.when(r % 4 == 1, 1.0), F.when(r % 4 == 2, 1.0))
    return t.forecast_runs().select(
        "run_id", F.coalesce(overlay.choose_basis(*args), F.lit("none")).alias("basis"), overlay.basis_source(*args).alias("source")
    )


@query(
    "C16_time_windows",
    f"""SELECT run_id, CASE WHEN s IS NULL AND e IS NULL THEN 'none' WHEN s IS NULL OR e IS NULL THEN 'one_bound_only' WHEN e <= s THEN 'end_not_after_start'
        WHEN e - s > INTERVAL 45 DAY THEN 'too_long' ELSE 'ok' END AS verdict,
      CAST(least(greatest(TIMESTAMP '1998-06-01 00:00:00', date_trunc('minute', issued_at) - INTERVAL 72 HOUR), date_trunc('minute', issued_at)) AS VARCHAR) AS cursor
      FROM (SELECT run_id, issued_at, CASE WHEN run_id % 7 > 1 THEN issued_at END AS s,
        CASE WHEN run_id % 7 > 0 THEN issued_at + to_days(CAST(run_id % 60 - 5 AS INTEGER)) END AS e FROM b_run)""",
)
def c16(t):
    r = F.col("run_id")
    s = F.when(r % 7 > 1, F.col("issued_at"))
    e = F.when(r % 7 > 0, clocks.plus_hours(F.col("issued_at"), (r % 60 - 5) * 24))
    lo, hi = overlay.trailing_window(F.col("issued_at"))
    at = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return t.forecast_runs().select("run_id", overlay.window_problem(s, e).alias("verdict"), overlay.clamp(at, lo, hi).alias("cursor"))


@query(
    "C17_search",
    """SELECT * FROM (SELECT 0 AS kind_rank, 'basin' AS kind, 'basin:' || n_nationkey AS id, n_name AS name FROM nation
      UNION ALL SELECT 1, 'forecast_point', 'fp:' || c_custkey, c_name FROM customer
      UNION ALL SELECT 2, 'station', 'station:' || s_suppkey, s_name FROM supplier)
      WHERE contains(lower(name), '00') OR contains(lower(id), '00') ORDER BY kind_rank, id LIMIT 50""",
)
def c17(t):
    named = [
        ("basin", t.basins().select(F.concat(F.lit("basin:"), "basin").alias("id"), F.col("basin_name").alias("name"))),
        ("forecast_point", t.points().select(F.concat(F.lit("fp:"), "fp").alias("id"), F.col("fp_name").alias("name"))),
        ("station", t.stations().select(F.concat(F.lit("station:"), "station").alias("id"), F.col("station_name").alias("name"))),
    ]
    return selection.search(named, " 00 ")


KEY_SQL = """'land/cycle.' || l_linenumber || '/' || CASE l_suppkey % 7 WHEN 0 THEN 'channel_rt' WHEN 1 THEN 'land' WHEN 2 THEN 'reservoir'
  WHEN 3 THEN 'terrain_rt' WHEN 4 THEN 'forcing' WHEN 5 THEN 'land.channel_rt' ELSE 'x' END || '.nc'"""


def object_keys(t):
    s = F.col("l_suppkey") % 7
    name = (
        F.when(s == 0, "channel_rt").when(s == 1, "land").when(s == 2, "reservoir").when(s == 3, "terrain_rt")
        .when(s == 4, "forcing").when(s == 5, "land.channel_rt").otherwise("x")
    )
    return t.lineitem().withColumn("key", F.concat(F.lit("land/cycle."), "l_linenumber", F.lit("/"), name, F.lit(".nc")))


@query(
    "C18_object_kind",
    """SELECT kind, count(*) AS n, count(DISTINCT l_linenumber) AS n_cycles FROM (SELECT l_linenumber, CASE l_suppkey % 7 WHEN 0 THEN 'channel_rt' WHEN 1 THEN 'land'
      WHEN 2 THEN 'reservoir' WHEN 3 THEN 'terrain_rt' WHEN 4 THEN 'forcing' WHEN 5 THEN 'channel_rt' ELSE 'other' END AS kind FROM lineitem) GROUP BY ALL""",
)
def c18(t):
    return (
        object_keys(t).groupBy(overlay.object_kind(F.col("key")).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_linenumber").alias("n_cycles"))
    )


@query(
    "C19_header_time",
    """SELECT event_id AS id, strftime(ts, '%d%H%M') = strftime(ts + to_minutes(CAST(event_id % 2 AS INTEGER)), '%d%H%M') AS matches FROM events""",
)
def c19(t):
    issued = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 2) * 60_000_000)
    return t.events().select(F.col("event_id").alias("id"), overlay.header_matches(F.date_format("ts", "ddHHmm"), issued).alias("matches"))


@query(
    "C20_id_patterns",
    """SELECT c_custkey AS fp, regexp_matches('basin:' || lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '_x' ELSE '-x' END, '^basin:[a-z0-9-]+$') AS basin_ok,
      regexp_matches(upper(substr(c_mktsegment, 1, 3)) || c_custkey, '^[A-Z0-9]{3,8}$') AS lid_ok,
      regexp_matches('station:usgs:' || c_name, '^station:[a-z]+:[A-Za-z0-9._-]+$') AS station_ok,
      CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS reach FROM customer""",
)
def c20(t):
    k = F.col("c_custkey")
    basin = F.concat(F.lit("basin:"), F.lower("c_mktsegment"), F.when(k % 3 == 0, "_x").otherwise("-x"))
    lid = F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), k.cast("string"))
    reach = F.concat(F.lit("reach:nwm:"), k.cast("string"), F.when(k % 2 == 0, "").otherwise("b"))
    return t.read("customer").select(
        k.alias("fp"),
        basin.rlike(overlay.ID_PATTERNS["basin"]).alias("basin_ok"),
        lid.rlike(overlay.ID_PATTERNS["lid"]).alias("lid_ok"),
        F.concat(F.lit("station:usgs:"), "c_name").rlike(overlay.ID_PATTERNS["station"]).alias("station_ok"),
        overlay.reach_number(reach).alias("reach"),
    )


@query(
    "C21_field_units",
    """SELECT field, grid_hash, CASE WHEN refusal IS NULL THEN CASE parameter WHEN 'precipitation' THEN 'mm' ELSE 'm' END END AS unit, flag, refusal FROM (
      SELECT *, CASE WHEN parameter = 'snow_level' AND native = 'unknown' THEN 'unit_from_documentation' END AS flag,
        CASE WHEN parameter = 'wind' THEN 'unknown_parameter' WHEN parameter = 'precipitation' AND native <> 'kg m**-2' THEN 'unexpected_unit'
          WHEN parameter = 'snow_level' AND native NOT IN ('m', 'unknown') THEN 'unexpected_unit' END AS refusal FROM (
      SELECT vec_id AS field, label AS grid_hash, CASE label % 3 WHEN 0 THEN 'precipitation' WHEN 1 THEN 'snow_level' ELSE 'wind' END AS parameter,
        CASE vec_id % 4 WHEN 0 THEN 'kg m**-2' WHEN 1 THEN 'm' WHEN 2 THEN 'unknown' ELSE 'mm' END AS native FROM embeddings))""",
)
def c21(t):
    p = F.when(F.col("label") % 3 == 0, "precipitation").when(F.col("label") % 3 == 1, "snow_level").otherwise("wind")
    v = F.col("vec_id") % 4
    native = F.when(v == 0, "kg m**-2").when(v == 1, "m").when(v == 2, "unknown").otherwise("mm")
    s = overlay.field_unit(p, native)
    return t.read("embeddings").select(F.col("vec_id").alias("field"), F.col("label").alias("grid_hash"), s["unit"].alias("unit"), s["flag"].alias("flag"), s["refusal"].alias("refusal"))


@query(
    "C22_backfilled",
    """SELECT fp, count(*) AS runs, count_if(b) AS backfilled, bool_or(b) AS series_backfilled FROM (
      SELECT fp, run_id % 13 = 0 OR product = '5-LOW' OR (run_id % 9) * 24 > 168 AS b FROM b_run) GROUP BY ALL""",
)
def c22(t):
    r = F.col("run_id")
    quality = F.when(r % 13 == 0, F.array(F.lit("approved"), F.lit("backfilled")))
    product = F.when(F.col("product") == "5-LOW", overlay.RECONSTRUCTED_PRODUCT).otherwise(F.col("product"))
    b = overlay.is_backfilled(quality, product, F.col("issued_at"), clocks.plus_hours(F.col("issued_at"), (r % 9) * 24))
    return (
        t.forecast_runs().select("fp", b.alias("b")).groupBy("fp")
        .agg(F.count(F.lit(1)).alias("runs"), F.count_if("b").alias("backfilled"), F.bool_or("b").alias("series_backfilled"))
    )


@query(
    "C23_window_clip",
    """SELECT run_id, count(*) AS n, count_if(keep) AS n_in, count_if(keep AND flow <> -9999) AS n_valued, max(CASE WHEN keep AND flow <> -9999 THEN flow END) AS top FROM (
      SELECT run_id, CASE WHEN lead = 4 THEN -9999 ELSE flow END AS flow, valid_time > issued_at + INTERVAL 6 HOUR AND valid_time <= issued_at + INTERVAL 36 HOUR AS keep FROM b_val) GROUP BY ALL""",
)
def c23(t):
    keep = overlay.inside(F.col("valid_time"), clocks.plus_hours(F.col("issued_at"), 6), clocks.plus_hours(F.col("issued_at"), 36))
    flow = F.nullif(F.when(F.col("lead") == 4, F.lit(-9999.0)).otherwise(F.col("flow")), F.lit(-9999.0))
    return (
        t.run_values().select("run_id", keep.alias("keep"), F.when(keep, flow).alias("v")).groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("n_in"), F.count("v").alias("n_valued"), F.max("v").alias("top"))
    )


@query(
    "C24_suspect_qc",
    """SELECT l_suppkey AS site, count(*) AS n, count_if(coalesce(CASE l_returnflag WHEN 'A' THEN NULL ELSE l_returnflag END, 'V') NOT IN ('S', 'N')) AS usable FROM lineitem GROUP BY ALL""",
)
def c24(t):
    qc = F.nullif(F.col("l_returnflag"), F.lit("A"))
    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.count(F.lit(1)).alias("n"), F.count_if(overlay.usable_qc(qc)).alias("usable"))


@query(
    "C25_shared_datum",
    f"""SELECT fp, CASE WHEN count(DISTINCT coalesce(datum, '-')) = 1 THEN max(datum) END AS datum, count(*) AS n FROM {AXIS_SQL} GROUP BY fp""",
)
def c25(t):
    return selection.shared_value(with_axis(t), ["fp"], "datum", "datum")

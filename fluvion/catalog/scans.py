"""Source scans over documents rendered from the given tables, a bounded page at a time."""

from pyspark.sql import functions as F

from fluvion.catalog.registry import query
from fluvion.operators import thresholds
from fluvion.sources import documents, forecasts, gauges, notices, prototype, snow_stations

PAGE = 200


def lit_null(kind="string"):
    return F.lit(None).cast(kind)


def docs(df, key, body):
    """One document per ``key``; the key bounds how many rows a document holds."""
    return df.groupBy(key).agg(F.to_json(body).alias("content")).withColumn("path", F.concat(F.lit("landed/"), F.col(key).cast("string")))


def zulu(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def reading_pages(t):
    """Pages of at most 200 readings; every ninth page carries a reading without a value."""
    page = F.floor(F.col("event_id") / PAGE)
    code = F.when(F.col("event_type") == "view", "00060").when(F.col("event_type") == "click", "00065").otherwise("00010")
    broken = (page % 9 == 0) & (F.col("event_id") % PAGE == 7)
    p = F.struct(
        F.concat(F.lit("USGS-"), "user_id").alias("monitoring_location_id"), code.alias("parameter_code"), F.lit("00011").alias("statistic_id"), zulu("ts").alias("time"),
        F.when(~broken, F.col("value").cast("string")).alias("value"), F.lit("ft^3/s").alias("unit_of_measure"),
        F.when(F.col("event_id") % 2 == 0, "Approved").otherwise("Provisional").alias("approval_status"), F.array(F.lit("e")).alias("qualifier"),
    )
    rows = t.events().select(page.alias("page"), F.struct(p.alias("properties")).alias("f"))
    nxt = F.struct(F.lit("next").alias("rel"), F.concat(F.lit("page="), F.col("page") + 1).alias("href"))
    return docs(rows, "page", F.struct(F.collect_list("f").alias("features"), F.count(F.lit(1)).alias("numberReturned"), F.array(F.first(nxt)).alias("links")))


@query(
    "A1_continuous_readings",
    """SELECT 'landed/' || event_id // 200 AS path, 'USGS-' || user_id AS site, CASE event_type WHEN 'view' THEN 'flow' WHEN 'click' THEN 'stage' END AS variable, value, CASE WHEN event_id % 2 = 0 THEN 'Approved' ELSE 'Provisional' END AS approval, CAST(date_trunc('second', ts) AS VARCHAR) AS valid_time
      FROM events WHERE event_id // 200 NOT IN (SELECT event_id // 200 FROM events WHERE (event_id // 200) % 9 = 0 AND event_id % 200 = 7)""",
)
def a1(t):
    return gauges.continuous_rows(gauges.continuous(reading_pages(t))).select("path", "site", "variable", "value", "approval", "valid_time")


@query(
    "A1_refused_pages",
    """SELECT 'landed/' || event_id // 200 AS path, 'missing_required_field' AS refusal FROM events WHERE (event_id // 200) % 9 = 0 AND event_id % 200 = 7""",
)
def a1b(t):
    return documents.refusals(gauges.continuous(reading_pages(t)))


@query(
    "A2_nested_series",
    """SELECT 'landed/' || event_id // 200 AS path, CASE event_type WHEN 'view' THEN 'flow' ELSE 'stage' END AS variable, CASE WHEN event_id % 10 <> 0 AND event_id % 10 <> 1 THEN value END AS value, CASE event_id % 10 WHEN 0 THEN 'sentinel' WHEN 1 THEN 'unparseable' ELSE 'ok' END AS flag, CAST(date_trunc('second', ts) - INTERVAL 2 HOUR AS VARCHAR) AS valid_time
      FROM events WHERE event_type IN ('view', 'click')""",
)
def a2(t):
    raw = F.when(F.col("event_id") % 10 == 0, "-999999").when(F.col("event_id") % 10 == 1, "Ice").otherwise(F.col("value").cast("string"))
    code = F.when(F.col("event_type") == "view", "00060").when(F.col("event_type") == "click", "00065").otherwise("00010")
    v = F.struct(raw.alias("value"), F.array(F.lit("P")).alias("qualifiers"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("dateTime"))
    rows = t.events().select(F.floor(F.col("event_id") / PAGE).alias("page"), code.alias("code"), v.alias("v")).groupBy("page", "code").agg(F.collect_list("v").alias("vs"))
    series = F.struct(
        F.struct(F.array(F.struct(F.col("code").alias("value"))).alias("variableCode"), F.struct(F.lit("ft3/s").alias("unitCode")).alias("unit"), F.lit(-999999.0).alias("noDataValue")).alias("variable"),
        F.array(F.struct(F.col("vs").alias("value"))).alias("values"),
    )
    d = docs(rows.select("page", series.alias("s")), "page", F.struct(F.struct(F.collect_list("s").alias("timeSeries")).alias("value")))
    return gauges.nested_series(d).select("path", "variable", "value", F.coalesce("flag", F.lit("ok")).alias("flag"), "valid_time")


def daily_files(t):
    """One file per (site, month); some name another site inside, some lack the approval column."""
    day = t.lineitem().groupBy(F.col("l_suppkey").alias("s"), "day").agg(F.max("l_quantity").alias("q"), F.max("l_linestatus").alias("st"))
    day = day.withColumn("m", F.trunc("day", "month")).withColumn("bad", (F.col("s") + F.month("day")) % 11 == 0)
    named = F.when(F.col("bad"), F.col("s") + 1).otherwise(F.col("s"))
    line = F.concat_ws(",", F.date_format("day", "yyyy-MM-dd"), F.when(F.col("q") == 7, "").otherwise(F.col("q").cast("string")), F.when(F.col("st") == "F", "Approved").otherwise("Provisional"), F.concat(F.lit("USGS-"), named))
    g = day.groupBy("s", "m").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    header = F.when((F.col("s") % 13) == 5, "time,value,approval,monitoring_location_id").otherwise("time,value,approval_status,monitoring_location_id")
    return g.select(
        F.concat(F.lit("USGS-"), "s").alias("site"), F.concat_ws("/", "s", "m").alias("path"), F.concat_ws("\n", header, F.concat_ws("\n", F.reverse("lines"))).alias("content")
    )


@query(
    "A3_daily_csv",
    """SELECT 'USGS-' || l_suppkey AS site, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, nullif(CAST(max(l_quantity) AS VARCHAR), '7.0') AS raw, CASE WHEN max(l_linestatus) = 'F' THEN 'Approved' ELSE 'Provisional' END AS approval FROM lineitem WHERE l_suppkey % 13 <> 5 AND (l_suppkey + month(l_shipdate)) % 11 <> 0 GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
)
def a3(t):
    return gauges.daily_rows(gauges.daily_csv(daily_files(t))).select("site", "day", "raw", "approval")


@query(
    "A3_refused_files",
    """SELECT refusal, count(*) AS n FROM (SELECT DISTINCT l_suppkey, date_trunc('month', l_shipdate), CASE WHEN l_suppkey % 13 = 5 THEN 'missing_column' ELSE 'foreign_site' END AS refusal FROM lineitem WHERE l_suppkey % 13 = 5 OR (l_suppkey + month(l_shipdate)) % 11 = 0) GROUP BY ALL""",
)
def a3b(t):
    return documents.refusals(gauges.daily_csv(daily_files(t))).groupBy("refusal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A4_latest_daily",
    """SELECT CAST(l_suppkey AS VARCHAR) AS site, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS day, max(l_quantity) FILTER (WHERE l_shipdate = m) AS value FROM (SELECT *, max(l_shipdate) OVER (PARTITION BY l_suppkey) AS m FROM lineitem) GROUP BY l_suppkey""",
)
def a4(t):
    latest = t.lineitem().groupBy("l_suppkey").agg(F.max(F.struct("day", F.col("l_quantity").alias("q"))).alias("b"))
    p = F.struct(F.concat(F.lit("USGS-"), "l_suppkey").alias("monitoring_location_id"), F.col("b.day").cast("string").alias("time"), (F.col("b.q") + F.col("kind.off")).cast("string").alias("value"),
        F.lit("Provisional").alias("approval_status"), F.col("kind.parameter_code").alias("parameter_code"), F.col("kind.statistic_id").alias("statistic_id"))
    # beside the daily mean discharge: its daily maximum and the daily mean stage
    kinds = F.array(*(F.struct(F.lit(a).alias("parameter_code"), F.lit(b).cast("string").alias("statistic_id"), F.lit(c).alias("off")) for a, b, c in (("00060", "00003", 0), ("00060", "00001", 7), ("00065", "00003", -7))))
    rows = latest.withColumn("kind", F.explode(kinds)).select(F.floor(F.col("l_suppkey") / 50).alias("page"), F.struct(p.alias("properties")).alias("f"))
    return gauges.latest_daily(docs(rows, "page", F.struct(F.collect_list("f").alias("features")))).select("site", "day", "value")


@query(
    "A5_rdb_percentiles",
    """SELECT CAST(s AS VARCHAR) AS site, CAST(mo AS INTEGER) AS month, CAST(d AS INTEGER) AS dom, n, level, CASE level WHEN 5 THEN lo WHEN 50 THEN hi - 1 ELSE hi END AS value FROM (SELECT l_suppkey AS s, month(l_shipdate) AS mo, day(l_shipdate) AS d, CAST(count(*) AS INTEGER) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL), (VALUES (5), (50), (95)) AS v(level) WHERE NOT (level = 50 AND n < 2)""",
)
def a5(t):
    g = t.lineitem().groupBy(F.col("l_suppkey").alias("s"), F.month("day").alias("mo"), F.dayofmonth("day").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    line = F.concat_ws("\t", F.lit("USGS"), "s", "mo", "d", F.lit("1995"), F.lit("2001"), "n", "lo", F.when(F.col("n") > 1, (F.col("hi") - 1).cast("string")).otherwise(""), "hi")
    head = "# comment\n#\nagency_cd\tsite_no\tmonth_nu\tday_nu\tbegin_yr\tend_yr\tcount_nu\tp05_va\tp50_va\tp95_va\n5s\t15s\t2n\t2n\t4n\t4n\t8n\t12s\t12s\t12s\n"
    d = g.groupBy("s").agg(F.concat(F.lit(head), F.concat_ws("\n", F.collect_list(line))).alias("content")).withColumn("path", F.concat(F.lit("rdb/"), "s"))
    return gauges.rdb_table(d).select("site", "month", "dom", "n", "level", "value")


def normals_docs(t):
    g = t.lineitem().groupBy(F.col("l_suppkey").alias("s"), F.date_format("day", "MM-dd").alias("md")).agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    text = lambda c: F.col(c).cast("string")
    vals = F.when((F.col("s") % 17 == 3) & (F.col("md") == "02-03"), F.array(text("lo"))).otherwise(F.array(text("lo"), F.when(F.col("n") > 1, text("hi")).otherwise("nan"), F.lit("1.0")))
    row = F.struct(F.col("md").alias("month_day"), F.col("n").cast("int").alias("n"), F.array(F.lit("5"), F.lit("50"), F.lit("33")).alias("levels"), vals.alias("values"))
    return docs(g.select("s", row.alias("r")), "s", F.struct(F.first(F.concat(F.lit("USGS-"), F.col("s"))).alias("site"), F.collect_list("r").alias("rows")))


BAD_NORMALS = "(SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 17 = 3 AND strftime(l_shipdate, '%m-%d') = '02-03')"


@query(
    "A6_published_normals",
    f"""SELECT 'USGS-' || s AS site, md AS month_day, n, level, CASE level WHEN 5 THEN lo ELSE hi END AS value FROM (SELECT l_suppkey AS s, strftime(l_shipdate, '%m-%d') AS md, CAST(count(*) AS INTEGER) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_suppkey NOT IN {BAD_NORMALS} GROUP BY ALL), (VALUES (5), (50)) AS v(level) WHERE NOT (level = 50 AND n = 1)""",
)
def a6(t):
    return gauges.normal_rows(gauges.normals(normals_docs(t))).select("site", "month_day", "n", "level", "value")


def gauge_docs(t):
    k, v = F.col("c_custkey"), F.round(F.abs("c_acctbal") / 100, 2)
    cat = lambda m: F.struct(F.when((k % 4 == 0) | (k % 10 == m), F.lit(-9999.0)).otherwise(v + m).alias("stage"), F.when(k % 8 == 0, F.lit(-9999.0)).otherwise(v * m).alias("flow"))
    cats = F.create_map(F.lit("action"), cat(1), F.lit("minor"), cat(2), F.lit("moderate"), cat(3), F.lit("major"), cat(4))
    body = F.struct(
        F.concat(F.lit("L"), k).alias("lid"), F.when(k % 6 != 1, "NAVD88").alias("datum"), F.lit("ft").alias("stage_units"), F.lit("kcfs").alias("flow_units"), F.struct(cats.alias("categories")).alias("flood")
    )
    return t.read("customer").select(F.concat(F.lit("gauges/"), k).alias("path"), F.to_json(body).alias("content"))


GAUGE_SQL = """(SELECT 'L' || c_custkey AS lid, c_custkey AS k, CASE WHEN c_custkey % 6 <> 1 THEN 'NAVD88' END AS datum, category, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 10 = m THEN NULL ELSE round(abs(c_acctbal) / 100, 2) + m END AS stage,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE round(abs(c_acctbal) / 100, 2) * m END AS flow FROM customer, (VALUES ('action', 1), ('minor', 2), ('moderate', 3), ('major', 4)) AS v(category, m))"""


@query("A7_gauge_thresholds", f"SELECT lid, datum, category, round(stage, 6) AS stage, round(flow, 6) AS flow FROM {GAUGE_SQL}")
def a7(t):
    return gauges.gauge_thresholds(gauge_docs(t)).drop("flow_unit")


@query(
    "L20_storable_thresholds",
    f"""WITH g AS (SELECT *, count(stage) OVER (PARTITION BY lid) AS ns, count(flow) OVER (PARTITION BY lid) AS nf FROM {GAUGE_SQL})
      SELECT lid, category, CASE WHEN ns > 0 THEN 'stage' WHEN nf > 0 THEN 'flow' END AS basis, round(CASE WHEN ns > 0 AND datum IS NOT NULL THEN stage WHEN ns = 0 THEN flow * 1000 END, 6) AS value, CASE WHEN ns > 0 AND datum IS NULL THEN 'stage_without_datum' WHEN ns = 0 AND nf = 0 THEN 'no_thresholds' ELSE 'ok' END AS reason
      FROM g WHERE (ns > 0 AND datum IS NULL) OR (ns = 0 AND nf = 0) OR (CASE WHEN ns > 0 THEN stage ELSE flow END) IS NOT NULL""",
)
def l20(t):
    return thresholds.from_gauge(gauges.gauge_thresholds(gauge_docs(t)))


def lead_values(t):
    """One value per (run, lead): what a hydrograph document holds."""
    return t.run_values().groupBy("run_id", "product", "issued_at", "lead", "valid_time").agg(F.max("stage").alias("stage"), F.max("flow").alias("flow"))


@query(
    "A8_stage_flow",
    """SELECT 'P' || run_id AS lid, CAST(issued_at AS VARCHAR) AS issued_at, CAST(row_number() OVER (PARTITION BY run_id ORDER BY lead) - 1 AS INTEGER) AS pos, CAST(valid_time AS VARCHAR) AS valid_time, CASE WHEN lead <> 3 THEN stage END AS primary_value, flow AS secondary_value FROM (SELECT run_id, issued_at, lead, valid_time, max(stage) AS stage, max(flow) AS flow FROM b_val GROUP BY ALL)""",
)
def a8(t):
    p = F.struct("lead", zulu("valid_time").alias("validTime"), F.when(F.col("lead") == 3, F.lit(-9999.0)).otherwise(F.col("stage")).alias("primary"), F.col("flow").alias("secondary"))
    g = lead_values(t).groupBy("run_id", "issued_at").agg(F.sort_array(F.collect_list(p)).alias("data"))
    body = F.struct(F.concat(F.lit("P"), "run_id").alias("lid"), F.struct(zulu("issued_at").alias("issuedTime"), F.lit("Stage").alias("primaryName"), F.lit("ft").alias("primaryUnits"), F.lit("Flow").alias("secondaryName"), F.lit("kcfs").alias("secondaryUnits"), "data").alias("forecast"))
    s = forecasts.stage_flow(g.select(F.concat(F.lit("sf/"), "run_id").alias("path"), F.to_json(body).alias("content")))
    return s.select("lid", "issued_at", "pos", "valid_time", F.col("primary").alias("primary_value"), F.col("secondary").alias("secondary_value"))


def member_leads(t):
    return t.run_values().groupBy("run_id", "issued_at", "member", "lead", "valid_time").agg(F.max("flow").alias("flow"))


MEMBER_SQL = "(SELECT run_id, issued_at, member, lead, valid_time, max(flow) AS flow FROM b_val GROUP BY ALL)"


@query(
    "A9_model_ensemble",
    f"""SELECT 'R' || run_id AS reach, CAST(member AS INTEGER) AS member, member = 0 AS is_mean, CAST(issued_at AS VARCHAR) AS cycle, CAST(valid_time AS VARCHAR) AS valid_time, CASE WHEN lead <> 5 THEN flow END AS flow FROM {MEMBER_SQL} WHERE run_id % 14 <> 0""".replace("CAST(member AS INTEGER) AS member", "CASE WHEN member > 0 THEN CAST(member + 8 AS INTEGER) END AS member"),
)
def a9(t):
    point = F.struct(zulu("valid_time").alias("validTime"), F.when(F.col("lead") == 5, F.lit(-9999.0)).otherwise(F.col("flow")).alias("flow"))
    s = member_leads(t).groupBy("run_id", "issued_at", "member").agg(F.collect_list(point).alias("data"))
    name = F.when(F.col("member") == 0, "mean").otherwise(F.concat(F.lit("member"), F.col("member") + 8))
    series = F.struct(zulu("issued_at").alias("referenceTime"), F.when(F.col("run_id") % 14 == 0, "acre-feet").otherwise("ft³/s").alias("units"), "data")
    g = s.select("run_id", F.struct(name.alias("k"), series.alias("v")).alias("e"))
    d = docs(g, "run_id", F.struct(F.first(F.concat(F.lit("R"), F.col("run_id"))).alias("reach"), F.map_from_entries(F.collect_list("e")).alias("mediumRange")))
    return forecasts.medium_range(d).select("reach", "member", "is_mean", "cycle", "valid_time", "flow")


def ensemble_docs(t):
    event = F.struct(zulu("valid_time").alias("valid_datetime"), F.when(F.col("lead") == 2, "-999").otherwise(F.col("flow").cast("string")).alias("value"))
    s = member_leads(t).groupBy("run_id", "issued_at", "member").agg(F.collect_list(event).alias("events"))
    r, m = F.col("run_id"), F.col("member")
    head = F.struct(
        F.when((r % 19 == 0) & (m == 3), F.concat(F.lit("X"), r)).otherwise(F.concat(F.lit("H"), r)).alias("location_id"), F.lit("QINE").alias("parameter_id"), F.lit("MEFP").alias("ensemble_id"),
        zulu("issued_at").alias("forecast_datetime"), zulu("issued_at").alias("creation_datetime"), F.lit("CFS").alias("units"), F.lit("second").alias("time_step_unit"),
        F.when(r % 23 == 0, "0").otherwise("21600").alias("time_step_multiplier"), (m + 1960).cast("string").alias("ensemble_member_index"), F.lit("-999").alias("miss_val"), "events",
    )
    g = s.select("run_id", head.alias("h")).groupBy("run_id").agg(F.collect_list("h").alias("members"))
    return g.select(F.concat(F.lit("hefs/"), "run_id").alias("path"), F.to_json(F.array("members")).alias("content"))


@query(
    "A10_ensemble_members",
    f"""WITH x AS (SELECT run_id FROM {MEMBER_SQL} GROUP BY run_id HAVING run_id % 23 = 0 OR (run_id % 19 = 0 AND count(DISTINCT member) > 1 AND count_if(member = 3) > 0))
      SELECT CASE WHEN run_id % 19 = 0 AND member = 3 THEN 'X' ELSE 'H' END || run_id AS location_id, CAST(member + 1960 AS INTEGER) AS member, CAST(valid_time AS VARCHAR) AS valid_time, CASE WHEN lead <> 2 THEN flow END AS value FROM {MEMBER_SQL} WHERE run_id NOT IN (SELECT run_id FROM x)""",
)
def a10(t):
    return forecasts.ensemble_rows(forecasts.ensembles(ensemble_docs(t))).select("location_id", "member", "valid_time", "value")


@query(
    "A10_refused_groups",
    f"""SELECT refusal, count(*) AS n FROM (SELECT run_id, CASE WHEN run_id % 23 = 0 THEN 'implausible_step' WHEN run_id % 19 = 0 AND count(DISTINCT member) > 1 AND count_if(member = 3) > 0 THEN 'mixed_group' END AS refusal FROM {MEMBER_SQL} GROUP BY run_id) WHERE refusal IS NOT NULL GROUP BY ALL""",
)
def a10b(t):
    return documents.refusals(forecasts.ensembles(ensemble_docs(t))).groupBy("refusal").agg(F.count(F.lit(1)).alias("n"))


def quantile_docs(t):
    """Exceedance ladders: values fall as the exceedance level rises; some rows miss a value."""
    v = lead_values(t)
    vals = F.when((F.col("run_id") % 31 == 0) & (F.col("lead") == 1), F.array(F.col("flow"))).otherwise(F.array(F.col("flow") * 2, F.col("flow"), F.col("flow") / 2))
    row = F.struct(zulu("valid_time").alias("valid_datetime"), vals.alias("quantile_values"), (F.col("flow") * 3).alias("max_value"), (F.col("flow") / 4).alias("min_value"))
    g = v.select("run_id", "issued_at", row.alias("r")).groupBy("run_id", "issued_at").agg(F.collect_list("r").alias("value_set"))
    meta = F.struct(F.concat(F.lit("Q"), "run_id").alias("location_id"), zulu("issued_at").alias("forecast_datetime"), F.lit("CFS").alias("units"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)).alias("exceedance_quantiles"))
    return g.select(F.concat(F.lit("q/"), "run_id").alias("path"), F.to_json(F.struct(meta.alias("metadata"), "value_set")).alias("content"))


BAD_Q = "(SELECT DISTINCT run_id FROM b_val WHERE run_id % 31 = 0 AND lead = 1)"


@query(
    "A11_exceedance_quantiles",
    f"""SELECT 'Q' || run_id AS location_id, CAST(valid_time AS VARCHAR) AS valid_time, level, round(CASE level WHEN 0.05 THEN flow * 2 WHEN 0.5 THEN flow ELSE flow / 2 END, 6) AS value, round(flow * 3, 6) AS max_value FROM (SELECT run_id, valid_time, max(flow) AS flow FROM b_val WHERE run_id NOT IN {BAD_Q} GROUP BY ALL), (VALUES (0.05::DOUBLE), (0.5), (0.95)) AS v(level)""",
)
def a11(t):
    return forecasts.quantile_rows(forecasts.quantiles(quantile_docs(t))).select("location_id", "valid_time", "level", "value", "max_value")


@query(
    "A12_snow_stations",
    """SELECT s_suppkey || ':WA:SNTL' AS station, s_name AS name, '1711' || lpad(CAST(s_nationkey AS VARCHAR), 4, '0') AS huc8, s_acctbal AS elevation, CASE WHEN s_suppkey % 5 <> 0 THEN -8.0::DOUBLE END AS utc_offset_h, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS n_associated FROM supplier""",
)
def a12(t):
    k = F.col("s_suppkey")
    huc = F.format_string("1711%04d0102", "s_nationkey")
    s = F.struct(
        F.concat(k, F.lit(":WA:SNTL")).alias("stationTriplet"), F.col("s_name").alias("name"), huc.alias("huc"), F.col("s_acctbal").alias("elevation"),
        F.when(k % 5 != 0, F.lit(-8.0)).alias("dataTimeZone"), F.when(k % 3 != 0, F.array(huc)).alias("associatedHucs"),
    )
    d = docs(t.read("supplier").select(F.floor(k / 50).alias("page"), s.alias("s")), "page", F.struct(F.collect_list("s").alias("stations")))
    return snow_stations.stations(d).select("station", "name", "huc8", "elevation", "utc_offset_h", F.size("associated").alias("n_associated"))


@query(
    "A12_snow_values",
    """SELECT l_suppkey AS station, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, CASE WHEN max(l_quantity) <> 9 THEN max(l_quantity) END AS value, min(l_quantity) AS median, CASE WHEN min(l_linenumber) = 2 THEN 'S' ELSE 'V' END AS qc_flag FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""".replace("l_suppkey AS station", "CAST(l_suppkey AS VARCHAR) AS station"),
)
def a12b(t):
    g = t.lineitem().groupBy("l_suppkey", "day").agg(F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo"), F.min("l_linenumber").alias("ln"))
    v = F.struct(F.col("day").cast("string").alias("date"), F.when(F.col("hi") == 9, "M").otherwise(F.col("hi").cast("string")).alias("value"), F.col("lo").alias("median"), F.when(F.col("ln") == 2, "S").otherwise("V").alias("qcFlag"))
    y = g.select("l_suppkey", F.year("day").alias("y"), v.alias("v")).groupBy("l_suppkey", "y").agg(F.collect_list("v").alias("values"))
    el = lambda code, depth: F.struct(F.struct(F.lit(code).alias("elementCode"), depth.alias("heightDepth")).alias("stationElement"), F.col("values"))
    body = F.struct(F.col("l_suppkey").cast("string").alias("stationTriplet"), F.array(el("WTEQ", lit_null("int")), el("SMS", F.lit(-8))).alias("data"))
    return snow_stations.values(y.select(F.concat_ws("/", "l_suppkey", "y").alias("path"), F.to_json(body).alias("content"))).drop("element")


@query(
    "A13_alert_messages",
    """SELECT alert_id, status, message_type, CAST(sent AS VARCHAR) AS sent, CAST(ends AS VARCHAR) AS ends, ugc1 || '|' || ugc2 AS ugc, coalesce(reference, '') AS "references" FROM b_alert WHERE conv_id % 10 <> 4""",
)
def a13(t):
    naive = F.date_format("sent", "yyyy-MM-dd'T'HH:mm:ss")
    p = F.struct(
        F.col("alert_id").alias("id"), F.lit("Flood Warning").alias("event"), "status", F.col("message_type").alias("messageType"), F.when(F.col("conv_id") % 10 == 4, naive).otherwise(zulu("sent")).alias("sent"),
        zulu("ends").alias("ends"), zulu("expires").alias("expires"), F.struct(F.col("ugc").alias("UGC")).alias("geocode"), F.transform("references", lambda r: F.struct(r.alias("identifier"))).alias("references"),
    )
    page = F.concat_ws("/", "conv_id", F.floor(F.col("turn") / 100))
    d = docs(t.alerts().select(page.alias("page"), F.struct(p.alias("properties")).alias("f")), "page", F.struct(F.collect_list("f").alias("features")))
    return notices.alerts(d).select("alert_id", "status", "message_type", "sent", "ends", "ugc", "references")


def reservoir_docs(t):
    g = t.lineitem().groupBy(F.col("l_suppkey").alias("s"), "day", (F.col("l_linenumber") % 3).alias("c")).agg(F.max("l_quantity").alias("v"))
    g = g.withColumn("m", F.trunc("day", "month"))
    code = F.element_at(F.array(F.lit("RZ"), F.lit("RG"), F.lit("RR")), F.col("c") + 1)
    when = F.concat(F.col("day").cast("string"), F.when((F.col("s") % 12 == 7), "T08:00:00").otherwise("T08:00:00Z"))
    row = F.concat(
        F.lit('<observedValue petype="'), F.when(F.col("s") % 12 == 5, "HP").otherwise("HF"), F.lit('" tsCode="'), code, F.lit('"><dataDateTime>'), when, F.lit('</dataDateTime><forebay units="ft">'), F.col("v").cast("string"), F.lit("</forebay></observedValue>")
    )
    d = g.groupBy("s", "m").agg(F.concat_ws("", F.collect_list(row)).alias("rows"))
    site = F.when(F.col("s") % 12 == 3, F.lit("OTHER")).otherwise(F.concat(F.lit("D"), "s"))
    return d.select(
        F.concat_ws("/", "s", "m").alias("path"), F.concat(F.lit("D"), "s").alias("lid"), F.lit("HF").alias("pe"),
        F.concat(F.lit('<HydroMetData><SiteData id="'), site, F.lit('">'), F.col("rows"), F.lit("</SiteData></HydroMetData>")).alias("content"),
    )


@query(
    "A14_reservoir_xml",
    """SELECT 'D' || l_suppkey AS lid, CAST(CAST(l_shipdate AS DATE) + INTERVAL 8 HOUR AS VARCHAR) AS valid_time, ['RZ', 'RG', 'RR'][l_linenumber % 3 + 1] AS code, max(l_quantity) AS value, 'ft' AS unit FROM lineitem WHERE l_suppkey % 12 NOT IN (3, 5, 7) GROUP BY l_suppkey, CAST(l_shipdate AS DATE), l_linenumber % 3""",
)
def a14(t):
    return notices.reservoir_rows(notices.reservoir_xml(reservoir_docs(t)))


@query(
    "A14_refused_xml",
    """SELECT CASE l_suppkey % 12 WHEN 3 THEN 'wrong_site' WHEN 5 THEN 'wrong_element' ELSE 'naive_instant' END AS refusal, count(DISTINCT (l_suppkey, date_trunc('month', l_shipdate))) AS n FROM lineitem WHERE l_suppkey % 12 IN (3, 5, 7) GROUP BY ALL""",
)
def a14b(t):
    return documents.refusals(notices.reservoir_xml(reservoir_docs(t))).groupBy("refusal").agg(F.count(F.lit(1)).alias("n"))


def bulletin_docs(t):
    """Two transmissions' worth of segments per run: one segment per lead, two products per document."""
    v = lead_values(t)
    num = F.format_string("%,d", F.floor(F.col("flow") / 10))
    vt = F.date_format("valid_time", "yyMMdd'T'HHmm'Z'")
    crest_time = F.when(F.col("lead") == 2, F.lit("000000T0000Z")).otherwise(vt)
    event = F.concat(F.lit("/"), F.format_string("W%04d", (F.col("run_id") % 10000).cast("int")), F.lit(".1.ER."), vt, F.lit("."), crest_time, F.lit("."), vt, F.lit(".NO/\n"))
    seg = F.concat(
        F.format_string("WAC%03d-\n", (F.col("run_id") % 1000).cast("int")), F.when(F.col("lead") == 3, "/O.CAN.KSEW.FL.W.0041.250101T0000Z-250102T0000Z/\n").otherwise(""), F.lit("/O.NEW.KSEW.FL.W.0042.250101T0000Z-250102T0000Z/\n"),
        event, F.when(F.col("run_id") % 37 == 0, event).otherwise(""), F.when(F.col("lead") == 5, "").otherwise("* At noon the stage was 3.0 feet.\n"), F.when(F.col("lead") == 6, "").otherwise(F.concat(F.lit("* Flood stage is "), F.col("lead").cast("string"), F.lit(",001.0 feet.\n"))),
        F.when(F.col("lead") == 7, "").otherwise(F.concat(F.lit("  - Forecast...The river will rise to "), F.format_string("%.1f", F.col("stage")), F.lit(" feet and then\n    to a crest of "), num, F.lit(" feet tomorrow.\n"))),
        F.lit("  - Impact...at 99.9 feet to of 5 feet.\n"), F.lit("$$\n"),
    )
    head = F.concat(F.lit("WGUS46 KSEW "), F.date_format("issued_at", "ddHHmm"), F.when(F.col("run_id") % 31 == 0, "\n\n").otherwise("\nFLWSEW\n\n"))
    body = v.groupBy("run_id", "issued_at").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("lead", seg.alias("s")))), lambda x: x["s"])).alias("segments"))
    return body.select(
        F.concat(F.lit("afos/"), "run_id").alias("path"),
        F.concat(F.lit("\x01"), F.when(F.col("run_id") % 29 == 0, F.lit("no heading\n")).otherwise(head), F.col("segments"), F.lit("\x03")).alias("content"),
    )


SEG_SQL = """(SELECT run_id, issued_at, lead, valid_time, max(stage) AS stage, max(flow) AS flow FROM b_val WHERE run_id % 29 <> 0 AND run_id % 31 <> 0 AND run_id % 37 <> 0 GROUP BY ALL)"""


@query(
    "A15_bulletin_segments",
    f"""SELECT 'afos/' || run_id AS path, CAST(row_number() OVER (PARTITION BY run_id ORDER BY lead) - 1 AS INTEGER) AS segment_no, strftime(issued_at, '%d%H%M') AS wmo, printf('W%04d', run_id % 10000) AS lid, CAST(CASE WHEN lead <> 2 THEN valid_time END AS VARCHAR) AS crest_time, CASE WHEN lead = 7 THEN 0 ELSE 2 END AS n_mentions , 'FLWSEW' AS pil, CASE WHEN lead = 3 THEN 'CAN|NEW' ELSE 'NEW' END AS actions, CASE WHEN lead <> 5 THEN 3.0::DOUBLE END AS observed, CASE WHEN lead <> 6 THEN lead * 1000.0::DOUBLE + 1 END AS flood_stage FROM {SEG_SQL}""",
)
def a15(t):
    s = notices.segments(notices.bulletins(bulletin_docs(t)))
    return s.select("path", "segment_no", "wmo", "lid", "crest_time", F.size("mentions").alias("n_mentions"), "pil", "actions", "observed", "flood_stage")


@query(
    "A15_refused_bulletins",
    """SELECT CASE WHEN run_id % 29 = 0 THEN 'no_heading' WHEN run_id % 31 = 0 THEN 'no_product_line' ELSE 'several_event_lines' END AS refusal, count(DISTINCT run_id) AS n FROM b_val WHERE run_id % 29 = 0 OR run_id % 31 = 0 OR run_id % 37 = 0 GROUP BY ALL""",
)
def a15b(t):
    return documents.refusals(notices.bulletins(bulletin_docs(t))).groupBy("refusal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "E32_bulletin_crest",
    f"""SELECT 'afos/' || run_id AS path, CAST(row_number() OVER (PARTITION BY run_id ORDER BY lead) - 1 AS INTEGER) AS segment_no, CASE WHEN lead <> 7 THEN greatest(stage, floor(flow / 10)) END AS crest FROM {SEG_SQL}""",
)
def e32(t):
    return notices.segments(notices.bulletins(bulletin_docs(t))).select("path", "segment_no", "crest")


@query(
    "A16_object_listing",
    """SELECT 'mrms/' || strftime(ts, '%Y%m%d-%H%M%S') || '.' || event_id || '.grib2' AS key, CAST(date_trunc('second', ts) AS VARCHAR) AS valid_time, CAST(date_trunc('second', ts) + INTERVAL 3 MINUTE AS VARCHAR) AS modified_at, CAST(value * 100 AS BIGINT) AS size_bytes FROM events""",
)
def a16(t):
    return notices.listing(listing_docs(t))


def listing_docs(t):
    key = F.concat(F.lit("mrms/"), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("."), "event_id", F.lit(".grib2"))
    entry = F.concat(
        F.lit("<Contents><Key>"), key, F.lit("</Key><LastModified>"), zulu(F.col("ts") + F.expr("interval 3 minutes")), F.lit("</LastModified><Size>"), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("</Size></Contents>")
    )
    d = t.events().select(F.floor(F.col("event_id") / PAGE).alias("page"), entry.alias("e")).groupBy("page").agg(F.concat_ws("", F.collect_list("e")).alias("body"))
    return d.select("page", F.concat(F.lit("listing/"), "page").alias("path"), F.concat(F.lit("<ListBucketResult>"), "body", F.lit("</ListBucketResult>")).alias("content"))


@query("A16_refused_pages", f"""SELECT 'malformed' AS refusal, count(DISTINCT event_id // {PAGE}) AS n FROM events WHERE event_id // {PAGE} % 5 = 3 HAVING count(*) > 0""")
def a16b(t):
    """Every fifth page lands a second time, cut off; the broken copy is refused, the whole one is read."""
    d = listing_docs(t)
    broken = d.filter(F.col("page") % 5 == 3).withColumn("content", F.expr("left(content, length(content) - 25)"))
    return documents.refusals(notices.listing_pages(d.unionByName(broken))).groupBy("refusal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A17_polygons",
    """SELECT s_suppkey AS basin, part, ring, x, y FROM supplier, (VALUES (0, 0, 0, 0), (0, 0, 4, 0), (0, 0, 4, 3), (0, 1, 1, 1), (0, 1, 2, 1), (0, 1, 2, 2), (1, 0, 10, 10), (1, 0, 12, 10), (1, 0, 12, 12)) AS v(part, ring, dx, dy), LATERAL (SELECT s_suppkey + dx + 0.5::DOUBLE AS x, dy + 0.25::DOUBLE AS y) WHERE s_suppkey % 3 <> 2 AND (part = 0 OR s_suppkey % 3 = 1)""".replace("s_suppkey AS basin", "CAST(s_suppkey AS VARCHAR) AS basin"),
)
def a17(t):
    k = F.col("s_suppkey")
    pt = lambda dx, dy: F.array(k + dx + F.lit(0.5), F.lit(dy + 0.25))
    outer, hole, second = F.array(pt(0, 0), pt(4, 0), pt(4, 3)), F.array(pt(1, 1), pt(2, 1), pt(2, 2)), F.array(pt(10, 10), pt(12, 10), pt(12, 12))
    poly = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(outer, hole).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(outer, hole), F.array(second)).alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), outer.alias("coordinates")))
    geometry = F.when(k % 3 == 0, poly).when(k % 3 == 1, multi).otherwise(line)
    content = F.concat(F.lit('{"features":[{"properties":{"id":"'), k.cast("string"), F.lit('"},"geometry":'), geometry, F.lit("}]}"))
    r = notices.polygons(t.read("supplier").select(F.concat(F.lit("geo/"), k).alias("path"), content.alias("content")))
    return r.select("basin", "part", "ring", F.explode("pts").alias("p")).select("basin", "part", "ring", "p.x", "p.y")


@query(
    "A18_gazetteer",
    """SELECT name, feature_class, county, lon FROM (SELECT l_returnflag || l_quantity AS name, l_linestatus AS feature_class, 'c' || l_linenumber AS county, l_extendedprice AS lon, row_number() OVER (PARTITION BY l_returnflag, l_quantity, l_linestatus, l_linenumber ORDER BY l_orderkey // 40, l_partkey // 500, l_orderkey, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""".replace("l_returnflag || l_quantity", "l_returnflag || CAST(l_quantity AS VARCHAR)"),
)
def a18(t):
    line = F.concat_ws("|", F.concat("l_returnflag", F.col("l_quantity").cast("string")), "l_linestatus", F.concat(F.lit("c"), "l_linenumber"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("47.5"))
    page = F.format_string("%012d/%012d", F.floor(F.col("l_orderkey") / 40), F.floor(F.col("l_partkey") / 500))
    rows = t.read("lineitem").select(page.alias("page"), F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber").alias("o"), line.alias("line"))
    d = rows.groupBy("page").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda x: x["line"])).alias("content"))
    return notices.gazetteer(d.select(F.concat(F.lit("gnis/"), "page").alias("path"), "content")).select("name", "feature_class", "county", "lon")


@query(
    "A21_elevation_curves",
    """SELECT CAST(s_suppkey AS VARCHAR) AS basin, CASE WHEN s_suppkey % 7 = 0 THEN 'missing:total_km2' WHEN s_suppkey % 11 = 0 THEN 'missing:max_m' ELSE 'ok' END AS refusal, 3 AS n_bins FROM supplier""",
)
def a21(t):
    k = F.col("s_suppkey")
    b = F.struct(
        k.cast("string").alias("id"), F.lit(0.0).alias("origin_m"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("counts_km2"), F.lit(0.5).alias("under_km2"), F.lit(0.0).alias("over_km2"),
        F.when(k % 7 != 0, F.lit(6.5)).alias("total_km2"), F.lit(-1.0).alias("min_m"), F.when(k % 11 != 0, F.lit(59.0)).alias("max_m"),
    )
    d = docs(t.read("supplier").select(F.floor(k / 20).alias("page"), b.alias("b")), "page", F.struct(F.collect_list("b").alias("basins")))
    c = notices.elevation_curves(d)
    return c.select(F.col("id").alias("basin"), F.coalesce("refusal", F.lit("ok")).alias("refusal"), F.size("counts_km2").alias("n_bins"))


@query(
    "A22_reread_archived",
    """SELECT 'USGS-' || l_suppkey AS site, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_days FROM lineitem WHERE l_suppkey % 13 <> 5 AND (l_suppkey + month(l_shipdate)) % 11 <> 0 AND year(l_shipdate) >= 1999 GROUP BY l_suppkey""",
)
def a22(t):
    """Archived files are found by content key and parsed again to rebuild a derived table."""
    stored = daily_files(t).withColumn("sha256", F.sha2("content", 256))
    wanted = stored.filter(F.substring_index("path", "/", -1) >= "1999-01-01").select("sha256").distinct()
    rows = gauges.daily_rows(gauges.daily_csv(stored.join(wanted, "sha256", "left_semi")))
    return rows.groupBy("site").agg(F.countDistinct("day").alias("n_days"))


@query(
    "A23_paged_result",
    """SELECT 'USGS-' || user_id AS site, variable, CAST(h AS VARCHAR) AS valid_time, arg_max(value, event_id) AS value, max(event_id // 200) AS page FROM (SELECT *, CASE event_type WHEN 'view' THEN 'flow' ELSE 'stage' END AS variable, date_trunc('second', ts) AS h FROM events WHERE event_type IN ('view', 'click') AND event_id // 200 NOT IN (SELECT event_id // 200 FROM events WHERE (event_id // 200) % 9 = 0 AND event_id % 200 = 7)) GROUP BY ALL""",
)
def a23(t):
    """All pages of a result in one scan; a reading repeated on a later page replaces the earlier one."""
    r = gauges.continuous_rows(gauges.continuous(reading_pages(t))).filter("variable IS NOT NULL")
    page = F.substring_index("path", "/", -1).cast("long")
    return r.groupBy("site", "variable", "valid_time").agg(F.max_by("value", page).alias("value"), F.max(page).alias("page"))


@query(
    "A25_prototype_sentinels",
    """SELECT l_suppkey AS site, count(*) AS n, count_if(l_linenumber NOT IN (1, 2)) AS n_valued, max(CASE WHEN l_linenumber NOT IN (1, 2) THEN l_quantity END) AS top FROM lineitem GROUP BY ALL""",
)
def a25(t):
    from fluvion.functions.values import number

    raw = F.when(F.col("l_linenumber") == 1, "-999999.0").when(F.col("l_linenumber") == 2, "-9999").otherwise(F.col("l_quantity").cast("string"))
    v = number(raw)
    ok = F.when((v > -9000.0) & (v > -999998.0), v)
    return t.read("lineitem").select(F.col("l_suppkey").alias("site"), ok.alias("v")).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valued"), F.max("v").alias("top"))


def prototype_docs(t):
    """One document per site and 200 events, with sentinels, text, points without a time and broken documents."""
    n, page = F.col("event_id") % 10, F.floor(F.col("event_id") / PAGE)
    raw = F.when(n == 0, "-999999").when(n == 1, "-999998.0").when(n == 2, "Ice").otherwise(F.col("value").cast("string"))
    code = F.when(F.col("event_type") == "view", "00060").when(F.col("event_type") == "click", "00065").otherwise("00010")
    v = F.struct(raw.alias("value"), F.when(n != 3, zulu("ts")).alias("dateTime"))
    rows = t.events().select((F.col("user_id") % 10).alias("site"), page.alias("page"), code.alias("code"), F.struct("event_id", v.alias("v")).alias("r"))
    points = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["v"])
    by_code = rows.groupBy("site", "page", "code").agg(points.alias("vs"))
    one = F.struct(
        F.struct(F.array(F.struct(F.col("code").alias("value"))).alias("variableCode"), F.struct(F.lit("ft3/s").alias("unitCode")).alias("unit")).alias("variable"),
        F.array(F.struct(F.col("vs").alias("value"))).alias("values"),
    )
    g = by_code.groupBy("site", "page").agg(F.to_json(F.struct(F.struct(F.collect_list(one).alias("timeSeries")).alias("value"))).alias("content"))
    broken = F.col("page") % 7 == 3
    return g.select(F.concat_ws("/", F.lit("landed"), "site", "page").alias("path"), "site", F.when(broken, F.substring("content", 1, 20)).otherwise(F.col("content")).alias("content"))


@query(
    "A25_prototype_readings",
    """WITH e AS (SELECT event_id, user_id % 10 AS site, event_id // 200 AS page, CASE event_type WHEN 'view' THEN 'flow' WHEN 'click' THEN 'stage' END AS variable, CASE WHEN event_id % 10 > 3 THEN value END AS v, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t FROM events)
      SELECT 'landed/' || d.site || '/' || d.page AS path, x.variable, CASE WHEN x.variable = 'flow' THEN 'cfs' WHEN d.page % 7 <> 3 AND count(event_id) > 0 THEN 'ft3/s' ELSE 'ft' END AS unit, CAST(CASE WHEN d.page % 7 = 3 THEN 0 ELSE count(v) END AS INTEGER) AS n, CASE WHEN d.page % 7 <> 3 THEN max(CASE WHEN v IS NOT NULL THEN t END) END AS latest_at,
        CASE WHEN d.page % 7 <> 3 THEN first(v ORDER BY t DESC, event_id) FILTER (v IS NOT NULL) END AS latest, CASE WHEN d.page % 7 = 3 THEN 'malformed' WHEN count(event_id) = 0 THEN 'no_data' WHEN count(v) = 0 THEN 'empty_series' ELSE 'ok' END AS note
      FROM (SELECT DISTINCT site, page FROM e) d CROSS JOIN (VALUES ('stage'), ('flow')) AS x(variable) LEFT JOIN e ON e.site = d.site AND e.page = d.page AND e.variable = x.variable GROUP BY d.site, d.page, x.variable""",
)
def a25b(t):
    """The prototype's reading documents, one row per document and parameter."""
    s = prototype.series(prototype_docs(t))
    return s.select("path", "variable", "unit", F.size("points").alias("n"), "latest_at", "latest", "note")


def prototype_gauges(t):
    k, v = F.col("c_custkey"), F.round(F.abs("c_acctbal") / 100, 2)

    def category(m):
        text = (v + m).cast("string")
        plain = ~((k % 4 == 0) | (k % 10 == m) | (k % 6 == m))
        stage = F.when(k % 4 == 0, "-9999").when(k % 10 == m, "n/a").when(plain, text)
        return F.struct(stage.alias("stage"), F.when((k % 4 != 0) & (k % 10 == m), text).alias("value"), F.when((k % 4 != 0) & (k % 10 != m) & (k % 6 == m), text).alias("ft"))

    cats = F.create_map(*[x for m, c in enumerate(("action", "minor", "moderate", "major"), 1) for x in (F.lit(c), category(m))])
    body = F.struct(F.struct(F.when(k % 12 != 5, cats).alias("categories")).alias("flood"))
    return t.read("customer").select(F.concat(F.lit("gauges/"), k).alias("path"), F.to_json(body).alias("content"))


@query(
    "A25_prototype_levels",
    """SELECT 'gauges/' || c_custkey AS path, CASE WHEN ok THEN round(v + 1, 6) END AS action, CASE WHEN ok THEN round(v + 2, 6) END AS minor, CASE WHEN ok THEN round(v + 3, 6) END AS moderate, CASE WHEN ok THEN round(v + 4, 6) END AS major, CASE WHEN ok THEN 'ok' ELSE 'missing_categories' END AS refusal
      FROM (SELECT c_custkey, round(abs(c_acctbal) / 100, 2) AS v, c_custkey % 4 <> 0 AND c_custkey % 12 <> 5 AS ok FROM customer)""",
)
def a25c(t):
    """The prototype's gauge documents: the first field of a category that is a number decides."""
    return prototype.levels(prototype_gauges(t)).withColumn("refusal", F.coalesce("refusal", F.lit("ok")))


@query(
    "A25_prototype_snow",
    """SELECT CAST(l_suppkey AS VARCHAR) || '/' || year(l_shipdate) AS path, CAST(l_suppkey AS VARCHAR) AS station, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, max(l_quantity) AS value FROM lineitem WHERE l_suppkey % 9 <> 4 GROUP BY l_suppkey, year(l_shipdate), CAST(l_shipdate AS DATE) HAVING max(l_quantity) <> 9""",
)
def a25d(t):
    """The prototype's snow documents: the first snow-water element of an entry, of the stations that were asked for."""
    g = t.lineitem().groupBy("l_suppkey", "day").agg(F.max("l_quantity").alias("hi"))
    v = F.struct(F.col("day").cast("string").alias("date"), F.when(F.col("hi") == 9, "M").otherwise(F.col("hi").cast("string")).alias("value"))
    y = g.select("l_suppkey", F.year("day").alias("y"), v.alias("v")).groupBy("l_suppkey", "y").agg(F.collect_list("v").alias("vs"))
    none = F.slice("vs", 1, 0)
    el = lambda code, vs: F.struct(F.struct(F.lit(code).alias("elementCode")).alias("stationElement"), vs.alias("values"))
    station = F.col("l_suppkey").cast("string")
    entries = F.array(F.struct(station.alias("stationTriplet"), F.array(el("SMS", F.col("vs")), el("WTEQ", F.col("vs")), el("WTEQ", none)).alias("data")), F.struct(station.alias("stationTriplet"), F.array(el("SMS", none)).alias("data")))
    asked = F.array(F.when(F.col("l_suppkey") % 9 != 4, station).otherwise(F.lit("elsewhere")))
    return prototype.snow(y.select(F.concat_ws("/", "l_suppkey", "y").alias("path"), asked.alias("stations"), F.to_json(entries).alias("content")))


@query(
    "I18_number_tokens",
    r"""SELECT doc_id, CAST(len(x) AS INTEGER) AS n_tokens, list_max(list_transform(x, lambda s: TRY_CAST(replace(s, ',', '') AS DOUBLE))) AS largest FROM (SELECT doc_id, regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?') AS x FROM documents)""",
)
def i18(t):
    tokens = F.regexp_extract_all("text", F.lit(notices.NUMBER_TOKEN), F.lit(0))
    d = t.read("documents").select("doc_id", tokens.alias("x"))
    return d.select("doc_id", F.size("x").alias("n_tokens"), F.array_max(F.transform("x", notices.number_token)).alias("largest"))


@query(
    "I19_compact_time",
    """SELECT event_id AS id, CAST(CASE WHEN event_id % 9 <> 0 AND event_id % 9 <> 1 THEN date_trunc('minute', ts) END AS VARCHAR) AS instant FROM events""",
)
def i19(t):
    from fluvion.functions.clocks import vtec_time

    tok = F.when(F.col("event_id") % 9 == 0, "000000T0000Z").when(F.col("event_id") % 9 == 1, "24AB01T0000Z").otherwise(F.date_format("ts", "yyMMdd'T'HHmm'Z'"))
    return t.events().select(F.col("event_id").alias("id"), vtec_time(tok).alias("instant"))



"""Sorts, limits, top-k and set operations."""

from pyspark.sql import functions as F

from fluvion.catalog.expressions import T, now
from fluvion.catalog.joins import KEY, LEFT_SQL, RIGHT_SQL, transports
from fluvion.catalog.registry import query
from fluvion.functions import clocks
from fluvion.operators import health, joins, selection
from fluvion.plans import quality


@query(
    "G1_latest_field",
    f"""SELECT user_id % 10 AS product, event_id AS id, CAST(ts AS VARCHAR) AS valid_time FROM events WHERE ts BETWEEN TIMESTAMP '{T}' - INTERVAL 6 HOUR AND TIMESTAMP '{T}' QUALIFY row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) = 1""",
)
def g1(t):
    inside = F.col("ts").between(clocks.plus_hours(now(), -6), now())
    rows = t.events().filter(inside).withColumn("product", F.col("user_id") % 10)
    return selection.newest(rows, ["product"], [F.desc("ts"), F.desc("event_id")]).select("product", F.col("event_id").alias("id"), F.col("ts").alias("valid_time"))


@query(
    "G2_runs_in_window",
    """SELECT r.run_id, CAST(any_value(r.issued_at) AS VARCHAR) AS issued_at, any_value(r.product) AS product, string_agg(v.lead || ':' || CAST(v.flow AS VARCHAR), '|' ORDER BY v.lead, v.flow) AS points FROM b_run r JOIN (SELECT run_id, lead, max(flow) AS flow FROM b_val GROUP BY ALL) v USING (run_id)
      WHERE r.issued_at >= TIMESTAMP '1998-01-01' AND r.issued_at < TIMESTAMP '1998-02-15' GROUP BY r.run_id""",
)
def g2(t):
    window = (F.col("issued_at") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("issued_at") < F.lit("1998-02-15").cast("timestamp"))
    pts = F.transform(F.sort_array(F.collect_list(F.struct("lead", "flow"))), lambda p: F.concat_ws(":", p["lead"], p["flow"]))
    per_lead = t.run_values().filter(window).groupBy("run_id", "issued_at", "product", "lead").agg(F.max("flow").alias("flow"))
    out = per_lead.groupBy("run_id", "issued_at", "product").agg(pts.alias("points"))
    return out.select("run_id", "issued_at", "product", "points").orderBy("issued_at", "run_id")


@query(
    "G3_values_of_runs",
    """SELECT run_id, CAST(valid_time AS VARCHAR) AS valid_time, flow, stage FROM b_val WHERE run_id IN (SELECT arg_max(run_id, (issued_at, run_id)) FROM b_run GROUP BY fp) ORDER BY run_id, valid_time""",
)
def g3(t):
    latest = t.forecast_runs().groupBy("fp").agg(F.max_by("run_id", F.struct("issued_at", "run_id")).alias("run_id")).select("run_id")
    return t.run_values().join(latest, "run_id", "left_semi").select("run_id", "valid_time", "flow", "stage").orderBy("run_id", "valid_time")


@query(
    "G4_top_values_per_key",
    """SELECT site, key, CAST(rn AS INTEGER) AS rn, round(value, 6) AS value, CAST(year(day) AS INTEGER) AS year FROM (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY value DESC, day DESC) AS rn FROM b_win) WHERE rn <= 20""",
)
def g4(t):
    from pyspark.sql import Window as W

    w = joins.doy_windows(t.daily_key(t.daily_means()))
    rn = F.row_number().over(W.partitionBy("site", "key").orderBy(F.desc("value"), F.desc("day")))
    return w.withColumn("rn", rn).filter("rn <= 20").select("site", F.col("key").cast("long").alias("key"), "rn", "value", F.year("day").alias("year"))


@query(
    "G5_candidate_cycles",
    """WITH h AS (SELECT o_custkey AS fp, max(o_orderdate) + INTERVAL 17 HOUR AS horizon FROM orders GROUP BY ALL), c AS (SELECT fp, horizon, unnest(generate_series(date_trunc('day', horizon) - INTERVAL 2 DAY, date_trunc('day', horizon) + INTERVAL 1 DAY, INTERVAL 6 HOUR)) AS cycle FROM h)
      SELECT fp, CAST(cycle AS VARCHAR) AS cycle, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY cycle DESC) AS rn FROM c WHERE cycle <= horizon) WHERE rn <= 4""",
)
def g5(t):
    from pyspark.sql import Window as W

    h = t.forecast_runs().groupBy("fp").agg(clocks.plus_hours(F.max("issued_at"), 17).alias("horizon"))
    day = F.date_trunc("day", "horizon")
    c = h.withColumn("cycle", F.explode(F.sequence(clocks.plus_hours(day, -48), clocks.plus_hours(day, 24), F.expr("interval 6 hours"))))
    rn = F.row_number().over(W.partitionBy("fp").orderBy(F.desc("cycle")))
    return c.filter("cycle <= horizon").withColumn("rn", rn).filter("rn <= 4").select("fp", "cycle", "rn")


@query(
    "G6_station_series",
    f"""WITH b AS (SELECT * FROM b_obs WHERE available_at <= TIMESTAMP '{T}' QUALIFY row_number() OVER (PARTITION BY station, variable, valid_time ORDER BY revision_seq DESC, id DESC) = 1)
      SELECT station, variable, CAST(valid_time AS VARCHAR) AS valid_time, value, last_value(id) OVER (PARTITION BY station, variable ORDER BY valid_time ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM b ORDER BY station, variable, valid_time""",
)
def g6(t):
    known = selection.as_known_at(t.observations(True), T)
    best = selection.newest(known, KEY, [F.desc("revision_seq"), F.desc("id")])
    last = known.groupBy(F.col("station").alias("_s"), F.col("variable").alias("_v")).agg(F.max(F.struct("valid_time", "revision_seq", "id"))["id"].alias("last_id"))
    both = best.join(last, F.col("station").eqNullSafe(F.col("_s")) & F.col("variable").eqNullSafe(F.col("_v")))
    return both.select(*KEY, "value", "last_id").orderBy(*KEY)


@query(
    "G7_time_grid",
    """SELECT station, CAST(d + to_hours(h) AS VARCHAR) AS as_of, CASE WHEN d BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' THEN 'event' ELSE 'control' END AS role FROM (
      SELECT user_id % 10 AS station, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS d FROM events GROUP BY ALL), (VALUES (0), (6), (12), (18)) AS x(h)""".replace(
        "user_id % 10 AS station, unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS d FROM events GROUP BY ALL",
        "station, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (SELECT user_id % 10 AS station, date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) AS hi FROM events GROUP BY user_id % 10)",
    ),
)
def g7(t):
    from fluvion.plans import replay

    span = t.events().groupBy((F.col("user_id") % 10).alias("station")).agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    return replay.time_grid(span, (0, 6, 12, 18), "2024-01-10", "2024-01-20").select("station", "as_of", "role")


@query(
    "G8_ranked_daily_series",
    """WITH s AS (SELECT site, day, value, row_number() OVER (PARTITION BY site ORDER BY day DESC) AS rn FROM b_day) SELECT site, string_agg(CAST(day AS VARCHAR), '|' ORDER BY day) AS days, count(*) AS n, round(max(value), 6) AS top FROM s WHERE day >= DATE '2001-10-01' GROUP BY ALL""",
)
def g8(t):
    rows = t.daily_means().filter(F.col("day") >= F.lit("2001-10-01").cast("date"))
    s = F.sort_array(F.collect_list(F.struct("day", "value")))
    return rows.groupBy("site").agg(
        F.transform(s, lambda r: r["day"].cast("string")).alias("days"), F.count(F.lit(1)).alias("n"), F.max("value").alias("top")
    )


@query(
    "H1_key_sets",
    f"""WITH l AS (SELECT station, variable, valid_time FROM {LEFT_SQL}), r AS (SELECT station, variable, valid_time FROM {RIGHT_SQL})
      SELECT side, station, count(*) AS n FROM (SELECT 'only_left' AS side, * FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT 'only_right', * FROM (SELECT * FROM r EXCEPT SELECT * FROM l) UNION ALL SELECT 'both', * FROM (SELECT * FROM l INTERSECT SELECT * FROM r)) GROUP BY ALL""",
)
def h1(t):
    """The difference both ways and the intersection of two key sets, from one pass over either side."""
    left, right = transports(t)
    sides = left.select(*KEY, F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(right.select(*KEY, F.lit(False).alias("l"), F.lit(True).alias("r")))
    per = sides.groupBy(*KEY).agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
    side = F.when(~F.col("r"), "only_left").when(~F.col("l"), "only_right").otherwise("both")
    return per.groupBy(side.alias("side"), "station").agg(F.count(F.lit(1)).alias("n"))


@query(
    "H2_expected_minus_stored",
    """WITH c AS (SELECT DISTINCT o_orderkey AS run_id FROM orders), e AS (SELECT run_id, l AS lead FROM c, range(1, 8) AS r(l)) SELECT run_id, lead FROM e ANTI JOIN (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS lead FROM lineitem) s USING (run_id, lead)""",
)
def h2(t):
    expected = t.forecast_runs().select("run_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("lead"))
    stored = t.forecast_values().select("run_id", "lead").distinct()
    return expected.join(stored, ["run_id", "lead"], "left_anti").select("run_id", F.col("lead").cast("long").alias("lead"))


@query(
    "H3_union_of_tables",
    """SELECT kind, count(*) AS n, count(basin) AS with_basin, max(name) AS last_name FROM (SELECT 'basin' AS kind, n_name AS name, NULL AS basin FROM nation UNION ALL SELECT 'point', c_name, c_nationkey FROM customer UNION ALL SELECT 'station', s_name, s_nationkey FROM supplier) GROUP BY ALL""",
)
def h3(t):
    u = (
        t.basins().select(F.lit("basin").alias("kind"), F.col("basin_name").alias("name"))
        .unionByName(t.points().select(F.lit("point").alias("kind"), F.col("fp_name").alias("name"), "basin"), allowMissingColumns=True)
        .unionByName(t.stations().select(F.lit("station").alias("kind"), F.col("station_name").alias("name"), "basin"), allowMissingColumns=True)
    )
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("basin").alias("with_basin"), F.max("name").alias("last_name"))


@query(
    "H4_config_drift",
    """SELECT c_custkey AS product, CASE WHEN c_custkey % 10 = 0 THEN 'not_stored' ELSE nullif(concat_ws(', ', CASE WHEN c_custkey % 3 = 0 THEN 'cadence_s: ' || (c_custkey + 1) || ' != ' || c_custkey END, CASE WHEN c_custkey % 4 = 0 THEN 'grace_s: 60 != 30' END), '') END AS drift FROM customer""",
)
def h4(t):
    k = F.col("c_custkey")
    base = t.read("customer").select(k.alias("product"), k.alias("cadence_s"), F.lit(30).alias("grace_s"))
    stored = base.filter(F.col("product") % 10 != 0).select(
        "product", F.when(F.col("product") % 3 == 0, F.col("cadence_s") + 1).otherwise(F.col("cadence_s")).alias("cadence_s"),
        F.when(F.col("product") % 4 == 0, 60).otherwise(30).alias("grace_s"),
    )
    return health.config_drift(base, stored, "product", ["cadence_s", "grace_s"])


@query(
    "H5_two_way_containment",
    """SELECT 'value_without_run' AS defect, count(*) AS n, min(l_orderkey) AS first_key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)
      UNION ALL SELECT 'run_without_values', count(*), min(o_orderkey) FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def h5(t):
    runs = t.forecast_runs().filter("run_id % 50 <> 0").select("run_id")
    return quality.dangling(t.forecast_values().select("run_id"), runs, "run_id", "value_without_run", "run_without_values")


@query(
    "H6_reasons_required",
    """SELECT state, CASE WHEN state <> 'unknown' THEN 'not_needed' WHEN r IS NULL THEN 'defect:unexplained:hazard' ELSE r END AS reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'known' END AS state, CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE 'no_value' END AS r FROM orders) GROUP BY ALL""",
)
def h6(t):
    r = F.col("run_id")
    df = t.forecast_runs().select(F.when(r % 5 == 0, "unknown").otherwise("known").alias("state"), F.when(r % 15 != 0, "no_value").alias("reason"))
    out = df.select("state", quality.explained(F.col("state"), F.col("reason"), "hazard").alias("reason"))
    return out.groupBy("state", "reason").agg(F.count(F.lit(1)).alias("n"))

"""Write operators: what would be appended, checked as rows."""

import uuid

from pyspark.sql import functions as F

from fluvion.catalog.aggregates import daily
from fluvion.catalog.expressions import T, now
from fluvion.catalog.registry import query
from fluvion.operators import doy, hydrograph, revisions, sinks
from fluvion.session import shared_dir

REV = ["station", "variable", "day"]
ARR_SQL = """(SELECT user_id % 10 AS station, event_type AS variable, CAST(ts AS DATE) AS day, event_id AS id, CAST(floor(value / 40) AS INTEGER) AS state, event_id % 2 = 0 AS stored FROM events)"""
SEQ_SQL = f"""(SELECT *, CASE WHEN lag(state) OVER w IS NULL OR lag(state) OVER w <> state THEN 1 ELSE 0 END AS ch FROM {ARR_SQL} WHERE stored WINDOW w AS (PARTITION BY station, variable, day ORDER BY id))"""


def arrivals(t):
    return t.events().select(
        (F.col("user_id") % 10).alias("station"), F.col("event_type").alias("variable"), F.to_date("ts").alias("day"),
        F.col("event_id").alias("id"), F.floor(F.col("value") / 40).cast("int").alias("state"), (F.col("event_id") % 2 == 0).alias("stored"),
    )


def stored_revisions(t):
    """The store as left by loading the even arrivals through the same operator."""
    a = arrivals(t)
    first = a.filter("stored").withColumn("arrived", F.col("id"))
    none = a.filter("false").withColumn("revision_seq", F.lit(0)).select(*REV, "id", "state", "revision_seq")
    return revisions.new_revisions(none, first, REV, ["state"], "arrived")


# the latest stored revision keeps the id of the arrival that changed it
LAST_SQL = f"""(SELECT station, variable, day, max(CASE WHEN ch = 1 THEN id END) AS id, arg_max(state, id) AS state, CAST(sum(ch) - 1 AS INTEGER) AS seq FROM {SEQ_SQL} GROUP BY station, variable, day)"""


@query(
    "B1_revision_append",
    f"""WITH b AS (SELECT * FROM {ARR_SQL} WHERE NOT stored QUALIFY row_number() OVER (PARTITION BY station, variable, day ORDER BY id DESC) = 1)
      SELECT b.station, b.variable, CAST(b.day AS VARCHAR) AS day, b.id, b.state, coalesce(l.seq + 1, 0) AS revision_seq, l.id AS revises FROM b LEFT JOIN {LAST_SQL} l USING (station, variable, day) WHERE l.id IS NULL OR l.state <> b.state""",
)
def b1(t):
    a = arrivals(t).filter("NOT stored").withColumn("arrived", F.col("id"))
    one = a.withColumn("_rn", sinks.newest_rank(REV, F.desc("id"))).filter("_rn = 1").drop("_rn")
    return revisions.new_revisions(stored_revisions(t), one, REV, ["state"], "arrived").select(*REV, "id", "state", "revision_seq", "revises")


BATCH_SQL = f"""(SELECT station, variable, day, id, state, 0 AS k, seq FROM {LAST_SQL} UNION ALL SELECT station, variable, day, id, state, 1, NULL FROM {ARR_SQL} WHERE NOT stored)"""


@query(
    "B2_batch_revisions",
    f"""WITH s AS (SELECT *, lag(state) OVER w AS ps FROM {BATCH_SQL} WINDOW w AS (PARTITION BY station, variable, day ORDER BY k, id)), c AS (SELECT *, CASE WHEN k = 1 AND (ps IS NULL OR ps <> state) THEN 1 ELSE 0 END AS ch FROM s),
      n AS (SELECT *, last_value(CASE WHEN k = 0 OR ch = 1 THEN id END IGNORE NULLS) OVER (PARTITION BY station, variable, day ORDER BY k, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pid, coalesce(max(seq) OVER (PARTITION BY station, variable, day), -1) + sum(ch) OVER (PARTITION BY station, variable, day ORDER BY k, id ROWS UNBOUNDED PRECEDING) AS rs FROM c)
      SELECT station, variable, CAST(day AS VARCHAR) AS day, id, state, CAST(rs AS INTEGER) AS revision_seq, pid AS revises FROM n WHERE ch = 1""",
)
def b2(t):
    batch = arrivals(t).filter("NOT stored").withColumn("arrived", F.col("id"))
    return revisions.new_revisions(stored_revisions(t), batch, REV, ["state"], "arrived")


@query(
    "B3_append_if_absent",
    """WITH s AS (SELECT DISTINCT feature, scope, win, valid_time FROM b_feat WHERE id % 3 = 0), b AS (SELECT * FROM b_feat)
      SELECT feature, scope, win, CAST(valid_time AS VARCHAR) AS valid_time, id FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.feature = b.feature AND s.scope = b.scope AND s.win IS NOT DISTINCT FROM b.win AND s.valid_time = b.valid_time)""",
)
def b3(t):
    f = t.derived_features().withColumnRenamed("window", "win")
    out = revisions.absent(f, f.filter("id % 3 = 0"), ["feature", "scope", "win", "valid_time"], [F.asc("id")])
    return out.select("feature", "scope", "win", "valid_time", "id")


@query(
    "B4_completion_sets",
    """WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id % 40 AS scope FROM events) SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT scope) AS n_have, 40::BIGINT AS n_expected, count(DISTINCT scope) >= 40 AS complete FROM s GROUP BY ALL""",
)
def b4(t):
    e = t.events().select(F.to_date("ts").alias("day"), (F.col("user_id") % 40).alias("scope"))
    return revisions.complete_instants(e, e, "day", "scope")


@query(
    "B5_high_water",
    """WITH m AS (SELECT user_id AS station, event_type AS variable, max(ts) AS mark FROM events WHERE event_id % 3 = 0 GROUP BY ALL) SELECT event_id AS id, user_id AS station, event_type AS variable FROM events LEFT JOIN m ON m.station = user_id AND m.variable = event_type WHERE mark IS NULL OR ts > mark""",
)
def b5(t):
    e = t.events().select(F.col("event_id").alias("id"), F.col("user_id").alias("station"), F.col("event_type").alias("variable"), "ts")
    return revisions.above_high_water(e, e.filter("id % 3 = 0"), ["station", "variable"], "ts").select("id", "station", "variable")


@query(
    "B6_changed_dimension",
    """WITH s AS (SELECT o_custkey AS fp, o_orderkey % 4 AS category, arg_max(floor(o_totalprice / 200000), (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY ALL),
      b AS (SELECT o_custkey AS fp, o_orderkey % 4 AS category, floor(o_totalprice / 200000) AS v, o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderdate, o_orderkey) = 1)
      SELECT b.fp, b.category, b.v AS value, b.id, CASE WHEN s.v IS NULL THEN 'new' ELSE 'changed' END AS change FROM b LEFT JOIN s USING (fp, category) WHERE s.v IS DISTINCT FROM b.v""",
)
def b6(t):
    o = t.read("orders").select(
        F.col("o_custkey").alias("fp"), (F.col("o_orderkey") % 4).alias("category"), F.floor(F.col("o_totalprice") / 200000).cast("double").alias("value"),
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("effective_from"),
    )
    cut = F.lit("1999-01-01").cast("timestamp")
    rank = sinks.newest_rank(["fp", "category"], F.asc("effective_from"), F.asc("id"))
    batch = o.filter(F.col("effective_from") >= cut).withColumn("_rn", rank).filter("_rn = 1").drop("_rn")
    out = revisions.changed_dimension_rows(o.filter(F.col("effective_from") < cut), batch, ["fp", "category"], ["value"])
    return out.select("fp", "category", "value", "id", "change")


@query(
    "B7_supersession_links",
    """SELECT run_id, fp, product, lag(run_id) OVER (PARTITION BY fp, product ORDER BY issued_at, run_id) AS supersedes FROM b_run""",
)
def b7(t):
    return revisions.link_supersession(t.forecast_runs(), ["fp", "product"]).select("run_id", "fp", "product", "supersedes")


@query(
    "B8_archive_rows",
    """WITH d AS (SELECT doc_id AS id, sha256(text) AS sha, CAST(octet_length(encode(text)) AS INTEGER) AS n FROM documents), f AS (SELECT sha, min(id) AS id, any_value(n) AS n FROM d GROUP BY sha)
      SELECT sha AS sha256, 'raw/' || substr(sha, 1, 2) || '/' || substr(sha, 3, 2) || '/' || sha || '.txt' AS object_key, n AS size_bytes, id, 'permanent' AS retention_class FROM f WHERE sha NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0)""",
)
def b8(t):
    d = t.read("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("fetched_at"), "text")
    known = d.filter("id % 5 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).distinct()
    return sinks.archive_rows(d, known, "text", ".txt", "raw/", "permanent")


@query(
    "B9_retention",
    f"""SELECT event_type AS product, count(*) AS n, CAST(min(ts) AS VARCHAR) AS oldest FROM events WHERE event_type <> 'view' OR epoch(date_trunc('second', ts)) >= epoch(TIMESTAMP '{T}') - 72 * 3600 GROUP BY ALL""",
)
def b9(t):
    rows = t.events().select(F.col("event_type").alias("product"), F.col("ts").alias("valid_time"))
    return sinks.retained(rows, "view", now()).groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.min("valid_time").alias("oldest"))


@query(
    "B10_month_partitions",
    """SELECT CAST(CAST(date_trunc('month', issued_at) AS DATE) AS VARCHAR) AS month, count(*) AS n, min(run_id) AS first_run FROM b_run WHERE issued_at >= TIMESTAMP '1997-03-01' AND issued_at < TIMESTAMP '1999-01-01' GROUP BY ALL""",
)
def b10(t):
    path = f"{shared_dir(t.spark)}/runs-{uuid.uuid4().hex}"
    sinks.write_by_month(t.forecast_runs(), path, "issued_at")
    return sinks.read_months(t.spark, path, "1997-03-01", "1998-12-31").groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))


def member_points(t):
    return t.run_values().groupBy("run_id", F.col("valid_time").alias("t")).agg(F.max("flow").alias("v"))


@query(
    "B12_encode_series",
    """WITH p AS (SELECT run_id, valid_time AS t, max(flow) AS v FROM b_val GROUP BY ALL), s AS (SELECT *, epoch(t) - epoch(lag(t) OVER (PARTITION BY run_id ORDER BY t)) AS st FROM p)
      SELECT run_id, CASE WHEN count(*) >= 2 AND count(DISTINCT st) = 1 THEN 'grid' ELSE 'points' END AS encoding, CASE WHEN count(*) >= 2 AND count(DISTINCT st) = 1 THEN min(st) / 3600.0::DOUBLE END AS step_h, CAST(count(*) AS INTEGER) AS n FROM s GROUP BY ALL""".replace("GROUP BY ALL\"", "GROUP BY run_id\""),
)
def b12(t):
    e = hydrograph.encode(member_points(t), ["run_id"])
    return e.select("run_id", "encoding", "step_h", F.size(F.when(F.col("encoding") == "grid", F.transform("flow", lambda v: F.lit(1))).otherwise(F.transform("points", lambda p: F.lit(1)))).alias("n"))


@query(
    "B12_decode_series",
    """SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY valid_time) - 1 AS INTEGER) AS pos, CAST(valid_time AS VARCHAR) AS t, v FROM (SELECT run_id, valid_time, max(flow) AS v FROM b_val GROUP BY ALL)""",
)
def b12b(t):
    return hydrograph.decode(hydrograph.encode(member_points(t), ["run_id"]), ["run_id"])


@query("B13_nested_ladder", "SELECT site, key, n, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM b_lad")
def b13(t):
    levels = list(doy.P.values())
    docs = sinks.ladder_document(doy.ladder(daily(t)), levels)
    text = docs.select("site", F.to_json("ladder").alias("doc"))
    schema = "map<string, struct<n: bigint, " + ", ".join(f"{x}: double" for x in levels) + ">>"
    back = text.select("site", F.from_json("doc", schema).alias("ladder"))
    return sinks.from_ladder_document(back, levels).select("site", "key", "n", "p50", "p95")


@query(
    "B14_snapshot_upsert",
    """SELECT user_id AS station, CAST(max(ts) AS VARCHAR) AS at, max(event_id) FILTER (WHERE ts = m) AS event_id, max(value) FILTER (WHERE ts = m) AS value FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY ALL""",
)
def b14(t):
    e = t.events().select(F.col("user_id").alias("station"), F.col("ts").alias("at"), "event_id", "value")
    return sinks.latest_snapshot(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "station", ["at", "event_id"])


@query(
    "B15_seed_checks",
    """WITH r AS (SELECT s_suppkey AS station, s_nationkey AS basin, CASE s_suppkey % 3 WHEN 0 THEN 'America/Los_Angeles' WHEN 1 THEN 'Mars/Base' END AS zone FROM supplier)
      SELECT basin, 'unknown_key' AS problem, count(*) AS n FROM r WHERE basin NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 <> 0) GROUP BY ALL UNION ALL SELECT basin, 'zone_not_allowed', count(*) FROM r WHERE zone = 'Mars/Base' GROUP BY ALL""",
)
def b15(t):
    zone = F.when(F.col("station") % 3 == 0, "America/Los_Angeles").when(F.col("station") % 3 == 1, "Mars/Base")
    rows = t.stations().select("station", "basin", zone.alias("zone"))
    problems = sinks.seed_problems(rows, t.basins().filter("basin % 4 <> 0"), "basin", "zone", ["America/Los_Angeles"])
    return problems.groupBy("basin", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "B16_load_report",
    """WITH r AS (SELECT user_id AS station, value, CASE WHEN event_id % 7 = 0 THEN 'duplicate' WHEN event_id % 5 = 0 THEN 'unknown_id' WHEN event_id % 11 = 0 THEN 'no_crest' END AS reason FROM events), c AS (SELECT station, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL)
      SELECT r.station, count_if(reason IS NULL) AS written, count_if(reason IS NOT NULL) AS rejected, max(CASE WHEN reason IS NULL THEN value END) AS peak, (SELECT c.reason FROM c WHERE c.station = r.station ORDER BY n DESC, reason LIMIT 1) AS main_reason FROM r GROUP BY r.station""",
)
def b16(t):
    i = F.col("event_id")
    reason = F.when(i % 7 == 0, "duplicate").when(i % 5 == 0, "unknown_id").when(i % 11 == 0, "no_crest")
    rows = t.events().select(F.col("user_id").alias("station"), "value", reason.alias("reason"))
    return sinks.load_report(rows, "station", "reason", "value")


@query(
    "B17_refusals_as_rows",
    """WITH g AS (SELECT field, basin, count(*) AS met, count_if(value < -400) AS bad, sum(value * weight) AS total FROM b_gap JOIN b_mask USING (flat_index) GROUP BY ALL)
      SELECT field, basin, round(CASE WHEN bad + n - met = 0 THEN total / w END, 6) AS value, CASE WHEN bad + n - met > 0 THEN 'missing_values' END AS reason FROM g JOIN b_masktotal USING (basin)""",
)
def b17(t):
    from fluvion.operators import zonal

    means = zonal.strict_mean(t.delivered_cells(), t.mask(), None, F.col("value") < -400)
    good = means.filter("reason = 'ok'").select("field", "basin", "value")
    bad = means.filter("reason <> 'ok'").select("field", "basin", "reason")
    return sinks.with_refusals(good, bad)

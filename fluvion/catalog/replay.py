"""Replay: evaluations over time, escalation rules, arms, base rates, clocks."""

import uuid

from pyspark.sql import functions as F

from fluvion.catalog.aggregates import ratio_sql
from fluvion.catalog.registry import BINDINGS, query
from fluvion.catalog.series import pct_case
from fluvion.functions.clocks import plus_hours
from fluvion.operators import doy
from fluvion.plans import replay, susceptibility
from fluvion.session import shared_dir, staged

CUTOFF = "2001-01-01"
GRID = ("2001-03-01 06:00:00", "2001-05-30 18:00:00", 12)
EVENT = ("2001-04-10", "2001-05-05")
SERIES_SHIFT_DAYS = 8306  # moves the event calendar into the replayed one

BINDINGS["b_cday"] = f"SELECT * FROM b_day WHERE day < DATE '{CUTOFF}'"
BINDINGS["b_cwin"] = BINDINGS["b_win"].replace("b_day", "b_cday")
BINDINGS["b_clad"] = BINDINGS["b_lad"].replace("b_win", "b_cwin")
BINDINGS["b_cctx"] = BINDINGS["b_ctx"].replace("b_win", "b_cwin")
BINDINGS["b_cgrow"] = BINDINGS["b_growth"].replace(ratio_sql(1), ratio_sql(1).replace("b_day", "b_cday"))
DIR = lambda g, h: f"CASE WHEN {g} IS NULL THEN 'unknown' WHEN {g} BETWEEN 1 / power(1.01::DOUBLE, {h}) AND power(1.01::DOUBLE, {h}) THEN 'steady' WHEN {g} > 1 THEN 'rising' ELSE 'falling' END"
BINDINGS["b_rk"] = f"""SELECT d.site, d.day, d.value, round({pct_case('d.value')} + 1e-9, 1) AS percentile, {DIR('d.value / a.value', 24)} AS d24, {DIR('d.value / b.value', 48)} AS d48, (d.day + 1)::TIMESTAMP AS valid_time, (d.day + 1)::TIMESTAMP + to_hours(CAST(d.site % 3 * 12 AS INTEGER)) AS available_at,
  CASE WHEN round(d.value / a.value, 4) >= f.floor THEN CAST((SELECT count(*) FROM b_cgrow x WHERE x.site = d.site AND x.growth > round(d.value / a.value, 4)) + 1 AS INTEGER) END AS growth_rank, CASE WHEN a.value IS NOT NULL THEN f.n END AS growth_rank_of
  FROM (SELECT *, datediff('day', DATE '2000-01-01', make_date(2000, month(day), day(day))) AS doy FROM b_day) d LEFT JOIN b_clad l ON l.site = d.site AND l.key = d.doy LEFT JOIN b_day a ON a.site = d.site AND a.day = d.day - 1 AND a.value > 0 AND d.value > 0 LEFT JOIN b_day b ON b.site = d.site AND b.day = d.day - 2 AND b.value > 0 AND d.value > 0
  LEFT JOIN (SELECT site, min(growth) AS floor, any_value(n) AS n FROM b_cgrow GROUP BY ALL) f ON f.site = d.site"""
BINDINGS["b_gpt"] = f"""SELECT station AS site, g AS as_of, (epoch(t) - epoch(TIMESTAMP '2024-01-01')) / 3600.0::DOUBLE AS x, v AS y, (epoch(t) - epoch(lag(t) OVER (PARTITION BY station, g ORDER BY t))) / 3600.0::DOUBLE AS gap
  FROM generate_series(TIMESTAMP '{GRID[0]}', TIMESTAMP '{GRID[1]}', INTERVAL {GRID[2]} HOUR) AS s(g) JOIN b_fast ON t - INTERVAL {SERIES_SHIFT_DAYS} DAY BETWEEN g - INTERVAL 6 HOUR AND g"""
BINDINGS["b_gok"] = """SELECT site, as_of, arg_max(y, x) AS last_v FROM b_gpt GROUP BY ALL HAVING count(*) >= 3 AND coalesce(max(gap), 0) <= 2 AND max(x) - min(x) >= 3"""
BINDINGS["b_gdir"] = """SELECT site, as_of, CASE WHEN abs(slope) <= greatest(1.0, abs(last_v) * 0.01::DOUBLE) THEN 'steady' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS trend FROM b_gok JOIN (
  SELECT site, as_of, median(m) AS slope FROM (SELECT p.site, p.as_of, p.x, median((q.y - p.y) / (q.x - p.x)) AS m FROM b_gpt p JOIN b_gpt q ON q.site = p.site AND q.as_of = p.as_of AND q.x <> p.x GROUP BY ALL) GROUP BY ALL) USING (site, as_of)"""
BINDINGS["b_ev"] = f"""SELECT g AS as_of, site, day, percentile, d24, d48, growth_rank, growth_rank_of, valid_time, CASE WHEN CAST(g AS DATE) BETWEEN DATE '{EVENT[0]}' AND DATE '{EVENT[1]}' THEN 'event' ELSE 'control' END AS role, CASE WHEN percentile IS NULL THEN 'unknown' WHEN percentile < 25 THEN 'low' WHEN percentile < 75 THEN 'moderate' WHEN percentile < 90 THEN 'high' ELSE 'very_high' END AS band
  FROM generate_series(TIMESTAMP '{GRID[0]}', TIMESTAMP '{GRID[1]}', INTERVAL {GRID[2]} HOUR) AS x(g) JOIN b_rk r ON r.available_at <= g AND r.valid_time >= g - INTERVAL 48 HOUR QUALIFY row_number() OVER (PARTITION BY g, site ORDER BY valid_time DESC) = 1"""
BINDINGS["b_rule"] = """SELECT site, as_of, arm, role, rule, CASE WHEN arm = 'old' AND rule IN ('rising_24h', 'rising_48h', 'growth_rank_top_0.01_24h') THEN NULL ELSE CASE rule WHEN 'band_very_high' THEN band = 'very_high' WHEN 'band_high' THEN band IN ('high', 'very_high') WHEN 'rising_24h' THEN d24 = 'rising' WHEN 'rising_48h' THEN d48 = 'rising'
  WHEN 'any_escalation' THEN band = 'very_high' OR (arm = 'new' AND d24 = 'rising') WHEN 'trend_rising_6h' THEN coalesce(trend = 'rising', false) ELSE coalesce(growth_rank <= greatest(1, ceil(0.01::DOUBLE * growth_rank_of)), false) END END AS holds
  FROM b_ev LEFT JOIN b_gdir USING (site, as_of), (VALUES ('old'), ('new')) AS a(arm), (VALUES ('band_very_high'), ('band_high'), ('rising_24h'), ('rising_48h'), ('any_escalation'), ('trend_rising_6h'), ('growth_rank_top_0.01_24h')) AS r(rule)"""
BINDINGS["b_esc"] = """SELECT site, rule, arm, min(CASE WHEN role = 'event' AND holds THEN as_of END) AS first_time, count_if(role = 'event') AS evaluations, count_if(role = 'control' AND coalesce(holds, false)) AS control_firings, bool_and(holds IS NOT NULL) AS applicable FROM b_rule GROUP BY ALL"""


def ranked_days(t, cutoff=CUTOFF):
    """Every day ranked in the reference as it stood at the cutoff, with its changes and their ranks."""
    daily = staged(t.daily_key(t.daily_means()), "daily")
    before = daily.filter(F.col("day") < F.lit(cutoff).cast("date"))
    ranked = susceptibility.ranked(daily, doy.ladder(before)).select("site", "day", "value", "percentile")
    changes = susceptibility.state_changes(daily.select("site", "day", "value"))
    grown = changes.filter("growth_24h IS NOT NULL").select("site", "day", F.col("growth_24h").alias("growth"))
    ranks = doy.growth_rank(grown, doy.growth_reference(before, 24)).select("site", "day", "growth_rank", "growth_rank_of")
    j = ranked.join(changes.drop("value"), ["site", "day"]).join(ranks, ["site", "day"], "left")
    valid = F.date_add("day", 1).cast("timestamp")
    return j.withColumn("valid_time", valid).withColumn("available_at", plus_hours(F.col("valid_time"), F.col("site") % 3 * 12))


def evaluated(t):
    ev = replay.evaluations(ranked_days(t), GRID, EVENT)
    series = t.fast_series().select(F.col("station").alias("site"), (F.col("t") - F.expr(f"interval {SERIES_SHIFT_DAYS} days")).alias("t"), "v")
    return replay.with_trends(ev, replay.grid_trends(series, GRID))


@query(
    "L7_replay_evaluations",
    """SELECT CAST(as_of AS VARCHAR) AS as_of, site, arm, CAST(day AS VARCHAR) AS day, percentile, band, role, CASE WHEN arm = 'new' THEN d24 END AS direction_24h, CASE WHEN arm = 'new' THEN growth_rank END AS growth_rank, coalesce(trend, 'unknown') AS trend_6h FROM b_ev LEFT JOIN b_gdir USING (site, as_of), (VALUES ('old'), ('new')) AS a(arm)""",
)
def l7(t):
    return evaluated(t).select("as_of", "site", "arm", "day", "percentile", "band", "role", "direction_24h", "growth_rank", F.col("trend_direction").alias("trend_6h"))


def evaluation_parts():
    return [F.col("as_of"), F.col("site"), F.col("arm"), F.col("day"), F.round(F.col("percentile") * 10).cast("long"), F.col("band"), F.col("role"), F.col("direction_24h"), F.col("growth_rank"), F.col("trend_direction")]


HASH_SQL = lambda parts: "sum(('0x' || substr(sha256(concat_ws('|', " + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '~')" for p in parts) + ")), 1, 15))::BIGINT)::HUGEINT"


@query(
    "L7_run_document",
    f"""WITH v AS (SELECT as_of, site, arm, day, CAST(round(percentile * 10) AS BIGINT) AS p, band, role, CASE WHEN arm = 'new' THEN d24 END AS d, CASE WHEN arm = 'new' THEN growth_rank END AS g, coalesce(trend, 'unknown') AS t FROM b_ev LEFT JOIN b_gdir USING (site, as_of), (VALUES ('old'), ('new')) AS a(arm)),
      e AS (SELECT count(*) AS n_evaluations, count_if(role = 'event') AS n_event, count_if(role = 'control') AS n_control, count(DISTINCT site) AS n_sites, CAST(min(as_of) AS VARCHAR) AS first_as_of, CAST(max(as_of) AS VARCHAR) AS last_as_of, sha256(count(*) || ':' || {HASH_SQL(["as_of", "site", "arm", "day", "p", "band", "role", "d", "g", "t"])}) AS content_sha256 FROM v),
      i AS (SELECT 'daily=' || sha256(count(*) || ':' || {HASH_SQL(["site", "day", "CAST(floor(value * 1000) AS BIGINT)"])}) AS inputs FROM b_day),
      x AS (SELECT 'RETROSPECTIVE' AS mode, '{"|".join(map(str, GRID))}' AS grid, '{"|".join(EVENT)}' AS event, 'old=susceptibility@0.1.0|new=susceptibility@0.2.0' AS arms, 'observation|derived_feature|reference|threshold|forecast_run' AS projected, inputs, e.* FROM e, i)
      SELECT sha256(concat_ws(chr(10), mode, grid, event, arms, inputs, content_sha256)) AS run_id, * FROM x""",
)
def l7_document(t):
    """The manifest of the replay run: what it read, over which clocks and arms, what it counted, and a hash of it all."""
    daily = [F.col("site"), F.col("day"), F.floor(F.col("value") * 1000)]
    return replay.run_document(evaluated(t), evaluation_parts(), replay.RETROSPECTIVE, GRID, EVENT, {"daily": (t.daily_means(), daily)})


@query("L8_escalation_rules", "SELECT rule, arm, role, count(*) AS n, count_if(coalesce(holds, false)) AS n_holds, count_if(holds IS NULL) AS n_unanswerable FROM b_rule GROUP BY ALL")
def l8(t):
    r = replay.apply_rules(evaluated(t))
    return r.groupBy("rule", "arm", "role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("holds", F.lit(False))).alias("n_holds"), F.count_if(F.col("holds").isNull()).alias("n_unanswerable"))


@query("F28_earliest_escalation", "SELECT site, rule, arm, CAST(first_time AS VARCHAR) AS first_time, evaluations, control_firings, applicable FROM b_esc")
def f28(t):
    return replay.earliest_escalation(replay.apply_rules(evaluated(t)))


@query(
    "D21_compare_arms",
    """WITH p AS (SELECT site, rule, max(CASE WHEN arm = 'old' THEN first_time END) AS ot, max(CASE WHEN arm = 'new' THEN first_time END) AS nt, bool_or(arm = 'old' AND applicable) AS ook, bool_or(arm = 'new' AND applicable) AS nok FROM b_esc GROUP BY ALL), d AS (SELECT *, round((epoch(ot) - epoch(nt)) / 3600.0::DOUBLE, 2) AS diff FROM p)
      SELECT site, rule, CAST(ot AS VARCHAR) AS old_time, CAST(nt AS VARCHAR) AS new_time, diff AS difference_h, CASE WHEN NOT ook AND NOT nok THEN 'not_applicable' WHEN NOT (ook AND nok) AND coalesce(nt, ot) IS NOT NULL THEN 'earlier_but_not_a_lead_time' WHEN NOT (ook AND nok) THEN 'no_difference' WHEN ot IS NULL AND nt IS NULL THEN 'no_difference' WHEN nt IS NULL THEN 'later'
        WHEN ot IS NULL THEN 'earlier_but_not_a_lead_time' WHEN diff > 0 AND rule NOT LIKE 'growth_rank_top%' THEN 'lead_time' WHEN diff > 0 THEN 'earlier_but_not_a_lead_time' WHEN diff < 0 THEN 'later' ELSE 'no_difference' END AS verdict FROM d""",
)
def d21(t):
    e = replay.earliest_escalation(replay.apply_rules(evaluated(t)))
    return replay.compare_arms(e)


RULES20 = {
    "rising_24h": "d24 = 'rising'", "rising_48h": "d48 = 'rising'", "band_high": "coalesce(percentile >= 75, false)", "band_very_high": "coalesce(percentile >= 90, false)",
    "any_escalation": "(d24 = 'rising' OR coalesce(percentile >= 90, false))", "rising_24h_below_p90": "(d24 = 'rising' AND NOT coalesce(percentile >= 90, false))",
}
WINTER = "month(valid_time) IN (11, 12, 1, 2)"


@query(
    "E20_base_rate",
    "SELECT site, count(*) AS days, count_if(" + WINTER + ") AS winter_days, " + ", ".join(f"count_if({c}) AS {k}, count_if({c} AND {WINTER}) AS {k}_winter, round(count_if({c}) / (count(*) / 365.25::DOUBLE) + 1e-9, 1) AS {k}_per_year" for k, c in RULES20.items())
    + " FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY day) AS i FROM b_rk) WHERE i > 3 GROUP BY ALL",
)
def e20(t):
    return replay.base_rate(ranked_days(t))


@query(
    "L9_reference_at_cutoff",
    f"""SELECT l.site, l.key, l.n, round(p50, 6) AS p50, round(p95, 6) AS p95, CAST(c.water_years AS INTEGER) AS water_years, round(c.maximum, 6) AS maximum, round(c.tail_floor, 6) AS tail_floor, CAST(c.tail_years AS INTEGER) AS tail_years, g.n AS growth_n, g.floor AS growth_floor, '{CUTOFF} 00:00:00' AS known_from
      FROM b_clad l JOIN b_cctx c ON c.site = l.site AND c.key = l.key LEFT JOIN (SELECT site, any_value(n) AS n, min(growth) AS floor FROM b_cgrow GROUP BY ALL) g ON g.site = l.site""",
)
def l9(t):
    """Ladder, record support and growth reference from the days before a cutoff, stamped with the clock at which they became known."""
    before = t.daily_key(t.daily_means()).filter(F.col("day") < F.lit(CUTOFF).cast("date"))
    growth = doy.growth_reference(before, 24).groupBy("site").agg(F.max("n").alias("growth_n"), F.min("growth").alias("growth_floor"))
    out = doy.reference(before).join(growth, "site", "left")
    return out.select("site", F.col("key").cast("long").alias("key"), "n", "p50", "p95", "water_years", "maximum", "tail_floor", "tail_years", "growth_n", "growth_floor", F.lit(CUTOFF).cast("timestamp").alias("known_from"))


@query(
    "L10_projected_clocks",
    """SELECT station, count(*) AS n, count_if(valid_time <= TIMESTAMP '2024-01-15') AS visible_retrospective, count_if(available_at <= TIMESTAMP '2024-01-15') AS visible_knowledge, count(*) AS restored FROM b_obs GROUP BY ALL""",
)
def l10(t):
    cut = F.lit("2024-01-15").cast("timestamp")
    obs = t.observations().withColumn("own", F.col("available_at"))
    p = replay.projected(obs, replay.RETROSPECTIVE, "valid_time").withColumn("seen", F.col("available_at"))
    return replay.restored(p).groupBy("station").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("seen") <= cut).alias("visible_retrospective"),
        F.count_if(F.col("own") <= cut).alias("visible_knowledge"), F.count_if(F.col("available_at") == F.col("own")).alias("restored"),
    )


@query(
    "L23_stored_evaluations",
    """SELECT arm, rule, count(*) AS n, count_if(coalesce(holds, false)) AS n_holds FROM b_rule WHERE rule IN ('band_high', 'any_escalation') AND role = 'event' GROUP BY ALL""",
)
def l23(t):
    """Evaluations are stored once, partitioned by arm, and rules are applied to the stored rows."""
    path = f"{shared_dir(t.spark)}/evaluations-{uuid.uuid4().hex}"
    replay.write_evaluations(evaluated(t), path)
    stored = t.spark.read.parquet(path).filter("role = 'event'")
    r = replay.apply_rules(stored, ("band_high", "any_escalation"))
    return r.groupBy("arm", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("holds", F.lit(False))).alias("n_holds"))


@query(
    "L26_replay_disclosure",
    """SELECT arm, count(*) AS n, 'RETROSPECTIVE' AS mode, 'observation|derived_feature|reference|threshold|forecast_run' AS projected,
      'observation:valid_time:publication_latency|derived_feature:valid_time:publication_lag_and_approved_values|reference:cutoff:rebuilt_from_later_fetch|threshold:declared_epoch:vintage_unverified|forecast_run:issued_at:none' AS optimism,
      'threshold' AS anachronistic FROM b_ev, (VALUES ('old'), ('new')) AS a(arm) GROUP BY arm""",
)
def l26(t):
    return replay.disclosure(evaluated(t), replay.RETROSPECTIVE).drop("disclosure")

"""Extension tables: estimators, rules, series decoding and versioned methods chosen by name."""

from pyspark.sql import functions as F

from fluvion.catalog.registry import query
from fluvion.catalog.replay import evaluated
from fluvion.catalog.series import windows
from fluvion.catalog.surfaces import BAND_SQL, s_daily, susceptibility_rows
from fluvion.catalog.writes import member_points
from fluvion.functions.arrays import ESTIMATORS, register_estimator
from fluvion.operators import hydrograph, trend
from fluvion.plans import replay


@query(
    "K1_estimator_registry",
    """SELECT o.station, CAST(o.t AS VARCHAR) AS t, round(endpoint, 6) AS endpoint, round(ols, 6) AS ols, round(s.q[2], 6) AS theil_sen, round(r.slope, 6) AS repeated_median, round((endpoint + ols) / 2, 6) AS blend FROM b_ok o LEFT JOIN b_ts s ON s.station = o.station AND s.t = o.t LEFT JOIN b_rm r ON r.station = o.station AND r.t = o.t""",
)
def k1(t):
    """A user estimator is a function from the window column to a slope column."""
    register_estimator("blend", lambda p: (ESTIMATORS["endpoint"](p) + ESTIMATORS["ols"](p)) / 2)
    names = ("endpoint", "ols", "theil_sen", "repeated_median", "blend")
    return trend.slopes(windows(t), names).select("station", "t", *[F.col(f"{n}_slope").alias(n) for n in names])


@query(
    "K2_rule_registry",
    """SELECT site, rule, count_if(coalesce(holds, false)) AS n_holds, count_if(holds IS NULL) AS n_null FROM b_rule WHERE rule IN ('rising_48h', 'growth_rank_top_0.01_24h') GROUP BY ALL""",
)
def k2(t):
    r = replay.apply_rules(evaluated(t), ("rising_48h", "growth_rank_top_0.01_24h"))
    return r.groupBy("site", "rule").agg(F.count_if(F.coalesce("holds", F.lit(False))).alias("n_holds"), F.count_if(F.col("holds").isNull()).alias("n_null"))


@query(
    "K3_series_table_function",
    """SELECT run_id, count(*) AS n, round(max(v), 6) AS top, CAST(min(t) AS VARCHAR) AS t0 FROM (SELECT run_id, valid_time AS t, max(flow) AS v FROM b_val GROUP BY ALL) GROUP BY ALL""",
)
def k3(t):
    rows = hydrograph.decode(hydrograph.encode(member_points(t), ["run_id"]), ["run_id"])
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"), F.min("t").alias("t0"))


@query(
    "K4_versioned_methods",
    f"""SELECT m AS method, band, count(*) AS n FROM (SELECT CASE WHEN reason = 'ok' THEN {BAND_SQL('p')} ELSE 'unknown' END AS band FROM b_susc), (VALUES ('susceptibility@0.1.0'), ('susceptibility@0.2.0')) AS v(m) GROUP BY ALL""",
)
def k4(t):
    days = s_daily(t)
    both = susceptibility_rows(t, "0.1.0", days).select("method", "band").unionByName(susceptibility_rows(t, "0.2.0", days).select("method", "band"))
    return both.groupBy("method", "band").agg(F.count(F.lit(1)).alias("n"))

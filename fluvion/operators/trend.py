"""Rates of rise over trailing windows of a gauge series.

The series is reduced to its cadence first (15 minutes here), so a window holds at most
window / cadence points. Windows are built inside (station, block of time) partitions with a halo
of one window, so a station with a third of all rows is still spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluvion.functions.arrays import ESTIMATORS, pair_stats
from fluvion.functions.clocks import plus_hours
from fluvion.operators import running

# Fixed values.
WINDOW_H = 6.0
MAX_GAP_H = 2.0
MIN_SPAN_FRACTION = 0.5
MIN_SAMPLES = 3
CADENCE_H = 0.25
STAGE_EPS_FT_H = 0.05
FLOW_EPS_FRACTION = 0.01
SUPPORT_FRACTION = 0.75
WIDE_SPREAD = 2.0
SUSTAIN_WINDOWS = 8
SHIPPED = "repeated_median"
BLOCK_H, BLOCK_DAYS = 24, 4


def steady_epsilon(basis: Column, last: Column) -> Column:
    return F.when(basis == "stage", F.lit(STAGE_EPS_FT_H)).otherwise(F.greatest(F.lit(1.0), F.abs(last) * FLOW_EPS_FRACTION))


def direction(slope: Column, eps: Column) -> Column:
    return F.when(slope.isNull(), "unknown").when(F.abs(slope) <= eps, "steady").when(slope > 0, "rising").otherwise("falling")


def trailing_windows(series: DataFrame, key: str = "station", window_h: float = WINDOW_H, block_h: int = BLOCK_H) -> DataFrame:
    """One row per reading with the readings of the closed window [t - w, t] as a sorted array.

    ``series``: key, t, v; one row per instant. Each reading goes to its own block and, when it can
    fall into a window of the next block, to that one too; only own-block readings anchor windows.
    """
    block_s, window_s = block_h * 3600, int(window_h * 3600)
    sec = F.unix_timestamp("t")
    block = F.floor(sec / block_s)
    last_needed = F.floor((sec + window_s) / block_s)
    halo = series.withColumn("_own", block).withColumn("_block", F.explode(F.sequence(block, last_needed)))
    w = W.partitionBy(key, "_block").orderBy(sec).rangeBetween(-window_s, 0)
    hours = (sec - F.col("_block") * block_s) / 3600.0
    pts = F.collect_list(F.struct(hours.alias("x"), F.col("v").alias("y"))).over(w)
    own = halo.withColumn("pts", F.sort_array(pts)).filter("_own = _block")
    return window_shape(own.select(key, "t", "v", "pts"))


def window_shape(windows: DataFrame) -> DataFrame:
    """Number, span, largest gap and last value of the sorted readings ``pts`` of each window."""
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    gaps = F.transform(F.slice("pts", 2, F.greatest(F.size("pts") - 1, F.lit(0))), lambda q, i: q["x"] - F.get("pts", i)["x"])
    return windows.select(
        "*", F.size("pts").alias("n"), (last["x"] - first["x"]).alias("span_h"),
        F.coalesce(F.array_max(gaps), F.lit(0.0)).alias("max_gap_h"), last["y"].alias("last_v"),
    )


def window_refusal(min_samples: int = MIN_SAMPLES, window_h: float = WINDOW_H) -> Column:
    return (
        F.when(F.col("n") < min_samples, "INSUFFICIENT_OBSERVATIONS")
        .when(F.col("max_gap_h") > MAX_GAP_H, "GAP_EXCEEDS_TOLERANCE")
        .when(F.col("span_h") < MIN_SPAN_FRACTION * window_h, "SPAN_BELOW_MINIMUM")
    )


def admissible(windows: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    return windows.filter(window_refusal(min_samples).isNull())


def tidal_refusal(tidal_class: Column) -> Column:
    return F.when(tidal_class == "FLUVIAL", F.lit(None)).when(tidal_class == "TIDAL", "TIDAL_CONTAMINATION").otherwise("TIDAL_CLASS_UNVERIFIED")


def endpoint_rate(windows: DataFrame, basis: Column) -> DataFrame:
    """First-generation endpoint rate: two readings suffice."""
    refusal = window_refusal(min_samples=2)
    rate = F.when(refusal.isNull(), ESTIMATORS["endpoint"](F.col("pts")))
    return windows.withColumn("rate", rate).withColumn("refusal", F.coalesce(refusal, F.lit("ok"))).withColumn(
        "direction", direction(F.col("rate"), steady_epsilon(basis, F.col("last_v")))
    )


def slopes(windows: DataFrame, names: tuple[str, ...] = tuple(ESTIMATORS)) -> DataFrame:
    """All named estimators beside each admissible window."""
    return admissible(windows).withColumns({f"{n}_slope": ESTIMATORS[n](F.col("pts")) for n in names})


def estimate(windows: DataFrame, tidal_class: Column, basis: Column, estimator: str = SHIPPED) -> DataFrame:
    """Full trend: tidal guard first, then sample, gap and span refusals, then slope and condition."""
    refusal = F.coalesce(tidal_refusal(tidal_class), window_refusal())
    ok = refusal.isNull()
    df = windows.withColumn("refusal", refusal).withColumn("_pairs", pair_stats(F.when(ok, F.col("pts"))))
    pairwise = {"theil_sen": F.col("_pairs.theil_sen"), "repeated_median": F.col("_pairs.repeated_median")}
    df = df.withColumn("slope", pairwise[estimator] if estimator in pairwise else F.when(ok, ESTIMATORS[estimator](F.col("pts"))))
    eps = steady_epsilon(basis, F.col("last_v"))
    expected = F.greatest(F.lit(MIN_SAMPLES), F.floor(F.col("span_h") / CADENCE_H).cast("int"))
    quality = (
        F.when(F.col("slope").isNull(), F.lit(None))
        .when(F.col("n") < expected * SUPPORT_FRACTION, "SPARSE_SUPPORT")
        .when((F.abs("slope") > 0) & (F.col("_pairs.q75") - F.col("_pairs.q25") > F.abs("slope") * WIDE_SPREAD), "WIDE_SLOPE_SPREAD")
        .otherwise("OK")
    )
    return df.withColumns({
        "direction": direction(F.col("slope"), eps), "quality": quality,
        "q25": F.col("_pairs.q25"), "q75": F.col("_pairs.q75"), "refusal": F.coalesce("refusal", F.lit("ok")),
    }).drop("_pairs")


def jitter(sloped: DataFrame, name: str, basis: Column, key: str = "station") -> DataFrame:
    """Relative step between consecutive windows and hard direction flips of one estimator."""
    s = F.col(f"{name}_slope")
    rows = sloped.withColumn("_dir", direction(s, steady_epsilon(basis, F.col("last_v"))))
    rows = running.lagged(rows, [key], running.day_block("t", BLOCK_DAYS), "t", {"_ps": f"{name}_slope", "_pd": "_dir"})
    step = F.abs(s - F.col("_ps")) / F.greatest(F.abs("last_v"), F.lit(1e-9))
    flip = (F.col("_pd") != F.col("_dir")) & (F.col("_dir") != "steady") & (F.col("_pd") != "steady")
    return rows.select(key, "t", step.alias("step"), flip.alias("flip"))


def sustained(directions: DataFrame, need: int = SUSTAIN_WINDOWS, key: str = "station") -> DataFrame:
    """Instants at which a run of rising windows reaches ``need``, per key."""
    runs = running.runs(directions, [key], running.day_block("t", BLOCK_DAYS), "t", F.col("direction") == "rising")
    return runs.filter(F.col("nth") == need).select(key, "t", plus_hours(F.col("t"), -need * CADENCE_H).alias("onset"))

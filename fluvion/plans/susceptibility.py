"""Susceptibility: the day-of-year percentile of each gauge's latest daily mean, and its company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluvion.functions import bands
from fluvion.functions.clocks import hours_between
from fluvion.functions.values import relative_difference
from fluvion.operators import doy
from fluvion.plans.climatology import DISAGREEMENT_THRESHOLD
from fluvion.session import staged

# Fixed values.
MAX_AGE_H = 48
STEADY_FRACTION_PER_H = 0.01
RANK_EDGE = 90.0
CHANGE_WINDOWS_H = (24, 48)
VERSIONS = ("0.1.0", "0.2.0")
CONTEXT_AGE_H = 7 * 24
SCORED, LEVEL, CHANGE, CONTEXT, UNAVAILABLE, LOWERS = (
    "increases_susceptibility", "level_not_scored", "state_change_not_scored", "context_not_scored", "unavailable", "lowers_confidence",
)
TIE = 1e-9


def change_direction(growth: Column, window_h: int) -> Column:
    """Multiplicative steady band, compounded over the span."""
    eps = (1.0 + STEADY_FRACTION_PER_H) ** window_h
    return F.when(growth.isNull(), "unknown").when(growth.between(1.0 / eps, eps), "steady").when(growth > 1.0, "rising").otherwise("falling")


def state_changes(daily: DataFrame) -> DataFrame:
    """Growth over 24 and 48 h beside each day; both ends must exist and be positive.

    Daily means end on the same clock, so the endpoint within tolerance is the exact calendar day:
    one window per site with a frame of exactly that offset.
    """
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    out = daily
    for h in CHANGE_WINDOWS_H:
        k = h // 24
        prior = F.max("value").over(W.partitionBy("site").orderBy(number).rangeBetween(-k, -k))
        growth = F.when((F.col("value") > 0) & (prior > 0), F.col("value") / prior)
        out = out.withColumn(f"growth_{h}h", growth).withColumn(f"direction_{h}h", change_direction(F.col(f"growth_{h}h"), h))
    return out


def ranked(days: DataFrame, ladder: DataFrame) -> DataFrame:
    """Days with their percentile (one decimal) in the ladder; no ladder, no percentile."""
    j = days.join(ladder.withColumnRenamed("key", "doy"), ["site", "doy"], "left")
    return j.withColumn("percentile", F.round(doy.percentile_of(F.col("value")) + TIE, 1)).withColumn("clamped", F.coalesce(doy.outside_range(F.col("value")), F.lit(False)))


def assess(daily: DataFrame, at: Column, ceilings: DataFrame, cadence_s: int, grace_s: int, version: str = "0.2.0", published: DataFrame | None = None) -> DataFrame:
    """One row per gauge: band, confidence, multiple, rank, boundary, changes, or a reason.

    ``daily``: site, day, doy, wy, value (known at ``at``). ``ceilings``: site, ceiling.
    Version 0.1.0 publishes the level only. ``published`` (site, doy, published_p50) is a second ladder's median: where
    the two differ by more than a tenth, confidence drops one level and ``disagreement_pct`` says by how much. It is
    null where they agree or nothing is published; the two are never averaged.
    """
    if version not in VERSIONS:
        raise ValueError(f"unknown version {version!r}; known: {VERSIONS}")
    extended_version = version != "0.1.0"
    latest = daily.groupBy("site").agg(F.max(F.struct("day", "doy", "wy", "value")).alias("b")).select("site", "b.*")
    # of each site only the window of its latest day is read: about five days of every year
    asked = latest.select("site", F.col("doy").alias("key"))
    reference = staged(doy.reference(daily, asked), "reference") if extended_version else None
    ladder = reference.select("site", "key", "n", *doy.P.values()) if extended_version else doy.ladder(daily, asked)
    valid_time = F.date_add("day", 1).cast("timestamp")
    row = ranked(latest, ladder).withColumn("age_h", hours_between(at, valid_time))
    stale = F.col("age_h") > MAX_AGE_H
    reason = F.when(stale, "daily_mean_too_old").when(F.col("percentile").isNull(), "no_climatology")
    ok = reason.isNull()
    fresh = F.when(F.col("age_h") * 3600 > cadence_s * 4, "degraded").when(F.col("age_h") * 3600 > cadence_s + grace_s, "stale").otherwise("current")
    row = row.join(ceilings, "site", "left")
    confidence = bands.lowest_confidence(bands.confidence_ceiling(F.col("ceiling")), bands.freshness_confidence(fresh))
    p = F.col("percentile")
    checked = []
    if published is not None:
        row = row.join(published.select("site", "doy", "published_p50"), ["site", "doy"], "left")
        off = relative_difference(F.col("p50"), F.col("published_p50"))
        disputed = F.coalesce(F.abs(off) > DISAGREEMENT_THRESHOLD, F.lit(False))
        confidence = F.when(disputed, bands.one_level_down(confidence)).otherwise(confidence)
        checked = [F.when(ok & disputed, F.round(off * 100 + TIE, 1)).alias("disagreement_pct")]
    base = [
        "site", "day", F.when(ok, F.col("value")).alias("value"), F.when(ok, p).alias("percentile"), F.when(ok, bands.band(p)).otherwise("unknown").alias("band"),
        F.when(ok, F.round(p / 100, 4)).alias("score"), F.when(ok, confidence).otherwise("unknown").alias("confidence"), F.coalesce(reason, F.lit("ok")).alias("reason"),
        F.lit(f"susceptibility@{version}").alias("method"), *checked,
    ]
    if not extended_version:
        return row.select(*base)

    years = bands.independent_years(F.col("n"))
    se = F.when(~F.col("clamped"), bands.rank_standard_error(p, years))
    extended = row.withColumn("se", se).select(
        *base, "doy",
        F.when(ok, bands.seasonal_multiple(F.col("value"), F.col("p95"))).alias("multiple"),
        F.when(ok, bands.boundary(p, F.col("se"))).alias("boundary"),
        (ok & (p >= RANK_EDGE)).alias("hot"),
    )
    # the exact rank is read only for gauges at or above the edge
    hot = extended.filter("hot").select("site", "day", F.col("doy").alias("key"), "value")
    context = reference.select(*doy.CONTEXT)
    ranks = doy.window_rank(hot, context, doy.record_tail(daily, context)).select("site", "rank", "rank_of", "exceeds_record")
    last = latest.select("site", "day")
    recent = daily.join(last.select("site", F.date_sub("day", 2).alias("since")), "site").filter(F.col("day") >= F.col("since"))
    changes = state_changes(recent.select("site", "day", "value")).join(last, ["site", "day"], "left_semi").select("site", "growth_24h", "direction_24h", "growth_48h", "direction_48h")
    grown = changes.select("site", F.col("growth_24h").alias("growth")).filter("growth IS NOT NULL")
    growth_rank = doy.growth_rank(grown, doy.growth_reference(daily, 24)).select("site", "growth_rank", "growth_rank_of")
    out = extended.join(ranks, "site", "left").join(changes, "site", "left").join(growth_rank, "site", "left")
    when_ok = lambda c: F.when(F.col("reason") == "ok", F.col(c)).alias(c)
    return out.select(
        *[c for c in extended.columns if c not in ("doy", "hot")], "rank", "rank_of", when_ok("growth_24h"), when_ok("growth_48h"),
        F.when(F.col("reason") == "ok", F.col("direction_24h")).otherwise("unknown").alias("direction_24h"), when_ok("growth_rank"),
    )


def current_context(contexts: DataFrame, at: Column) -> DataFrame:
    """Of (basin, clock, known_at, …) the newest row per basin that is known at ``at`` and at most a week old."""
    known = contexts.filter((F.col("known_at") <= at) & (F.col("clock") <= at) & (hours_between(at, F.col("clock")) <= CONTEXT_AGE_H))
    rest = [c for c in contexts.columns if c not in ("basin", "clock", "known_at")]
    best = F.max(F.struct("clock", "known_at", *rest)).alias("b")
    return known.groupBy("basin").agg(best).select("basin", "b.*")


def drivers(assessed: DataFrame, sites: DataFrame, swe: DataFrame, precip: DataFrame, snow: DataFrame) -> DataFrame:
    """(site, rank, feature, value, unit, direction, clock): what a gauge's susceptibility rests on, numbered from 1.

    ``assessed``: rows of :func:`assess` with a published ladder. ``sites``: site, basin. ``swe``, ``precip``: basin, clock,
    value (percent of median); ``snow``: basin, clock, swe_mm, covered (fraction). Snow is context and never scored: its two
    station numbers have a row even when nothing is known, the gridded ones only when a field is. Soil always has a row
    without a value. A gauge that is refused has the soil row alone.
    """
    part = lambda df, name, *cols: df.select("basin", F.col("clock").alias(f"{name}_clock"), *[F.col(c).cast("double").alias(f"{name}_{c}") for c in cols])
    j = assessed.join(sites, "site", "left")
    for piece in (part(swe, "swe", "value"), part(precip, "precip", "value"), part(snow, "snow", "swe_mm", "covered")):
        j = j.join(piece, "basin", "left")

    def one(feature: str, value: Column, unit: str, direction: str, clock: Column, shown: Column | None = None) -> Column:
        made = F.struct(
            F.lit(feature).alias("feature"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(direction).alias("direction"), clock.cast("timestamp").alias("clock"),
        )
        return F.when(value.isNotNull() if shown is None else shown, made)

    always, day, none = F.lit(True), F.col("day"), F.lit(None)
    growths = [one(f"streamflow_growth_{h}h", F.round(F.col(f"growth_{h}h") + TIE, 3), "x", CHANGE, day) for h in CHANGE_WINDOWS_H]
    soil = one("soil_saturation_percentile", none, "pct", UNAVAILABLE, none, always)
    rows = F.array_compact(F.array(
        one("streamflow_doy_percentile", F.col("percentile"), "pct", SCORED, day),
        one("streamflow_seasonal_multiple", F.round(F.col("multiple") + TIE, 3), "x", LEVEL, day),
        *growths,
        one("basin_swe_percent_of_median", F.col("swe_value"), "pct", CONTEXT, F.col("swe_clock"), always),
        one("basin_swe_mm", F.col("snow_swe_mm"), "mm", CONTEXT, F.col("snow_clock"), F.col("snow_clock").isNotNull()),
        one("basin_snow_covered_fraction", F.round(F.col("snow_covered") * 100 + TIE, 2), "pct", CONTEXT, F.col("snow_clock")),
        one("snotel_precip_14d_percent_of_median", F.col("precip_value"), "pct", CONTEXT, F.col("precip_clock"), always),
        soil,
        one("climatology_p50_disagreement", F.col("disagreement_pct"), "pct", LOWERS, day),
    ))
    # at most ten entries per gauge: their places are their ranks, no window is needed
    listed = j.select("site", F.posexplode(F.when(F.col("reason") == "ok", rows).otherwise(F.array(soil))).alias("place", "d"))
    return listed.select("site", (F.col("place") + 1).alias("rank"), "d.*")

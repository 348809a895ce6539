"""State of every river point at its knowledge time, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fluvion.functions import flood
from fluvion.functions.clocks import hours_between, plus_hours
from fluvion.functions.values import age_seconds, freshness
from fluvion.operators import hydrograph, selection, trend

# Fixed values.
LOOKBACK_H = 24 * 14
TREND_H = 6
PRIMARY, COMPANION = "stage", "flow"


def admissible(observations: DataFrame, at: Column, lookback_h: int = LOOKBACK_H) -> DataFrame:
    """Both clocks and the lookback are filtered before anything is ranked."""
    return observations.filter((F.col("available_at") <= at) & F.col("valid_time").between(plus_hours(at, -lookback_h), at))


def best_per_instant(observations: DataFrame) -> DataFrame:
    """Newest revision of each (point, variable, instant), reduced map-side."""
    return observations.groupBy("point", "variable", "valid_time").agg(
        F.max(F.struct("id", "value", "retrieved_at")).alias("b")
    ).select("point", "variable", "valid_time", "b.*")


def latest_state(best: DataFrame) -> DataFrame:
    """Newest primary reading per point with the companion of exactly the same instant."""
    primary = best.filter(F.col("variable") == PRIMARY)
    latest = primary.groupBy("point").agg(F.max(F.struct("valid_time", "id", "value", "retrieved_at")).alias("b")).select("point", "b.*")
    other = best.filter(F.col("variable") == COMPANION).select("point", "valid_time", F.col("value").alias("companion"), F.col("id").alias("companion_id"), F.col("retrieved_at").alias("companion_known"))
    return latest.join(other, ["point", "valid_time"], "left")


def trend_at(best: DataFrame, at: Column, tidal_class: Column) -> DataFrame:
    """Trend over the closed six hours before ``at``; hourly readings bound the window."""
    window = best.filter((F.col("variable") == PRIMARY) & F.col("valid_time").between(plus_hours(at, -TREND_H), at) & F.col("value").isNotNull())
    x = hours_between(F.col("valid_time"), plus_hours(at, -TREND_H))
    # the readings behind a rate travel with it: their number, ids and clocks
    source = F.struct(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("valid_time").alias("valid_time"), F.max("retrieved_at").alias("known_at"))
    w = window.groupBy("point").agg(F.sort_array(F.collect_list(F.struct(x.alias("x"), F.col("value").alias("y")))).alias("pts"), source.alias("trend_source"))
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    gaps = F.transform(F.slice("pts", 2, F.greatest(F.size("pts") - 1, F.lit(0))), lambda q, i: q["x"] - F.get("pts", i)["x"])
    w = w.select("point", "trend_source", "pts", F.size("pts").alias("n"), (last["x"] - first["x"]).alias("span_h"), F.coalesce(F.array_max(gaps), F.lit(0.0)).alias("max_gap_h"), last["y"].alias("last_v"))
    return trend.estimate(w, tidal_class, F.lit(PRIMARY)).select("point", F.col("refusal").alias("trend_refusal"), F.col("slope").alias("rate"), "direction", "trend_source")


def official_forecast(runs: DataFrame, values: DataFrame, at: Column) -> DataFrame:
    """Newest official run known at ``at`` per point, with its crest inside the hazard window.

    The run per point is found first, from the headers; only values of those runs are joined.
    ``values``: run_id, after_h (hours after the issue time), stage.
    """
    newest = selection.newest(runs.filter(F.col("available_at") <= at), ["point"], [F.desc("issued_at"), F.desc("run_id")]).select("point", "run_id", "issued_at", F.col("available_at").alias("run_known"))
    chosen = values.join(newest, "run_id").withColumn("valid_time", plus_hours(F.col("issued_at"), F.col("after_h"))).withColumn("as_of", at)
    crest = hydrograph.crests(chosen, ["point", "run_id"], "stage")
    return newest.join(crest, ["point", "run_id"], "left")


def dated_levels(thresholds: DataFrame, at: Column) -> DataFrame:
    """The levels of each point in force and known at ``at``, side by side, with the rows they come from.

    ``thresholds``: point, category, level, effective_from, known_at, id. The newest row of each category stands.
    """
    known = thresholds.filter((F.col("effective_from") <= at) & (F.col("known_at") <= at) & F.col("category").isin(*flood.CATEGORIES))
    row = F.struct("effective_from", "known_at", "id", "level")
    g = known.groupBy("point").agg(*[F.max(F.when(F.col("category") == c, row)).alias(f"_{c}") for c in flood.CATEGORIES])
    ref = lambda c: F.when(F.col(f"_{c}").isNotNull(), reference(F.lit(f"level:{c}"), F.col(f"_{c}.id"), F.col(f"_{c}.effective_from"), F.col(f"_{c}.known_at")))
    return g.select("point", *[F.col(f"_{c}.level").alias(c) for c in flood.CATEGORIES], F.array_compact(F.array(*map(ref, flood.CATEGORIES))).alias("level_sources"))


def reference(part: Column, row_id: Column, valid: Column, known: Column, n: Column | None = None, last_id: Column | None = None) -> Column:
    """What stands behind one published number: how many rows, the first and last of their ids, and both clocks."""
    one = F.lit(1).cast("long") if n is None else n
    return F.struct(part.alias("part"), one.alias("n"), row_id.cast("long").alias("first_id"), (row_id if last_id is None else last_id).cast("long").alias("last_id"), valid.alias("valid_time"), known.alias("known_at"))


def evidence(observations: DataFrame, at: Column, runs: DataFrame, values: DataFrame, tidal_class: Column) -> DataFrame:
    """The chosen rows of every point that has a reading, each reduction carrying the ids and clocks of what it chose."""
    best = best_per_instant(admissible(observations, at))
    return latest_state(best).join(trend_at(best, at, tidal_class), "point", "left").join(official_forecast(runs, values, at), "point", "left")


def provenance(state: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(point, part, n, first_id, last_id, valid_time, known_at): the rows and clocks behind each published number.

    ``state`` is the `evidence` of the points; ``levels`` their `dated_levels`.
    """
    t = F.col("trend_source")
    parts = [
        reference(F.lit("value"), F.col("id"), F.col("valid_time"), F.col("retrieved_at")),
        F.when(F.col("companion_id").isNotNull(), reference(F.lit("companion"), F.col("companion_id"), F.col("valid_time"), F.col("companion_known"))),
        F.when(t.isNotNull(), reference(F.lit("trend"), t["first_id"], t["valid_time"], t["known_at"], t["n"], t["last_id"])),
        F.when(F.col("run_id").isNotNull(), reference(F.lit("hazard"), F.col("run_id"), F.col("crest_time"), F.col("run_known"))),
    ]
    refs = F.array_compact(F.array(*parts))
    if levels is not None:
        state = state.join(levels.select("point", "level_sources"), "point", "left")
        refs = F.when(F.col("level_sources").isNull(), refs).otherwise(F.concat(refs, F.col("level_sources")))
    return state.select("point", F.inline(refs))


def point_state(
    observations: DataFrame, levels: dict[str, Column], at: Column, runs: DataFrame, values: DataFrame, tidal_class: Column, cadence_s: Column, grace_s: Column
) -> DataFrame:
    """One row per point that has a reading: category, trend, headroom, forecast, freshness, reasons."""
    return published(evidence(observations, at, runs, values, tidal_class), levels, at, cadence_s, grace_s)


def published(state: DataFrame, levels: dict[str, Column], at: Column, cadence_s: Column, grace_s: Column) -> DataFrame:
    """The published numbers of the `evidence` of points."""
    v, crest = F.col("value"), F.col("crest")
    direction = F.coalesce("direction", F.lit("unknown"))
    room = flood.headroom(v, levels)
    clock = (at, F.col("valid_time"), F.col("retrieved_at"))
    return state.select(
        "point", "valid_time", "value", "companion",
        flood.category(v, levels).alias("category"),
        F.coalesce("trend_refusal", F.lit("INSUFFICIENT_OBSERVATIONS")).alias("trend_refusal"),
        "rate", direction.alias("direction"),
        room.alias("headroom"), flood.next_category(v, levels).alias("headroom_to"), flood.hours_to_level(room, F.col("rate"), direction).alias("hours_to_level"),
        F.coalesce(flood.headroom_reason(v, levels, F.col("rate"), direction), F.lit("ok")).alias("headroom_reason"),
        "run_id", "crest", "crest_time",
        F.when(crest.isNotNull(), flood.category(crest, levels)).otherwise("unknown").alias("hazard"),
        F.when(F.col("run_id").isNull(), "no_official_forecast").when(crest.isNull(), "no_value_inside_horizon").otherwise("ok").alias("hazard_reason"),
        freshness(*clock, cadence_s, grace_s).alias("freshness"), age_seconds(*clock).alias("age_s"),
    )

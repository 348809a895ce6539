"""Forecast documents: official hydrographs, model ensembles, exceedance quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluvion.functions.clocks import has_offset, parse_instant
from fluvion.functions.values import number
from fluvion.sources.documents import accepted, once, parse_json, refuse

# Fixed values.
SENTINEL = -9999.0
FLOW_UNITS = ("ft³/s", "ft3/s", "cfs")
MAX_STEP_S = 24 * 3600

STAGEFLOW = (
    "lid: string, forecast: struct<issuedTime: string, primaryName: string, primaryUnits: string, secondaryName: string, secondaryUnits: string, "
    "data: array<struct<validTime: string, primary: double, secondary: double>>>"
)
SERIES = "struct<referenceTime: string, units: string, data: array<struct<validTime: string, flow: double>>>"
MEDIUM_RANGE = f"reach: string, mediumRange: map<string, {SERIES}>"
MEMBER = (
    "location_id: string, parameter_id: string, ensemble_id: string, forecast_datetime: string, creation_datetime: string, units: string, time_step_unit: string, "
    "time_step_multiplier: string, ensemble_member_index: string, miss_val: string, events: array<struct<valid_datetime: string, value: string>>"
)
QUANTILES = (
    "metadata: struct<location_id: string, forecast_datetime: string, units: string, exceedance_quantiles: array<double>>, "
    "value_set: array<struct<valid_datetime: string, quantile_values: array<double>, max_value: double, min_value: double>>"
)


def stage_flow(docs: DataFrame) -> DataFrame:
    """Official hydrograph points in document order; an empty series is no series, not an error."""
    df = parse_json(docs, STAGEFLOW)
    some = F.size(F.coalesce("doc.forecast.data", F.array().cast("array<struct<validTime: string, primary: double, secondary: double>>"))) > 0
    df = refuse(df, some & F.col("doc.forecast.issuedTime").isNull(), "no_issue_time")
    rows = accepted(df).select("doc.lid", "doc.forecast.*").select(
        "lid", parse_instant(F.col("issuedTime")).alias("issued_at"), F.lower("primaryName").alias("primary_name"), F.col("primaryUnits").alias("primary_unit"),
        F.col("secondaryUnits").alias("secondary_unit"), F.posexplode("data").alias("pos", "p"),
    )
    clean = lambda c: F.when(F.col(c) > -900, F.col(c))
    return rows.select(
        "lid", "issued_at", "primary_name", "primary_unit", "secondary_unit", "pos", parse_instant(F.col("p.validTime")).alias("valid_time"),
        clean("p.primary").alias("primary"), clean("p.secondary").alias("secondary"),
    )


def medium_range(docs: DataFrame) -> DataFrame:
    """Ensemble members as rows, ordered numerically; the provider's mean is kept apart.

    Unknown flow units refuse the document; an empty block means there is no cycle.
    """
    df = parse_json(docs, MEDIUM_RANGE)
    units = F.map_values("doc.mediumRange")
    df = refuse(df, F.exists(units, lambda s: ~F.coalesce(s["units"].isin(*FLOW_UNITS), F.lit(False))), "unknown_unit")
    m = accepted(df).select("path", "doc.reach", F.explode("doc.mediumRange").alias("name", "s"))
    index = F.nullif(F.regexp_extract("name", r"(\d+)$", 1), F.lit("")).cast("int")
    rows = m.filter(F.size("s.data") > 0).select(
        "path", "reach", "name", index.alias("member"), (F.col("name") == "mean").alias("is_mean"), parse_instant(F.col("s.referenceTime")).alias("cycle"), F.explode("s.data").alias("d")
    )
    return rows.select("path", "reach", "name", "member", "is_mean", "cycle", parse_instant(F.col("d.validTime")).alias("valid_time"), F.nullif("d.flow", F.lit(SENTINEL)).alias("flow"))


def ensembles(docs: DataFrame) -> DataFrame:
    """Array of cycles of arrays of members; a group that mixes headers is refused whole.

    An empty outer list is a valid answer and gives no groups; content that cannot be read gives one
    refused row without a group number. One row per group.
    """
    parsed = once(docs, "groups", F.from_json("content", f"array<array<struct<{MEMBER}>>>"))
    g = parsed.select("path", F.col("groups").isNull().alias("_unread"), F.posexplode_outer("groups").alias("group_no", "members"))
    g = g.filter("_unread or size(members) > 0").withColumn("refusal", F.when(F.col("_unread"), "malformed")).drop("_unread")
    step = F.transform("members", lambda m: m["time_step_multiplier"].try_cast("int"))
    g = refuse(g, F.exists("members", lambda m: ~m["time_step_unit"].eqNullSafe(F.lit("second"))), "step_unit")
    g = refuse(g, F.exists(step, lambda s: F.coalesce((s <= 0) | (s > MAX_STEP_S), F.lit(True))), "implausible_step")
    identity = F.transform("members", lambda m: F.concat_ws("|", m["location_id"], m["forecast_datetime"], m["ensemble_id"], m["units"]))
    g = refuse(g, F.size(F.array_distinct(identity)) > 1, "mixed_group")
    return refuse(g, F.exists("members", lambda m: ~has_offset(m["forecast_datetime"])), "naive_instant")


def ensemble_rows(groups: DataFrame) -> DataFrame:
    m = accepted(groups).select("path", "group_no", F.explode("members").alias("m"))
    e = m.select("path", "m.location_id", parse_instant(F.col("m.forecast_datetime")).alias("cycle"), F.col("m.ensemble_member_index").cast("int").alias("member"), F.col("m.miss_val").alias("miss"), F.explode("m.events").alias("e"))
    return e.select(
        "location_id", "cycle", "member", parse_instant(F.col("e.valid_datetime")).alias("valid_time"),
        F.when(~F.coalesce(F.col("e.value") == F.col("miss"), F.lit(False)), number(F.col("e.value"))).alias("value"),
    )


def quantiles(docs: DataFrame) -> DataFrame:
    """Published exceedance quantiles; every row must have as many values as there are levels."""
    df = parse_json(docs, QUANTILES)
    levels = F.col("doc.metadata.exceedance_quantiles")
    df = refuse(df, F.coalesce(F.size(levels), F.lit(0)) <= 0, "no_levels")
    return refuse(df, F.exists("doc.value_set", lambda r: F.size(r["quantile_values"]) != F.size(levels)), "level_count_mismatch")


def quantile_rows(parsed: DataFrame) -> DataFrame:
    """Long form: (location, cycle, valid time, level, value)."""
    r = accepted(parsed).select("doc.metadata.*", F.explode("doc.value_set").alias("r"))
    z = r.select("location_id", "forecast_datetime", "r.*", F.explode(F.arrays_zip(F.col("exceedance_quantiles").alias("level"), F.col("r.quantile_values").alias("value"))).alias("z"))
    return z.select(
        "location_id", parse_instant(F.col("forecast_datetime")).alias("cycle"), parse_instant(F.col("valid_datetime")).alias("valid_time"), "z.level", "z.value", "max_value", "min_value"
    )

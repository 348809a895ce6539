"""Gauge documents: readings, daily means, day-of-year tables, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluvion.functions.clocks import has_offset, parse_instant
from fluvion.functions.values import number, number_with_flag
from fluvion.sources.documents import accepted, once, parse_json, refuse

# Fixed values.
PARAMETERS = {"00065": "stage", "00060": "flow"}
DISCHARGE, DAILY_MEAN = "00060", "00003"
NO_DATA = -999999.0
THRESHOLD_SENTINEL = -9999.0
PERCENTILE_COLUMNS = ("p05_va", "p10_va", "p25_va", "p50_va", "p75_va", "p90_va", "p95_va")
ALLOWED_LEVELS = (5, 10, 25, 50, 75, 90, 95)

READING = "monitoring_location_id: string, parameter_code: string, statistic_id: string, time: string, value: string, unit_of_measure: string, approval_status: string, qualifier: array<string>"
CONTINUOUS = f"features: array<struct<properties: struct<{READING}>>>, numberReturned: int, links: array<struct<rel: string, href: string>>"
REQUIRED = ("monitoring_location_id", "parameter_code", "time", "value")
NESTED = (
    "value: struct<timeSeries: array<struct<variable: struct<variableCode: array<struct<value: string>>, unit: struct<unitCode: string>, noDataValue: double>, "
    "values: array<struct<value: array<struct<value: string, qualifiers: array<string>, dateTime: string>>>>>>>"
)
NORMALS = "site: string, rows: array<struct<month_day: string, n: int, levels: array<string>, values: array<string>>>"
GAUGE = "lid: string, datum: string, stage_units: string, flow_units: string, flood: struct<categories: map<string, struct<stage: double, flow: double>>>"


def variable_of(code):
    expr = F.lit(None).cast("string")
    for k, v in PARAMETERS.items():
        expr = F.when(code == k, F.lit(v)).otherwise(expr)
    return expr


def continuous(docs: DataFrame) -> DataFrame:
    """Instantaneous readings; a page with a feature that lacks a required field is refused whole."""
    df = parse_json(docs, CONTINUOUS)
    df = refuse(df, F.col("doc.features").isNull(), "missing_features")
    incomplete = F.exists("doc.features", lambda f: F.greatest(*[f["properties"][c].isNull().cast("int") for c in REQUIRED]) == 1)
    df = refuse(df, incomplete, "missing_required_field")
    return refuse(df, F.exists("doc.features", lambda f: ~has_offset(f["properties"]["time"])), "naive_instant")


def continuous_rows(pages: DataFrame) -> DataFrame:
    p = accepted(pages).select("path", F.explode("doc.features").alias("f")).select("path", "f.properties.*")
    return p.select(
        "path", F.col("monitoring_location_id").alias("site"), variable_of(F.col("parameter_code")).alias("variable"), number(F.col("value")).alias("value"),
        F.col("unit_of_measure").alias("unit"), F.col("approval_status").alias("approval"), F.col("statistic_id").alias("statistic"),
        F.col("qualifier").alias("qualifiers"), parse_instant(F.col("time")).alias("valid_time"),
    )


def next_page(pages: DataFrame) -> DataFrame:
    """Pages that announce a following page."""
    return pages.select("path", F.get(F.filter("doc.links", lambda x: x["rel"] == "next"), F.lit(0))["href"].alias("next_url"))


def nested_series(docs: DataFrame) -> DataFrame:
    """Older nested document: one row per value of a stage or flow series, other series ignored."""
    df = accepted(refuse(parse_json(docs, NESTED), F.col("doc.value.timeSeries").isNull(), "missing_series"))
    s = df.select("path", F.explode("doc.value.timeSeries").alias("s")).withColumn("variable", variable_of(F.get("s.variable.variableCode", F.lit(0))["value"]))
    v = s.filter(F.col("variable").isNotNull()).select("path", "variable", "s.variable", F.explode("s.values").alias("block")).toDF("path", "variable", "meta", "block")
    v = v.select("path", "variable", "meta", F.explode("block.value").alias("v"))
    n = number_with_flag(F.col("v.value"), F.coalesce("meta.noDataValue", F.lit(NO_DATA)))
    return v.select(
        "path", "variable", n["value"].alias("value"), n["flag"].alias("flag"), F.col("meta.unit.unitCode").alias("unit"),
        F.col("v.qualifiers").alias("qualifiers"), parse_instant(F.col("v.dateTime")).alias("valid_time"),
    )


DAILY_COLUMNS = ("time", "value", "approval_status")


def daily_csv(docs: DataFrame) -> DataFrame:
    """Daily means of one file per site, columns found by name; the file's own site must match.

    ``docs`` carries ``site``. Adds ``header`` (column positions) and ``refusal``.
    """
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: (F.length(x) > 0) & ~x.startswith("#"))
    df = once(once(docs, "lines", lines), "header", F.split(F.get("lines", F.lit(0)), ",")).withColumn("refusal", F.lit(None).cast("string"))
    missing = F.lit(False)
    for c in DAILY_COLUMNS:
        missing = missing | ~F.array_contains("header", c)
    df = refuse(df, missing, "missing_column")
    at = F.array_position("header", F.lit("monitoring_location_id")).cast("int") - 1
    foreign = F.exists(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda r: ~F.get(F.split(r, ","), at).eqNullSafe(F.col("site")))
    return refuse(df, (at >= 0) & foreign, "foreign_site")


def daily_rows(files: DataFrame) -> DataFrame:
    rows = accepted(files).select("site", "header", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("pos", "line"))
    rows = once(rows, "cells", F.split("line", ",", -1))
    cell = lambda name: F.get("cells", F.array_position("header", F.lit(name)).cast("int") - 1)
    return rows.select(
        "site", "pos", F.to_date(cell("time")).alias("day"), F.nullif(F.trim(cell("value")), F.lit("")).alias("raw"), F.trim(cell("approval_status")).alias("approval")
    )


def latest_daily(docs: DataFrame) -> DataFrame:
    """Latest complete daily mean discharge of many sites in one document; other parameters and statistics are not read.

    A feature without a statistic is a daily mean.
    """
    df = accepted(parse_json(docs, CONTINUOUS))
    p = df.select(F.explode("doc.features").alias("f")).select("f.properties.*")
    p = p.filter((F.col("parameter_code") == DISCHARGE) & (F.coalesce("statistic_id", F.lit(DAILY_MEAN)) == DAILY_MEAN))
    return p.select(
        F.substring_index("monitoring_location_id", "-", -1).alias("site"), F.to_date("time").alias("day"), number(F.col("value")).alias("value"), F.col("approval_status").alias("approval")
    )


def rdb_table(docs: DataFrame) -> DataFrame:
    """Day-of-year percentile table in tab-separated form: comments, a header, a type row, data."""
    lines = F.filter(F.split("content", r"\r?\n"), lambda x: (F.length(x) > 0) & ~x.startswith("#"))
    df = docs.withColumn("lines", lines).withColumn("header", F.split(F.get("lines", F.lit(0)), "\t"))
    rows = df.filter(F.size("lines") > 2).select("header", F.explode(F.slice("lines", 3, F.size("lines") - 2)).alias("line")).withColumn("cells", F.split("line", "\t", -1))
    cell = lambda name: F.nullif(F.get("cells", F.array_position("header", F.lit(name)).cast("int") - 1), F.lit(""))
    wide = rows.select(
        cell("site_no").alias("site"), cell("month_nu").cast("int").alias("month"), cell("day_nu").cast("int").alias("dom"), cell("count_nu").cast("int").alias("n"),
        cell("begin_yr").cast("int").alias("begin_year"), cell("end_yr").cast("int").alias("end_year"), *[number(cell(c)).alias(c) for c in PERCENTILE_COLUMNS],
    )
    long = wide.unpivot(["site", "month", "dom", "n", "begin_year", "end_year"], list(PERCENTILE_COLUMNS), "column", "value")
    return long.filter("value IS NOT NULL").withColumn("level", F.substring("column", 2, 2).cast("int")).drop("column")


def normals(docs: DataFrame) -> DataFrame:
    """Day-of-year normals as parallel arrays; another length refuses, the text 'nan' is absent."""
    df = refuse(parse_json(docs, NORMALS), F.col("doc.rows").isNull(), "missing_rows")
    return refuse(df, F.exists("doc.rows", lambda r: F.size(r["levels"]) != F.size(r["values"])), "length_mismatch")


def normal_rows(parsed: DataFrame) -> DataFrame:
    r = accepted(parsed).select("doc.site", F.explode("doc.rows").alias("r"))
    z = r.select("site", "r.month_day", "r.n", F.explode(F.arrays_zip(F.col("r.levels").alias("level"), F.col("r.values").alias("value"))).alias("z"))
    return z.select("site", "month_day", "n", F.col("z.level").try_cast("int").alias("level"), number(F.col("z.value")).alias("value")).filter(
        F.col("level").isin(*ALLOWED_LEVELS) & F.col("value").isNotNull()
    )


def gauge_thresholds(docs: DataFrame) -> DataFrame:
    """Gauge metadata with its categories as rows; the sentinel becomes null."""
    df = accepted(refuse(parse_json(docs, GAUGE), F.col("doc.lid").isNull(), "missing_lid"))
    rows = df.select("doc.lid", "doc.datum", F.col("doc.flow_units").alias("flow_unit"), F.explode("doc.flood.categories").alias("category", "c"))
    clean = lambda c: F.nullif(F.col(c), F.lit(THRESHOLD_SENTINEL))
    return rows.select("lid", "datum", "flow_unit", "category", clean("c.stage").alias("stage"), clean("c.flow").alias("flow"))


def published_ladder(rows: DataFrame) -> DataFrame:
    """Published day-of-year table in the shape of a built ladder: one map level → value per key.

    ``rows``: site, month, dom, year, level, value. A key without values keeps an empty map.
    """
    valued = F.col("value").isNotNull()
    by_level = rows.groupBy("site", "month", "dom", "level").agg(
        F.max("value").alias("value"), F.min(F.when(valued, F.col("year"))).alias("y0"), F.max(F.when(valued, F.col("year"))).alias("y1")
    )
    entry = F.when(F.col("value").isNotNull(), F.struct("level", "value"))
    return by_level.groupBy("site", "month", "dom").agg(
        F.map_from_entries(F.collect_list(entry)).alias("ladder"), F.min("y0").alias("begin_year"), F.max("y1").alias("end_year")
    )

"""Documents as the first prototype read them: its own sentinels, one site or gauge per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluvion.functions.flood import CATEGORIES
from fluvion.functions.values import number
from fluvion.sources.documents import accepted, parse_json, refuse

# Fixed values.
READING_SENTINEL, LEVEL_SENTINEL = -999998.0, -9000.0  # this or anything below it is no number
SERIES = (("00065", "stage", "ft"), ("00060", "flow", "cfs"))
LEVEL_FIELDS = ("stage", "value", "ft")
SNOW_ELEMENT = "WTEQ"

NESTED = (
    "value: struct<timeSeries: array<struct<variable: struct<variableCode: array<struct<value: string>>, unit: struct<unitCode: string>>, "
    "values: array<struct<value: array<struct<value: string, dateTime: string>>>>>>>"
)
GAUGE = "flood: struct<categories: map<string, string>>"
SNOW = "entries: array<struct<stationTriplet: string, data: array<struct<stationElement: struct<elementCode: string>, values: array<struct<date: string, value: string>>>>>>"


def above(value, sentinel: float):
    return F.when(value > sentinel, value)


def series(docs: DataFrame) -> DataFrame:
    """Stage and flow of each document (path, site, content): always two rows, with the points that count.

    A point needs a number above the sentinel and a time. Points are in the order of their time texts; of several at the
    latest time the first of the document is the latest. The last series of a parameter stands. ``note`` says why there is
    no latest value: ``malformed``, ``no_data`` (the parameter is not in the document) or ``empty_series``.
    """
    df = parse_json(docs, NESTED)
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(v).alias("variable"), F.lit(u).alias("unit")) for c, v, u in SERIES]))
    df = df.select("path", "site", "refusal", F.col("doc.value.timeSeries").alias("all"), kinds.alias("k"))
    own = F.filter("all", lambda s: F.get(s["variable"]["variableCode"], F.lit(0))["value"] == F.col("k.code"))
    df = df.withColumn("s", F.when(F.col("refusal").isNull(), F.get(own, F.size(own) - 1)))
    blocks = F.flatten(F.filter(F.transform("s.values", lambda b: b["value"]), lambda v: v.isNotNull()))
    points = F.transform(blocks, lambda p, i: F.struct(p["dateTime"].alias("t"), i.alias("place"), above(number(p["value"]), READING_SENTINEL).alias("v")))
    kept = F.array_sort(F.filter(points, lambda p: p["v"].isNotNull() & (F.length(p["t"]) > 0)))
    df = df.withColumn("points", F.coalesce(kept, F.array().cast("array<struct<t:string,place:int,v:double>>")))
    last = F.get("points", F.size("points") - 1)["t"]
    latest = F.get(F.filter("points", lambda p: p["t"] == last), F.lit(0))["v"]
    unit = F.coalesce("s.variable.unit.unitCode", "k.unit")
    note = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(F.col("s").isNull(), F.lit("no_data")).when(F.size("points") == 0, F.lit("empty_series"))
    )
    return df.select(
        "path", "site", F.col("k.variable").alias("variable"), F.when((F.col("k.variable") == "flow") & (unit == "ft3/s"), "cfs").otherwise(unit).alias("unit"),
        F.transform("points", lambda p: F.struct(p["t"].alias("t"), p["v"].alias("v"))).alias("points"), last.alias("latest_at"), latest.alias("latest"),
        F.coalesce(note, F.lit("ok")).alias("note"),
    )


def levels(docs: DataFrame) -> DataFrame:
    """Flood levels of each gauge document (path, content) side by side; a document without any is refused.

    A level is the first of its fields stage, value and ft that is a number; if that one is a sentinel there is no level. A
    category that is not an object has none.
    """
    df = parse_json(docs, GAUGE)

    def level(category: str):
        text = F.try_element_at("doc.flood.categories", F.lit(category))
        return above(F.coalesce(*[number(F.get_json_object(text, f"$.{f}")) for f in LEVEL_FIELDS]), LEVEL_SENTINEL).alias(category)

    df = df.select("path", "refusal", *map(level, CATEGORIES))
    return refuse(df, F.coalesce(*CATEGORIES).isNull(), "missing_categories")


def snow(docs: DataFrame) -> DataFrame:
    """(path, station, day, value) of the asked stations in documents (path, stations, content) that are arrays of entries.

    Of an entry the first snow-water element is read, of a station the last entry that has one; readings without a day
    or a number are left out.
    """
    df = accepted(parse_json(docs.withColumn("content", F.concat(F.lit('{"entries":'), "content", F.lit("}"))), SNOW))
    e = df.select("path", "stations", F.posexplode("doc.entries").alias("place", "e")).filter(F.array_contains("stations", F.col("e.stationTriplet")))
    element = F.get(F.filter("e.data", lambda d: d["stationElement"]["elementCode"] == SNOW_ELEMENT), F.lit(0))
    e = e.select("path", F.col("e.stationTriplet").alias("station"), "place", element.alias("d")).filter(F.col("d").isNotNull())
    last = e.groupBy("path", "station").agg(F.max(F.struct("place", F.col("d.values").alias("vs"))).alias("l"))
    v = last.select("path", "station", F.explode("l.vs").alias("v"))
    return v.select("path", "station", F.to_date("v.date").alias("day"), number(F.col("v.value")).alias("value")).filter("day IS NOT NULL AND value IS NOT NULL")

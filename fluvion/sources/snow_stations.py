"""Snow-station metadata and daily values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluvion.sources.documents import accepted, parse_json, refuse

STATIONS = "stations: array<struct<stationTriplet: string, name: string, huc: string, elevation: double, dataTimeZone: double, associatedHucs: array<string>>>"
DATA = (
    "stationTriplet: string, data: array<struct<stationElement: struct<elementCode: string, heightDepth: int>, "
    "values: array<struct<date: string, value: string, median: double, qcFlag: string>>>>"
)


def stations(docs: DataFrame) -> DataFrame:
    df = refuse(parse_json(docs, STATIONS), F.exists("doc.stations", lambda s: s["stationTriplet"].isNull()), "missing_triplet")
    s = accepted(df).select(F.explode("doc.stations").alias("s")).select("s.*")
    return s.select(
        F.col("stationTriplet").alias("station"), "name", F.substring("huc", 1, 8).alias("huc8"), "elevation", F.col("dataTimeZone").alias("utc_offset_h"),
        F.coalesce("associatedHucs", F.array().cast("array<string>")).alias("associated"),
    )


def values(docs: DataFrame) -> DataFrame:
    """Daily values of surface elements; a number that does not parse is absent."""
    from fluvion.functions.values import number

    df = accepted(refuse(parse_json(docs, DATA), F.col("doc.stationTriplet").isNull(), "missing_triplet"))
    e = df.select("doc.stationTriplet", F.explode("doc.data").alias("d")).filter(F.col("d.stationElement.heightDepth").isNull())
    v = e.select(F.col("stationTriplet").alias("station"), F.col("d.stationElement.elementCode").alias("element"), F.explode("d.values").alias("v"))
    return v.select("station", "element", F.to_date("v.date").alias("day"), number(F.col("v.value")).alias("value"), "v.median", F.col("v.qcFlag").alias("qc_flag"))

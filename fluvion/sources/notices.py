"""Text bulletins, alerts, reservoir XML, object listings, gazetteers and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluvion.functions.clocks import has_offset, parse_instant, vtec_time
from fluvion.functions.values import number
from fluvion.sources.documents import accepted, once, parse_json, refuse

# The line formats of the bulletins and listings.
WMO_LINE = r"(?m)^([A-Z]{4}\d{2}) ([A-Z]{4}) (\d{6})(?: ([A-Z]{3}))?\s*$"
PRODUCT_LINE = r"\A\n*([A-Z][A-Z0-9]{3,8})[ \t]*(?:\n|\z)"
UGC_LINE = r"(?m)^([A-Z]{2}[CZ]\d{3}(?:[->][A-Z0-9]{3,6})*-)\s*$"
PVTEC_LINE = r"(?m)^/[OTEX]\.([A-Z]{3})\.([A-Z]{4})\.([A-Z]{2})\.([A-Z])\.(\d{4})\.(\d{6}T\d{4}Z)-(\d{6}T\d{4}Z)/\s*$"
HVTEC_LINE = r"(?m)^/([A-Z0-9]{5})\.([0-3NU])\.([A-Z]{2})\.(\d{6}T\d{4}Z)\.(\d{6}T\d{4}Z)\.(\d{6}T\d{4}Z)\.([A-Z]{2})/\s*$"
FORECAST_BULLET = r"(?m)^[ \t]*(- Forecast[^\n]*(?:\n(?![ \t]*(?:- |\*|&&|\$\$|$))[^\n]*)*)"
FLOOD_LEVEL = r"\bFlood (?:stage|flow) is (\d[\d,]*(?:\.\d+)?)\s+(?:feet|cfs)\b"
OBSERVED = r"\bthe (?:stage|flow) was (\d[\d,]*(?:\.\d+)?)\s+(?:feet|cfs)\b"
MENTION = r"\b(?:to|of)\s+(?:a crest of\s+)?(\d[\d,]*(?:\.\d+)?)\s+(feet|cfs)\b"
TRANSMISSION_END = "\x01"
SEGMENT_END = r"(?m)^\s*\$\$\s*$"
REST = r"(?s:(.*))"
UNITS = {"feet": "ft", "cfs": "cfs"}
STAMP = r"(\d{8}-\d{6})"
NUMBER_TOKEN = r"\d[\d,]*(?:\.\d+)?"


def number_token(token: Column) -> Column:
    """'1,234.5' as a number."""
    return F.replace(token, F.lit(","), F.lit("")).try_cast("double")


def mention_values(text: Column) -> Column:
    """All 'to/of N feet|cfs' numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(1)), number_token)


def bulletins(docs: DataFrame) -> DataFrame:
    """Products of each transmission with their header; refused without a heading, without a product line
    right below it, or with several hydrologic event lines in one segment."""
    chunks = F.filter(F.split("content", TRANSMISSION_END), lambda c: F.length(F.trim(c)) > 0)
    p = docs.select("path", F.posexplode(chunks).alias("product_no", "text")).withColumn("refusal", F.lit(None).cast("string"))
    p = once(p, "text", F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("\x03"), F.lit("")))
    p = once(p, "wmo", F.nullif(F.regexp_extract("text", WMO_LINE, 3), F.lit("")))
    p = once(p, "pil", F.nullif(F.regexp_extract(F.regexp_extract("text", WMO_LINE + REST, 5), PRODUCT_LINE, 1), F.lit("")))
    p = once(p, "parts", F.split("text", SEGMENT_END))
    p = refuse(p, F.col("wmo").isNull(), "no_heading")
    p = refuse(p, F.col("pil").isNull(), "no_product_line")
    # what stands before the first zone line belongs to no segment; it is looked for only where two event lines are
    events = lambda s: F.coalesce(F.regexp_count(s, F.lit(HVTEC_LINE)), F.lit(0))
    return refuse(p, F.exists("parts", lambda s: (events(s) > 1) & (events(F.regexp_extract(s, UGC_LINE + REST, 2)) > 1)), "several_event_lines")


def segments(products: DataFrame) -> DataFrame:
    """Segments with all their event codes, flood level, observed value, the forecast bullet and its crest (largest number mentioned)."""
    s = accepted(products).select("path", "product_no", "wmo", "pil", F.posexplode("parts").alias("segment_no", "body"))
    s = once(s, "ugc", F.nullif(F.regexp_extract("body", UGC_LINE, 1), F.lit(""))).filter(F.col("ugc").isNotNull())
    s = once(s, "event", F.split(F.regexp_extract("body", HVTEC_LINE, 0), r"\."))
    h = lambda i: F.nullif(F.substring(F.get("event", F.lit(0)), 2, 5), F.lit("")) if i == 1 else F.get("event", F.lit(i - 1))
    s = once(s, "forecast_text", F.nullif(F.regexp_extract("body", FORECAST_BULLET, 1), F.lit("")))
    s = once(s, "mentions", mention_values(F.coalesce(F.col("forecast_text"), F.lit(""))))
    first = lambda pattern: number_token(F.nullif(F.regexp_extract("body", pattern, 1), F.lit("")))
    actions = F.regexp_extract_all("body", F.lit(PVTEC_LINE), F.lit(1))
    return s.select(
        "path", "product_no", "wmo", "pil", "segment_no", "ugc", h(1).alias("lid"), h(2).alias("severity"), vtec_time(h(5)).alias("crest_time"), vtec_time(h(4)).alias("begin_time"),
        actions.alias("actions"), first(FLOOD_LEVEL).alias("flood_stage"), first(OBSERVED).alias("observed"), "forecast_text", "mentions", F.array_max("mentions").alias("crest"),
    )


CAP = (
    "features: array<struct<properties: struct<id: string, event: string, status: string, messageType: string, sent: string, ends: string, expires: string, "
    "geocode: struct<UGC: array<string>>, references: array<struct<identifier: string>>>>>"
)


def alerts(docs: DataFrame) -> DataFrame:
    """Alert messages; an instant without an offset refuses the document."""
    df = refuse(parse_json(docs, CAP), F.col("doc.features").isNull(), "missing_features")
    df = refuse(df, F.exists("doc.features", lambda f: ~has_offset(f["properties"]["sent"])), "naive_instant")
    p = accepted(df).select(F.explode("doc.features").alias("f")).select("f.properties.*")
    return p.select(
        F.col("id").alias("alert_id"), "event", "status", F.col("messageType").alias("message_type"), parse_instant(F.col("sent")).alias("sent"),
        parse_instant(F.col("ends")).alias("ends"), parse_instant(F.col("expires")).alias("expires"), F.col("geocode.UGC").alias("ugc"),
        F.transform("references", lambda r: r["identifier"]).alias("references"),
    )


RESERVOIR = "SiteData struct<_id: string, observedValue: array<struct<_petype: string, _tsCode: string, dataDateTime: string, forebay: array<struct<_VALUE: double, _units: string>>>>>"


def reservoir_xml(docs: DataFrame) -> DataFrame:
    """Reservoir readings; ``docs`` carries the asked ``lid`` and ``pe``. One refusal per document."""
    df = once(docs, "x", F.from_xml("content", RESERVOIR)).withColumn("refusal", F.lit(None).cast("string"))
    rows = F.col("x.SiteData.observedValue")
    df = refuse(df, F.col("x.SiteData").isNull(), "no_site")
    df = refuse(df, ~F.col("x.SiteData._id").eqNullSafe(F.col("lid")), "wrong_site")
    df = refuse(df, F.exists(rows, lambda r: ~r["_petype"].eqNullSafe(F.col("pe"))), "wrong_element")
    df = refuse(df, F.exists(rows, lambda r: ~has_offset(r["dataDateTime"])), "naive_instant")
    df = refuse(df, F.exists(rows, lambda r: F.size(r["forebay"]) > 1), "duplicate_value")
    return refuse(df, F.exists(rows, lambda r: F.coalesce(F.size(r["forebay"]), F.lit(0)) < 1), "incomplete_row")


def reservoir_rows(parsed: DataFrame) -> DataFrame:
    r = accepted(parsed).select("lid", F.explode("x.SiteData.observedValue").alias("r"))
    v = F.get("r.forebay", F.lit(0))
    return r.select("lid", parse_instant(F.col("r.dataDateTime")).alias("valid_time"), F.col("r._tsCode").alias("code"), v["_VALUE"].alias("value"), v["_units"].alias("unit"))


LISTING = "Contents: array<struct<Key: string, LastModified: string, Size: bigint>>"


def listing_pages(docs: DataFrame) -> DataFrame:
    """Parsed listing pages; content that is not a listing, or holds an object without a key, is refused. A page may be empty."""
    parsed = once(docs, "page", F.from_xml("content", f"struct<{LISTING}>")).withColumn("refusal", F.lit(None).cast("string"))
    shaped = F.coalesce(F.col("content").rlike(r"(?s)<ListBucketResult\b.*(?:</ListBucketResult>|/>)\s*\z"), F.lit(False))
    parsed = refuse(parsed, F.col("page").isNull() | ~shaped, "malformed")
    return refuse(parsed, F.exists("page.Contents", lambda o: o["Key"].isNull()), "missing_key")


def listing(docs: DataFrame) -> DataFrame:
    """Objects of the listing pages that can be read: valid time out of the key, publication time from last-modified."""
    o = accepted(listing_pages(docs)).select(F.explode("page.Contents").alias("o"))
    stamp = F.nullif(F.regexp_extract("o.Key", STAMP, 1), F.lit(""))
    return o.select(
        F.col("o.Key").alias("key"), F.try_to_timestamp(stamp, F.lit("yyyyMMdd-HHmmss")).alias("valid_time"), parse_instant(F.col("o.LastModified")).alias("modified_at"), F.col("o.Size").alias("size_bytes")
    )


def gazetteer(docs: DataFrame) -> DataFrame:
    """Pipe-delimited names; the first occurrence of (name, class, county) wins, in file order."""
    lines = docs.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).filter(F.length("line") > 0)
    c = lambda i: F.get(F.split("line", r"\|", -1), F.lit(i))
    rows = lines.select("path", "pos", c(0).alias("name"), c(1).alias("feature_class"), c(2).alias("county"), number(c(3)).alias("lon"), number(c(4)).alias("lat"))
    first = F.row_number().over(W.partitionBy("name", "feature_class", "county").orderBy("path", "pos"))
    return rows.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


GEOMETRY = "features: array<struct<properties: struct<id: string>, geometry: struct<type: string, coordinates: string, geometries: array<struct<type: string, coordinates: string>>>>>"


def polygons(docs: DataFrame) -> DataFrame:
    """Rings of areal geometries as (basin, part, ring, pts); other geometry types are ignored."""
    f = accepted(parse_json(docs, GEOMETRY)).select(F.explode("doc.features").alias("f")).select("f.properties.id", "f.geometry")
    members = F.when(F.col("geometry.type") == "GeometryCollection", F.col("geometry.geometries")).otherwise(
        F.array(F.struct(F.col("geometry.type").alias("type"), F.col("geometry.coordinates").alias("coordinates")))
    )
    g = f.select("id", F.posexplode(members).alias("g", "m")).filter(F.col("m.type").isin("Polygon", "MultiPolygon"))
    text = F.when(F.col("m.type") == "Polygon", F.concat(F.lit("["), F.col("m.coordinates"), F.lit("]"))).otherwise(F.col("m.coordinates"))
    parts = g.select("id", "g", F.posexplode(F.from_json(text, "array<array<array<array<double>>>>")).alias("p", "rings"))
    rings = parts.select(F.col("id").alias("basin"), (F.col("g").cast("long") * (1 << 32) + F.col("p")).alias("part"), F.posexplode("rings").alias("ring", "xy"))
    return rings.withColumn("pts", F.transform("xy", lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y")))).drop("xy")


CURVES = "basins: array<struct<id: string, origin_m: double, counts_km2: array<double>, under_km2: double, over_km2: double, total_km2: double, min_m: double, max_m: double>>"
CURVE_FIELDS = ("origin_m", "counts_km2", "under_km2", "over_km2", "total_km2", "min_m", "max_m")


def elevation_curves(docs: DataFrame) -> DataFrame:
    """Elevation–area curves; a curve with a missing field is refused by name."""
    b = accepted(parse_json(docs, CURVES)).select(F.explode("doc.basins").alias("b")).select("b.*")
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in CURVE_FIELDS])
    return b.withColumn("refusal", F.when(missing.isNotNull(), F.concat(F.lit("missing:"), missing)))

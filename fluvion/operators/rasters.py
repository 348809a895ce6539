"""Packed rasters, windows of a grid, field selection, hypsometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
SENTINEL, MAX_RAW = 65535, 65534
BIN_M = 20.0
# how parcels of one slot become one
PARCEL = {"area": F.sum, "lo": F.min, "hi": F.max, "n": F.sum}


def quantise(value: Column, scale: float, invalid: Sequence[float] = ()) -> Column:
    """Packed 16-bit code; negative and invalid values become the sentinel, never a number."""
    ok = value >= 0
    for code in invalid:
        ok = ok & (value != code)
    raw = F.least(F.greatest(F.rint(value / scale), F.lit(0.0)), F.lit(float(MAX_RAW))).cast("int")
    return F.when(ok, raw).otherwise(F.lit(SENTINEL))


def cut_window(cells: DataFrame, nx: int, i0: int, i1: int, j0: int, j1: int, scale: float, invalid: Sequence[float] = ()) -> DataFrame:
    """Packed window per field, row-major; refused when the field does not cover it.

    The window has a fixed number of cells, so the array per field is bounded by it.
    """
    i, j = F.col("flat_index") % nx, F.floor(F.col("flat_index") / nx)
    need = (i1 - i0 + 1) * (j1 - j0 + 1)
    inside = cells.filter(i.between(i0, i1) & j.between(j0, j1)).withColumn("raw", quantise(F.col("value"), scale, invalid))
    fields = cells.select("field").distinct()
    g = inside.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("raw") != SENTINEL, F.col("value"))).alias("top"),
        F.transform(F.sort_array(F.collect_list(F.struct("flat_index", "raw"))), lambda c: c["raw"]).alias("cells"),
    )
    out = fields.join(g, "field", "left")
    whole = F.coalesce(F.col("n") == need, F.lit(False))
    return out.select(
        "field", F.when(whole, F.col("cells")).alias("cells"), F.when(whole, F.coalesce(F.round("top", 1), F.lit(0.0))).alias("max_value"),
        F.when(whole, "ok").otherwise("window_not_inside_grid").alias("reason"),
    )


def unpack(packed: DataFrame, scale: float, size: int) -> DataFrame:
    """Cells of packed rasters; a raster of another length is refused whole."""
    right = F.size("cells") == size
    rows = packed.filter(right).select("field", F.posexplode("cells").alias("pos", "raw"))
    return rows.select("field", "pos", F.when(F.col("raw") != SENTINEL, F.col("raw") * scale).alias("value"))


def select_fields(catalog: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each wanted field must exist exactly once."""
    n = catalog.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("field").alias("field"))
    j = wanted.join(n, list(keys), "left").fillna(0, ["n"])
    verdict = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return j.select(*keys, "n", F.when(F.col("n") == 1, F.col("field")).alias("field"), verdict.alias("verdict"))


def levels_present(catalog: DataFrame, by: Sequence[str], level: str) -> DataFrame:
    return catalog.groupBy(*by).agg(F.sort_array(F.collect_set(level)).alias("levels"))


def binned(pixels: DataFrame, origin_m: float, top_m: float) -> DataFrame:
    """Pixels (elevation, area) as parcels of one pixel: slot of the elevation, area, extremes and number."""
    n_bins = int((top_m - origin_m) / BIN_M)
    e = F.col("elevation")
    k = F.floor((e - origin_m) / BIN_M).cast("int")
    slot = F.when(e < origin_m, -1).when(k >= n_bins, n_bins).otherwise(k)
    return pixels.withColumns({"slot": slot, "lo": e, "hi": e, "n": F.lit(1).cast("long")}).drop("elevation")


def hypsometry(pixels: DataFrame, origin_m: float, top_m: float) -> DataFrame:
    """Area per elevation bin with the area below, above and the extremes.

    ``pixels``: basin, elevation, area (one row per pixel and basin), or parcels of ``binned`` pixels with the same bins. Bins are few and fixed, so
    the per-basin map of bin → area is bounded.
    """
    n_bins = int((top_m - origin_m) / BIN_M)
    parcels = pixels if "slot" in pixels.columns else binned(pixels, origin_m, top_m)
    per = parcels.groupBy("basin", "slot").agg(*[f(c).alias(c) for c, f in PARCEL.items()])
    g = per.groupBy("basin").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "area"))).alias("m"), F.sum("area").alias("total"),
        F.min("lo").alias("min_m"), F.max("hi").alias("max_m"), F.sum("n").alias("n_pixels"),
    )
    at = lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0.0))
    return g.select(
        "basin", F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), at).alias("counts"), at(F.lit(-1)).alias("under"), at(F.lit(n_bins)).alias("over"),
        "total", "min_m", "max_m", "n_pixels", F.lit(origin_m).alias("origin_m"),
    )


def fraction_below(elevation: Column) -> Column:
    """Share of the area at or below an elevation, from the hypsometry columns of the same row."""
    span = elevation - F.col("origin_m")
    full = F.floor(span / BIN_M).cast("int")
    upto = lambda n: F.aggregate(F.slice("counts", 1, n), F.lit(0.0), lambda a, x: a + x)
    low = F.when(elevation >= F.col("min_m"), F.col("under")).otherwise(0.0) / F.col("total")
    beyond = F.when(elevation >= F.col("max_m"), F.lit(1.0)).otherwise((F.col("under") + upto(F.size("counts"))) / F.col("total"))
    within = F.least(F.lit(1.0), (F.col("under") + upto(F.greatest(full, F.lit(0))) + F.get("counts", full) * (span - full * BIN_M) / BIN_M) / F.col("total"))
    return F.when(elevation.isNull() | F.col("total").isNull() | (F.col("total") <= 0), F.lit(None).cast("double")).when(span <= 0, low).when(full >= F.size("counts"), beyond).otherwise(within)

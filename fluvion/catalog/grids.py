"""Gridded fields: selection, packing, zonal statistics, masks, hypsometry."""

from pyspark.sql import functions as F

from fluvion.catalog.joins import RING_SQL, rings
from fluvion.catalog.registry import query
from fluvion.operators import joins, masks, rasters, zonal


def field_catalog(t):
    """One row per stored field of a cycle (a month here)."""
    return t.lineitem().select(
        F.trunc("day", "month").alias("cycle"), F.col("l_returnflag").alias("parameter"), F.round(F.col("l_discount") * 100).cast("int").alias("percentile"),
        (F.col("l_linenumber") * 12).alias("hours"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("field"),
    )


CAT_SQL = """(SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS cycle, l_returnflag AS parameter, CAST(round(l_discount * 100) AS INTEGER) AS percentile, l_linenumber * 12 AS hours FROM lineitem)"""


@query(
    "A19_field_selection",
    f"""WITH c AS {CAT_SQL}, w AS (SELECT cycle, p AS percentile, h AS hours FROM (SELECT DISTINCT cycle FROM c), (VALUES (1), (5), (10)) AS x(p), (VALUES (24), (72)) AS y(h)), n AS (SELECT cycle, percentile, hours, count(*) AS n FROM c WHERE parameter = 'R' GROUP BY ALL)
      SELECT CAST(w.cycle AS VARCHAR) AS cycle, w.percentile, w.hours, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS verdict FROM w LEFT JOIN n USING (cycle, percentile, hours)""",
)
def a19(t):
    c = field_catalog(t)
    each = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    wanted = c.select("cycle").distinct().withColumn("percentile", each((1, 5, 10))).withColumn("hours", each((24, 72)))
    return rasters.select_fields(c.filter("parameter = 'R'"), wanted, ["cycle", "percentile", "hours"]).drop("field")


@query(
    "A20_levels_present",
    f"""SELECT CAST(cycle AS VARCHAR) AS cycle, hours, array_to_string(list_sort(list(DISTINCT percentile)), '|') AS levels FROM {CAT_SQL} WHERE parameter = 'A' GROUP BY ALL""",
)
def a20(t):
    return rasters.levels_present(field_catalog(t).filter("parameter = 'A'"), ["cycle", "hours"], "percentile")


WINDOW_SQL = """(SELECT field, flat_index, value, CASE WHEN value >= 0 AND value <> 100 THEN CAST(least(greatest(round_even(value / 10, 0), 0), 65534) AS INTEGER) ELSE 65535 END AS raw FROM b_cell
  WHERE flat_index % 8 BETWEEN 2 AND 5 AND flat_index // 8 BETWEEN 1 AND 6 AND NOT (field % 9 = 0 AND flat_index >= 40))"""


def windows(t):
    covered = t.grid_cells().filter(~((F.col("field") % 9 == 0) & (F.col("flat_index") >= 40)))
    return rasters.cut_window(covered, 8, 2, 5, 1, 6, 10.0, (100.0,))


@query(
    "B11_window_cut",
    f"""SELECT f.field, CASE WHEN count(raw) = 24 THEN string_agg(CAST(raw AS VARCHAR), '|' ORDER BY flat_index) ELSE '' END AS cells, CASE WHEN count(raw) = 24 THEN coalesce(max(CASE WHEN raw <> 65535 THEN value END), 0) END AS max_value,
      CASE WHEN count(raw) = 24 THEN 'ok' ELSE 'window_not_inside_grid' END AS reason FROM (SELECT DISTINCT field FROM b_cell) f LEFT JOIN {WINDOW_SQL} w USING (field) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY f.field"),
)
def b11(t):
    return windows(t)


@query(
    "A24_raster_unpack",
    f"""SELECT field, CAST(row_number() OVER (PARTITION BY field ORDER BY flat_index) - 1 AS INTEGER) AS pos, CASE WHEN raw <> 65535 THEN raw * 10.0::DOUBLE END AS value FROM {WINDOW_SQL} WHERE field % 9 <> 0""",
)
def a24(t):
    return rasters.unpack(windows(t), 10.0, 24)


@query(
    "E9_strict_zonal_mean",
    """WITH g AS (SELECT field, basin, count(*) AS met, count_if(value < -400) AS bad, sum(value * weight) AS total FROM b_gap JOIN b_mask USING (flat_index) GROUP BY ALL)
      SELECT field, basin, n AS cell_count, bad + n - met AS missing_cells, round(CASE WHEN bad + n - met = 0 THEN total / w END, 6) AS value, CASE WHEN bad + n - met > 0 THEN 'missing_values' ELSE 'ok' END AS reason FROM g JOIN b_masktotal USING (basin)""",
)
def e9(t):
    return zonal.strict_mean(t.delivered_cells(), t.mask(), None, F.col("value") < -400)


CODED_SQL = "(SELECT field, flat_index, CASE WHEN value < -330 THEN -3.0 WHEN value < -300 THEN -1.0 ELSE abs(value) END::DOUBLE AS value FROM b_gap)"


@query(
    "E10_radar_zonal",
    f"""WITH g AS (SELECT field, basin, any_value(n) AS cell_count, any_value(w) AS ws, coalesce(sum(CASE WHEN value >= 0 THEN weight END), 0) AS wv, coalesce(sum(CASE WHEN value = -3 THEN weight END), 0) AS wn, coalesce(sum(CASE WHEN value = -1 THEN weight END), 0) AS wm,
        sum(CASE WHEN value >= 0 THEN value * weight END) AS tot, max(CASE WHEN value >= 0 THEN value END) AS top FROM {CODED_SQL} JOIN b_mask USING (flat_index) JOIN b_masktotal USING (basin) GROUP BY field, basin)
      SELECT field, basin, cell_count, round(wv / ws, 6) AS valid_fraction, round(wn / ws, 6) AS no_coverage_fraction, round(wm / ws, 6) AS missing_fraction, round(CASE WHEN wv / ws >= 0.995 THEN tot / wv END, 6) AS mean, CASE WHEN wv / ws >= 0.995 THEN top END AS max,
        concat_ws('|', CASE WHEN wv / ws < 0.995 THEN 'insufficient_radar_coverage' END, CASE WHEN wn > 0 THEN 'radar_no_coverage_cells' END, CASE WHEN wm > 0 THEN 'missing_cells' END) AS flags FROM g""",
)
def e10(t):
    v = F.col("value")
    coded = t.delivered_cells().withColumn("value", F.when(v < -330, F.lit(-3.0)).when(v < -300, F.lit(-1.0)).otherwise(F.abs(v)))
    return zonal.radar_stats(coded, t.mask())


SNOW_SQL = "(SELECT field, flat_index, CASE WHEN value < -330 THEN -9999.0 WHEN value < -300 THEN -7.0 WHEN value > 330 THEN 32767.0 WHEN value < -100 THEN 0.0 ELSE abs(value) END::DOUBLE AS value FROM b_gap)"


@query(
    "E11_snow_zonal",
    f"""WITH g AS (SELECT field, basin, any_value(n) AS cell_count, any_value(w) AS ws, coalesce(sum(CASE WHEN value >= 0 AND value <> 32767 THEN weight END), 0) AS wv, coalesce(sum(CASE WHEN value = -9999 THEN weight END), 0) AS ww, coalesce(sum(CASE WHEN value = 32767 THEN weight END), 0) AS wt,
        coalesce(sum(CASE WHEN value = -7 THEN weight END), 0) AS wc, sum(CASE WHEN value >= 0 AND value <> 32767 THEN value * weight END) AS tot, max(CASE WHEN value <> 32767 THEN value END) AS top, coalesce(sum(CASE WHEN value > 0 AND value <> 32767 THEN weight END), 0) AS wsnow FROM {SNOW_SQL} JOIN b_mask USING (flat_index) JOIN b_masktotal USING (basin) GROUP BY field, basin)
      SELECT field, basin, cell_count, round(wv / ws, 6) AS valid_fraction, round(ww / ws, 6) AS water_fraction, round(wt / ws, 6) AS saturated_fraction, round(wc / ws, 6) AS corrupt_fraction, round(CASE WHEN wv / ws >= 0.93 THEN tot / wv END, 6) AS mean, CASE WHEN wv / ws >= 0.93 THEN top END AS max,
        round(CASE WHEN wv / ws >= 0.93 THEN wsnow / wv END, 6) AS snow_covered_fraction, concat_ws('|', CASE WHEN wv / ws < 0.93 THEN 'insufficient_grid_coverage' END, CASE WHEN ww > 0 THEN 'static_water_cells_present' END, CASE WHEN wt > 0 THEN 'swe_saturated_cells_excluded' END, CASE WHEN wc > 0 THEN 'negative_non_sentinel_cells_excluded' END) AS flags FROM g""",
)
def e11(t):
    return zonal.snow_stats(t.delivered_cells().withColumn("value", snow_coded()), t.mask())


def snow_coded():
    v = F.col("value")
    return F.when(v < -330, F.lit(-9999.0)).when(v < -300, F.lit(-7.0)).when(v > 330, F.lit(32767.0)).when(v < -100, F.lit(0.0)).otherwise(F.abs(v))


RAIN_SQL = "(SELECT field, flat_index, CASE WHEN value < -350 THEN 9999.0 WHEN value BETWEEN -200 AND -150 THEN -0.05 ELSE abs(value) END::DOUBLE AS value FROM b_gap)"


@query(
    "E12_forecast_zonal",
    f"""WITH g AS (SELECT field, basin, any_value(n) AS cell_count, any_value(w) AS ws, sum(CASE WHEN value < 9998 THEN weight END) AS wv, count_if(value < 0) AS neg, sum(CASE WHEN value < 9998 THEN greatest(value, 0) * weight END) AS tot, max(CASE WHEN value < 9998 THEN greatest(value, 0) END) AS top FROM {RAIN_SQL} JOIN b_mask USING (flat_index) JOIN b_masktotal USING (basin) GROUP BY field, basin)
      SELECT field, basin, cell_count, round(wv / ws, 6) AS valid_fraction, round(1 - wv / ws, 6) AS missing_fraction, neg AS negative_clamped_cells, round(CASE WHEN wv / ws >= 0.995 THEN tot / wv END, 6) AS mean, CASE WHEN wv / ws >= 0.995 THEN top END AS max,
        concat_ws('|', CASE WHEN wv / ws < 0.995 THEN 'insufficient_grid_coverage' END, CASE WHEN 1 - wv / ws > 1e-6 THEN 'missing_cells' END, CASE WHEN neg > 0 THEN 'jpeg_negative_clamped' END) AS flags FROM g""",
)
def e12(t):
    return zonal.forecast_stats(t.delivered_cells().withColumn("value", rain_coded()), t.mask())


def rain_coded():
    v = F.col("value")
    return F.when(v < -350, F.lit(9999.0)).when(v.between(-200, -150), F.lit(-0.05)).otherwise(F.abs(v))


PIX_SQL = """(SELECT field || ':' || flat_index AS pid, (field * 8 % 480) + flat_index % 8 + 0.5::DOUBLE AS x, (flat_index // 8) * 2.5 + 0.25::DOUBLE AS y, value AS elevation, 1 + (flat_index // 8) * 0.25::DOUBLE AS area FROM b_cell)"""
QUAD_SQL = f"""(SELECT ring_id, e, cx + [-9.5, 8.0, 11.0, -4.0][e + 1] AS x1, cy + [-1.0, -2.75, 1.5, 2.875][e + 1] AS y1, cx + [8.0, 11.0, -4.0, -9.5][e + 1] AS x2, cy + [-2.75, 1.5, 2.875, -1.0][e + 1] AS y2 FROM {RING_SQL})"""
INSIDE_SQL = f"(SELECT ring_id AS basin, pid, any_value(elevation) AS elevation, any_value(area) AS area FROM {PIX_SQL} p JOIN {QUAD_SQL} v ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"


def pixels(t, origin_m=0.0, top_m=300.0, basins=None):
    """Parcels of each basin's pixels, by elevation slot; with ``basins`` (ring_id) only theirs."""
    f, k = F.col("field"), F.col("flat_index")
    row = F.floor(k / 8)
    p = t.grid_cells().select(
        F.concat_ws(":", f, k).alias("pid"), ((f * 8 % 480) + k % 8 + F.lit(0.5)).alias("x"), (row * 2.5 + F.lit(0.25)).alias("y"),
        F.col("value").alias("elevation"), (F.lit(1) + row * 0.25).alias("area"),
    )
    r = rings(t) if basins is None else rings(t).join(basins, "ring_id", "left_semi")
    p = rasters.binned(p, origin_m, top_m)
    return joins.points_in_rings(p, r, "pid", "ring_id", cell=2.0, carry=("slot", *rasters.PARCEL), merged=rasters.PARCEL).withColumnRenamed("ring_id", "basin")


@query(
    "E18_hypsometry",
    f"""SELECT basin, count(*) AS n_pixels, sum(area) AS total, coalesce(sum(CASE WHEN elevation < 0 THEN area END), 0) AS under, coalesce(sum(CASE WHEN elevation >= 300 THEN area END), 0) AS "over", coalesce(sum(CASE WHEN elevation >= 40 AND elevation < 60 THEN area END), 0) AS bin2, min(elevation) AS min_m, max(elevation) AS max_m FROM {INSIDE_SQL} GROUP BY ALL""",
)
def e18(t):
    h = rasters.hypsometry(pixels(t), 0.0, 300.0)
    return h.select("basin", "n_pixels", "total", "under", "over", F.get("counts", F.lit(2)).alias("bin2"), "min_m", "max_m")


@query(
    "E19_fraction_below",
    f"""WITH p AS {INSIDE_SQL}, q AS (SELECT s_suppkey AS basin, s_acctbal / 20 AS e FROM supplier), g AS (SELECT basin, sum(area) AS total, min(elevation) AS lo, max(elevation) AS hi, coalesce(sum(CASE WHEN elevation < 0 THEN area END), 0) AS under, coalesce(sum(CASE WHEN elevation < 300 THEN area END), 0) AS below_top FROM p GROUP BY ALL),
      x AS (SELECT q.basin, q.e, g.*, coalesce(sum(CASE WHEN p.elevation < floor(q.e / 20) * 20 THEN p.area END), 0) AS full_area, coalesce(sum(CASE WHEN p.elevation >= floor(q.e / 20) * 20 AND p.elevation < floor(q.e / 20) * 20 + 20 THEN p.area END), 0) AS part FROM q JOIN g ON g.basin = q.basin JOIN p ON p.basin = q.basin GROUP BY ALL)
      SELECT q_basin AS basin, round(CASE WHEN e <= 0 THEN CASE WHEN e >= lo THEN under ELSE 0 END / total WHEN e >= 300 THEN CASE WHEN e >= hi THEN 1 ELSE below_top / total END ELSE least(1, (full_area + part * (e - floor(e / 20) * 20) / 20) / total) END, 6) AS fraction FROM (SELECT basin AS q_basin, * EXCLUDE (basin, basin_1) FROM x)""".replace("SELECT q.basin, q.e, g.*,", "SELECT q.basin, q.e, g.total, g.lo, g.hi, g.under, g.below_top,").replace("(SELECT basin AS q_basin, * EXCLUDE (basin, basin_1) FROM x)", "(SELECT basin AS q_basin, * FROM x)"),
)
def e19(t):
    q = t.stations().select(F.col("station").alias("basin"), (F.col("elevation") / 20).alias("e"))
    h = rasters.hypsometry(pixels(t), 0.0, 300.0).join(q, "basin")
    return h.select("basin", rasters.fraction_below(F.col("e")).alias("fraction"))


def box_rings(t):
    """A box with a rectangular hole per supplier, off the cell lines of a 100 x 50 grid."""
    k = F.col("s_suppkey")
    x, y = (k * 13 % 80).cast("double") + 0.25, (k * 7 % 30).cast("double") + 0.125
    w, h = 6.5 + (k % 5).cast("double"), 4.25 + (k % 3).cast("double")
    box = lambda a, b, c, d: F.array(*[F.struct(u.alias("x"), v.alias("y")) for u, v in ((a, b), (c, b), (c, d), (a, d))])
    part = F.explode(F.array(
        F.struct(F.lit(0).alias("ring"), box(x, y, x + w, y + h).alias("pts")),
        F.struct(F.lit(1).alias("ring"), box(x + 1.75, y + 1.5, x + 3.5, y + 2.75).alias("pts")),
    ))
    return t.read("supplier").select(k.alias("basin"), F.lit(0).alias("part"), part.alias("r")).select("basin", "part", "r.ring", "r.pts")


BOX_SQL = """(SELECT s_suppkey AS basin, (s_suppkey * 13 % 80) + 0.25::DOUBLE AS x, (s_suppkey * 7 % 30) + 0.125::DOUBLE AS y, 6.5 + (s_suppkey % 5)::DOUBLE AS w, 4.25 + (s_suppkey % 3)::DOUBLE AS h FROM supplier)"""
OV = lambda a, b, k: f"greatest(0, least({b}, {k} + 0.5) - greatest({a}, {k} - 0.5))"
COVER_SQL = f"""(SELECT basin, j * 100 + i AS flat_index, i, j, {OV('x', 'x + w', 'i')} * {OV('y', 'y + h', 'j')} - {OV('x + 1.75', 'x + 3.5', 'i')} * {OV('y + 1.5', 'y + 2.75', 'j')} AS weight
  FROM {BOX_SQL}, range(0, 100) AS a(i), range(0, 50) AS b(j) WHERE {OV('x', 'x + w', 'i')} * {OV('y', 'y + h', 'j')} - {OV('x + 1.75', 'x + 3.5', 'i')} * {OV('y + 1.5', 'y + 2.75', 'j')} > 1e-6)"""


@query("M1_polygon_coverage", f"SELECT basin, CAST(flat_index AS INTEGER) AS flat_index, round(weight, 6) AS weight FROM {COVER_SQL}")
def m1(t):
    return masks.coverage(box_rings(t), 100).select("basin", "flat_index", "weight")


@query(
    "M1_slanted_coverage",
    f"""SELECT ring_id AS basin, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area FROM {QUAD_SQL} GROUP BY ALL""",
)
def m1b(t):
    slanted = rings(t).select(F.col("ring_id").alias("basin"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("ring").alias("pts"))
    return masks.coverage(slanted, 600).groupBy("basin").agg(F.sum("weight").alias("area"))


@query(
    "M1_outside_grid",
    f"""SELECT basin, CASE WHEN x + w > 79.5 OR y + h > 34.5 THEN 'basin_outside_grid' ELSE 'ok' END AS verdict FROM {BOX_SQL}""",
)
def m1c(t):
    return masks.outside_grid(box_rings(t), 80, 35).select("basin", "verdict")


@query(
    "M2_masks_to_build",
    """WITH w AS (SELECT DISTINCT b AS basin, label AS grid_hash FROM embeddings, range(6) AS r(b)) SELECT basin, grid_hash FROM w ANTI JOIN (SELECT DISTINCT vec_id % 6 AS basin, label AS grid_hash FROM embeddings WHERE vec_id % 6 <> label % 6) s USING (basin, grid_hash)""",
)
def m2(t):
    e = t.read("embeddings")
    wanted = e.select(F.col("label").alias("grid_hash")).distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("basin"), "grid_hash")
    stored = e.filter("vec_id % 6 <> label % 6").select((F.col("vec_id") % 6).alias("basin"), F.col("label").alias("grid_hash"))
    return masks.masks_to_build(wanted, stored)


@query(
    "M3_masked_area",
    f"""SELECT basin, count(*) AS n_cells, round(sum(weight * 30.9 * cos(radians(50 - j * 0.05::DOUBLE))), 6) AS area_km2 FROM {COVER_SQL} GROUP BY ALL""",
)
def m3(t):
    area = F.lit(30.9) * F.cos(F.radians(F.lit(50) - F.col("j") * 0.05))
    return masks.masked_area(masks.coverage(box_rings(t), 100), area)

"""Exact fractional coverage of polygons on a grid, by signed-area accumulation.

In grid coordinates a cell (i, j) is the unit square [i - 0.5, i + 0.5] x [j - 0.5, j + 0.5]. Every
edge is cut at the row lines and then at the column lines; each piece adds its height to all cells
to the right of it in its row (cover) and a trapezoid to its own cell (area). Summing along a row
gives the covered fraction of every cell. Pieces are rows of a DataFrame, so the work is spread
over edges and rows, not over polygons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluvion.operators.geometry import signed_area

# Fixed values.
MIN_WEIGHT = 1e-6


def edges(rings: DataFrame) -> DataFrame:
    """Directed edges in cell units: outer rings positive, holes negative, whatever their winding.

    ``rings``: basin, part, ring (0 = outer), pts array<struct<x, y>> in fractional grid indices.
    """
    area = signed_area(F.col("pts"))
    sign = F.when(F.col("ring") == 0, F.signum(area)).otherwise(-F.signum(area))
    nxt = lambda i: F.get("pts", F.pmod(i + 1, F.size("pts")))
    e = F.transform("pts", lambda p, i: F.struct((p["x"] + 0.5).alias("x1"), (p["y"] + 0.5).alias("y1"), (nxt(i)["x"] + 0.5).alias("x2"), (nxt(i)["y"] + 0.5).alias("y2")))
    return rings.select("basin", sign.alias("sign"), F.explode(e).alias("e")).select("basin", "sign", "e.*").filter("y1 <> y2")


def _cut(df: DataFrame, axis: str, cell: str) -> DataFrame:
    """Cut pieces at the integer lines of one axis; ``cell`` receives the index of each part."""
    other = "y" if axis == "x" else "x"
    a1, a2, b1, b2 = F.col(f"{axis}1"), F.col(f"{axis}2"), F.col(f"{other}1"), F.col(f"{other}2")
    lo, hi = F.least(a1, a2), F.greatest(a1, a2)
    first = F.floor(lo).cast("int")
    last = F.greatest(first, (F.ceil(hi) - 1).cast("int"))
    parts = df.withColumn(cell, F.explode(F.sequence(first, last)))
    clip = lambda v: F.least(F.greatest(v, F.col(cell).cast("double")), F.col(cell) + 1.0)
    at = lambda a: F.when(a1 == a2, b1).otherwise(b1 + (b2 - b1) * (a - a1) / (a2 - a1))
    n1, n2 = clip(a1), clip(a2)
    return parts.select(
        "basin", "sign", *[c for c in ("j",) if c in df.columns], cell,
        n1.alias(f"{axis}1"), n2.alias(f"{axis}2"),
        F.when(a1 == a2, b1).otherwise(at(n1)).alias(f"{other}1"), F.when(a1 == a2, b2).otherwise(at(n2)).alias(f"{other}2"),
    )


def coverage(rings: DataFrame, nx: int) -> DataFrame:
    """Sparse weights (basin, flat_index, i, j, weight) of every polygon."""
    rows = _cut(edges(rings), "y", "j")
    pieces = _cut(rows, "x", "i")
    dy = (F.col("y2") - F.col("y1")) * F.col("sign")
    own = dy * (F.col("i") + 1.0 - (F.col("x1") + F.col("x2")) / 2.0)
    cells = pieces.groupBy("basin", "j", "i").agg(F.sum(own).alias("own"), F.sum(dy).alias("dy"))
    w = W.partitionBy("basin", "j").orderBy("i")
    before = F.coalesce(F.sum("dy").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    swept = cells.withColumn("before", before).withColumn("next_i", F.lead("i").over(w))
    touched = swept.select("basin", "j", "i", (F.col("before") + F.col("own")).alias("weight"))
    inner = swept.filter((F.col("next_i") > F.col("i") + 1) & (F.abs(F.col("before") + F.col("dy")) > MIN_WEIGHT)).select(
        "basin", "j", F.explode(F.sequence(F.col("i") + 1, F.col("next_i") - 1)).alias("i"), (F.col("before") + F.col("dy")).alias("weight")
    )
    # both axes carry the same sign convention; the orientation makes covered cells positive or negative as one
    return (
        touched.unionByName(inner)
        .withColumn("weight", F.least(F.abs("weight"), F.lit(1.0)))
        .filter(F.col("weight") > MIN_WEIGHT)
        .select("basin", (F.col("j") * nx + F.col("i")).alias("flat_index"), "i", "j", "weight")
    )


def polygon_overlaps(left: DataFrame, right: DataFrame, tile: float, cell_km2: float, minimum_km2: float) -> DataFrame:
    """(left, right, overlap_km2, of_left, of_right): exact shared area of the polygons of two ring tables.

    A polygon is the signed sum of the regions to the left of its edges, so the shared area is the sum,
    over pairs of edges, of the area to the left of both. Polygons whose boxes share a ``tile`` and
    overlap are candidates; their edges, cut into rows of one unit, meet by row. Concave polygons, holes and
    several parts need no special case. Pairs below the minimum are left out.
    """
    lo, hi = (lambda c: F.least(f"{c}1", f"{c}2")), (lambda c: F.greatest(f"{c}1", f"{c}2"))
    cut = {}
    shape = {}
    for side, rings in (("l", left), ("r", right)):
        e = edges(rings)
        moment = F.col("sign") * (F.col("y2") - F.col("y1")) * (F.col("x1") + F.col("x2")) / 2.0
        shape[side] = e.groupBy(F.col("basin").alias(side)).agg(
            F.min(lo("x")).alias(f"{side}w"), F.max(hi("x")).alias(f"{side}e"), F.min(lo("y")).alias(f"{side}s"), F.max(hi("y")).alias(f"{side}n"), F.abs(F.sum(moment)).alias(f"{side}_area")
        )
        cut[side] = _cut(e, "y", "j").select(F.col("basin").alias(side), "j", (F.col("sign") * F.signum(F.col("y2") - F.col("y1"))).alias(f"{side}_sign"),
            *[F.when(F.col("y2") > F.col("y1"), F.col(a)).otherwise(F.col(b)).alias(f"{side}_{name}") for name, a, b in (("x1", "x1", "x2"), ("y1", "y1", "y2"), ("x2", "x2", "x1"), ("y2", "y2", "y1"))])
    tiles = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile)))
    on_tiles = {s: shape[s].withColumn("_tx", tiles(f"{s}w", f"{s}e")).withColumn("_ty", tiles(f"{s}s", f"{s}n")) for s in shape}
    boxes = (F.col("lw") < F.col("re")) & (F.col("rw") < F.col("le")) & (F.col("ls") < F.col("rn")) & (F.col("rs") < F.col("ln"))
    # the first tile that two boxes share stands for all of them
    first = (F.col("_tx") == F.floor(F.greatest("lw", "rw") / tile)) & (F.col("_ty") == F.floor(F.greatest("ls", "rs") / tile))
    pairs = on_tiles["l"].join(on_tiles["r"], ["_tx", "_ty"]).filter(boxes & first).select("l", "r", "l_area", "r_area")
    met = cut["l"].join(pairs, "l").join(cut["r"], ["r", "j"])
    y0, y1 = F.greatest("l_y1", "r_y1"), F.least("l_y2", "r_y2")
    at = lambda s, y: F.col(f"{s}_x1") + (F.col(f"{s}_x2") - F.col(f"{s}_x1")) * (y - F.col(f"{s}_y1")) / (F.col(f"{s}_y2") - F.col(f"{s}_y1"))
    d0, d1 = at("l", y0) - at("r", y0), at("l", y1) - at("r", y1)
    # mean distance of the two edges; where they cross, of the two triangles
    apart = F.when(d0 * d1 >= 0, (F.abs(d0) + F.abs(d1)) / 2).otherwise((d0 * d0 + d1 * d1) / (2 * (F.abs(d0) + F.abs(d1))))
    nearer = (at("l", y0) + at("l", y1) + at("r", y0) + at("r", y1)) / 4 - apart / 2
    part = F.col("l_sign") * F.col("r_sign") * (y1 - y0) * nearer
    shared = met.filter(y0 < y1).groupBy("l", "r").agg(F.abs(F.sum(part)).alias("shared"), F.first("l_area").alias("l_area"), F.first("r_area").alias("r_area"))
    return shared.filter(F.col("shared") * cell_km2 >= minimum_km2).select(
        F.col("l").alias("left"), F.col("r").alias("right"), (F.col("shared") * cell_km2).alias("overlap_km2"),
        (F.col("shared") / F.col("l_area")).alias("of_left"), (F.col("shared") / F.col("r_area")).alias("of_right"),
    )


def outside_grid(rings: DataFrame, nx: int, ny: int) -> DataFrame:
    """Polygons that leave the grid: refused, because clamping would smear area onto the edge."""
    x, y = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    g = rings.groupBy("basin").agg(
        F.min(F.array_min(x)).alias("lo_i"), F.max(F.array_max(x)).alias("hi_i"), F.min(F.array_min(y)).alias("lo_j"), F.max(F.array_max(y)).alias("hi_j")
    )
    bad = (F.col("lo_i") < -0.5) | (F.col("lo_j") < -0.5) | (F.col("hi_i") > nx - 0.5) | (F.col("hi_j") > ny - 0.5)
    return g.withColumn("verdict", F.when(bad, "basin_outside_grid").otherwise("ok"))


def masks_to_build(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(basin, grid) pairs without a stored mask."""
    return wanted.join(stored.select("basin", "grid_hash").distinct(), ["basin", "grid_hash"], "left_anti")


def masked_area(mask: DataFrame, cell_area_km2: Column) -> DataFrame:
    return mask.groupBy("basin").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(F.col("weight") * cell_area_km2).alias("area_km2"))

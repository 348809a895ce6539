"""Time and space joins expressed as equi joins on buckets plus an exact filter."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluvion.functions import geo
from fluvion.functions.clocks import hours_between, plus_hours

HOUR_US = 3_600_000_000
#: edges of a ring that a point is tested against at once
PACKET = 4
#: blocks of points that are merged: cuts of a grid cell each way (a power of two), points of a block, and what marks a block that an edge may divide
CUTS, BLOCK, DIVIDED = 8, 2048, 1000
#: parts of a grid cell, each way, in which segments too far to be nearest are left out
FINE = 4


def latest_at_grid(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    start: str,
    end: str,
    step_h: int,
    lookback_h: float,
) -> DataFrame:
    """As-of join of every key against a regular grid of knowledge times.

    A row becomes visible at the first grid instant at or after its ``available_at`` and stays the
    newest until a larger (``order``) row becomes visible. Rows are first reduced map-side to one
    per (key, grid slot), so the later window holds slots, never raw rows, however hot a key is;
    each slot then fills the grid up to the next one without any range join.
    Requires ``available_at >= order[0]`` (the valid time), which knowledge times guarantee.
    """
    t0, t1 = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    n_slots = F.floor(hours_between(t1, t0) / step_h).cast("int")
    slot = F.greatest(F.lit(0), F.ceil(hours_between(F.col("available_at"), t0) / step_h).cast("int"))
    best = F.max(F.struct(*order, *[c for c in payload if c not in order])).alias("best")
    # plain bounds on both clocks, so that a scan can skip what no grid instant sees
    near = (F.col("available_at") <= t1) & (F.col(order[0]) >= plus_hours(t0, -lookback_h))
    slots = rows.filter(near).withColumn("slot", slot).filter(F.col("slot") <= n_slots).groupBy(*keys, "slot").agg(best)
    w = W.partitionBy(*keys).orderBy("slot")
    running = slots.withColumn("best", F.max("best").over(w)).withColumn(
        "until", F.coalesce(F.lead("slot").over(w) - 1, n_slots)
    )
    filled = running.select(*keys, F.explode(F.sequence("slot", "until")).alias("slot"), "best")
    as_of = plus_hours(t0, F.col("slot") * step_h)
    return (
        filled.withColumn("as_of", as_of)
        .filter(hours_between(F.col("as_of"), F.col(f"best.{order[0]}")) <= lookback_h)
        .select("as_of", *keys, *[F.col(f"best.{c}").alias(c) for c in dict.fromkeys([*order, *payload])])
    )


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    target: str,
    instant: str,
    payload: Sequence[str],
    tolerance_h: float,
    left_id: Sequence[str],
) -> DataFrame:
    """Nearest right row within the tolerance, earlier instant on ties; unmatched left rows stay.

    Both sides meet on time buckets as wide as the tolerance: the target looks at its own bucket
    and its two neighbours, the right side sits in one. No interpolation.
    """
    width = float(round(tolerance_h * HOUR_US))
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(width)).cast("long")
    probes = left.select(*left_id, *[k for k in keys if k not in left_id], target).withColumn(
        "_b", F.explode(F.array(*[bucket(F.col(target)) + d for d in (-1, 0, 1)]))
    )
    stored = right.select(*keys, F.col(instant).alias("_t"), *[c for c in payload if c != instant]).withColumn("_b", bucket(F.col("_t")))
    gap = F.abs(hours_between(F.col("_t"), F.col(target)))
    hits = probes.join(stored, [*keys, "_b"]).withColumn("_gap", gap).filter(F.col("_gap") <= tolerance_h)
    chosen = hits.groupBy(*left_id).agg(
        F.min(F.struct("_gap", "_t", *[c for c in payload if c != instant])).alias("_best")
    )
    out = left.join(chosen, list(left_id), "left")
    return out.select(
        *left.columns,
        F.col("_best._t").alias(f"near_{instant}"),
        *[F.col(f"_best.{c}").alias(f"near_{c}") for c in payload if c != instant],
    )


def rows_for_specs(specs: DataFrame, rows: DataFrame, keys: Sequence[str], instant: str, any_match: Sequence[str] = ()) -> DataFrame:
    """Many (key, from, until) requests answered by one read.

    Specs are spread over the days they cover, rows sit in their one day, so each matching pair
    meets exactly once. The overall bound of the specs is not collected; day equality prunes.
    Columns in ``any_match`` match when the spec holds null.
    """
    by_day = specs.withColumn("_day", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))))
    stored = rows.withColumn("_day", F.to_date(instant))
    for c in any_match:
        stored = stored.withColumnRenamed(c, f"row_{c}")
    hit = by_day.join(stored, [*keys, "_day"]).filter((F.col(instant) >= F.col("lo")) & (F.col(instant) <= F.col("hi")))
    for c in any_match:
        hit = hit.filter(F.col(c).isNull() | F.col(c).eqNullSafe(F.col(f"row_{c}")))
    return hit.drop("_day")


def lookup(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left equi join to a dimension; its size, not a hint, decides whether Spark broadcasts it."""
    return df.join(dim, on, "left")


def points_in_rings(
    points: DataFrame, rings: DataFrame, point_id: str, ring_id: str, cell: float, carry: Sequence[str] = (), merged: Mapping[str, Callable[[str], Column]] | None = None, flag: Column | None = None
) -> DataFrame:
    """(point, ring) pairs with the point inside, by even-odd crossing over all rings of one id (holes included).

    Edges are packed by (ring, row of cells), at most ``PACKET`` to a packet, and packets lie on the cells of the ring's
    bounding box; a point meets those of its own cell and must lie inside the box. Where a packet holds all edges of its
    row and an id has one point, the pair is decided where they meet and is shuffled no more; the others are counted by
    (point, ring). No row ever carries a whole ring but the input's own. ``carry`` names columns of the points to go along.

    ``merged`` asks for what the pairs add up to instead: it names the sum, least or greatest of carried columns (doubles or longs), and
    the result has a row per ring and value of the other carried columns. Points then meet a packet as blocks, each with its extent
    and with the aggregates of its points: a block that no edge divides is inside or outside as a whole, and the points of the others are tested one by one.

    ``flag``, a condition on the ring's id, asks for one row per point in any ring instead: (point, flag), true if the condition holds for one
    of them. A point in a block that lies whole in such a ring meets no other, and one in a block whole in any ring meets only such rings.

    Tables of points may be far larger than their files tell (cells are unpacked from arrays), so joins with them are by merge, not broadcast.
    """
    c = lambda v: F.floor(v / cell).cast("int")
    nxt = lambda i: F.get("ring", F.pmod(i + 1, F.size("ring")))
    edge = F.transform("ring", lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), nxt(i)["x"].alias("x2"), nxt(i)["y"].alias("y2")))
    # level edges are never crossed
    edges = rings.select(ring_id, F.explode(edge).alias("e")).select(ring_id, "e.*").filter("y1 <> y2")
    edges = edges.withColumn("_cy", F.explode(F.sequence(c(F.least("y1", "y2")), c(F.greatest("y1", "y2")))))
    w = W.partitionBy(ring_id, "_cy")
    number = F.floor((F.row_number().over(w.orderBy("x1", "y1", "x2", "y2")) - 1) / PACKET)
    packed = edges.withColumns({"_k": number, "_alone": F.count(F.lit(1)).over(w) <= PACKET, "dx": F.col("x2") - F.col("x1"), "dy": F.col("y2") - F.col("y1"), "low": F.least("y1", "y2"), "high": F.greatest("y1", "y2")})
    packed = packed.groupBy(ring_id, "_cy", "_k", "_alone").agg(F.collect_list(F.struct("x1", "y1", "dx", "dy", "low", "high")).alias("_edges")).drop("_k")
    bound = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    boxes = rings.groupBy(ring_id).agg(
        F.min(bound(F.array_min, "x")).alias("x0"), F.max(bound(F.array_max, "x")).alias("x9"), F.min(bound(F.array_min, "y")).alias("y0"), F.max(bound(F.array_max, "y")).alias("y9")
    )
    placed = boxes.hint("merge").join(packed, ring_id).withColumn("_cx", F.explode(F.sequence(c(F.col("x0")), c(F.col("x9")))))
    # few rings lie in one partition, whose task would meet all points if these are broadcast
    placed = placed.repartition("_cx", "_cy")
    inside = F.col("x").between(F.col("x0"), F.col("x9")) & F.col("y").between(F.col("y0"), F.col("y9"))

    def crossed(i: int) -> Column:
        # short on purpose: the code of all edges must stay small enough to be compiled
        e = F.get("_edges", F.lit(i))
        return F.when((e["low"] <= F.col("y")) & (F.col("y") < e["high"]) & (F.col("x") < e["dx"] * (F.col("y") - e["y1"]) / e["dy"] + e["x1"]), 1).otherwise(0)

    crossings = sum((crossed(i) for i in range(1, PACKET)), crossed(0))

    def met(some: DataFrame, packets: DataFrame) -> DataFrame:
        probes = some.withColumns({"_cx": c(F.col("x")), "_cy": c(F.col("y"))})
        return probes.hint("merge").join(packets, ["_cx", "_cy"]).filter(inside).withColumn("_n", crossings)

    carried = [x for x in carry if x not in ("x", "y")]
    single = points.groupBy(point_id).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(x).alias(x) for x in ("x", "y", *carried)])
    once = single.filter("_rows = 1").drop("_rows")
    repeated = single.filter("_rows > 1").select(F.col(point_id).alias("_id"))
    again = points.select(point_id, "x", "y").join(repeated.hint("merge"), F.col(point_id).eqNullSafe(F.col("_id")), "left_semi")
    out = [ring_id, *carry] if merged else [point_id, ring_id, *carry]
    whole = placed.filter("_alone")
    parts = met(once.select(point_id, "x", "y"), placed.filter("not _alone")).unionByName(met(again, placed))
    counted = parts.groupBy(point_id, ring_id).agg(F.sum("_n").alias("_n")).filter("_n % 2 = 1").select(point_id, ring_id)
    if flag is not None:
        told = _flagged_blocks(once, whole, point_id, cell, flag, inside, crossings).unionByName(counted.select(point_id, flag.alias("flag")))
        return told.groupBy(point_id).agg(F.max("flag").alias("flag"))
    direct = _merged_blocks(once, whole, point_id, ring_id, cell, carry, merged, inside, crossings) if merged else met(once, whole).filter("_n % 2 = 1").select(*out)
    if carry:
        beside = points.select(F.col(point_id).alias("_id"), *carry)
        counted = counted.join(beside.hint("merge"), F.col(point_id).eqNullSafe(F.col("_id")))
    found = direct.unionByName(counted.select(*out))
    return _merge(found, [ring_id, *[x for x in carry if x not in merged]], merged) if merged else found


def _merge(rows: DataFrame, keys: Sequence[str], merged: Mapping[str, Callable[[str], Column]], *more: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*[f(x).alias(x) for x, f in merged.items()], *more)


def _located(points: DataFrame, cell: float) -> DataFrame:
    """Points with a place and the cut of a grid cell they lie in."""
    return points.filter("x IS NOT NULL AND y IS NOT NULL").withColumns({f: F.floor(F.col(v) / cell * CUTS) for f, v in (("_fx", "x"), ("_fy", "y"))})


def _coarse() -> dict[str, Column]:
    return {k: F.floor(F.col(f) / CUTS).cast("int") for k, f in (("_cx", "_fx"), ("_cy", "_fy"))}


def _extent() -> list[Column]:
    return [f(v).alias(x) for f, names in ((F.min, ("_west", "_south")), (F.max, ("_east", "_north"))) for v, x in zip("xy", names)]


def _extents() -> tuple[Column, Column, Column]:
    """Of a block beside a packet: if it touches the ring's box, if it lies in it, and how often its points cross, ``DIVIDED`` or more where they differ.

    A crossing never falls or never rises along an edge, in rounded numbers too, so its values at both ends of a block's
    extent bound those of all points in it: what is decided for a block is what its points would give one by one.
    """

    def divides(i: int) -> Column:
        e, west, east, south, north = F.get("_edges", F.lit(i)), *map(F.col, ("_west", "_east", "_south", "_north"))
        a, b = (e["dx"] * (y - e["y1"]) / e["dy"] + e["x1"] for y in (F.greatest(south, e["low"]), F.least(north, e["high"])))
        all_left = (e["low"] <= south) & (north < e["high"]) & (east < a) & (east < b)
        return F.when((e["low"] <= north) & (south < e["high"]), F.when((west >= a) & (west >= b), 0).when(all_left, 1).otherwise(DIVIDED)).otherwise(0)

    near = (F.col("_west") <= F.col("x9")) & (F.col("_east") >= F.col("x0")) & (F.col("_south") <= F.col("y9")) & (F.col("_north") >= F.col("y0"))
    held = (F.col("_west") >= F.col("x0")) & (F.col("_east") <= F.col("x9")) & (F.col("_south") >= F.col("y0")) & (F.col("_north") <= F.col("y9"))
    return near, held, sum((divides(i) for i in range(1, PACKET)), divides(0))


def _flagged_blocks(points: DataFrame, packets: DataFrame, point_id: str, cell: float, flag: Column, inside: Column, crossings: Column) -> DataFrame:
    """(point, flag) of points, one row per id, in rings whose packets each hold all edges of their row; a point may come several times."""
    place = ["_fx", "_fy"]
    located = _located(points.select(point_id, "x", "y"), cell)
    blocks = located.groupBy(*place).agg(*_extent()).withColumns(_coarse())
    _, held, n = _extents()
    # generators keep filters from being pushed into the join, and from making two plans of what both kinds of points share
    met = blocks.hint("merge").join(packets, ["_cx", "_cy"]).filter(held).select(*place, flag.alias("_flag"), F.explode(F.array(n)).alias("_n"))
    sure = met.filter((F.col("_n") < DIVIDED) & (F.col("_n") % 2 == 1)).groupBy(*place).agg(F.max("_flag").alias("_sure"))
    known = located.join(sure.hint("merge"), place, "left").select(point_id, "x", "y", *place, F.explode(F.array("_sure")).alias("_sure"))
    asking = known.filter("_sure IS NULL OR NOT _sure").withColumns(_coarse()).drop(*place)
    tested = asking.hint("merge").join(packets, ["_cx", "_cy"]).filter(inside & (F.col("_sure").isNull() | flag)).withColumn("_n", crossings)
    return known.filter("_sure IS NOT NULL").select(point_id, F.col("_sure").alias("flag")).unionByName(tested.filter("_n % 2 = 1").select(point_id, flag.alias("flag")))


def _merged_blocks(
    points: DataFrame, packets: DataFrame, point_id: str, ring_id: str, cell: float, carry: Sequence[str], merged: Mapping[str, Callable[[str], Column]], inside: Column, crossings: Column
) -> DataFrame:
    """(ring, carried columns) of points, one row per id, inside rings whose packets each hold all edges of their row; merged by block where they can be."""
    by, box = [x for x in carry if x not in merged], ["x0", "x9", "y0", "y9"]
    place = ["_fx", "_fy"]
    located = _located(points.select(point_id, "x", "y", *carry), cell)
    # a crowded place is cut into parts of a bounded size
    crowd = located.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
    dealt = located.join(crowd.hint("merge"), place).withColumn("_part", F.pmod(F.xxhash64(point_id), F.col("_parts")))
    low, high = ("_west", "_south"), ("_east", "_north")
    groups = _merge(dealt, [*place, "_part", *by], merged, *_extent(), F.collect_list(F.struct("x", "y", *merged)).alias("_points"))
    extent = [f(x).alias(x) for f, names in ((F.min, low), (F.max, high)) for x in names]
    blocks = groups.groupBy(*place, "_part").agg(*extent, F.collect_list(F.struct(*by, *merged, "_points")).alias("_groups"))
    blocks = blocks.withColumns(_coarse())
    near, held, n = _extents()
    # the generator keeps the filter from being pushed into the join, where it would spell out the formula once more
    met = blocks.hint("merge").join(packets, ["_cx", "_cy"]).filter(near).select(ring_id, *box, "_edges", "_groups", held.alias("_held"), F.explode(F.array(n)).alias("_n"))
    met = met.filter((F.col("_n") >= DIVIDED) | (F.col("_n") % 2 == 1))
    met = met.select(ring_id, *box, "_edges", (F.col("_held") & (F.col("_n") < DIVIDED)).alias("_whole"), F.explode("_groups").alias("_g"))
    one = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), *[F.col("_g")[x].alias(x) for x in merged]))
    each = F.explode(F.when(F.col("_whole"), one).otherwise(F.col("_g")["_points"])).alias("_p")
    met = met.select(ring_id, *box, "_edges", "_whole", *[F.col("_g")[x].alias(x) for x in by], each).select(ring_id, *box, "_edges", "_whole", *by, "_p.*")
    return met.filter(F.col("_whole") | (inside & (crossings % 2 == 1))).select(ring_id, *carry)


def nearest_within(points: DataFrame, vertices: DataFrame, point_id: str, limit_m: float) -> DataFrame:
    """Distance to the nearest vertex closer than ``limit_m``; points without one keep null.

    Rows of cells are as high as the limit; each row is cut into as many columns as keep a cell wider than the
    limit at the row's poleward neighbour, around the whole circle. Vertices are copied to the three rows
    and three columns around them, so every pair inside the limit shares a cell at any latitude and
    across the date line.
    """
    dy = limit_m / geo.METRES_PER_DEGREE
    cy = F.floor(F.col("lat") / dy).cast("long")

    def column(row: Column, lon: Column, shift: Column) -> Column:
        edge = F.least(F.greatest(F.abs(row - 1), F.abs(row + 2)) * dy, F.lit(90.0))
        n = F.greatest(F.floor(F.cos(F.radians(edge)) * (360.0 / dy)), F.lit(1)).cast("long")
        return F.pmod(F.floor((lon + 180.0) * n / 360.0).cast("long") + shift, n)

    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = (
        vertices.select(F.col("lon").alias("v_lon"), F.col("lat").alias("v_lat"), cy.alias("_y"))
        .distinct()
        .withColumn("_dx", F.explode(around))
        .withColumn("_dy", F.explode(around))
        .withColumn("_cy", F.col("_y") + F.col("_dy"))
        .select("v_lon", "v_lat", "_cy", column(F.col("_cy"), F.col("v_lon"), F.col("_dx")).alias("_cx"))
        .distinct()
    )
    probes = points.select(point_id, "lon", "lat", cy.alias("_cy"), column(cy, F.col("lon"), F.lit(0)).alias("_cx"))
    # the vertex's longitude on the point's side of the date line
    v_lon = F.col("v_lon") + 360.0 * F.round((F.col("lon") - F.col("v_lon")) / 360.0)
    d = geo.local_distance_m(F.col("lon"), F.col("lat"), v_lon, F.col("v_lat"))
    near = probes.join(spread, ["_cx", "_cy"]).withColumn("d_m", d).filter(F.col("d_m") < limit_m)
    return points.join(near.groupBy(point_id).agg(F.min("d_m").alias("d_m")), point_id, "left")


def nearest_segment(points: DataFrame, segments: DataFrame, point_id: str, limit_m: float, same: str | None = None) -> DataFrame:
    """Distance to the nearest point of any segment, not of its ends alone, where it is closer than ``limit_m``; else null.

    ``segments``: lon1, lat1, lon2, lat2, and ``same``, a column that points and segments must share, if one is named. Rows
    of grid cells are as high as the limit, columns at least as wide. A segment enters the cells of its pieces, each no longer
    than a cell, and of their neighbours; the distance is to the whole segment. Segments cross the date line by
    longitudes beyond 180.

    Cells that hold points are cut ``FINE`` times each way. In such a part a segment is left out if, seen from the middle,
    it is farther than the limit or than the nearest one by more than the part's extent allows any point in it.
    """
    dy = limit_m / geo.METRES_PER_DEGREE
    row = lambda lat: F.floor(F.floor(lat * FINE / dy) / FINE).cast("long")

    def columns(at: Column) -> Column:
        edge = F.least(F.greatest(F.abs(at - 1), F.abs(at + 2)) * dy, F.lit(90.0))
        return F.greatest(F.floor(F.cos(F.radians(edge)) * (360.0 / dy)), F.lit(1)).cast("long")

    def square(lon: Column, lat: Column, wide: Column) -> dict[str, Column]:
        """The square of the distance in metres from a place to its row's segment, both ends on the place's side of the date line."""
        side = 360.0 * F.round((lon - F.col("lon1")) / 360.0)
        x1, y1 = (F.col("lon1") + side - lon) * wide, (F.col("lat1") - lat) * geo.METRES_PER_DEGREE
        return {"_x": x1, "_y": y1, "_dx": (F.col("lon2") + side - lon) * wide - x1, "_dy": (F.col("lat2") - lat) * geo.METRES_PER_DEGREE - y1}

    def measured(df: DataFrame, lon: Column, lat: Column, wide: Column) -> DataFrame:
        length = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
        part = F.when(length > 0, F.least(F.greatest(-(F.col("_x") * F.col("_dx") + F.col("_y") * F.col("_dy")) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        px, py = F.col("_x") + F.col("_t") * F.col("_dx"), F.col("_y") + F.col("_t") * F.col("_dy")
        return df.withColumns(square(lon, lat, wide)).withColumn("_t", part).withColumn("_d2", px * px + py * py).drop("_x", "_y", "_dx", "_dy", "_t")

    by = [same] if same else []
    keep = ["lon1", "lat1", "lon2", "lat2", *by]
    fy = F.floor(F.col("lat") * FINE / dy).cast("long")
    n_fine = columns(F.floor(F.col("_fy") / FINE).cast("long")) * FINE
    probes = points.select(point_id, "lon", "lat", *by, geo.metres_per_degree_lon(F.col("lat")).alias("_wide"), fy.alias("_fy"))
    probes = probes.withColumn("_fx", F.pmod(F.floor((F.col("lon") + 180.0) * n_fine / 360.0).cast("long"), n_fine))
    asked = probes.select("_fx", "_fy", *by).distinct()
    coarse = {"_cx": F.floor(F.col("_fx") / FINE).cast("long"), "_cy": F.floor(F.col("_fy") / FINE).cast("long")}

    # a degree of longitude is never longer than one of latitude, so steps by degrees are short enough
    n = F.greatest(F.ceil(F.greatest(F.abs(F.col("lon2") - F.col("lon1")), F.abs(F.col("lat2") - F.col("lat1"))) / dy), F.lit(1)).cast("int")
    pieces = segments.select(*keep).distinct().withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # few segments lie in one partition; their pieces are spread over many before they are copied to cells
    pieces = pieces.repartition("lon1", "lat1", "_i")
    on = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n")
    lon = [on("lon1", "lon2", F.col("_i") + k) for k in (0, 1)]
    lat = [on("lat1", "lat2", F.col("_i") + k) for k in (0, 1)]
    rows = F.sequence(row(F.least(*lat)) - 1, row(F.greatest(*lat)) + 1)
    placed = pieces.withColumns({"_w": F.least(*lon), "_e": F.greatest(*lon), "_cy": F.explode(rows)}).withColumn("_cols", columns(F.col("_cy")))
    column = lambda x, n: F.floor((x + 180.0) * n / 360.0).cast("long")
    spread = placed.withColumn("_c", F.explode(F.sequence(column(F.col("_w"), F.col("_cols")) - 1, column(F.col("_e"), F.col("_cols")) + 1)))
    spread = spread.select(*keep, "_cy", F.pmod("_c", "_cols").alias("_cx")).distinct()

    # the parts of cells that are asked for, each with its middle, its extent and its widest and narrowest metre
    deg = F.lit(360.0) / n_fine
    south, north = F.col("_fy") * (dy / FINE), (F.col("_fy") + 1) * (dy / FINE)
    wide = lambda at: geo.metres_per_degree_lon(F.least(at, F.lit(90.0)))
    nearest = F.when((F.col("_fy") >= 0), south).otherwise(-north)
    fine = asked.withColumns({**coarse, "_deg": deg, "_mid": (F.col("_fy") + 0.5) * (dy / FINE), "_most": wide(nearest), "_least": F.greatest(wide(nearest + dy / FINE), F.lit(0.0))})
    fine = fine.withColumn("_lon", (F.col("_fx") + 0.5) * F.col("_deg") - 180.0).withColumn("_r", F.hypot(F.col("_deg") * F.col("_most"), F.lit(limit_m / FINE)) / 2 * (1 + 1e-9) + 1e-3)
    seen = measured(spread.join(fine, ["_cx", "_cy", *by]), F.col("_lon"), F.col("_mid"), F.col("_most"))
    # half the earth away points of one part may see a segment on either side: it stays
    turn = F.abs(F.col("_lon") - F.col("lon1") - 360.0 * F.round((F.col("_lon") - F.col("lon1")) / 360.0))
    seen = seen.withColumn("_far", F.when(turn < 180.0 - F.col("_deg"), F.sqrt("_d2")))
    # no point of the part is nearer to the segment than _low or farther than _high; the generator keeps the filter from being
    # pushed into the join, where it would spell out the whole formula many times in code too large to be compiled
    bounds = F.struct(((F.col("_far") - F.col("_r")) * F.col("_least") / F.col("_most")).alias("_low"), (F.col("_far") + F.col("_r")).alias("_high"))
    seen = seen.select(*keep, "_fx", "_fy", F.explode(F.array(bounds)).alias("_b")).select(*keep, "_fx", "_fy", "_b._low", "_b._high")
    seen = seen.filter(F.col("_low").isNull() | (F.col("_low") < limit_m))
    best = seen.groupBy("_fx", "_fy", *by).agg(F.min("_high").alias("_best"))
    able = seen.join(best, ["_fx", "_fy", *by]).filter(F.col("_low").isNull() | F.col("_best").isNull() | (F.col("_low") <= F.col("_best"))).select(*keep, "_fx", "_fy").repartition("_fx", "_fy")

    met = measured(probes.join(able, ["_fx", "_fy", *by]), F.col("lon"), F.col("lat"), F.col("_wide"))
    near = met.groupBy(point_id).agg(F.sqrt(F.min("_d2")).alias("d_m")).filter(F.col("d_m") < limit_m)
    return points.join(near, point_id, "left")


def first_box(points: DataFrame, boxes: DataFrame, point_id: str, cell: float) -> DataFrame:
    """First bounding box (by ``box`` order) that holds each point, edges included."""
    c = lambda v: F.floor(v / cell).cast("int")
    spread = (
        boxes.withColumn("_cx", F.explode(F.sequence(c(F.col("west")), c(F.col("east")))))
        .withColumn("_cy", F.explode(F.sequence(c(F.col("south")), c(F.col("north")))))
    )
    probes = points.withColumn("_cx", c(F.col("x"))).withColumn("_cy", c(F.col("y")))
    held = F.col("x").between(F.col("west"), F.col("east")) & F.col("y").between(F.col("south"), F.col("north"))
    hits = probes.join(spread, ["_cx", "_cy"]).filter(held).groupBy(point_id).agg(F.min("box").alias("box"))
    return points.join(hits, point_id, "left")


def compare_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str], close: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Row-by-row comparison of two deliveries: where a key lives and which columns differ."""
    l = left.select(*keys, F.struct(*exact, *close).alias("l"))
    r = right.select(*keys, F.struct(*exact, *close).alias("r"))
    side = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").otherwise("both")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    flags = [(both & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(f"{c}_differs") for c in exact]
    for c in close:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        same = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) < tol, F.lit(False))
        flags.append((both & ~same).alias(f"{c}_differs"))
    return l.join(r, list(keys), "full_outer").select(*keys, side.alias("side"), *flags)


def not_superseded(alerts: DataFrame, at: str, unbounded_h: int = 48) -> DataFrame:
    """Alerts active at ``at``: known, actual, not ended, and not named by any later known alert.

    References are read from all known rows, so a short-lived cancel keeps its target cancelled.
    """
    t = F.lit(at).cast("timestamp")
    known = alerts.filter(F.col("available_at") <= t)
    open_ended = F.col("ends").isNull() & F.col("expires").isNull()
    active = known.filter(
        (F.col("status") == "Actual")
        & (F.col("message_type") != "Cancel")
        & (F.col("ends").isNull() | (F.col("ends") >= t))
        & (F.col("expires").isNull() | (F.col("expires") >= t))
        & (~open_ended | (hours_between(t, F.col("sent")) <= unbounded_h))
    )
    gone = known.select(F.explode("references").alias("alert_id")).distinct()
    return active.join(gone, "alert_id", "left_anti")


def doy_windows(daily: DataFrame, doy: str = "doy", window_days: int = 2) -> DataFrame:
    """Each day of record once per day-of-year window that contains it (2w+1 copies, wrapping)."""
    from fluvion.functions.clocks import neighbour_indices

    return daily.withColumn("key", F.explode(neighbour_indices(F.col(doy), window_days)))


def calendar_lag(daily: DataFrame, keys: Sequence[str], lag_days: int) -> DataFrame:
    """Value of each day beside the value exactly ``lag_days`` earlier, matched on the date.

    A range frame of exactly that offset finds the earlier day without a self join; a gap in the
    record gives no row, never the row before the gap.
    """
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = W.partitionBy(*keys).orderBy(number).rangeBetween(-lag_days, -lag_days)
    return daily.withColumn("prior", F.max("value").over(w)).filter(F.col("prior").isNotNull())

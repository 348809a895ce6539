"""Paths and rings as bounded arrays of vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fluvion.functions import geo


def midpoint_of_longest(paths: DataFrame, scope: str) -> DataFrame:
    """Middle vertex of the path with most vertices (lowest path id on ties)."""
    rank = F.struct(F.size("path").alias("n"), (-F.col("path_id")).alias("k"))
    best = paths.groupBy(scope).agg(F.max_by(F.struct("path_id", "path"), rank).alias("b"))
    n = F.size("b.path")
    mid = F.get("b.path", F.floor(n / 2).cast("int"))
    return best.select(scope, F.col("b.path_id").alias("path_id"), n.cast("long").alias("n_vertices"), mid.alias("mid"))


def signed_area(ring: Column) -> Column:
    """Shoelace area of an open ring (the closing edge is implied)."""
    nxt = lambda i: F.get(ring, F.pmod(i + 1, F.size(ring)))
    cross = F.transform(ring, lambda p, i: p["x"] * nxt(i)["y"] - nxt(i)["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda a, c: a + c) / 2.0


def path_length(path: Column) -> Column:
    """Planar length in the path's own units."""
    steps = F.transform(
        F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))),
        lambda q, i: F.hypot(q["x"] - F.get(path, i)["x"], q["y"] - F.get(path, i)["y"]),
    )
    return F.aggregate(steps, F.lit(0.0), lambda a, c: a + c)


def sinusoidal(ring: Column, earth_radius_km: float = 6371.0088) -> Column:
    """Equal-area projection of a lon/lat ring, in km."""
    return F.transform(
        ring,
        lambda p: F.struct(
            (F.radians(p["x"]) * F.cos(F.radians(p["y"])) * earth_radius_km).alias("x"), (F.radians(p["y"]) * earth_radius_km).alias("y")
        ),
    )


def touches_box(path: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.exists(path, lambda p: p["x"].between(west, east) & p["y"].between(south, north))


def vertex_distance_m(path: Column, lon: Column, lat: Column) -> Column:
    return F.array_min(F.transform(path, lambda p: geo.local_distance_m(lon, lat, p["x"], p["y"])))

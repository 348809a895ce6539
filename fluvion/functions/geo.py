"""Grid and projection arithmetic as column expressions; grid constants are folded on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

METRES_PER_DEGREE = 111_320.0


def metres_per_degree_lon(lat: Column) -> Column:
    return F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat))


def local_distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Flat-earth distance at the latitude of the first point."""
    return F.hypot((lon2 - lon1) * metres_per_degree_lon(lat1), (lat2 - lat1) * METRES_PER_DEGREE)


def lon360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def flat_index(i: Column, j: Column, nx: int) -> Column:
    return j * nx + i


@dataclass(frozen=True)
class LatLonGrid:
    """Regular grid scanning east and south from its north-west cell centre."""

    nx: int
    ny: int
    la1: float
    lo1: float
    dlon: float
    dlat: float
    earth_radius_m: float = 6_371_229.0

    def to_grid(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return (lon360(lon) - self.lo1) / self.dlon, (F.lit(self.la1) - lat) / self.dlat

    def cell_area_km2(self, j: Column) -> Column:
        r = self.earth_radius_m / 1000.0
        flat = math.radians(self.dlon) * r * math.radians(self.dlat) * r
        return F.lit(flat) * F.cos(F.radians(F.lit(self.la1) - j * self.dlat))


@dataclass(frozen=True)
class LambertGrid:
    """Lambert conformal conic on a sphere; grid coordinates are fractional cell indices."""

    nx: int
    ny: int
    la1: float
    lo1: float
    latin1: float
    latin2: float
    lad: float
    lov: float
    dx_m: float
    dy_m: float
    earth_radius_m: float = 6_371_200.0

    @property
    def cone(self) -> float:
        p1, p2 = math.radians(self.latin1), math.radians(self.latin2)
        if abs(p1 - p2) < 1e-12:
            return math.sin(p1)
        quarter = math.pi / 4
        return math.log(math.cos(p1) / math.cos(p2)) / math.log(math.tan(quarter + p2 / 2) / math.tan(quarter + p1 / 2))

    @property
    def rho_scale(self) -> float:
        p1 = math.radians(self.latin1)
        return self.earth_radius_m * math.cos(p1) * math.tan(math.pi / 4 + p1 / 2) ** self.cone / self.cone

    def rho_at(self, lat_deg: float) -> float:
        return self.rho_scale / math.tan(math.pi / 4 + math.radians(lat_deg) / 2) ** self.cone

    def origin(self) -> tuple[float, float]:
        theta = self.cone * math.radians((self.lo1 - self.lov + 180.0) % 360.0 - 180.0)
        rho = self.rho_at(self.la1)
        return rho * math.sin(theta), self.rho_at(self.lad) - rho * math.cos(theta)

    def rho(self, lat: Column) -> Column:
        return F.lit(self.rho_scale) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(self.cone))

    def to_grid(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        x0, y0 = self.origin()
        theta = F.radians(F.pmod(lon - self.lov + 180.0, F.lit(360.0)) - 180.0) * self.cone
        rho = self.rho(lat)
        x, y = rho * F.sin(theta), F.lit(self.rho_at(self.lad)) - rho * F.cos(theta)
        return (x - x0) / self.dx_m, (y - y0) / self.dy_m

    def to_lonlat(self, i: Column, j: Column) -> tuple[Column, Column]:
        x0, y0 = self.origin()
        x, dy = i * self.dx_m + x0, F.lit(self.rho_at(self.lad) - y0) - j * self.dy_m
        rho = F.hypot(x, dy) * math.copysign(1.0, self.cone)
        lat = F.degrees(F.atan(F.pow(F.lit(self.rho_scale) / rho, F.lit(1.0 / self.cone))) * 2.0 - math.pi / 2)
        lon = F.degrees(F.atan2(x, dy) / self.cone) + self.lov
        return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0, lat

    def scale_factor(self, lat: Column) -> Column:
        return self.rho(lat) * self.cone / (F.cos(F.radians(lat)) * self.earth_radius_m)

    def cell_area_km2(self, lat: Column) -> Column:
        k = self.scale_factor(lat)
        return F.lit(self.dx_m * self.dy_m / 1e6) / (k * k)

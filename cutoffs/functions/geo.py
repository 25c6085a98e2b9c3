"""Geographic column functions: distances, offsets, map projection, hexagonal cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Ellipsoid (a in metres, 1/f), scale at the central meridian, false easting.
WGS84_A, WGS84_F, UTM_K0, UTM_E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def local_offsets_m(lon0: Column, lat0: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """East and north of a point from an origin, in metres, with the cosine of the middle latitude."""
    k = math.radians(1) * EARTH_KM * 1000
    return (lon - lon0) * k * F.cos(F.radians((lat + lat0) / 2)), (lat - lat0) * k


def _series() -> tuple[float, float, list[float], list[float]]:
    n = WGS84_F / (2 - WGS84_F)
    big_a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return n, big_a, alpha, beta


def to_utm(lon: Column, lat: Column, meridian: float = 81.0) -> tuple[Column, Column]:
    """Easting and northing in metres by the Krueger series (zone 44N for meridian 81)."""
    n, big_a, alpha, _ = _series()
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    dl = F.radians(lon - meridian)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_E0 + UTM_K0 * big_a * x, UTM_K0 * big_a * y


def from_utm(x: Column, y: Column, meridian: float = 81.0) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing."""
    n, big_a, _, beta = _series()
    xi0, eta0 = y / (UTM_K0 * big_a), (x - UTM_E0) / (UTM_K0 * big_a)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    d = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    lat = chi + d[0] * F.sin(2 * chi) + d[1] * F.sin(4 * chi) + d[2] * F.sin(6 * chi)
    return meridian + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


#: Areas in square metres that hexagons of the two resolutions cover.
HEX_AREA = {6: 36.13e6, 8: 0.7373e6}


def hex_size(res: int) -> float:
    """Side of a hexagon of a resolution, in metres."""
    return math.sqrt(2 * HEX_AREA[res] / (3 * math.sqrt(3)))


def hex_axial(x: Column, y: Column, res: int) -> tuple[Column, Column]:
    """Axial coordinates of the hexagon (pointed up) that holds a point in metres, by cube rounding."""
    size = hex_size(res)
    q, r = (math.sqrt(3) / 3 * x - y / 3) / size, (2 / 3 * y) / size
    rq, rr, rs = F.round(q), F.round(r), F.round(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    cq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    cr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return cq.cast("long"), cr.cast("long")


def hex_cell(x: Column, y: Column, res: int) -> Column:
    q, r = hex_axial(x, y, res)
    return F.concat_ws(":", F.lit(f"r{res}"), q.cast("string"), r.cast("string"))


def hex_centre(q: Column, r: Column, res: int) -> tuple[Column, Column]:
    size = hex_size(res)
    return size * math.sqrt(3) * (q + r / 2), size * 1.5 * r


def hex_ring(q: Column, r: Column, res: int) -> Column:
    """Six corners of a hexagon and the first again, as points in metres."""
    size, (cx, cy) = hex_size(res), hex_centre(q, r, res)
    corner = [F.struct((cx + size * math.cos(math.radians(60 * k - 30))).alias("x"), (cy + size * math.sin(math.radians(60 * k - 30))).alias("y")) for k in (*range(6), 0)]
    return F.array(*corner)


def line_lengths(line: Column) -> Column:
    """Running length at each vertex of a line of points {x, y}."""
    seg = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(seg, F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))


def line_length(line: Column) -> Column:
    seg = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(seg, F.lit(0.0), lambda acc, d: acc + d)


def interpolate_line(line: Column, distance: Column) -> Column:
    """Point {x, y} at a distance along a line, clamped to its ends."""
    def at(run: Column) -> Column:
        d = F.least(F.greatest(distance, F.lit(0.0)), F.element_at(run, -1))
        i = F.greatest(F.lit(1), F.least(F.size(F.filter(run, lambda s: s <= d)), F.size(line) - 1))
        a, b, s0, s1 = F.element_at(line, i), F.element_at(line, i + 1), F.element_at(run, i), F.element_at(run, i + 1)
        t = F.when(s1 > s0, (d - s0) / (s1 - s0)).otherwise(0.0)
        return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))

    return F.transform(F.array(line_lengths(line)), at)[0]


def densify(line: Column, step: float) -> Column:
    """Distances of evenly spaced samples along a line, both ends included, at most `step` apart (two at least)."""
    n = F.greatest(F.lit(2), (F.ceil(line_length(line) / step) + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: k / (n - 1) * line_length(line))

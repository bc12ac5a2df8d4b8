"""Geometry as column expressions: degrees in, metres or degrees out, all within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth and metres in a degree of latitude.
EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; the root is clamped to 1, so antipodes give a number; null if a place is."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * F.lit(EARTH_M) * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def local_xy(lon: Column, lat: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular metres about a latitude."""
    return F.radians(lon) * F.lit(EARTH_M) * F.cos(F.radians(lat0)), F.radians(lat) * F.lit(EARTH_M)


def equirect_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lat0: Column) -> Column:
    x1, y1 = local_xy(lon1, lat1, lat0)
    x2, y2 = local_xy(lon2, lat2, lat0)
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def point_segment_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment in the plane; the foot is clamped to the ends, and a segment without length
    is a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0.0)))))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return angle - 360 * F.floor(angle / 360)


def turn_deg(before: Column, after: Column) -> Column:
    """Signed turn between two bearings in (-180, 180]."""
    d = after - before + 180
    d = d - 360 * F.floor(d / 360) - 180
    return F.when(d == -180, F.lit(180.0)).otherwise(d)


def destination(lon: Column, lat: Column, bearing: Column, distance_m: Column) -> tuple[Column, Column]:
    """The point reached from another one by bearing and distance on the sphere."""
    a, r, t = F.radians(lat), distance_m / F.lit(EARTH_M), F.radians(bearing)
    b = F.asin(F.sin(a) * F.cos(r) + F.cos(a) * F.sin(r) * F.cos(t))
    return F.degrees(F.radians(lon) + F.atan2(F.sin(t) * F.sin(r) * F.cos(a), F.cos(r) - F.sin(a) * F.sin(b))), F.degrees(b)


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile of a point."""
    n, a = float(2**zoom), F.radians(lat)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(a) + 1 / F.cos(a)) / F.pi()) / 2 * n)
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(int(n) - 1), c)).cast("long")
    return clamp(x), clamp(y)


def turn_class(delta: Column) -> Column:
    """Kind of a turn by its size: slight below 45 degrees, sharp from 120, u-turn from 160; straight below 30."""
    size = F.abs(delta)
    return (
        F.when(size < 30, "straight").when(size < 45, "slight").when(size < 120, "turn").when(size < 160, "sharp").otherwise("uturn")
    )

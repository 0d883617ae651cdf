"""Distances, bearings and angles as column expressions (degrees in, km or degrees out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radii in km: of analyses, and of quality checks.
RADIUS, RADIUS_QC = 6371.0, 6371.0088


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def floor_mod(x: Column, n: float) -> Column:
    """x - n * floor(x / n): never negative."""
    return x - F.floor(x / n) * n


def wrap_lon(lon: Column | str, low: float = -180.0) -> Column:
    """Longitude in [low, low + 360)."""
    return floor_mod(_c(lon) - low, 360.0) + low


def delta_lon(a: Column | str, b: Column | str) -> Column:
    """b - a in [-180, 180)."""
    return floor_mod(_c(b) - _c(a) + 180.0, 360.0) - 180.0


def haversine(lon1, lat1, lon2, lat2, radius: float = RADIUS) -> Column:
    """Great-circle distance; the difference of longitude is wrapped."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(delta_lon(_c(lon1), _c(lon2))) / 2), 2)
    # least and greatest skip nulls: a missing position has no distance.
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def chord(lon1, lat1, lon2, lat2, radius: float = RADIUS) -> Column:
    """Straight distance through the sphere."""
    return 2 * radius * F.sin(haversine(lon1, lat1, lon2, lat2, 1.0) / 2)


def meridional(lat1, lat2, radius: float = RADIUS) -> Column:
    return F.abs(F.radians(_c(lat2) - _c(lat1))) * radius


def local_xy(lon, lat, lon0, lat0, radius: float = RADIUS) -> tuple[Column, Column]:
    """Equirectangular km east and north of a centre."""
    return F.radians(delta_lon(lon0, lon)) * F.cos(F.radians(_c(lat0))) * radius, F.radians(_c(lat) - _c(lat0)) * radius


def planar(lon1, lat1, lon2, lat2, radius: float = RADIUS) -> Column:
    """Equirectangular distance at the mean latitude."""
    x, y = local_xy(lon2, lat2, lon1, lat1, radius)
    x = F.radians(delta_lon(lon1, lon2)) * F.cos(F.radians((_c(lat1) + _c(lat2)) / 2)) * radius
    return F.sqrt(x * x + y * y)


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial great-circle bearing in [0, 360); null where both points are one."""
    d, p1, p2 = F.radians(delta_lon(lon1, lon2)), F.radians(_c(lat1)), F.radians(_c(lat2))
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    same = (_c(lat1) == _c(lat2)) & (delta_lon(lon1, lon2) == 0)
    return F.when(~same, floor_mod(angle, 360.0))


def angle_difference(a, b) -> Column:
    """b - a in [-180, 180)."""
    return delta_lon(a, b)


def axial_mismatch(a, b) -> Column:
    """Angle between two undirected axes, 0 to 90."""
    d = F.abs(delta_lon(a, b))
    return F.least(d, 180.0 - d)


def circular_mean(degrees: Column | str, weight: Column | float = 1.0) -> Column:
    """Aggregate: weighted mean direction in [-180, 180]."""
    r, w = F.radians(_c(degrees)), weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.degrees(F.atan2(F.sum(w * F.sin(r)), F.sum(w * F.cos(r))))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval of a binomial share; null where n is 0."""
    p, z2 = k / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def entropy(p: Column, base: float = math.e) -> Column:
    """Aggregate: -sum p log p; shares of 0 or null add nothing."""
    return F.sum(F.when(p > 0, -p * F.log(p) / math.log(base)))


def displaced(x, y, bearing_degrees, distance) -> tuple[Column, Column]:
    """Planar point at a distance along a bearing (0 is north)."""
    r = F.radians(_c(bearing_degrees))
    return _c(x) + _c(distance) * F.sin(r), _c(y) + _c(distance) * F.cos(r)


def planar_inverse(x1, y1, x2, y2) -> tuple[Column, Column]:
    """Distance and bearing between planar points."""
    dx, dy = _c(x2) - _c(x1), _c(y2) - _c(y1)
    return F.sqrt(dx * dx + dy * dy), floor_mod(F.degrees(F.atan2(dx, dy)), 360.0)

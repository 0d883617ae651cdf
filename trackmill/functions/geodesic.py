"""WGS84 geodesics: iterative inverse and direct solutions as Arrow functions over columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

A, FLAT = 6378.137, 1 / 298.257223563
B = A * (1 - FLAT)


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def inverse(lon1, lat1, lon2, lat2, rounds: int = 60):
    """Distance in km and bearings at either end, in degrees; NaN where the iteration does not settle (nearly opposite points)."""
    l1, p1, l2, p2 = (np.radians(np.asarray(x, float)) for x in (lon1, lat1, lon2, lat2))
    u1, u2 = np.arctan((1 - FLAT) * np.tan(p1)), np.arctan((1 - FLAT) * np.tan(p2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    d = (l2 - l1 + np.pi) % (2 * np.pi) - np.pi
    lam = d.copy()
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / np.where(ss == 0, 1.0, ss))
            ca2 = 1 - sa * sa
            c2m = np.where(ca2 < 1e-15, 0.0, cs - 2 * s1 * s2 / np.where(ca2 < 1e-15, 1.0, ca2))
            c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            new = d + (1 - c) * FLAT * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            moved = np.abs(new - lam)
            lam = new
        k = ca2 * (A * A - B * B) / (B * B)
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        delta = small * ss * (c2m + small / 4 * (cs * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        km = B * big * (sigma - delta)
        sl, cl = np.sin(lam), np.cos(lam)
        start = np.degrees(np.arctan2(c2 * sl, c1 * s2 - s1 * c2 * cl)) % 360
        end = np.degrees(np.arctan2(c1 * sl, c1 * s2 * cl - s1 * c2)) % 360
    settled = (moved < 1e-11) & (np.abs(lam) <= np.pi + 1e-9)
    same = (p1 == p2) & (d == 0)
    km = np.where(same, 0.0, np.where(settled, km, np.nan))
    return km, np.where(same | ~settled, np.nan, start), np.where(same | ~settled, np.nan, end)


def direct(lon, lat, bearing, km, rounds: int = 60):
    """Longitude in [-180, 180) and latitude reached after km along a bearing."""
    p, az, s = np.radians(np.asarray(lat, float)), np.radians(np.asarray(bearing, float)), np.asarray(km, float)
    u = np.arctan((1 - FLAT) * np.tan(p))
    su, cu, ca, sa = np.sin(u), np.cos(u), np.cos(az), np.sin(az)
    sigma1 = np.arctan2(su / cu, ca)
    sin_a = cu * sa
    ca2 = 1 - sin_a**2
    k = ca2 * (A * A - B * B) / (B * B)
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    sigma = s / (B * big)
    for _ in range(rounds):
        c2m = np.cos(2 * sigma1 + sigma)
        ss, cs = np.sin(sigma), np.cos(sigma)
        delta = small * ss * (c2m + small / 4 * (cs * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
        sigma = s / (B * big) + delta
    ss, cs, c2m = np.sin(sigma), np.cos(sigma), np.cos(2 * sigma1 + sigma)
    lat2 = np.arctan2(su * cs + cu * ss * ca, (1 - FLAT) * np.hypot(sin_a, su * ss - cu * cs * ca))
    lam = np.arctan2(ss * sa, cu * cs - su * ss * ca)
    c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
    d = lam - (1 - c) * FLAT * sin_a * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return (np.degrees(d) + np.asarray(lon, float) + 180) % 360 - 180, np.degrees(lat2)


@F.pandas_udf(_doubles("km", "bearing", "arrival"))
def wgs84_inverse(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("km", "bearing", "arrival"), inverse(lon1, lat1, lon2, lat2), strict=True))).astype(object).where(lambda d: d.notna(), None)


@F.pandas_udf(_doubles("lon", "lat"))
def wgs84_direct(lon: pd.Series, lat: pd.Series, bearing: pd.Series, km: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("lon", "lat"), direct(lon, lat, bearing, km), strict=True)))


def zone_area(lat0: float, lat1: float, lon_width: float) -> float:
    """Area in km2 between two parallels, over a width of longitude in degrees."""
    e = np.sqrt(FLAT * (2 - FLAT))

    def q(lat: float) -> float:
        s = np.sin(np.radians(lat))
        return s / (1 - (e * s) ** 2) + np.arctanh(e * s) / e

    return float(np.radians(lon_width) * B * B / 2 * abs(q(lat1) - q(lat0)))


def row_scales(spark, grid) -> DataFrame:
    """Of each latitude row of a grid, on the ellipsoid: km of a step of longitude (km_x), km to the next row's centre (km_y), and a cell's area in km2."""
    rows = spark.range(grid.ny).select(F.col("id").alias("lat_bin")).withColumn("lat", grid.lat_center(F.col("lat_bin")))
    zero, edge = F.lit(0.0), lambda side: F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("lat") + side * grid.lat_step / 2))
    x, y = wgs84_inverse(zero, F.col("lat"), F.lit(float(grid.lon_step)), F.col("lat")), wgs84_inverse(zero, F.col("lat"), zero, F.col("lat") + F.lit(float(grid.lat_step)))
    return rows.select("lat_bin", x["km"].alias("km_x"), F.when(F.col("lat") + grid.lat_step <= 90, y["km"]).alias("km_y"), wgs84_zone(edge(-1), edge(1), F.lit(float(grid.lon_step))).alias("area_km2"))


@F.pandas_udf(T.DoubleType())
def wgs84_zone(south: pd.Series, north: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([zone_area(a, b, w) for a, b, w in zip(south, north, width, strict=True)])

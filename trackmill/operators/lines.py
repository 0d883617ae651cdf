"""Lines on the ellipsoid: resampling by arc length, smoothing, tangents, normals and curvature."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import delta_lon, wrap_lon
from trackmill.functions.geodesic import wgs84_direct, wgs84_inverse
from trackmill.operators.transport import spherical_centre

KEYS = ("branch",)


def resample_polyline(points: DataFrame, spacing_km: float, values: Sequence[str] = (), keys: Sequence[str] = KEYS, order: str = "point") -> DataFrame:
    """Each line's places every spacing_km of arc length from its start, and its end: (keys, place, s_km, lon, lat, values).

    Legs follow geodesics, in pieces of half a spacing at most, between whose ends longitude and latitude are
    straight, as are values along a leg. A line of one point is one place. Points of no length add nothing.
    Each leg gives its own places: only the sum of leg lengths goes along a line, as a window.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = {c: F.lead(c).over(w) for c in ("lon", "lat", *values)}
    legs = points.select(*keys, order, "lon", "lat", *values).withColumns({f"__{c}": x for c, x in ahead.items()}).withColumn("__first", F.row_number().over(w) == 1)
    legs = legs.withColumn("__leg", F.when(F.col("__lon").isNotNull(), wgs84_inverse("lon", "lat", "__lon", "__lat")))
    legs = legs.withColumn("__km", F.coalesce("__leg.km", F.lit(0.0)))
    legs = legs.withColumn("__to", F.sum("__km").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__from", F.col("__to") - F.col("__km"))
    legs = legs.withColumn("__total", F.max("__to").over(Window.partitionBy(*keys)))
    # A line's end is the end of its last leg with a length; a line without any is its first point.
    ends = legs.where((F.col("__km") > 0) | ((F.col("__total") == 0) & F.col("__first")))
    steps = F.greatest(F.lit(1), F.ceil(F.col("__km") / max(spacing_km / 2, 1.0))).cast("int")
    pieces = ends.withColumns({"__steps": steps, "__k": F.explode(F.sequence(F.lit(0), steps - 1))})
    at = lambda k: F.col("__from") + F.col("__km") * k / F.col("__steps")
    pieces = pieces.withColumns({"__a": at(F.col("__k")), "__b": F.when(F.col("__k") == F.col("__steps") - 1, F.col("__to")).otherwise(at(F.col("__k") + 1))})
    # Multiples of the spacing in [a, b) that are not the end itself.
    low, high = F.ceil(F.col("__a") / spacing_km - 1e-12).cast("long"), F.ceil(F.col("__b") / spacing_km - 1e-12).cast("long") - 1
    inside = F.when(low <= high, F.filter(F.transform(F.sequence(low, F.greatest(low, high)), lambda m: m * F.lit(float(spacing_km))), lambda s: s < F.col("__total") - 1e-8)).otherwise(F.array().cast("array<double>"))
    last = (F.col("__b") == F.col("__total")) & (F.col("__k") == F.col("__steps") - 1)
    pieces = pieces.withColumn("s_km", F.explode(F.concat(inside, F.when(last, F.array("__total")).otherwise(F.array().cast("array<double>")))))
    spot = lambda k: wgs84_direct(F.col("lon"), F.col("lat"), F.coalesce("__leg.bearing", F.lit(0.0)), F.col("__km") * k / F.col("__steps"))
    pieces = pieces.withColumns({"__p": spot(F.col("__k")), "__q": spot(F.col("__k") + 1)})
    share = F.coalesce((F.col("s_km") - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0)), F.lit(0.0))
    lon = wrap_lon(F.col("__p.lon") + share * delta_lon(F.col("__p.lon"), F.col("__q.lon")))
    lat = F.col("__p.lat") + share * (F.col("__q.lat") - F.col("__p.lat"))
    along = F.coalesce((F.col("s_km") - F.col("__from")) / F.nullif("__km", F.lit(0.0)), F.lit(0.0))
    between = [(F.col(c) + along * (F.coalesce(f"__{c}", c) - F.col(c))).alias(c) for c in values]
    rows = pieces.select(*keys, "s_km", lon.alias("lon"), lat.alias("lat"), *between)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("s_km")) - 1)


def polynomial_weights(size: int, degree: int) -> np.ndarray:
    """Row i gives the value at place i of the polynomial fitted to size equally spaced values."""
    x = np.vander(np.arange(size) - (size - 1) / 2, degree + 1)
    return x @ np.linalg.pinv(x)


def polynomial_smooth(df: DataFrame, columns: Sequence[str], size: int, degree: int, keys: Sequence[str] = KEYS, order: str = "place") -> DataFrame:
    """Columns replaced by a fitted polynomial of an odd number of rows around each; the first and last half window use the fit of the whole first or last one.

    Groups of fewer rows than size stay as they are, and so does everything where size is not above degree. The
    frame of a row holds 2 size - 1 values at most.
    """
    if size <= degree:
        return df
    w = Window.partitionBy(*keys).orderBy(order)
    i, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(*keys))
    table = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in polynomial_weights(size, degree)))
    rows = df.withColumns({"__i": i, "__n": n} | {f"__f_{c}": F.collect_list(c).over(w.rowsBetween(-(size - 1), size - 1)) for c in columns})
    begin = F.greatest(F.lit(0), F.least(F.col("__i") - size // 2, F.col("__n") - size))
    offset = begin - (F.col("__i") - F.least(F.col("__i"), F.lit(size - 1)))
    weights = F.get(table, F.col("__i") - begin)
    dot = lambda c: F.aggregate(F.zip_with(F.slice(f"__f_{c}", offset + 1, F.lit(size)), weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumns({c: F.when(F.col("__n") >= size, dot(c)).otherwise(F.col(c)) for c in columns})
    return rows.drop("__i", "__n", *(f"__f_{c}" for c in columns))


def gradient(value: str, s: str, w) -> Column:
    """Derivative along unequal steps: of second order inside, one-sided at the ends, null for a single row."""
    f, x = F.col(value), F.col(s)
    before, after = x - F.lag(s).over(w), F.lead(s).over(w) - x
    f0, f1 = F.lag(value).over(w), F.lead(value).over(w)
    inner = (before * before * f1 + (after * after - before * before) * f - after * after * f0) / (before * after * (before + after))
    return F.when(before.isNotNull() & after.isNotNull(), inner).when(after.isNotNull(), (f1 - f) / after).when(before.isNotNull(), (f - f0) / before)


def line_geometry(lines: DataFrame, size: int = 5, degree: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """Resampled lines (keys, place, s_km, lon, lat) smoothed, with their frame: x_km, y_km, tangent, normal to the left, bearing, curvature.

    x_km and y_km are east and north of the line's centre by geodesics from it (azimuthal equidistant); both are
    smoothed by polynomial_smooth, but for the ends, and turned back into lon and lat; raw_lon and raw_lat keep what
    was. A line of one place points east. radius_km is null where the line is straight.
    """
    centre = spherical_centre(lines, list(keys))
    rows = lines.join(centre, list(keys)).withColumn("__to", wgs84_inverse("centre_lon", "centre_lat", "lon", "lat"))
    angle = F.radians(F.coalesce("__to.bearing", F.lit(0.0)))
    rows = rows.withColumns({"raw_x": F.col("__to.km") * F.sin(angle), "raw_y": F.col("__to.km") * F.cos(angle)}).drop("__to")
    smooth = polynomial_smooth(rows.withColumns({"x_km": F.col("raw_x"), "y_km": F.col("raw_y")}), ["x_km", "y_km"], size, degree, keys)
    w = Window.partitionBy(*keys).orderBy("place")
    end = F.lag("place").over(w).isNull() | F.lead("place").over(w).isNull()
    rows = smooth.withColumns({"x_km": F.when(end, F.col("raw_x")).otherwise(F.col("x_km")), "y_km": F.when(end, F.col("raw_y")).otherwise(F.col("y_km"))})
    back = wgs84_direct(F.col("centre_lon"), F.col("centre_lat"), F.pmod(F.degrees(F.atan2("x_km", "y_km")), F.lit(360.0)), F.sqrt(F.col("x_km") ** 2 + F.col("y_km") ** 2))
    rows = rows.withColumnsRenamed({"lon": "raw_lon", "lat": "raw_lat"}).withColumn("__p", back).withColumns({"lon": F.col("__p.lon"), "lat": F.col("__p.lat")})
    rows = rows.withColumns({"__dx": F.coalesce(gradient("x_km", "s_km", w), F.lit(1.0)), "__dy": F.coalesce(gradient("y_km", "s_km", w), F.lit(0.0))})
    long = F.greatest(F.sqrt(F.col("__dx") ** 2 + F.col("__dy") ** 2), F.lit(1e-12))
    rows = rows.withColumns({"tangent_x": F.col("__dx") / long, "tangent_y": F.col("__dy") / long})
    bend = F.sqrt(F.coalesce(gradient("tangent_x", "s_km", w), F.lit(0.0)) ** 2 + F.coalesce(gradient("tangent_y", "s_km", w), F.lit(0.0)) ** 2)
    rows = rows.withColumns({"normal_x": -F.col("tangent_y"), "normal_y": F.col("tangent_x"), "bearing": F.pmod(F.degrees(F.atan2("tangent_x", "tangent_y")), F.lit(360.0)), "curvature": bend})
    return rows.withColumn("radius_km", F.when(F.col("curvature") > 1e-12, 1 / F.col("curvature"))).drop("__p", "__dx", "__dy", "raw_x", "raw_y")

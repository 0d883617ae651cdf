"""Fronts beside transport structures: gradients along and across them, what surrounds a front, one front for each core and side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.functions.geo import RADIUS, angle_difference, bearing
from trackmill.functions.geodesic import row_scales
from trackmill.functions.grid import RegularGrid
from trackmill.operators.sections import bilinear_fields
from trackmill.operators.spatial import radius_join
from trackmill.operators.transport import CELL, with_neighbours

KEYS = ("branch", "point")
GRADIENTS = ("g_perp", "abs_g_perp", "g_parallel", "abs_g_parallel", "magnitude", "share_perp")


def rotated_gradients(cells: DataFrame, grid: RegularGrid, value: str, angle: str, ellipsoid: bool = False) -> DataFrame:
    """Gradient of a value per km, east (gx) and north (gy), and across (to the left) and along each cell's direction.

    Centred where both neighbours have the value, one-sided where one has, else null; dx_method and dy_method say
    which. What needs both parts or a direction is null without them; share_perp, the part of the magnitude that
    lies across, is null where there is no slope at all.
    """
    rows = cells.where(F.col(value).isNotNull()).select(*CELL, F.col(value).alias("v"), F.col(angle).alias("angle"))
    met = with_neighbours(rows.select(*CELL, "v"), grid, ["v"]).where("dx = 0 or dy = 0")
    pick = lambda x, y: F.max(F.when((F.col("dx") == x) & (F.col("dy") == y), F.col("n_v")))
    sides = met.groupBy(*CELL).agg(pick(1, 0).alias("e"), pick(-1, 0).alias("w"), pick(0, 1).alias("n"), pick(0, -1).alias("s"))
    out = rows.join(sides, CELL, "left")
    if ellipsoid:
        scale = row_scales(cells.sparkSession, grid)  # a row for each row of the grid
        out = out.join(scale.select("lat_bin", F.col("km_x").alias("__x"), F.col("km_y").alias("__n")), "lat_bin").join(scale.select((F.col("lat_bin") + 1).alias("lat_bin"), F.col("km_y").alias("__s")), "lat_bin", "left")
    else:
        out = out.withColumns({"__x": F.radians(F.lit(grid.lon_step)) * RADIUS * F.cos(F.radians(grid.lat_center(F.col("lat_bin")))), "__n": F.radians(F.lit(grid.lat_step)) * RADIUS, "__s": F.radians(F.lit(grid.lat_step)) * RADIUS})

    def slope(a: str, b: str, km_a: str, km_b: str):
        apart = F.when(F.col(a).isNotNull(), F.col(km_a)).otherwise(0.0) + F.when(F.col(b).isNotNull(), F.col(km_b)).otherwise(0.0)
        return F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), (F.coalesce(a, "v") - F.coalesce(b, "v")) / apart)

    method = lambda a, b, name: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), f"{name}_centered").when(F.col(a).isNotNull() | F.col(b).isNotNull(), f"{name}_one_sided").otherwise(f"{name}_undefined")
    out = out.withColumns({"gx": slope("e", "w", "__x", "__x"), "gy": slope("n", "s", "__n", "__s"), "dx_method": method("e", "w", "dx"), "dy_method": method("n", "s", "dy")})
    a = F.radians("angle")
    out = out.withColumns({"g_perp": F.col("gy") * F.sin(a) - F.col("gx") * F.cos(a), "g_parallel": F.col("gx") * F.sin(a) + F.col("gy") * F.cos(a)})
    out = out.withColumns({"abs_g_perp": F.abs("g_perp"), "abs_g_parallel": F.abs("g_parallel"), "magnitude": F.sqrt(F.col("g_perp") ** 2 + F.col("g_parallel") ** 2)})
    out = out.withColumn("share_perp", F.when(F.col("magnitude") > 1e-12, F.col("abs_g_perp") / F.col("magnitude")))
    return out.select(*CELL, F.col("v").alias(value), F.col("angle").alias(angle), "gx", "gy", "dx_method", "dy_method", *GRADIENTS)


def gradients_at(points: DataFrame, gradients: DataFrame, grid: RegularGrid, lon: str = "lon", lat: str = "lat", prefix: str = "") -> DataFrame:
    """points with the gradients there (between cell centres) and sample_class: gradient_sample_direct at a centre, _interpolated, or _unavailable where a corner lacks its own."""
    near = lambda x: F.abs(x - F.round(x)) <= 1e-9
    direct = near((F.col(lon) - grid.lon_min) / grid.lon_step - 0.5) & near((F.col(lat) - grid.lat_min) / grid.lat_step - 0.5)
    out = bilinear_fields(points, gradients, grid, ["abs_g_perp", *(g for g in GRADIENTS if g != "abs_g_perp")], lon, lat)
    kind = F.when(F.col("abs_g_perp").isNull(), "gradient_sample_unavailable").when(direct, "gradient_sample_direct").otherwise("gradient_sample_interpolated")
    return out.withColumn("sample_class", kind).drop("status").withColumnsRenamed({c: f"{prefix}{c}" for c in (*GRADIENTS, "sample_class")} if prefix else {})


def gradient_context(fronts: DataFrame, gradients: DataFrame, grid: RegularGrid, keys: Sequence[str], search: float = 1.5, background: float = 3.0) -> DataFrame:
    """Of each front the largest abs_g_perp of a cell within search scales (local_max, how far, of equal ones the nearest), and the share of cells within background scales of its core that have no more than the front (percentile, n_background).

    fronts: keys, lon, lat, core_lon, core_lat, scale_km, abs_g_perp. To 12 digits.
    """
    steep = gradients.where("abs_g_perp is not null").select(grid.lon_center(F.col("lon_bin")).alias("lon"), grid.lat_center(F.col("lat_bin")).alias("lat"), F.round("abs_g_perp", 12).alias("g"))
    widest = fronts.agg(F.max("scale_km")).first()[0] or 1.0
    own = fronts.select(*keys, "scale_km", "lon", "lat")
    near = radius_join(own, steep, search * widest).where(F.col("km") <= search * F.col("scale_km"))
    best = near.groupBy(*keys).agg(F.max(F.struct(F.col("g_r").alias("g"), (-F.col("km")).alias("k"))).alias("best"))
    cores = fronts.select(*keys, "scale_km", F.col("core_lon").alias("lon"), F.col("core_lat").alias("lat"), F.round("abs_g_perp", 12).alias("own")).where("lon is not null")
    around = radius_join(cores, steep, background * widest).where(F.col("km") <= background * F.col("scale_km"))
    share = around.groupBy(*keys).agg(F.avg((F.col("g_r") <= F.col("own")).cast("double")).alias("percentile"), F.count("*").alias("n_background"))
    rows = fronts.join(best, list(keys), "left").join(share, list(keys), "left")
    return rows.withColumns({"local_max": F.col("best.g"), "local_max_km": -F.col("best.k"), "n_background": F.coalesce("n_background", F.lit(0))}).drop("best")


def nearby_contamination(cores: DataFrame, along: float = 2.0, cross: float = 3.0, keys: Sequence[str] = KEYS, component: str = "branch") -> DataFrame:
    """cores with contaminated: whether a core of another component lies within so many scales along and across the core's direction."""
    spots = cores.select(*dict.fromkeys([*keys, component]), "lon", "lat", "bearing", "scale_km")
    widest = cores.agg(F.max("scale_km")).first()[0] or 1.0
    other = cores.select(component, "lon", "lat").distinct()
    met = radius_join(spots, other, widest * (along * along + cross * cross) ** 0.5).where(F.col(component) != F.col(f"{component}_r"))
    turn = F.radians(angle_difference(F.col("bearing"), bearing("lon", "lat", "lon_r", "lat_r")))
    # To a millimetre, so that what lies on the edge is not told apart by rounding errors.
    inside = (F.abs(F.round(F.col("km") * F.cos(turn), 6)) <= along * F.col("scale_km")) & (F.abs(F.round(F.col("km") * F.sin(turn), 6)) <= cross * F.col("scale_km"))
    hit = met.where(inside | (F.col("km") == 0)).select(*keys).distinct().withColumn("__hit", F.lit(True))
    return cores.join(hit, list(keys), "left").withColumn("contaminated", F.coalesce("__hit", F.lit(False))).drop("__hit")


def canonical_fronts(cores: DataFrame, found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each core and side, from any number of results for it: medians of place, distance and drop, and a status.

    found: keys, side, lon, lat, distance_km, drop, relative_drop. status: side_not_observable, probable_transport_front or
    observable_no_retained_front; values are null but for the second.
    """
    columns = ["lon", "lat", "distance_km", "drop", "relative_drop"]
    sides = cores.select(*keys, F.col("lon").alias("core_lon"), F.col("lat").alias("core_lat"), "missing_side").withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    middle = found.groupBy(*keys, "side").agg(*(F.median(c).alias(c) for c in columns))
    rows = sides.join(middle, [*keys, "side"], "left")
    seen = ~((F.col("missing_side") == F.col("side")) | (F.col("missing_side") == "left_and_right"))
    front = seen & F.col("lon").isNotNull()
    status = F.when(~seen, "side_not_observable").when(front, "probable_transport_front").otherwise("observable_no_retained_front")
    return rows.select(*keys, "side", "core_lon", "core_lat", status.alias("status"), *(F.when(front, F.col(c)).alias(c) for c in columns))


def unique_fronts(found: DataFrame, medians: Sequence[str], limit: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each core and side with results: their number, medians, the spread of their distances and whether it exceeds limit scales.

    found: keys, side, segment, distance_km, scale_km, persists, contaminated, sample_class and medians. persists where half
    of the results do; contaminated where any is.
    """
    rows = found.groupBy(*keys, "side").agg(
        F.count("*").alias("records"),
        F.array_join(F.array_sort(F.collect_set(F.col("segment").cast("string"))), ";").alias("segments"),
        (F.max("distance_km") - F.min("distance_km")).alias("spread_km"),
        F.median("scale_km").alias("scale_km"),
        F.avg(F.col("persists").cast("double")).alias("persistence"),
        F.max("contaminated").alias("contaminated"),
        F.array_join(F.array_sort(F.collect_set("sample_class")), ";").alias("sample_classes"),
        F.max(F.col("abs_g_perp").isNotNull()).alias("gradient_observable"),
        *(F.median(c).alias(c) for c in medians),
    )
    apart = (F.col("records") > 1) & (F.col("spread_km") > limit * F.col("scale_km"))
    return rows.withColumns({"spread_scales": F.when(F.col("scale_km") > 0, F.col("spread_km") / F.col("scale_km")), "disagreement": apart, "persists": F.col("persistence") >= 0.5})

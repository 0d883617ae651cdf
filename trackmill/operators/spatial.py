"""Radius joins by tiles, region tests, nearest fields."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmill.functions.geo import RADIUS, delta_lon, haversine, wrap_lon
from trackmill.functions.geodesic import row_scales, wgs84_inverse
from trackmill.functions.grid import RegularGrid
from trackmill.operators.cleaning import micros
from trackmill.operators.coupling import _km, coupled_rows
from trackmill.operators.nearest import _unit
from trackmill.shared import materialize


#: Degrees of a tile that regions are dealt to.
TILE = 10.0
#: Height of a radius join's tile in radii: a place is copied to four tiles on average, where it took nine with 1.
SPAN = 2
#: Numbers of the largest matrix of points and segments in a task.
MATRIX = 1_000_000


def _tiles(df: DataFrame, km: float, widen: bool, radius: float = RADIUS) -> DataFrame:
    """Tile rows and columns of a position; with widen, of all tiles that the box of a circle of km around it meets.

    Tile rows are SPAN times km high; a row's tiles are as wide at its edge nearer to a pole, and the last column of a
    row stands beside its first. Rows at a pole are one tile, and a circle that holds a pole meets whole rows.
    """
    reach = math.degrees(km / radius) * (1 + 1e-9) + 1e-9
    high = SPAN * reach
    row = lambda y: F.floor((y + 90) / high).cast("long")
    lat = F.col("lat")
    rows = df.withColumn("tile_row", F.explode(F.sequence(row(lat - reach), row(lat + reach))) if widen else row(lat))
    edge = F.least(F.greatest(F.abs(F.col("tile_row") * high - 90), F.abs((F.col("tile_row") + 1) * high - 90)), F.lit(90.0))
    count = F.greatest(F.floor(360.0 * F.cos(F.radians(edge)) / high), F.lit(1)).cast("long")
    column = lambda x: F.floor((x + 180) / (360.0 / count)).cast("long")
    lon = wrap_lon(F.col("lon"))
    wide = F.when(F.abs(lat) + reach >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(min(reach, 90.0))) / F.cos(F.radians(lat))))) + 1e-9)
    first = column(lon - wide)
    near = F.array_distinct(F.transform(F.sequence(first, F.least(column(lon + wide), first + count - 1)), lambda c: F.pmod(c, count)))
    return rows.withColumn("tile_column", F.explode(near) if widen else F.pmod(column(lon), count))


def radius_join(left: DataFrame, right: DataFrame, km: float, on: tuple[str, ...] = (), radius: float = RADIUS) -> DataFrame:
    """All pairs of left and right rows (columns lon, lat) within km and equal in on; right's columns get _r; adds km.

    Left rows are dealt to one tile, right rows to the tiles around theirs: a pair meets once. Exact distance decides.
    """
    named = right.withColumnsRenamed({c: f"{c}_r" for c in right.columns if c not in on})
    r = _tiles(named.withColumns({"lon": F.col("lon_r"), "lat": F.col("lat_r")}), km, True, radius).drop("lon", "lat")
    met = _tiles(left, km, False, radius).join(r, [*on, "tile_row", "tile_column"])
    out = met.withColumn("km", haversine("lon", "lat", "lon_r", "lat_r", radius)).where(F.col("km") <= km)
    return out.drop("tile_row", "tile_column")


def cluster_strength(df: DataFrame, grid: RegularGrid, length_km: float, cutoff: float = 4.0, frame: str = "time", keys: tuple[str, ...] = ("trajectory",), order: str = "obs") -> DataFrame:
    """Sum of exp(-(d / L)^2) over a frame's particles within cutoff L of each cell centre that any particle ever visits; release_count: particles that start in the cell."""
    points = df.where("lon is not null and lat is not null")
    visited = grid.assign(points).select("lon_bin", "lat_bin", F.col("lon_center").alias("lon"), F.col("lat_center").alias("lat")).distinct()
    # Particles at one place of a frame count together before they are dealt to tiles.
    places = points.groupBy(frame, "lon", "lat").agg(F.count("*").alias("n"))
    met = radius_join(places, visited, cutoff * length_km)
    weight = F.sum(F.col("n") * F.exp(-F.pow(F.col("km") / length_km, 2)))
    found = met.groupBy(frame, F.col("lon_bin_r").alias("lon_bin"), F.col("lat_bin_r").alias("lat_bin")).agg(weight.alias("strength"), F.sum("n").alias("particles"))
    frames = points.select(frame).distinct()
    every = frames.crossJoin(visited.select("lon_bin", "lat_bin"))  # the result has a row for each of them
    first = points.groupBy(*keys).agg(F.min_by(F.struct("lon", "lat"), order).alias("p")).select("p.*")
    released = grid.assign(first).groupBy("lon_bin", "lat_bin").agg(F.count("*").alias("release_count"))
    out = every.join(found, [frame, "lon_bin", "lat_bin"], "left").join(released, ["lon_bin", "lat_bin"], "left")
    return out.withColumns({"strength": F.coalesce("strength", F.lit(0.0)), "particles": F.coalesce("particles", F.lit(0)), "release_count": F.coalesce("release_count", F.lit(0))})


def smooth_cells(cells: DataFrame, grid: RegularGrid, value: str, sigma_km: float, cutoff: float = 3.0, ellipsoid: bool = False) -> DataFrame:
    """Gaussian mean over cells with a value within cutoff sigma, weighted by cell area.

    On the sphere (areas go with the cosine of latitude), or on the WGS84 ellipsoid: candidates are then those within
    a hundredth more on the sphere, which no geodesic exceeds, and the geodesic decides.
    """
    rows = cells.where(F.col(value).isNotNull()).select("lon_bin", "lat_bin", F.col(value).alias("v"), grid.lon_center(F.col("lon_bin")).alias("lon"), grid.lat_center(F.col("lat_bin")).alias("lat"))
    area = F.cos(F.radians("lat_r"))
    if ellipsoid:
        near = radius_join(rows, rows, 1.01 * cutoff * sigma_km).drop("km")
        met = near.withColumn("km", wgs84_inverse("lon", "lat", "lon_r", "lat_r")["km"]).where(F.col("km") <= cutoff * sigma_km)
        scales = row_scales(cells.sparkSession, grid).select(F.col("lat_bin").alias("lat_bin_r"), "area_km2")  # a row for each row of the grid
        met, area = met.join(scales, "lat_bin_r"), F.col("area_km2")
    else:
        met = radius_join(rows, rows, cutoff * sigma_km)
    w = F.exp(-0.5 * F.pow(F.col("km") / sigma_km, 2)) * area
    return met.groupBy("lon_bin", "lat_bin").agg((F.sum(w * F.col("v_r")) / F.sum(w)).alias(f"{value}_smooth"))


def _nearest_within(km: float):
    """Of rows (time, tile, kind, lon, lat, row, key) in that order, a tile's targets (kind 0) before its points, each point with the nearest target's row within km.

    Of distances equal to a millimetre the first target is taken.
    """
    slack = 1.5e-6 / RADIUS  # chords are shorter than arcs

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, targets = None, [], None
        for batch in batches:
            time, row, column, kind = (batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("time", "tile_row", "tile_column", "kind"))
            lon, lat = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
            ends = np.flatnonzero((time[1:] != time[:-1]) | (row[1:] != row[:-1]) | (column[1:] != column[:-1])) + 1
            for a, b in zip([0, *ends], [*ends, len(time)], strict=True):
                if a == b:
                    continue
                if tile != (time[a], row[a], column[a]):
                    tile, held, targets = (time[a], row[a], column[a]), [], None
                points = a + int(np.count_nonzero(kind[a:b] == 0))
                if points > a:
                    held.append((lon[a:points].copy(), lat[a:points].copy(), batch.column("row").take(pa.array(np.arange(a, points)))))
                if points == b or not held:
                    continue
                if targets is None:
                    x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
                    targets = x, y, _unit(x, y), pa.concat_arrays([h[2] for h in held])
                x, y, unit, rows = targets
                step = max(1, MATRIX // len(x))
                for lo in range(points, b, step):
                    hi = min(b, lo + step)
                    near = _unit(lon[lo:hi], lat[lo:hi]) @ unit.T
                    best = near.max(1)
                    room = 1e-14 + slack * (np.sqrt(2 * np.maximum(0.0, 1 - best)) + 1e-7 + slack)
                    i, j = np.nonzero(near >= (best - room)[:, None])
                    apart = _km(lon[lo + i], lat[lo + i], x[j], y[j])
                    i, j, apart = (v[apart <= km] for v in (i, j, apart))
                    if not len(i):
                        continue
                    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                    shown = np.round(apart, 6)
                    tied = np.flatnonzero(shown == np.repeat(np.minimum.reduceat(shown, first), np.diff(np.append(first, len(i)))))
                    at = tied[np.append(True, i[tied][1:] != i[tied][:-1])]
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(lo + i[at])), rows.take(pa.array(j[at])), pa.array(np.minimum.reduceat(apart, first))], ["key", "row", "km"])

    return nearest


def nearest_field(points: DataFrame, field: DataFrame, columns: list[str], km: float, keys: list[str]) -> DataFrame:
    """Of field's rows at the same time within km, the nearest one's columns; null where there is none.

    Distances that are the same to a millimetre tie: then the smallest lon, lat and columns are taken.
    Points and the rows dealt to their tile pass as one sorted stream, so only a tile's field rows are held and no
    pair is sorted or moved.
    """
    here = "time is not null and lon is not null and lat is not null and not isnan(lon) and not isnan(lat)"
    placed = lambda df, *more: df.select("time", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), *more)
    row, key = F.struct("lon", "lat", *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))), F.struct(*keys, "time")
    f = _tiles(placed(field.where(here), row.alias("row")), km, True).withColumn("kind", F.lit(0))
    p = _tiles(placed(points.where(here), key.alias("key")), km, False).withColumn("kind", F.lit(1))
    tile = ["time", "tile_row", "tile_column"]
    met = f.unionByName(p, allowMissingColumns=True).select(*tile, "kind", "lon", "lat", "row", "key").repartition(*tile).sortWithinPartitions(*tile, "kind", "row")
    kinds = T.StructType([T.StructField("key", p.schema["key"].dataType), T.StructField("row", f.schema["row"].dataType), T.StructField("km", T.DoubleType())])
    found = met.mapInArrow(_nearest_within(km), kinds).select("key.*", "row", "km")
    best = found.groupBy(*keys, "time").agg(F.min_by("row", F.struct(F.round("km", 6), "row")).alias("f"), F.min("km").alias("km"))
    return points.join(best, [*keys, "time"], "left").select(*points.columns, *(F.col("f")[f"c{i}"].alias(c) for i, c in enumerate(columns)), "km")


def inside_polygon(lon: Column, lat: Column, polygon: Column) -> Column:
    """Whether a point is in a ring of (x, y) structs, edges included; even-odd rule as a fold over the edges."""
    n = F.size(polygon)
    index = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def step(acc: Column, i: Column) -> Column:
        a, b = F.element_at(polygon, i), F.element_at(polygon, F.when(i == n, F.lit(1)).otherwise(i + 1))
        cross = (b["x"] - a["x"]) * (lat - a["y"]) - (b["y"] - a["y"]) * (lon - a["x"])
        within = (lon >= F.least(a["x"], b["x"])) & (lon <= F.greatest(a["x"], b["x"])) & (lat >= F.least(a["y"], b["y"])) & (lat <= F.greatest(a["y"], b["y"]))
        crosses = ((a["y"] > lat) != (b["y"] > lat)) & (lon < (b["x"] - a["x"]) * (lat - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])
        return F.struct((acc["edge"] | ((cross == 0) & within)).alias("edge"), (acc["odd"] != F.coalesce(crosses, F.lit(False))).alias("odd"))

    start = F.struct(F.lit(False).alias("edge"), F.lit(False).alias("odd"))
    return F.when(n >= 3, F.aggregate(index, start, step, lambda acc: acc["edge"] | acc["odd"])).otherwise(F.lit(False))


def classify_points(points: DataFrame, regions: DataFrame, pick: str = "priority_max", keys: tuple[str, ...] = ("trajectory", "obs")) -> DataFrame:
    """points with label, numeric_label and n_regions of the regions that hold them (null and 0: none).

    regions: (label, numeric_label, priority, x0, x1, y0, y1, polygon), rings in the points' longitudes. Regions are
    dealt to the tiles that their boxes meet and joined with the points there, then box and ring are tested.
    pick: priority_max, priority_min, first or last, by (priority, numeric_label, label).
    """
    tile = lambda c: F.floor(c / TILE).cast("long")
    over = lambda a, b: F.explode(F.sequence(tile(F.col(a)), tile(F.col(b))))
    dealt = regions.withColumn("tile_x", over("x0", "x1")).withColumn("tile_y", over("y0", "y1"))
    box = (F.col("lon") >= F.col("x0")) & (F.col("lon") <= F.col("x1")) & (F.col("lat") >= F.col("y0")) & (F.col("lat") <= F.col("y1"))
    placed = points.where("lon is not null and lat is not null").select(*keys, "lon", "lat", tile(F.col("lon")).alias("tile_x"), tile(F.col("lat")).alias("tile_y"))
    held = placed.join(dealt, ["tile_x", "tile_y"]).where(box & inside_polygon(F.col("lon"), F.col("lat"), F.col("polygon")))
    name = F.struct("label", "numeric_label")
    order = {"priority_max": F.struct(-F.col("priority"), "numeric_label", "label"), "priority_min": F.struct("priority", "numeric_label", "label"), "first": F.struct("priority", "numeric_label", "label"), "last": F.struct(-F.col("priority"), -F.col("numeric_label"), "label")}[pick]
    best = held.groupBy(*keys).agg(F.min_by(name, order).alias("r"), F.count("*").alias("n_regions"))
    return points.join(best, list(keys), "left").select(*points.columns, F.col("r.label").alias("label"), F.col("r.numeric_label").alias("numeric_label"), F.coalesce("n_regions", F.lit(0)).alias("n_regions"))


def regions_from_rings(spark, rings: list[tuple]) -> DataFrame:
    """Region table from (label, numeric_label, priority, [(x, y), ...])."""
    rows = [(a, b, c, *(f(p[i] for p in ring) for i in (0, 1) for f in (min, max)), [(float(x), float(y)) for x, y in ring]) for a, b, c, ring in rings]
    return spark.createDataFrame([(a, b, c, float(x0), float(x1), float(y0), float(y1), r) for a, b, c, x0, x1, y0, y1, r in rows], "label string, numeric_label int, priority int, x0 double, x1 double, y0 double, y1 double, polygon array<struct<x: double, y: double>>")


def couple_trajectories(df: DataFrame, threshold_km: float, min_life_days: float = 0.0, regions: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """Pairs of trajectories from their closest common time on: (id1, id2, time, both positions, their centre and mean depth, km, group).

    Candidates are pairs at one time within the threshold (compared in blocks of neighbouring tracks); of a pair the closest time, the first on a
    tie (distances that are the same to a millimetre), starts the group, which needs two common times from there and
    min_life_days. regions (see classify_points): only times whose centre, to 1e-9 of a degree, lies in one of them may
    start a group. The centre's longitude is the circular mean. digits: km, closest_km, the centre's longitude and the
    depth are rounded to so many (halves away from 0), which takes Spark longer than all else here.
    """
    depth = F.col("z") if "z" in df.columns else F.lit(None).cast("double")
    points = df.where("lon is not null and lat is not null").select("trajectory", "time", "lon", "lat", depth.alias("z"))
    return coupled_rows(points, threshold_km, int(min_life_days * 86400 * 1_000_000), regions, digits)


def nearest_in_time(points: DataFrame, samples: DataFrame, value: str, keys: list[str], by: list[str]) -> DataFrame:
    """Of samples equal in by, the value nearest in time (the earlier on a tie) for each point; null where there is none."""
    order, back = Window.partitionBy(*by).orderBy("t", "kind", *keys), Window.partitionBy(*by).orderBy(*(F.desc(c) for c in ("t", "kind", *keys)))
    p = points.select(*by, *keys, micros().alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v"))
    s = samples.where(F.col(value).isNotNull()).select(*by, *(F.lit(None).cast(points.schema[k].dataType).alias(k) for k in keys), micros().alias("t"), F.lit(0).alias("kind"), F.col(value).cast("double").alias("v"))
    sample = F.when(F.col("kind") == 0, F.struct("t", "v"))
    rows = p.unionByName(s).withColumns({"before": F.last(sample, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "after": F.last(sample, True).over(back.rowsBetween(Window.unboundedPreceding, 0))}).where("kind = 1")
    earlier = F.col("after").isNull() | (F.col("t") - F.col("before.t") <= F.col("after.t") - F.col("t"))
    best = rows.select(*by, *keys, F.when(F.col("before").isNotNull() & earlier, F.col("before.v")).otherwise(F.col("after.v")).alias(f"nearest_{value}"))
    return points.join(best, [*by, *keys])


def sample_observations(points: DataFrame, samples: DataFrame, value: str, by: list[str], keys: list[str], index: str = "observation_index") -> DataFrame:
    """Of samples equal in by (platform and depth bin), the value nearest in time, then in pressure, then first by index.

    points: (by, keys, time, pressure), samples: (by, index, time, pressure, value). The nearest times come from one
    pass over both, and only the samples of those times are joined. Points without a sample have nulls; rows
    (by, keys, value, sample_days, sample_pressure): the differences to what was taken.
    """
    known = samples.where(F.col(value).isNotNull() & F.col("time").isNotNull()).select(*by, F.col(index).alias("__i"), micros().alias("__t"), F.col("pressure").alias("__p"), F.col(value).alias("__v"))
    order, back = Window.partitionBy(*by).orderBy("t", "kind"), Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("kind"))
    p = points.select(*by, *keys, micros().alias("t"), F.lit(1).alias("kind"), "pressure")
    s = known.select(*by, *(F.lit(None).cast(points.schema[k].dataType).alias(k) for k in keys), F.col("__t").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("pressure"))
    time = F.when(F.col("kind") == 0, F.col("t"))
    # Samples stand before the points of their time, so one at the same time is the last before.
    near = p.unionByName(s).withColumns({"before": F.last(time, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "after": F.last(time, True).over(back.rowsBetween(Window.unboundedPreceding, 0))}).where("kind = 1")
    least = F.least(F.col("t") - F.col("before"), F.col("after") - F.col("t"))
    times = F.array_distinct(F.array_compact(F.array(F.when(F.col("t") - F.col("before") == least, F.col("before")), F.when(F.col("after") - F.col("t") == least, F.col("after")))))
    met = near.select(*by, *keys, "t", "pressure", F.explode(times).alias("__t")).join(known, [*by, "__t"])
    apart = F.abs(F.col("__p") - F.col("pressure"))
    best = met.groupBy(*by, *keys).agg(F.min_by(F.struct("__v", F.abs(F.col("__t") - F.col("t")).alias("dt"), apart.alias("dp")), F.struct(F.coalesce(apart, F.lit(float("inf"))), "__i")).alias("b"))
    return points.select(*by, *keys).join(best, [*by, *keys], "left").select(*by, *keys, F.col("b.__v").alias(value), (F.col("b.dt") / 86400e6).alias("sample_days"), F.col("b.dp").alias("sample_pressure"))


def _segments_near(ends: DataFrame, reach: float, size: float) -> DataFrame:
    """Segments in all tiles of size degrees that hold a place less than reach degrees off (longitudes as shortened there).

    Each row of tiles takes the piece of a segment that lies within reach of it, widened for the row's edge nearer to a pole.
    """
    reach = reach + 1e-9
    y0, y1, x0, x1 = (F.col(c) for c in ("y0", "y1", "x0", "x1"))
    tile = lambda c: F.floor(c / size).cast("long")
    rows = ends.withColumn("tile_y", F.explode(F.sequence(tile(F.least(y0, y1) - reach), tile(F.greatest(y0, y1) + reach))))
    low, top = F.col("tile_y") * size, (F.col("tile_y") + 1) * size
    share = lambda y: F.when(y1 == y0, F.lit(None)).otherwise((y - y0) / (y1 - y0))
    a, b = share(low - reach), share(top + reach)
    bound = lambda x, other: F.least(F.greatest(F.coalesce(x, F.lit(other)), F.lit(0.0)), F.lit(1.0))
    xa, xb = x0 + bound(F.least(a, b), 0.0) * (x1 - x0), x0 + bound(F.greatest(a, b), 1.0) * (x1 - x0)
    edge = F.least(F.lit(89.5), F.greatest(F.abs(low), F.abs(top)))
    wide = F.when(F.greatest(F.abs(low), F.abs(top)) > 89.0, 180.0).otherwise(F.least(reach / F.cos(F.radians(edge)), F.lit(180.0))) + 1e-9
    turns = round(360 / size)
    first = tile(F.least(xa, xb) - wide)
    columns = F.array_distinct(F.transform(F.sequence(first, F.least(tile(F.greatest(xa, xb) + wide), first + turns - 1)), lambda c: F.pmod(c, F.lit(turns))))
    return rows.withColumn("tile_x", F.explode(columns))


def _nearest_of(reach: float):
    """Of rows (tile, kind, line, x0, y0, x1, y1) in that order, points (kind 0, at x0, y0) before segments, each point with the nearest segment of its tile within reach degrees, and the share of its way.

    Of segments equally near to 1e-9 of a degree the first is taken: kept are those that were the nearest so far.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, spots, places, found = None, [], None, []

        def settled() -> pa.RecordBatch | None:
            if not found:
                return None
            point, off, share, *rows = (np.concatenate(x) for x in zip(*(f[:7] for f in found), strict=True))
            lines = pa.concat_arrays([f[7] for f in found])
            lon, lat, least = places[0], places[1], places[3]
            keep = np.flatnonzero(off <= least[point] + 1e-9)
            _, first = np.unique(point[keep], return_index=True)
            at = keep[first]
            return pa.RecordBatch.from_arrays([pa.array(lon[point[at]]), pa.array(lat[point[at]]), lines.take(pa.array(at)), *(pa.array(v[at]) for v in (*rows, share))], ["lon", "lat", "line", "x0", "y0", "x1", "y1", "s"])

        for batch in batches:
            ty, tx, kind, x0, y0, x1, y1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile_y", "tile_x", "kind", "x0", "y0", "x1", "y1"))
            ends = np.flatnonzero((ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])) + 1
            for a, b in zip([0, *ends], [*ends, len(ty)], strict=True):
                if a == b:
                    continue
                if tile != (ty[a], tx[a]):
                    if (out := settled()) is not None:
                        yield out
                    tile, spots, places, found = (ty[a], tx[a]), [], None, []
                points = a + int(np.count_nonzero(kind[a:b] == 0))
                if points > a:
                    spots.append((x0[a:points].copy(), y0[a:points].copy()))
                if points == b or not spots:
                    continue
                if places is None:
                    lon, lat = (np.concatenate(x) for x in zip(*spots, strict=True))
                    places = lon, lat, np.cos(np.radians(lat)), np.full(len(lon), np.inf)
                lon, lat, short, least = places
                step = max(1, MATRIX // (b - points))
                dx0, dy = x1[points:b] - x0[points:b], y1[points:b] - y0[points:b]
                for lo in range(0, len(lon), step):
                    mine = slice(lo, min(len(lon), lo + step))
                    turn = x0[points:b] - lon[mine, None] + 180.0
                    ax, ay = (turn - np.floor(turn / 360.0) * 360.0 - 180.0) * short[mine, None], y0[points:b] - lat[mine, None]
                    dx = dx0 * short[mine, None]
                    way = dx * dx + dy * dy
                    with np.errstate(all="ignore"):
                        s = np.where(way > 0, np.clip(-(ax * dx + ay * dy) / way, 0.0, 1.0), 0.0)
                    off = np.sqrt((ax + s * dx) ** 2 + (ay + s * dy) ** 2)
                    off = np.where(off <= reach, off, np.inf)
                    best = off.min(1)
                    near = np.flatnonzero(best < least[mine])
                    if not len(near):
                        continue
                    i, j = np.nonzero(off[near] <= best[near, None] + 1e-9)
                    i = near[i]
                    # Behind one that is as near, no other is ever taken.
                    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                    leads = np.repeat(first, np.diff(np.append(first, len(i))))
                    keep = (leads == np.arange(len(i))) | (off[i, j] < off[i[leads], j[leads]])
                    i, j = i[keep], j[keep]
                    at = points + j
                    found.append((lo + i, off[i, j], s[i, j], x0[at], y0[at], x1[at], y1[at], batch.column("line").take(pa.array(at))))
                    least[lo + near] = best[near]
        if (out := settled()) is not None:
            yield out

    return nearest


def nearest_on_lines(points: DataFrame, lines: DataFrame, km: float, keys: list[str], line: str = "line", order: str = "place") -> DataFrame:
    """Of each point the nearest place on any line within about km: (keys, line, line_lon, line_lat, km); nulls where none is near.

    lines: (line, place, lon, lat), in order of place; a step that crosses the antimeridian is the short way. Segments
    are dealt to the tiles that they come near to, and points to their own, each place once: first those within a
    quarter of km, then, for places that have none there, the others to large tiles. A tile's points and then its segments pass as a
    sorted stream, so only its points are held; of places equally near to 1e-9 of a degree the segment
    with the smallest line, x0, y0 is taken. The place is found in the plane of the point (degrees
    of longitude shortened by its latitude), its distance on the ellipsoid.
    """
    w = Window.partitionBy(line).orderBy(order)
    ends = lines.select(line, F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.lead("lon").over(w).alias("x1"), F.lead("lat").over(w).alias("y1")).where("x1 is not null")
    ends = materialize(ends.select(F.col(line).alias("line"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0")), (F.col("x0") + delta_lon("x0", "x1")).alias("x1"), F.col("y1").cast("double").alias("y1")), "lines-ends")
    high = math.degrees(km / RADIUS)
    columns = ("tile_y", "tile_x", "kind", "line", "x0", "y0", "x1", "y1")
    found = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), ends.schema["line"], *(T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1", "s"))])
    left = materialize(points.where("lon is not null and lat is not null").select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).distinct(), "lines-points")
    settled = []
    for reach in (high / 4, high):
        turns = max(36, min(1440, math.floor(360 / high))) if reach < high else round(360 / TILE)
        size = 360 / turns
        tile = lambda c: F.floor(c / size).cast("long")  # noqa: B023, E731
        placed = left.withColumns({"tile_x": F.pmod(tile(F.col("lon")), F.lit(turns)), "tile_y": tile(F.col("lat"))})
        asks = placed.select("tile_y", "tile_x", F.lit(0).alias("kind"), F.lit(None).cast(ends.schema["line"].dataType).alias("line"), F.col("lon").alias("x0"), F.col("lat").alias("y0"), *(F.lit(None).cast("double").alias(c) for c in ("x1", "y1")))
        dealt = _segments_near(ends, reach, size).withColumn("kind", F.lit(1))
        if reach == high:  # a row for each large tile at most
            dealt = dealt.join(F.broadcast(placed.select("tile_y", "tile_x").distinct()), ["tile_y", "tile_x"], "left_semi")
        met = asks.unionByName(dealt.select(*columns)).repartition("tile_y", "tile_x").sortWithinPartitions(*columns[:6])
        y = F.col("y0") + F.col("s") * (F.col("y1") - F.col("y0"))
        near = met.mapInArrow(_nearest_of(reach), found).select("lon", "lat", F.col("line").alias(line), wrap_lon(F.col("x0") + F.col("s") * (F.col("x1") - F.col("x0"))).alias("line_lon"), y.alias("line_lat"))
        settled.append(materialize(near, "lines-near"))
        if reach < high:
            # Files of few distinct numbers are small, their rows are not: nothing is broadcast by its files' size.
            left = materialize(left.join(settled[0].select("lon", "lat").hint("merge"), ["lon", "lat"], "left_anti"), "lines-left")
    apart = settled[0].unionByName(settled[1]).withColumn("km", wgs84_inverse("lon", "lat", "line_lon", "line_lat")["km"])
    return points.select(*keys, "lon", "lat").join(apart.hint("merge"), ["lon", "lat"], "left").drop("lon", "lat")

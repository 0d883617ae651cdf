"""Statistics of a sparse cell-to-cell transition matrix, and structures built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import angle_difference, axial_mismatch, bearing, floor_mod, haversine, planar_inverse
from trackmill.functions.geodesic import row_scales
from trackmill.functions.grid import RegularGrid
from trackmill.operators.graph import connected_components
from trackmill.operators.transitions import COUNTS

START, END = ["start_lon_bin", "start_lat_bin"], ["end_lon_bin", "end_lat_bin"]
CELL = ["lon_bin", "lat_bin"]


def displaced(matrix: DataFrame, geometry: str = "geographic") -> DataFrame:
    """Adds cell ids' moves: distance, bearing, dx and dy (east, north), stay."""
    a, b = ("start_lon_center", "start_lat_center"), ("end_lon_center", "end_lat_center")
    if geometry == "cartesian":
        d, angle = planar_inverse(*a, *b)
    else:
        d, angle = haversine(*a, *b), bearing(*a, *b)
    stay = (F.col(START[0]) == F.col(END[0])) & (F.col(START[1]) == F.col(END[1]))
    angle = F.when(~stay, angle)
    r = F.radians(F.coalesce(angle, F.lit(0.0)))
    return matrix.withColumns({"stay": stay, "distance": F.when(stay, 0.0).otherwise(d), "bearing": angle}).withColumns({"dx": F.col("distance") * F.sin(r), "dy": F.col("distance") * F.cos(r)})


def validate_transitions(matrix: DataFrame, grid: RegularGrid) -> DataFrame:
    """One row of counts of faults; all zero for a valid matrix."""
    bad = lambda c: F.sum(F.coalesce(c, F.lit(True)).cast("long"))
    n, p = F.col("transition_count"), F.col("transition_probability")
    off = F.lit(False)
    for s in ("start", "end"):
        off = off | (F.col(f"{s}_lon_bin") < 0) | (F.col(f"{s}_lon_bin") >= grid.nx) | (F.col(f"{s}_lat_bin") < 0) | (F.col(f"{s}_lat_bin") >= grid.ny)
    shifted = F.lit(False)
    for s in ("start", "end"):
        shifted = shifted | (F.abs(F.col(f"{s}_lon_center") - grid.lon_center(F.col(f"{s}_lon_bin"))) > 1e-9) | (F.abs(F.col(f"{s}_lat_center") - grid.lat_center(F.col(f"{s}_lat_bin"))) > 1e-9)
    w = Window.partitionBy(*START)
    rows = matrix.withColumns({"__n": F.sum("transition_count").over(w), "__p": F.sum("transition_probability").over(w), "__k": F.count("*").over(Window.partitionBy(*COUNTS))})
    return rows.agg(F.count("*").alias("rows"), bad(n <= 0).alias("bad_count"), bad((p < 0) | (p > 1)).alias("bad_probability"), bad(off).alias("outside"), bad(shifted).alias("bad_center"), bad(F.col("__k") > 1).alias("repeated"), bad(F.abs(F.col("__p") - 1) > 1e-9).alias("bad_sum"), bad(F.abs(p - n / F.nullif(F.col("__n"), F.lit(0))) > 1e-9).alias("bad_share"))


def support_fields(matrix: DataFrame) -> DataFrame:
    """A row for each cell that anything leaves or enters: counts out and in, of all and of moves, stays, distinct ends, shares."""
    stay = (F.col(START[0]) == F.col(END[0])) & (F.col(START[1]) == F.col(END[1]))
    n, moved = F.col("transition_count"), F.when(~stay, F.col("transition_count")).otherwise(0)
    out = matrix.groupBy(*(F.col(a).alias(b) for a, b in zip(START, CELL, strict=True))).agg(F.sum(n).alias("n_out"), F.sum(moved).alias("n_out_move"), F.sum(F.when(stay, n).otherwise(0)).alias("n_stay"), F.count(F.when(~stay, 1)).alias("destinations"))
    into = matrix.groupBy(*(F.col(a).alias(b) for a, b in zip(END, CELL, strict=True))).agg(F.sum(n).alias("n_in"), F.sum(moved).alias("n_in_move"), F.count(F.when(~stay, 1)).alias("sources"))
    cells = out.join(into, CELL, "full").fillna(0)
    return cells.withColumns({"p_stay": F.when(F.col("n_out") > 0, F.col("n_stay") / F.col("n_out")), "p_move": F.when(F.col("n_out") > 0, F.col("n_out_move") / F.col("n_out"))})


def outward_moments(matrix: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9), geometry: str = "geographic") -> DataFrame:
    """Mean displacement of all steps and of moves, mean bearing, and count-weighted quantiles of the distance moved (lower step rule)."""
    rows = displaced(matrix, geometry)
    n = F.col("transition_count")
    moved = F.when(~F.col("stay"), n).otherwise(0)
    mean = lambda c, w: F.sum(w * F.col(c)) / F.nullif(F.sum(w), F.lit(0))
    cells = rows.groupBy(*START).agg(F.sum(n).alias("n_out"), F.sum(moved).alias("n_move"), mean("dx", n).alias("dx_all"), mean("dy", n).alias("dy_all"), mean("dx", moved).alias("dx_move"), mean("dy", moved).alias("dy_move"), mean("distance", moved).alias("distance_move"))
    angle = floor_mod(F.degrees(F.atan2("dx_move", "dy_move")), 360.0)
    cells = cells.withColumn("bearing_move", F.when((F.col("dx_move") != 0) | (F.col("dy_move") != 0), angle))
    order = Window.partitionBy(*START).orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
    ranked = rows.where("not stay").withColumns({"__c": F.sum("transition_count").over(order), "__n": F.sum("transition_count").over(Window.partitionBy(*START))})
    quantile = ranked.groupBy(*START).agg(*(F.min(F.when(F.col("__c") >= q * F.col("__n"), F.col("distance"))).alias(f"distance_q{round(q * 100)}") for q in quantiles))
    return cells.join(quantile, START, "left")


def harmonics(matrix: DataFrame, incoming: bool = False, bins: int = 36, geometry: str = "geographic") -> DataFrame:
    """First and second circular moments of moves out of a cell (or into it): R1, R2, their angles, entropy of direction and effective bins.

    A step into a cell has its bearing on arrival, the reverse of that back to its start.
    """
    rows = displaced(matrix, geometry).where("not stay")
    keys, angle = START, F.col("bearing")
    if incoming:
        keys = END
        if geometry != "cartesian":
            angle = floor_mod(bearing("end_lon_center", "end_lat_center", "start_lon_center", "start_lat_center") + 180.0, 360.0)
    rows = rows.withColumn("a", angle).where("a is not null").withColumn("w", F.col("transition_count") / F.sum("transition_count").over(Window.partitionBy(*keys)))
    r = F.radians("a")
    moments = rows.groupBy(*keys).agg(F.sum("transition_count").alias("n_move"), *(F.sum(F.col("w") * f(k * r)).alias(f"{x}{k}") for k in (1, 2) for x, f in (("c", F.cos), ("s", F.sin))))
    out = moments.select(*keys, "n_move", F.sqrt(F.col("c1") ** 2 + F.col("s1") ** 2).alias("r1"), F.sqrt(F.col("c2") ** 2 + F.col("s2") ** 2).alias("r2"), floor_mod(F.degrees(F.atan2("s1", "c1")), 360.0).alias("theta1"), floor_mod(F.degrees(F.atan2("s2", "c2")) / 2, 180.0).alias("theta2"))
    binned = rows.groupBy(*keys, F.floor(F.col("a") / (360.0 / bins)).alias("b")).agg(F.sum("w").alias("p"))
    spread = binned.groupBy(*keys).agg(F.sum(-F.col("p") * F.log("p")).alias("direction_entropy"))
    return out.join(spread, keys).withColumn("effective_bins", F.exp("direction_entropy")).withColumnsRenamed(dict(zip(keys, CELL, strict=True)))


def directional_vectors(matrix: DataFrame, geometry: str = "geographic") -> DataFrame:
    """Per cell: coherence vector of moves (R1 along theta1), and that of all steps (times the share of moves); zero without moves."""
    cells = support_fields(matrix).where("n_out > 0").join(harmonics(matrix, geometry=geometry).select(*CELL, "r1", "theta1"), CELL, "left")
    r1, t = F.coalesce("r1", F.lit(0.0)), F.radians(F.coalesce("theta1", F.lit(0.0)))
    return cells.select(*CELL, "p_move", (r1 * F.sin(t)).alias("x_move"), (r1 * F.cos(t)).alias("y_move"), (F.col("p_move") * r1 * F.sin(t)).alias("x_all"), (F.col("p_move") * r1 * F.cos(t)).alias("y_all"))


def cell_id(grid: RegularGrid, lon_bin: Column | str = "lon_bin", lat_bin: Column | str = "lat_bin") -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return col(lat_bin) * grid.nx + col(lon_bin)


def neighbours8(cells: DataFrame, grid: RegularGrid, half: bool = False) -> DataFrame:
    """Rows (lon_bin, lat_bin, dx, dy, n_lon_bin, n_lat_bin) of the neighbours inside the grid; half: each pair once."""
    steps = [(1, 0), (-1, 1), (0, 1), (1, 1)] + ([] if half else [(-1, 0), (1, -1), (0, -1), (-1, -1)])
    offset = F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in steps)))
    rows = cells.select(*CELL, offset.alias("o")).select(*CELL, "o.dx", "o.dy", (F.col("lon_bin") + F.col("o.dx")).alias("n_lon_bin"), (F.col("lat_bin") + F.col("o.dy")).alias("n_lat_bin"))
    if grid.periodic:
        rows = rows.withColumn("n_lon_bin", F.pmod("n_lon_bin", F.lit(grid.nx)))
    return rows.where((F.col("n_lon_bin") >= 0) & (F.col("n_lon_bin") < grid.nx) & (F.col("n_lat_bin") >= 0) & (F.col("n_lat_bin") < grid.ny))


def with_neighbours(cells: DataFrame, grid: RegularGrid, columns: list[str], half: bool = False) -> DataFrame:
    """Pairs of neighbouring cells that are both in cells; the neighbour's columns get n_."""
    pairs = neighbours8(cells, grid, half).join(cells.select(*CELL, *columns), CELL)
    other = cells.select(*(F.col(c).alias(f"n_{c}") for c in (*CELL, *columns)))
    return pairs.join(other, [f"n_{c}" for c in CELL])


def neighbour_consistency(cells: DataFrame, grid: RegularGrid, angle: str = "theta1", least: int = 2) -> DataFrame:
    """Mean cosine of the differences of direction to neighbours that have one; null with fewer than least."""
    met = with_neighbours(cells.where(F.col(angle).isNotNull()), grid, [angle])
    return met.groupBy(*CELL).agg(F.count("*").alias("neighbours"), F.avg(F.cos(F.radians(F.col(angle) - F.col(f"n_{angle}")))).alias("consistency")).withColumn("consistency", F.when(F.col("neighbours") >= least, F.col("consistency")))


def compatible_edges(cells: DataFrame, grid: RegularGrid, max_turn: float, max_off_axis: float, angle: str = "theta1") -> DataFrame:
    """Neighbouring cells whose directions differ little and that lie along both directions: (src, dst) cell ids."""
    met = with_neighbours(cells.where(F.col(angle).isNotNull()), grid, [angle], half=True)
    step = floor_mod(F.degrees(F.atan2(F.col("dx") * F.lit(grid.lon_step), F.col("dy") * F.lit(grid.lat_step))), 360.0)
    fits = (F.abs(angle_difference(F.col(angle), F.col(f"n_{angle}"))) <= max_turn) & (axial_mismatch(step, F.col(angle)) <= max_off_axis) & (axial_mismatch(step, F.col(f"n_{angle}")) <= max_off_axis)
    return met.where(fits).select(cell_id(grid).alias("src"), cell_id(grid, "n_lon_bin", "n_lat_bin").alias("dst"))


def directional_corridors(matrix: DataFrame, grid: RegularGrid, min_count: int = 5, min_r1: float = 0.3, max_turn: float = 45.0, max_off_axis: float = 60.0, min_cells: int = 3, geometry: str = "geographic") -> DataFrame:
    """Cells of coherent transport in connected corridors of min_cells or more: (lon_bin, lat_bin, r1, theta1, component, cells)."""
    strong = harmonics(matrix, geometry=geometry).where((F.col("n_move") >= min_count) & (F.col("r1") >= min_r1))
    parts = connected_components(compatible_edges(strong, grid, max_turn, max_off_axis))
    sized = parts.join(parts.groupBy("component").agg(F.count("*").alias("cells")).where(F.col("cells") >= min_cells), "component")
    return strong.withColumn("node", cell_id(grid)).join(sized, "node").select(*CELL, "n_move", "r1", "theta1", "component", "cells")


def component_stats(cells: DataFrame, grid: RegularGrid, value: str) -> DataFrame:
    """Size, span, circular mean longitude, mean and median of a value, and ranks (1 is largest) of components."""
    lon = F.radians(grid.lon_center(F.col("lon_bin")))
    rows = cells.groupBy("component").agg(F.count("*").alias("cells"), (F.max("lat_bin") - F.min("lat_bin") + 1).alias("lat_span"), F.degrees(F.atan2(F.sum(F.sin(lon)), F.sum(F.cos(lon)))).alias("lon_mean"), F.avg(grid.lat_center(F.col("lat_bin"))).alias("lat_mean"), F.avg(value).alias("value_mean"), F.median(value).alias("value_median"))
    turned = cells.select("component", F.pmod(grid.lon_center(F.col("lon_bin")), F.lit(360.0)).alias("x")).distinct()
    w = Window.partitionBy("component")
    gaps = turned.withColumn("gap", F.coalesce(F.lead("x").over(w.orderBy("x")), F.min("x").over(w) + 360.0) - F.col("x"))
    rows = rows.join(gaps.groupBy("component").agg((360.0 - F.max("gap")).alias("lon_span")), "component")
    # One row for each component reaches the ranks; equal ones share the smallest rank, and nulls come last.
    ranks = {"cells": "cells", "value": "value_mean", "median": "value_median", "lat_span": "lat_span", "lon_span": "lon_span"}
    return rows.withColumns({f"rank_{k}": F.rank().over(Window.orderBy(F.desc_nulls_last(c))) for k, c in ranks.items()})


def n_hop(edges: DataFrame, k: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """Pairs of nodes at most k steps apart, with the number of steps."""
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).where("a != b").distinct()
    reached = both.withColumn("hops", F.lit(1))
    for i in range(2, k + 1):
        further = reached.where(F.col("hops") == i - 1).join(both.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).where("a != b").distinct()
        reached = reached.unionByName(further.join(reached.select("a", "b"), ["a", "b"], "left_anti").withColumn("hops", F.lit(i)))
    return reached


def degrees_of(edges: DataFrame) -> DataFrame:
    """Number of neighbours of each node."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()
    return both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def component_classes(edges: DataFrame) -> DataFrame:
    """Of each component: nodes, edges, ends and junctions, and whether it is a path, a loop or a network of junctions."""
    parts, degree = connected_components(edges), degrees_of(edges)
    rows = parts.join(degree, "node", "left").fillna(0, ["degree"]).groupBy("component").agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.count(F.when(F.col("degree") == 1, 1)).alias("ends"), F.count(F.when(F.col("degree") > 2, 1)).alias("junctions"))
    kind = F.when(F.col("nodes") == 1, "isolated").when(F.col("junctions") > 0, "network").when(F.col("ends") == 2, "path").otherwise("loop")
    return rows.withColumn("kind", kind)


def transverse_ridges(cells: DataFrame, grid: RegularGrid, value: str, angle: str = "theta1") -> DataFrame:
    """Cells whose value is that of both flanks (neighbours nearest to across the direction) or more; one flank is enough where the other has none."""
    met = with_neighbours(cells.where(F.col(angle).isNotNull() & F.col(value).isNotNull()), grid, [value, angle])
    step = floor_mod(F.degrees(F.atan2(F.col("dx") * F.lit(grid.lon_step), F.col("dy") * F.lit(grid.lat_step))), 360.0)
    side = angle_difference(F.col(angle), step)
    flank = F.when(F.abs(side - 90) <= 22.5, "right").when(F.abs(side + 90) <= 22.5, "left")
    best = met.withColumn("side", flank).where("side is not null").groupBy(*CELL, value).agg(F.max(F.when(F.col("side") == "left", F.col(f"n_{value}"))).alias("left"), F.max(F.when(F.col("side") == "right", F.col(f"n_{value}"))).alias("right"))
    high = (F.col(value) >= F.coalesce("left", "right")) & (F.col(value) >= F.coalesce("right", "left"))
    return best.withColumn("ridge", high).withColumn("status", F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), "both").otherwise("one_side"))


def sphere_gradients(cells: DataFrame, grid: RegularGrid, value: str, radius: float = 6371.0, ellipsoid: bool = False) -> DataFrame:
    """Gradient of a cell value per km east and north, on the sphere or the WGS84 ellipsoid: centred, else one-sided; the magnitude needs both."""
    rows = cells.where(F.col(value).isNotNull()).select(*CELL, F.col(value).alias("v"))
    met = with_neighbours(rows, grid, ["v"]).where("dx = 0 or dy = 0")
    pick = lambda x, y: F.max(F.when((F.col("dx") == x) & (F.col("dy") == y), F.col("n_v")))
    sides = met.groupBy(*CELL, "v").agg(pick(1, 0).alias("e"), pick(-1, 0).alias("w"), pick(0, 1).alias("n"), pick(0, -1).alias("s"))
    km_y = math.radians(grid.lat_step) * radius
    km_x = F.radians(F.lit(grid.lon_step)) * radius * F.cos(F.radians(grid.lat_center(F.col("lat_bin"))))

    def slope(a: str, b: str, km) -> Column:
        steps = F.col(a).isNotNull().cast("int") + F.col(b).isNotNull().cast("int")
        return F.when(steps > 0, (F.coalesce(a, "v") - F.coalesce(b, "v")) / (steps * km))

    gy = slope("n", "s", F.lit(km_y))
    if ellipsoid:
        scales = row_scales(cells.sparkSession, grid)  # a row for each row of the grid
        below = scales.select((F.col("lat_bin") + 1).alias("lat_bin"), F.col("km_y").alias("km_s"))
        sides = sides.join(scales.select("lat_bin", "km_x", F.col("km_y").alias("km_n")), "lat_bin").join(below, "lat_bin", "left")
        km_x = F.col("km_x")
        apart = F.when(F.col("n").isNotNull(), F.col("km_n")).otherwise(0.0) + F.when(F.col("s").isNotNull(), F.col("km_s")).otherwise(0.0)
        gy = F.when(apart > 0, (F.coalesce("n", "v") - F.coalesce("s", "v")) / apart)
    out = sides.withColumns({"gx": slope("e", "w", km_x), "gy": gy})
    return rows.join(out.select(*CELL, "gx", "gy"), CELL, "left").withColumn("magnitude", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))


def displacement_ellipse(matrix: DataFrame, geometry: str = "geographic") -> DataFrame:
    """Of each start's moves: mean, covariance and the axes and direction of its ellipse (closed form for two dimensions)."""
    rows = displaced(matrix, geometry).where("not stay")
    n = F.col("transition_count")
    s = rows.groupBy(*START).agg(F.sum(n).alias("n"), *((F.sum(n * c) / F.sum(n)).alias(k) for k, c in {"mx": F.col("dx"), "my": F.col("dy"), "xx": F.col("dx") ** 2, "yy": F.col("dy") ** 2, "xy": F.col("dx") * F.col("dy")}.items()))
    s = s.withColumns({"var_x": F.greatest(F.col("xx") - F.col("mx") ** 2, F.lit(0.0)), "var_y": F.greatest(F.col("yy") - F.col("my") ** 2, F.lit(0.0)), "cov": F.col("xy") - F.col("mx") * F.col("my")})
    half, gap = (F.col("var_x") + F.col("var_y")) / 2, F.sqrt(((F.col("var_x") - F.col("var_y")) / 2) ** 2 + F.col("cov") ** 2)
    out = s.withColumns({"major": F.sqrt(half + gap), "minor": F.sqrt(F.greatest(half - gap, F.lit(0.0)))})
    axis = floor_mod(F.degrees(0.5 * F.atan2(2 * F.col("cov"), F.col("var_y") - F.col("var_x"))), 180.0)
    return out.withColumns({"axis": axis, "anisotropy": F.when(F.col("major") > 0, 1 - F.col("minor") / F.col("major"))}).drop("xx", "yy", "xy")


def structure_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells in both of two structures, in one of them, by component of the first: overlap counts and share."""
    left, right = a.select(*CELL, F.col("component").alias("ca")).distinct(), b.select(*CELL, F.col("component").alias("cb")).distinct()
    met = left.join(right, CELL, "full")
    kind = F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), "both").when(F.col("ca").isNotNull(), "first").otherwise("second")
    return met.withColumn("kind", kind).groupBy("ca", "kind").agg(F.count("*").alias("cells"))


def component_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of each two components of two structures with a cell in common: the cells, and their share of either component."""
    left, right = a.select(*CELL, F.col("component").alias("ca")).distinct(), b.select(*CELL, F.col("component").alias("cb")).distinct()
    met = left.join(right, CELL).groupBy("ca", "cb").agg(F.count("*").alias("cells"))
    sized = met.join(left.groupBy("ca").agg(F.count("*").alias("na")), "ca").join(right.groupBy("cb").agg(F.count("*").alias("nb")), "cb")
    return sized.select("ca", "cb", "cells", (F.col("cells") / F.col("na")).alias("share_a"), (F.col("cells") / F.col("nb")).alias("share_b"))


def turn_fields(matrix: DataFrame, geometry: str = "geographic") -> DataFrame:
    """Of each cell with moves in and out: the turn from the mean direction of arrival to that of departure, its cosine (alignment), and the coherent share of moves that leave."""
    out = harmonics(matrix, geometry=geometry).select(*CELL, F.col("n_move").alias("n_out_move"), F.col("r1").alias("r1_out"), F.col("theta1").alias("theta_out"))
    into = harmonics(matrix, True, geometry=geometry).select(*CELL, F.col("n_move").alias("n_in_move"), F.col("r1").alias("r1_in"), F.col("theta1").alias("theta_in"))
    met = out.join(into, CELL).withColumn("turn", angle_difference("theta_in", "theta_out"))
    return met.withColumns({"alignment": F.cos(F.radians("turn")), "coherent_out": F.col("n_out_move") * F.col("r1_out")})


def seed_family(points: DataFrame, lon_min: float, lon_max: float, lat_min: float, lat_max: float, component: str = "component") -> DataFrame:
    """points with seed_family: whether any point of their component lies in a box (lon_min above lon_max: across the antimeridian)."""
    lon = (F.col("lon") >= lon_min) & (F.col("lon") <= lon_max) if lon_min <= lon_max else (F.col("lon") >= lon_min) | (F.col("lon") <= lon_max)
    touched = points.where(lon & F.col("lat").between(lat_min, lat_max)).select(component, F.lit(True).alias("seed_family")).distinct()
    return points.join(touched, component, "left").withColumn("seed_family", F.coalesce("seed_family", F.lit(False)))


def spherical_centre(df: DataFrame, keys: list[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Of each group the direction of the mean of its positions' unit vectors: (keys, centre_lon, centre_lat)."""
    x, y = F.radians(lon), F.radians(lat)
    mean = df.groupBy(*keys).agg(F.avg(F.cos(y) * F.cos(x)).alias("a"), F.avg(F.cos(y) * F.sin(x)).alias("b"), F.avg(F.sin(y)).alias("c"))
    return mean.select(*keys, F.degrees(F.atan2("b", "a")).alias("centre_lon"), F.degrees(F.atan2("c", F.sqrt(F.col("a") ** 2 + F.col("b") ** 2))).alias("centre_lat"))

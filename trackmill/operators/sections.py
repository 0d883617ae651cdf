"""Sections across transport structures: samples along normals, profiles of neighbouring sections together, drops beside the axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import RADIUS, wrap_lon
from trackmill.functions.geodesic import wgs84_direct
from trackmill.functions.grid import RegularGrid
from trackmill.operators.graph import connected_components
from trackmill.operators.segments import contiguous_rolling_median
from trackmill.operators.transport import CELL, cell_id, neighbours8, with_neighbours
from trackmill.shared import materialize

KEYS = ("branch", "point")


def destination(lon: Column, lat: Column, bearing: Column, km: Column, ellipsoid: bool = True) -> tuple[Column, Column]:
    """Longitude in [-180, 180) and latitude after km along a bearing, on WGS84 or on the sphere."""
    if ellipsoid:
        end = wgs84_direct(lon, lat, bearing, km)
        return end["lon"], end["lat"]
    y, b, d = F.radians(lat), F.radians(bearing), km / RADIUS
    up = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(y) * F.cos(d) + F.cos(y) * F.sin(d) * F.cos(b))))
    east = F.atan2(F.sin(b) * F.sin(d) * F.cos(y), F.cos(d) - F.sin(y) * F.sin(up))
    return wrap_lon(lon + F.degrees(east)), F.degrees(up)


def bilinear_fields(points: DataFrame, cells: DataFrame, grid: RegularGrid, values: Sequence[str], lon: str = "lon", lat: str = "lat", tolerance: float = 1e-9) -> DataFrame:
    """points with each of values between the four cell centres around, and status ok, domain_boundary or missing_support.

    A value is null where a corner that weighs more than the tolerance lacks it; the status is that of the first of
    values. All columns of points together tell its rows apart. Rows are dealt to corners, so cells of any number do.
    """
    x, y = (F.col(lon) - grid.lon_min) / grid.lon_step - 0.5, (F.col(lat) - grid.lat_min) / grid.lat_step - 0.5
    i, j = F.floor(x).cast("long"), F.floor(y).cast("long")
    u, v = x - i, y - j
    corners = F.array(*(F.struct((i + a).alias("lon_bin"), (j + b).alias("lat_bin"), ((u if a else 1 - u) * (v if b else 1 - v)).alias("w")) for a in (0, 1) for b in (0, 1)))
    each = points.select(*points.columns, F.explode(corners).alias("__c")).select(*points.columns, F.col("__c.lon_bin").alias("__ci"), F.col("__c.lat_bin").alias("__cj"), F.col("__c.w").alias("__w")).where(F.col("__w") > tolerance)
    if grid.periodic:
        each = each.withColumn("__ci", F.pmod("__ci", F.lit(grid.nx)))
    outside = (F.col("__ci") < 0) | (F.col("__ci") >= grid.nx) | (F.col("__cj") < 0) | (F.col("__cj") >= grid.ny)
    held = cells.select(F.col(CELL[0]).alias("__ci"), F.col(CELL[1]).alias("__cj"), *(F.col(c).alias(f"__v_{c}") for c in values))
    met = each.withColumn("__out", outside).join(held, ["__ci", "__cj"], "left")
    whole = lambda c: F.when(F.count(f"__v_{c}") == F.count("*"), F.sum(F.col("__w") * F.col(f"__v_{c}")) / F.sum("__w"))
    status = F.when(F.max("__out"), "domain_boundary").when(F.count(f"__v_{values[0]}") < F.count("*"), "missing_support").otherwise("ok")
    return met.groupBy(*points.columns).agg(*(whole(c).alias(c) for c in values), status.alias("status"))


def cross_sections(cores: DataFrame, fields: DataFrame, grid: RegularGrid, half_width: float = 3.0, interval: float = 0.5, refine: float = 1.0, median_size: int = 3, east: str = "x_all", north: str = "y_all", others: Sequence[str] = (), keys: Sequence[str] = KEYS, ellipsoid: bool = True) -> DataFrame:
    """Samples along the normal of each core: one row for each offset, from half_width core scales on the left to as many on the right.

    cores: keys, lon, lat, bearing, scale_km, and perhaps missing_side (none, left, right, left_and_right). fields:
    cells with the vector (east, north) and others. u_parallel is the vector's part along the bearing. The axis
    moves to the largest u_parallel within refine scales (the leftmost on a tie) on a side that can be observed;
    place counts samples from there, side and d_km follow it, and all are null where no sample will do.

    Returns keys, bearing, scale_km, offset (in scales from the core), place, d_km, lon, lat, side, u_parallel,
    smoothed (median of median_size in runs without gaps), relative (to the axis), valid, observable, eligible,
    sample_class, core_place (of the axis from the core), core_u, core_lon, core_lat, core_uncertain, others.
    """
    n, reach = round(half_width / interval), round(refine / interval)
    if "missing_side" not in cores.columns:
        cores = cores.withColumn("missing_side", F.lit("none"))
    i = F.col("__i")
    rows = cores.select(*keys, "lon", "lat", "bearing", "scale_km", "missing_side", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("__i"))
    lon, lat = destination(F.col("lon"), F.col("lat"), F.pmod(F.col("bearing") + F.when(i < 0, -90.0).otherwise(90.0), F.lit(360.0)), F.abs(i) * interval * F.col("scale_km"), ellipsoid)
    rows = rows.withColumns({"__x": F.when(i == 0, F.col("lon")).otherwise(lon), "__y": F.when(i == 0, F.col("lat")).otherwise(lat)}).drop("lon", "lat")
    rows = bilinear_fields(rows, fields, grid, [east, north, *others], "__x", "__y")
    a = F.radians("bearing")
    # To 12 digits: equal samples must not be told apart by rounding errors.
    rows = rows.withColumn("u_parallel", F.round(F.col(east) * F.sin(a) + F.col(north) * F.cos(a), 12)).drop(*({east, north} - set(others)))
    unseen = lambda side: F.col("missing_side").isin(side, "left_and_right")
    rows = rows.withColumns({"valid": F.col("u_parallel").isNotNull(), "observable": F.when(i < 0, ~unseen("left")).when(i > 0, ~unseen("right")).otherwise(F.lit(True))})
    allowed = F.col("valid") & F.col("observable") & (F.abs(i) <= reach)
    best = F.max_by(F.struct(i.alias("i"), F.col("u_parallel").alias("u"), F.col("__x").alias("x"), F.col("__y").alias("y")), F.when(allowed, F.struct("u_parallel", -i))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("__core", best)
    place = i - F.col("__core.i")
    out = contiguous_rolling_median(rows.withColumn("place", place), "u_parallel", median_size, keys, "__i")
    kind = F.when(F.col("status") == "domain_boundary", "missing_because_of_boundary").when(F.col("status") == "missing_support", "missing_because_of_support").when(~F.col("valid"), "missing_invalid").when(i == 0, "direct_grid_information").otherwise("interpolated")
    return out.select(
        *keys,
        "bearing",
        "scale_km",
        "missing_side",
        (i * interval).alias("offset"),
        "place",
        (F.col("place") * interval * F.col("scale_km")).alias("d_km"),
        F.col("__x").alias("lon"),
        F.col("__y").alias("lat"),
        F.when(F.col("place") < 0, "left").when(F.col("place") > 0, "right").when(F.col("place") == 0, "core").alias("side"),
        "u_parallel",
        F.col("u_parallel_median").alias("smoothed"),
        F.when(F.col("__core.u") > 0, F.col("u_parallel") / F.col("__core.u")).alias("relative"),
        "valid",
        "observable",
        (F.col("valid") & F.col("observable")).alias("eligible"),
        kind.alias("sample_class"),
        F.col("__core.i").alias("core_place"),
        F.col("__core.u").alias("core_u"),
        F.col("__core.x").alias("core_lon"),
        F.col("__core.y").alias("core_lat"),
        F.coalesce(F.abs("__core.i") == reach, F.lit(True)).alias("core_uncertain"),
        *others,
    )


def section_summary(sections: DataFrame, least: int = 5, outer: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each section: samples by class, total variation raw and smoothed, and flags (a comma-joined list of those that hold)."""
    w = Window.partitionBy(*keys).orderBy("offset")
    rows = sections.withColumns({f"__{c}": F.abs(F.col(c) - F.lag(c).over(w)) for c in ("u_parallel", "smoothed")})
    number = lambda c: F.count(F.when(c, 1))
    far = F.abs("d_km") >= outer * F.col("scale_km")
    out = rows.groupBy(*keys).agg(
        number(F.col("valid")).alias("n_valid"),
        number(F.col("sample_class") == "missing_because_of_support").alias("n_missing_support"),
        number(F.col("sample_class") == "missing_because_of_boundary").alias("n_missing_boundary"),
        F.coalesce(F.sum("__u_parallel"), F.lit(0.0)).alias("variation"),
        F.coalesce(F.sum("__smoothed"), F.lit(0.0)).alias("variation_smoothed"),
        F.coalesce(F.max(far & (F.col("u_parallel") < 0)), F.lit(False)).alias("opposing_outer_transport"),
        F.max("core_uncertain").alias("core_uncertain"),
        F.max(F.struct("core_place", "core_u")).alias("__core"),
        F.max("missing_side").alias("missing_side"),
    )
    flags = {"unsupported_transverse_sample": F.col("n_missing_support") > 0, "domain_boundary": F.col("n_missing_boundary") > 0, "left_flank_not_observable": F.col("missing_side").isin("left", "left_and_right"), "right_flank_not_observable": F.col("missing_side").isin("right", "left_and_right"), "core_location_uncertain": F.col("core_uncertain"), "short_available_cross_section": F.col("n_valid") < least}
    return out.select(*keys, F.col("__core.core_place").alias("core_place"), F.col("__core.core_u").alias("core_u"), "n_valid", "n_missing_support", "n_missing_boundary", "variation", "variation_smoothed", "opposing_outer_transport", F.concat_ws(",", *(F.when(c, name) for name, c in flags.items())).alias("flags"))


def along_segment(cores: DataFrame, reach: int, keys: Sequence[str] = KEYS, segment: str = "branch", order: str = "sequence") -> DataFrame:
    """Pairs (keys, n_ keys) of sections of a segment at most reach places apart, each with itself too."""
    near = cores.select(F.col(segment).alias("__s"), F.col(order).alias("__o"), *(F.col(k).alias(f"n_{k}") for k in keys))
    own = cores.select(*keys, F.col(segment).alias("__s"), F.explode(F.sequence(F.col(order) - reach, F.col(order) + reach)).alias("__o"))
    return own.join(near, ["__s", "__o"]).drop("__s", "__o")


def within_hops(cores: DataFrame, hops: DataFrame, keys: Sequence[str] = KEYS, node: str = "point") -> DataFrame:
    """Pairs (keys, n_ keys) of sections whose nodes are a pair (a, b) of hops, each with itself too."""
    near = cores.select(*(F.col(k).alias(f"n_{k}") for k in keys), F.col(node).alias("__b"))
    own = cores.select(*keys, F.col(node).alias("__a"))
    linked = hops.select(F.col("a").alias("__a"), F.col("b").alias("__b")).distinct()
    linked = linked.where("__a != __b").unionByName(cores.select(F.col(node).alias("__a"), F.col(node).alias("__b")).distinct())
    return own.join(linked, "__a").join(near, "__b").drop("__a", "__b")


def composite_profiles(sections: DataFrame, neighbours: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """sections with what the sections of their neighbourhoods show at the same place from their axes.

    neighbours: pairs (keys, n_ keys). Adds composite_q25, composite_median, composite_q75, n_composite (sections
    with a sample there), n_decline and share_decline (of those with a sample there and one place further in, those
    that decline outwards). Sums of a place are pre-aggregated; no profile is gathered.
    """
    w = Window.partitionBy(*keys).orderBy("offset")
    inner = F.when(F.col("place") > 0, F.lag("u_parallel").over(w)).when(F.col("place") < 0, F.lead("u_parallel").over(w))
    profile = sections.where("place is not null").select(*(F.col(k).alias(f"n_{k}") for k in keys), "place", "u_parallel", F.when(inner.isNotNull() & F.col("u_parallel").isNotNull(), inner > F.col("u_parallel")).alias("__d"))
    met = neighbours.join(profile, [f"n_{k}" for k in keys])
    parts = F.percentile("u_parallel", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = met.groupBy(*keys, "place").agg(parts.alias("__q"), F.count("u_parallel").alias("n_composite"), F.count("__d").alias("__pairs"), F.sum(F.col("__d").cast("long")).alias("n_decline"))
    # To 12 digits, as samples: medians are compared with each other.
    out = out.select(*keys, "place", *(F.round(F.col("__q")[k], 12).alias(f"composite_{name}") for k, name in enumerate(("q25", "median", "q75"))), "n_composite", "n_decline", (F.col("n_decline") / F.nullif("__pairs", F.lit(0))).alias("share_decline"))
    return sections.join(out, [*keys, "place"], "left")


def drop_zones(profiles: DataFrame, least_sections: int = 2, least_share: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each step outwards between valid samples of an observable side, from the axis on, with whether it is a lasting drop, ranked.

    A step's values are the composites' medians where either sample has two sections or more, else the smoothed
    ones. It is a candidate if it falls, if the median of the next two samples out stays at or below its middle, and
    if enough neighbouring sections decline there (where there are two or more). rank (1 is best; null for others)
    goes by that persistence, then by the drop, the steeper slope and the smaller distance.
    """
    seen = profiles.where("valid and place is not null").withColumn("side", F.explode(F.when(F.col("side") == "core", F.array(F.lit("left"), F.lit("right"))).otherwise(F.array("side"))))
    seen = seen.where(~F.col("missing_side").isin("left_and_right") & (F.col("missing_side") != F.col("side")))
    w = Window.partitionBy(*keys, "side").orderBy(F.abs("place"))
    ahead = lambda c, k: F.lead(c, k).over(w)
    rows = seen.withColumns({"__out": ahead(F.struct("d_km", "lon", "lat", "n_composite", "n_decline", "share_decline"), 1), "__m": F.array("composite_median", *(ahead("composite_median", k) for k in (1, 2, 3))), "__s": F.array("smoothed", *(ahead("smoothed", k) for k in (1, 2, 3)))})
    together = F.coalesce((F.col("n_composite") >= 2) & (F.col("__out.n_composite") >= 2), F.lit(False))
    rows = rows.where("__out is not null").withColumn("__v", F.when(together, F.col("__m")).otherwise(F.col("__s"))).withColumn("profile", F.when(together, "composite").otherwise("smoothed"))
    inner, outer = F.col("__v")[0], F.col("__v")[1]
    a, b = F.col("__v")[2], F.col("__v")[3]
    rows = rows.where(inner.isNotNull() & outer.isNotNull())
    later = F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))
    width = F.abs("__out.d_km") - F.abs("d_km")
    persists = F.coalesce((F.col("__out.n_decline") >= least_sections) & (F.col("__out.share_decline") >= least_share), F.lit(False))
    alone = F.coalesce(F.col("__out.n_composite") < 2, F.lit(True))
    rows = rows.select(
        *keys,
        "side",
        F.abs("__out.d_km").alias("distance_km"),
        F.col("__out.lon").alias("lon"),
        F.col("__out.lat").alias("lat"),
        inner.alias("u_inner"),
        outer.alias("u_outer"),
        (inner - outer).alias("drop"),
        F.when(F.col("core_u") > 0, (inner - outer) / F.col("core_u")).alias("relative_drop"),
        (-(inner - outer) / width).alias("slope"),
        width.alias("width_km"),
        (2 + a.isNotNull().cast("int") + b.isNotNull().cast("int")).alias("samples"),
        F.when(later.isNotNull(), F.greatest(F.lit(0.0), F.greatest(a, b) - outer)).alias("recovery"),
        "profile",
        persists.alias("persists"),
        ((inner > outer) & F.coalesce(later <= (inner + outer) / 2, F.lit(False)) & (alone | persists)).alias("eligible"),
    )
    order = Window.partitionBy(*keys, "side", "eligible").orderBy(F.desc("persists"), F.desc("drop"), "slope", "distance_km")
    return rows.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(order)))


def side_drops(profiles: DataFrame, zones: DataFrame, strong: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two rows a section, left and right: status, number of candidate drops, the best one, and where the profile first falls to half, 1/e and nothing of the axis.

    status: flank_not_observable, candidate_drop or observable_no_candidate_drop. strong_recovery: transport beyond
    the best drop recovers by more than that share of it.
    """
    sides = profiles.groupBy(*keys).agg(F.max("missing_side").alias("missing_side")).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    seen = ~(F.col("missing_side").isin("left_and_right") | (F.col("missing_side") == F.col("side")))
    best = zones.where("rank = 1").select(*keys, "side", F.struct("distance_km", "drop", "persists", "recovery").alias("best"))
    number = zones.where("eligible").groupBy(*keys, "side").agg(F.count("*").alias("n"))
    own = profiles.where("valid and place is not null").withColumn("side", F.explode(F.when(F.col("side") == "core", F.array(F.lit("left"), F.lit("right"))).otherwise(F.array("side"))))
    first = lambda share: F.min(F.when(F.col("relative") <= share, F.abs("d_km")))
    falls = own.groupBy(*keys, "side").agg(first(0.5).alias("half_km"), first(0.36787944117144233).alias("e_km"), first(0.0).alias("zero_km"))
    rows = sides.withColumn("seen", seen).join(best, [*keys, "side"], "left").join(number, [*keys, "side"], "left").join(falls, [*keys, "side"], "left")
    shown = lambda c: F.when(F.col("seen"), c)
    return rows.select(
        *keys,
        "side",
        F.when(~F.col("seen"), "flank_not_observable").when(F.col("best").isNotNull(), "candidate_drop").otherwise("observable_no_candidate_drop").alias("status"),
        F.coalesce(F.col("n"), F.lit(0)).alias("candidates"),
        F.col("best.distance_km").alias("distance_km"),
        F.col("best.drop").alias("drop"),
        F.coalesce(F.col("best.persists"), F.lit(False)).alias("persists"),
        F.coalesce(F.col("best.recovery") > strong * F.col("best.drop"), F.lit(False)).alias("strong_recovery"),
        shown(F.col("half_km")).alias("half_km"),
        shown(F.col("e_km")).alias("e_km"),
        shown(F.col("zero_km")).alias("zero_km"),
    )


# Ridges


def support_mean(cells: DataFrame, grid: RegularGrid, value: str) -> DataFrame:
    """cells with a value, which becomes the mean over the cell and those of its eight neighbours that have one; the last column stands beside the first on the globe."""
    rows = cells.where(F.col(value).isNotNull())
    around = with_neighbours(rows.select(*CELL, F.col(value).alias("v")), grid, ["v"]).groupBy(*CELL).agg(F.sum("n_v").alias("__sum"), F.count("n_v").alias("__n"))
    mean = (F.col(value) + F.coalesce("__sum", F.lit(0.0))) / (1 + F.coalesce("__n", F.lit(0)))
    return rows.join(around, CELL, "left").withColumn(value, F.round(mean, 12)).drop("__sum", "__n")


def ridge_diagnostics(cells: DataFrame, grid: RegularGrid, value: str, angle: str = "theta", support: str = "n_move", min_support: int = 1, smooth: bool = False, distance: float = 1.0, boundary_aware: bool = True, levels: Sequence[float] = (0.5, 0.75), tolerance: float = 1e-12, ellipsoid: bool = True) -> DataFrame:
    """Each cell with a value, compared with samples a distance of its scale_km to the left and right across its direction.

    cells: bins, value, angle (null: none), support, scale_km. Only cells with min_support give values, to samples and
    to the mean of 3 by 3 (smooth). A ridge is no lower than both sides; with boundary_aware it is no lower than the one side
    that can be sampled, where the other cannot. d_left and d_right are the differences, c_perp the mean of those
    there are. missing_side: none, left, right, left_and_right; above_<level>: whether a ridge's value reaches that quantile of all
    cells with support.
    """
    known = cells.where((F.col(support) >= min_support) & F.col(value).isNotNull())
    field = (support_mean(known, grid, value) if smooth else known).select(*CELL, F.round(value, 12).alias("s"))
    rows = cells.join(field, CELL, "left").withColumns({"lon": grid.lon_center(F.col("lon_bin")), "lat": grid.lat_center(F.col("lat_bin"))})
    aimed = rows.where("s is not null and " + f"`{angle}` is not null").select(*CELL, "lon", "lat", F.col(angle).alias("__a"), "scale_km", F.explode(F.array(F.lit(-1), F.lit(1))).alias("__side"))
    lon, lat = destination(F.col("lon"), F.col("lat"), F.pmod(F.col("__a") + F.col("__side") * 90.0, F.lit(360.0)), F.col("scale_km") * distance, ellipsoid)
    spots = aimed.select(*(F.col(c).alias(f"__{c}") for c in CELL), "__side", lon.alias("__x"), lat.alias("__y"))
    sampled = bilinear_fields(spots, field, grid, ["s"], "__x", "__y")
    side = lambda c, k: F.max(F.when(F.col("__side") == k, F.col(c)))
    both = sampled.groupBy(*(F.col(f"__{c}").alias(c) for c in CELL)).agg(F.round(side("s", -1), 12).alias("left"), F.round(side("s", 1), 12).alias("right"), side("status", -1).alias("left_status"), side("status", 1).alias("right_status"))
    out = rows.join(both, CELL, "left").withColumns({"d_left": F.col("s") - F.col("left"), "d_right": F.col("s") - F.col("right")})
    has_left, has_right, able = F.col("left").isNotNull(), F.col("right").isNotNull(), F.col("s").isNotNull() & F.col(angle).isNotNull()
    two = able & has_left & has_right & (F.col("d_left") >= -tolerance) & (F.col("d_right") >= -tolerance)
    one = able & (has_left != has_right) & (F.coalesce("d_left", "d_right") >= -tolerance)
    kind = F.when(F.coalesce(two, F.lit(False)), "two_sided").when(F.coalesce(one, F.lit(False)), "one_sided").otherwise("not_ridge")
    missing = F.when(has_left & has_right, "none").when(has_left, "right").when(has_right, "left").otherwise("left_and_right")
    contrast = F.when(has_left & has_right, F.col("s") - (F.col("left") + F.col("right")) / 2).otherwise(F.coalesce("d_left", "d_right"))
    out = out.withColumns({"ridge_type": kind, "missing_side": missing, "c_perp": contrast})
    out = out.withColumn("ridge", (F.col("ridge_type") == "two_sided") | ((F.col("ridge_type") == "one_sided") & F.lit(boundary_aware)))
    limits = field.agg(F.percentile("s", F.array(*(F.lit(float(x)) for x in levels))).alias("__limits"))  # one row
    out = out.crossJoin(F.broadcast(limits))
    return out.select(*CELL, support, "s", "left", "right", F.coalesce("left_status", F.lit("not_sampled")).alias("left_status"), F.coalesce("right_status", F.lit("not_sampled")).alias("right_status"), "d_left", "d_right", "c_perp", "ridge_type", "missing_side", "ridge", *((F.col("ridge") & (F.col("s") >= F.col("__limits")[i])).alias(f"above_{round(100 * x)}") for i, x in enumerate(levels)))


def ridge_paths(ridges: DataFrame, grid: RegularGrid) -> DataFrame:
    """Ridge cells' eight-neighbour components with their kind, and interruptions: cells without a ridge that lie between two ends of different components.

    Rows (component, nodes, edges, ends, junctions, kind, interruptions, joins): joins are the components that one
    missing cell keeps apart, in order. An interruption is found from the ends' own neighbours, never from pairs of components.
    """
    cells = ridges.where("ridge").select(*CELL)
    pairs = with_neighbours(cells, grid, [], half=True)
    edges = materialize(pairs.select(cell_id(grid).alias("src"), cell_id(grid, "n_lon_bin", "n_lat_bin").alias("dst")), "ridge-edges")
    alone = cells.select(cell_id(grid).alias("src"), cell_id(grid).alias("dst"))
    every = materialize(edges.unionByName(alone), "ridge-cells")
    parts = materialize(connected_components(every), "ridge-parts")
    degree = every.where("src != dst").select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    nodes = materialize(parts.join(degree, "node", "left").fillna(0, ["degree"]), "ridge-nodes")
    stats = nodes.groupBy("component").agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.count(F.when(F.col("degree") == 1, 1)).alias("ends"), F.count(F.when(F.col("degree") > 2, 1)).alias("junctions"))
    kind = F.when(F.col("nodes") == 1, "isolated_cell").when(F.col("junctions") > 0, "junction_network").when(F.col("ends") == 0, "loop").otherwise("simple_path")
    # Each end offers its eight neighbours; a cell without a ridge that is offered by two components is an interruption.
    ends = nodes.where("degree <= 1").withColumns({"lon_bin": F.col("node") % grid.nx, "lat_bin": F.floor(F.col("node") / grid.nx).cast("long")})
    offered = neighbours8(ends, grid).join(ends.select(*CELL, "component"), CELL).select(cell_id(grid, "n_lon_bin", "n_lat_bin").alias("gap"), "component").distinct()
    offered = offered.join(nodes.select(F.col("node").alias("gap")), "gap", "left_anti")
    met = offered.groupBy("gap").agg(F.array_sort(F.collect_set("component")).alias("both")).where(F.size("both") > 1)  # eight at most
    mine = met.select("gap", F.explode("both").alias("component"), "both")
    gaps = mine.groupBy("component").agg(F.count("*").alias("interruptions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("both")))).alias("__all"))
    out = stats.withColumn("kind", kind).join(gaps, "component", "left")
    others = F.filter("__all", lambda x: x != F.col("component"))
    return out.select("component", "nodes", "edges", "ends", "junctions", "kind", F.coalesce("interruptions", F.lit(0)).alias("interruptions"), F.coalesce(F.array_join(others.cast("array<string>"), ","), F.lit("")).alias("joins"))

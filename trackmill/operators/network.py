"""Networks of transport modes: moments of modes, continuations clustered by where and how they go on, selected edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import angle_difference
from trackmill.functions.geodesic import row_scales, wgs84_inverse
from trackmill.functions.grid import RegularGrid
from trackmill.operators.graph import connected_components
from trackmill.operators.spatial import radius_join
from trackmill.operators.transport import END, START
from trackmill.shared import materialize

SOURCE = [*START, "mode"]


def mode_moments(members: DataFrame, matrix: DataFrame, min_start: int = 5, min_moving: int = 5, min_count: int = 3, min_share: float = 0.1, min_mean_km: float = 0.0) -> DataFrame:
    """Of each mode its moves' sums: n, p_moving (of its cell's moves), p_all, dx, dy, bearing and mean_km, sd_km and angular_sd about them, cells and records reached, reasons against it and accepted.

    reasons: low_start_count, low_moving_count, low_mode_count, low_mode_probability, short_mean_distance.
    """
    n, d = F.col("transition_count"), F.col("distance")
    mean = lambda c: F.sum(n * c) / F.sum(n)
    sums = members.groupBy(*SOURCE, "start_lon_center", "start_lat_center").agg(F.sum(n).alias("n"), F.sum("transition_probability").alias("p_all"), mean(F.col("dx")).alias("dx"), mean(F.col("dy")).alias("dy"), mean(d).alias("mean_km"), F.count_distinct(*END).alias("end_cells"), F.count("*").alias("records"))
    sums = sums.withColumn("bearing", F.pmod(F.degrees(F.atan2("dx", "dy")), F.lit(360.0)))
    about = members.join(sums.select(*SOURCE, F.col("bearing").alias("__b"), F.col("mean_km").alias("__m")), SOURCE)
    turn = angle_difference(F.col("__b"), F.col("bearing"))
    spread = about.groupBy(*SOURCE).agg(F.sqrt(mean((d - F.col("__m")) ** 2)).alias("sd_km"), F.sqrt(mean(turn * turn)).alias("angular_sd"))
    stay = (F.col(START[0]) == F.col(END[0])) & (F.col(START[1]) == F.col(END[1]))
    starts = matrix.groupBy(*START).agg(F.sum(n).alias("__start"), F.sum(F.when(~stay, n).otherwise(0)).alias("__moving"))
    out = sums.join(spread, SOURCE).join(starts, START).withColumn("p_moving", F.col("n") / F.col("__moving"))
    rules = {"low_start_count": F.col("__start") < min_start, "low_moving_count": F.col("__moving") < min_moving, "low_mode_count": F.col("n") < min_count, "low_mode_probability": F.col("p_moving") < min_share, "short_mean_distance": F.col("mean_km") < min_mean_km}
    reasons = F.concat_ws(";", *(F.when(c, name) for name, c in rules.items()))
    return out.withColumn("reasons", reasons).withColumn("accepted", F.col("reasons") == "").drop("__start", "__moving")


def diagonals(spark, grid: RegularGrid) -> DataFrame:
    """Of each row of a grid, km of the diagonal of a step of longitude and one of latitude on the ellipsoid."""
    scale = row_scales(spark, grid)
    south = F.lag("km_y").over(Window.orderBy("lat_bin"))  # the topmost row has no step north: that of the row below
    return scale.select("lat_bin", F.sqrt(F.col("km_x") ** 2 + F.coalesce("km_y", south) ** 2).alias("diagonal_km"))


def angular_factor(mismatch: Column, scale: float) -> Column:
    return F.exp(-0.5 * (mismatch / scale) ** 2)


def continuations(members: DataFrame, modes: DataFrame, grid: RegularGrid, alignment_degrees: float = 30.0) -> DataFrame:
    """Each move of an accepted mode with each accepted mode of the cell that it reaches (to_mode null where there is none) and its score.

    score: the move's share of its mode, times normal factors of the angle between the move and that mode and of its
    distance from its own mode's mean, measured in the larger of that mode's spread and the diagonal of its cell.
    To 12 digits: rank goes by it, then by the cell reached and its mode, within a source mode.
    """
    spark = members.sparkSession
    good = modes.where("accepted")
    own = members.join(good.select(*SOURCE, F.col("p_all").alias("__p"), F.col("mean_km").alias("__mean"), F.col("sd_km").alias("__sd")), SOURCE)
    own = own.join(diagonals(spark, grid).select(F.col("lat_bin").alias(START[1]), F.col("diagonal_km").alias("__diagonal")), START[1])
    target = good.select(F.col(START[0]).alias(END[0]), F.col(START[1]).alias(END[1]), F.col("mode").alias("to_mode"), F.col("bearing").alias("to_bearing"))
    met = own.join(target, END, "left")
    scale = F.greatest("__sd", "__diagonal", F.lit(1.0))
    turn, off = F.abs(angle_difference(F.col("bearing"), F.col("to_bearing"))), F.abs(F.col("distance") - F.col("__mean"))
    support = F.col("transition_probability") / F.col("__p")
    score = F.when(F.col("to_mode").isNotNull(), F.round(support * angular_factor(turn, alignment_degrees) * F.exp(-0.5 * (off / scale) ** 2), 12))
    rows = met.select(*SOURCE, *END, F.col("end_lon_center").alias("lon"), F.col("end_lat_center").alias("lat"), "to_mode", "to_bearing", "transition_count", "transition_probability", "distance", turn.alias("turn"), off.alias("off_km"), scale.alias("scale_km"), F.col("__p").alias("mode_probability"), score.alias("score"))
    order = Window.partitionBy(*SOURCE).orderBy(F.desc_nulls_last("score"), END[1], END[0], "to_mode")
    return rows.withColumn("rank", F.when(F.col("to_mode").isNotNull(), F.row_number().over(order)))


def clustered(candidates: DataFrame, grid: RegularGrid, diagonal_share: float = 1.5, max_turn: float = 30.0) -> DataFrame:
    """candidates with region: the rank of the representative of their cluster within their source mode.

    By rank, a candidate joins the first representative before it that lies within diagonal_share of a diagonal of
    the candidate's cell and whose mode points alike; if there is none, it represents a new cluster. Not one after the
    other, but in rounds over the table of candidates that are near each other: who is near an earlier representative is decided, and
    so is who has none but decided others before. What stays open shrinks from round to round, each a written table.
    """
    known = candidates.where("to_mode is not null").join(diagonals(candidates.sparkSession, grid).select(F.col("lat_bin").alias(END[1]), (F.col("diagonal_km") * diagonal_share).alias("__km")), END[1])
    spots = materialize(known.select(*SOURCE, "rank", "lon", "lat", "to_bearing", "__km"), "candidates")
    widest = spots.agg(F.max("__km")).first()[0] or 1.0
    # A hundredth more on the sphere than any geodesic; the geodesic decides.
    met = radius_join(spots.select(*SOURCE, "rank", "lon", "lat", "to_bearing", "__km"), spots.select(*SOURCE, "rank", "lon", "lat", "to_bearing"), 1.01 * widest, tuple(SOURCE)).where("rank_r < rank").drop("km")
    met = met.where(F.abs(angle_difference(F.col("to_bearing"), F.col("to_bearing_r"))) <= max_turn)
    near = met.withColumn("__apart", F.coalesce(wgs84_inverse("lon", "lat", "lon_r", "lat_r")["km"], F.lit(0.0))).where(F.col("__apart") <= F.col("__km"))
    near = materialize(near.select(*SOURCE, "rank", F.col("rank_r").alias("before")), "candidates-near")
    state = materialize(spots.select(*SOURCE, "rank", F.lit(0).alias("state")), "cluster-states")  # 1: represents, 2: belongs to another
    while not state.where("state = 0").isEmpty():
        asked = near.join(state.where("state = 0").select(*SOURCE, "rank"), [*SOURCE, "rank"]).join(state.select(*SOURCE, F.col("rank").alias("before"), F.col("state").alias("theirs")), [*SOURCE, "before"])
        said = asked.groupBy(*SOURCE, "rank").agg(F.max((F.col("theirs") == 1).cast("int")).alias("met"), F.max((F.col("theirs") == 0).cast("int")).alias("waits"))
        next_state = F.when(F.col("state") > 0, F.col("state")).when(F.col("met") == 1, 2).when(F.col("waits") == 1, 0).otherwise(1)
        state = materialize(state.join(said, [*SOURCE, "rank"], "left").select(*SOURCE, "rank", next_state.alias("state")), "cluster-states")
    heads = state.where("state = 1").select(*SOURCE, F.col("rank").alias("before"))
    first = near.join(heads, [*SOURCE, "before"]).groupBy(*SOURCE, "rank").agg(F.min("before").alias("head"))
    return candidates.where("to_mode is not null").join(first, [*SOURCE, "rank"], "left").withColumn("region", F.coalesce("head", "rank")).drop("head")


def network_edges(regions: DataFrame, alignment_degrees: float = 30.0, max_turn: float = 60.0, max_km: float = 400.0, min_relative: float = 0.35, mass: float = 0.8) -> DataFrame:
    """One edge for each cluster of continuations of a mode, to the mode of its representative, with its score, whether it is selected, and reasons against it.

    support, counts and end points are those of distinct moves; turn, km and off_km are means over the cluster by
    probability, and the score is taken anew from them. Of edges without angular_mismatch and edge_too_long those with a score below a share of the best go
    (low_relative_score); the others are selected, best first, until their support makes up the mass, with those whose score equals the last one's.
    """
    p = F.col("transition_probability")
    weighted = lambda c: F.sum(p * F.col(c)) / F.sum(p)
    group = [*SOURCE, "region"]
    means = regions.groupBy(*group, "mode_probability", "scale_km").agg(*(weighted(c).alias(c) for c in ("turn", "distance", "off_km")), F.min_by(F.struct(*END, "to_mode"), "rank").alias("to"))
    moves = regions.select(*group, *END, "transition_count", "transition_probability").distinct().groupBy(*group).agg(F.sum("transition_count").alias("n"), F.sum(p).alias("p_all"), F.count("*").alias("end_points"))
    rows = means.join(moves, group).withColumn("support", F.col("p_all") / F.col("mode_probability"))
    score = F.round(F.col("support") * angular_factor(F.col("turn"), alignment_degrees) * F.exp(-0.5 * (F.col("off_km") / F.col("scale_km")) ** 2), 12)
    against = F.concat_ws(";", F.when(F.col("turn") > max_turn, "angular_mismatch"), F.when(F.col("distance") > max_km, "edge_too_long"))
    rows = rows.select(*group, F.col(f"to.{END[0]}"), F.col(f"to.{END[1]}"), F.col("to.to_mode"), "n", "p_all", "end_points", "support", "turn", F.col("distance").alias("km"), "off_km", score.alias("score"), against.alias("against"))
    mine = Window.partitionBy(*SOURCE)
    best = F.max(F.when(F.col("against") == "", F.col("score"))).over(mine)
    rows = rows.withColumn("relative", F.when(best > 0, F.col("score") / best).otherwise(0.0))
    rows = rows.withColumn("__in", (F.col("against") == "") & (F.col("relative") + 1e-15 >= min_relative))
    order = mine.orderBy(F.desc("__in"), F.desc("score"), END[1], END[0], "to_mode")
    share = F.when(F.col("__in"), F.col("support")).otherwise(0.0)
    rows = rows.withColumn("__before", F.coalesce(F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    cut = F.max(F.when(F.col("__in") & (F.col("__before") < mass) & (F.col("__before") + share >= mass), F.col("score"))).over(mine)
    chosen = F.col("__in") & ((F.col("__before") < mass) | F.coalesce(F.abs(F.col("score") - cut) <= 1e-8 + 1e-5 * F.abs(cut), F.lit(False)))
    rows = rows.withColumn("selected", chosen)
    reasons = F.when(F.col("against") != "", F.col("against")).when(~F.col("__in"), "low_relative_score").when(~F.col("selected"), "beyond_cumulative_mass").otherwise("")
    return rows.withColumn("reasons", reasons).drop("against", "__in", "__before")


def node_id(grid: RegularGrid, lon: str, lat: str, mode: str) -> Column:
    """One number for a mode of a cell."""
    return (F.col(lat) * grid.nx + F.col(lon)) * 1000 + F.col(mode)


def network_components(modes: DataFrame, edges: DataFrame, grid: RegularGrid) -> DataFrame:
    """Rows (node, component) of accepted modes: parts of the network that hang together by selected edges, named by their smallest node."""
    nodes = modes.where("accepted").select(node_id(grid, *SOURCE).alias("node"))
    links = edges.where("selected").select(node_id(grid, *SOURCE).alias("src"), node_id(grid, *END, "to_mode").alias("dst"))
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return connected_components(links.unionByName(loops))

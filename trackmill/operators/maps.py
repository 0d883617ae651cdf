"""Maps of regions and structures, frames, sampling of cell fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import haversine
from trackmill.functions.grid import RegularGrid
from trackmill.operators.cleaning import micros
from trackmill.operators.segments import numbered
from trackmill.operators.spatial import inside_polygon, radius_join
from trackmill.operators.transport import CELL


def region_map(summary: DataFrame, grid: RegularGrid, label: str, lon: str = "lon_first", lat: str = "lat_first", priority: str | None = None) -> DataFrame:
    """A label for each release cell: the commonest (the smallest on a tie), or with a priority column the highest, then the smallest label."""
    rows = grid.assign(summary.where(F.col(label).isNotNull()), lon, lat)
    if priority is not None:
        return rows.groupBy(*CELL).agg(F.min_by(label, F.struct(F.coalesce(-F.col(priority), F.lit(float("inf"))), label)).alias(label))
    counts = rows.groupBy(*CELL, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*CELL).agg(F.min_by(label, F.struct(-F.col("n"), label)).alias(label), F.sum("n").alias("n"))


def connectivity_segments(summary: DataFrame, keys=("trajectory",)) -> DataFrame:
    """Two rows a particle: its first and its last position."""
    ends = F.array(*(F.struct(F.lit(i).alias("place"), F.col(f"lon_{n}").alias("lon"), F.col(f"lat_{n}").alias("lat")) for i, n in enumerate(("first", "last"))))
    return summary.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.place", "e.lon", "e.lat")


def snapshots(df: DataFrame, indices: list[int], time: str = "time") -> DataFrame:
    """Rows at the times with these places in the order of distinct times; negative ones count from the end; IndexError beyond."""
    times = numbered(df, [time], "frame")
    n = times.count()
    places = sorted({i + n if i < 0 else i for i in indices})
    if places and (places[0] < 0 or places[-1] >= n):
        raise IndexError(f"there are {n} times")
    return df.join(times.where(F.col("frame").isin(places)).withColumn("frame", F.col("frame").cast("int")), time)


def nearest_frame(df: DataFrame, wanted: Column, tolerance_us: int, time: str = "time") -> DataFrame:
    """Rows of the time nearest to a wanted one (the earlier on a tie); ValueError where none is within the tolerance."""
    off = F.abs(micros(time) - F.unix_micros(wanted.cast("timestamp")))
    best = df.select(time, off.alias("off")).where(F.col(time).isNotNull()).agg(F.min_by(time, F.struct("off", time)).alias("t"), F.min("off").alias("off")).first()
    if best["t"] is None or best["off"] > tolerance_us:
        raise ValueError("no frame near that time")
    return df.where(F.col(time) == F.lit(best["t"]).cast("timestamp_ntz"))


def regular_points(spark, regions: DataFrame, step: float) -> DataFrame:
    """Points on multiples of a step inside regions: (label, lon, lat)."""
    axis = lambda a, b: F.sequence(F.ceil(F.col(a) / step).cast("long"), F.floor(F.col(b) / step).cast("long"))
    rows = regions.where(F.ceil(F.col("x0") / step) <= F.floor(F.col("x1") / step)).where(F.ceil(F.col("y0") / step) <= F.floor(F.col("y1") / step))
    points = rows.withColumn("i", F.explode(axis("x0", "x1"))).withColumn("j", F.explode(axis("y0", "y1"))).withColumns({"lon": F.col("i") * F.lit(step), "lat": F.col("j") * F.lit(step)})
    return points.where(inside_polygon(F.col("lon"), F.col("lat"), F.col("polygon"))).select("label", "lon", "lat")


def bilinear_sample(points: DataFrame, cells: DataFrame, grid: RegularGrid, value: str, keys: list[str]) -> DataFrame:
    """A cell field between the four centres around each point: the weighted sum where every corner with weight has a value, else null; with status ok, domain_boundary or missing_support."""
    x, y = (F.col("lon") - grid.lon_min) / grid.lon_step - 0.5, (F.col("lat") - grid.lat_min) / grid.lat_step - 0.5
    rows = points.select(*keys, x.alias("x"), y.alias("y")).withColumns({"i": F.floor("x").cast("long"), "j": F.floor("y").cast("long")}).withColumns({"u": F.col("x") - F.col("i"), "v": F.col("y") - F.col("j")})
    corners = F.array(*(F.struct((F.col("i") + a).alias("lon_bin"), (F.col("j") + b).alias("lat_bin"), ((F.col("u") if a else 1 - F.col("u")) * (F.col("v") if b else 1 - F.col("v"))).alias("w")) for a in (0, 1) for b in (0, 1)))
    each = rows.select(*keys, F.explode(corners).alias("c")).select(*keys, "c.*").where("w > 0")
    if grid.periodic:
        each = each.withColumn("lon_bin", F.pmod("lon_bin", F.lit(grid.nx)))
    outside = (F.col("lon_bin") < 0) | (F.col("lon_bin") >= grid.nx) | (F.col("lat_bin") < 0) | (F.col("lat_bin") >= grid.ny)
    met = each.withColumn("outside", outside).join(cells.select(*CELL, F.col(value).alias("z")), CELL, "left")
    out = met.groupBy(*keys).agg(F.sum(F.col("w") * F.col("z")).alias("s"), F.count("*").alias("corners"), F.count("z").alias("known"), F.max("outside").alias("outside"))
    status = F.when(F.col("outside"), "domain_boundary").when(F.col("known") < F.col("corners"), "missing_support").otherwise("ok")
    return out.select(*keys, F.when(status == "ok", F.col("s")).alias(value), status.alias("status"))


def cell_scales(spark, grid: RegularGrid) -> DataFrame:
    """Of each latitude row: width, height and diagonal of a cell in km on the sphere."""
    rows = spark.range(grid.ny).select(F.col("id").alias("lat_bin")).withColumn("lat", grid.lat_center(F.col("lat_bin")))
    wide, high = haversine(F.lit(0.0), F.col("lat"), F.lit(grid.lon_step), F.col("lat")), haversine(F.lit(0.0), F.col("lat") - grid.lat_step / 2, F.lit(0.0), F.col("lat") + grid.lat_step / 2)
    return rows.select("lat_bin", wide.alias("width_km"), high.alias("height_km"), F.sqrt(wide * wide + high * high).alias("diagonal_km"))


def nearest_other_branch(points: DataFrame, km: float, gap: int = 3) -> DataFrame:
    """Of each branch point: least distance to another branch, and to its own branch more than gap places away, within km."""
    p = points.select("branch", "point", "lon", "lat")
    met = radius_join(p, p, km).where("branch != branch_r or point != point_r")
    other, own = F.col("branch") != F.col("branch_r"), (F.col("branch") == F.col("branch_r")) & (F.abs(F.col("point") - F.col("point_r")) > gap)
    best = met.groupBy("branch", "point").agg(F.min(F.when(other, F.col("km"))).alias("other_km"), F.min(F.when(own, F.col("km"))).alias("self_km"))
    return p.join(best, ["branch", "point"], "left")


def barrier_summary(minima: DataFrame, points: DataFrame, value: str = "p_cross") -> DataFrame:
    """Of each branch: its points, those with a barrier, the covered share, longest run of points without, statistics of crossing."""
    rows = points.select("branch", "point").join(minima, ["branch", "point"], "left")
    w = Window.partitionBy("branch").orderBy("point")
    rows = rows.withColumn("__run", F.sum(F.col(value).isNotNull().cast("int")).over(w))
    runs = rows.groupBy("branch", "__run").agg(F.sum(F.col(value).isNull().cast("int")).alias("gap")).groupBy("branch").agg(F.max("gap").alias("longest_gap"))
    stats = rows.groupBy("branch").agg(F.count("*").alias("points"), F.count(value).alias("barrier_points"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return stats.join(runs, "branch").withColumn("coverage", F.col("barrier_points") / F.col("points"))


def level_comparison(cells: DataFrame, a: str, b: str, quantiles: list[float]) -> DataFrame:
    """Of each quantile: thresholds of two values, cells at or above either, both, and their Jaccard share."""
    known = cells.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    limits = known.agg(F.percentile("a", F.array(*map(F.lit, quantiles))).alias("qa"), F.percentile("b", F.array(*map(F.lit, quantiles))).alias("qb"))
    levels = limits.select(F.explode(F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("q"), "qa", "qb")).alias("x")).select("x.*")
    met = known.crossJoin(F.broadcast(levels))  # a row for each quantile
    flag = lambda c: F.sum(c.cast("long"))
    in_a, in_b = F.col("a") >= F.col("qa"), F.col("b") >= F.col("qb")
    out = met.groupBy(F.col("q").alias("quantile"), F.col("qa").alias("threshold_a"), F.col("qb").alias("threshold_b")).agg(flag(in_a & in_b).alias("in_both"), flag(in_a & ~in_b).alias("only_a"), flag(~in_a & in_b).alias("only_b"))
    return out.withColumn("jaccard", F.col("in_both") / (F.col("in_both") + F.col("only_a") + F.col("only_b")))


def minimal_lon_span(df: DataFrame, keys: list[str], lon: str = "lon") -> DataFrame:
    """Degrees of the shortest arc of longitude that holds all positions of a group: 360 less its largest gap."""
    turned = df.where(F.col(lon).isNotNull()).select(*keys, F.pmod(lon, F.lit(360.0)).alias("x")).distinct()
    w = Window.partitionBy(*keys)
    gaps = turned.withColumn("gap", F.coalesce(F.lead("x").over(w.orderBy("x")), F.min("x").over(w) + 360.0) - F.col("x"))
    return gaps.groupBy(*keys).agg((360.0 - F.max("gap")).alias("lon_span"))


def run_schedule(spark, start: str, stop: str, days: int, prefix: str = "run") -> DataFrame:
    """Names and start dates of runs from start to stop, every so many days."""
    dates = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{stop}', INTERVAL {int(days)} DAY)) AS start")
    return dates.select(F.concat(F.lit(f"{prefix}_"), F.date_format("start", "yyyyMMdd")).alias("name"), "start")

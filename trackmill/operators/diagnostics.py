"""Aggregations over trajectories: summaries, density, residence, crossings, excursions, sampled maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import floor_mod, haversine, local_xy
from trackmill.functions.grid import AGGREGATES, RegularGrid
from trackmill.operators.cleaning import micros
from trackmill.operators.segments import DAY


def particle_summary(df: DataFrame, keys=("trajectory",), variables: tuple[str, ...] = (), meta: tuple[str, ...] = (), order: str = "obs") -> DataFrame:
    """One row a particle: number of rows, first and last time and position by obs, lifetime, statistics of variables."""
    ends = [f(c, order).alias(f"{c}_{n}") for c in ("time", "lon", "lat") for n, f in (("first", F.min_by), ("last", F.max_by))]
    stats = [x for v in variables for x in (F.min_by(v, order).alias(f"{v}_first"), F.max_by(v, order).alias(f"{v}_last"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), F.avg(v).alias(f"{v}_mean"))]
    out = df.groupBy(*keys).agg(F.count("*").alias("n_obs"), *ends, *stats, *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in meta))
    return out.withColumn("lifetime_s", (micros("time_last") - micros("time_first")) / 1e6)


def time_density(df: DataFrame, grid: RegularGrid, keys=("trajectory",), zero_fill: bool = False) -> DataFrame:
    """Particles of each time and cell, with the share of those active then and of all trajectories."""
    total = df.agg(F.countDistinct(*keys).alias("n_total"))
    active = df.groupBy("time").agg(F.count("*").alias("n_active"))
    cells = grid.assign(df).groupBy("time", "lon_bin", "lat_bin").agg(F.count("*").alias("n"))
    if zero_fill:
        ever = cells.select("lon_bin", "lat_bin").distinct()
        cells = active.select("time").crossJoin(ever).join(cells, ["time", "lon_bin", "lat_bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = cells.join(active, "time").crossJoin(F.broadcast(total))  # total: one row
    return out.withColumns({"active_fraction": F.col("n") / F.col("n_active"), "total_fraction": F.col("n") / F.col("n_total")})


def beaching_times(summary: DataFrame, grid: RegularGrid, how: str = "min") -> DataFrame:
    """Lifetime in days of particles by the cell of their release."""
    return grid.aggregate(summary.withColumn("days", F.col("lifetime_s") / 86400), "days", how, "lon_first", "lat_first")


def meridional_excursion(df: DataFrame, keys=("trajectory",), min_days: float = 0.0, order: str = "obs") -> DataFrame:
    """Southernmost and northernmost points (the first on a tie) with age and distance in latitude from the start."""
    first, last = F.min_by("time", order), F.max_by("time", order)
    point = F.struct("lat", "lon", "time")
    rows = df.groupBy(*keys).agg(F.min_by(point, order).alias("start"), F.min_by(point, F.struct("lat", "time", order)).alias("south"), F.min_by(point, F.struct(-F.col("lat"), "time", order)).alias("north"), first.alias("t0"), last.alias("t1"))
    rows = rows.where((micros("t1") - micros("t0")) >= int(min_days * DAY))
    out = {f"{c}_{n}": F.col(f"{n}.{c}") for n in ("start", "south", "north") for c in ("lon", "lat")}
    ages = {f"{n}_age_days": (F.unix_micros(F.col(f"{n}.time").cast("timestamp")) - micros("t0")) / DAY for n in ("south", "north")}
    reach = {f"{n}_excursion": F.col(f"{n}.lat") - F.col("start.lat") for n in ("south", "north")}
    return rows.select(*keys, *(c.alias(k) for k, c in (out | ages | reach).items()))


def excursion_grid(excursions: DataFrame, grid: RegularGrid, anchor: str, variable: str, how: str = "mean") -> DataFrame:
    """A variable of excursions and its count in the cells of their start, south or north point."""
    cells = grid.assign(excursions, f"lon_{anchor}", f"lat_{anchor}").groupBy("lon_bin", "lat_bin")
    return cells.agg(AGGREGATES[how](variable).alias("value"), F.count(variable).alias("n"))


def sampled_map(df: DataFrame, grid: RegularGrid, value: str, weighting: str = "points", min_count: int = 1, min_trajectories: int = 1, keys=("trajectory",)) -> DataFrame:
    """Count, distinct trajectories, mean and sample deviation of a value in each cell; too little support nulls the last two.

    weighting: points, or trajectories (the mean of each trajectory in a cell counts once).
    """
    rows = grid.assign(df.withColumn("lon", F.when(F.lit(grid.periodic), grid.wrapped(F.col("lon"))).otherwise(F.col("lon")))).where(F.col(value).isNotNull())
    per = rows.groupBy("lon_bin", "lat_bin", *keys).agg(F.count("*").alias("c"), F.avg(value).alias("m"))
    if weighting == "trajectories":
        cells = per.groupBy("lon_bin", "lat_bin").agg(F.sum("c").alias("count"), F.count("*").alias("trajectory_count"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))
    else:
        support = per.groupBy("lon_bin", "lat_bin").agg(F.sum("c").alias("count"), F.count("*").alias("trajectory_count"))
        cells = support.join(rows.groupBy("lon_bin", "lat_bin").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")), ["lon_bin", "lat_bin"])
    enough = (F.col("count") >= min_count) & (F.col("trajectory_count") >= min_trajectories)
    return cells.withColumns({c: F.when(enough, F.col(c)) for c in ("mean", "std")})


def alive_latitude_fraction(df: DataFrame, lat_min: float, lat_max: float, step: float, min_alive: int = 1) -> DataFrame:
    """alive_fraction of latitudes."""
    return alive_fraction(df, "lat", lat_min, lat_max, step, min_alive)


def alive_fraction(df: DataFrame, column: str, low: float, high: float, step: float, min_alive: int = 1, frame: str = "time", max_frame=None) -> DataFrame:
    """Share of particles alive in a frame (a time, or an age) in each bin of a column; those outside all bins stay in the denominator. The last bin is closed.

    Rows (frame, <column>_bin, its bounds bin_low and bin_high, n, alive, fraction), frames up to max_frame.
    """
    n = round((high - low) / step)
    name = f"{column}_bin"
    rows = df.where(F.col(column).isNotNull()) if max_frame is None else df.where(F.col(column).isNotNull() & (F.col(frame) <= F.lit(max_frame)))
    b = F.least(F.floor((F.col(column) - low) / step), F.lit(n - 1)).cast("long")
    rows = rows.withColumn(name, F.when((F.col(column) >= low) & (F.col(column) <= high), b))
    alive = rows.groupBy(frame).agg(F.count("*").alias("alive"))
    bins = alive.select(frame, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name))
    counted = rows.where(F.col(name).isNotNull()).groupBy(frame, name).agg(F.count("*").alias("n"))
    out = bins.join(counted, [frame, name], "left").join(alive, frame)
    bounds = [(low + F.col(name) * step).alias("bin_low"), (low + (F.col(name) + 1) * step).alias("bin_high")]
    return out.select(frame, name, *bounds, F.coalesce("n", F.lit(0)).alias("n"), "alive", F.when(F.col("alive") >= min_alive, F.coalesce("n", F.lit(0)) / F.col("alive")).alias("fraction"))


def meridional_crossing(segments: DataFrame, points: DataFrame, grid: RegularGrid, min_days: float = 0.0, min_degrees: float | None = None, reference: str = "center", keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Crossings of latitude lines by directional segments, in the longitude cell interpolated there.

    segments: rows (keys, segment, sign, first_obs, last_obs), last_obs being the last step's first point. A segment
    counts if it lasts min_days or spans min_degrees (a cell by default) or more. It crosses each line beyond its first
    latitude, up to its last, once: on its first step that reaches the line; steps that are flat to 1e-5 of their
    latitude are not searched. reference: lines are cell centres, or edges (of the cell that is entered).
    Rows (lat_bin, lon_bin, sign, crossings, segments, probability): the last two for all segments of the sign.
    """
    if reference not in ("center", "edge"):
        raise ValueError(f"unknown reference: {reference}")
    w = Window.partitionBy(*keys).orderBy(order)
    steps = points.withColumns({"lon1": F.lead("lon").over(w), "lat1": F.lead("lat").over(w), "t1": F.lead(micros()).over(w), "t0": micros()}).where("lat1 is not null")
    s = segments.select(*keys, "segment", "sign", "first_obs", "last_obs")
    inside = steps.join(s, list(keys)).where((F.col(order) >= F.col("first_obs")) & (F.col(order) <= F.col("last_obs")))
    own = Window.partitionBy(*keys, "segment")
    whole = {"__start": F.min_by("lat", order).over(own), "__end": F.max_by("lat1", order).over(own), "__us": F.max("t1").over(own) - F.min("t0").over(own)}
    spans = grid.lat_step if min_degrees is None else min_degrees
    valid = inside.withColumns(whole).where((F.col("__us") >= int(min_days * DAY)) | (F.abs(F.col("__end") - F.col("__start")) >= spans))
    flat = F.abs(F.col("lat1") - F.col("lat")) <= 1e-12 + 1e-5 * F.abs(F.col("lat"))
    lines = _lines(valid.where(~flat), grid, reference)
    once = lines.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "segment", "lat_bin").orderBy(order))).where("__r = 1")
    share = (F.col("line") - F.col("lat")) / (F.col("lat1") - F.col("lat"))
    step = floor_mod(F.col("lon1") - F.col("lon") + 180.0, 360.0) - 180.0
    lon = grid.wrapped(F.col("lon") + share * step) if grid.periodic else F.col("lon") + share * step
    placed = once.withColumn("lon_bin", grid.lon_bin(lon)).where((F.col("lon_bin") >= 0) & (F.col("lon_bin") < grid.nx))
    counted = valid.select(*keys, "segment", "sign").distinct().groupBy("sign").agg(F.count("*").alias("segments"))
    crossings = placed.groupBy("lat_bin", "lon_bin", "sign").agg(F.count("*").alias("crossings"))
    return crossings.join(counted, "sign").select("lat_bin", "lon_bin", "sign", "crossings", "segments", (F.col("crossings") / F.col("segments")).alias("probability"))


def _lines(steps: DataFrame, grid: RegularGrid, reference: str) -> DataFrame:
    """Steps with the lines that they reach (line, lat_bin), beyond the first latitude of their segment."""
    shift = 0.5 if reference == "center" else 0.0
    position = lambda x: (x - grid.lat_min) / grid.lat_step - shift
    first, last = F.ceil(position(F.least("lat", "lat1")) - 1e-12).cast("long"), F.floor(position(F.greatest("lat", "lat1")) + 1e-12).cast("long")
    # Lines by number: of centres one for each cell, of edges those of the cell that a segment going north or south enters.
    north = F.col("sign") > 0
    low, high = F.lit(0), F.lit(grid.ny - 1)
    if reference == "edge":
        low, high = F.when(north, 0).otherwise(1), F.when(north, grid.ny - 1).otherwise(grid.ny)
    rows = steps.withColumns({"__a": F.greatest(first, low.cast("long")), "__b": F.least(last, high.cast("long"))}).where("__a <= __b")
    rows = rows.withColumn("__k", F.explode(F.sequence("__a", "__b"))).withColumn("line", grid.lat_min + (F.col("__k") + shift) * grid.lat_step)
    beyond = F.when(north, F.col("line") > F.col("__start") + 1e-12).otherwise(F.col("line") < F.col("__start") - 1e-12)
    entered = F.col("__k") if reference == "center" else F.when(north, F.col("__k")).otherwise(F.col("__k") - 1)
    return rows.where(beyond).withColumn("lat_bin", entered).drop("__a", "__b", "__k")


def velocity_stats(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Mean, population deviation and maximum of step speeds in m/s over all particles."""
    w = Window.partitionBy(*keys).orderBy(order)
    km, dt = haversine(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat"), (micros() - F.lag(micros()).over(w)) / 1e6
    speed = df.select(F.when(dt > 0, km * 1000 / dt).alias("speed"))
    return speed.agg(F.count("speed").alias("steps"), F.avg("speed").alias("mean_speed"), F.stddev_pop("speed").alias("std_speed"), F.max("speed").alias("max_speed"))


def counts_per_time(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows of each time before and after cleaning."""
    a, b = (d.groupBy("time").agg(F.count("*").alias(n)) for d, n in ((raw, "n_raw"), (cleaned, "n_cleaned")))
    return a.join(b, "time", "left").withColumn("n_cleaned", F.coalesce("n_cleaned", F.lit(0)))


def depth_histogram(df: DataFrame, edges: list[float], z: str = "z", keys=("trajectory",)) -> DataFrame:
    """Observations and trajectories of each half-open depth range."""
    from trackmill.operators.segments import depth_bin

    rows = df.withColumn("depth_bin", depth_bin(F.col(z), list(zip(edges, edges[1:], strict=False)))).where("depth_bin is not null")
    per = rows.groupBy("depth_bin", *keys).agg(F.count("*").alias("c"))
    return per.groupBy("depth_bin").agg(F.sum("c").alias("observations"), F.count("*").alias("trajectories"))


def mode_region(df: DataFrame, label: str = "label", keys=("trajectory",)) -> DataFrame:
    """Most visited label of each trajectory, the smallest on a tie; null where there is none."""
    counts = df.groupBy(*keys, label).agg(F.count(label).alias("n"))
    best = F.min_by(label, F.struct(-F.col("n"), label))
    return counts.groupBy(*keys).agg(best.alias("mode"))


def exponent_grid(exponents: DataFrame, grid: RegularGrid, scale: str, value: str, lon: str = "lon", lat: str = "lat", release: str = "release_time", strict: bool = True) -> DataFrame:
    """A value for each release time, scale and cell of its centre; where two rows have one of them an error, or null if not strict."""
    rows = grid.assign(exponents, lon, lat).groupBy(release, scale, "lon_bin", "lat_bin").agg(F.first(value).alias(value), F.count("*").alias("__n"))
    once = F.when(F.col("__n") == 1, F.col(value))
    once = once.otherwise(F.raise_error(F.lit("two centres in one cell")).cast("double")) if strict else once
    return rows.select(release, scale, "lon_bin", "lat_bin", once.alias(value))


def velocity_components(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Mean and population deviation of the steps' eastward and northward speeds in m/s, and of their size."""
    w = Window.partitionBy(*keys).orderBy(order)
    dt = (micros() - F.lag(micros()).over(w)) / 1e6
    x, y = local_xy("lon", "lat", F.lag("lon").over(w), F.lag("lat").over(w))
    rows = df.select(dt.alias("dt"), x.alias("x"), y.alias("y")).where("dt > 0").select((F.col("x") * 1000 / F.col("dt")).alias("u"), (F.col("y") * 1000 / F.col("dt")).alias("v"))
    rows = rows.withColumn("speed", F.sqrt(F.col("u") ** 2 + F.col("v") ** 2))
    return rows.agg(F.count("speed").alias("steps"), *(f(c).alias(f"{n}_{c}") for c in ("u", "v", "speed") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max))))


def compare_velocity(a: DataFrame, b: DataFrame, keys=("trajectory",)) -> DataFrame:
    """The statistics of two runs side by side, and the differences of their means (second less first)."""
    left, right = (velocity_components(d, keys).select(*(F.col(c).alias(f"{c}_{s}") for c in ("steps", "mean_u", "mean_v", "mean_speed"))) for d, s in ((a, "a"), (b, "b")))
    # One row on either side.
    return left.crossJoin(right).withColumns({f"diff_{c}": F.col(f"mean_{c}_b") - F.col(f"mean_{c}_a") for c in ("u", "v", "speed")})


def simulation_direction(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """One row: forward, backward or mixed, by the sign of each particle's first step, and how many particles have one."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({"__s": F.signum((F.lead(micros()).over(w) - micros()).cast("double")), "__r": F.row_number().over(w)}).where("__r = 1 and __s is not null")
    name = F.when(F.min("__s") > 0, "forward").when(F.max("__s") < 0, "backward").otherwise("mixed")
    return rows.agg(name.alias("direction"), F.count("*").alias("particles"))

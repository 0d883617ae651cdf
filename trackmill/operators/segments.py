"""Segmenting, resampling and sequence rules inside trajectories, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import RADIUS_QC, delta_lon, haversine, wrap_lon
from trackmill.operators.cleaning import micros
from trackmill.shared import materialize

DAY = 86400 * 1_000_000


def _w(keys, order="obs"):
    return Window.partitionBy(*keys).orderBy(order)


def islands(df: DataFrame, breaks: Column, keys, order: str = "obs", name: str = "segment") -> DataFrame:
    """Number the runs of rows between breaks, from 0 for each key; breaks is true on the first row of a new run."""
    n = F.sum(F.when(F.coalesce(breaks, F.lit(False)), 1).otherwise(0)).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, n.cast("long"))


def gap_metrics(df: DataFrame, keys=("trajectory",), order: str = "obs", z: str | None = None, radius: float = RADIUS_QC) -> DataFrame:
    """Adds gap_days, gap_km, speed_km_day (null where no time passes) and, with z, vertical_rate a day, since the row before."""
    w = _w(keys, order)
    out = df.withColumns({"gap_days": (micros() - F.lag(micros()).over(w)) / DAY, "gap_km": haversine(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat", radius)})
    out = out.withColumn("speed_km_day", F.when(F.col("gap_days") > 0, F.col("gap_km") / F.col("gap_days")))
    return out if z is None else out.withColumn("vertical_rate", F.when(F.col("gap_days") > 0, F.abs(F.col(z) - F.lag(z).over(w)) / F.col("gap_days")))


def segment_by_gap(df: DataFrame, max_gap_days: float, max_speed: float | None = None, mode: str = "split", keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Break at long gaps and at too high speeds (km a day; movement without time breaks). ignore: one segment; longest: the one with most rows, then longest in time, then first."""
    rows = gap_metrics(df, keys, order)
    broken = F.col("gap_days") > max_gap_days
    if max_speed is not None:
        broken = broken | (F.col("speed_km_day") > max_speed) | ((F.col("gap_days") <= 0) & (F.col("gap_km") > 0))
    rows = islands(rows, F.lit(False) if mode == "ignore" else broken, keys, order).select(*df.columns, "segment")
    if mode != "longest":
        return rows
    sizes = rows.groupBy(*keys, "segment").agg(F.count("*").alias("n"), (F.max(micros()) - F.min(micros())).alias("d"))
    best = sizes.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("d"), "segment"))).where("r = 1")
    return rows.join(best.select(*keys, "segment"), [*keys, "segment"], "left_semi").select(*rows.columns)


def segment_by_cadence(df: DataFrame, step_seconds: float, tolerance_seconds: float, keys=("trajectory",), order: str = "obs") -> DataFrame:
    dt = (micros() - F.lag(micros()).over(_w(keys, order))) / 1e6
    return islands(df.withColumn("__dt", dt), F.abs(F.col("__dt") - step_seconds) > tolerance_seconds, keys, order).drop("__dt")


def split_on_qc(df: DataFrame, keep: Column, min_points: int, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Runs of consecutive rows that pass, of min_points or more."""
    rows = df.withColumn("__ok", F.coalesce(keep, F.lit(False)))
    rows = islands(rows, ~F.col("__ok"), keys, order, "__run").where("__ok")
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "__run"))).where(F.col("__n") >= min_points)
    return rows.withColumn("segment", (F.dense_rank().over(_w(keys, "__run")) - 1).cast("long")).select(*df.columns, "segment")


def merge_boundaries(df: DataFrame, max_points: int | None = None, max_days: float | None = None, max_speed: float | None = None, max_vertical_rate: float | None = None, keys=("trajectory",), order: str = "obs", z: str | None = None) -> DataFrame:
    """The first row of each segment but a trajectory's first, with what lies between it and the row before, and why they are joined or not.

    order counts all rows, those that no segment holds as well: gap_points of them lie between. Bounds that are None
    do not count; days (not negative), speed in m/s and vertical rate a day have to be known where they are bounded.
    reason: merged, gap_points_too_large, gap_duration_too_large, bridge_speed_too_large or bridge_vertical_rate_too_large.
    """
    w = _w(keys, order)
    rows = gap_metrics(df.withColumn("__before", F.lag("segment").over(w)).withColumn("gap_points", F.greatest(F.col(order) - F.lag(order).over(w) - 1, F.lit(0))), keys, order, z)
    rows = rows.where(F.col("segment") != F.col("__before")).drop("__before").withColumn("speed_m_s", F.col("speed_km_day") * 1000 / 86400)
    beyond = lambda c, most: F.col(c).isNull() | (F.col(c) > most)
    reason = F.lit("merged")
    for bad, name in reversed([
        (None if max_points is None else F.col("gap_points") > max_points, "gap_points_too_large"),
        (None if max_days is None else beyond("gap_days", max_days) | (F.col("gap_days") < 0), "gap_duration_too_large"),
        (None if max_speed is None else beyond("speed_m_s", max_speed), "bridge_speed_too_large"),
        (None if max_vertical_rate is None else beyond("vertical_rate", max_vertical_rate), "bridge_vertical_rate_too_large"),
    ]):
        reason = reason if bad is None else F.when(bad, name).otherwise(reason)
    return rows.withColumn("reason", reason)


def merge_segments(df: DataFrame, max_points: int | None = None, max_days: float | None = None, max_speed: float | None = None, max_vertical_rate: float | None = None, keys=("trajectory",), order: str = "obs", z: str | None = None) -> DataFrame:
    """Join neighbouring segments where merge_boundaries finds nothing too large: adds merged, numbered from 0."""
    found = merge_boundaries(df, max_points, max_days, max_speed, max_vertical_rate, keys, order, z)
    apart = found.where("reason != 'merged'").select(*keys, order, F.lit(True).alias("__break"))
    return islands(df.join(apart, [*keys, order], "left"), F.col("__break"), keys, order, "merged").select(*df.columns, "merged")


def directional_segments(df: DataFrame, threshold: float, column: str = "lat", keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Runs of steps of one sign beyond a dead band: a row for each segment with its first and last obs, direction and points."""
    w = _w(keys, order)
    step = F.lead(column).over(w) - F.col(column)
    sign = F.when(step > threshold, 1).when(step < -threshold, -1).otherwise(0)
    rows = df.withColumn("sign", F.when(F.lead(column).over(w).isNotNull(), sign)).where("sign is not null")
    rows = islands(rows, F.col("sign") != F.lag("sign").over(w), keys, order)
    last = rows.where("sign != 0").groupBy(*keys, "segment", "sign").agg(F.min(order).alias("first_obs"), F.max(order).alias("last_obs"), (F.count("*") + 1).alias("points"))
    return last


def rolling(df: DataFrame, column: str, size: int, how: str = "mean", keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Centred rolling mean or median of size rows, fewer at the ends; an even window reaches one further back."""
    w = _w(keys, order).rowsBetween(-(size // 2), size - 1 - size // 2)
    return df.withColumn(f"{column}_{how}", F.avg(column).over(w) if how == "mean" else frame_median(column, w))


def frame_median(column: str, frame) -> Column:
    """Median of the values in a window's frame of a few rows; Spark has no median over frames. Null where there are none."""
    values = F.sort_array(F.collect_list(column).over(frame))
    n = F.size(values)
    middle = lambda i: F.element_at(values, F.greatest(i, F.lit(1)))
    return F.when(n > 0, (middle(F.floor((n + 1) / 2).cast("int")) + middle((F.floor(n / 2) + 1).cast("int"))) / 2)


def contiguous_rolling_median(df: DataFrame, column: str, size: int, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Rolling median inside runs without nulls; null stays null."""
    rows = islands(df, F.col(column).isNull(), keys, order, "__run")
    half = size // 2
    w = Window.partitionBy(*keys, "__run", F.col(column).isNull()).orderBy(order).rowsBetween(-half, half)
    return rows.withColumn(f"{column}_median", F.when(F.col(column).isNotNull(), frame_median(column, w))).drop("__run")


def total_variation(df: DataFrame, column: str, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Sum of absolute differences of neighbouring rows that both have a value."""
    return df.withColumn("__d", F.abs(F.col(column) - F.lag(column).over(_w(keys, order)))).groupBy(*keys).agg(F.sum("__d").alias("total_variation"))


def isolated_label_filter(df: DataFrame, label: str, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """a, b, a becomes a, a, a (by the labels as they were); nulls and ends stay."""
    w = _w(keys, order)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    return df.withColumn(label, F.when(F.col(label).isNotNull() & (before == after) & (before != F.col(label)), before).otherwise(F.col(label)))


def depth_bin(z: Column, edges: list[tuple[float, float]]) -> Column:
    """Index of the first half-open range that holds z; null if none."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges))):
        out = F.when((z >= edges[i][0]) & (z < edges[i][1]), i).otherwise(out)
    return out


def fill_missing_bins(df: DataFrame, column: str, longest: int, same_only: bool = False, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Runs of nulls up to a length take the value before (or, with none, after); same_only: only between equal values."""
    rows = islands(df, F.col(column).isNotNull(), keys, order, "__run")
    w = _w(keys, order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    size = F.sum(F.col(column).isNull().cast("int")).over(Window.partitionBy(*keys, "__run"))
    value = F.when(before == after, before) if same_only else F.coalesce(before, after)
    filled = rows.withColumns({"__v": value, "__n": size})
    return filled.withColumn(column, F.when(F.col(column).isNull() & (F.col("__n") <= longest), F.col("__v")).otherwise(F.col(column))).drop("__run", "__v", "__n")


def split_by_bin(df: DataFrame, column: str, min_points: int, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Runs of one bin, of min_points or more; null breaks and goes."""
    w = _w(keys, order)
    rows = islands(df, ~F.col(column).eqNullSafe(F.lag(column).over(w)), keys, order, "__run").where(F.col(column).isNotNull())
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "__run"))).where(F.col("__n") >= min_points)
    return rows.withColumn("segment", (F.dense_rank().over(_w(keys, "__run")) - 1).cast("long")).select(*df.columns, "segment")


def cycle_representative(df: DataFrame, good=("1", "2"), keys=("trajectory", "cycle_number"), order: str = "obs", last: bool = False) -> DataFrame:
    """The best fix of each cycle: good position flag, good time flag, a position off (0, 0), one that repeats; then first (or last)."""
    repeats = F.count("*").over(Window.partitionBy(*keys, "lon", "lat"))
    bad = lambda c: (~F.coalesce(F.col(c).isin(*good), F.lit(False))).cast("int")
    rows = df.withColumns({"__a": bad("position_qc"), "__b": bad("time_qc") if "time_qc" in df.columns else F.lit(0), "__c": ((F.col("lon") == 0) & (F.col("lat") == 0)).cast("int"), "__d": -repeats})
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("__a", "__b", "__c", "__d", F.desc(order) if last else F.asc(order)))
    return rows.withColumn("__r", best).where("__r = 1").drop("__a", "__b", "__c", "__d", "__r")


def unwrap_lon(df: DataFrame, keys=("trajectory",), order: str = "obs", lon: str = "lon", out: str = "lon_unwrapped") -> DataFrame:
    """Longitude without jumps over half a turn, in runs without nulls."""
    w = _w(keys, order)
    rows = islands(df, F.col(lon).isNull(), keys, order, "__run")
    run = Window.partitionBy(*keys, "__run", F.col(lon).isNull()).orderBy(order)
    jump = F.col(lon) - F.lag(lon).over(run)
    turns = F.when(jump > 180, -360.0).when(jump < -180, 360.0).otherwise(0.0)
    rows = rows.withColumn("__turn", turns)
    return rows.withColumn(out, F.col(lon) + F.sum("__turn").over(run.rowsBetween(Window.unboundedPreceding, 0))).drop("__run", "__turn")


def resample(df: DataFrame, step_seconds: int, anchor: str = "native", columns: tuple[str, ...] = (), end_point: bool = True, keys=("trajectory",), reference_us: int = 0, filled: tuple[str, ...] = ()) -> DataFrame:
    """Positions and columns on a regular time grid of each trajectory, linear in time; longitude is unwrapped before.

    anchor: native (from each first time) or reference (from reference_us on, in microseconds since 1970, shared by
    all). With end_point, the last fix is kept too. filled: columns that take the last value before, else the next
    after. Every fix makes the grid times from itself up to the next fix, so nothing is joined by ranges.
    """
    step = step_seconds * 1_000_000
    rows = unwrap_lon(dedup(df, keys), keys, "time").withColumn("t", micros())
    w = Window.partitionBy(*keys).orderBy("t")
    values = ["lon_unwrapped", "lat", *columns]
    origin = F.min("t").over(Window.partitionBy(*keys)) if anchor == "native" else F.lit(reference_us)
    last = {c: F.coalesce(F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing))) for c in filled}
    rows = rows.withColumns({"t1": F.lead("t").over(w), "origin": origin, **{f"{c}_1": F.lead(c).over(w) for c in values}, **last})
    first = F.greatest(F.ceil((F.col("t") - F.col("origin")) / step).cast("long"), F.lit(0)) * step + F.col("origin")
    stop = F.coalesce(F.col("t1") - 1, F.col("t"))
    on_grid = F.when(first <= stop, F.sequence(first, stop, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    times = F.when(F.lit(end_point) & F.col("t1").isNull(), F.array_union(on_grid, F.array("t"))).otherwise(on_grid)
    out = rows.withColumn("g", F.explode(times))
    share = (F.col("g") - F.col("t")) / (F.col("t1") - F.col("t"))
    linear = {c: F.when(F.col("g") == F.col("t"), F.col(c)).otherwise(F.col(c) + share * (F.col(f"{c}_1") - F.col(c))) for c in values}
    fields = out.select(*keys, F.timestamp_micros("g").cast("timestamp_ntz").alias("time"), wrap_lon(linear["lon_unwrapped"]).alias("lon"), linear["lat"].alias("lat"), *(linear[c].alias(c) for c in columns), *filled)
    return fields.withColumn("obs", (F.row_number().over(Window.partitionBy(*keys).orderBy("time")) - 1).cast("long"))


def shift_to_start(df: DataFrame, reference_us: int, keys=("trajectory",)) -> DataFrame:
    """Times of each trajectory moved so that its first is reference_us (microseconds since 1970)."""
    moved = micros() - F.min(micros()).over(Window.partitionBy(*keys)) + reference_us
    return df.withColumn("time", F.timestamp_micros(moved).cast("timestamp_ntz"))


def dedup(df: DataFrame, keys) -> DataFrame:
    from trackmill.operators.cleaning import dedup_times

    return dedup_times(df.where("time is not null and lon is not null and lat is not null"), keys)


def numbered(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct values of columns with their place in order, from 0. Ranges of them are sorted apart and start from the counts of those before."""
    ranged = df.select(*columns).distinct().repartitionByRange(*columns)
    # Written down, as ranges are drawn from a sample that another run could draw otherwise.
    ranged = materialize(ranged.withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each partition
    ahead = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*columns)) - 1 + F.col("__ahead")
    return ranged.join(ahead, "__part").select(*columns, place.cast("long").alias(name))


def renumber(df: DataFrame, keys: list[str], order: str = "time") -> DataFrame:
    """Dense trajectory ids over keys, in their order, and obs from 0."""
    rows = df.join(numbered(df, keys, "new_id"), keys).withColumn("obs", (F.row_number().over(Window.partitionBy("new_id").orderBy(order)) - 1).cast("long"))
    return rows.drop("trajectory").withColumnRenamed("new_id", "trajectory")


def antimeridian_parts(df: DataFrame, keys, order: str = "obs", lon: str = "lon") -> DataFrame:
    """Parts of a path between steps of over 180 degrees of longitude."""
    return islands(df, F.abs(F.col(lon) - F.lag(lon).over(_w(keys, order))) > 180, keys, order, "part")


def release_age(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """release_time: the first observation's; age_us since then, negative in backward runs."""
    first = F.min_by("time", order).over(Window.partitionBy(*keys))
    rows = df.withColumn("release_time", first)
    return rows.withColumn("age_us", micros() - micros("release_time"))


def cadence(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Rows (step_s, n) of time steps, commonest first."""
    rows = df.select(((micros() - F.lag(micros()).over(_w(keys, order))) / 1e6).alias("step_s")).where("step_s is not null")
    return rows.groupBy("step_s").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "step_s")


def cadence_summary(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """One row: number, least, median, greatest and commonest (the smallest on a tie) time step in seconds."""
    steps = cadence(df, keys, order)
    known = df.select(((micros() - F.lag(micros()).over(_w(keys, order))) / 1e6).alias("step_s")).agg(F.median("step_s").alias("median_s"))
    return steps.agg(F.sum("n").alias("steps"), F.min("step_s").alias("min_s"), F.max("step_s").alias("max_s"), F.min_by("step_s", F.struct(-F.col("n"), "step_s")).alias("mode_s")).crossJoin(known)  # one row each


def jump_distance(keys=("trajectory",), order: str = "obs") -> Column:
    w = _w(keys, order)
    return F.abs(delta_lon(F.lag("lon").over(w), F.col("lon")))

"""Cell-to-cell and region transition matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import bearing, delta_lon, entropy, wrap_lon
from trackmill.functions.grid import RegularGrid
from trackmill.operators.cleaning import micros
from trackmill.operators.segments import resample

COUNTS = ("start_lon_bin", "start_lat_bin", "end_lon_bin", "end_lat_bin")


def timestep_table(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """One row (step_s): the commonest positive time step in seconds, the smallest on a tie; none without steps."""
    gap = (micros() - F.lag(micros()).over(Window.partitionBy(*keys).orderBy(order))).alias("gap")
    return df.select(gap).where("gap > 0").groupBy("gap").count().orderBy(F.desc("count"), "gap").limit(1).select((F.col("gap") / 1e6).alias("step_s"))


def source_timestep(df: DataFrame, keys=("trajectory",), order: str = "obs") -> float | None:
    """The step of timestep_table, None without one."""
    row = timestep_table(df, keys, order).first()
    return row["step_s"] if row else None


def check_timestep(df: DataFrame, seconds: float, keys=("trajectory",)) -> None:
    """ValueError where a step is longer than the source's and not a whole multiple of it."""
    source = source_timestep(df, keys)
    if source is not None and seconds > source and abs(seconds / source - round(seconds / source)) > 1e-9 * max(1.0, seconds / source):
        raise ValueError(f"a step of {seconds} s is no multiple of the source's {source} s")


def consecutive(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Steps between neighbouring rows: (keys, lon, lat, lon1, lat1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select(*keys, "lon", "lat", F.lead("lon").over(w).alias("lon1"), F.lead("lat").over(w).alias("lat1"))


def regular_chain(df: DataFrame, seconds: int, keys=("trajectory",)) -> DataFrame:
    """Steps that follow each other without overlap: from the first time on, every so many seconds, between interpolated points."""
    return consecutive(resample(df, seconds, end_point=False, keys=keys), keys)


def endpoints(df: DataFrame, seconds: int, keys=("trajectory",)) -> DataFrame:
    """From every row to where its trajectory is that much later: a fix there, else between the two fixes around it; none past the end."""
    step = seconds * 1_000_000
    rows = df.where("lon is not null and lat is not null").withColumn("t", micros())
    w = Window.partitionBy(*keys).orderBy("t")
    point = F.struct("t", "lon", "lat")
    rows = rows.withColumns({"after": F.first(point).over(w.rangeBetween(step, Window.unboundedFollowing)), "before": F.last(point).over(w.rangeBetween(Window.unboundedPreceding, step))}).where("after is not null")
    share = (F.col("t") + step - F.col("before.t")) / F.nullif(F.col("after.t") - F.col("before.t"), F.lit(0))
    share = F.coalesce(share, F.lit(0.0))
    lon = wrap_lon(F.col("before.lon") + share * delta_lon(F.col("before.lon"), F.col("after.lon")))
    exact = F.col("after.t") == F.col("t") + step
    return rows.select(*keys, "lon", "lat", F.when(exact, F.col("after.lon")).otherwise(lon).alias("lon1"), F.when(exact, F.col("after.lat")).otherwise(F.col("before.lat") + share * (F.col("after.lat") - F.col("before.lat"))).alias("lat1"))


def transition_matrix(steps: DataFrame, grid: RegularGrid) -> DataFrame:
    """Sparse matrix of steps with both ends in the grid: bins and centres of either cell, count, share of the start's steps."""
    turn = (lambda c: grid.wrapped(F.col(c))) if grid.periodic else F.col
    wrapped = steps.withColumns({c: turn(c) for c in ("lon", "lon1")})
    ends = grid.assign(grid.assign(wrapped, "lon", "lat", "start_"), "lon1", "lat1", "end_")
    counts = ends.groupBy(*COUNTS).agg(F.count("*").alias("transition_count"))
    centers = {f"{s}_{a}_center": getattr(grid, f"{a}_center")(F.col(f"{s}_{a}_bin")) for s in ("start", "end") for a in ("lon", "lat")}
    of_start = F.sum("transition_count").over(Window.partitionBy("start_lon_bin", "start_lat_bin"))
    return counts.withColumns(centers | {"transition_probability": F.col("transition_count") / of_start})


def transition_entropy(matrix: DataFrame, base: float = math.e) -> DataFrame:
    """Entropy of each start's destinations, and how many there are."""
    return matrix.groupBy("start_lon_bin", "start_lat_bin").agg(entropy(F.col("transition_probability"), base).alias("entropy"), F.count("*").alias("destinations"), F.sum("transition_count").alias("n_out"))


def cardinal_probabilities(matrix: DataFrame) -> DataFrame:
    """Shares of steps that stay, and that go north, east, south, west by great-circle bearing; a bearing between two sectors is halved, an undefined one quartered."""
    b = bearing("start_lon_center", "start_lat_center", "end_lon_center", "end_lat_center")
    stay = (F.col("start_lon_bin") == F.col("end_lon_bin")) & (F.col("start_lat_bin") == F.col("end_lat_bin"))
    rows = matrix.withColumns({"b": b, "stay": stay})

    def weight(middle: float) -> Column:
        off = F.abs(delta_lon(F.lit(middle), F.col("b")))
        return F.when(F.col("stay"), 0.0).when(F.col("b").isNull(), 0.25).when(off < 45, 1.0).when(off == 45, 0.5).otherwise(0.0)

    parts = {"north": 0.0, "east": 90.0, "south": 180.0, "west": 270.0}
    p = F.col("transition_probability")
    return rows.groupBy("start_lon_bin", "start_lat_bin").agg(F.sum(F.when(F.col("stay"), p).otherwise(0.0)).alias("stay"), *(F.sum(p * weight(m)).alias(n) for n, m in parts.items()))


def region_transitions(df: DataFrame, label: str = "label", keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Rows (age_us, origin, target, n, eligible, probability): particles by first label and label at an age.

    eligible: particles of the origin, the same at every age, so ended particles lower the sum of probabilities.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"age_us": micros() - F.min(micros()).over(w), "origin": F.min_by(label, order).over(w)}).where("origin is not null")
    eligible = rows.select(*keys, "origin").distinct().groupBy("origin").agg(F.count("*").alias("eligible"))
    counts = rows.where(F.col(label).isNotNull()).groupBy("age_us", "origin", F.col(label).alias("target")).agg(F.count("*").alias("n"))
    return counts.join(eligible, "origin").withColumn("probability", F.col("n") / F.col("eligible"))


def represented_fraction(transitions: DataFrame) -> DataFrame:
    """Of each age: the share of all eligible particles that is in some region."""
    rows = transitions.groupBy("age_us", "origin").agg(F.sum("n").alias("n"), F.first("eligible").alias("eligible"))
    return rows.groupBy("age_us").agg((F.sum("n") / F.sum("eligible")).alias("represented"))

"""Pair dispersion inside groups of particles released together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import chord, haversine, meridional
from trackmill.operators.cleaning import micros


def pair_members(df: DataFrame, mode: str = "all_pairs", distance: str = "haversine") -> DataFrame:
    """Pairs a < b of a group's members at one obs and time, with their distance. center_pairs: those with member 1.

    A group has five members or so, so this is an equi-join with a few rows for each key.
    """
    cols = ["group_id", "obs", "time"]
    side = lambda s: df.select(*cols, *(F.col(c).alias(f"{c}_{s}") for c in ("group_member", "lon", "lat")))
    met = side("a").join(side("b"), cols).where("group_member_a < group_member_b")
    if mode == "center_pairs":
        met = met.where("group_member_a = 1")
    how = {"haversine": haversine("lon_a", "lat_a", "lon_b", "lat_b"), "meridional": meridional("lat_a", "lat_b"), "chord": chord("lon_a", "lat_a", "lon_b", "lat_b")}[distance]
    return met.withColumn("km", how).withColumnsRenamed({"group_member_a": "member_a", "group_member_b": "member_b"})


PAIR = ("group_id", "member_a", "member_b")


def fsle_crossings(pairs: DataFrame, first: float, ratio: float, n: int) -> DataFrame:
    """For each pair and scale k: the first obs in [s_k, s_k+1) and the first beyond s_k+1 after the pair has passed s_0.

    Rows (pair, k, dt_days, log_ratio) with dt > 0; log_ratio is that of the actual distances.
    """
    w = Window.partitionBy(*PAIR).orderBy("obs").rowsBetween(Window.unboundedPreceding, 0)
    rows = pairs.where("km is not null").withColumn("__on", F.max(F.col("km") > first).over(w)).where("__on")
    low = first * F.pow(F.lit(float(ratio)), F.col("k"))
    scaled = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    point = F.struct(micros().alias("t"), "km")
    entered = F.min_by(point, F.when((F.col("km") >= low) & (F.col("km") < low * ratio), F.col("obs")))
    left = F.min_by(point, F.when(F.col("km") > low * ratio, F.col("obs")))
    met = scaled.groupBy(*PAIR, "k").agg(entered.alias("a"), left.alias("b")).where("a is not null and b is not null and b.t > a.t")
    return met.select(*PAIR, "k", ((F.col("b.t") - F.col("a.t")) / 86400e6).alias("dt_days"), F.log(F.col("b.km") / F.col("a.km")).alias("log_ratio"))


def fsle_spectrum(crossings: DataFrame) -> DataFrame:
    """Exponent of each scale: mean log ratio over mean time; with the mean inverse time and its standard error."""
    inverse = F.col("log_ratio") / F.col("dt_days")
    return crossings.groupBy("k").agg(F.count("*").alias("pairs"), (F.avg("log_ratio") / F.avg("dt_days")).alias("fsle"), F.avg(inverse).alias("mean_rate"), (F.stddev_samp(inverse) / F.sqrt(F.count("*"))).alias("rate_error"))


def centre_pairs(df: DataFrame) -> DataFrame:
    """Distance of every member to member 1 at each obs (whatever their times; time is member 1's), with the initial one, which has to be positive."""
    side = lambda s, *more: df.select("group_id", "obs", *more, *(F.col(c).alias(f"{c}_{s}") for c in ("group_member", "lon", "lat")))
    met = side("a", "time").where("group_member_a = 1").join(side("b").where("group_member_b > 1"), ["group_id", "obs"])
    pairs = met.withColumn("km", haversine("lon_a", "lat_a", "lon_b", "lat_b")).withColumnsRenamed({"group_member_a": "member_a", "group_member_b": "member_b"})
    first = F.min_by("km", "obs").over(Window.partitionBy(*PAIR))
    return pairs.withColumn("initial_km", first).where("initial_km > 0")


def aged(pairs: DataFrame) -> DataFrame:
    """Pairs with age: days since their first obs, without sign."""
    first = F.min_by(micros(), "obs").over(Window.partitionBy(*PAIR))
    return pairs.withColumn("age", F.abs(micros() - first) / 86400e6)


def _of_every_group(pairs: DataFrame, scales: list[float], scale: str, found: DataFrame, value: str, fill: bool, mask_zeros: bool, backward: bool) -> DataFrame:
    """A row for each group and scale: is_valid tells whether a value was found; what was not is 0 (fill) or null. Negative in backward runs; mask_zeros: zeros are null."""
    base = pairs.select("group_id").distinct().withColumn(scale, F.explode(F.array(*map(F.lit, scales))))
    rows = base.join(found, ["group_id", scale], "left").withColumn("is_valid", F.col(value).isNotNull())
    out = F.coalesce(value, F.lit(0.0)) if fill else F.col(value)
    out = -out if backward else out
    return rows.withColumn(value, F.when(out != 0, out) if mask_zeros else out).select("group_id", scale, value, "is_valid")


def fsle_map(pairs: DataFrame, scales: list[float], mask_zeros: bool = False, backward: bool = False) -> DataFrame:
    """Of each group and scale: log(distance / initial) / age where a member first reaches the scale, by the member that does so earliest; 0 where that is no growth, or where none does."""
    rows = aged(pairs).where("age > 0").withColumn("scale", F.explode(F.array(*map(F.lit, scales)))).where("km >= scale")
    crossed = rows.groupBy(*PAIR, "scale").agg(F.min_by(F.struct("age", "km", "initial_km"), "obs").alias("c"))
    best = crossed.groupBy("group_id", "scale").agg(F.min_by("c", F.struct("c.age", "member_b")).alias("c"))
    rate: Column = F.when(F.col("c.km") > F.col("c.initial_km"), F.log(F.col("c.km") / F.col("c.initial_km")) / F.col("c.age")).otherwise(0.0)
    return _of_every_group(pairs, scales, "scale", best.select("group_id", "scale", rate.alias("fsle")), "fsle", not mask_zeros, mask_zeros, backward)


def ftle_map(pairs: DataFrame, days: list[float], mode: str = "last_before_or_at", mask_short: bool = True, mask_zeros: bool = False, backward: bool = False) -> DataFrame:
    """Of each group and horizon: log(distance / initial) / age by the member that went farthest; 0 where that is no growth.

    mode: at the last obs up to the horizon, of pairs that reach it (last_before_or_at), or at the largest distance
    before it (max). A group without one has null, or 0 unless mask_short.
    """
    rows = aged(pairs).withColumn("horizon", F.explode(F.array(*map(F.lit, days)))).withColumn("last", F.max("age").over(Window.partitionBy(*PAIR)))
    rows = rows.where("age <= horizon and age > 0")
    rows = rows.where("last >= horizon") if mode == "last_before_or_at" else rows
    by = F.struct("age", "obs") if mode == "last_before_or_at" else F.struct("km", -F.col("obs"))
    member = rows.groupBy(*PAIR, "horizon").agg(F.max_by(F.struct("km", "age", "initial_km"), by).alias("p"))
    rate = F.when(F.col("p.km") > F.col("p.initial_km"), F.log(F.col("p.km") / F.col("p.initial_km")) / F.col("p.age")).otherwise(0.0)
    best = member.withColumn("ftle", rate).groupBy("group_id", "horizon").agg(F.max_by("ftle", F.struct("p.km", "ftle", -F.col("member_b"))).alias("ftle"))
    return _of_every_group(pairs, days, "horizon", best, "ftle", not (mask_short or mask_zeros), mask_zeros, backward)


def compare_trajectories(a: DataFrame, b: DataFrame, keys=("trajectory",)) -> DataFrame:
    """Two tables joined by trajectory and time, with the distance between them."""
    left, right = (d.select(*keys, "time", F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}")) for d, s in ((a, "a"), (b, "b")))
    return left.join(right, [*keys, "time"]).withColumn("km", haversine("lon_a", "lat_a", "lon_b", "lat_b"))

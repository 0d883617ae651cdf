"""Filters, predicates and cleaning rules of trajectory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import RADIUS_QC, delta_lon, haversine, wrap_lon


def micros(time: str = "time") -> Column:
    """Microseconds of a timestamp without zone (or with)."""
    return F.unix_micros(F.col(time).cast("timestamp"))


def filter_bbox(df: DataFrame, lon_min, lon_max, lat_min, lat_max) -> DataFrame:
    return df.where(F.col("lon").between(lon_min, lon_max) & F.col("lat").between(lat_min, lat_max))


def filter_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Closed range, open at an end that is None: times, depths, values."""
    for bound, keep in ((low, F.col(column) >= F.lit(low)), (high, F.col(column) <= F.lit(high))):
        df = df if bound is None else df.where(keep)
    return df


def filter_trajectories(df: DataFrame, ids, key: str = "trajectory") -> DataFrame:
    """Membership in a list, or a semi join with a table of ids."""
    return df.join(ids.select(key), key, "left_semi") if isinstance(ids, DataFrame) else df.where(F.col(key).isin(list(ids)))


def max_group_member(df: DataFrame, k: int) -> DataFrame:
    return df.where(F.col("group_member") <= k)


def group_member(df: DataFrame, k: int) -> DataFrame:
    return df.where(F.col("group_member") == k)


def at_sea(df: DataFrame, flags: tuple[int, ...] = (1,), column: str = "at_sea") -> DataFrame:
    """Rows whose whole-number flag is one of flags."""
    return df.where(F.col(column).isin(*flags))


def finite_fixes(df: DataFrame) -> DataFrame:
    """Rows with a time and finite positions."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(F.col("time").isNotNull() & fine("lon") & fine("lat"))


def truncate_at_first_invalid(df: DataFrame, keys=("trajectory",), order: str = "obs", only_invalid: bool = False) -> DataFrame:
    """Rows of each trajectory before its first without a position; only_invalid: all rows with one."""
    if only_invalid:
        return df.where("lon is not null and lat is not null")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("lon").isNull() | F.col("lat").isNull()
    return df.withColumn("__bad", F.max(bad).over(w)).where("not __bad").drop("__bad")


def truncate_stagnant(df: DataFrame, tolerance: float, steps: int, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Cut a trajectory where its first run of that many steps within the tolerance begins; one that begins so goes."""
    w = Window.partitionBy(*keys).orderBy(order)
    still = (F.abs(F.lead("lon").over(w) - F.col("lon")) <= tolerance) & (F.abs(F.lead("lat").over(w) - F.col("lat")) <= tolerance)
    rows = df.withColumn("__n", F.row_number().over(w)).withColumn("__still", F.coalesce(still, F.lit(False)))
    run = rows.withColumn("__run", F.sum(F.when(F.col("__still"), 0).otherwise(1)).over(w))
    length = run.withColumn("__len", F.sum(F.col("__still").cast("int")).over(Window.partitionBy(*keys, "__run")))
    first = F.min(F.when(F.col("__still") & (F.col("__len") >= steps), F.col("__n"))).over(Window.partitionBy(*keys))
    kept = length.withColumn("__cut", first).where((F.col("__cut").isNull()) | ((F.col("__n") <= F.col("__cut")) & (F.col("__cut") > 1)))
    return kept.select(*df.columns)


def dedup_times(df: DataFrame, keys=("trajectory",), order: str = "obs", keep: str = "first") -> DataFrame:
    """One row for each time of a trajectory."""
    by = F.asc(order) if keep == "first" else F.desc(order)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "time").orderBy(by))).where("__r = 1").drop("__r")


def dedup_times_or_fail(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """The last row of each time; an error where rows of one time have different positions."""
    w = Window.partitionBy(*keys, "time")
    rows = df.withColumns({"__r": F.row_number().over(w.orderBy(F.desc(order))), "__lo": F.min(F.struct("lon", "lat")).over(w), "__hi": F.max(F.struct("lon", "lat")).over(w)})
    checked = rows.withColumn("__r", F.when(F.col("__lo").eqNullSafe(F.col("__hi")), F.col("__r")).otherwise(F.raise_error(F.lit("positions conflict at one time")).cast("int")))
    return checked.where("__r = 1").drop("__r", "__lo", "__hi")


def time_direction(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Sign of the time steps of each trajectory: 1, -1, or null where they are mixed, zero or missing."""
    step = F.signum((micros() - F.lag(micros()).over(Window.partitionBy(*keys).orderBy(order))).cast("double"))
    signs = df.withColumn("__s", step).groupBy(*keys).agg(F.min("__s").alias("lo"), F.max("__s").alias("hi"))
    return signs.select(*keys, F.when((F.col("lo") == F.col("hi")) & (F.col("lo") != 0), F.col("lo").cast("int")).alias("direction"))


def check_monotonic_time(df: DataFrame, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """The same rows; reading them fails where times of a trajectory stand still or turn round."""
    w = Window.partitionBy(*keys)
    step = F.signum((micros() - F.lag(micros()).over(w.orderBy(order))).cast("double"))
    rows = df.withColumn("__s", step).withColumns({"__lo": F.min("__s").over(w), "__hi": F.max("__s").over(w)})
    fine = F.col("__lo").isNull() | ((F.col("__lo") == F.col("__hi")) & (F.col("__lo") != 0))
    return rows.where(F.when(fine, True).otherwise(F.raise_error(F.lit("times do not run one way")).cast("boolean"))).drop("__s", "__lo", "__hi")


def valid_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Finite values in the closed range."""
    fine = F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))
    return filter_range(df.where(fine), column, low, high)


def mask_below(value: Column, limit: float, absolute: bool = False) -> Column:
    return F.when((F.abs(value) if absolute else value) >= limit, value)


def qc_failures(rules: dict[str, tuple[str, ...]], missing_passes: bool = False) -> Column:
    """Names of failed rules (column to accepted flags), as an array."""
    failed = lambda c, ok: F.when(~F.coalesce(F.col(c).cast("string").isin(*ok), F.lit(missing_passes)), F.lit(c))
    return F.array_compact(F.array(*(failed(c, ok) for c, ok in rules.items())))


def adjusted_or_raw(adjusted: Column, raw: Column, adjusted_ok: Column, raw_ok: Column) -> tuple[Column, Column]:
    """The adjusted value where there is one, else the raw one, if that source passes its own checks; and the reason."""
    use = adjusted.isNotNull()
    value = F.when(use & adjusted_ok, adjusted).when(~use & raw.isNotNull() & raw_ok, raw)
    reason = F.when(use, F.when(adjusted_ok, "adjusted").otherwise("adjusted rejected")).when(raw.isNotNull(), F.when(raw_ok, "raw").otherwise("raw rejected")).otherwise("missing")
    return value, reason


def min_duration(df: DataFrame, days: float, keys=("trajectory",)) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("__d", F.max(micros()).over(w) - F.min(micros()).over(w)).where(F.col("__d") >= int(days * 86400 * 1_000_000)).drop("__d")


def life_trim_stride(df: DataFrame, min_life_days: float = 0.0, trim_days: float | None = None, stride: int = 1, keys=("trajectory",)) -> DataFrame:
    """Particles that live long enough, rows up to an age, every stride-th obs; adds age_us."""
    w = Window.partitionBy(*keys)
    day = 86400 * 1_000_000
    rows = df.withColumns({"age_us": micros() - F.min(micros()).over(w), "__life": F.max(micros()).over(w) - F.min(micros()).over(w)})
    rows = rows.where(F.col("__life") >= int(min_life_days * day)).drop("__life")
    rows = rows if trim_days is None else rows.where(F.col("age_us") <= int(trim_days * day))
    return rows.where(F.col("obs") % stride == 0)


def suspect_segments(df: DataFrame, max_speed: float, max_km: float, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """Consecutive fixes with time running on that are too fast (m/s) or too far apart."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({"lon0": F.lag("lon").over(w), "lat0": F.lag("lat").over(w), "dt_s": (micros() - F.lag(micros()).over(w)) / 1e6})
    rows = rows.where("dt_s > 0").withColumn("km", haversine("lon0", "lat0", "lon", "lat", RADIUS_QC)).withColumn("speed", F.col("km") * 1000 / F.col("dt_s"))
    return rows.where((F.col("speed") > max_speed) | (F.col("km") > max_km))


def worst_segments(df: DataFrame, n: int, *tie: str) -> DataFrame:
    return df.orderBy(F.desc("speed"), *tie).limit(n)


def convert_lon(df: DataFrame, positive: bool, lon: str = "lon") -> DataFrame:
    return df.withColumn(lon, wrap_lon(F.col(lon), 0.0 if positive else -180.0))


def drogued_period(df: DataFrame, min_length: float, platform: str = "platform", start: str | None = None, end: str | None = None) -> DataFrame:
    """Platforms with a long enough drogue; rows before it was lost, or up to the end date where it was not.

    start, end: columns with a platform's first and last dates, where there are any.
    """
    w = Window.partitionBy(platform)
    rows = df.withColumns({"__len": F.max("drogue_length").over(w), "__lost": F.min("drogue_lost").over(w)})
    since = F.lit(True) if start is None else F.coalesce(F.col("time") >= F.min(start).over(w), F.lit(True))
    until = F.lit(True) if end is None else F.coalesce(F.col("time") <= F.max(end).over(w), F.lit(True))
    rows = rows.withColumns({"__since": since, "__until": until})
    kept = F.when(F.col("__lost").isNotNull(), F.col("time") < F.col("__lost")).otherwise(F.col("__until"))
    return rows.where((F.col("__len") >= min_length) & F.col("__since") & kept).drop("__len", "__lost", "__since", "__until")


def clip_before(df: DataFrame, date: str, keys) -> DataFrame:
    """Rows before the earliest of a date column in each group; all where there is none."""
    first = F.min(date).over(Window.partitionBy(*keys))
    return df.withColumn("__first", first).where("__first is null or time < __first").drop("__first")


def first_metadata(df: DataFrame, columns: list[str], keys: list[str], order: str = "obs") -> DataFrame:
    """Of each group the first non-missing value of each column, and in multiple how many columns have several."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    several = sum((F.when(F.min(c) != F.max(c), 1).otherwise(0) for c in columns), F.lit(0))
    return df.groupBy(*keys).agg(*first, several.cast("long").alias("multiple"))


def select_by_region(df: DataFrame, inside: Column, mode: str, keys=("trajectory",), order: str = "obs") -> DataFrame:
    """initial_inside: by the first row; full_if_enters: by any row; from_first_entry: rows from the first inside on."""
    w = Window.partitionBy(*keys).orderBy(order)
    flag = F.coalesce(inside, F.lit(False))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    keep = {"initial_inside": F.first(flag).over(whole), "full_if_enters": F.max(flag).over(whole), "from_first_entry": F.max(flag).over(w.rowsBetween(Window.unboundedPreceding, 0))}[mode]
    return df.withColumn("__keep", keep).where("__keep").drop("__keep")


def mode_of_gaps(counts: DataFrame) -> DataFrame:
    """Gaps between neighbouring distinct times (t) with their numbers; ranges of times are sorted apart."""
    from trackmill.operators.segments import numbered

    placed = numbered(counts, ["t"], "place")
    after = placed.select((F.col("place") + 1).alias("place"), F.col("t").alias("before"))
    return placed.join(after, "place").select((F.col("t") - F.col("before")).alias("gap")).groupBy("gap").count()


def snap_times(df: DataFrame) -> DataFrame:
    """Times moved to a grid: its step is the modal gap of distinct times, its origin the commonest time."""
    from trackmill.shared import materialize

    counts = materialize(df.where("time is not null").groupBy(micros().alias("t")).count(), "times")
    step = mode_of_gaps(counts).where("gap > 0").orderBy(F.desc("count"), "gap").first()
    origin = counts.orderBy(F.desc("count"), "t").first()
    if step is None or origin is None:
        return df
    snapped = F.rint((micros() - origin["t"]) / step["gap"]).cast("long") * step["gap"] + origin["t"]
    return df.withColumn("time", F.timestamp_micros(snapped).cast("timestamp_ntz"))


def drop_duplicate_release(df: DataFrame, seconds: float = 1e-6, keys=("trajectory",)) -> DataFrame:
    """Without the second observation where it has the first one's time; later ones are renumbered."""
    w = Window.partitionBy(*keys).orderBy("obs")
    rows = df.withColumns({"__n": F.row_number().over(w), "__dt": F.abs(micros() - F.lag(micros()).over(w))})
    return rows.where(~((F.col("__n") == 2) & (F.col("__dt") <= max(1, int(seconds * 1e6))))).withColumn("obs", (F.row_number().over(w) - 1).cast("long")).drop("__n", "__dt")


def null_off_grid(df: DataFrame, step_seconds: int, tolerance_seconds: int = 1, columns=("lon", "lat")) -> DataFrame:
    """Values set to null where the time is not near a multiple of the step."""
    rest = F.pmod(micros(), F.lit(step_seconds * 1_000_000))
    near = F.least(rest, step_seconds * 1_000_000 - rest) <= tolerance_seconds * 1_000_000
    return df.withColumns({c: F.when(near, F.col(c)) for c in columns})


def wrapped_step(lon: str = "lon", keys=("trajectory",), order: str = "obs") -> Column:
    return delta_lon(F.lag(lon).over(Window.partitionBy(*keys).orderBy(order)), F.col(lon))

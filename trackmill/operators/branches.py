"""Modes of transport, their graph, and permeability across branches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import angle_difference, haversine, wilson
from trackmill.operators.spatial import radius_join
from trackmill.operators.transport import START, displaced

BINS = 72


def circular_peaks(weights: np.ndarray, sigma: float, prominence: float, distance: int) -> list[tuple[int, int, int]]:
    """Peaks of a circular histogram after Gaussian smoothing: (peak, first bin, last bin) of each basin, last taken round the circle."""
    n = len(weights)
    reach = min(n // 2, int(np.ceil(4 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    smooth = sum(k * np.roll(weights, s) for s, k in zip(range(-reach, reach + 1), kernel, strict=True))
    top = smooth.max()
    if top <= 0:
        return []
    peaks = []
    for i in sorted(range(n), key=lambda i: (-smooth[i], i)):
        if smooth[i] >= smooth[i - 1] and smooth[i] > smooth[(i + 1) % n]:
            # Prominence: down to the lower of the two valleys before a higher bin on either side.
            valleys = []
            for step in (1, -1):
                low, j = smooth[i], i
                for _ in range(n - 1):
                    j = (j + step) % n
                    low = min(low, smooth[j])
                    if smooth[j] > smooth[i]:
                        break
                valleys.append(low)
            if smooth[i] - max(valleys) >= prominence * top or smooth[i] == top:
                if all(min((i - p) % n, (p - i) % n) >= distance for p in peaks):
                    peaks.append(i)
    peaks.sort()
    if len(peaks) == 1:
        return [(peaks[0], peaks[0] - n // 2, peaks[0] - n // 2 + n - 1)]
    cuts = []
    for a, b in zip(peaks, [*peaks[1:], peaks[0] + n], strict=True):
        cuts.append(min(range(a + 1, b), key=lambda j: (smooth[j % n], j)))
    return [(p, cuts[i - 1] - (n if i == 0 else 0), cuts[i] - 1) for i, p in enumerate(peaks)]


def mode_members(matrix: DataFrame, sigma: float = 1.5, prominence: float = 0.1, distance: int = 6) -> DataFrame:
    """The moves of a matrix (see displaced) with the directional mode of their start cell that they belong to.

    The histogram of a cell (72 bins at most) is smoothed and cut at its minima by an Arrow function over arrays.
    """
    moves = displaced(matrix).where("not stay and bearing is not null").withColumn("bin", F.floor(F.col("bearing") / (360.0 / BINS)).cast("int"))
    histogram = moves.groupBy(*START, "bin").agg(F.sum("transition_count").alias("n")).groupBy(*START).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))
    dense = histogram.select(*START, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.try_element_at("h", i), F.lit(0)).cast("double")).alias("w"))

    def basins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *cell, w in batch[[*START, "w"]].itertuples(index=False):
                for mode, (_, a, b) in enumerate(circular_peaks(np.asarray(w, float), sigma, prominence, distance)):
                    rows += [(*cell, mode, j % BINS) for j in range(a, b + 1)]
            yield pd.DataFrame(rows, columns=[*START, "mode", "bin"]).astype("int64")

    member = dense.mapInPandas(basins, f"{START[0]} long, {START[1]} long, mode long, bin long")
    return moves.join(member, [*START, "bin"])


def detect_modes(matrix: DataFrame, min_count: int = 5, sigma: float = 1.5, prominence: float = 0.1, distance: int = 6) -> DataFrame:
    """Directional modes of each start cell: (start bins, mode, n, share, bearing, mean_km, accepted); moments of modes are sums over the matrix."""
    r, n = F.radians("bearing"), F.col("transition_count")
    modes = mode_members(matrix, sigma, prominence, distance).groupBy(*START, "mode").agg(F.sum(n).alias("n"), F.degrees(F.atan2(F.sum(n * F.sin(r)), F.sum(n * F.cos(r)))).alias("b"), (F.sum(n * F.col("distance")) / F.sum(n)).alias("mean_km"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*START))
    return modes.select(*START, "mode", "n", share.alias("share"), F.pmod("b", F.lit(360.0)).alias("bearing"), "mean_km", (F.col("n") >= min_count).alias("accepted"))


def mode_continuation(modes: DataFrame, matrix: DataFrame, max_turn: float = 60.0) -> DataFrame:
    """Directed edges from a mode along its moves to modes of the cell reached: score = share of moves times exp(-turn / 45); moves into cells without a mode are kept with a reason."""
    m = modes.where("accepted")
    moves = displaced(matrix).where("not stay and bearing is not null")
    own = moves.join(m.select(*START, "mode", F.col("bearing").alias("mode_bearing"), F.col("n").alias("mode_n")), START).where(F.abs(angle_difference(F.col("mode_bearing"), F.col("bearing"))) <= 45)
    target = m.select(F.col(START[0]).alias("end_lon_bin"), F.col(START[1]).alias("end_lat_bin"), F.col("mode").alias("to_mode"), F.col("bearing").alias("to_bearing"))
    met = own.join(target, ["end_lon_bin", "end_lat_bin"], "left").withColumn("turn", F.abs(angle_difference(F.col("mode_bearing"), F.col("to_bearing"))))
    reason = F.when(F.col("to_mode").isNull(), "no mode there").when(F.col("turn") > max_turn, "turns too far").otherwise("ok")
    score = F.when(reason == "ok", F.col("transition_count") / F.col("mode_n") * F.exp(-F.col("turn") / 45))
    return met.select(*START, "mode", "end_lon_bin", "end_lat_bin", "to_mode", "transition_count", "turn", reason.alias("reason"), score.alias("score"))


def select_edges(edges: DataFrame, keys: list[str], mass: float = 0.8, least: float = 0.1) -> DataFrame:
    """Of each source the best edges until their scores make up a mass of the sum, ties of the last one kept; those under a share of the best go."""
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(F.desc("score"))
    before = F.sum("score").over(ordered.rangeBetween(Window.unboundedPreceding, 0)) - F.sum("score").over(Window.partitionBy(*keys, "score"))
    rows = edges.where("score > 0").withColumns({"__before": before, "__all": F.sum("score").over(w), "__top": F.max("score").over(w)})
    return rows.where((F.col("__before") < mass * F.col("__all")) & (F.col("score") >= least * F.col("__top"))).select(*edges.columns)


def permeability(points: DataFrame, matrix: DataFrame, radius_km: float, offsets: list[float], least: int = 5) -> DataFrame:
    """Share of nearby moves that cross a branch, at offsets beside it, with Wilson intervals.

    points: (branch, point, lon, lat, bearing). A move from a cell within the radius crosses where its ends lie on
    different sides of the line through the point along its bearing, shifted by the offset. Offsets are a short list.
    """
    cells = displaced(matrix).withColumnsRenamed({"start_lon_center": "lon", "start_lat_center": "lat"})
    met = radius_join(points.select("branch", "point", "lon", "lat", F.col("bearing").alias("along")), cells.select("lon", "lat", "dx", "dy", "transition_count"), radius_km)
    x, y = (F.radians(F.col("lon_r") - F.col("lon")) * F.cos(F.radians("lat")) * 6371.0, F.radians(F.col("lat_r") - F.col("lat")) * 6371.0)
    a = F.radians("along")
    # To the right of the bearing, to a millimetre: what lies on the line is not put on a side by rounding errors.
    normal = lambda e, n: F.round(e * F.cos(a) - n * F.sin(a), 6)
    rows = met.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumns({"d0": normal(x, y) - F.col("offset"), "d1": normal(x + F.col("dx_r"), y + F.col("dy_r")) - F.col("offset")})
    n = F.col("transition_count_r")
    out = rows.groupBy("branch", "point", "offset").agg(F.sum(n).alias("n"), F.sum(F.when((F.col("d0") < 0) & (F.col("d1") >= 0), n).otherwise(0)).alias("to_right"), F.sum(F.when((F.col("d0") >= 0) & (F.col("d1") < 0), n).otherwise(0)).alias("to_left"))
    crossed = F.col("to_right") + F.col("to_left")
    low, high = wilson(crossed, F.col("n"))
    return out.withColumns({"p_cross": crossed / F.col("n"), "low": low, "high": high, "asymmetry": (F.col("to_right") - F.col("to_left")) / F.nullif(crossed, F.lit(0)), "supported": F.col("n") >= least})


def barrier_minima(profile: DataFrame, value: str = "p_cross") -> DataFrame:
    """Of each branch point: the offset where crossing is least among supported ones and less than at both neighbours."""
    w = Window.partitionBy("branch", "point").orderBy("offset")
    rows = profile.where("supported").withColumns({"__a": F.lag(value).over(w), "__b": F.lead(value).over(w)})
    lows = rows.where((F.col(value) < F.col("__a")) & (F.col(value) < F.col("__b")))
    best = lows.groupBy("branch", "point").agg(F.min_by(F.struct("offset", value), F.struct(value, F.abs("offset"), "offset")).alias("m"))
    return best.select("branch", "point", F.col("m.offset").alias("offset"), F.col(f"m.{value}").alias(value))


def path_geometry(points: DataFrame, keys=("branch",), order: str = "point") -> DataFrame:
    """Length, step and turn along ordered points: step_km from the point before, s_km from the first, turn at each point."""
    from trackmill.functions.geo import bearing

    w = Window.partitionBy(*keys).orderBy(order)
    rows = points.withColumn("step_km", haversine(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat")).withColumn("course", bearing("lon", "lat", F.lead("lon").over(w), F.lead("lat").over(w)))
    return rows.withColumns({"s_km": F.coalesce(F.sum("step_km").over(w), F.lit(0.0)), "turn": angle_difference(F.lag("course").over(w), F.col("course"))})

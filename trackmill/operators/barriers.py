"""Barriers to transport: minima of crossing profiles, and tracks of minima along a branch."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions.geo import haversine
from trackmill.functions.geodesic import inverse, wgs84_inverse
from trackmill.operators.segments import islands

KEYS = ("branch", "point")


def gaussian_weights(sigma: float) -> list[float]:
    """Weights of a Gaussian of that many steps out to four of them, either side of the middle."""
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def barrier_candidates(profile: DataFrame, spacing_km: float, sigma: float = 1.0, min_prominence: float = 0.05, min_width_km: float = 0.0, min_separation_km: float = 0.0, keys: Sequence[str] = KEYS, value: str = "p_cross") -> DataFrame:
    """Minima of each run of three or more supported offsets of a profile, with why those that do not count do not.

    profile: keys, offset, value, low and high (its interval), supported. A run is smoothed by a Gaussian of sigma
    steps, whose ends go on with the end's value; a minimum is lower than what is beside it (the middle of a level
    stretch), or an end that is lower than its neighbour. Prominence is the climb to the lower of the highest places
    on either side before something lower; the width is taken at half of it, between samples. From the most
    prominent on, a minimum is rejected as edge_minimum, low_prominence, narrow_minimum or
    too_close_to_stronger_minimum (to one that was accepted). reference: the higher of the two places that the
    prominence is measured from (at the end itself for an end); ci_overlaps_reference: its interval is not clear of that one's.

    A run is an array of at most as many values as there are offsets, and all rules are array functions.
    """
    w = Window.partitionBy(*keys).orderBy("offset")
    valid = F.col("supported") & F.col(value).isNotNull()
    rows = profile.withColumn("__run", F.sum((~valid).cast("int")).over(w)).where(valid)
    runs = rows.groupBy(*keys, "__run").agg(F.sort_array(F.collect_list(F.struct("offset", F.col(value).alias("value"), "low", "high"))).alias("p")).withColumn("n", F.size("p")).where("n >= 3")
    weights = gaussian_weights(sigma)
    reach, last = len(weights) // 2, F.col("n") - 1
    places = F.sequence(F.lit(0), last)
    at = lambda i: F.get(F.col("p"), F.greatest(F.lit(0), F.least(last, i)))["value"]
    # To 12 digits: level stretches must not be told apart by rounding errors.
    runs = runs.withColumn("s", F.transform(places, lambda i: F.round(sum(weight * at(i + k) for k, weight in zip(range(-reach, reach + 1), weights, strict=True)), 12)))
    s = lambda i: F.get(F.col("s"), i)
    some = lambda test: F.filter(places, test)

    def candidate(i: Column) -> Column:
        v = s(i)
        before, after = F.array_max(some(lambda j: (j < i) & (s(j) != v))), F.array_min(some(lambda j: (j > i) & (s(j) != v)))
        inner = F.coalesce((s(before) > v) & (s(after) > v) & (i == F.floor((before + after) / 2)), F.lit(False))
        end = ((i == 0) & (v < s(F.lit(1)))) | ((i == last) & (v < s(last - 1)))
        left, right = F.coalesce(F.array_max(some(lambda j: (j < i) & (s(j) < v))) + 1, F.lit(0)), F.coalesce(F.array_min(some(lambda j: (j > i) & (s(j) < v))) - 1, last)
        return F.struct(i.alias("i"), v.alias("v"), inner.alias("inner"), end.alias("end"), left.alias("left"), right.alias("right"))

    def based(c: Column) -> Column:
        """The highest places on either side, the one next to the minimum where there are several."""
        i = c["i"]
        high_left, high_right = F.array_max(F.slice("s", c["left"] + 1, i - c["left"] + 1)), F.array_max(F.slice("s", i + 1, c["right"] - i + 1))
        a, b = F.array_max(some(lambda j: (j >= c["left"]) & (j <= i) & (s(j) == high_left))), F.array_min(some(lambda j: (j >= i) & (j <= c["right"]) & (s(j) == high_right)))
        rise = F.when(c["inner"], F.least(high_left, high_right) - c["v"]).otherwise(0.0)
        return F.struct((-rise).alias("less"), i.alias("i"), c["v"].alias("v"), F.when(c["inner"], a).otherwise(i).alias("a"), F.when(c["inner"], b).otherwise(i).alias("b"), (~c["inner"]).alias("edge"))

    def measured(c: Column) -> Column:
        half = c["v"] - c["less"] / 2
        a, b = F.array_max(some(lambda j: (j >= c["a"]) & (j <= c["i"]) & (s(j) >= half))), F.array_min(some(lambda j: (j <= c["b"]) & (j >= c["i"]) & (s(j) >= half)))
        from_left = a + F.when(s(a) > half, (s(a) - half) / (s(a) - s(a + 1))).otherwise(0.0)
        to_right = b - F.when(s(b) > half, (s(b) - half) / (s(b) - s(b - 1))).otherwise(0.0)
        width = F.when(c["edge"], 0.0).otherwise((to_right - from_left) * spacing_km)
        return F.struct(c["i"].alias("i"), c["v"].alias("v"), (-c["less"]).alias("prominence"), width.alias("width_km"), F.when(s(c["a"]) >= s(c["b"]), c["a"]).otherwise(c["b"]).alias("reference"), c["edge"].alias("edge"))

    runs = runs.withColumn("c", F.filter(F.transform(places, candidate), lambda c: c["inner"] | c["end"]))
    runs = runs.withColumn("c", F.array_sort(F.transform("c", based))).withColumn("c", F.transform("c", measured))
    steps = max(1, math.ceil(min_separation_km / spacing_km))

    def judged(sofar: Column, c: Column) -> Column:
        near = F.exists(sofar, lambda x: (x["reasons"] == "") & (F.abs(x["i"] - c["i"]) < steps))
        reasons = {"edge_minimum": c["edge"], "low_prominence": c["prominence"] < min_prominence, "narrow_minimum": c["width_km"] < min_width_km, "too_close_to_stronger_minimum": near}
        said = F.concat_ws(";", *(F.when(test, name) for name, test in reasons.items()))
        return F.concat(sofar, F.array(F.struct(c["i"].alias("i"), said.alias("reasons"))))

    runs = runs.withColumn("r", F.aggregate("c", F.array().cast("array<struct<i:int,reasons:string>>"), judged))
    out = runs.select(*keys, "p", F.inline(F.arrays_zip("c", "r")))
    own, ref = F.get(F.col("p"), F.col("c.i")), F.get(F.col("p"), F.col("c.reference"))
    return out.select(
        *keys,
        own["offset"].alias("offset"),
        own["value"].alias(value),
        F.col("c.v").alias("smoothed"),
        "c.prominence",
        "c.width_km",
        ref["offset"].alias("reference_offset"),
        ref["value"].alias(f"reference_{value}"),
        (own["high"] >= ref["low"]).alias("ci_overlaps_reference"),
        (F.col("r.reasons") == "").alias("accepted"),
        F.col("r.reasons").alias("reasons"),
    )


# Tracks


def cheapest(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of finite cost: as many as there can be, and of those the cheapest in sum."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in cheapest(cost.T))
    finite = np.isfinite(cost)
    # A pair that may not be costs more than all others together.
    work = np.where(finite, cost, 1 + 2 * cost[finite].sum() if finite.any() else 1.0)
    rows, cols = work.shape
    price, gain, owner = np.zeros(cols), np.zeros(rows), np.full(cols, -1)
    for r in range(rows):
        # The shortest way, by reduced costs, from this row to a column without an owner.
        least, via, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        row, col, far = r, -1, 0.0
        while True:
            reduced = far + work[row] - gain[row] - price
            better = ~done & (reduced < least)
            least[better], via[better] = reduced[better], col
            col = int(np.argmin(np.where(done, np.inf, least)))
            far = least[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        gain[r] += far
        for c in np.flatnonzero(done):
            if c != col:
                gain[owner[c]] += far - least[c]
                price[c] -= far - least[c]
        while col >= 0:
            before = via[col]
            owner[col] = r if before < 0 else owner[before]
            col = before
    return sorted((int(owner[c]), c) for c in range(cols) if owner[c] >= 0 and finite[owner[c], c])


def link_costs(ends: np.ndarray, here: np.ndarray, max_offset_km: float, max_gap_km: float, sign_band_km: float) -> np.ndarray:
    """Cost of going on from each end to each minimum (rows: lon, lat, offset, value); infinite where that may not be.

    The offset and the distance must not jump too far, and the side must not change beyond a band around the line.
    """
    a, b = ends[:, None, :], here[None, :, :]
    lon0, lat0, lon1, lat1 = (np.broadcast_to(x, (len(ends), len(here))) for x in (a[..., 0], a[..., 1], b[..., 0], b[..., 1]))
    km = inverse(lon0, lat0, lon1, lat1)[0]
    jump = np.abs(a[..., 2] - b[..., 2])
    same = (np.abs(a[..., 2]) <= sign_band_km) | (np.abs(b[..., 2]) <= sign_band_km) | (np.sign(a[..., 2]) == np.sign(b[..., 2]))
    cost = jump / max_offset_km + km / max_gap_km + np.abs(a[..., 3] - b[..., 3])
    return np.where((jump <= max_offset_km) & (km <= max_gap_km) & same, cost, np.inf)


def link_tracks(minima: DataFrame, max_offset_km: float, max_gap_km: float, max_missing: int = 1, sign_band_km: float = 0.0, branch: str = "branch", order: str = "sequence", value: str = "p_cross") -> DataFrame:
    """minima (branch, order, offset, lon, lat, value; other columns stay) with stretch and track, from 0 in each branch and stretch.

    Section by section, minima go on from the tracks that end at most max_missing sections before, by the cheapest
    assignment of the most pairs; others begin tracks, numbered by section and offset. Where a branch has no minimum
    for more than max_missing sections nothing can go on, so it is cut into stretches there, which are scanned apart.
    A scan reads sorted rows as a stream and holds the tracks that are open, never a whole branch.
    """
    w = Window.partitionBy(branch).orderBy(order)
    rows = islands(minima, F.col(order) - F.lag(order).over(w) > max_missing + 1, [branch], order, "stretch")
    carried = rows.columns
    names = [branch, "stretch", order, "lon", "lat", "offset", value]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        where = [carried.index(c) for c in names]
        stream = (row for batch in batches for row in batch.itertuples(index=False, name=None))
        for _, stretch in itertools.groupby(stream, key=lambda r: (r[where[0]], r[where[1]])):
            open_ends: list[tuple[int, int, tuple]] = []  # track, section, (lon, lat, offset, value)
            made = 0
            for section, group in itertools.groupby(stretch, key=lambda r: r[where[2]]):
                here = list(group)
                ends = [e for e in open_ends if section - e[1] <= max_missing + 1]
                spots = [tuple(r[k] for k in where[3:]) for r in here]
                taken = {}
                if ends:
                    cost = link_costs(np.array([e[2] for e in ends], float), np.array(spots, float), max_offset_km, max_gap_km, sign_band_km)
                    taken = {c: r for r, c in cheapest(cost)}
                kept = {e[0]: e for e in ends}
                for k, row in enumerate(here):
                    track = ends[taken[k]][0] if k in taken else made
                    made += k not in taken
                    kept[track] = (track, section, spots[k])
                    out.append((*row, track))
                open_ends = [kept[t] for t in sorted(kept)]
                if len(out) > 4096:
                    yield pd.DataFrame(out, columns=[*carried, "track"])
                    out = []
        yield pd.DataFrame(out, columns=[*carried, "track"])

    ordered = rows.repartition(branch, "stretch").sortWithinPartitions(branch, "stretch", order, "offset")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ordered.mapInPandas(scan, f"{schema}, track long")


def track_geometry(tracks: DataFrame, branch: str = "branch", order: str = "sequence", ellipsoid: bool = True) -> DataFrame:
    """tracks with place (from 0), part (a new one after missing sections), step_km from the place before and along_km, which leaves missing sections out."""
    w = Window.partitionBy(branch, "stretch", "track").orderBy(order)
    lon, lat = F.lag("lon").over(w), F.lag("lat").over(w)
    rows = tracks.withColumns({"__lon": lon, "__lat": lat, "__gap": F.col(order) - F.lag(order).over(w), "place": F.row_number().over(w) - 1})
    km = wgs84_inverse("__lon", "__lat", "lon", "lat")["km"] if ellipsoid else haversine("__lon", "__lat", "lon", "lat")
    rows = rows.withColumn("step_km", F.when(F.col("__gap").isNotNull(), km))
    return rows.withColumns({"part": F.sum(F.coalesce((F.col("__gap") > 1).cast("int"), F.lit(0))).over(w), "along_km": F.sum(F.when(F.col("__gap") == 1, F.col("step_km")).otherwise(0.0)).over(w), "missing": F.coalesce(F.col("__gap") - 1, F.lit(0))}).drop("__lon", "__lat", "__gap")


def track_summary(geometry: DataFrame, least_points: int = 3, least_km: float = 0.0, branch: str = "branch", order: str = "sequence", value: str = "p_cross") -> DataFrame:
    """One row for each track: points, length, covered share of its sections, gaps and their length, statistics of the value, robust."""
    out = geometry.groupBy(branch, "stretch", "track").agg(
        F.count("*").alias("points"),
        F.max("along_km").alias("length_km"),
        (F.count("*") / (F.max(order) - F.min(order) + 1)).alias("coverage"),
        F.count(F.when(F.col("missing") > 0, 1)).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("missing") > 0, F.col("step_km"))), F.lit(0.0)).alias("gap_km"),
        F.avg(value).alias("mean"),
        F.median(value).alias("median"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )
    return out.withColumn("robust", (F.col("points") >= least_points) & (F.col("length_km") >= least_km))

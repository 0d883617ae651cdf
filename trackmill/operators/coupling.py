"""Pairs of tracks near each other at one time, by blocks of neighbouring tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmill.functions.geo import RADIUS
from trackmill.operators.nearest import _curve, _unit
from trackmill.shared import materialize, small_batches

#: Points of a block of tracks.
POINTS = 1 << 17
#: Pairs of tracks that a task looks at together, and rows that it hands on together.
PAIRS, ROWS = 1 << 22, 1 << 17
#: Most parts that pairs of blocks are dealt to.
MOST_PARTS = 2000
#: Places of one time that are compared together.
STRIP = 128
SIDES = [f"{e}_{c}" for c in "xyz" for e in ("lo", "hi")]


def _km(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))


def _centre(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The circular mean of two longitudes."""
    a, b = np.radians(a), np.radians(b)
    return np.degrees(np.arctan2(np.sin(a) + np.sin(b), np.cos(a) + np.cos(b)))


def _inside(x: np.ndarray, y: np.ndarray, ring: list[dict]) -> np.ndarray:
    """Which points are in a ring, edges included; as spatial.inside_polygon."""
    edge = odd = np.zeros(len(x), bool)
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if len(ring) >= 3 else ():
        (ax, ay), (bx, by) = (a["x"], a["y"]), (b["x"], b["y"])
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        edge = edge | ((cross == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by)))
        if ay != by:
            odd = odd ^ (((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax))
    return edge | odd


def _labelled(x: np.ndarray, y: np.ndarray, regions: list[dict]) -> np.ndarray:
    """Which points have a label by the first of the regions that holds them."""
    held, named = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for r in regions:
        at = np.flatnonzero(~held & (x >= r["x0"]) & (x <= r["x1"]) & (y >= r["y0"]) & (y <= r["y1"]))
        at = at[_inside(x[at], y[at], r["polygon"] or [])]
        held[at], named[at] = True, r["label"] is not None
    return named


class _Side:
    """Tracks of a block as arrays, in order of track and time."""

    def __init__(self, tracks: pa.StructArray):
        self.id, times, *values = tracks.flatten()
        self.n, flat = len(self.id), times.flatten()
        owner = np.repeat(np.arange(self.n), pc.list_value_length(times).to_numpy(zero_copy_only=False))
        micros = flat.cast(pa.int64()).to_numpy(zero_copy_only=False)
        order = np.lexsort((micros, owner))
        self.owner, self.micros = owner[order], micros[order]
        self.columns = [c.take(pa.array(order)) for c in (flat, *(v.flatten() for v in values))]
        self.lon, self.lat = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in self.columns[1:3])
        self.unit = _unit(self.lon, self.lat)

    def ranked(self, times: np.ndarray) -> None:
        """Places of the rows' times among times; rows by time and latitude, and where each time begins."""
        self.rank = np.searchsorted(times, self.micros)
        self.key = self.owner * len(times) + self.rank
        self.twice = bool((self.key[1:] == self.key[:-1]).any())
        placed = np.flatnonzero(~np.isnan(self.lon) & ~np.isnan(self.lat))
        self.by_time = placed[np.lexsort((self.lat[placed], self.rank[placed]))]


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of count from first on: which range, and the numbers in it."""
    which = np.repeat(np.arange(len(count)), count)
    return which, first[which] + np.arange(len(which)) - (np.cumsum(count) - count)[which]


def _starts(a: _Side, b: _Side, lo: int, hi: int, times: int, codes: tuple[np.ndarray, np.ndarray], same: bool, km: float, regions: list[dict] | None):
    """Pairs (track of a from lo to hi, track of b), the place of their closest time and the least distance."""
    best, closest, start = np.full((hi - lo) * b.n, np.inf), np.full((hi - lo) * b.n, np.inf), np.zeros((hi - lo) * b.n, np.int32)
    reach, least = math.degrees(km / RADIUS) * (1 + 1e-9) + 1e-9, math.cos(min(km / RADIUS, math.pi)) - 1e-14
    mine = a.by_time[(a.owner[a.by_time] >= lo) & (a.owner[a.by_time] < hi)]
    ends = [np.searchsorted(s.rank[rows], np.arange(times + 1)) for s, rows in ((a, mine), (b, b.by_time))]
    for t in np.flatnonzero((np.diff(ends[0]) > 0) & (np.diff(ends[1]) > 0)):
        asks, others = mine[ends[0][t] : ends[0][t + 1]], b.by_time[ends[1][t] : ends[1][t + 1]]
        south = b.lat[others]
        for strip in (asks[s : s + STRIP] for s in range(0, len(asks), STRIP)):
            some = others[np.searchsorted(south, a.lat[strip[0]] - reach) : np.searchsorted(south, a.lat[strip[-1]] + reach, "right")]
            if not len(some):
                continue
            i, j = np.nonzero(a.unit[strip] @ b.unit[some].T >= least)
            i, j = strip[i], some[j]
            one, two = codes[0][a.owner[i]], codes[1][b.owner[j]]
            keep = one < two if same else one != two
            i, j = i[keep], j[keep]
            apart = _km(a.lon[i], a.lat[i], b.lon[j], b.lat[j])
            keep = apart <= km
            if regions is not None:
                keep &= _labelled(np.round(_centre(a.lon[i], b.lon[j]), 9), (a.lat[i] + b.lat[j]) / 2, regions)
            i, j, apart = i[keep], j[keep], apart[keep]
            if a.twice or b.twice:  # of rows of one pair the nearest is written last
                order = np.argsort(-apart, kind="stable")
                i, j, apart = i[order], j[order], apart[order]
            pair, near = (a.owner[i] - lo) * b.n + b.owner[j], np.round(apart, 6)
            closer = near < best[pair]  # times ascend: the first of equal ones stays
            best[pair[closer]], start[pair[closer]] = near[closer], t
            closest[pair] = np.minimum(closest[pair], apart)
    found = np.flatnonzero(best < np.inf)
    return found // b.n + lo, found % b.n, start[found], closest[found]


def _coupled_in(km: float, life: int, digits: int | None):
    """Of rows (p, q, asks, others, regions), tracks of two blocks, the coupled rows of their pairs."""
    # Adding 0.0 leaves no negative zero.
    rounded = lambda x: x if digits is None else pc.add(pc.round(x, digits, "half_towards_infinity"), 0.0)

    def coupled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("p")[row] == batch.column("q")[row]
                a, b = (_Side(batch.column(c)[row].values) for c in ("asks", "others"))
                regions = batch.column("regions")[row].as_py() if "regions" in batch.schema.names else None
                times = np.unique(np.concatenate([a.micros, b.micros]))
                for side in (a, b):
                    side.ranked(times)
                codes = pc.rank(pa.concat_arrays([a.id, b.id]), tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
                codes = codes[: a.n], codes[a.n :]
                ids = pa.concat_arrays([a.id, b.id])
                columns = [pa.concat_arrays(c) for c in zip(a.columns, b.columns, strict=True)]
                step = max(1, PAIRS // b.n)
                for lo in range(0, a.n, step):
                    i, j, start, closest = _starts(a, b, lo, min(a.n, lo + step), len(times), codes, same, km, regions)
                    first = np.searchsorted(a.key, i * len(times) + start)
                    count = np.searchsorted(a.key, (i + 1) * len(times)) - first
                    ends, done = np.cumsum(count), 0
                    while done < len(i):
                        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + ROWS, "right")))
                        some, done = slice(done, until), until
                        pair, mine = _expand(first[some], count[some])
                        key = j[some][pair] * len(times) + a.rank[mine]
                        at = np.searchsorted(b.key, key)
                        which, theirs = _expand(at, np.searchsorted(b.key, key, "right") - at)
                        pair, mine = pair[which], mine[which]
                        rows = np.bincount(pair, minlength=until - some.start)
                        last = np.cumsum(rows) - 1  # a pair's rows are in order of time, and it has its start
                        lived = a.micros[mine[last]] - a.micros[mine[last - rows + 1]]
                        keep = ((rows >= 2) & (lived >= life))[pair]
                        pair, mine, theirs = pair[keep], mine[keep], theirs[keep]
                        if not len(pair):
                            continue
                        swap = codes[0][i[some][pair]] > codes[1][j[some][pair]]
                        tracks, places = (i[some][pair], a.n + j[some][pair]), (mine, len(a.owner) + theirs)
                        track = [i[some][pair], a.n + j[some][pair]]
                        place = [mine, len(a.owner) + theirs]
                        (id1, id2), (row1, row2) = ((pa.array(np.where(swap, y, x)), pa.array(np.where(swap, x, y))) for x, y in (track, place))
                        values = {"id1": ids.take(id1), "id2": ids.take(id2), "time": columns[0].take(row1), "start": columns[0].take(pa.array(first[some][pair])), "closest_km": rounded(pa.array(closest[some])).take(pa.array(pair))}
                        values |= {f"{c}{k}": v.take(at) for k, at in ((1, row1), (2, row2)) for c, v in zip(("lon", "lat"), columns[1:3], strict=True)}
                        lon1, lat1, lon2, lat2 = (values[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("lon1", "lat1", "lon2", "lat2"))
                        z1, z2 = (columns[3].take(at).cast(pa.float64()) for at in (row1, row2))
                        values |= {"rows": pa.array(rows[pair]), "km": rounded(pa.array(_km(lon1, lat1, lon2, lat2))), "lon": rounded(pa.array(_centre(lon1, lon2))), "lat": pa.array((lat1 + lat2) / 2)}
                        # A depth that one of them lacks is the other's.
                        yield pa.RecordBatch.from_pydict(values | {"z": rounded(pc.coalesce(pc.divide(pc.add(z1, z2), 2.0), z1, z2))})

    return coupled


def _meet(a: str, b: str, chord: float) -> Column:
    """Whether two boxes whose columns begin with a and b come within a chord of each other and share times."""
    apart = lambda c: F.greatest(F.lit(0.0), F.col(f"{a}lo_{c}") - F.col(f"{b}hi_{c}"), F.col(f"{b}lo_{c}") - F.col(f"{a}hi_{c}"))
    return (sum((apart(c) * apart(c) for c in "xyz"), F.lit(0.0)) <= chord * chord * (1 + 1e-9) + 1e-12) & (F.col(f"{a}lo_t") <= F.col(f"{b}hi_t")) & (F.col(f"{b}lo_t") <= F.col(f"{a}hi_t"))


def coupled_rows(points: DataFrame, km: float, life: int, regions: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """The rows of spatial.couple_trajectories.

    points: (trajectory, time, lon, lat, z); life in microseconds.

    Tracks are sorted along a curve by their boxes' centres and cut into blocks. Two blocks whose boxes come near each other meet in
    one row, with those tracks alone that come near the other block's box. There the pairs' closest times are found and
    their rows handed on in pieces, so no pair and no row of a pair is ever moved; what is moved are tracks, once for each
    block that they come near to. A track is whole in a task.
    """
    lon, lat = F.radians("lon"), F.radians("lat")
    placed = ~F.isnan("lon") & ~F.isnan("lat")
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat), "t": F.col("time")}
    bounds = [f(F.when(placed, v)).alias(f"{name}_{c}") for c, v in axes.items() for name, f in (("lo", F.min), ("hi", F.max))]
    sides = [*SIDES, "lo_t", "hi_t"]
    known = points.where("trajectory is not null and time is not null and lon is not null and lat is not null")
    packed = known.groupBy("trajectory").agg(F.collect_list(F.struct("time", "lon", "lat", "z")).alias("rows"), *bounds, F.min("lat").alias("south"), F.max(F.when(placed, F.col("lat"))).alias("north"))
    columns = ["trajectory", "times", "lons", "lats", "zs"]
    packed = packed.where("lo_t is not null").select("trajectory", *(F.col(f"rows.{c}").alias(f"{c}s") for c in ("time", "lon", "lat", "z")), *sides, "south", "north")
    packed = materialize(packed, "couple-tracks")
    blocks = max(1, math.ceil((packed.agg(F.sum(F.size("times"))).first()[0] or 0) / POINTS))
    x, y, z = (F.col(f"lo_{c}") + F.col(f"hi_{c}") for c in "xyz")
    tracks = packed.repartitionByRange(blocks, _curve(F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))), "trajectory")
    tracks = materialize(tracks.withColumn("block", F.spark_partition_id()), "couple-blocks")
    chord = 2 * math.sin(min(km / RADIUS, math.pi) / 2)
    most = [(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in sides]
    boxes = materialize(tracks.groupBy("block").agg(*most, F.min("south").alias("south"), F.max("north").alias("north")), "couple-boxes")  # a row for each block
    named = lambda a: boxes.select(*(F.col(c).alias(f"{a}_{c}") for c in ("block", *sides)))
    pairs = named("p").crossJoin(F.broadcast(named("q"))).where((F.col("p_block") <= F.col("q_block")) & _meet("p_", "q_", chord))
    pairs = materialize(pairs, "couple-pairs")
    track, parts = F.struct(*columns), min(MOST_PARTS, max(1, pairs.count()))

    def dealt(mine: str, other: str, name: str) -> DataFrame:
        met = tracks.join(pairs, tracks["block"] == pairs[f"{mine}_block"]).where(_meet("", f"{other}_", chord))
        # Few rows are much work: they are dealt to as many parts as there are, not to as many as their bytes ask for.
        return met.repartition(parts, "p_block", "q_block").groupBy(F.col("p_block").alias("p"), F.col("q_block").alias("q")).agg(F.collect_list(track).alias(name))

    met = dealt("p", "q", "asks").join(dealt("q", "p", "others"), ["p", "q"])
    if regions is not None:
        reach = math.degrees(km / RADIUS) + 1e-9
        order = F.struct((-F.col("priority")).alias("priority"), "numeric_label", "label", "x0", "x1", "y0", "y1", "polygon")
        near = boxes.join(regions, (F.col("y1") >= F.col("south") - reach) & (F.col("y0") <= F.col("north") + reach))
        met = met.join(near.groupBy(F.col("block").alias("p")).agg(F.array_sort(F.collect_list(order)).alias("regions")), "p")
    small_batches(points.sparkSession, 4 << 20)
    kind = {c: points.schema[c].dataType for c in points.columns}
    out = {"id1": kind["trajectory"], "id2": kind["trajectory"], "time": kind["time"], "start": kind["time"], "closest_km": T.DoubleType()}
    out |= {f"{c}{k}": kind[c] for k in (1, 2) for c in ("lon", "lat")} | {"rows": T.LongType()} | dict.fromkeys(("km", "lon", "lat", "z"), T.DoubleType())
    return met.mapInArrow(_coupled_in(km, life, digits), T.StructType([T.StructField(c, t) for c, t in out.items()]))

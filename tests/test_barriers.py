"""Minima of profiles and their tracks against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions.geodesic import inverse
from trackmill.operators import barriers as B
from trackmill.plans import catalog, crossings
from trackmill.plans.tracks import tracks as track_table

PROFILE = "branch int, point int, offset double, p_cross double, low double, high double, supported boolean"


def plain_minima(values, step, sigma, prominence, width, separation):
    """Walks outwards from every minimum, one step at a time."""
    n, w = len(values), B.gaussian_weights(sigma)
    r = len(w) // 2
    s = [round(sum(w[k + r] * values[min(max(i + k, 0), n - 1)] for k in range(-r, r + 1)), 12) for i in range(n)]
    found = []
    for i in range(n):
        a = b = i
        while a > 0 and s[a - 1] == s[i]:
            a -= 1
        while b < n - 1 and s[b + 1] == s[i]:
            b += 1
        if a > 0 and b < n - 1 and s[a - 1] > s[i] < s[b + 1] and i == (a + b) // 2:
            sides = []
            for d in (-1, 1):
                j, top, base = i, s[i], i
                while 0 <= j + d < n and s[j + d] >= s[i]:
                    j += d
                    if s[j] > top:
                        top, base = s[j], j
                sides.append((top, base))
            rise = min(sides[0][0], sides[1][0]) - s[i]
            half, ends = s[i] + rise / 2, []
            for d in (-1, 1):
                j = i
                while s[j] < half:
                    j += d
                ends.append(j - d * ((s[j] - half) / (s[j] - s[j - d]) if s[j] > half else 0.0))
            found.append([-rise, i, (ends[1] - ends[0]) * step, sides[0][1] if sides[0][0] >= sides[1][0] else sides[1][1], False])
        elif (i == 0 and s[0] < s[1]) or (i == n - 1 and s[i] < s[i - 1]):
            found.append([0.0, i, 0.0, i, True])
    out, taken = [], []
    for less, i, wide, ref, edge in sorted(found):
        why = [name for name, bad in (("edge_minimum", edge), ("low_prominence", -less < prominence), ("narrow_minimum", wide < width), ("too_close_to_stronger_minimum", any(abs(i - j) < max(1, math.ceil(separation / step)) for j in taken))) if bad]
        taken += [] if why else [i]
        out.append((i, s[i], -less, wide, ref, ";".join(why)))
    return sorted(out)


def test_candidates(spark):
    random.seed(3)
    rows, want = [], []
    for branch in range(60):
        n = random.choice([2, 3, 4, 7, 13, 25])
        values = [random.choice([random.random(), random.choice([0.2, 0.5])]) for _ in range(n)] if branch % 5 else [0.5, 0.5, 0.2, 0.2, 0.2, 0.2, 0.5, 0.6, 0.1, 0.6, 0.6, 0.0][:n]
        n = len(values)
        gaps = {random.randrange(n) for _ in range(branch % 3)}
        rows += [(branch, 7, 10.0 * i, v if i not in gaps or i % 2 else None, v - 0.1, v + 0.1, i not in gaps or i % 2 == 0) for i, v in enumerate(values)]
        run = []
        for i in range(n + 1):
            if i < n and i not in gaps:
                run.append(i)
                continue
            if len(run) >= 3:
                for k, s, rise, wide, ref, why in plain_minima([values[j] for j in run], 10.0, 0.6, 0.08, 12.0, 25.0):
                    want.append((branch, 10.0 * run[k], round(s, 9), round(rise, 9), round(wide, 6), 10.0 * run[ref], values[run[k]] + 0.1 >= values[run[ref]] - 0.1, why == "", why))
            run = []
    got = B.barrier_candidates(spark.createDataFrame(rows, PROFILE), 10.0, 0.6, 0.08, 12.0, 25.0)
    got = [(r.branch, r.offset, round(r.smoothed, 9), round(r.prominence, 9), round(r.width_km, 6), r.reference_offset, r.ci_overlaps_reference, r.accepted, r.reasons) for r in got.collect()]
    assert sorted(got) == sorted(want) and len({r[-1] for r in got}) > 6


def test_cheapest_assignment():
    rng = np.random.default_rng(1)
    for _ in range(300):
        cost = rng.random((rng.integers(0, 6), rng.integers(1, 6))) * rng.choice([1, 100])
        cost[rng.random(cost.shape) < rng.choice([0, 0.3, 0.8])] = np.inf
        got = B.cheapest(cost)
        best = (0, 0.0)
        tall = cost if cost.shape[0] <= cost.shape[1] else cost.T
        for cols in itertools.permutations(range(tall.shape[1]), tall.shape[0]):
            picked = [tall[r, c] for r, c in enumerate(cols) if np.isfinite(tall[r, c])]
            best = min(best, (-len(picked), sum(picked)))
        assert len(got) == -best[0] and sum(cost[p] for p in got) == pytest.approx(best[1])
        assert len({r for r, _ in got}) == len({c for _, c in got}) == len(got)


def plain_tracks(rows, offset, gap, missing, band):
    """Tracks of one branch after another, trying all assignments; rows: (branch, section, offset, lon, lat, value)."""
    out = []
    for branch in sorted({r[0] for r in rows}):
        tracks = []
        mine = sorted((r for r in rows if r[0] == branch), key=lambda r: (r[1], r[2]))
        for section in sorted({r[1] for r in mine}):
            here = [r for r in mine if r[1] == section]
            ends = [t for t in tracks if section - t[-1][1] <= missing + 1]
            cost = {}
            for i, t in enumerate(ends):
                for j, b in enumerate(here):
                    a = t[-1]
                    km = float(inverse(a[3], a[4], b[3], b[4])[0])
                    if abs(a[2] - b[2]) <= offset and km <= gap and (abs(a[2]) <= band or abs(b[2]) <= band or np.sign(a[2]) == np.sign(b[2])):
                        cost[i, j] = abs(a[2] - b[2]) / offset + km / gap + abs(a[5] - b[5])
            best, chosen = (0, 0.0), []
            slots = [*range(len(here)), *[None] * len(ends)]
            for pick in set(itertools.permutations(slots, len(ends))):
                pairs = [(i, j) for i, j in enumerate(pick) if j is not None]
                if all(p in cost for p in pairs) and (-len(pairs), sum(cost[p] for p in pairs)) < best:
                    best, chosen = (-len(pairs), sum(cost[p] for p in pairs)), pairs
            for i, j in chosen:
                ends[i].append(here[j])
            tracks += [[b] for j, b in enumerate(here) if j not in {j for _, j in chosen}]
        out += [tuple(sorted((r[1], r[2]) for r in t)) + (branch,) for t in tracks]
    return sorted(out, key=str)


def grouped(got):
    found = {}
    for r in got:
        found.setdefault((r.branch, r.stretch, r.track), []).append((r.sequence, r.offset))
    return sorted((tuple(sorted(v)) + (k[0],) for k, v in found.items()), key=str)


def test_tracks(spark):
    random.seed(8)
    rows = []
    for branch in range(12):
        for section in range(25):
            if random.random() < 0.3 or branch == 0 and 8 < section < 14:
                continue
            rows += [(branch, section, random.choice([-1, 1]) * random.uniform(0, 300), section * 0.5 + random.random() / 5, random.random(), random.random()) for _ in range(random.randint(1, 3))]
    df = spark.createDataFrame(rows, "branch int, sequence int, offset double, lon double, lat double, p_cross double")
    options = (180.0, 160.0, 1, 40.0)
    got = B.link_tracks(df, *options).collect()
    assert len(got) == len(rows) and grouped(got) == plain_tracks(rows, *options)
    assert len({r.stretch for r in got if r.branch == 0}) > 1

    geometry = B.track_geometry(B.link_tracks(df, *options))
    summary = {(r.branch, r.stretch, r.track): r for r in B.track_summary(geometry).collect()}
    by_track = {}
    for r in sorted(geometry.collect(), key=lambda r: r.sequence):
        by_track.setdefault((r.branch, r.stretch, r.track), []).append(r)
    for key, points in by_track.items():
        steps = [(b.sequence - a.sequence, float(inverse(a.lon, a.lat, b.lon, b.lat)[0])) for a, b in itertools.pairwise(points)]
        length = sum(km for k, km in steps if k == 1)
        s = summary[key]
        assert [p.place for p in points] == list(range(len(points))) and points[-1].part == sum(k > 1 for k, _ in steps) == s.gaps
        assert s.length_km == pytest.approx(length) and s.gap_km == pytest.approx(sum(km for k, km in steps if k > 1)) and points[-1].along_km == pytest.approx(length)
        assert s.coverage == len(points) / (points[-1].sequence - points[0].sequence + 1) and s.median == pytest.approx(np.median([p.p_cross for p in points]))


def test_tracks_of_the_given_events(spark):
    minima = crossings.barrier_minima(track_table(spark, "/root/testdata/sf0.01"))
    rows = [(r.branch, r.sequence, r.offset, r.lon, r.lat, r.p_cross) for r in minima.collect()]
    got = catalog.QUERIES["barrier_tracks"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 20 and grouped(got) == plain_tracks(rows, *crossings.LINKS.values())


def test_no_minima(spark):
    df = spark.createDataFrame([], "branch int, sequence int, offset double, lon double, lat double, p_cross double")
    assert B.track_summary(B.track_geometry(B.link_tracks(df, 1.0, 1.0))).count() == 0
    assert B.barrier_candidates(spark.createDataFrame([(1, 1, 0.0, 0.5, 0.4, 0.6, True)] * 2 + [(1, 1, 5.0, None, None, None, True)], PROFILE), 1.0).where(F.lit(True)).count() == 0

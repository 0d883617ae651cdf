"""Coupled tracks in blocks give the rows of brute force, and move tracks instead of pairs."""

import math
import random
from datetime import datetime, timedelta

import pytest

from trackmill.functions.geo import RADIUS
from trackmill.operators import coupling as K
from trackmill.operators import spatial as G

T0 = datetime(2024, 1, 1)
SCHEMA = "trajectory string, time timestamp_ntz, lon double, lat double, z double"


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(min(1.0, h)))


def walks(rng, n=60, long=25):
    """Tracks over the antimeridian, at a pole and elsewhere, with gaps, a time twice, missing positions and depths."""
    rows = []
    for k in range(n):
        x, y = rng.choice([(180.0, 0.0), (30.0, 87.5), (20.0, -40.0)])
        x, y = x + rng.uniform(-4, 4), y + rng.uniform(-2, 2)
        for d in range(rng.randrange(8), long):
            x, y = x + rng.uniform(-1, 1), max(-89.9, min(89.9, y + rng.uniform(-1, 1)))
            if rng.random() < 0.9:
                rows.append((f"t{k}", T0 + timedelta(hours=12 * d), (x + 180) % 360 - 180, y if rng.random() < 0.95 else None, rng.choice([None, rng.uniform(0, 9)])))
                if rng.random() < 0.03:
                    rows.append((*rows[-1][:2], (x + 181) % 360 - 180, y, 1.0))
    return [*rows, ("nan", T0, float("nan"), 1.0, 2.0), (None, T0, 20.0, -40.0, 2.0), ("t0", None, 20.0, -40.0, 2.0)]


def brute(rows, reach, days, held=None):
    at = {}
    for k, t, x, y, z in rows:
        if None not in (k, t, x, y):
            at.setdefault(k, []).append((t, x, y, z))
    out = []
    for a in at:
        for b in at:
            both = [(p, q) for p in at[a] for q in at[b] if p[0] == q[0]] if a < b else []
            near = [(round(d, 6), p[0], d) for p, q in both for d in [km(p[1:3], q[1:3])] if d <= reach and (held is None or held(p, q))]
            if near:
                start, tail = min(near)[1], [(p, q) for p, q in both if p[0] >= min(near)[1]]
                if len(tail) >= 2 and max(p[0] for p, _ in tail) - min(p[0] for p, _ in tail) >= timedelta(days=days):
                    out += [(a, b, p[0], start, round(min(near, key=lambda x: x[2])[2], 6), p[1], q[1], p[2], q[2], len(tail), round((p[3] + q[3]) / 2 if None not in (p[3], q[3]) else p[3] if p[3] is not None else q[3] if q[3] is not None else -1, 6)) for p, q in tail]
    return sorted(out)


def rows_of(df):
    return sorted((r["id1"], r["id2"], r["time"], r["start"], round(r["closest_km"], 6), r["lon1"], r["lon2"], r["lat1"], r["lat2"], r["rows"], round(-1 if r["z"] is None else r["z"], 6)) for r in df.collect())


@pytest.mark.parametrize("points, pairs, many", [(1 << 17, 1 << 22, 1 << 17), (150, 40, 30)])
def test_blocks_give_the_rows_of_brute_force(spark, monkeypatch, points, pairs, many):
    for name, value in (("POINTS", points), ("PAIRS", pairs), ("ROWS", many), ("STRIP", 3 if many == 30 else 128)):
        monkeypatch.setattr(K, name, value)
    rows = walks(random.Random(8))
    found = G.couple_trajectories(spark.createDataFrame(rows, SCHEMA), 150.0, 2.0)
    want = brute(rows, 150.0, 2.0)
    assert rows_of(found) == want and len(want) > 500
    assert all(abs(r["km"] - km((r["lon1"], r["lat1"]), (r["lon2"], r["lat2"]))) < 1e-6 for r in found.collect())


def test_first_of_the_regions_that_hold_a_centre_has_to_have_a_label(spark, monkeypatch):
    monkeypatch.setattr(K, "POINTS", 150)
    rows = [r for r in walks(random.Random(9)) if r[3] is not None and r[3] < -20]
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    regions = G.regions_from_rings(spark, [("a", 1, 1, ring(15, -45, 25, -35)), (None, 2, 2, ring(18, -45, 20, -35)), ("c", 3, 3, [(19.5, -42), (20.5, -42), (20, -38)])])

    def held(p, q):
        x, y = (p[1] + q[1]) / 2, (p[2] + q[2]) / 2
        within = ["c"] if -42 <= y <= -38 and 19.5 + (y + 42) / 8 <= x <= 20.5 - (y + 42) / 8 else []
        return bool(within) or (not (18 <= x <= 20 and -45 <= y <= -35) and 15 <= x <= 25 and -45 <= y <= -35)

    want = brute(rows, 150.0, 2.0, held)
    assert rows_of(G.couple_trajectories(spark.createDataFrame(rows, SCHEMA), 150.0, 2.0, regions)) == want != brute(rows, 150.0, 2.0)


def test_pairs_are_never_moved(spark):
    """Pairs at one time, and every later row of a pair three times, used to be shuffled."""
    rows = [(f"{k}", T0 + timedelta(hours=12 * d), 20.0 + 0.001 * k, 1.0, None) for k in range(60) for d in range(5)]
    out = G.couple_trajectories(spark.createDataFrame(rows, SCHEMA), 300.0, 1.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.split("\n")[0] and out.count() == 60 * 59 // 2 * 5

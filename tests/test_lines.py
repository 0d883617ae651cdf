"""Lines against a plain version in numpy, over made-up lines and those of the given events."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmill.functions.geodesic import direct, inverse
from trackmill.operators import lines as L
from trackmill.plans import catalog, crossings  # noqa: F401  crossings registers its queries
from trackmill.plans.tracks import tracks


def plain(lon, lat, values, spacing, size, degree):
    """One line: places of (s, lon, lat, value), then smoothed frame."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    dense, raw = [(0.0, lon[0], lat[0])], [0.0]
    for a, b, c, d in zip(lon[:-1], lat[:-1], lon[1:], lat[1:], strict=True):
        km, az, _ = (float(x) for x in inverse(a, b, c, d))
        raw.append(raw[-1] + km)
        if km == 0:
            continue
        steps = max(1, math.ceil(km / max(spacing / 2, 1.0)))
        for k in range(1, steps + 1):
            x, y = direct(a, b, az, km * k / steps)
            x = dense[-1][1] + (float(x) - dense[-1][1] + 180) % 360 - 180
            dense.append((raw[-2] + km * k / steps, x, float(y)))
    s = np.array([p[0] for p in dense])
    total = s[-1]
    goals = [m * spacing for m in range(int(total / spacing) + 2) if m * spacing < total - 1e-8] + [total]
    out_lon, out_lat = np.interp(goals, s, [p[1] for p in dense]), np.interp(goals, s, [p[2] for p in dense])
    value = np.interp(goals, raw, values)
    p, q = np.radians(out_lat), np.radians(out_lon)
    c = np.array([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)]).mean(1)
    lon0, lat0 = np.degrees(np.arctan2(c[1], c[0])), np.degrees(np.arctan2(c[2], np.hypot(c[0], c[1])))
    km, az, _ = inverse(np.full(len(goals), lon0), np.full(len(goals), lat0), out_lon, out_lat)
    az = np.radians(np.nan_to_num(az))
    x, y = km * np.sin(az), km * np.cos(az)
    sx, sy = x.copy(), y.copy()
    n, half = len(goals), size // 2
    if n >= size:
        for i in range(1, n - 1):
            b = min(max(i - half, 0), n - size)
            t = np.arange(size) - (i - b)
            sx[i], sy[i] = np.polyfit(t, x[b : b + size], degree)[-1], np.polyfit(t, y[b : b + size], degree)[-1]
    if n > 1:
        dx, dy = np.gradient(sx, goals), np.gradient(sy, goals)
        long = np.maximum(np.hypot(dx, dy), 1e-12)
        tx, ty = dx / long, dy / long
        bend = np.hypot(np.gradient(tx, goals), np.gradient(ty, goals))
    else:
        tx, ty, bend = np.ones(1), np.zeros(1), np.zeros(1)
    back = direct(np.full(n, lon0), np.full(n, lat0), np.degrees(np.arctan2(sx, sy)), np.hypot(sx, sy))
    return np.array([goals, (out_lon + 180) % 360 - 180, out_lat, value, sx, sy, tx, ty, np.degrees(np.arctan2(tx, ty)) % 360, bend, back[0], back[1]]).T


COLUMNS = ["s_km", "raw_lon", "raw_lat", "v", "x_km", "y_km", "tangent_x", "tangent_y", "bearing", "curvature", "lon", "lat"]


def compare(rows, want):
    got = np.array([[r[c] for c in COLUMNS] for r in sorted(rows, key=lambda r: r["place"])])
    assert [r["place"] for r in sorted(rows, key=lambda r: r["place"])] == list(range(len(want)))
    turned = got - want
    for k in (1, 8, 10):
        turned[:, k] = (turned[:, k] + 180) % 360 - 180
    assert np.abs(turned[:, :6]).max() < 1e-4 and np.abs(turned[:, 6:8]).max() < 1e-6 and np.abs(turned[:, [8, 10, 11]]).max() < 1e-4 and np.abs(turned[:, 9]).max() < 1e-7


def test_made_up_lines(spark):
    random.seed(2)
    lines = {0: [(170.0, 10.0, 1.0), (178.0, 12.0, 2.0), (-175.0, 11.0, 5.0), (-174.0, 20.0, 0.0)], 1: [(5.0, -60.0, 3.0)], 2: [(0.0, 0.0, 1.0), (0.0, 0.0, 4.0), (0.5, 0.2, 2.0), (0.5, 0.2, 2.0)], 3: [(3.0, 3.0, 1.0), (3.0, 3.0, 1.0)], 4: [(10.0 + i * 0.9, 50 + math.sin(i) * 2, float(i)) for i in range(40)]}
    for b in range(5, 20):
        x, y = random.uniform(-180, 180), random.uniform(-60, 60)
        lines[b] = [((x := x + random.uniform(-3, 3)), (y := max(-80, min(80, y + random.uniform(-3, 3)))), random.random()) for _ in range(random.randint(2, 12))]
    df = spark.createDataFrame([(b, i, *p) for b, line in lines.items() for i, p in enumerate(line)], "branch int, point int, lon double, lat double, v double")
    got = L.line_geometry(L.resample_polyline(df, 75.0, ["v"]), 5, 2).collect()
    for b, line in lines.items():
        lon = np.degrees(np.unwrap(np.radians([p[0] for p in line])))
        want = plain(lon, [p[1] for p in line], [p[2] for p in line], 75.0, 5, 2)
        compare([r for r in got if r["branch"] == b], want)


def test_lines_of_the_given_events(spark):
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES["line_geometry"](spark, sf).collect()
    points = tracks(spark, sf).select("trajectory", "obs", "lon", "lat", F.col("z").alias("v")).collect()
    by_track = {}
    for p in sorted(points, key=lambda p: p["obs"]):
        by_track.setdefault(p["trajectory"], []).append(p)
    mine = {}
    for r in got:
        mine.setdefault(r["trajectory"], []).append(r)
    assert set(mine) == set(by_track) and len(by_track) > 5
    for k, line in by_track.items():
        lon = np.degrees(np.unwrap(np.radians([p["lon"] for p in line])))
        want = plain(lon, [p["lat"] for p in line], [p["v"] for p in line], 200.0, 5, 2)
        rows = [dict(r.asDict(), v=r["z"]) for r in mine[k]]
        assert len(rows) == len(want)
        assert max(abs(a["s_km"] - b[0]) for a, b in zip(sorted(rows, key=lambda r: r["place"]), want, strict=True)) < 1e-4
        assert max(abs(a["x_km"] - b[4]) + abs(a["y_km"] - b[5]) for a, b in zip(sorted(rows, key=lambda r: r["place"]), want, strict=True)) < 0.05


def test_weights():
    assert L.polynomial_weights(5, 2)[2] == pytest.approx(np.array([-3, 12, 17, 12, -3]) / 35)

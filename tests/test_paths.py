"""Paths of graphs against a walk from node to node; nearest places on lines; the ellipsoid against its own inverse."""

import math
import random
from collections import defaultdict

from trackmill.functions.geodesic import inverse, zone_area
from trackmill.functions.grid import RegularGrid
from trackmill.operators import spatial as G
from trackmill.operators import transport as R
from trackmill.operators.graph import directed_paths, ordered_segments


def walk(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    ends = {n for n in near if len(near[n]) != 2}
    out, used = set(), set()
    for start in sorted(ends):
        for second in sorted(near[start]):
            path = [start, second]
            while path[-1] not in ends:
                path.append((near[path[-1]] - {path[-2]}).pop())
            used |= {frozenset(p) for p in zip(path, path[1:])}
            if tuple(path[:2]) <= (path[-1], path[-2]):
                out.add((tuple(path), False))
    for n in sorted(near):
        if n not in ends and frozenset((n, min(near[n]))) not in used:
            path = [n, min(near[n])]
            while path[-1] != n:
                path.append((near[path[-1]] - {path[-2]}).pop())
            used |= {frozenset(p) for p in zip(path, path[1:])}
            out.add((tuple(path), True))
    return out


def test_ordered_segments(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(20, 60), (60, 61), (61, 62), (62, 20)] + [(200, 201), (201, 200), (5, 5)]
    edges += [(300 + rng.randrange(25), 300 + rng.randrange(25)) for _ in range(30)]
    rows = ordered_segments(spark.createDataFrame(edges, "src long, dst long")).collect()
    paths = defaultdict(dict)
    for r in rows:
        paths[r["first"], r["second"], r["closed"]][r["place"]] = r["node"]
    got = {(tuple(nodes[i] for i in range(len(nodes))), closed) for (_, _, closed), nodes in paths.items()}
    assert got == walk(edges)


def test_directed_paths(spark):
    edges = [(1, 2), (2, 3), (3, 4), (3, 5), (5, 6), (6, 7), (10, 11), (11, 12), (12, 10), (20, 21), (21, 20), (7, 30), (8, 7)]
    paths = defaultdict(dict)
    for r in directed_paths(spark.createDataFrame(edges, "src long, dst long")).collect():
        paths[r["first"], r["second"]][r["place"]] = r["node"]
    got = {tuple(n[i] for i in range(len(n))) for n in paths.values()}
    assert got == {(1, 2, 3), (3, 4), (3, 5, 6, 7), (7, 30), (8, 7), (10, 11, 12, 10), (20, 21, 20)}


def test_nearest_on_lines(spark):
    lines = [("a", 0, 175.0, 10.0), ("a", 1, -175.0, 10.0), ("b", 0, 0.0, 0.0), ("b", 1, 10.0, 0.0), ("b", 2, 10.0, 10.0)]
    points = [(1, 179.0, 11.0), (2, -179.0, 9.0), (3, 5.0, 2.0), (4, 12.0, 12.0), (5, 90.0, 60.0)]
    got = {r["id"]: r for r in G.nearest_on_lines(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(lines, "line string, place long, lon double, lat double"), 500.0, ["id"]).collect()}
    assert (got[1]["line"], round(got[1]["line_lat"], 6)) == ("a", 10.0) and (got[2]["line"], round(got[2]["line_lat"], 6)) == ("a", 10.0)
    assert (got[3]["line"], round(got[3]["line_lon"], 6), round(got[3]["line_lat"], 6)) == ("b", 5.0, 0.0)
    assert (got[4]["line_lon"], got[4]["line_lat"]) == (10.0, 10.0) and got[5]["line"] is None
    assert abs(got[3]["km"] - inverse(5.0, 2.0, 5.0, 0.0)[0]) < 1e-6


def test_smoothing_and_gradients_on_the_ellipsoid(spark):
    grid = RegularGrid(0.0, 60.0, -60.0, 60.0, 10.0, 10.0)
    rng = random.Random(2)
    cells = {(x, y): rng.random() for x in range(6) for y in range(12) if rng.random() < 0.8}
    df = spark.createDataFrame([(x, y, v) for (x, y), v in cells.items()], "lon_bin long, lat_bin long, value double")
    at = lambda c: (5.0 + 10 * c[0], -55.0 + 10 * c[1])
    smooth = {(r["lon_bin"], r["lat_bin"]): r["value_smooth"] for r in G.smooth_cells(df, grid, "value", 700.0, ellipsoid=True).collect()}
    slopes = {(r["lon_bin"], r["lat_bin"]): r for r in R.sphere_gradients(df, grid, "value", ellipsoid=True).collect()}
    for c in cells:
        total = weight = 0.0
        for d, v in cells.items():
            km = float(inverse(*at(c), *at(d))[0])
            if km <= 2100.0:
                w = math.exp(-0.5 * (km / 700.0) ** 2) * zone_area(at(d)[1] - 5, at(d)[1] + 5, 10.0)
                total, weight = total + w * v, weight + w
        assert abs(smooth[c] - total / weight) < 1e-9
        n, s = (cells.get((c[0], c[1] + k)) for k in (1, -1))
        lat = at(c)[1]
        apart = sum(float(inverse(0.0, lat, 0.0, lat + k)[0]) for k, x in ((10.0, n), (-10.0, s)) if x is not None)
        want = None if not apart else ((n if n is not None else cells[c]) - (s if s is not None else cells[c])) / apart
        assert (slopes[c]["gy"] is None) == (want is None) and (want is None or abs(slopes[c]["gy"] - want) < 1e-12)

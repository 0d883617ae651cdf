"""Nearest places on lines come from sorted streams; no table that grows is broadcast."""

import math
import random

from trackmill.functions.geo import RADIUS
from trackmill.operators import spatial as G

LINES, POINTS = "line string, place long, lon double, lat double", "id long, lon double, lat double"


def made(rng):
    """Lines and points on a lattice, so that many segments are equally near, some over the antimeridian."""
    lines = [(f"l{i}", k, (x + 0.5 * rng.randrange(6) * k + 180) % 360 - 180, y + 0.5 * rng.randrange(3) * k) for i in range(40) for x, y in [(rng.choice([178.0, 10.0, 11.0]), rng.choice([0.0, 1.0, 60.0]))] for k in range(5)]
    return lines, [(i, (rng.choice([179.0, 181.0, 12.0]) + 0.25 * rng.randrange(12) + 180) % 360 - 180, rng.choice([0.0, 2.0, 61.0, -8.0]) + 0.25 * rng.randrange(8)) for i in range(120)]


def test_equally_near_segments_and_batches(spark, monkeypatch):
    lines, points = made(random.Random(3))
    run = lambda: {r["id"]: r for r in G.nearest_on_lines(spark.createDataFrame(points, POINTS), spark.createDataFrame(lines, LINES), 200.0, ["id"]).collect()}
    got = run()
    turn = lambda d: (d + 180) % 360 - 180
    high, tied = math.degrees(200.0 / RADIUS), 0
    for i, x, y in points:
        near = []
        for a, b in zip(lines, lines[1:], strict=False):
            if a[0] == b[0]:
                c = math.cos(math.radians(y))
                ax, ay, dx, dy = turn(a[2] - x) * c, a[3] - y, turn(b[2] - a[2]) * c, b[3] - a[3]
                way = dx * dx + dy * dy
                s = min(1.0, max(0.0, -(ax * dx + ay * dy) / way)) if way else 0.0
                near.append((math.hypot(ax + s * dx, ay + s * dy), a[0], a[2], a[3], turn(a[2] + s * turn(b[2] - a[2])), a[3] + s * dy))
        least = min(near)[0]
        ties = sorted((n[1:] for n in near if n[0] <= least + 1e-9), key=lambda n: n[:3])
        tied += least <= high and len({n[0] for n in ties}) > 1
        assert (got[i]["line"] is None) == (least > high)
        if least <= high:
            assert got[i]["line"] == ties[0][0] and abs(turn(got[i]["line_lon"] - ties[0][3])) < 1e-9 and abs(got[i]["line_lat"] - ties[0][4]) < 1e-9
    assert tied >= 5 and any(r["line"] is None for r in got.values())
    monkeypatch.setattr(G, "MATRIX", 50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run() == got
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_only_tiles_are_broadcast(spark, monkeypatch):
    """Segments in their tiles used to be broadcast where the file of the segments was small."""
    plans, was = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label: plans.append(df) or was(df, label))
    lines, points = made(random.Random(4))
    out = G.nearest_on_lines(spark.createDataFrame(points, POINTS), spark.createDataFrame(lines, LINES), 200.0, ["id"])
    text = [line for df in [*plans, out] for line in df._jdf.queryExecution().executedPlan().toString().split("\n")]
    joins = [line for line in text if "HashJoin" in line or "NestedLoop" in line]
    assert joins and all("[tile_y" in line and "LeftSemi" in line for line in joins)

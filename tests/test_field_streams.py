"""The nearest row of a field comes from a sorted stream of each tile; pairs within the radius are neither sorted nor moved."""

import math
import random
from datetime import datetime, timedelta

from trackmill.functions.geo import RADIUS
from trackmill.operators import spatial as G

T0 = datetime(2024, 1, 1)
FIELD, POINTS = "time timestamp_ntz, lon double, lat double, z double, w string", "id long, time timestamp_ntz, lon double, lat double"


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(min(1.0, h)))


def made(rng):
    """A lattice over the antimeridian and at a pole: places twice, equal distances, missing values and positions."""
    spot = lambda: rng.choice([(rng.choice([-179.0, 179.0, 180.0, -180.0]), float(rng.randrange(-2, 3))), (float(rng.randrange(-180, 180, 30)), float(rng.randrange(84, 91)))])
    field = [(T0 + timedelta(hours=rng.randrange(3)), *spot(), rng.choice([None, 1.0, 2.0]), rng.choice([None, "a", "b"])) for _ in range(90)]
    points = [(i, T0 + timedelta(hours=rng.randrange(4)), *spot()) for i in range(150)]
    return [*field, (T0, float("nan"), 1.0, 5.0, "n"), (T0, None, 1.0, 5.0, "n"), (None, 179.0, 1.0, 5.0, "n")], [*points, (900, T0, None, 1.0), (901, None, 179.0, 1.0), (902, T0, float("nan"), 1.0), (903, T0, 40.0, 40.0), points[0]]


def test_nearest_field_is_that_of_brute_force(spark, monkeypatch):
    field, points = made(random.Random(6))
    run = lambda: sorted(((r["id"], r["z"], r["w"], r["km"]) for r in G.nearest_field(spark.createDataFrame(points, POINTS), spark.createDataFrame(field, FIELD), ["z", "w"], 150.0, ["id"]).collect()), key=repr)
    order = lambda v: (v is not None, v)
    got, want, tied = run(), [], 0
    for i, t, x, y in points:
        near = [(round(d, 6), a, b, order(z), order(w), d, z, w) for u, a, b, z, w in field if None not in (t, x, y, u, a, b) and u == t and not math.isnan(x + a) for d in [km((x, y), (a, b))] if d <= 150.0]
        best = min(near, default=None, key=lambda n: n[:5])
        tied += best is not None and sum(n[0] == best[0] for n in near) > 1
        want.append((i, *((best[6], best[7], min(n[5] for n in near)) if best else (None, None, None))))
    want.sort(key=repr)
    assert tied > 20 and [g[:3] for g in got] == [w[:3] for w in want]
    assert all((g[3] is None) == (w[3] is None) and (w[3] is None or abs(g[3] - w[3]) < 1e-6) for g, w in zip(got, want, strict=True))
    monkeypatch.setattr(G, "MATRIX", 20)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert run() == got
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_pairs_within_the_radius_are_no_rows(spark, monkeypatch):
    """Every pair within the radius used to be sorted by point before the nearest was taken."""
    monkeypatch.setattr(G, "radius_join", lambda *a: 1 / 0)
    field = [(T0, 20.0 + 0.001 * i, 1.0, float(i), "a") for i in range(300)]
    points = [(i, T0, 20.0 + 0.001 * i, 1.0) for i in range(300)]
    out = G.nearest_field(spark.createDataFrame(points, POINTS), spark.createDataFrame(field, FIELD), ["z"], 800.0, ["id"])
    assert all(r["z"] == r["id"] and r["km"] == 0 for r in out.collect())

"""What surrounds fronts and one row for each of them, over the given events, against plain loops."""

import math
from statistics import median

import pytest

from trackmill.operators import fronts as T
from trackmill.operators.sections import destination
from trackmill.plans import catalog, crossings
from trackmill.plans.tracks import tracks

SF = "/root/testdata/sf0.01"


def km(a, b, c, d):
    p, q = math.radians(b), math.radians(d)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.fixture(scope="module")
def tables(spark):
    g, found = crossings.front_records(tracks(spark, SF))
    return [r.asDict() for r in g.collect()], [r.asDict() for r in found.collect()]


def test_gradients_at_fronts(tables):
    cells, found = tables
    by = {(c["lon_bin"], c["lat_bin"]): c for c in cells}
    kinds = set()
    for r in found:
        x, y = (r["lon"] + 180) / 10 - 0.5, (r["lat"] + 90) / 5 - 0.5
        i, j = math.floor(x), math.floor(y)
        corners = [(by.get(((i + a) % 36, j + b), {}).get("abs_g_perp"), (x - i if a else 1 - x + i) * (y - j if b else 1 - y + j)) for a in (0, 1) for b in (0, 1)]
        corners = [(v, w) for v, w in corners if w > 1e-9]
        kinds.add(r["sample_class"])
        if any(v is None for v, _ in corners):
            assert r["abs_g_perp"] is None and r["sample_class"] == "gradient_sample_unavailable"
        else:
            assert r["abs_g_perp"] == pytest.approx(sum(v * w for v, w in corners) / sum(w for _, w in corners), rel=1e-6, abs=1e-12)
            assert (r["sample_class"] == "gradient_sample_direct") == (len(corners) == 1)
    assert len(kinds) > 1


def test_context(tables):
    cells, found = tables
    steep = [(-175 + 10 * c["lon_bin"], -87.5 + 5 * c["lat_bin"], round(c["abs_g_perp"], 12)) for c in cells if c["abs_g_perp"] is not None]
    for r in found:
        near = [(v, km(r["lon"], r["lat"], x, y)) for x, y, v in steep]
        near = [(v, d) for v, d in near if d <= 1.5 * r["scale_km"]]
        top = max((v for v, _ in near), default=None)
        assert r["local_max"] == pytest.approx(top) if near else r["local_max"] is None
        if near:
            assert r["local_max_km"] == pytest.approx(min(d for v, d in near if v == top))
        around = [v for x, y, v in steep if km(r["core_lon"], r["core_lat"], x, y) <= 3 * r["scale_km"]]
        assert r["n_background"] == len(around)
        if around and r["abs_g_perp"] is not None:
            assert r["percentile"] == pytest.approx(sum(v <= round(r["abs_g_perp"], 12) for v in around) / len(around))
        else:
            assert r["percentile"] is None


def test_unique(spark, tables):
    groups = {}
    for r in tables[1]:
        groups.setdefault((r["branch"], r["point"], r["side"]), []).append(r)
    got = {(r["branch"], r["point"], r["side"]): r for r in catalog.QUERIES["unique_fronts"](spark, SF).collect()}
    assert set(got) == set(groups)
    for k, rows in groups.items():
        g, far = got[k], [r["distance_km"] for r in rows]
        assert g["records"] == len(rows) and g["segments"] == ";".join(sorted(str(r["segment"]) for r in rows)) and g["spread_km"] == pytest.approx(max(far) - min(far))
        assert g["disagreement"] == (len(rows) > 1 and max(far) - min(far) > 0.2 * rows[0]["scale_km"]) and g["persists"] == (sum(r["persists"] for r in rows) / len(rows) >= 0.5)
        assert g["contaminated"] == any(r["contaminated"] for r in rows)
        for c in crossings.MEDIANS:
            values = [r[c] for r in rows if r[c] is not None]
            assert g[c] == pytest.approx(median(values)) if values else g[c] is None
    assert len({g["disagreement"] for g in got.values()}) == 2


def test_missing_neighbours(spark):
    grid = crossings.GRID
    cells = [(0, 10, 1.0, 0.0), (1, 10, 2.0, 90.0), (35, 10, 4.0, None), (5, 5, 1.0, 0.0), (5, 6, 3.0, 0.0), (9, 9, None, 0.0)]
    got = {(r.lon_bin, r.lat_bin): r for r in T.rotated_gradients(spark.createDataFrame(cells, "lon_bin long, lat_bin long, v double, a double"), grid, "v", "a").collect()}
    wide, high = math.radians(10) * 6371 * math.cos(math.radians(-37.5)), math.radians(5) * 6371
    assert set(got) == {c[:2] for c in cells[:-1]}
    assert got[0, 10].gx == pytest.approx((2 - 4) / (2 * wide)) and got[0, 10].dx_method == "dx_centered" and got[0, 10].dy_method == "dy_undefined" and got[0, 10].g_perp is None
    assert got[1, 10].gx == pytest.approx((2 - 1) / wide) and got[1, 10].dx_method == "dx_one_sided"
    assert got[5, 5].gy == pytest.approx(2 / high) and got[5, 5].gx is None and got[5, 6].dy_method == "dy_one_sided"


def test_destinations_of_both_kinds(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10.0, 40.0, 30.0, 500.0), (179.0, -10.0, 90.0, 900.0)], "x double, y double, b double, d double")
    both = [df.select(*(c.alias(n) for c, n in zip(destination(F.col("x"), F.col("y"), F.col("b"), F.col("d"), kind), ("lon", "lat"), strict=True))).collect() for kind in (True, False)]
    for a, b in zip(*both, strict=True):
        assert a.lon != b.lon and km(a.lon, a.lat, b.lon, b.lat) < 5


def test_empty(spark):
    cores = spark.createDataFrame([], "branch long, point long, lon double, lat double, bearing double, scale_km double, missing_side string")
    found = spark.createDataFrame([], "branch long, point long, side string, lon double, lat double, distance_km double, drop double, relative_drop double")
    assert T.canonical_fronts(cores, found).count() == 0 and T.nearby_contamination(cores).count() == 0

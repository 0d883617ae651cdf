"""What operators read, copy and write for each row, and the same rows as brute force."""

import math
import random
from datetime import datetime, timedelta
from pathlib import Path

from trackmill.functions.geo import RADIUS
from trackmill.operators import float_qc as Q
from trackmill.operators import nearest as N
from trackmill.operators import spatial as G


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(min(1.0, h)))


def test_radius_join_copies_few_and_finds_all(spark):
    rng = random.Random(4)
    spots = [(i, rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(84, 90), rng.uniform(-3, 3)])) for i in range(400)] + [(900, 180.0, 0.0), (901, -180.0, 0.5), (902, 7.0, 90.0), (903, 0.0, -90.0)]
    p = spark.createDataFrame(spots, "id long, lon double, lat double")
    for reach in (400.0, 3000.0):
        got = {(r["id"], r["id_r"]) for r in G.radius_join(p, p, reach).select("id", "id_r").collect()}
        assert got == {(a[0], b[0]) for a in spots for b in spots if km(a[1:], b[1:]) <= reach}
    mild = p.where("abs(lat) < 60")
    assert G._tiles(mild, 400.0, True).count() < 6 * mild.count()


def test_nearest_on_lines_small_tiles(spark):
    rng = random.Random(9)
    lines = [(f"l{i}", k, x + 0.8 * k, y + rng.uniform(-1, 1)) for i in range(60) for x, y in [(rng.uniform(-180, 170), rng.uniform(-80, 80))] for k in range(5)]
    points = [(i, *(c + rng.uniform(-w, w) for c, w in zip(rng.choice(lines)[2:], (2.5, 2.5), strict=True))) for i in range(150)]
    points = [(i, (x + 180) % 360 - 180, max(-89.0, min(89.0, y))) for i, x, y in points]
    got = {r["id"]: r for r in G.nearest_on_lines(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(lines, "line string, place long, lon double, lat double"), 200.0, ["id"]).collect()}
    high, far = math.degrees(200.0 / RADIUS), 0
    turn = lambda d: (d + 180) % 360 - 180
    for i, x, y in points:
        best = (math.inf, None)
        for a, b in zip(lines, lines[1:], strict=False):
            if a[0] == b[0]:
                c = math.cos(math.radians(y))
                ax, ay, dx, dy = turn(a[2] - x) * c, a[3] - y, turn(b[2] - a[2]) * c, b[3] - a[3]
                s = min(1.0, max(0.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
                best = min(best, (math.hypot(ax + s * dx, ay + s * dy), a[0]))
        assert got[i]["line"] == (best[1] if best[0] <= high else None)
        far += high / 4 < best[0] <= high
    assert far > 10
    ends = spark.createDataFrame([("a", 0.0, 0.0, 8.0, 8.0)], "line string, x0 double, y0 double, x1 double, y1 double")
    assert G._segments_near(ends, 0.5, 0.5).count() < 150  # its box alone has over 300 tiles


def test_few_targets_are_looked_through_without_going_down(spark, monkeypatch):
    rng = random.Random(2)
    spot = lambda: (rng.uniform(-180, 180), rng.uniform(-90, 90))
    targets = [(g, i, *spot()) for g in range(30) for i in range(5)]
    points = [(i, rng.randrange(32), *spot()) for i in range(100)]
    t = spark.createDataFrame(targets, "g long, v long, lon double, lat double")
    p = spark.createDataFrame(points, "id long, g long, lon double, lat double")
    want = {i: min(((km((x, y), (a, b)), v) for h, v, a, b in targets if h == g), default=(None, None)) for i, g, x, y in points}

    def check(rows):
        for r in rows:
            d, v = want[r["id"]]
            assert r["v"] == v and (d is None or abs(r["km"] - d) < 1e-6)

    with monkeypatch.context() as m:
        m.setattr(N, "TOGETHER", 1)
        check(N.nearest_row(p, t, ["id"], ["v"], ("g",)).collect())
    monkeypatch.setattr(N, "_cell", lambda *a: 1 / 0)
    check(N.nearest_row(p, t, ["id"], ["v"], ("g",)).collect())


def test_other_lines_at_the_same_place(spark):
    rows = [(b, i, float((i * 7 + b * 3) % 11), float(i % 5)) for b in range(6) for i in range(12)]
    got = {(r["branch"], r["point"]): r for r in N.nearest_other_lines(spark.createDataFrame(rows, "branch long, point long, lon double, lat double")).collect()}
    for b, i, x, y in rows:
        others = min(km((x, y), (c, d)) for e, _, c, d in rows if e != b)
        own = min(km((x, y), (c, d)) for e, j, c, d in rows if e == b and abs(i - j) > 3)
        assert abs(got[b, i]["other_km"] - others) < 1e-6 and abs(got[b, i]["self_km"] - own) < 1e-6


def test_nearest_rows_of_boxes(spark, monkeypatch):
    monkeypatch.setattr(N, "TOGETHER", 4)
    monkeypatch.setattr(N, "SUPER", 3)
    monkeypatch.setattr(N, "ASKS", 7)
    rng = random.Random(6)
    crowd = [(rng.uniform(179.5, 180.5), rng.uniform(-1, 1)) for _ in range(150)]
    spots = [((x + 180) % 360 - 180, y) for x, y in crowd] + [(rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90)])) for _ in range(150)] + [(0.0, 90.0), (50.0, 90.0), (180.0, 0.0), (-180.0, 0.0)]
    targets = [(i % 3, i, rng.randrange(12), x, y) for i, (x, y) in enumerate(spots)]
    points = [(i, rng.randrange(4), rng.randrange(12), *((x, y) if rng.random() < 0.4 else (rng.uniform(-180, 180), rng.uniform(-90, 90)))) for i, (x, y) in enumerate(spots)]
    t = spark.createDataFrame(targets, "g long, v long, a int, lon double, lat double")
    p = spark.createDataFrame([*points, (900, 1, 1, None, 3.0), (901, None, 1, 2.0, 3.0)], "id long, g long, a int, lon double, lat double")
    for on, apart, columns in ((), None, ["v"]), (("g",), None, ["v"]), ((), 0, []), ((), 3, ["v"]), (("g",), 2, ["v"]):
        got = {r["id"]: r for r in N.nearest_row(p, t, ["id"], columns, on, ("a", apart) if apart is not None else None).collect()}
        assert len(got) == len(points) + 2 and got[900]["km"] is None and (got[901]["km"] is None) == bool(on)
        for i, g, a, x, y in points:
            able = [(km((x, y), (u, w)), v) for h, v, b, u, w in targets if (not on or h == g) and (apart is None or abs(a - b) > apart)]
            best = min(able, default=None)
            assert (got[i]["km"] is None) == (best is None)
            if best:
                assert abs(got[i]["km"] - best[0]) < 1e-4
                assert not columns or got[i]["v"] in {v for d, v in able if d < best[0] + 1e-4}


def test_nearest_rows_move_boxes_and_a_point_once(spark, monkeypatch):
    """A point used to go down from level to level with all cells near it, and every level was shuffled."""
    rng = random.Random(7)
    rows = [(i // 20, i % 20, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(6000)]
    kept = {}
    was = N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, label: kept.setdefault(label, was(df, label)))
    df = spark.createDataFrame(rows, "line long, place long, lon double, lat double")
    plan = N.nearest_row(df, df, ["line", "place"], [], apart=("line", 0))._jdf.queryExecution().toString()
    assert kept["nearest-pairs"].count() < 60 * kept["nearest-point-boxes"].count() < 60 * 200 and "Window" not in plan


def test_jump_qc_streams_segments_over_batches(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = [(k, 0, i, t0 + timedelta(hours=i), i * 0.01 + (5.0 if rng.random() < 0.1 else 0.0), 0.0) for k in range(20) for i in range(40)]
    df = spark.createDataFrame(rows, "trajectory long, segment long, obs long, time timestamp_ntz, lon double, lat double").repartition(7)
    whole = Q.jump_qc(df, 200.0)
    assert "FlatMapGroupsInPandas" not in whole._jdf.queryExecution().toString()
    want = sorted(map(tuple, whole.collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert sorted(map(tuple, Q.jump_qc(df, 200.0).collect())) == want and 600 < len(want) < 800
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_jump_qc_measures_few_links_one_by_one(spark, monkeypatch):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    rows = [(k, 0, i, t0 + timedelta(hours=i), i * 0.01 + (5.0 if i in (20, 50) else 0.0), rng.uniform(0, 0.01)) for k in range(10) for i in range(80)]
    df = spark.createDataFrame(rows, "trajectory long, segment long, obs long, time timestamp_ntz, lon double, lat double")
    want = sorted(map(tuple, Q.jump_qc(df, 200.0).collect()))
    held, calls, was = [], [], Q._too_fast
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: held.append((self, f)) or self)
    monkeypatch.setattr(Q, "_too_fast", lambda *a: calls.append(1) or was(*a))
    Q.jump_qc(df, 200.0)
    [(given, stream)] = held
    got = [tuple(r.values()) for batch in stream(iter(given.toArrow().to_batches())) for r in batch.to_pylist()]
    assert sorted(got) == want and len(want) == 780
    assert len(calls) < 200  # every link of a segment with a fast one used to be: over 1600


def test_text_fixes_take_a_file_for_many_tracks(spark, tmp_path, monkeypatch):
    from trackmill.plans import ingest
    from trackmill.plans.catalog import QUERIES

    monkeypatch.setattr(ingest, "new_path", lambda s, label: str(tmp_path / label))
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), i % 130, "view", 1.0, "{}") for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["read_text_fixes"](spark, str(tmp_path)).count() == 1000
    assert len([p for p in Path(tmp_path / "fixes").rglob("*.txt")]) == 3


def test_text_fixes_parse_a_line_once(spark, tmp_path):
    from trackmill.operators import cleaning as C
    from trackmill.sources import tables as T

    (tmp_path / "a.txt").write_text("x\n*END OF HEADER\n1 2024/01/01 00:00:00 2.5 3.5 1\n1 2024/01/01 06:00:00 2.5 bad 1\n short line\n")
    df = C.at_sea(T.read_text_fixes(spark, str(tmp_path)))
    assert [tuple(r) for r in df.collect()] == [("a", datetime(2024, 1, 1), 2.5, 3.5, 1)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(trim(line") == 1 and plan.count("yyyy/MM/dd") == 1

"""Rules by hand where a twin could share a mistake: crossings at a segment's start, merging, steps, shared grids, tiles."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trackmill.functions.grid import RegularGrid
from trackmill.operators import diagnostics as D
from trackmill.operators import segments as S
from trackmill.operators import spatial as G
from trackmill.operators import transitions as X

GRID = RegularGrid(0.0, 360.0, 0.0, 10.0, 10.0, 1.0)


def track(spark, lats, lon=5.0, hours=24, key=1):
    rows = [(key, i, datetime(2024, 1, 1 + i * hours // 24, i * hours % 24), lon, float(y), 10.0 * i) for i, y in enumerate(lats)]
    return spark.createDataFrame(rows, "trajectory long, obs long, time timestamp_ntz, lon double, lat double, z double")


def crossings(spark, lats, **how):
    t = track(spark, lats)
    return sorted((r["lat_bin"], r["sign"], r["crossings"], r["segments"], r["probability"]) for r in D.meridional_crossing(S.directional_segments(t, 0.1), t, GRID, **how).collect())


def test_a_line_at_a_segments_start_is_not_crossed(spark):
    assert crossings(spark, [2.5, 3.0, 3.4]) == []
    assert crossings(spark, [2.4, 3.0, 3.5]) == [(2, 1, 1, 1, 1.0), (3, 1, 1, 1, 1.0)]
    # Turning on a line: reached by the way north, the start of the way south.
    assert crossings(spark, [2.2, 3.5, 2.0]) == [(2, -1, 1, 1, 1.0), (2, 1, 1, 1, 1.0), (3, 1, 1, 1, 1.0)]


def test_short_segments_do_not_count_and_edges_belong_to_the_cell_entered(spark):
    assert crossings(spark, [2.4, 2.9, 2.6], min_days=2.0) == []
    assert crossings(spark, [2.4, 2.9, 2.6], min_days=1.0) == [(2, 1, 1, 1, 1.0)]
    assert crossings(spark, [2.4, 3.2], reference="edge", min_days=1.0) == [(3, 1, 1, 1, 1.0)]
    assert crossings(spark, [3.2, 2.4], reference="edge", min_days=1.0) == [(2, -1, 1, 1, 1.0)]
    with pytest.raises(ValueError):
        crossings(spark, [1, 2], reference="line")


def test_merging_bounds_the_points_between(spark):
    t = track(spark, [1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7]).where(~F.col("obs").isin(2, 5, 6)).withColumn("segment", F.when(F.col("obs") < 2, 0).when(F.col("obs") < 5, 1).otherwise(2).cast("long"))
    reasons = lambda **how: [r["reason"] for r in S.merge_boundaries(t, **how).orderBy("obs").collect()]
    assert reasons() == ["merged", "merged"]
    assert reasons(max_points=1) == ["merged", "gap_points_too_large"]
    assert reasons(max_days=1.5) == ["gap_duration_too_large"] * 2
    assert reasons(max_speed=1e-3) == ["bridge_speed_too_large"] * 2
    assert reasons(max_vertical_rate=5.0, z="z") == ["bridge_vertical_rate_too_large"] * 2
    assert [r["merged"] for r in S.merge_segments(t, max_points=1).orderBy("obs").collect()] == [0, 0, 0, 0, 1]
    # No time passes: that is no bound on days broken, but a speed that is not known is too large.
    still = t.withColumn("time", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    assert [r["reason"] for r in S.merge_boundaries(still, max_days=1.0).collect()] == ["merged"] * 2
    assert [r["reason"] for r in S.merge_boundaries(still, max_speed=1.0).collect()] == ["bridge_speed_too_large"] * 2


def test_steps_have_to_be_multiples(spark):
    t = track(spark, [1, 2, 3, 4], hours=6)
    X.check_timestep(t, 6 * 3600)
    X.check_timestep(t, 18 * 3600)
    X.check_timestep(t, 3600)
    with pytest.raises(ValueError):
        X.check_timestep(t, 15 * 3600)
    chain = X.regular_chain(t, 12 * 3600).where("lat1 is not null").collect()
    assert [(r["lat"], r["lat1"]) for r in chain] == [(1.0, 3.0)]


def test_shared_and_shifted_grids(spark):
    t = track(spark, [1, 2, 3], hours=10).withColumn("label", F.when(F.col("obs") == 1, "b"))
    origin = 1704067200 * 10**6 + 3 * 3600 * 10**6
    rows = S.resample(t, 6 * 3600, "reference", end_point=False, reference_us=origin, filled=("label",)).orderBy("obs").collect()
    assert [(r["time"].hour, round(r["lat"], 6), r["label"]) for r in rows] == [(3, 1.3, "b"), (9, 1.9, "b"), (15, 2.5, "b")]
    assert S.shift_to_start(t, origin).agg(F.min("time")).first()[0] == datetime(2024, 1, 1, 3)


def test_numbers_follow_the_order_of_keys(spark):
    df = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)] + [(5,)], "k long").repartition(16)
    got = {r["k"]: r["n"] for r in S.numbered(df, ["k"], "n").collect()}
    assert got == {k: k for k in range(1000)}


def test_regions_over_many_tiles(spark):
    regions = G.regions_from_rings(spark, [("wide", 1, 1, [(-170, -80), (170, -80), (170, 80), (-170, 80)]), ("small", 2, 5, [(9.5, 9.5), (10.5, 9.5), (10.5, 10.5), (9.5, 10.5)])])
    points = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 9.4, 10.0), (1, 2, 175.0, 0.0), (1, 3, None, 0.0), (1, 4, -170.0, -80.0)], "trajectory long, obs long, lon double, lat double")
    got = {r["obs"]: (r["label"], r["n_regions"]) for r in G.classify_points(points, regions).collect()}
    assert got == {0: ("small", 2), 1: ("wide", 1), 2: (None, 0), 3: (None, 0), 4: ("wide", 1)}


def test_exponents_use_the_distance_reached(spark):
    import math

    from trackmill.operators import pairs as P

    rows = [(1, m, o, datetime(2024, 1, 1 + o), float(x if m == 2 else 0), 0.0) for o, x in enumerate((1, 2, 4)) for m in (1, 2)]
    rows += [(2, m, o, datetime(2024, 1, 1 + o), float(1 if m == 2 else 0), 0.0) for o in range(3) for m in (1, 2)]
    pairs = P.centre_pairs(spark.createDataFrame(rows, "group_id long, group_member int, obs long, time timestamp_ntz, lon double, lat double"))
    get = lambda df, c: {(r["group_id"], r[c]): r for r in df.collect()}
    fsle = get(P.fsle_map(pairs, [200.0, 300.0]), "scale")
    assert math.isclose(fsle[1, 200.0]["fsle"], math.log(2) / 1) and math.isclose(fsle[1, 300.0]["fsle"], math.log(4) / 2)
    assert fsle[2, 200.0]["fsle"] == 0.0 and not fsle[2, 200.0]["is_valid"]
    assert get(P.fsle_map(pairs, [300.0], mask_zeros=True, backward=True), "scale")[2, 300.0]["fsle"] is None
    ftle = get(P.ftle_map(pairs, [1.5, 5.0]), "horizon")
    assert math.isclose(ftle[1, 1.5]["ftle"], math.log(2)) and ftle[2, 1.5]["ftle"] == 0.0 and ftle[1, 5.0]["ftle"] is None
    assert math.isclose(get(P.ftle_map(pairs, [5.0], "max", backward=True), "horizon")[1, 5.0]["ftle"], -math.log(4) / 2)

"""Ties of distances are settled by what is documented, not by rounding or by the order of rows."""

from datetime import datetime, timedelta

from trackmill.operators import spatial as G


def test_coupling_starts_at_the_first_of_equally_close_times(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(k, t0 + timedelta(days=d), x, 10.0) for d, gap in enumerate((2.0, 1.0, 1.0 - 1e-12, 1.5)) for k, x in ((1, 20.0), (2, 20.0 + gap))]
    got = G.couple_trajectories(spark.createDataFrame(rows, "trajectory long, time timestamp_ntz, lon double, lat double"), 300.0, 1.0).collect()
    assert {r["start"] for r in got} == {t0 + timedelta(days=1)} and len(got) == 3


def test_regions_hold_centres_on_their_edge(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(k, t0 + timedelta(days=d), x, -40.0) for d in range(3) for k, x in ((1, 61.0), (2, 59.0 + 1e-12))]
    regions = G.regions_from_rings(spark, [("a", 1, 1, [(50.0, -45.0), (60.0, -45.0), (60.0, -35.0), (50.0, -35.0)])])
    tracks = spark.createDataFrame(rows, "trajectory long, time timestamp_ntz, lon double, lat double")
    assert G.couple_trajectories(tracks, 300.0, 1.0, regions).count() == 3


def test_nearest_field_takes_the_smallest_columns_of_one_place(spark):
    t0 = datetime(2024, 1, 1)
    field = spark.createDataFrame([(t0, 1.0, 1.0, z) for z in (5.0, 2.0, 9.0)], "time timestamp_ntz, lon double, lat double, z double")
    points = spark.createDataFrame([(1, t0, 1.0, 1.5)], "id long, time timestamp_ntz, lon double, lat double")
    assert [r["z"] for r in G.nearest_field(points, field, ["z"], 100.0, ["id"]).collect()] == [2.0]

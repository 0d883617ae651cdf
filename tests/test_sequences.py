"""Hand-made cases of rules that depend on order."""

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from trackmill.functions.grid import RegularGrid, infer_spacing
from trackmill.operators import branches as B
from trackmill.operators import cleaning as C
from trackmill.operators import float_qc as Q
from trackmill.operators import segments as S
from trackmill.operators import transitions as X
from trackmill.sources import tables as T

DAY0 = dt.datetime(2024, 1, 1)


def track(spark, points, hours=24, key=1):
    rows = [(key, i, DAY0 + dt.timedelta(hours=hours * i), *p) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "trajectory long, obs long, time timestamp_ntz, lon double, lat double")


def test_jump_is_removed_and_split(spark):
    # One fix far off and back again goes; a lasting jump splits.
    t = track(spark, [(0.0, 0.0), (0.5, 0.0), (40.0, 0.0), (1.0, 0.0), (1.5, 0.0), (90.0, 0.0), (90.5, 0.0)])
    got = Q.jump_qc(t.withColumn("segment", F.lit(0).cast("long")), 200.0, 1).orderBy("obs").collect()
    assert [(r["obs"], r["part"]) for r in got] == [(0, 0), (1, 0), (3, 0), (4, 0), (5, 1), (6, 1)]


def test_repairs_cascade(spark):
    rows = [(1, i, b) for i, b in enumerate("aabacaab")] + [(2, 0, None), (2, 1, "a"), (2, 2, None)]
    got = Q.repair_isolated_bins(spark.createDataFrame(rows, "trajectory long, obs long, bin string"), "bin", 1).orderBy("trajectory", "obs").collect()
    assert "".join(r["bin"] for r in got[:8]) == "aaaaaaab" and [r["bin"] for r in got[8:]] == [None, "a", None]


def test_conflicting_times_fail(spark):
    t = track(spark, [(0.0, 0.0), (1.0, 0.0)], hours=0)
    with pytest.raises(SparkRuntimeException):
        C.dedup_times_or_fail(t).collect()
    same = track(spark, [(1.0, 0.0), (1.0, 0.0)], hours=0)
    assert [r["obs"] for r in C.dedup_times_or_fail(same).collect()] == [1]


def test_backward_runs_have_negative_ages(spark):
    t = track(spark, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], hours=-12)
    assert [r["direction"] for r in C.time_direction(t).collect()] == [-1]
    assert [r["age_us"] for r in S.release_age(t).orderBy("obs").collect()] == [0, -43200 * 10**6, -86400 * 10**6]


def test_endpoints_cross_the_antimeridian(spark):
    t = track(spark, [(179.0, 0.0), (-179.0, 2.0), (-177.0, 4.0)])
    got = X.endpoints(t, 43200).orderBy("lat").collect()
    assert [(r["lon1"], r["lat1"]) for r in got] == [(-180.0, 1.0), (-178.0, 3.0)]


def test_cardinal_shares_add_up(spark):
    grid = RegularGrid(-180, 180, -90, 90, 10, 10)
    t = track(spark, [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0), (0.0, 0.0)])
    rows = X.cardinal_probabilities(X.transition_matrix(X.consecutive(t), grid)).collect()
    assert all(abs(r["stay"] + r["north"] + r["east"] + r["south"] + r["west"] - 1) < 1e-12 for r in rows)
    first = next(r for r in rows if (r["start_lon_bin"], r["start_lat_bin"]) == (18, 9))
    assert (first["stay"], first["north"]) == (0.5, 0.5)


def test_grid_edges(spark):
    grid = RegularGrid(0, 10, 0, 10, 5, 5)
    t = track(spark, [(0.0, 0.0), (5.0, 5.0), (10.0, 5.0), (5.0, 10.0), (-0.1, 5.0), (None, 5.0)])
    assert {(r["lon_bin"], r["lat_bin"]) for r in grid.assign(t).collect()} == {(0, 0), (1, 1)}
    assert infer_spacing(t, "lon") == 5.0
    assert grid.densify(grid.aggregate(t, "lat", "count")).count() == 4


def test_modes_of_a_split_flow():
    w = np.zeros(72)
    w[0] = w[18] = 10
    modes = B.circular_peaks(w, 1.5, 0.1, 6)
    assert [m[0] for m in modes] == [0, 18] and sorted(j % 72 for _, a, b in modes for j in range(a, b + 1)) == list(range(72))
    assert B.circular_peaks(np.zeros(72), 1.5, 0.1, 6) == []


def test_shapes_round_trip(spark, tmp_path):
    t = track(spark, [(0.0, 1.0), (2.0, 3.0)])
    wide = T.rows_to_arrays(t, ["time", "lon", "lat"])
    back = T.arrays_to_rows(wide).orderBy("obs").collect()
    assert [(r["obs"], r["lon"], r["lat"]) for r in back] == [(0, 0.0, 1.0), (1, 2.0, 3.0)]
    T.save_table(t, f"{tmp_path}/t.parquet")
    assert T.read_trajectories(spark, f"{tmp_path}/t.parquet").count() == 2
    assert T.get_or_build(spark, f"{tmp_path}/none.parquet", ["lon"], lambda: t).count() == 2
    with pytest.raises(ValueError):
        T.read_trajectories(spark, "t.nc")
    with pytest.raises(KeyError):
        T.resolve_schema(t, {"lon": "longitude"})
    T.write_lines_geojson(track(spark, [(179.0, 0.0), (179.5, 0.0), (-179.5, 0.0), (-179.0, 0.0)]), f"{tmp_path}/lines", "trajectory", "obs")
    assert spark.read.text(f"{tmp_path}/lines").count() == 2


def test_text_sources(spark, tmp_path):
    (tmp_path / "drift.csv").write_text("ID,time,latitude,longitude,drogue_lost_date,DrogueLength\n7,2024-01-01T00:00:00Z,1.5,2.5,,15 m\n7,bad,1,2,,\n")
    got = T.read_drifters(spark, str(tmp_path / "drift.csv")).collect()
    assert [(r["platform"], r["lat"], r["drogue_length"]) for r in got] == [("7", 1.5, 15.0)]
    (tmp_path / "fixes").mkdir()
    (tmp_path / "fixes" / "a12.txt").write_text("head\n*END OF HEADER\nx 2024/01/02 03:04:05 1.0 2.0 1\nshort line\n")
    got = T.read_text_fixes(spark, str(tmp_path / "fixes")).collect()
    assert [(r["platform"], r["lat"], r["lon"], r["at_sea"]) for r in got] == [("a12", 1.0, 2.0, 1)]
    wide = spark.createDataFrame([("g", 2, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "trajectory string, group_size int, lon_1 double, lat_1 double, lon_2 double, lat_2 double, lon_3 double, lat_3 double")
    assert [r["trajectory"] for r in T.expand_members(wide, 3).orderBy("trajectory").collect()] == ["g_m1", "g_m2"]

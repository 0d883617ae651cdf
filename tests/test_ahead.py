"""Passes that look ahead end their frames at the current row: one that ends with its partition is gone through anew for each row."""

import random
from datetime import datetime, timedelta

from trackmill.operators import nearest as N
from trackmill.operators import spatial as G


def frames(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_nearest_times_are_found_in_one_pass(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    times = [t0 + timedelta(days=rng.choice([0, 1, 1, 6, 9]), seconds=rng.randrange(500)) for _ in range(300)]
    samples = [t0 + timedelta(days=rng.choice([1, 1, 6]), seconds=rng.randrange(500)) for _ in range(40)]
    got = N.nearest_time(spark.createDataFrame([(t,) for t in times], "time timestamp_ntz"), spark.createDataFrame([(t,) for t in samples], "time timestamp_ntz"))
    assert "unboundedfollowing" not in frames(got)
    assert {r["time"]: r["nearest"] for r in got.collect()} == {t: min(samples, key=lambda s: (abs(s - t), s)) for t in times}


def test_samples_nearest_in_time_are_found_in_one_pass(spark):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    p = [(g, i, t0 + timedelta(seconds=rng.randrange(900)), 5.0) for g in range(4) for i in range(60)]
    s = [(g, i, t0 + timedelta(seconds=second), 5.0, float(i)) for g in range(3) for i, second in enumerate(rng.sample(range(900), 25))]
    points = spark.createDataFrame(p, "g long, id long, time timestamp_ntz, pressure double")
    samples = spark.createDataFrame(s, "g long, observation_index long, time timestamp_ntz, pressure double, v double")
    want = {(g, i): min(((abs(u - t), u, v) for h, _, u, _, v in s if h == g), default=(0, 0, None))[2] for g, i, t, _ in p}
    near = G.nearest_in_time(points.drop("pressure"), samples, "v", ["id"], ["g"])
    taken = G.sample_observations(points, samples, "v", ["g"], ["id"])
    assert "unboundedfollowing" not in frames(near) + frames(taken)
    assert {(r["g"], r["id"]): r["nearest_v"] for r in near.collect()} == want
    apart = {(g, i): min((abs(u - t) for h, _, u, *_ in s if h == g), default=None) for g, i, t, _ in p}
    assert all((r["sample_days"] is None) == (apart[r["g"], r["id"]] is None) and (r["sample_days"] is None or abs(r["sample_days"] * 86400 - apart[r["g"], r["id"]].total_seconds()) < 1e-6) for r in taken.collect())

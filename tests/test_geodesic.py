import numpy as np

from trackmill.functions import geodesic as G


def test_published_line_and_round_trip():
    # Flinders Peak to Buninyong, the example that accompanies the method.
    km, az, _ = G.inverse([144 + 25 / 60 + 29.52440 / 3600], [-(37 + 57 / 60 + 3.72030 / 3600)], [143 + 55 / 60 + 35.38390 / 3600], [-(37 + 39 / 60 + 10.15610 / 3600)])
    assert abs(km[0] - 54.972271) < 2e-3 and abs(az[0] - 306.8681) < 1e-2
    rng = np.random.default_rng(1)
    lon, lat, b, d = rng.uniform(-180, 180, 500), rng.uniform(-85, 85, 500), rng.uniform(0, 360, 500), rng.uniform(1, 5000, 500)
    x, y = G.direct(lon, lat, b, d)
    km, az, _ = G.inverse(lon, lat, x, y)
    assert np.allclose(km, d, atol=1e-5) and np.allclose((az - b + 180) % 360, 180, atol=1e-4)


def test_symmetry_and_area():
    km, _, _ = G.inverse([0, 0, 10, 0], [0, 0, 5, 0], [1, 0, 10, 179.9], [0, 90, 5, 0.1])
    assert abs(km[0] - 111.319491) < 1e-5 and abs(km[1] - 10001.965729) < 1e-5 and km[2] == 0 and np.isnan(km[3])
    assert abs(G.zone_area(-90, 90, 360) - 510065621.724) < 1


def test_columns(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (5.0, 5.0, 5.0, 5.0)], "a double, b double, c double, d double")
    rows = df.select(G.wgs84_inverse("a", "b", "c", "d").alias("x"), G.wgs84_direct("a", "b", "c", "d").alias("y")).collect()
    assert abs(rows[0]["x"]["km"] - 111.319491) < 1e-5 and rows[1]["x"]["bearing"] is None and rows[1]["y"]["lon"] is not None

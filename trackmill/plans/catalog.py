"""Registered queries over the trajectory tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.functions.grid import RegularGrid
from trackmill.operators import cleaning as C
from trackmill.operators import diagnostics as D
from trackmill.operators import segments as S
from trackmill.operators import transitions as X
from trackmill.plans.tracks import VARIANTS, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The globe in cells of 10 by 5 degrees.
GRID = RegularGrid(-180.0, 180.0, -90.0, 90.0, 10.0, 5.0)
BINS = "CAST(floor((lon + 180.0) / 10.0) AS BIGINT) AS lon_bin, CAST(floor((lat + 90.0) / 5.0) AS BIGINT) AS lat_bin"
INSIDE = "lon >= -180 AND lon < 180 AND lat >= -90 AND lat < 90"


def query(name: str, sql: str | None = None, variant: str = "irregular"):
    """Register a function of a track table as a query; sql: its twin over {t}, the same table."""

    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(tracks(spark, sf_dir, variant))
        if sql is not None:
            SQL[name] = sql.replace("{t}", f"({VARIANTS[variant]})")
        return f

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


HAVERSINE = "2 * {r} * asin(sqrt(least(1.0, pow(sin(radians({lat1} - {lat0}) / 2), 2) + cos(radians({lat0})) * cos(radians({lat1})) * pow(sin(radians({lon1} - {lon0}) / 2), 2))))"
MICROS = "epoch_us(time)"


def haversine_sql(lon0, lat0, lon1, lat1, r=6371.0) -> str:
    return HAVERSINE.format(lon0=lon0, lat0=lat0, lon1=lon1, lat1=lat1, r=r)


# Cleaning


@query("filter_bbox", "SELECT * FROM {t} WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30")
def _(t):
    return C.filter_bbox(t, -60, 60, -30, 30)


@query("filter_time_range", "SELECT * FROM {t} WHERE time >= TIMESTAMP '2024-01-05 00:00:00' AND time <= TIMESTAMP '2024-01-20 00:00:00'")
def _(t):
    return C.filter_range(t, "time", "2024-01-05 00:00:00", "2024-01-20 00:00:00")


@query("filter_z_range", "SELECT * FROM {t} WHERE z >= 100 AND z <= 400")
def _(t):
    return C.filter_range(t, "z", 100.0, 400.0)


@query("filter_trajectories", "SELECT * FROM {t} WHERE trajectory IN (SELECT trajectory FROM {t} GROUP BY trajectory HAVING count(*) >= 70)")
def _(t):
    return C.filter_trajectories(t, t.groupBy("trajectory").count().where("count >= 70"))


@query("valid_range", "SELECT * FROM {t} WHERE isfinite(z) AND z BETWEEN 50 AND 900")
def _(t):
    return C.valid_range(t, "z", 50.0, 900.0)


@query("truncate_at_first_invalid", "SELECT * EXCLUDE bad FROM (SELECT *, max(CASE WHEN lon IS NULL OR lat IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory ORDER BY obs) AS bad FROM {t}) WHERE bad = 0", "invalid")
def _(t):
    return C.truncate_at_first_invalid(t)


@query(
    "truncate_stagnant",
    """WITH s AS (SELECT *, CASE WHEN abs(lead(lon) OVER w - lon) <= 0.01 AND abs(lead(lat) OVER w - lat) <= 0.01 THEN 1 ELSE 0 END AS still FROM {t} WINDOW w AS (PARTITION BY trajectory ORDER BY obs)),
    r AS (SELECT *, sum(1 - still) OVER (PARTITION BY trajectory ORDER BY obs) AS run FROM s),
    c AS (SELECT trajectory, min(first) AS cut FROM (SELECT trajectory, run, min(CASE WHEN still = 1 THEN obs END) AS first FROM r GROUP BY ALL HAVING sum(still) >= 5) GROUP BY ALL)
    SELECT t.* FROM {t} t LEFT JOIN c USING (trajectory) WHERE cut IS NULL OR (obs <= cut AND cut > 0)""",
    "stagnant",
)
def _(t):
    return C.truncate_stagnant(t, 0.01, 5)


@query("dedup_times", "SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY trajectory, time ORDER BY obs) AS r FROM (SELECT * REPLACE (date_trunc('day', time) AS time) FROM {t})) WHERE r = 1")
def _(t):
    return C.dedup_times(t.withColumn("time", F.date_trunc("day", "time").cast("timestamp_ntz")))


@query("time_direction", "SELECT trajectory, CASE WHEN min(s) = max(s) AND max(s) != 0 THEN CAST(max(s) AS INTEGER) END AS direction FROM (SELECT trajectory, sign(epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY trajectory ORDER BY obs)) AS s FROM {t}) GROUP BY trajectory")
def _(t):
    return C.time_direction(t)


@query("qc_failures", "SELECT trajectory, obs, concat_ws(';', CASE WHEN position_qc NOT IN ('1', '2') THEN 'position_qc' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'event_type' END) AS failed FROM {t}", "qc")
def _(t):
    return t.select("trajectory", "obs", F.concat_ws(";", C.qc_failures({"position_qc": ("1", "2"), "event_type": ("click", "view")})).alias("failed"))


@query("adjusted_or_raw", "SELECT reason, count(*) AS n, round(sum(v), 6) AS total FROM (SELECT CASE WHEN lat IS NOT NULL THEN CASE WHEN lat > 0 THEN 'adjusted' ELSE 'adjusted rejected' END ELSE CASE WHEN z < 500 THEN 'raw' ELSE 'raw rejected' END END AS reason, CASE WHEN lat > 0 THEN lat WHEN lat IS NULL AND z < 500 THEN z END AS v FROM {t}) GROUP BY reason", "invalid")
def _(t):
    value, reason = C.adjusted_or_raw(F.col("lat"), F.col("z"), F.col("lat") > 0, F.col("z") < 500)
    return t.select(value.alias("v"), reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query("min_duration", "SELECT * EXCLUDE d FROM (SELECT *, max(epoch_us(time)) OVER (PARTITION BY trajectory) - min(epoch_us(time)) OVER (PARTITION BY trajectory) AS d FROM {t}) WHERE d >= 28 * 86400 * 1000000::BIGINT")
def _(t):
    return C.min_duration(t, 28)


@query("life_trim_stride", "SELECT * EXCLUDE life FROM (SELECT *, epoch_us(time) - min(epoch_us(time)) OVER w AS age_us, max(epoch_us(time)) OVER w - min(epoch_us(time)) OVER w AS life FROM {t} WINDOW w AS (PARTITION BY trajectory)) WHERE life >= 15 * 86400 * 1000000::BIGINT AND age_us <= 10 * 86400 * 1000000::BIGINT AND obs % 2 = 0", "regular")
def _(t):
    return C.life_trim_stride(t, 15, 10, 2)


@query(
    "suspect_segments",
    f"SELECT trajectory, obs, round(km, 6) AS km, round(speed, 6) AS speed FROM (SELECT *, km * 1000 / dt AS speed FROM (SELECT trajectory, obs, (epoch_us(time) - epoch_us(t0)) / 1e6 AS dt, {haversine_sql('lon0', 'lat0', 'lon', 'lat', 6371.0088)} AS km FROM (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(time) OVER w AS t0 FROM {{t}} WINDOW w AS (PARTITION BY trajectory ORDER BY obs))) WHERE dt > 0) WHERE speed > 8 OR km > 120",
)
def _(t):
    return rounded(C.suspect_segments(t, 8.0, 120.0).select("trajectory", "obs", "km", "speed"), 6, "km", "speed")


@query("convert_lon", "SELECT * REPLACE (lon - 360 * floor(lon / 360) AS lon) FROM {t}")
def _(t):
    return C.convert_lon(t, True)


@query("select_from_first_entry", "SELECT * EXCLUDE hit FROM (SELECT *, max(CASE WHEN lon BETWEEN -40 AND 40 THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory ORDER BY obs) AS hit FROM {t}) WHERE hit = 1")
def _(t):
    return C.select_by_region(t, F.col("lon").between(-40, 40), "from_first_entry")


@query("null_off_grid", "SELECT * REPLACE (CASE WHEN least(r, 3600000000 - r) <= 600000000 THEN lon END AS lon, CASE WHEN least(r, 3600000000 - r) <= 600000000 THEN lat END AS lat) EXCLUDE r FROM (SELECT *, epoch_us(time) % 3600000000 AS r FROM {t})".replace("SELECT * REPLACE (", "SELECT * EXCLUDE (r) REPLACE (").replace(" EXCLUDE r FROM", " FROM"))
def _(t):
    return C.null_off_grid(t, 3600, 600)


# Segments


@query("segment_by_gap", "SELECT *, sum(CASE WHEN gap > 2 * 86400 * 1000000::BIGINT THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory ORDER BY obs)::BIGINT AS segment FROM (SELECT *, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY trajectory ORDER BY obs) AS gap FROM {t})".replace("SELECT *, sum", "SELECT * EXCLUDE gap, sum"))
def _(t):
    return S.segment_by_gap(t, 2)


@query("segment_by_cadence", "SELECT * EXCLUDE dt, sum(CASE WHEN abs(dt - 6.0) > 18.0 THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory ORDER BY obs)::BIGINT AS segment FROM (SELECT *, (epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY trajectory ORDER BY obs)) / 3600e6 AS dt FROM {t})")
def _(t):
    return S.segment_by_cadence(t, 6 * 3600, 18 * 3600)


@query(
    "split_on_qc",
    """WITH r AS (SELECT *, sum(CASE WHEN position_qc IN ('1', '2', '3') THEN 0 ELSE 1 END) OVER (PARTITION BY trajectory ORDER BY obs) AS run FROM {t}),
    k AS (SELECT *, count(*) OVER (PARTITION BY trajectory, run) AS n FROM r WHERE position_qc IN ('1', '2', '3'))
    SELECT * EXCLUDE (run, n), dense_rank() OVER (PARTITION BY trajectory ORDER BY run) - 1 AS segment FROM k WHERE n >= 3""",
    "qc",
)
def _(t):
    return S.split_on_qc(t, F.col("position_qc").isin("1", "2", "3"), 3)


@query(
    "directional_segments",
    """WITH s AS (SELECT trajectory, obs, CASE WHEN nxt - lat > 0.3 THEN 1 WHEN nxt - lat < -0.3 THEN -1 ELSE 0 END AS sign FROM (SELECT *, lead(lat) OVER (PARTITION BY trajectory ORDER BY obs) AS nxt FROM {t}) WHERE nxt IS NOT NULL),
    i AS (SELECT *, sum(b) OVER (PARTITION BY trajectory ORDER BY obs)::BIGINT AS segment FROM (SELECT *, CASE WHEN sign != lag(sign) OVER (PARTITION BY trajectory ORDER BY obs) THEN 1 ELSE 0 END AS b FROM s))
    SELECT trajectory, segment, sign, min(obs) AS first_obs, max(obs) AS last_obs, count(*) + 1 AS points FROM i WHERE sign != 0 GROUP BY ALL""",
)
def _(t):
    return S.directional_segments(t, 0.3)


@query("rolling_mean", "SELECT * , round(avg(lat) OVER (PARTITION BY trajectory ORDER BY obs ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS lat_mean FROM {t}")
def _(t):
    return rounded(S.rolling(t, "lat", 5), 9, "lat_mean")


@query("total_variation", "SELECT trajectory, sum(abs(d)) AS total_variation FROM (SELECT trajectory, lat - lag(lat) OVER (PARTITION BY trajectory ORDER BY obs) AS d FROM {t}) GROUP BY trajectory", "invalid")
def _(t):
    return S.total_variation(t, "lat")


@query("isolated_label_filter", "SELECT trajectory, obs, CASE WHEN p = n AND p != event_type THEN p ELSE event_type END AS event_type FROM (SELECT *, lag(event_type) OVER w AS p, lead(event_type) OVER w AS n FROM {t} WINDOW w AS (PARTITION BY trajectory ORDER BY obs))")
def _(t):
    return S.isolated_label_filter(t, "event_type").select("trajectory", "obs", "event_type")


@query("depth_histogram", "SELECT CASE WHEN z < 100 THEN 0 WHEN z < 300 THEN 1 ELSE 2 END AS depth_bin, count(*) AS observations, count(DISTINCT trajectory) AS trajectories FROM {t} WHERE z >= 0 AND z < 1000 GROUP BY 1")
def _(t):
    return D.depth_histogram(t, [0.0, 100.0, 300.0, 1000.0])


@query(
    "cycle_representative",
    """SELECT * EXCLUDE (rep, r) FROM (SELECT *, row_number() OVER (PARTITION BY trajectory, cycle_number ORDER BY CASE WHEN position_qc IN ('1', '2') THEN 0 ELSE 1 END, CASE WHEN lon = 0 AND lat = 0 THEN 1 ELSE 0 END, -rep, obs) AS r
    FROM (SELECT *, count(*) OVER (PARTITION BY trajectory, cycle_number, lon, lat) AS rep FROM {t})) WHERE r = 1""",
    "qc",
)
def _(t):
    return S.cycle_representative(t)


@query(
    "unwrap_lon",
    "SELECT * EXCLUDE turn, lon + sum(turn) OVER (PARTITION BY trajectory ORDER BY obs) AS lon_unwrapped FROM (SELECT *, CASE WHEN lon - lag(lon) OVER w > 180 THEN -360.0 WHEN lon - lag(lon) OVER w < -180 THEN 360.0 ELSE 0.0 END::DOUBLE AS turn FROM {t} WINDOW w AS (PARTITION BY trajectory ORDER BY obs))",
)
def _(t):
    return S.unwrap_lon(t)


@query("antimeridian_parts", "SELECT * EXCLUDE b, sum(b) OVER (PARTITION BY trajectory ORDER BY obs)::BIGINT AS part FROM (SELECT *, CASE WHEN abs(lon - lag(lon) OVER (PARTITION BY trajectory ORDER BY obs)) > 180 THEN 1 ELSE 0 END AS b FROM {t})")
def _(t):
    return S.antimeridian_parts(t, ["trajectory"])


@query(
    "resample_6h",
    """WITH d AS (SELECT * EXCLUDE r FROM (SELECT *, epoch_us(time) AS t, row_number() OVER (PARTITION BY trajectory, time ORDER BY obs) AS r FROM {t}) WHERE r = 1),
    u AS (SELECT *, lon + sum(turn) OVER (PARTITION BY trajectory ORDER BY t) AS ulon FROM (SELECT *, CASE WHEN lon - lag(lon) OVER w > 180 THEN -360.0 WHEN lon - lag(lon) OVER w < -180 THEN 360.0 ELSE 0.0 END AS turn FROM d WINDOW w AS (PARTITION BY trajectory ORDER BY t))),
    b AS (SELECT trajectory, min(t) AS t0, max(t) AS t1 FROM u GROUP BY trajectory),
    g AS (SELECT trajectory, unnest(range(t0, t1 + 1, 21600000000)) AS g FROM b UNION SELECT trajectory, t1 FROM b),
    j AS (SELECT g.trajectory, g.g, a.t AS ta, a.ulon AS xa, a.lat AS ya, z.t AS tz, z.ulon AS xz, z.lat AS yz FROM g ASOF JOIN u a ON g.trajectory = a.trajectory AND g.g >= a.t ASOF JOIN u z ON g.trajectory = z.trajectory AND g.g <= z.t),
    o AS (SELECT trajectory, g, CASE WHEN g = ta THEN xa ELSE xa + (g - ta) / (tz - ta) * (xz - xa) END AS x, CASE WHEN g = ta THEN ya ELSE ya + (g - ta) / (tz - ta) * (yz - ya) END AS y FROM j)
    SELECT trajectory, row_number() OVER (PARTITION BY trajectory ORDER BY g) - 1 AS obs, make_timestamp(g) AS time, round(x + 180 - 360 * floor((x + 180) / 360) - 180, 6) AS lon, round(y, 6) AS lat FROM o""",
)
def _(t):
    return rounded(S.resample(t, 6 * 3600), 6, "lon", "lat")


@query("cadence", "SELECT d / 1e6 AS step_s, count(*) AS n FROM (SELECT epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY trajectory ORDER BY obs) AS d FROM {t}) WHERE d IS NOT NULL GROUP BY 1", "regular")
def _(t):
    return S.cadence(t)


@query("release_age", "SELECT trajectory, obs, first(time) OVER w AS release_time, epoch_us(time) - epoch_us(first(time) OVER w) AS age_us FROM {t} WINDOW w AS (PARTITION BY trajectory ORDER BY obs ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(t):
    return S.release_age(t).select("trajectory", "obs", "release_time", "age_us")


@query("renumber", "SELECT dense_rank() OVER (ORDER BY trajectory) - 1 AS trajectory, row_number() OVER (PARTITION BY trajectory ORDER BY time, obs) - 1 AS obs, time, lon, lat FROM {t}", "regular")
def _(t):
    return S.renumber(t, ["trajectory"]).select("trajectory", "obs", "time", "lon", "lat")


# Diagnostics

SUMMARY = "SELECT trajectory, count(*) AS n_obs, min_by(time, obs) AS time_first, max_by(time, obs) AS time_last, min_by(lon, obs) AS lon_first, max_by(lon, obs) AS lon_last, min_by(lat, obs) AS lat_first, max_by(lat, obs) AS lat_last, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(avg(z), 6) AS z_mean, (epoch_us(max_by(time, obs)) - epoch_us(min_by(time, obs))) / 1e6 AS lifetime_s FROM {t} GROUP BY trajectory"


@query("particle_summary", SUMMARY)
def _(t):
    return rounded(D.particle_summary(t, variables=("z",)).drop("z_first", "z_last"), 6, "z_min", "z_max", "z_mean")


@query("beaching_times", f"SELECT CAST(floor((lon_first + 180.0) / 10.0) AS BIGINT) AS lon_bin, CAST(floor((lat_first + 90.0) / 5.0) AS BIGINT) AS lat_bin, round(min(lifetime_s / 86400), 9) AS value FROM ({SUMMARY}) GROUP BY 1, 2")
def _(t):
    return rounded(D.beaching_times(D.particle_summary(t), GRID), 9, "value").select("lon_bin", "lat_bin", "value")


@query("time_density", f"SELECT time, lon_bin, lat_bin, n, n_active, n_total, round(n / n_active, 9) AS active_fraction, round(n / n_total, 9) AS total_fraction FROM (SELECT time, {BINS}, count(*) AS n FROM {{t}} WHERE {INSIDE} GROUP BY ALL) JOIN (SELECT time, count(*) AS n_active FROM {{t}} GROUP BY time) USING (time) CROSS JOIN (SELECT count(DISTINCT trajectory) AS n_total FROM {{t}})", "regular")
def _(t):
    return rounded(D.time_density(t, GRID), 9, "active_fraction", "total_fraction")


for _how, _sql in {"mean": "avg(z)", "count": "count(z)", "sum": "sum(z)", "min": "min(z)", "max": "max(z)", "median": "median(z)", "std": "stddev_samp(z)"}.items():
    query(f"grid_{_how}", f"SELECT {BINS}, round(CAST({_sql} AS DOUBLE), 6) AS value FROM {{t}} WHERE {INSIDE} GROUP BY 1, 2")(lambda t, how=_how: GRID.aggregate(t, "z", how).select("lon_bin", "lat_bin", F.round(F.col("value").cast("double"), 6).alias("value")))


@query("grid_densify", f"SELECT x.range AS lon_bin, y.range AS lat_bin, coalesce(n, 0)::DOUBLE AS value FROM range(36) x CROSS JOIN range(36) y LEFT JOIN (SELECT {BINS}, count(*) AS n FROM {{t}} WHERE {INSIDE} GROUP BY 1, 2) g ON g.lon_bin = x.range AND g.lat_bin = y.range")
def _(t):
    return GRID.densify(GRID.aggregate(t, "z", "count").withColumn("value", F.col("value").cast("double")), fill=0.0).select("lon_bin", "lat_bin", "value")


EXCURSION = """SELECT trajectory, min_by(lat, obs) AS lat_start, min_by(lon, obs) AS lon_start, arg_min(struct_pack(a := lat, o := lon, t := time), struct_pack(a := lat, t := time, o := obs)) AS s,
    arg_min(struct_pack(a := lat, o := lon, t := time), struct_pack(a := -lat, t := time, o := obs)) AS n, min_by(time, obs) AS t0 FROM {t} GROUP BY trajectory"""


@query("meridional_excursion", f"SELECT trajectory, lon_start, lat_start, s.o AS lon_south, s.a AS lat_south, n.o AS lon_north, n.a AS lat_north, (epoch_us(s.t) - epoch_us(t0)) / 86400e6 AS south_age_days, (epoch_us(n.t) - epoch_us(t0)) / 86400e6 AS north_age_days, s.a - lat_start AS south_excursion, n.a - lat_start AS north_excursion FROM ({EXCURSION})", "regular")
def _(t):
    return D.meridional_excursion(t)


@query("excursion_grid", f"SELECT CAST(floor((lon_start + 180.0) / 10.0) AS BIGINT) AS lon_bin, CAST(floor((lat_start + 90.0) / 5.0) AS BIGINT) AS lat_bin, round(avg(n.a - lat_start), 9) AS value, count(*) AS n FROM ({EXCURSION}) GROUP BY 1, 2", "regular")
def _(t):
    return rounded(D.excursion_grid(D.meridional_excursion(t), GRID, "start", "north_excursion"), 9, "value")


@query("sampled_map_points", f"SELECT lon_bin, lat_bin, c AS count, k AS trajectory_count, CASE WHEN c >= 3 AND k >= 2 THEN round(m, 6) END AS mean, CASE WHEN c >= 3 AND k >= 2 THEN round(s, 6) END AS std FROM (SELECT {BINS}, count(*) AS c, count(DISTINCT trajectory) AS k, avg(z) AS m, stddev_samp(z) AS s FROM {{t}} WHERE {INSIDE} GROUP BY 1, 2)")
def _(t):
    return rounded(D.sampled_map(t, GRID, "z", "points", 3, 2), 6, "mean", "std")


@query("sampled_map_trajectories", f"SELECT lon_bin, lat_bin, sum(c)::BIGINT AS count, count(*) AS trajectory_count, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM (SELECT {BINS}, trajectory, count(*) AS c, avg(z) AS m FROM {{t}} WHERE {INSIDE} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(t):
    return rounded(D.sampled_map(t, GRID, "z", "trajectories"), 6, "mean", "std")


@query("alive_latitude_fraction", "WITH a AS (SELECT time, count(*) AS alive FROM {t} GROUP BY time), b AS (SELECT time, CAST(least(floor((lat + 60) / 10), 11) AS BIGINT) AS lat_bin, count(*) AS n FROM {t} WHERE lat BETWEEN -60 AND 60 GROUP BY 1, 2) SELECT a.time, x.range AS lat_bin, -60e0 + x.range * 10 AS bin_low, -50e0 + x.range * 10 AS bin_high, coalesce(b.n, 0) AS n, alive, round(coalesce(b.n, 0) / alive, 9) AS fraction FROM a CROSS JOIN range(12) x LEFT JOIN b ON b.time = a.time AND b.lat_bin = x.range", "regular")
def _(t):
    return rounded(D.alive_latitude_fraction(t, -60.0, 60.0, 10.0), 9, "fraction")


@query("velocity_stats", f"SELECT count(v) AS steps, round(avg(v), 6) AS mean_speed, round(stddev_pop(v), 6) AS std_speed, round(max(v), 6) AS max_speed FROM (SELECT CASE WHEN epoch_us(time) > epoch_us(t0) THEN {haversine_sql('lon0', 'lat0', 'lon', 'lat')} * 1000 / ((epoch_us(time) - epoch_us(t0)) / 1e6) END AS v FROM (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(time) OVER w AS t0 FROM {{t}} WINDOW w AS (PARTITION BY trajectory ORDER BY obs)))", "regular")
def _(t):
    return rounded(D.velocity_stats(t), 6, "mean_speed", "std_speed", "max_speed")


@query("counts_per_time", "SELECT time, count(*) AS n_raw, count(CASE WHEN z BETWEEN 50 AND 400 THEN 1 END) AS n_cleaned FROM {t} GROUP BY time", "regular")
def _(t):
    return D.counts_per_time(t, C.valid_range(t, "z", 50.0, 400.0))


@query("mode_region", "SELECT trajectory, min_by(event_type, struct_pack(a := -n, b := event_type)) AS mode FROM (SELECT trajectory, event_type, count(*) AS n FROM {t} GROUP BY ALL) GROUP BY trajectory")
def _(t):
    return D.mode_region(t, "event_type")


CROSSING = """WITH i AS (SELECT *, sum(b) OVER (PARTITION BY trajectory ORDER BY obs) AS segment FROM (SELECT *, CASE WHEN sign != lag(sign) OVER (PARTITION BY trajectory ORDER BY obs) THEN 1 ELSE 0 END AS b
      FROM (SELECT *, CASE WHEN lat1 - lat > 0.2 THEN 1 WHEN lat1 - lat < -0.2 THEN -1 ELSE 0 END AS sign FROM (SELECT trajectory, obs, time, lon, lat, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1, lead(time) OVER w AS time1 FROM {t} WINDOW w AS (PARTITION BY trajectory ORDER BY obs)) WHERE lat1 IS NOT NULL))),
    v AS (SELECT trajectory, segment, any_value(sign) AS sign, arg_min(lat, obs) AS a, arg_max(lat1, obs) AS z FROM i WHERE sign != 0 GROUP BY trajectory, segment HAVING epoch_us(max(time1)) - epoch_us(min(time)) >= 2 * 86400000000 OR abs(arg_max(lat1, obs) - arg_min(lat, obs)) >= {span}),
    c AS (SELECT v.*, k.range AS k, {line} AS y FROM v CROSS JOIN range({lines}) k),
    d AS (SELECT * FROM c WHERE (sign = 1 AND y > a + 1e-12 AND y <= z + 1e-12 AND k < 36) OR (sign = -1 AND y < a - 1e-12 AND y >= z - 1e-12 AND k >= {south})),
    m AS (SELECT d.sign, d.k, d.y, i.lon + (d.y - i.lat) / (i.lat1 - i.lat) * (i.lon1 - i.lon + 180 - 360 * floor((i.lon1 - i.lon + 180) / 360) - 180) AS x FROM d JOIN i ON i.trajectory = d.trajectory AND i.segment = d.segment WHERE d.y BETWEEN least(i.lat, i.lat1) AND greatest(i.lat, i.lat1) AND abs(i.lat1 - i.lat) > 1e-12 + 1e-5 * abs(i.lat) QUALIFY row_number() OVER (PARTITION BY d.trajectory, d.segment, d.k ORDER BY i.obs) = 1),
    n AS (SELECT sign, count(*) AS segments FROM v GROUP BY sign)
    SELECT {bin} AS lat_bin, CAST(floor((x + 180 - 360 * floor((x + 180) / 360)) / 10) AS BIGINT) AS lon_bin, sign, count(*) AS crossings, segments, round(count(*) / segments, 9) AS probability FROM m JOIN n USING (sign) GROUP BY 1, 2, sign, segments"""


@query("meridional_crossing", CROSSING.replace("{span}", "5.0").replace("{line}", "-87.5e0 + 5 * k.range").replace("{lines}", "36").replace("{south}", "0").replace("{bin}", "k"))
def _(t):
    return rounded(D.meridional_crossing(S.directional_segments(t, 0.2), t, GRID, 2.0), 9, "probability")


@query("meridional_crossing_edges", CROSSING.replace("{span}", "1.5").replace("{line}", "-90e0 + 5 * k.range").replace("{lines}", "37").replace("{south}", "1").replace("{bin}", "CASE WHEN sign = 1 THEN k ELSE k - 1 END"))
def _(t):
    return rounded(D.meridional_crossing(S.directional_segments(t, 0.2), t, GRID, 2.0, 1.5, "edge"), 9, "probability")


# Transitions

STEPS = "SELECT trajectory, lon, lat, lead(lon) OVER (PARTITION BY trajectory ORDER BY obs) AS lon1, lead(lat) OVER (PARTITION BY trajectory ORDER BY obs) AS lat1 FROM {t}"
MATRIX = f"""SELECT a AS start_lon_bin, b AS start_lat_bin, c AS end_lon_bin, d AS end_lat_bin, n AS transition_count, -175e0 + a * 10 AS start_lon_center, -87.5e0 + b * 5 AS start_lat_center, -175e0 + c * 10 AS end_lon_center, -87.5e0 + d * 5 AS end_lat_center, n / sum(n) OVER (PARTITION BY a, b) AS transition_probability
    FROM (SELECT CAST(floor((lon + 180.0) / 10.0) AS BIGINT) AS a, CAST(floor((lat + 90.0) / 5.0) AS BIGINT) AS b, CAST(floor((lon1 + 180.0) / 10.0) AS BIGINT) AS c, CAST(floor((lat1 + 90.0) / 5.0) AS BIGINT) AS d, count(*) AS n FROM ({STEPS}) WHERE lon1 IS NOT NULL GROUP BY ALL)"""


def matrix(t: DataFrame) -> DataFrame:
    return X.transition_matrix(X.consecutive(t), GRID)


@query("transition_matrix", f"SELECT * REPLACE (round(transition_probability, 9) AS transition_probability) FROM ({MATRIX})")
def _(t):
    return rounded(matrix(t), 9, "transition_probability")


@query("transition_matrix_entropy", f"SELECT start_lon_bin, start_lat_bin, round(sum(-transition_probability * ln(transition_probability)), 9) AS entropy, count(*) AS destinations, sum(transition_count)::BIGINT AS n_out FROM ({MATRIX}) GROUP BY 1, 2")
def _(t):
    return rounded(X.transition_entropy(matrix(t)), 9, "entropy")


#: The matrix of steps o (lon, lat, x, y).
BINNED = """SELECT *, -175e0 + start_lon_bin * 10 AS start_lon_center, -87.5e0 + start_lat_bin * 5 AS start_lat_center, -175e0 + end_lon_bin * 10 AS end_lon_center, -87.5e0 + end_lat_bin * 5 AS end_lat_center, round(transition_count / sum(transition_count) OVER (PARTITION BY start_lon_bin, start_lat_bin), 9) AS transition_probability
    FROM (SELECT CAST(floor((lon + 180) / 10) AS BIGINT) AS start_lon_bin, CAST(floor((lat + 90) / 5) AS BIGINT) AS start_lat_bin, CAST(floor((x + 180 - 360 * floor((x + 180) / 360)) / 10) AS BIGINT) AS end_lon_bin, CAST(floor((y + 90) / 5) AS BIGINT) AS end_lat_bin, count(*) AS transition_count FROM o GROUP BY ALL)"""


@query(
    "transition_matrix_endpoints",
    """WITH p AS (SELECT trajectory, epoch_us(time) AS t, lon, lat FROM {t}),
    q AS (SELECT trajectory, t + 86400000000 AS g, lon, lat FROM p),
    j AS (SELECT q.*, a.t AS ta, a.lon AS xa, a.lat AS ya, z.t AS tz, z.lon AS xz, z.lat AS yz FROM q ASOF JOIN p a ON q.trajectory = a.trajectory AND q.g >= a.t ASOF JOIN p z ON q.trajectory = z.trajectory AND q.g <= z.t),
    o AS (SELECT lon, lat, CASE WHEN tz = g THEN xz ELSE xa + (g - ta) / (tz - ta) * (xz - xa + 180 - 360 * floor((xz - xa + 180) / 360) - 180) END AS x, CASE WHEN tz = g THEN yz ELSE ya + (g - ta) / (tz - ta) * (yz - ya) END AS y FROM j)
    """ + BINNED,
    "regular",
)
def _(t):
    return rounded(X.transition_matrix(X.endpoints(t, 86400), GRID), 9, "transition_probability")


@query(
    "transition_matrix_chain",
    """WITH p AS (SELECT trajectory, epoch_us(time) AS t, lon, lat FROM {t}), b AS (SELECT trajectory, min(t) AS t0, max(t) AS t1 FROM p GROUP BY trajectory),
    g AS (SELECT trajectory, unnest(range(t0, t1 + 1, 86400000000)) AS g FROM b),
    j AS (SELECT g.trajectory, g.g, a.t AS ta, a.lon AS xa, a.lat AS ya, z.t AS tz, z.lon AS xz, z.lat AS yz FROM g ASOF JOIN p a ON g.trajectory = a.trajectory AND g.g >= a.t ASOF JOIN p z ON g.trajectory = z.trajectory AND g.g <= z.t),
    k AS (SELECT trajectory, g, CASE WHEN ta = g THEN xa ELSE xa + (g - ta) / (tz - ta) * (xz - xa + 180 - 360 * floor((xz - xa + 180) / 360) - 180) END AS x0, CASE WHEN ta = g THEN ya ELSE ya + (g - ta) / (tz - ta) * (yz - ya) END AS lat FROM j),
    o AS (SELECT x0 + 180 - 360 * floor((x0 + 180) / 360) - 180 AS lon, lat, lead(x0) OVER (PARTITION BY trajectory ORDER BY g) AS x, lead(lat) OVER (PARTITION BY trajectory ORDER BY g) AS y FROM k QUALIFY x IS NOT NULL)
    """ + BINNED,
)
def _(t):
    return rounded(X.transition_matrix(X.regular_chain(t, 86400), GRID), 9, "transition_probability")


@query("source_timestep", "SELECT d / 1e6 AS step_s FROM (SELECT epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY trajectory ORDER BY obs) AS d FROM {t}) WHERE d > 0 GROUP BY d ORDER BY count(*) DESC, d LIMIT 1", "regular")
def _(t):
    return X.timestep_table(t)


TURN = "({b}) - ({a}) + 180 - 360 * floor((({b}) - ({a}) + 180) / 360) - 180"


def turn_sql(a: str, b: str) -> str:
    """b - a in [-180, 180)."""
    return f"({TURN.format(a=a, b=b)})"


def bearing_sql(x0: str, y0: str, x1: str, y1: str) -> str:
    """Initial great-circle bearing, null where both points are one."""
    d = f"radians({turn_sql(x0, x1)})"
    angle = f"degrees(atan2(sin({d}) * cos(radians({y1})), cos(radians({y0})) * sin(radians({y1})) - sin(radians({y0})) * cos(radians({y1})) * cos({d})))"
    return f"CASE WHEN NOT ({y0} = {y1} AND {turn_sql(x0, x1)} = 0) THEN {angle} - 360 * floor({angle} / 360) END"


STEP_BEARING = bearing_sql("start_lon_center", "start_lat_center", "end_lon_center", "end_lat_center")
SECTOR = "round(sum(CASE WHEN stay THEN 0 WHEN b IS NULL THEN 0.25 WHEN abs({turn}) < 45 THEN 1.0 WHEN abs({turn}) = 45 THEN 0.5 ELSE 0.0 END * transition_probability), 9) AS {name}"
SECTORS = ", ".join(SECTOR.format(turn=turn_sql(str(m), "b"), name=n) for n, m in {"north": 0, "east": 90, "south": 180, "west": 270}.items())


@query("cardinal_probabilities", f"SELECT start_lon_bin, start_lat_bin, round(sum(CASE WHEN stay THEN transition_probability ELSE 0 END), 9) AS stay, {SECTORS} FROM (SELECT *, start_lon_bin = end_lon_bin AND start_lat_bin = end_lat_bin AS stay, {STEP_BEARING} AS b FROM ({MATRIX})) GROUP BY 1, 2")
def _(t):
    return rounded(X.cardinal_probabilities(matrix(t)), 9, "stay", "north", "east", "south", "west")


REGION_STEPS = (
    """WITH r AS (SELECT *, epoch_us(time) - min(epoch_us(time)) OVER (PARTITION BY trajectory) AS age_us, first(event_type) OVER (PARTITION BY trajectory ORDER BY obs ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS origin FROM {t}),
    e AS (SELECT origin, count(DISTINCT trajectory) AS eligible FROM r GROUP BY origin)
    SELECT origin, age_us, event_type AS target, count(*) AS n, eligible, round(count(*) / eligible, 9) AS probability FROM r JOIN e USING (origin) GROUP BY origin, age_us, event_type, eligible"""
)


@query("region_transitions", REGION_STEPS, "regular")
def _(t):
    return rounded(X.region_transitions(t, "event_type"), 9, "probability")


@query("represented_fraction", f"SELECT age_us, round(sum(n) / sum(eligible), 9) AS represented FROM (SELECT age_us, origin, sum(n) AS n, any_value(eligible) AS eligible FROM ({REGION_STEPS}) GROUP BY age_us, origin) GROUP BY age_us", "regular")
def _(t):
    return rounded(X.represented_fraction(X.region_transitions(t, "event_type")), 9, "represented")

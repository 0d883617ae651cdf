"""Queries that pass tracks through readers, writers and reshaping, and further modes of cleaning, segmenting and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.functions import geo
from trackmill.functions.grid import spacing_table
from trackmill.operators import cleaning as C
from trackmill.operators import diagnostics as D
from trackmill.operators import float_qc as Q
from trackmill.operators import maps as M
from trackmill.operators import pairs as P
from trackmill.operators import segments as S
from trackmill.operators import spatial as G
from trackmill.operators import transport as R
from trackmill.plans.catalog import BINS, GRID, INSIDE, haversine_sql, query, rounded, turn_sql
from trackmill.plans.structures import PAIRS, fsle_sql
from trackmill.shared import new_path
from trackmill.sources import tables as T

DAY_US = 86400 * 10**6
#: Tracks of one file of text fixes.
STATIONS = 64
PLAIN = "trajectory, obs, time, lon, lat, z"


# Readers, writers and reshaping


@query("csv_round_trip", "SELECT * FROM {t}")
def _(t):
    path = f"{new_path(t.sparkSession, 'tracks')}.csv"
    T.save_table(t, path, "csv")
    return T.read_trajectories(t.sparkSession, path, t.schema)


@query("parquet_by_name", f"SELECT {PLAIN} FROM {{t}}")
def _(t):
    path = f"{new_path(t.sparkSession, 'tracks')}.parquet"
    T.save_table(t.selectExpr("trajectory AS id", "obs AS n", "time AS moment", "lon AS x", "lat AS y", "z"), path)
    named = {"trajectory": "id", "obs": "n", "time": "moment", "lon": "x", "lat": "y"}
    return T.resolve_schema(T.read_trajectories(t.sparkSession, path), named)


@query("get_or_build", f"SELECT {PLAIN} FROM {{t}}")
def _(t):
    path = f"{new_path(t.sparkSession, 'product')}.parquet"
    T.save_table(t.select("trajectory", "obs"), path)
    # The stored product lacks columns, so it is built.
    return T.get_or_build(t.sparkSession, path, ["trajectory", "obs", "z"], lambda: t.select(*PLAIN.split(", ")))


@query("arrays_round_trip", "SELECT t.trajectory, obs, time, lon, lat, label FROM {t} t JOIN (SELECT trajectory, arg_min(event_type, obs) AS label FROM {t} GROUP BY trajectory) m ON m.trajectory = t.trajectory")
def _(t):
    packed = T.rows_to_arrays(t.withColumn("label", F.col("event_type")), ["time", "lon", "lat"], ["label"])
    return T.arrays_to_rows(packed)


@query("expand_members", "WITH g AS (SELECT DISTINCT group_id, obs FROM {t}) SELECT g.group_id || '_m' || k.range AS trajectory, g.obs, 3 AS group_size, CAST(k.range AS INTEGER) AS group_member, t.lon, t.lat, g.group_id AS source_trajectory FROM g CROSS JOIN range(1, 4) k LEFT JOIN {t} t ON t.group_id = g.group_id AND t.obs = g.obs AND t.group_member = k.range", "grouped")
def _(t):
    wide = [F.max(F.when(F.col("group_member") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, 6) for c in ("lon", "lat")]
    return T.expand_members(t.groupBy(F.col("group_id").alias("trajectory"), "obs").agg(*wide).withColumn("group_size", F.lit(3)))


@query("merge_files", "SELECT * REPLACE (CASE WHEN event_type = 'click' THEN z * 2 ELSE z END AS z) FROM {t}")
def _(t):
    return T.merge_files([t, t.where("event_type = 'click'").withColumn("z", F.col("z") * 2)], ["trajectory", "obs"])


FIXES = "SELECT trajectory AS platform, obs, date_trunc('day', time)::TIMESTAMP AS time, floor(lon / 10) AS lon, floor(lat / 10) AS lat, CASE WHEN event_type != 'error' THEN z END AS pressure FROM {t}"


@query("surface_fix", f"SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY platform, time, lat, lon ORDER BY pressure NULLS LAST, obs) AS r FROM ({FIXES})) WHERE r = 1")
def _(t):
    pressure = F.when(F.col("event_type") != "error", F.col("z"))
    floor = lambda c: F.floor(F.col(c) / 10).cast("double")
    return T.surface_fix(t.select(F.col("trajectory").alias("platform"), "obs", F.date_trunc("day", "time").cast("timestamp_ntz").alias("time"), floor("lon").alias("lon"), floor("lat").alias("lat"), pressure.alias("pressure")))


STAMP = "yyyy-MM-dd HH:mm:ss"


def written_csv(df: DataFrame) -> str:
    path = f"{new_path(df.sparkSession, 'observations')}.csv"
    T.save_table(df, path, "csv")
    return path


@query("read_profiles", "SELECT trajectory AS platform, date_trunc('second', time) AS time, lat, lon, CASE WHEN event_type != 'error' THEN z END AS pressure, obs::DOUBLE AS TEMP FROM {t} WHERE lat IS NOT NULL", "invalid")
def _(t):
    pressure = F.when(F.col("event_type") != "error", F.col("z"))
    path = written_csv(t.select(F.concat("trajectory", F.lit(".0")).alias("PLATFORM_CODE"), F.date_format("time", STAMP).alias("DATE"), F.col("lat").alias("LATITUDE"), F.col("lon").alias("LONGITUDE"), pressure.alias("PRES_ADJUSTED"), F.col("obs").alias("TEMP")))
    return T.read_profiles(t.sparkSession, path, ["PLATFORM_CODE", "DATE", "LATITUDE", "LONGITUDE"], ["TEMP", "PSAL"])


DRIFTERS = "SELECT trajectory::VARCHAR AS platform, date_trunc('second', time) AS time, lat, lon, CASE WHEN trajectory % 2 = 0 THEN date_trunc('second', max(CASE WHEN obs = 20 THEN time END) OVER (PARTITION BY trajectory)) END AS drogue_lost, (trajectory % 30)::DOUBLE AS drogue_length FROM {t}"


def drifters(t: DataFrame) -> DataFrame:
    lost = F.when(F.col("trajectory") % 2 == 0, F.date_format(F.max(F.when(F.col("obs") == 20, F.col("time"))).over(Window.partitionBy("trajectory")), STAMP))
    path = written_csv(t.select(F.col("trajectory").alias("ID"), F.date_format("time", STAMP).alias("time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), lost.alias("drogue_lost_date"), F.concat(F.lit("drogue of "), F.col("trajectory") % 30, F.lit(" m")).alias("DrogueLength")))
    return T.read_drifters(t.sparkSession, path)


@query("read_drifters", f"SELECT * FROM ({DRIFTERS})")
def _(t):
    return drifters(t)


@query("drogued_period", f"SELECT * FROM ({DRIFTERS}) WHERE drogue_length >= 10 AND (drogue_lost IS NULL OR time < drogue_lost)")
def _(t):
    return C.drogued_period(drifters(t), 10.0)


@query("read_text_fixes", "SELECT date_trunc('second', time) AS time, lat, lon, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS at_sea FROM {t} WHERE event_type != 'error'")
def _(t):
    flag = F.when(F.col("event_type") == "error", 0).otherwise(1)
    line = F.concat_ws("  ", "trajectory", F.date_format("time", "yyyy/MM/dd HH:mm:ss"), "lat", "lon", flag.cast("string"))
    path = new_path(t.sparkSession, "fixes")
    # A text file for each STATIONS tracks, with a header above its first line: a file each would be more work than its rows.
    station = F.floor(F.col("trajectory") / STATIONS)
    first = F.row_number().over(Window.partitionBy("station").orderBy("trajectory", "obs")) == 1
    head = F.when(first, F.lit("station\na b 2020/01/01 00:00:00 1 1 1\n*END OF HEADER\n")).otherwise(F.lit(""))
    rows = t.withColumn("station", station).withColumn("value", F.concat(head, line))
    rows.repartition("station").sortWithinPartitions("station", "trajectory", "obs").select("value", "station").write.partitionBy("station").text(path)
    return C.at_sea(T.read_text_fixes(t.sparkSession, path)).select("time", "lat", "lon", "at_sea")


@query("clip_before", "SELECT t.* FROM {t} t JOIN (SELECT trajectory, min(CASE WHEN obs >= 20 AND event_type = 'view' THEN time END) AS first FROM {t} GROUP BY trajectory) f ON f.trajectory = t.trajectory WHERE first IS NULL OR time < first")
def _(t):
    return C.clip_before(t.withColumn("surfaced", F.when((F.col("obs") >= 20) & (F.col("event_type") == "view"), F.col("time"))), "surfaced", ["trajectory"]).drop("surfaced")


@query("float_rows", "SELECT trajectory AS platform_code, cycle_number, event_id AS source_index, time, coalesce(a, z) AS depth, 'time' AS time_source, CASE WHEN a IS NOT NULL THEN 'PRES_ADJUSTED' WHEN z IS NOT NULL THEN 'PRES' END AS depth_source FROM (SELECT *, CASE WHEN position_qc IN ('1', '2') THEN z - 1 END AS a FROM {t})", "qc")
def _(t):
    raw = t.select(F.col("trajectory").alias("platform_code"), "cycle_number", F.col("event_id").alias("source_index"), "time", F.when(F.col("position_qc").isin("1", "2"), F.col("z") - 1).alias("PRES_ADJUSTED"), F.col("z").alias("PRES"))
    return T.float_rows(raw, {"time": ("JULD_ADJUSTED", "time"), "depth": ("PRES_ADJUSTED", "PRES")})


@query("finalize_trajectory", "SELECT trajectory, obs, time, lon, lat, z FROM {t}")
def _(t):
    return T.finalize_trajectory(t.withColumnRenamed("z", "depth"), "depth", ("event_id", "event_type"))


@query("with_codes", "SELECT trajectory, obs, event_type, coalesce(n, -1)::BIGINT AS code FROM {t} LEFT JOIN (SELECT event_type, count(*) AS n FROM {t} WHERE event_type != 'error' GROUP BY event_type) USING (event_type)")
def _(t):
    codes = t.where("event_type != 'error'").groupBy("event_type").agg(F.count("*").alias("code"))
    return T.with_codes(t.select("trajectory", "obs", "event_type"), codes, "event_type", "code", -1)


@query("write_by_bin", "WITH b AS (SELECT trajectory, time, lat, CASE WHEN abs(lat) < 20 THEN 0 WHEN abs(lat) < 40 THEN 1 END AS depth_bin FROM {t}) SELECT dense_rank() OVER (PARTITION BY depth_bin ORDER BY trajectory) - 1 AS trajectory, row_number() OVER (PARTITION BY depth_bin, trajectory ORDER BY time) - 1 AS obs, time, lat, depth_bin FROM b WHERE depth_bin IS NOT NULL", "regular")
def _(t):
    path = new_path(t.sparkSession, "bins")
    T.write_by_bin(t.select("trajectory", "time", "lat", S.depth_bin(F.abs("lat"), [(0.0, 20.0), (20.0, 40.0)]).alias("depth_bin")), path)
    return t.sparkSession.read.parquet(path)


@query("public_names", "SELECT trajectory, lon AS lon_start, z AS drop_km, lat AS along_per_day FROM {t}")
def _(t):
    return T.numeric_columns(T.externalize_names(t.select("trajectory", F.col("lon").alias("x_start"), F.col("z").alias("drop_length"), F.col("lat").alias("along_rate"), "event_type"), "km", "per_day"))


# Filters and cleaning


@query("max_group_member", "SELECT * FROM {t} WHERE group_member <= 2", "grouped")
def _(t):
    return C.max_group_member(t, 2)


@query("group_member", "SELECT * FROM {t} WHERE group_member = 3", "grouped")
def _(t):
    return C.group_member(t, 3)


@query("drop_invalid", "SELECT * FROM {t} WHERE lon IS NOT NULL AND lat IS NOT NULL", "invalid")
def _(t):
    return C.truncate_at_first_invalid(t, only_invalid=True)


@query("finite_fixes", "SELECT * FROM {t} WHERE lon IS NOT NULL AND lat IS NOT NULL", "invalid")
def _(t):
    return C.finite_fixes(t)


@query("dedup_times_or_fail", "SELECT * REPLACE (obs + 1000 AS obs) FROM {t}", "regular")
def _(t):
    return C.dedup_times_or_fail(t.unionByName(t.withColumn("obs", F.col("obs") + 1000)))


@query("snap_times", "SELECT * FROM {t}", "regular")
def _(t):
    late = (F.col("event_type") == "error") & (F.col("obs") == 3)
    return C.snap_times(t.withColumn("time", F.when(late, F.col("time") + F.expr("INTERVAL 10 MINUTES")).otherwise(F.col("time"))))


@query("mask_below", "SELECT trajectory, obs, CASE WHEN lat >= 10 THEN lat END AS high, CASE WHEN abs(lat) >= 10 THEN lat END AS far FROM {t}")
def _(t):
    return t.select("trajectory", "obs", C.mask_below(F.col("lat"), 10.0).alias("high"), C.mask_below(F.col("lat"), 10.0, True).alias("far"))


@query("worst_segments", f"SELECT trajectory, obs, round(km, 6) AS km FROM (SELECT *, km * 1000 / dt AS speed FROM (SELECT trajectory, obs, (epoch_us(time) - epoch_us(t0)) / 1e6 AS dt, {haversine_sql('lon0', 'lat0', 'lon', 'lat', 6371.0088)} AS km FROM (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(time) OVER w AS t0 FROM {{t}} WINDOW w AS (PARTITION BY trajectory ORDER BY obs))) WHERE dt > 0) WHERE speed > 1 OR km > 120 ORDER BY speed DESC, trajectory, obs LIMIT 20")
def _(t):
    return rounded(C.worst_segments(C.suspect_segments(t, 1.0, 120.0), 20, "trajectory", "obs").select("trajectory", "obs", "km"), 6, "km")


for _mode, _sql in {"initial_inside": "arg_min(CASE WHEN lon BETWEEN -40 AND 40 THEN 1 ELSE 0 END, obs)", "full_if_enters": "max(CASE WHEN lon BETWEEN -40 AND 40 THEN 1 ELSE 0 END)"}.items():
    query(f"select_{_mode}", f"SELECT * FROM {{t}} WHERE trajectory IN (SELECT trajectory FROM {{t}} GROUP BY trajectory HAVING {_sql} = 1)")(lambda t, mode=_mode: C.select_by_region(t, F.col("lon").between(-40, 40), mode))


@query("near_surface_cycles", "WITH c AS (SELECT trajectory, cycle_number, min(time) AS a, min(CASE WHEN event_type = 'view' THEN time END) AS b, min(CASE WHEN event_type = 'click' THEN time END) AS p, max(time) AS q FROM {t} GROUP BY ALL), h AS (SELECT *, coalesce((epoch_us(b) - epoch_us(a)) / 3600e6, 0) AS s, coalesce((epoch_us(q) - epoch_us(p)) / 3600e6, 0) AS k FROM c) SELECT trajectory, cycle_number, round(s, 6) AS surface_hours, round(k, 6) AS parking_hours, round(k / nullif(k + s, 0), 9) AS parking_ratio, s > 12 OR k < 2 OR coalesce(k / nullif(k + s, 0), 0) < 0.25 AS fails FROM h", "qc")
def _(t):
    at = lambda f, e: f(F.when(F.col("event_type") == e, F.col("time")))
    cycles = t.groupBy("trajectory", "cycle_number").agg(F.min("time").alias("surface_start"), at(F.min, "view").alias("surface_stop"), at(F.min, "click").alias("park_start"), F.max("time").alias("park_stop"))
    out = Q.near_surface_cycles(cycles, 12.0, 2.0, 0.25).select("trajectory", "cycle_number", "surface_hours", "parking_hours", "parking_ratio", "fails")
    return rounded(rounded(out, 6, "surface_hours", "parking_hours"), 9, "parking_ratio")


@query("identifier", "SELECT trajectory, obs, CASE event_type WHEN 'error' THEN 'N/A' WHEN 'view' THEN trajectory::VARCHAR ELSE event_type END AS id FROM {t}")
def _(t):
    text = F.when(F.col("event_type") == "error", F.lit(" NaN ")).when(F.col("event_type") == "view", F.concat("trajectory", F.lit(".00"))).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return t.select("trajectory", "obs", Q.identifier(text).alias("id"))


# Segments and sampling

METRICS = f"SELECT trajectory, obs, (epoch_us(time) - epoch_us(t0)) / 86400e6 AS d, CASE WHEN x0 IS NOT NULL THEN {haversine_sql('x0', 'y0', 'lon', 'lat', 6371.0088)} END AS km, abs(z - z0) AS dz FROM (SELECT *, lag(time) OVER w AS t0, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0, lag(z) OVER w AS z0 FROM {{t}} WINDOW w AS (PARTITION BY trajectory ORDER BY obs))"


@query("gap_metrics", f"SELECT trajectory, obs, round(d, 9) AS gap_days, round(km, 6) AS gap_km, round(CASE WHEN d > 0 THEN km / d END, 3) AS speed_km_day, round(CASE WHEN d > 0 THEN dz / d END, 3) AS vertical_rate FROM ({METRICS})")
def _(t):
    out = S.gap_metrics(t, z="z").select("trajectory", "obs", "gap_days", "gap_km", "speed_km_day", "vertical_rate")
    return rounded(rounded(rounded(out, 9, "gap_days"), 6, "gap_km"), 3, "speed_km_day", "vertical_rate")


@query("segment_longest", "WITH g AS (SELECT *, sum(CASE WHEN d > 1.5 * 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory ORDER BY obs)::BIGINT AS segment FROM (SELECT *, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY trajectory ORDER BY obs) AS d FROM {t})), s AS (SELECT trajectory, segment, row_number() OVER (PARTITION BY trajectory ORDER BY count(*) DESC, max(epoch_us(time)) - min(epoch_us(time)) DESC, segment) AS r FROM g GROUP BY trajectory, segment) SELECT g.* EXCLUDE d FROM g JOIN s ON s.trajectory = g.trajectory AND s.segment = g.segment AND r = 1")
def _(t):
    return S.segment_by_gap(t, 1.5, mode="longest")


@query("contiguous_median", "SELECT trajectory, obs, CASE WHEN lat IS NOT NULL THEN median(lat) OVER (PARTITION BY trajectory, run, lat IS NULL ORDER BY obs ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS lat_median FROM (SELECT *, sum(CASE WHEN lat IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory ORDER BY obs) AS run FROM {t})", "invalid")
def _(t):
    return S.contiguous_rolling_median(t, "lat", 5).select("trajectory", "obs", "lat_median")


@query("rolling_median", "SELECT trajectory, obs, median(lat) OVER (PARTITION BY trajectory ORDER BY obs ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS lat_median FROM {t}")
def _(t):
    return S.rolling(t, "lat", 4, "median").select("trajectory", "obs", "lat_median")


@query("split_by_bin", "WITH b AS (SELECT trajectory, obs, CASE WHEN lat IS NOT NULL THEN floor(abs(lat) / 10)::INTEGER END AS bin FROM {t}), r AS (SELECT *, sum(n) OVER (PARTITION BY trajectory ORDER BY obs) AS run FROM (SELECT *, CASE WHEN bin IS DISTINCT FROM lag(bin) OVER (PARTITION BY trajectory ORDER BY obs) THEN 1 ELSE 0 END AS n FROM b)), k AS (SELECT *, count(*) OVER (PARTITION BY trajectory, run) AS size FROM r WHERE bin IS NOT NULL) SELECT trajectory, obs, bin, dense_rank() OVER (PARTITION BY trajectory ORDER BY run) - 1 AS segment FROM k WHERE size >= 3", "invalid")
def _(t):
    return S.split_by_bin(t.select("trajectory", "obs", F.floor(F.abs("lat") / 10).cast("int").alias("bin")), "bin", 3)


SHARED_GRID = """WITH d AS (SELECT * EXCLUDE r FROM (SELECT *, epoch_us(time) AS t, row_number() OVER (PARTITION BY trajectory, time ORDER BY obs) AS r FROM {t}) WHERE r = 1),
    b AS (SELECT trajectory, min(t) AS t0, max(t) AS t1 FROM d GROUP BY trajectory),
    g AS (SELECT trajectory, unnest(range(o + greatest(0, CAST(ceil((t0 - o) / 21600000000.0) AS BIGINT)) * 21600000000, t1 + 1, 21600000000)) AS g FROM (SELECT *, epoch_us(TIMESTAMP '2024-01-03 01:00:00') AS o FROM b)),
    j AS (SELECT g.trajectory, g.g, a.t AS ta, a.lat AS ya, a.event_type AS label, z.t AS tz, z.lat AS yz FROM g ASOF JOIN d a ON g.trajectory = a.trajectory AND g.g >= a.t ASOF JOIN d z ON g.trajectory = z.trajectory AND g.g <= z.t)
    SELECT trajectory, row_number() OVER (PARTITION BY trajectory ORDER BY g) - 1 AS obs, make_timestamp(g) AS time, round(CASE WHEN g = ta THEN ya ELSE ya + (g - ta) / (tz - ta) * (yz - ya) END, 6) AS lat, label AS event_type FROM j"""


@query("resample_shared", SHARED_GRID)
def _(t):
    from datetime import UTC, datetime

    start = int(datetime(2024, 1, 3, 1, tzinfo=UTC).timestamp()) * 10**6
    return rounded(S.resample(t, 6 * 3600, "reference", end_point=False, reference_us=start, filled=("event_type",)).select("trajectory", "obs", "time", "lat", "event_type"), 6, "lat")


@query("shift_to_start", "SELECT trajectory, obs, make_timestamp(epoch_us(time) - min(epoch_us(time)) OVER (PARTITION BY trajectory)) AS time FROM {t}")
def _(t):
    return S.shift_to_start(t, 0).select("trajectory", "obs", "time")


@query("sample_observations", """WITH p AS (SELECT trajectory, obs, time, z AS pressure, floor(abs(lat) / 30)::INTEGER AS bin FROM {t} WHERE event_type != 'view'), s AS (SELECT trajectory, event_id, date_trunc('hour', time) AS time, z AS pressure, lon AS v, floor(abs(lat) / 30)::INTEGER AS bin FROM {t} WHERE event_type = 'view'),
    j AS (SELECT p.trajectory, p.bin, p.obs, s.v, abs(epoch_us(s.time) - epoch_us(p.time)) AS dt, abs(s.pressure - p.pressure) AS dp, row_number() OVER (PARTITION BY p.trajectory, p.obs ORDER BY abs(epoch_us(s.time) - epoch_us(p.time)), abs(s.pressure - p.pressure), s.event_id) AS r FROM p JOIN s ON s.trajectory = p.trajectory AND s.bin = p.bin)
    SELECT p.trajectory, p.bin, p.obs, j.v AS value, round(j.dt / 86400e6, 9) AS sample_days, round(j.dp, 6) AS sample_pressure FROM p LEFT JOIN j ON j.trajectory = p.trajectory AND j.obs = p.obs AND r = 1""")
def _(t):
    rows = t.withColumn("bin", F.floor(F.abs("lat") / 30).cast("int"))
    points = rows.where("event_type != 'view'").select("trajectory", "bin", "obs", "time", F.col("z").alias("pressure"))
    samples = rows.where("event_type = 'view'").select("trajectory", "bin", F.col("event_id").alias("observation_index"), F.date_trunc("hour", "time").cast("timestamp_ntz").alias("time"), F.col("z").alias("pressure"), F.col("lon").alias("value"))
    out = G.sample_observations(points, samples, "value", ["trajectory", "bin"], ["obs"])
    return rounded(rounded(out, 9, "sample_days"), 6, "sample_pressure")


# Diagnostics and maps


@query("simulation_direction", "SELECT CASE WHEN min(s) > 0 THEN 'forward' WHEN max(s) < 0 THEN 'backward' ELSE 'mixed' END AS direction, count(s) AS particles FROM (SELECT sign(epoch_us(n) - epoch_us(time)) AS s FROM (SELECT time, obs, lead(time) OVER w AS n, row_number() OVER w AS r FROM {t} WINDOW w AS (PARTITION BY trajectory ORDER BY obs)) WHERE r = 1 AND n IS NOT NULL)")
def _(t):
    return D.simulation_direction(t)


@query("time_density_zero_fill", f"WITH v AS (SELECT DISTINCT {BINS} FROM {{t}} WHERE {INSIDE}), a AS (SELECT time, count(*) AS n_active FROM {{t}} GROUP BY time), c AS (SELECT time, {BINS}, count(*) AS n FROM {{t}} WHERE {INSIDE} GROUP BY ALL) SELECT a.time, v.lon_bin, v.lat_bin, coalesce(c.n, 0) AS n, n_active, round(coalesce(c.n, 0) / n_active, 9) AS active_fraction FROM a CROSS JOIN v LEFT JOIN c ON c.time = a.time AND c.lon_bin = v.lon_bin AND c.lat_bin = v.lat_bin", "regular")
def _(t):
    return rounded(D.time_density(t, GRID, zero_fill=True).select("time", "lon_bin", "lat_bin", "n", "n_active", "active_fraction"), 9, "active_fraction")


@query("grid_spacing", "WITH v AS (SELECT DISTINCT round(lon, 6) AS v FROM {t} WHERE lon IS NOT NULL), g AS (SELECT round(v - lag(v) OVER (ORDER BY v), 6) AS gap FROM v), c AS (SELECT gap, count(*) AS n FROM g WHERE gap > 0 GROUP BY gap) SELECT coalesce(min(CASE WHEN n > 1 THEN gap END), min(gap)) AS spacing FROM c")
def _(t):
    return spacing_table(t, "lon")


EAST, NORTH = f"(radians({turn_sql('x0', 'lon')}) * cos(radians(y0)) * 6371.0)", "(radians(lat - y0) * 6371.0)"
BACK = "SELECT *, (epoch_us(time) - epoch_us(t0)) / 1e6 AS dt FROM (SELECT *, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0, lag(time) OVER w AS t0 FROM {t} WINDOW w AS (PARTITION BY trajectory ORDER BY obs))"


@query("local_steps", f"SELECT trajectory, obs, round({EAST}, 6) + 0.0 AS east, round({NORTH}, 6) + 0.0 AS north, round(radians(abs(lat - y0)) * 6371.0, 6) AS meridional, round(6371.0 * sqrt(pow(radians({turn_sql('x0', 'lon')}) * cos(radians((y0 + lat) / 2)), 2) + pow(radians(lat - y0), 2)), 6) AS planar FROM ({BACK})")
def _(t):
    w = Window.partitionBy("trajectory").orderBy("obs")
    rows = t.withColumns({"x0": F.lag("lon").over(w), "y0": F.lag("lat").over(w)})
    east, north = geo.local_xy("lon", "lat", "x0", "y0")
    out = rows.select("trajectory", "obs", east.alias("east"), north.alias("north"), geo.meridional("y0", "lat").alias("meridional"), geo.planar("x0", "y0", "lon", "lat").alias("planar"))
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("east", "north")} | {c: F.round(c, 6) for c in ("meridional", "planar")})


SPEEDS = f"SELECT {EAST} * 1000 / dt AS u, {NORTH} * 1000 / dt AS v, sqrt(pow({EAST}, 2) + pow({NORTH}, 2)) * 1000 / dt AS speed FROM ({BACK}) WHERE dt > 0"


@query("velocity_components", f"SELECT count(speed) AS steps, {', '.join(f'round({f}({c}), 5) + 0.0 AS {n}_{c}' for c in ('u', 'v', 'speed') for n, f in (('mean', 'avg'), ('std', 'stddev_pop'), ('max', 'max')))} FROM ({SPEEDS})", "regular")
def _(t):
    out = D.velocity_components(t)
    return out.withColumns({c: F.round(c, 5) + 0.0 for c in out.columns if c != "steps"})


@query("compare_velocity", f"SELECT count(speed) AS steps_a, count(CASE WHEN event_type != 'error' THEN 1 END) AS cleaned, 0::BIGINT AS same FROM (SELECT speed, event_type FROM (SELECT *, sqrt(pow({EAST}, 2) + pow({NORTH}, 2)) * 1000 / dt AS speed FROM ({BACK}) WHERE dt > 0))", "regular")
def _(t):
    both = D.compare_velocity(t, t)
    # Against itself every difference is zero.
    zero = sum((F.when(F.abs(f"diff_{c}") > 0, 1).otherwise(0) for c in ("u", "v", "speed")), F.lit(0)).cast("long")
    kept = t.where("obs > 0 and event_type != 'error'").agg(F.count("*").alias("cleaned"))
    return both.select("steps_a", zero.alias("same")).crossJoin(kept)


@query("region_map_priority", f"WITH f AS (SELECT trajectory, arg_min(struct_pack(x := lon, y := lat), obs) AS p, arg_max(event_type, obs) AS label FROM {{t}} GROUP BY trajectory), r AS (SELECT CAST(floor((p.x + 180.0) / 10.0) AS BIGINT) AS lon_bin, CAST(floor((p.y + 90.0) / 5.0) AS BIGINT) AS lat_bin, label, CASE label WHEN 'view' THEN 3 WHEN 'click' THEN 2 WHEN 'error' THEN NULL ELSE 1 END AS rank FROM f) SELECT lon_bin, lat_bin, arg_min(label, struct_pack(a := coalesce(-rank, 1000), b := label)) AS label FROM r GROUP BY 1, 2")
def _(t):
    last = t.groupBy("trajectory").agg(F.min_by("lon", "obs").alias("lon_first"), F.min_by("lat", "obs").alias("lat_first"), F.max_by("event_type", "obs").alias("label"))
    rank = F.when(F.col("label") == "view", 3).when(F.col("label") == "click", 2).when(F.col("label") != "error", 1)
    return M.region_map(last.withColumn("rank", rank), GRID, "label", priority="rank")


@query("regular_points", "WITH b AS (SELECT trajectory, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM {t} GROUP BY trajectory) SELECT trajectory::VARCHAR AS label, i.range * 2.5e0 AS lon, j.range * 2.5e0 AS lat FROM b CROSS JOIN range(-72, 73) i CROSS JOIN range(-36, 37) j WHERE i.range * 2.5 BETWEEN x0 AND x1 AND j.range * 2.5 BETWEEN y0 AND y1 AND x1 > x0 AND y1 > y0")
def _(t):
    box = t.groupBy(F.col("trajectory").cast("string").alias("label")).agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    return M.regular_points(t.sparkSession, box.where("x1 > x0 and y1 > y0").withColumn("polygon", ring), 2.5)


@query("cell_scales", f"SELECT lon_bin, lat_bin, round({haversine_sql('0', 'y', '10', 'y')}, 6) AS width_km, round({haversine_sql('0', '(y - 2.5)', '0', '(y + 2.5)')}, 6) AS height_km FROM (SELECT DISTINCT {BINS} FROM {{t}} WHERE {INSIDE}) JOIN (SELECT range AS k, -87.5e0 + range * 5 AS y FROM range(36)) ON k = lat_bin")
def _(t):
    cells = GRID.assign(t).select("lon_bin", "lat_bin").distinct()
    return rounded(cells.join(M.cell_scales(t.sparkSession, GRID), "lat_bin").select("lon_bin", "lat_bin", "width_km", "height_km"), 6, "width_km", "height_km")


EXPONENTS = f"SELECT release_time, scale, CAST(floor((lon + 180) / 0.5) AS BIGINT) AS lon_bin, CAST(floor((lat + 90) / 0.5) AS BIGINT) AS lat_bin, CASE WHEN count(*) = 1 THEN any_value(fsle) END AS fsle FROM ({fsle_sql('600.0, 1200.0')}) JOIN (SELECT group_id, arg_min(lon, obs) AS lon, arg_min(lat, obs) AS lat, min(time) AS release_time FROM {{t}} WHERE group_member = 1 GROUP BY group_id) r USING (group_id) GROUP BY ALL"


@query("exponent_grid", EXPONENTS, "grouped")
def _(t):
    return exponents(t)


@query("exponent_average", f"SELECT scale, lon_bin, lat_bin, round(avg(CASE WHEN abs(fsle) >= 0.05 THEN fsle END), 9) AS mean_fsle FROM ({EXPONENTS}) GROUP BY ALL", "grouped")
def _(t):
    # Averaged over releases, small values masked.
    masked = exponents(t).withColumn("fsle", C.mask_below(F.col("fsle"), 0.05, True))
    return masked.groupBy("scale", "lon_bin", "lat_bin").agg(F.round(F.avg("fsle"), 9).alias("mean_fsle"))


def exponents(t: DataFrame) -> DataFrame:
    from trackmill.functions.grid import RegularGrid

    first = C.group_member(t, 1).groupBy("group_id").agg(F.min_by("lon", "obs").alias("lon"), F.min_by("lat", "obs").alias("lat"), F.min("time").alias("release_time"))
    found = P.fsle_map(P.centre_pairs(t), [600.0, 1200.0]).join(first, "group_id")
    return rounded(D.exponent_grid(found, RegularGrid(-180.0, 180.0, -90.0, 90.0, 0.5, 0.5), "scale", "fsle", strict=False), 9, "fsle")


@query("pair_meridional", f"SELECT group_id, obs, member_b, round(radians(abs(lat_b - lat_a)) * 6371.0, 6) AS km FROM ({PAIRS}) WHERE member_a = 1", "grouped")
def _(t):
    return rounded(P.pair_members(t, "center_pairs", "meridional").select("group_id", "obs", "member_b", "km"), 6, "km")


@query("check_monotonic_time", "SELECT * FROM {t}", "regular")
def _(t):
    return C.check_monotonic_time(t)


@query("first_metadata", "SELECT trajectory, arg_min(event_type, obs) AS event_type, arg_min(lat, obs) FILTER (WHERE lat IS NOT NULL) AS lat, (CASE WHEN min(event_type) != max(event_type) THEN 1 ELSE 0 END + CASE WHEN min(lat) != max(lat) THEN 1 ELSE 0 END)::BIGINT AS multiple FROM {t} GROUP BY trajectory", "invalid")
def _(t):
    return C.first_metadata(t, ["event_type", "lat"], ["trajectory"])


@query("cadence_summary", "WITH d AS (SELECT (epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY trajectory ORDER BY obs)) / 1e6 AS s FROM {t}), c AS (SELECT s, count(*) AS n FROM d WHERE s IS NOT NULL GROUP BY s) SELECT (SELECT sum(n)::BIGINT FROM c) AS steps, min(s) AS min_s, max(s) AS max_s, (SELECT s FROM c ORDER BY n DESC, s LIMIT 1) AS mode_s, median(s) AS median_s FROM d")
def _(t):
    return S.cadence_summary(t)


@query("alive_longitude_by_age", "WITH g AS (SELECT lon, epoch_us(time) - min(epoch_us(time)) OVER (PARTITION BY trajectory) AS age_us FROM {t}), r AS (SELECT * FROM g WHERE age_us <= 10 * 86400000000), a AS (SELECT age_us, count(*) AS alive FROM r GROUP BY age_us), b AS (SELECT age_us, CAST(least(floor((lon + 90) / 30), 5) AS BIGINT) AS k, count(*) AS n FROM r WHERE lon BETWEEN -90 AND 90 GROUP BY 1, 2) SELECT a.age_us, x.range AS lon_bin, -90e0 + x.range * 30 AS bin_low, -60e0 + x.range * 30 AS bin_high, coalesce(b.n, 0) AS n, alive, CASE WHEN alive >= 5 THEN round(coalesce(b.n, 0) / alive, 9) END AS fraction FROM a CROSS JOIN range(6) x LEFT JOIN b ON b.age_us = a.age_us AND b.k = x.range", "regular")
def _(t):
    return rounded(D.alive_fraction(S.release_age(t), "lon", -90.0, 90.0, 30.0, 5, "age_us", 10 * DAY_US), 9, "fraction")


#: Two structures of cells: where z is high, in parts of 60 degrees of longitude, and where there are many rows, in parts of 30 of latitude.
HIGH = f"SELECT lon_bin, lat_bin, CAST(floor(lon_bin / 6) AS BIGINT) AS component FROM (SELECT {BINS}, avg(z) AS v FROM {{t}} WHERE {INSIDE} GROUP BY 1, 2) WHERE v > 500"
MANY = f"SELECT lon_bin, lat_bin, CAST(floor(lat_bin / 6) AS BIGINT) AS component FROM (SELECT {BINS}, count(*) AS n FROM {{t}} WHERE {INSIDE} GROUP BY 1, 2) WHERE n >= 10"


def structures(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    part = lambda c: F.floor(F.col(c) / 6).cast("long").alias("component")
    cells = GRID.assign(t).groupBy("lon_bin", "lat_bin").agg(F.avg("z").alias("v"), F.count("*").alias("n"))
    return cells.where("v > 500").select("lon_bin", "lat_bin", part("lon_bin")), cells.where("n >= 10").select("lon_bin", "lat_bin", part("lat_bin"))


@query("structure_comparison", f"SELECT a.component AS ca, CASE WHEN b.component IS NULL THEN 'first' WHEN a.component IS NULL THEN 'second' ELSE 'both' END AS kind, count(*) AS cells FROM ({HIGH}) a FULL JOIN ({MANY}) b ON a.lon_bin = b.lon_bin AND a.lat_bin = b.lat_bin GROUP BY 1, 2")
def _(t):
    return R.structure_comparison(*structures(t))


@query("component_overlap", f"SELECT a.component AS ca, b.component AS cb, count(*) AS cells, round(count(*) / any_value(a.n), 9) AS share_a, round(count(*) / any_value(b.n), 9) AS share_b FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM ({HIGH})) a JOIN (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM ({MANY})) b ON a.lon_bin = b.lon_bin AND a.lat_bin = b.lat_bin GROUP BY a.component, b.component")
def _(t):
    return rounded(R.component_overlap(*structures(t)), 9, "share_a", "share_b")

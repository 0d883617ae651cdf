"""Queries over pairs, regions, radius joins and transition structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmill.functions.geodesic import inverse
from trackmill.operators import branches as B
from trackmill.operators import cleaning as C
from trackmill.operators import diagnostics as D
from trackmill.operators import float_qc as Q
from trackmill.operators import maps as M
from trackmill.operators import pairs as P
from trackmill.operators import segments as S
from trackmill.operators import spatial as G
from trackmill.operators import transitions as X
from trackmill.operators import transport as R
from trackmill.operators.graph import directed_paths, ordered_segments
from trackmill.plans.catalog import BINS, GRID, INSIDE, MATRIX, QUERIES, SQL, STEP_BEARING, SUMMARY, bearing_sql, haversine_sql, matrix, query, rounded, turn_sql
from trackmill.plans.tracks import tracks

PAIRS = f"SELECT a.group_id, a.obs, a.time, a.group_member AS member_a, b.group_member AS member_b, a.lat AS lat_a, b.lat AS lat_b, {haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS km FROM {{t}} a JOIN {{t}} b ON a.group_id = b.group_id AND a.obs = b.obs AND a.time = b.time AND a.group_member < b.group_member"


@query("pair_members", f"SELECT group_id, obs, member_a, member_b, round(km, 6) AS km FROM ({PAIRS})", "grouped")
def _(t):
    return rounded(P.pair_members(t).select("group_id", "obs", "member_a", "member_b", "km"), 6, "km")


@query("pair_center", f"SELECT group_id, obs, member_b, round(km, 6) AS km, round(first, 6) AS initial_km FROM (SELECT *, first(km) OVER (PARTITION BY group_id, member_b ORDER BY obs ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM ({PAIRS}) WHERE member_a = 1) WHERE first > 0", "grouped")
def _(t):
    return rounded(P.centre_pairs(t).select("group_id", "obs", "member_b", "km", "initial_km"), 6, "km", "initial_km")


CROSSINGS = f"""WITH p AS (SELECT * FROM (SELECT *, max(CASE WHEN km > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id, member_a, member_b ORDER BY obs) AS seen FROM ({PAIRS})) WHERE seen = 1),
    s AS (SELECT p.*, k.range AS k, 500 * pow(1.5, k.range) AS low FROM p CROSS JOIN range(6) k),
    c AS (SELECT group_id, member_a, member_b, k, min(CASE WHEN km >= low AND km < low * 1.5 THEN obs END) AS oa, min(CASE WHEN km > low * 1.5 THEN obs END) AS ob FROM s GROUP BY ALL),
    x AS (SELECT c.*, (epoch_us(b.time) - epoch_us(a.time)) / 86400e6 AS dt_days, ln(b.km / a.km) AS log_ratio FROM c JOIN p a ON a.group_id = c.group_id AND a.member_a = c.member_a AND a.member_b = c.member_b AND a.obs = oa JOIN p b ON b.group_id = c.group_id AND b.member_a = c.member_a AND b.member_b = c.member_b AND b.obs = ob WHERE ob > oa)"""


@query("fsle_crossings", f"{CROSSINGS} SELECT group_id, member_a, member_b, CAST(k AS INTEGER) AS k, round(dt_days, 6) AS dt_days, round(log_ratio, 6) AS log_ratio FROM x", "grouped")
def _(t):
    return rounded(P.fsle_crossings(P.pair_members(t), 500.0, 1.5, 6), 6, "dt_days", "log_ratio")


@query("fsle_spectrum", f"{CROSSINGS} SELECT CAST(k AS INTEGER) AS k, count(*) AS pairs, round(avg(log_ratio) / avg(dt_days), 6) AS fsle, round(avg(log_ratio / dt_days), 6) AS mean_rate, round(stddev_samp(log_ratio / dt_days) / sqrt(count(*)), 6) AS rate_error FROM x GROUP BY k", "grouped")
def _(t):
    return rounded(P.fsle_spectrum(P.fsle_crossings(P.pair_members(t), 500.0, 1.5, 6)), 6, "fsle", "mean_rate", "rate_error")


CENTRED = f"SELECT *, first(km) OVER (PARTITION BY group_id, member_b ORDER BY obs ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS initial FROM ({PAIRS}) WHERE member_a = 1"
AGED = f"SELECT *, abs(epoch_us(time) - first(epoch_us(time)) OVER (PARTITION BY group_id, member_b ORDER BY obs ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 86400e6 AS age FROM ({CENTRED}) WHERE initial > 0"
GROWTH = "CASE WHEN p.k > p.i THEN ln(p.k / p.i) / p.a ELSE 0 END"


def fsle_sql(scales: str) -> str:
    return f"""WITH a AS MATERIALIZED ({AGED}), s AS (SELECT unnest([{scales}])::DOUBLE AS scale), c AS (SELECT group_id, member_b, scale, arg_min(struct_pack(a := age, k := km, i := initial), obs) AS p FROM a CROSS JOIN s WHERE age > 0 AND km >= scale GROUP BY ALL),
    b AS (SELECT group_id, scale, arg_min(p, struct_pack(a := p.a, m := member_b)) AS p FROM c GROUP BY group_id, scale)
    SELECT g.group_id, s.scale, b.p IS NOT NULL AS is_valid, CASE WHEN b.p IS NULL THEN 0.0 ELSE round({GROWTH}, 9) END AS fsle FROM (SELECT DISTINCT group_id FROM a) g CROSS JOIN s LEFT JOIN b ON b.group_id = g.group_id AND b.scale = s.scale"""


def ftle_sql(reaches: str, best: str) -> str:
    return f"""WITH a AS MATERIALIZED ({AGED}), s AS (SELECT unnest([2.0, 5.0])::DOUBLE AS horizon), c AS (SELECT group_id, member_b, horizon, arg_max(struct_pack(k := km, a := age, i := initial), {best}) AS p FROM (SELECT *, max(age) OVER (PARTITION BY group_id, member_b) AS last FROM a) CROSS JOIN s WHERE age <= horizon AND age > 0 {reaches} GROUP BY ALL),
    b AS (SELECT group_id, horizon, arg_max({GROWTH}, struct_pack(k := p.k, f := {GROWTH}, m := -member_b)) AS v FROM c GROUP BY group_id, horizon)
    SELECT g.group_id, s.horizon, round(v, 9) AS ftle, v IS NOT NULL AS is_valid FROM (SELECT DISTINCT group_id FROM a) g CROSS JOIN s LEFT JOIN b ON b.group_id = g.group_id AND b.horizon = s.horizon"""


@query("fsle_map", fsle_sql("600.0, 1200.0, 2400.0"), "grouped")
def _(t):
    return rounded(P.fsle_map(P.centre_pairs(t), [600.0, 1200.0, 2400.0]), 9, "fsle")


@query("ftle_map", ftle_sql("AND last >= horizon", "struct_pack(a := age, o := obs)"), "grouped")
def _(t):
    return rounded(P.ftle_map(P.centre_pairs(t), [2.0, 5.0]), 9, "ftle")


@query("ftle_map_largest", ftle_sql("", "struct_pack(k := km, o := -obs)"), "grouped")
def _(t):
    return rounded(P.ftle_map(P.centre_pairs(t), [2.0, 5.0], "max"), 9, "ftle")


CHORD = f"2 * 6371.0 * sin({haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat', 1.0)} / 2)"


@query("group_separation_chord", f"SELECT group_id, obs, round(avg(km), 6) AS mean_km, round(max(km), 6) AS max_km FROM (SELECT a.group_id, a.obs, {CHORD} AS km FROM {{t}} a JOIN {{t}} b ON a.group_id = b.group_id AND a.obs = b.obs AND a.time = b.time AND a.group_member < b.group_member) GROUP BY group_id, obs", "grouped")
def _(t):
    return P.pair_members(t, "all_pairs", "chord").groupBy("group_id", "obs").agg(F.round(F.avg("km"), 6).alias("mean_km"), F.round(F.max("km"), 6).alias("max_km"))


@query("compare_trajectories", f"SELECT a.trajectory, a.time, a.lon AS lon_a, a.lat AS lat_a, b.lon AS lon_b, b.lat AS lat_b, round({haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 6) AS km FROM {{t}} a JOIN (SELECT * REPLACE (lat * 0.5 AS lat) FROM {{t}}) b ON a.trajectory = b.trajectory AND a.time = b.time", "regular")
def _(t):
    return rounded(P.compare_trajectories(t, t.withColumn("lat", F.col("lat") * 0.5)), 6, "km")


#: Small squares and a triangle; one square lies over another with a higher priority.
RINGS = [("west", 1, 1, [(-180, -60), (-60, -60), (-60, 60), (-180, 60)]), ("middle", 2, 1, [(-60, -60), (60, -60), (60, 60), (-60, 60)]), ("core", 3, 5, [(-20, -20), (20, -20), (20, 20), (-20, 20)]), ("wedge", 4, 2, [(60, -40), (170, 0), (60, 40)])]
REGION = "CASE WHEN lon BETWEEN -20 AND 20 AND lat BETWEEN -20 AND 20 THEN 'core' WHEN lon BETWEEN 60 AND 170 AND abs(lat) * 110 <= (170 - lon) * 40 THEN 'wedge' WHEN lon BETWEEN -180 AND -60 AND lat BETWEEN -60 AND 60 THEN 'west' WHEN lon BETWEEN -60 AND 60 AND lat BETWEEN -60 AND 60 THEN 'middle' END"


def labelled(t: DataFrame) -> DataFrame:
    return G.classify_points(t, G.regions_from_rings(t.sparkSession, RINGS))


@query("classify_points", f"SELECT trajectory, obs, lon, lat, {REGION} AS label FROM {{t}}")
def _(t):
    return labelled(t).select("trajectory", "obs", "lon", "lat", "label")


@query("start_end_regions", f"SELECT trajectory, first(label) AS start_label, last(label) AS end_label FROM (SELECT *, {REGION} AS label FROM {{t}}) GROUP BY trajectory".replace("first(label)", "arg_min(struct_pack(l := label), obs).l").replace("last(label)", "arg_max(struct_pack(l := label), obs).l"))
def _(t):
    name = F.struct("label")
    return labelled(t).groupBy("trajectory").agg(F.min_by(name, "obs").alias("a"), F.max_by(name, "obs").alias("b")).select("trajectory", F.col("a.label").alias("start_label"), F.col("b.label").alias("end_label"))


@query("unclassified_points", f"SELECT trajectory, obs FROM {{t}} WHERE {REGION} IS NULL")
def _(t):
    return labelled(t).where("label is null").select("trajectory", "obs")


@query("region_transition_probability", f"WITH r AS (SELECT *, {REGION} AS label, epoch_us(time) - min(epoch_us(time)) OVER (PARTITION BY trajectory) AS age_us FROM {{t}}), o AS (SELECT trajectory, arg_min(struct_pack(l := label), obs).l AS origin FROM r GROUP BY trajectory), e AS (SELECT origin, count(*) AS eligible FROM o WHERE origin IS NOT NULL GROUP BY origin) SELECT origin, age_us, label AS target, count(*) AS n, eligible, round(count(*) / eligible, 9) AS probability FROM r JOIN o USING (trajectory) JOIN e USING (origin) WHERE label IS NOT NULL GROUP BY origin, age_us, label, eligible", "regular")
def _(t):
    rows = labelled(t).withColumn("label_", F.struct("label"))
    first = rows.groupBy("trajectory").agg(F.min_by("label_", "obs").alias("f")).where("f.label is not null")
    return rounded(X.region_transitions(rows.join(first.select("trajectory"), "trajectory", "left_semi").drop("label_"), "label"), 9, "probability")


@query("radius_join", f"SELECT a.trajectory, b.trajectory AS trajectory_r, a.time, round({haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 6) AS km FROM {{t}} a JOIN {{t}} b ON a.time = b.time WHERE a.trajectory < b.trajectory AND {haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 400", "regular")
def _(t):
    p = t.select("trajectory", "time", "lon", "lat")
    return rounded(G.radius_join(p, p, 400.0, ("time",)).where("trajectory < trajectory_r").select("trajectory", "trajectory_r", "time", "km"), 6, "km")


def couple_sql(where: str = "") -> str:
    middle = "degrees(atan2(sin(radians({a})) + sin(radians({b})), cos(radians({a})) + cos(radians({b}))))"
    region = REGION.replace("lon", "c.x").replace("lat", "c.y")
    return f"""WITH p AS (SELECT trajectory, time, lon, lat, z FROM {{t}} WHERE lon IS NOT NULL AND lat IS NOT NULL), c AS (SELECT a.trajectory AS id1, b.trajectory AS id2, a.time, {haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS km, round({middle.format(a='a.lon', b='b.lon')}, 9) AS x, (a.lat + b.lat) / 2 AS y FROM p a JOIN p b ON a.time = b.time AND a.trajectory < b.trajectory),
    s AS (SELECT id1, id2, arg_min(time, struct_pack(k := round(km, 6), t := time)) AS start, min(km) AS closest_km FROM c WHERE km <= 300 {where.format(region=region)} GROUP BY id1, id2),
    r AS (SELECT s.id1, s.id2, s.start, s.closest_km, a.time, a.lon AS lon1, a.lat AS lat1, a.z AS z1, b.lon AS lon2, b.lat AS lat2, b.z AS z2 FROM s JOIN p a ON a.trajectory = s.id1 AND a.time >= s.start JOIN p b ON b.trajectory = s.id2 AND b.time = a.time),
    n AS (SELECT id1, id2, count(*) AS rows FROM r GROUP BY id1, id2 HAVING count(*) >= 2 AND epoch_us(max(time)) - epoch_us(min(time)) >= 86400000000)
    SELECT r.* EXCLUDE (z1, z2) REPLACE (round(closest_km, 6) AS closest_km), n.rows, round({haversine_sql('lon1', 'lat1', 'lon2', 'lat2')}, 6) AS km, round({middle.format(a='lon1', b='lon2')}, 6) + 0.0 AS lon, (lat1 + lat2) / 2 AS lat, round((z1 + z2) / 2, 6) AS z FROM r JOIN n ON r.id1 = n.id1 AND r.id2 = n.id2"""


def coupled(t: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    return G.couple_trajectories(t, 300.0, 1.0, regions, digits=6)


@query("couple_trajectories", couple_sql(), "regular")
def _(t):
    return coupled(t)


@query("couple_trajectories_in_regions", couple_sql("AND ({region}) IS NOT NULL"), "regular")
def _(t):
    return coupled(t, G.regions_from_rings(t.sparkSession, RINGS))


@query("cluster_strength", f"WITH v AS (SELECT DISTINCT {BINS} FROM {{t}} WHERE {INSIDE}), f AS (SELECT DISTINCT time FROM {{t}}), d AS (SELECT f.time, lon_bin, lat_bin, {haversine_sql('lon', 'lat', '(-175 + lon_bin * 10)', '(-87.5 + lat_bin * 5)')} AS km FROM f JOIN {{t}} t USING (time) CROSS JOIN v), r AS (SELECT {BINS}, count(*) AS n FROM {{t}} WHERE obs = 0 GROUP BY 1, 2) SELECT time, lon_bin, lat_bin, round(sum(CASE WHEN km <= 1200 THEN exp(-pow(km / 300, 2)) ELSE 0 END), 6) AS strength, count(CASE WHEN km <= 1200 THEN 1 END) AS particles, coalesce(any_value(r.n), 0) AS release_count FROM d LEFT JOIN r USING (lon_bin, lat_bin) GROUP BY ALL", "regular")
def _(t):
    return rounded(G.cluster_strength(t, GRID, 300.0), 6, "strength")


@query("smooth_cells", f"WITH c AS (SELECT *, -175 + lon_bin * 10 AS x, -87.5 + lat_bin * 5 AS y FROM (SELECT {BINS}, avg(z) AS v FROM {{t}} WHERE {INSIDE} GROUP BY 1, 2)), d AS (SELECT a.lon_bin, a.lat_bin, b.v, b.y, {haversine_sql('a.x', 'a.y', 'b.x', 'b.y')} AS km FROM c a CROSS JOIN c b) SELECT lon_bin, lat_bin, round(sum(exp(-0.5 * pow(km / 500, 2)) * cos(radians(y)) * v) / sum(exp(-0.5 * pow(km / 500, 2)) * cos(radians(y))), 6) AS value_smooth FROM d WHERE km <= 1500 GROUP BY 1, 2")
def _(t):
    return rounded(G.smooth_cells(GRID.aggregate(t, "z"), GRID, "value", 500.0), 6, "value_smooth")


@query("nearest_in_time", "WITH s AS (SELECT * FROM {t} WHERE event_type = 'purchase') SELECT p.trajectory, p.obs, CASE WHEN b.time IS NOT NULL AND (a.time IS NULL OR p.time - b.time <= a.time - p.time) THEN b.z ELSE a.z END AS nearest_z FROM {t} p ASOF LEFT JOIN s b ON p.trajectory = b.trajectory AND p.time >= b.time ASOF LEFT JOIN s a ON p.trajectory = a.trajectory AND p.time <= a.time")
def _(t):
    return G.nearest_in_time(t, t.where("event_type = 'purchase'"), "z", ["obs"], ["trajectory"]).select("trajectory", "obs", "nearest_z")


@query("nearest_field", f"WITH f AS (SELECT time, lon, lat, z FROM {{t}} WHERE event_type = 'view'), m AS (SELECT p.trajectory, p.obs, arg_min(f.z, struct_pack(k := round(km, 6), x := f.lon, y := f.lat, z := f.z)) AS z, min(km) AS km FROM (SELECT p.trajectory, p.obs, f.z, f.lon, f.lat, {haversine_sql('p.lon', 'p.lat', 'f.lon', 'f.lat')} AS km FROM {{t}} p JOIN f ON f.time = p.time) AS f JOIN {{t}} p ON p.trajectory = f.trajectory AND p.obs = f.obs WHERE km <= 800 GROUP BY p.trajectory, p.obs) SELECT p.trajectory, p.obs, p.time, p.lon, p.lat, m.z, round(m.km, 6) AS km FROM {{t}} p LEFT JOIN m ON m.trajectory = p.trajectory AND m.obs = p.obs", "regular")
def _(t):
    return rounded(G.nearest_field(t.select("trajectory", "obs", "time", "lon", "lat"), t.where("event_type = 'view'").select("time", "lon", "lat", "z"), ["z"], 800.0, ["trajectory", "obs"]), 6, "km")


QC_RUNS = """r AS (SELECT *, sum(CASE WHEN position_qc IN ('1', '2', '3') THEN 0 ELSE 1 END) OVER (PARTITION BY trajectory ORDER BY obs) AS run FROM {t}),
    k AS (SELECT *, count(*) OVER (PARTITION BY trajectory, run) AS n FROM r WHERE position_qc IN ('1', '2', '3')),
    s AS (SELECT * EXCLUDE (run, n), dense_rank() OVER (PARTITION BY trajectory ORDER BY run) - 1 AS segment FROM k WHERE n >= 3)"""
GAPS = f"""g AS (SELECT *, greatest(obs - o0 - 1, 0) AS gap_points, (epoch_us(time) - epoch_us(t0)) / 86400e6 AS gap_days, {haversine_sql('x0', 'y0', 'lon', 'lat', 6371.0088)} AS gap_km, z0 FROM (SELECT *, lag(obs) OVER w AS o0, lag(segment) OVER w AS s0, lag(time) OVER w AS t0, lag(lon) OVER w AS x0, lag(lat) OVER w AS y0, lag(z) OVER w AS z0 FROM s WINDOW w AS (PARTITION BY trajectory ORDER BY obs)))"""
REASON = "CASE WHEN gap_points > 1 THEN 'gap_points_too_large' WHEN gap_days < 0 OR gap_days > 2 THEN 'gap_duration_too_large' WHEN gap_days > 0 IS NOT TRUE OR gap_km * 1000 / (gap_days * 86400) > 3 THEN 'bridge_speed_too_large' WHEN abs(z - z0) / gap_days > 20000 THEN 'bridge_vertical_rate_too_large' ELSE 'merged' END"
QC_BOUNDS = {"max_points": 1, "max_days": 2.0, "max_speed": 3.0, "max_vertical_rate": 20000.0, "z": "z"}


def qc_segments(t: DataFrame) -> DataFrame:
    return S.split_on_qc(t, F.col("position_qc").isin("1", "2", "3"), 3)


@query("merge_segments", f"WITH {QC_RUNS}, {GAPS} SELECT trajectory, obs, sum(CASE WHEN segment != s0 AND {REASON} != 'merged' THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory ORDER BY obs)::BIGINT AS merged FROM g", "qc")
def _(t):
    return S.merge_segments(qc_segments(t), **QC_BOUNDS).select("trajectory", "obs", "merged")


@query("merge_boundaries", f"WITH {QC_RUNS}, {GAPS} SELECT trajectory, obs, gap_points, round(gap_days, 9) AS gap_days, round(gap_km, 6) AS gap_km, {REASON} AS reason FROM g WHERE segment != s0", "qc")
def _(t):
    return rounded(rounded(S.merge_boundaries(qc_segments(t), **QC_BOUNDS).select("trajectory", "obs", "gap_points", "gap_days", "gap_km", "reason"), 9, "gap_days"), 6, "gap_km")


@query("fill_missing_bins", "WITH b AS (SELECT trajectory, obs, CASE WHEN abs(lat) < 20 THEN 0 WHEN abs(lat) < 40 THEN 1 WHEN abs(lat) < 90 THEN 2 END AS bin FROM {t}), r AS (SELECT *, sum(CASE WHEN bin IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY trajectory ORDER BY obs) AS run, last_value(bin IGNORE NULLS) OVER (PARTITION BY trajectory ORDER BY obs) AS bef, first_value(bin IGNORE NULLS) OVER (PARTITION BY trajectory ORDER BY obs ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft FROM b) SELECT trajectory, obs, CASE WHEN bin IS NULL AND sum(CASE WHEN bin IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory, run) <= 2 THEN coalesce(bef, aft) ELSE bin END AS bin FROM r", "invalid")
def _(t):
    return S.fill_missing_bins(t.withColumn("bin", S.depth_bin(F.abs("lat"), [(0.0, 20.0), (20.0, 40.0), (40.0, 90.0)])), "bin", 2).select("trajectory", "obs", "bin")


# Structures of the transition matrix


FAULTS = """SELECT count(*) AS rows, count(CASE WHEN transition_count <= 0 THEN 1 END) AS bad_count, count(CASE WHEN transition_probability < 0 OR transition_probability > 1 THEN 1 END) AS bad_probability,
    count(CASE WHEN start_lon_bin NOT BETWEEN 0 AND 35 OR start_lat_bin NOT BETWEEN 0 AND 35 OR end_lon_bin NOT BETWEEN 0 AND 35 OR end_lat_bin NOT BETWEEN 0 AND 35 THEN 1 END) AS outside,
    count(CASE WHEN abs(start_lon_center + 175 - start_lon_bin * 10) > 1e-9 OR abs(start_lat_center + 87.5 - start_lat_bin * 5) > 1e-9 OR abs(end_lon_center + 175 - end_lon_bin * 10) > 1e-9 OR abs(end_lat_center + 87.5 - end_lat_bin * 5) > 1e-9 THEN 1 END) AS bad_center,
    count(CASE WHEN k > 1 THEN 1 END) AS repeated, count(CASE WHEN abs(p - 1) > 1e-9 THEN 1 END) AS bad_sum, count(CASE WHEN coalesce(abs(transition_probability - transition_count / nullif(n, 0)) > 1e-9, TRUE) THEN 1 END) AS bad_share
    FROM (SELECT *, count(*) OVER (PARTITION BY start_lon_bin, start_lat_bin, end_lon_bin, end_lat_bin) AS k, sum(transition_probability) OVER (PARTITION BY start_lon_bin, start_lat_bin) AS p, sum(transition_count) OVER (PARTITION BY start_lon_bin, start_lat_bin) AS n FROM ({m}))"""


@query("validate_transitions", FAULTS.replace("{m}", MATRIX))
def _(t):
    return R.validate_transitions(matrix(t), GRID)


#: Faults put into a matrix by rules of its own columns: (new columns, in both languages), and rows that stand twice.
BROKEN = {
    "transition_count": "CASE WHEN transition_count = 2 THEN 0 ELSE transition_count END",
    "transition_probability": "CASE WHEN transition_probability = 1 THEN 1.5e0 ELSE transition_probability END",
    "end_lat_bin": "CASE WHEN end_lat_bin = 10 THEN 36 + end_lat_bin ELSE end_lat_bin END",
    "start_lon_center": "CASE WHEN start_lon_bin = 5 THEN start_lon_center + 1 ELSE start_lon_center END",
}
TWICE = "start_lat_bin = 15"


@query("validate_broken_transitions", FAULTS.replace("{m}", f"SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in BROKEN.items())}) FROM (SELECT * FROM ({MATRIX}) UNION ALL SELECT * FROM ({MATRIX}) WHERE {TWICE})"))
def _(t):
    rows = matrix(t)
    rows = rows.unionByName(rows.where(TWICE))
    return R.validate_transitions(rows.withColumns({k: F.expr(v) for k, v in BROKEN.items()}), GRID)


SUPPORT = f"""WITH m AS ({MATRIX}), o AS (SELECT start_lon_bin AS lon_bin, start_lat_bin AS lat_bin, sum(transition_count)::BIGINT AS n_out, sum(CASE WHEN mv THEN transition_count ELSE 0 END)::BIGINT AS n_out_move, sum(CASE WHEN mv THEN 0 ELSE transition_count END)::BIGINT AS n_stay, count(CASE WHEN mv THEN 1 END) AS destinations FROM (SELECT *, start_lon_bin != end_lon_bin OR start_lat_bin != end_lat_bin AS mv FROM m) GROUP BY 1, 2),
    i AS (SELECT end_lon_bin AS lon_bin, end_lat_bin AS lat_bin, sum(transition_count)::BIGINT AS n_in, sum(CASE WHEN mv THEN transition_count ELSE 0 END)::BIGINT AS n_in_move, count(CASE WHEN mv THEN 1 END) AS sources FROM (SELECT *, start_lon_bin != end_lon_bin OR start_lat_bin != end_lat_bin AS mv FROM m) GROUP BY 1, 2)
    SELECT lon_bin, lat_bin, coalesce(n_out, 0) AS n_out, coalesce(n_out_move, 0) AS n_out_move, coalesce(n_stay, 0) AS n_stay, coalesce(destinations, 0) AS destinations, coalesce(n_in, 0) AS n_in, coalesce(n_in_move, 0) AS n_in_move, coalesce(sources, 0) AS sources, round(n_stay / n_out, 9) AS p_stay, round(n_out_move / n_out, 9) AS p_move FROM o FULL JOIN i USING (lon_bin, lat_bin)"""


@query("support_fields", SUPPORT)
def _(t):
    return rounded(R.support_fields(matrix(t)), 9, "p_stay", "p_move")


MOVES = f"SELECT *, CASE WHEN start_lon_bin = end_lon_bin AND start_lat_bin = end_lat_bin THEN 0 ELSE transition_count END AS mv, end_lon_center - start_lon_center AS dx, end_lat_center - start_lat_center AS dy FROM ({MATRIX})"


POLAR = f"SELECT *, start_lon_bin = end_lon_bin AND start_lat_bin = end_lat_bin AS stay, {STEP_BEARING} AS b, CASE WHEN start_lon_bin = end_lon_bin AND start_lat_bin = end_lat_bin THEN 0 ELSE {haversine_sql('start_lon_center', 'start_lat_center', 'end_lon_center', 'end_lat_center')} END AS d FROM ({MATRIX})"
DISPLACED = f"SELECT *, CASE WHEN stay THEN 0 ELSE transition_count END AS mv, d * sin(radians(coalesce(b, 0))) AS dx, d * cos(radians(coalesce(b, 0))) AS dy FROM ({POLAR})"


@query(
    "outward_moments_geographic",
    f"""WITH q AS (SELECT *, sum(transition_count) OVER (PARTITION BY start_lon_bin, start_lat_bin ORDER BY d) AS c, sum(transition_count) OVER (PARTITION BY start_lon_bin, start_lat_bin) AS n FROM ({DISPLACED}) WHERE NOT stay),
    k AS (SELECT start_lon_bin, start_lat_bin, round(min(CASE WHEN c >= 0.5 * n THEN d END), 4) AS distance_q50, round(min(CASE WHEN c >= 0.9 * n THEN d END), 4) AS distance_q90 FROM q GROUP BY 1, 2),
    s AS (SELECT start_lon_bin, start_lat_bin, sum(transition_count)::BIGINT AS n_out, sum(mv)::BIGINT AS n_move, sum(transition_count * dx) / sum(transition_count) AS xa, sum(transition_count * dy) / sum(transition_count) AS ya, sum(mv * dx) / nullif(sum(mv), 0) AS xm, sum(mv * dy) / nullif(sum(mv), 0) AS ym, sum(mv * d) / nullif(sum(mv), 0) AS dm FROM ({DISPLACED}) GROUP BY 1, 2)
    SELECT start_lon_bin, start_lat_bin, n_out, n_move, round(xa, 4) + 0.0 AS dx_all, round(ya, 4) + 0.0 AS dy_all, round(xm, 4) + 0.0 AS dx_move, round(ym, 4) + 0.0 AS dy_move, round(dm, 4) AS distance_move, CASE WHEN sqrt(xm * xm + ym * ym) > 1 THEN round(degrees(atan2(xm, ym)) - 360 * floor(degrees(atan2(xm, ym)) / 360), 6) END AS bearing_move, distance_q50, distance_q90 FROM s LEFT JOIN k USING (start_lon_bin, start_lat_bin)""",
)
def _(t):
    rows = R.outward_moments(matrix(t))
    # Where moves cancel each other, the mean's direction is an error of rounding.
    rows = rows.withColumn("bearing_move", F.when(F.sqrt(F.col("dx_move") ** 2 + F.col("dy_move") ** 2) > 1, F.round("bearing_move", 6)))
    return rows.withColumns({c: F.round(c, 4) + 0.0 for c in ("dx_all", "dy_all", "dx_move", "dy_move")} | {c: F.round(c, 4) for c in ("distance_move", "distance_q50", "distance_q90")})


def harmonics_sql(keys: str, bearing: str) -> str:
    """First and second moments of moves by cell, and the entropy of their direction in 36 bins."""
    return f"""WITH h AS (SELECT {keys}, a, transition_count AS n, transition_count / sum(transition_count) OVER (PARTITION BY {keys}) AS w FROM (SELECT *, {bearing} AS a FROM ({POLAR}) WHERE NOT stay) WHERE a IS NOT NULL),
    e AS (SELECT {keys}, sum(-p * ln(p)) AS direction_entropy FROM (SELECT {keys}, floor(a / 10) AS k, sum(w) AS p FROM h GROUP BY ALL) GROUP BY {keys}),
    m AS (SELECT {keys}, sum(n)::BIGINT AS n_move, sum(w * cos(radians(a))) AS c1, sum(w * sin(radians(a))) AS s1, sum(w * cos(2 * radians(a))) AS c2, sum(w * sin(2 * radians(a))) AS s2 FROM h GROUP BY {keys})
    SELECT *, sqrt(c1 * c1 + s1 * s1) AS r1, sqrt(c2 * c2 + s2 * s2) AS r2, degrees(atan2(s1, c1)) - 360 * floor(degrees(atan2(s1, c1)) / 360) AS theta1, degrees(atan2(s2, c2)) / 2 - 180 * floor(degrees(atan2(s2, c2)) / 360) AS theta2, exp(direction_entropy) AS effective_bins FROM m JOIN e USING ({keys})"""


OUTGOING = harmonics_sql("start_lon_bin, start_lat_bin", "b")
ARRIVAL = bearing_sql("end_lon_center", "end_lat_center", "start_lon_center", "start_lat_center")
INCOMING = harmonics_sql("end_lon_bin, end_lat_bin", f"({ARRIVAL}) + 180 - 360 * floor((({ARRIVAL}) + 180) / 360)")
SHOWN = "n_move, round(r1, 6) AS r1, round(r2, 6) AS r2, CASE WHEN r1 > 1e-6 THEN round(theta1, 4) % 360 END AS theta1, CASE WHEN r2 > 1e-6 THEN round(theta2, 4) % 180 END AS theta2, round(direction_entropy, 6) AS direction_entropy, round(effective_bins, 5) AS effective_bins"


def shown(h: DataFrame) -> DataFrame:
    """Moments rounded; a direction is none where its moment is zero."""
    angles = {f"theta{k}": F.when(F.col(f"r{k}") > 1e-6, F.pmod(F.round(f"theta{k}", 4), F.lit(360.0 / k))) for k in (1, 2)}
    return rounded(rounded(h.withColumns(angles), 6, "r1", "r2", "direction_entropy"), 5, "effective_bins").select("lon_bin", "lat_bin", "n_move", "r1", "r2", "theta1", "theta2", "direction_entropy", "effective_bins")


@query("outgoing_harmonics_geographic", f"SELECT start_lon_bin AS lon_bin, start_lat_bin AS lat_bin, {SHOWN} FROM ({OUTGOING})")
def _(t):
    return shown(R.harmonics(matrix(t)))


@query("incoming_harmonics_geographic", f"SELECT end_lon_bin AS lon_bin, end_lat_bin AS lat_bin, {SHOWN} FROM ({INCOMING})")
def _(t):
    return shown(R.harmonics(matrix(t), incoming=True))


@query("outward_moments", f"SELECT start_lon_bin, start_lat_bin, sum(transition_count)::BIGINT AS n_out, sum(mv)::BIGINT AS n_move, round(sum(transition_count * dx) / sum(transition_count), 6) AS dx_all, round(sum(transition_count * dy) / sum(transition_count), 6) AS dy_all, round(sum(mv * sqrt(dx * dx + dy * dy)) / nullif(sum(mv), 0), 6) AS distance_move FROM ({MOVES}) GROUP BY 1, 2")
def _(t):
    moments = R.outward_moments(matrix(t), geometry="cartesian")
    # 0 and -0 are one number.
    zero = {c: F.round(c, 6) + 0.0 for c in ("dx_all", "dy_all", "distance_move")}
    return moments.withColumns(zero).select("start_lon_bin", "start_lat_bin", "n_out", "n_move", *zero)


@query("outgoing_harmonics", f"SELECT start_lon_bin AS lon_bin, start_lat_bin AS lat_bin, sum(mv)::BIGINT AS n_move, round(sqrt(pow(sum(mv * dx / d), 2) + pow(sum(mv * dy / d), 2)) / sum(mv), 6) AS r1 FROM (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM ({MOVES}) WHERE mv > 0) GROUP BY 1, 2")
def _(t):
    return rounded(R.harmonics(matrix(t), geometry="cartesian").select("lon_bin", "lat_bin", "n_move", "r1"), 6, "r1")


@query("incoming_harmonics", f"SELECT end_lon_bin AS lon_bin, end_lat_bin AS lat_bin, sum(mv)::BIGINT AS n_move, round(sqrt(pow(sum(mv * dx / d), 2) + pow(sum(mv * dy / d), 2)) / sum(mv), 6) AS r1 FROM (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM ({MOVES}) WHERE mv > 0) GROUP BY 1, 2")
def _(t):
    return rounded(R.harmonics(matrix(t), incoming=True, geometry="cartesian").select("lon_bin", "lat_bin", "n_move", "r1"), 6, "r1")


@query("directional_vectors", f"SELECT o.start_lon_bin AS lon_bin, o.start_lat_bin AS lat_bin, round(p, 9) AS p_move, round(coalesce(s1, 0), 9) + 0.0 AS x_move, round(coalesce(c1, 0), 9) + 0.0 AS y_move, round(p * coalesce(s1, 0), 9) + 0.0 AS x_all, round(p * coalesce(c1, 0), 9) + 0.0 AS y_all FROM (SELECT start_lon_bin, start_lat_bin, sum(CASE WHEN stay THEN 0 ELSE transition_count END) / sum(transition_count) AS p FROM ({POLAR}) GROUP BY 1, 2) o LEFT JOIN ({OUTGOING}) h ON h.start_lon_bin = o.start_lon_bin AND h.start_lat_bin = o.start_lat_bin")
def _(t):
    return R.directional_vectors(matrix(t)).withColumns({c: F.round(c, 9) + 0.0 for c in ("p_move", "x_move", "y_move", "x_all", "y_all")})


#: Cells with a direction and their neighbours of the eight that have one; the globe's last column stands beside its first.
CELLS = f"SELECT start_lon_bin AS lon_bin, start_lat_bin AS lat_bin, n_move, r1, theta1 FROM ({OUTGOING})"
AROUND = f"SELECT a.*, o.dx, o.dy, b.r1 AS n_r1, b.theta1 AS n_theta1, b.lon_bin AS n_lon_bin, b.lat_bin AS n_lat_bin FROM c a CROSS JOIN (SELECT x.range AS dx, y.range AS dy FROM range(-1, 2) x CROSS JOIN range(-1, 2) y WHERE x.range != 0 OR y.range != 0) o JOIN c b ON b.lon_bin = (a.lon_bin + o.dx + 36) % 36 AND b.lat_bin = a.lat_bin + o.dy"


@query("neighbour_consistency", f"WITH c AS ({CELLS}) SELECT lon_bin, lat_bin, count(*) AS neighbours, CASE WHEN count(*) >= 2 THEN round(avg(cos(radians(theta1 - n_theta1))), 6) + 0.0 END AS consistency FROM ({AROUND}) GROUP BY 1, 2")
def _(t):
    return R.neighbour_consistency(R.harmonics(matrix(t)), GRID).withColumn("consistency", F.round("consistency", 6) + 0.0)


@query(
    "displacement_axes",
    f"""WITH s AS (SELECT start_lon_bin, start_lat_bin, sum(mv)::BIGINT AS n, sum(mv * dx) / sum(mv) AS mx, sum(mv * dy) / sum(mv) AS my, sum(mv * dx * dx) / sum(mv) AS xx, sum(mv * dy * dy) / sum(mv) AS yy, sum(mv * dx * dy) / sum(mv) AS xy FROM ({DISPLACED}) WHERE mv > 0 GROUP BY 1, 2),
    v AS (SELECT *, greatest(xx - mx * mx, 0) AS vx, greatest(yy - my * my, 0) AS vy, xy - mx * my AS cv FROM s), g AS (SELECT *, (vx + vy) / 2 AS half, sqrt(pow((vx - vy) / 2, 2) + cv * cv) AS gap FROM v)
    SELECT start_lon_bin, start_lat_bin, n, round(sqrt(half + gap), 2) AS major, round(sqrt(greatest(half - gap, 0)), 2) AS minor, CASE WHEN half + gap > 1 THEN round(1 - sqrt(greatest(half - gap, 0)) / sqrt(half + gap), 4) END AS anisotropy, CASE WHEN gap > 1 THEN round(degrees(0.5 * atan2(2 * cv, vy - vx)) - 180 * floor(degrees(0.5 * atan2(2 * cv, vy - vx)) / 180), 3) END AS axis FROM g""",
)
def _(t):
    # Below a kilometre, axes and their direction are errors of rounding.
    e = R.displacement_ellipse(matrix(t))
    wide = F.col("major") ** 2 - F.col("minor") ** 2 > 2
    return e.select("start_lon_bin", "start_lat_bin", "n", F.round("major", 2).alias("major"), F.round("minor", 2).alias("minor"), F.when(F.col("major") > 1, F.round("anisotropy", 4)).alias("anisotropy"), F.when(wide, F.round("axis", 3)).alias("axis"))


@query("displacement_ellipse", f"SELECT start_lon_bin, start_lat_bin, sum(mv)::BIGINT AS n, round(sum(mv * dx) / sum(mv), 6) AS mx, round(sum(mv * dy) / sum(mv), 6) AS my, round(sum(mv * dx * dy) / sum(mv) - sum(mv * dx) / sum(mv) * (sum(mv * dy) / sum(mv)), 6) AS cov FROM ({MOVES}) WHERE mv > 0 GROUP BY 1, 2")
def _(t):
    zero = {c: F.round(c, 6) + 0.0 for c in ("mx", "my", "cov")}
    return R.displacement_ellipse(matrix(t), geometry="cartesian").withColumns(zero).select("start_lon_bin", "start_lat_bin", "n", *zero)


def edges_sql(turn: float, off: float) -> str:
    """Neighbours in c that point alike and lie along both directions, as edges of cell numbers either way."""
    axial = lambda a: f"least(abs({turn_sql('step', a)}), 180 - abs({turn_sql('step', a)}))"
    step = "degrees(atan2(dx * 10.0, dy * 5.0)) - 360 * floor(degrees(atan2(dx * 10.0, dy * 5.0)) / 360)"
    return f"SELECT lat_bin * 36 + lon_bin AS a, n_lat_bin * 36 + n_lon_bin AS b FROM (SELECT *, {step} AS step FROM ({AROUND})) WHERE abs({turn_sql('theta1', 'n_theta1')}) <= {turn} AND {axial('theta1')} <= {off} AND {axial('n_theta1')} <= {off}"


def components_sql(strong: str, turn: float, off: float) -> str:
    """c: the strong cells; e: their edges; p (node, component): the least cell number that each reaches."""
    return f"WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM ({CELLS}) WHERE {strong}), e AS MATERIALIZED ({edges_sql(turn, off)}), z(node, other) AS (SELECT a, a FROM e UNION SELECT z.node, e.b FROM z JOIN e ON z.other = e.a), p AS MATERIALIZED (SELECT node, min(other) AS component FROM z GROUP BY node)"


CORRIDORS = components_sql("n_move >= 3 AND r1 >= 0.2", 45, 60) + ", k AS MATERIALIZED (SELECT c.*, p.component, count(*) OVER (PARTITION BY p.component) AS cells FROM c JOIN p ON p.node = c.lat_bin * 36 + c.lon_bin QUALIFY cells >= 3)"


@query("directional_corridors", f"{CORRIDORS} SELECT lon_bin, lat_bin, n_move, round(r1, 9) AS r1, round(theta1, 6) AS theta1, component, cells FROM k")
def _(t):
    return rounded(rounded(R.directional_corridors(matrix(t), GRID, 3, 0.2), 9, "r1"), 6, "theta1")


RANKS = ", ".join(f"CAST(rank() OVER (ORDER BY {c} DESC) AS INTEGER) AS rank_{k}" for k, c in {"cells": "cells", "value": "value_mean", "median": "value_median", "lat_span": "lat_span", "lon_span": "lon_span"}.items())


@query("corridor_components", f"{CORRIDORS}, s AS (SELECT component, count(*) AS cells, max(lat_bin) - min(lat_bin) + 1 AS lat_span, round(degrees(atan2(sum(sin(radians(-175 + lon_bin * 10))), sum(cos(radians(-175 + lon_bin * 10))))), 6) AS lon_mean, round(avg(-87.5 + lat_bin * 5), 9) AS lat_mean, round(avg(r1), 9) AS value_mean, round(median(r1), 9) AS value_median FROM k GROUP BY component), l AS (SELECT component, 360 - max(gap) AS lon_span FROM (SELECT component, coalesce(lead(x) OVER (PARTITION BY component ORDER BY x), min(x) OVER (PARTITION BY component) + 360) - x AS gap FROM (SELECT DISTINCT component, (-175e0 + lon_bin * 10 + 360) % 360 AS x FROM k)) GROUP BY component) SELECT *, {RANKS} FROM s JOIN l USING (component)")
def _(t):
    cells = R.directional_corridors(matrix(t), GRID, 3, 0.2)
    return rounded(rounded(R.component_stats(cells, GRID, "r1"), 9, "lat_mean", "value_mean", "value_median"), 6, "lon_mean")


@query("corridor_classes", components_sql("n_move >= 3", 60, 60) + ", d AS (SELECT a AS node, count(*) AS degree FROM e GROUP BY a), s AS (SELECT component, count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, count(CASE WHEN degree = 1 THEN 1 END) AS ends, count(CASE WHEN degree > 2 THEN 1 END) AS junctions FROM p JOIN d USING (node) GROUP BY component) SELECT *, CASE WHEN nodes = 1 THEN 'isolated' WHEN junctions > 0 THEN 'network' WHEN ends = 2 THEN 'path' ELSE 'loop' END AS kind FROM s")
def _(t):
    strong = R.harmonics(matrix(t)).where("n_move >= 3")
    return R.component_classes(R.compatible_edges(strong, GRID, 60.0, 60.0))


SIDE = turn_sql("theta1", "degrees(atan2(dx * 10.0, dy * 5.0))")


@query("transverse_ridges", f"""WITH c AS MATERIALIZED ({CELLS}), f AS (SELECT lon_bin, lat_bin, r1, max(CASE WHEN abs(side + 90) <= 22.5 AND abs(side - 90) > 22.5 THEN n_r1 END) AS l, max(CASE WHEN abs(side - 90) <= 22.5 THEN n_r1 END) AS r FROM (SELECT *, {SIDE} AS side FROM ({AROUND})) WHERE abs(side - 90) <= 22.5 OR abs(side + 90) <= 22.5 GROUP BY ALL)
    SELECT lon_bin, lat_bin, round(r1, 9) AS r1, round(l, 9) AS "left", round(r, 9) AS "right", round(r1, 9) >= coalesce(round(l, 9), round(r, 9)) AND round(r1, 9) >= coalesce(round(r, 9), round(l, 9)) AS ridge, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 'both' ELSE 'one_side' END AS status FROM f""")
def _(t):
    # Equal shares are equal: they are rounded before they are compared.
    return R.transverse_ridges(rounded(R.harmonics(matrix(t)), 9, "r1"), GRID, "r1")


def slope_sql(a: str, b: str, km: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL OR {b} IS NOT NULL THEN (coalesce({a}, v) - coalesce({b}, v)) / ((CASE WHEN {a} IS NULL THEN 0 ELSE 1 END + CASE WHEN {b} IS NULL THEN 0 ELSE 1 END) * {km}) END"


@query(
    "sphere_gradients",
    f"""WITH c AS (SELECT {BINS}, avg(z) AS v FROM {{t}} WHERE {INSIDE} GROUP BY 1, 2), n AS (SELECT c.lon_bin, c.lat_bin, c.v, e.v AS e, w.v AS w, n.v AS n, s.v AS s FROM c LEFT JOIN c e ON e.lat_bin = c.lat_bin AND e.lon_bin = (c.lon_bin + 1) % 36 LEFT JOIN c w ON w.lat_bin = c.lat_bin AND w.lon_bin = (c.lon_bin + 35) % 36 LEFT JOIN c n ON n.lon_bin = c.lon_bin AND n.lat_bin = c.lat_bin + 1 LEFT JOIN c s ON s.lon_bin = c.lon_bin AND s.lat_bin = c.lat_bin - 1),
    g AS (SELECT *, {slope_sql('e', 'w', '(radians(10) * 6371.0 * cos(radians(-87.5 + lat_bin * 5)))')} AS gx, {slope_sql('n', 's', '(radians(5) * 6371.0)')} AS gy FROM n) SELECT lon_bin, lat_bin, round(v, 9) AS v, round(gx, 9) + 0.0 AS gx, round(gy, 9) + 0.0 AS gy, round(sqrt(gx * gx + gy * gy), 9) AS magnitude FROM g""",
)
def _(t):
    return R.sphere_gradients(GRID.aggregate(t, "z"), GRID, "value").withColumns({c: F.round(c, 9) + 0.0 for c in ("v", "gx", "gy", "magnitude")})


@query("two_hop_cells", f"WITH e AS (SELECT DISTINCT start_lat_bin * 36 + start_lon_bin AS a, end_lat_bin * 36 + end_lon_bin AS b FROM ({MATRIX})), s AS (SELECT a, b FROM e WHERE a != b UNION SELECT b, a FROM e WHERE a != b), h AS (SELECT DISTINCT x.a, y.b FROM s x JOIN s y ON x.b = y.a WHERE x.a != y.b) SELECT a, b, 1 AS hops FROM s UNION ALL SELECT a, b, 2 AS hops FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.a = h.a AND s.b = h.b)")
def _(t):
    m = matrix(t)
    return R.n_hop(m.select(R.cell_id(GRID, "start_lon_bin", "start_lat_bin").alias("src"), R.cell_id(GRID, "end_lon_bin", "end_lat_bin").alias("dst")), 2)


# Modes, permeability, floats


@query("transport_modes", None)
def _(t):
    return rounded(B.detect_modes(matrix(t), 2), 9, "share", "bearing", "mean_km")


@query("mode_continuation", None)
def _(t):
    return rounded(B.mode_continuation(B.detect_modes(matrix(t), 2), matrix(t)), 9, "turn", "score")


@query("selected_mode_edges", None)
def _(t):
    return rounded(B.select_edges(B.mode_continuation(B.detect_modes(matrix(t), 2), matrix(t)), ["start_lon_bin", "start_lat_bin", "mode"]), 9, "turn", "score")


def branch_points(t: DataFrame) -> DataFrame:
    cells = R.directional_corridors(matrix(t), GRID, 3, 0.2)
    return cells.select(F.col("component").alias("branch"), R.cell_id(GRID).alias("point"), GRID.lon_center(F.col("lon_bin")).alias("lon"), GRID.lat_center(F.col("lat_bin")).alias("lat"), F.col("theta1").alias("bearing"))


POINTS = "o AS (SELECT component AS branch, lat_bin * 36 + lon_bin AS point, -175e0 + lon_bin * 10 AS x, -87.5e0 + lat_bin * 5 AS y, radians(theta1) AS a FROM k)"


def crossing_sql(offsets: str) -> str:
    """Profile f: moves near each branch point and those that cross its line, at offsets."""
    side = lambda e, n: f"round(({e}) * cos(a) - ({n}) * sin(a), 6)"
    return f"""{CORRIDORS}, {POINTS}, m AS MATERIALIZED (SELECT start_lon_center AS u, start_lat_center AS v, dx, dy, transition_count AS n FROM ({DISPLACED})),
    j AS (SELECT branch, point, n, dx, dy, a, radians(u - x) * cos(radians(y)) * 6371.0 AS e, radians(v - y) * 6371.0 AS f FROM o JOIN m ON {haversine_sql('x', 'y', 'u', 'v')} <= 1500),
    d AS (SELECT branch, point, off AS "offset", n, {side('e', 'f')} - off AS d0, {side('e + dx', 'f + dy')} - off AS d1 FROM j CROSS JOIN (SELECT unnest([{offsets}])::DOUBLE AS off)),
    s AS (SELECT branch, point, "offset", sum(n)::BIGINT AS n, sum(CASE WHEN d0 < 0 AND d1 >= 0 THEN n ELSE 0 END)::BIGINT AS to_right, sum(CASE WHEN d0 >= 0 AND d1 < 0 THEN n ELSE 0 END)::BIGINT AS to_left FROM d GROUP BY ALL),
    f AS (SELECT *, (to_right + to_left) / n AS p_cross, n >= 5 AS supported FROM s)"""


Z = "1.959963984540054"
WILSON = f"((p_cross + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) {{s}} {Z} * sqrt(p_cross * (1 - p_cross) / n + {Z} * {Z} / (4 * n * n)) / (1 + {Z} * {Z} / n))"
LOWS = "g AS (SELECT *, lag(p_cross) OVER w AS a, lead(p_cross) OVER w AS b FROM f WHERE supported WINDOW w AS (PARTITION BY branch, point ORDER BY \"offset\")), h AS (SELECT branch, point, arg_min(struct_pack(o := \"offset\", p := p_cross), struct_pack(p := p_cross, a := abs(\"offset\"), o := \"offset\")) AS m FROM g WHERE p_cross < a AND p_cross < b GROUP BY branch, point)"
FIVE = "-600.0, -300.0, 0.0, 300.0, 600.0"


@query("permeability", f"{crossing_sql('-300.0, 0.0, 300.0')} SELECT branch, point, \"offset\", n, to_right, to_left, round(p_cross, 9) AS p_cross, round(greatest(0.0, {WILSON.replace('{s}', '-')}), 9) AS low, round(least(1.0, {WILSON.replace('{s}', '+')}), 9) AS high, round((to_right - to_left) / nullif(to_right + to_left, 0), 9) AS asymmetry, supported FROM f")
def _(t):
    return rounded(B.permeability(branch_points(t), matrix(t), 1500.0, [-300.0, 0.0, 300.0]), 9, "p_cross", "low", "high", "asymmetry")


@query("barrier_minima", f"{crossing_sql(FIVE)}, {LOWS} SELECT branch, point, m.o AS \"offset\", round(m.p, 9) AS p_cross FROM h")
def _(t):
    return rounded(B.barrier_minima(B.permeability(branch_points(t), matrix(t), 1500.0, [-600.0, -300.0, 0.0, 300.0, 600.0])), 9, "p_cross")


@query("turn_fields", f"WITH o AS ({OUTGOING}), i AS ({INCOMING}) SELECT o.start_lon_bin AS lon_bin, o.start_lat_bin AS lat_bin, o.n_move AS n_out_move, i.n_move AS n_in_move, round(o.r1, 6) AS r1_out, round(i.r1, 6) AS r1_in, CASE WHEN o.r1 > 1e-6 AND i.r1 > 1e-6 THEN round(cos(radians(o.theta1 - i.theta1)), 6) + 0.0 END AS alignment, round(o.n_move * o.r1, 6) AS coherent_out FROM o JOIN i ON i.end_lon_bin = o.start_lon_bin AND i.end_lat_bin = o.start_lat_bin")
def _(t):
    rows = R.turn_fields(matrix(t))
    # Where moves cancel each other there is no direction to turn from.
    known = (F.col("r1_out") > 1e-6) & (F.col("r1_in") > 1e-6)
    return rounded(rows.withColumn("alignment", F.when(known, F.round("alignment", 6) + 0.0)), 6, "r1_out", "r1_in", "coherent_out").select("lon_bin", "lat_bin", "n_out_move", "n_in_move", "r1_out", "r1_in", "alignment", "coherent_out")


@query("seed_family", "SELECT trajectory, obs, lon, lat, trajectory IN (SELECT trajectory FROM {t} WHERE (lon >= 150 OR lon <= -150) AND lat BETWEEN -20 AND 20) AS seed_family FROM {t}")
def _(t):
    return R.seed_family(t.select("trajectory", "obs", "lon", "lat"), 150.0, -150.0, -20.0, 20.0, "trajectory")


@query("spherical_centre", "SELECT trajectory, round(degrees(atan2(b, a)), 6) AS centre_lon, round(degrees(atan2(c, sqrt(a * a + b * b))), 6) AS centre_lat FROM (SELECT trajectory, avg(cos(radians(lat)) * cos(radians(lon))) AS a, avg(cos(radians(lat)) * sin(radians(lon))) AS b, avg(sin(radians(lat))) AS c FROM {t} GROUP BY trajectory)")
def _(t):
    return rounded(R.spherical_centre(t, ["trajectory"]), 6, "centre_lon", "centre_lat")


#: Ellipsoidal scales of the grid's rows, as the SQL's input.
ROWS = ", ".join(f"({j}, {float(inverse(0.0, -87.5 + 5 * j, 10.0, -87.5 + 5 * j)[0])}, {float(inverse(0.0, -87.5 + 5 * j, 0.0, -82.5 + 5 * j)[0]) if j < 35 else 0.0})" for j in range(36))


@query(
    "ellipsoid_gradients",
    f"""WITH c AS (SELECT {BINS}, avg(z) AS v FROM {{t}} WHERE {INSIDE} GROUP BY 1, 2), k AS (SELECT * FROM (VALUES {ROWS}) AS k(j, x, y)), n AS (SELECT c.lon_bin, c.lat_bin, c.v, e.v AS e, w.v AS w, n.v AS n, s.v AS s, k.x, k.y AS up, b.y AS down FROM c JOIN k ON k.j = c.lat_bin LEFT JOIN k b ON b.j = c.lat_bin - 1 LEFT JOIN c e ON e.lat_bin = c.lat_bin AND e.lon_bin = (c.lon_bin + 1) % 36 LEFT JOIN c w ON w.lat_bin = c.lat_bin AND w.lon_bin = (c.lon_bin + 35) % 36 LEFT JOIN c n ON n.lon_bin = c.lon_bin AND n.lat_bin = c.lat_bin + 1 LEFT JOIN c s ON s.lon_bin = c.lon_bin AND s.lat_bin = c.lat_bin - 1),
    g AS (SELECT *, {slope_sql('e', 'w', 'x')} AS gx, CASE WHEN n IS NOT NULL OR s IS NOT NULL THEN (coalesce(n, v) - coalesce(s, v)) / (CASE WHEN n IS NULL THEN 0 ELSE up END + CASE WHEN s IS NULL THEN 0 ELSE down END) END AS gy FROM n) SELECT lon_bin, lat_bin, round(v, 9) AS v, round(gx, 9) + 0.0 AS gx, round(gy, 9) + 0.0 AS gy, round(sqrt(gx * gx + gy * gy), 9) AS magnitude FROM g""",
)
def _(t):
    return R.sphere_gradients(GRID.aggregate(t, "z"), GRID, "value", ellipsoid=True).withColumns({c: F.round(c, 9) + 0.0 for c in ("v", "gx", "gy", "magnitude")})


@query("ellipsoid_smooth", None)
def _(t):
    return rounded(G.smooth_cells(GRID.aggregate(t, "z"), GRID, "value", 500.0, ellipsoid=True), 6, "value_smooth")


@query("ordered_segments", None)
def _(t):
    strong = R.harmonics(matrix(t)).where("n_move >= 3")
    return ordered_segments(R.compatible_edges(strong, GRID, 60.0, 60.0))


@query("directed_paths", None)
def _(t):
    m = matrix(t).where("transition_probability >= 0.5 and not (start_lon_bin = end_lon_bin and start_lat_bin = end_lat_bin)")
    return directed_paths(m.select(R.cell_id(GRID, "start_lon_bin", "start_lat_bin").alias("src"), R.cell_id(GRID, "end_lon_bin", "end_lat_bin").alias("dst")))


@query("nearest_on_lines", None)
def _(t):
    # Lines through each track's views, and its errors as points.
    lines = t.where("event_type = 'view'").select(F.col("trajectory").cast("string").alias("line"), F.col("obs").alias("place"), "lon", "lat")
    points = t.where("event_type = 'error'").select("trajectory", "obs", "lon", "lat")
    return rounded(G.nearest_on_lines(points, lines, 300.0, ["trajectory", "obs"]), 6, "line_lon", "line_lat", "km")


@query("path_geometry", f"SELECT trajectory, obs, round(step, 6) AS step_km, round(coalesce(sum(step) OVER (PARTITION BY trajectory ORDER BY obs), 0), 6) AS s_km, round(CASE WHEN abs({turn_sql('c0', 'c1')}) < 179.999999 THEN {turn_sql('c0', 'c1')} END, 6) + 0.0 AS turn FROM (SELECT trajectory, obs, CASE WHEN obs > 0 THEN {haversine_sql('lon0', 'lat0', 'lon', 'lat')} END AS step, {bearing_sql('lon0', 'lat0', 'lon', 'lat')} AS c0, {bearing_sql('lon', 'lat', 'lon1', 'lat1')} AS c1 FROM (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1 FROM {{t}} WINDOW w AS (PARTITION BY trajectory ORDER BY obs)))")
def _(t):
    rows = rounded(B.path_geometry(t, ("trajectory",), "obs"), 6, "step_km", "s_km")
    # A full turn is one to the left or to the right by an error of rounding.
    turn = F.when(F.abs("turn") < 179.999999, F.round("turn", 6) + 0.0)
    return rows.select("trajectory", "obs", "step_km", "s_km", turn.alias("turn"))


@query("park_window_depth", "SELECT trajectory AS platform_code, cycle_number, round(quantile_cont(z, 0.5), 6) AS depth, count(*) AS n FROM {t} GROUP BY ALL", "qc")
def _(t):
    m = t.select(F.col("trajectory").alias("platform_code"), "cycle_number", "time", F.col("z").alias("pressure"))
    windows = m.groupBy("platform_code", "cycle_number").agg(F.min("time").alias("start"), F.max("time").alias("stop"))
    return rounded(Q.park_window_depth(m, windows), 6, "depth")


@query(
    "resolve_parking_depth",
    """WITH c AS (SELECT trajectory AS platform_code, cycle_number, max(CASE WHEN event_id % 4 = 0 THEN z END) AS a, max(CASE WHEN event_id % 4 = 1 THEN z END) AS b FROM {t} GROUP BY ALL),
    o AS (SELECT *, coalesce(a, b) AS own, CASE WHEN a IS NOT NULL THEN 'representative' WHEN b IS NOT NULL THEN 'inferred_adjusted' END AS src FROM c),
    f AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY platform_code ORDER BY cycle_number) AS bef, first_value(own IGNORE NULLS) OVER (PARTITION BY platform_code ORDER BY cycle_number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS aft FROM o)
    SELECT platform_code, cycle_number, coalesce(own, bef, aft, 1000.0) AS parking_depth, coalesce(src, CASE WHEN bef IS NOT NULL THEN 'forward_fill' WHEN aft IS NOT NULL THEN 'backward_fill' ELSE 'fallback' END) AS depth_source FROM f""",
    "qc",
)
def _(t):
    value = lambda k: F.max(F.when(F.col("event_id") % 4 == k, F.col("z")))
    cycles = t.groupBy(F.col("trajectory").alias("platform_code"), "cycle_number").agg(value(0).alias("representative"), value(1).alias("inferred_adjusted")).withColumn("inferred_raw", F.lit(None).cast("double"))
    return Q.resolve_parking_depth(cycles, 1000.0).select("platform_code", "cycle_number", "parking_depth", "depth_source")


@query("jump_qc", None, "qc")
def _(t):
    return Q.jump_qc(S.segment_by_gap(t, 4.0).select("trajectory", "segment", "obs", "time", "lon", "lat"), 900.0)


@query("repair_isolated_bins", None)
def _(t):
    return Q.repair_isolated_bins(t.select("trajectory", "obs", F.when(F.col("lat") >= 0, "north").otherwise("south").alias("bin")), "bin", 1)


@query("stage_counts", "SELECT 'raw' AS stage, count(*) AS rows, count(DISTINCT trajectory) AS particles FROM {t} UNION ALL SELECT 'valid', count(*), count(DISTINCT trajectory) FROM {t} WHERE lon IS NOT NULL", "invalid")
def _(t):
    return Q.stage_counts({"raw": t, "valid": t.where("lon is not null")})


@query("drop_duplicate_release", "SELECT trajectory, row_number() OVER (PARTITION BY trajectory ORDER BY obs) - 1 AS obs, time FROM (SELECT trajectory, obs, CASE WHEN obs = 1 AND trajectory % 2 = 0 THEN t0 ELSE time END AS time FROM (SELECT *, lag(time) OVER (PARTITION BY trajectory ORDER BY obs) AS t0 FROM {t})) WHERE NOT (obs = 1 AND trajectory % 2 = 0)", "regular")
def _(t):
    from pyspark.sql import Window

    first = F.lag("time").over(Window.partitionBy("trajectory").orderBy("obs"))
    doubled = t.withColumn("time", F.when((F.col("obs") == 1) & (F.col("trajectory") % 2 == 0), first).otherwise(F.col("time")))
    return C.drop_duplicate_release(doubled).select("trajectory", "obs", "time")


# Maps and frames


@query("region_map", f"WITH f AS (SELECT trajectory, arg_min(struct_pack(x := lon, y := lat), obs) AS p, arg_max(struct_pack(l := event_type), obs).l AS label FROM {{t}} GROUP BY trajectory), c AS (SELECT CAST(floor((p.x + 180.0) / 10.0) AS BIGINT) AS lon_bin, CAST(floor((p.y + 90.0) / 5.0) AS BIGINT) AS lat_bin, label, count(*) AS n FROM f GROUP BY ALL) SELECT lon_bin, lat_bin, arg_min(label, struct_pack(a := -n, b := label)) AS label, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2")
def _(t):
    last = t.groupBy("trajectory").agg(F.min_by("lon", "obs").alias("lon_first"), F.min_by("lat", "obs").alias("lat_first"), F.max_by("event_type", "obs").alias("label"))
    return M.region_map(last, GRID, "label")


@query("connectivity_segments", "SELECT trajectory, 0 AS place, arg_min(lon, obs) AS lon, arg_min(lat, obs) AS lat FROM {t} GROUP BY trajectory UNION ALL SELECT trajectory, 1, arg_max(lon, obs), arg_max(lat, obs) FROM {t} GROUP BY trajectory")
def _(t):
    return M.connectivity_segments(D.particle_summary(t))


@query("snapshots", "SELECT time, trajectory, obs, lon, lat, CAST(frame AS INTEGER) AS frame FROM (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS frame FROM {t}) WHERE frame IN (0, 4, (SELECT count(DISTINCT time) - 1 FROM {t}))", "regular")
def _(t):
    return M.snapshots(t, [0, 4, -1]).select("time", "trajectory", "obs", "lon", "lat", "frame")


@query("nearest_frame", "SELECT trajectory, obs, lon, lat FROM {t} WHERE time = TIMESTAMP '2024-01-03 12:00:00'", "regular")
def _(t):
    return M.nearest_frame(t, F.lit("2024-01-03 13:00:00"), 4 * 3600 * 10**6).select("trajectory", "obs", "lon", "lat")


@query(
    "bilinear_sample",
    f"""WITH c AS (SELECT {BINS}, avg(z) AS v FROM {{t}} WHERE {INSIDE} GROUP BY 1, 2), p AS (SELECT trajectory, obs, (lon + 180) / 10 - 0.5 AS x, (lat + 90) / 5 - 0.5 AS y FROM {{t}}),
    k AS (SELECT trajectory, obs, CAST(floor(x) AS BIGINT) + a.range AS i, CAST(floor(y) AS BIGINT) + b.range AS j, (CASE WHEN a.range = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN b.range = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM p CROSS JOIN range(2) a CROSS JOIN range(2) b),
    g AS (SELECT trajectory, obs, sum(w * c.v) AS s, count(*) AS n, count(c.v) AS known, max(CASE WHEN j < 0 OR j > 35 THEN 1 ELSE 0 END) AS outside FROM k LEFT JOIN c ON c.lon_bin = (i + 36) % 36 AND c.lat_bin = j WHERE w > 0 GROUP BY ALL)
    SELECT trajectory, obs, CASE WHEN outside = 0 AND known = n THEN round(s, 10) END AS value, CASE WHEN outside = 1 THEN 'domain_boundary' WHEN known < n THEN 'missing_support' ELSE 'ok' END AS status FROM g""",
)
def _(t):
    return rounded(M.bilinear_sample(t, GRID.aggregate(t, "z"), GRID, "value", ["trajectory", "obs"]), 10, "value")


@query("nearest_other_branch", f"{CORRIDORS}, {POINTS}, d AS (SELECT a.branch, a.point, b.branch AS other, b.point AS place, {haversine_sql('a.x', 'a.y', 'b.x', 'b.y')} AS km FROM o a JOIN o b ON a.branch != b.branch OR a.point != b.point), n AS (SELECT branch, point, min(CASE WHEN other != branch THEN km END) AS other_km, min(CASE WHEN other = branch AND abs(point - place) > 3 THEN km END) AS self_km FROM d WHERE km <= 3000 GROUP BY branch, point) SELECT o.branch, o.point, o.x AS lon, o.y AS lat, round(other_km, 6) AS other_km, round(self_km, 6) AS self_km FROM o LEFT JOIN n ON n.branch = o.branch AND n.point = o.point")
def _(t):
    return rounded(M.nearest_other_branch(branch_points(t), 3000.0), 6, "other_km", "self_km")


@query(
    "barrier_summary",
    f"""{crossing_sql(FIVE)}, {LOWS}, b AS (SELECT o.branch, o.point, h.m.p AS p FROM o LEFT JOIN h ON h.branch = o.branch AND h.point = o.point), r AS (SELECT *, sum(CASE WHEN p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY branch ORDER BY point) AS run FROM b),
    l AS (SELECT branch, max(gap)::BIGINT AS longest_gap FROM (SELECT branch, run, sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS gap FROM r GROUP BY ALL) GROUP BY branch)
    SELECT branch, count(*) AS points, count(p) AS barrier_points, round(avg(p), 9) AS mean, round(min(p), 9) AS least, round(max(p), 9) AS most, any_value(longest_gap) AS longest_gap, round(count(p) / count(*), 9) AS coverage FROM b JOIN l USING (branch) GROUP BY branch""",
)
def _(t):
    points = branch_points(t)
    return rounded(M.barrier_summary(B.barrier_minima(B.permeability(points, matrix(t), 1500.0, [-600.0, -300.0, 0.0, 300.0, 600.0])), points), 9, "mean", "least", "most", "coverage")


@query("level_comparison", f"WITH c AS (SELECT avg(z) AS a, count(*)::DOUBLE AS b FROM (SELECT *, {BINS} FROM {{t}} WHERE {INSIDE}) GROUP BY lon_bin, lat_bin), q AS (SELECT x.q AS quantile, quantile_cont(a, 0.5) AS a5, quantile_cont(b, 0.5) AS b5, quantile_cont(a, 0.9) AS a9, quantile_cont(b, 0.9) AS b9 FROM c CROSS JOIN (SELECT unnest([0.5, 0.9])::DOUBLE AS q) x GROUP BY x.q), l AS (SELECT quantile, CASE WHEN quantile = 0.5 THEN a5 ELSE a9 END AS qa, CASE WHEN quantile = 0.5 THEN b5 ELSE b9 END AS qb FROM q) SELECT quantile, round(qa, 6) AS threshold_a, round(qb, 6) AS threshold_b, count(CASE WHEN a >= qa AND b >= qb THEN 1 END) AS in_both, count(CASE WHEN a >= qa AND b < qb THEN 1 END) AS only_a, count(CASE WHEN a < qa AND b >= qb THEN 1 END) AS only_b, round(count(CASE WHEN a >= qa AND b >= qb THEN 1 END) / count(CASE WHEN a >= qa OR b >= qb THEN 1 END), 9) AS jaccard FROM c CROSS JOIN l GROUP BY quantile, qa, qb")
def _(t):
    cells = GRID.assign(t).groupBy("lon_bin", "lat_bin").agg(F.avg("z").alias("a"), F.count("*").cast("double").alias("b"))
    return rounded(rounded(M.level_comparison(cells, "a", "b", [0.5, 0.9]), 6, "threshold_a", "threshold_b"), 9, "jaccard")


@query("minimal_lon_span", "WITH d AS (SELECT DISTINCT trajectory, lon - 360 * floor(lon / 360) AS x FROM {t}), g AS (SELECT trajectory, coalesce(lead(x) OVER (PARTITION BY trajectory ORDER BY x), min(x) OVER (PARTITION BY trajectory) + 360) - x AS gap FROM d) SELECT trajectory, 360 - max(gap) AS lon_span FROM g GROUP BY trajectory")
def _(t):
    return M.minimal_lon_span(t, ["trajectory"])


@query("average_over_time", f"SELECT lon_bin, lat_bin, round(avg(n), 9) AS mean_n FROM (SELECT time, {BINS}, count(*) AS n FROM {{t}} WHERE {INSIDE} GROUP BY ALL) GROUP BY 1, 2", "regular")
def _(t):
    return D.time_density(t, GRID).groupBy("lon_bin", "lat_bin").agg(F.round(F.avg("n"), 9).alias("mean_n"))


#: Kept by name for callers of this module.
__all__ = ["QUERIES", "SQL", "SUMMARY", "labelled", "tracks"]

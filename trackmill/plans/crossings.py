"""Queries across transport structures: sections, composites, drops, barriers and their tracks, lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.operators import barriers as B
from trackmill.operators import fronts as T
from trackmill.operators import lines as L
from trackmill.operators import maps as M
from trackmill.operators import nearest as N
from trackmill.operators import network as W
from trackmill.operators import repair as Q
from trackmill.operators import sections as X
from trackmill.operators import transport as R
from trackmill.operators.branches import mode_members, permeability
from trackmill.plans.catalog import GRID, bearing_sql, haversine_sql, matrix, query, rounded
from trackmill.plans.structures import OUTGOING, POINTS, POLAR, WILSON, components_sql, crossing_sql, slope_sql
from trackmill.shared import materialize

#: Sides of cores that count as unobservable, by a rule of their cells that both languages say alike.
UNSEEN = "CASE WHEN point % 11 = 0 THEN 'left_and_right' WHEN point % 7 = 0 THEN 'left' WHEN point % 7 = 1 THEN 'right' ELSE 'none' END"


#: Corridors of cells with any move in a common direction.
CORRIDORS = components_sql("n_move >= 1 AND r1 >= 0.05", 75, 75) + ", k AS MATERIALIZED (SELECT c.*, p.component, count(*) OVER (PARTITION BY p.component) AS cells FROM c JOIN p ON p.node = c.lat_bin * 36 + c.lon_bin QUALIFY cells >= 3)"


def corridors(m: DataFrame) -> DataFrame:
    return R.directional_corridors(m, GRID, 1, 0.05, 75.0, 75.0)


def written(t: DataFrame) -> DataFrame:
    """The transition matrix, computed once for all that a query takes from it."""
    return materialize(matrix(t), "matrix")


def cores(m: DataFrame) -> DataFrame:
    """Cells of corridors as cores of sections: branch, point (the cell), sequence in the branch, position, bearing, scale, missing side."""
    cells = corridors(m)
    scale = M.cell_scales(m.sparkSession, GRID).select("lat_bin", F.sqrt(F.col("width_km") * F.col("height_km")).alias("scale_km"))
    rows = cells.join(scale, "lat_bin").select(F.col("component").alias("branch"), R.cell_id(GRID).alias("point"), GRID.lon_center(F.col("lon_bin")).alias("lon"), GRID.lat_center(F.col("lat_bin")).alias("lat"), F.col("theta1").alias("bearing"), "scale_km")
    order = F.row_number().over(Window.partitionBy("branch").orderBy("point")) - 1
    return materialize(rows.withColumns({"sequence": order.cast("long"), "missing_side": F.expr(UNSEEN)}), "cores")


def sections(m: DataFrame, c: DataFrame) -> DataFrame:
    return X.cross_sections(c, R.directional_vectors(m), GRID, ellipsoid=False)


SECTIONS = f"""{CORRIDORS}, {POINTS},
    vf AS MATERIALIZED (SELECT f.start_lon_bin AS lon_bin, f.start_lat_bin AS lat_bin, pm * coalesce(s1, 0) AS x_all, pm * coalesce(c1, 0) AS y_all FROM (SELECT start_lon_bin, start_lat_bin, sum(CASE WHEN stay THEN 0 ELSE transition_count END) / sum(transition_count) AS pm FROM ({POLAR}) GROUP BY 1, 2) f LEFT JOIN ({OUTGOING}) h ON h.start_lon_bin = f.start_lon_bin AND h.start_lat_bin = f.start_lat_bin),
    co AS MATERIALIZED (SELECT branch, point, x, y, a, sqrt({haversine_sql('0', 'y', '10', 'y')} * {haversine_sql('0', '(y - 2.5)', '0', '(y + 2.5)')}) AS sc, row_number() OVER (PARTITION BY branch ORDER BY point) - 1 AS seq, {UNSEEN} AS ms FROM o),
    tp AS (SELECT co.*, i, CASE WHEN i < 0 THEN a - pi() / 2 ELSE a + pi() / 2 END AS b, abs(i) * 0.5 * sc / 6371.0 AS d FROM co CROSS JOIN (SELECT unnest(generate_series(-6, 6)) AS i)),
    tl AS (SELECT *, asin(greatest(-1.0, least(1.0, sin(radians(y)) * cos(d) + cos(radians(y)) * sin(d) * cos(b)))) AS up FROM tp),
    tm AS (SELECT *, x + degrees(atan2(sin(b) * sin(d) * cos(radians(y)), cos(d) - sin(radians(y)) * sin(up))) AS far FROM tl),
    tq AS MATERIALIZED (SELECT branch, point, a, sc, ms, i, CASE WHEN i = 0 THEN x ELSE far + 180 - 360 * floor((far + 180) / 360) - 180 END AS u, CASE WHEN i = 0 THEN y ELSE degrees(up) END AS v FROM tm),
    tc AS (SELECT branch, point, i, CAST(floor((u + 180) / 10 - 0.5) AS BIGINT) + p.range AS ci, CAST(floor((v + 90) / 5 - 0.5) AS BIGINT) + q.range AS cj, (CASE WHEN p.range = 1 THEN (u + 180) / 10 - 0.5 - floor((u + 180) / 10 - 0.5) ELSE 1 - ((u + 180) / 10 - 0.5 - floor((u + 180) / 10 - 0.5)) END) * (CASE WHEN q.range = 1 THEN (v + 90) / 5 - 0.5 - floor((v + 90) / 5 - 0.5) ELSE 1 - ((v + 90) / 5 - 0.5 - floor((v + 90) / 5 - 0.5)) END) AS w FROM tq CROSS JOIN range(2) p CROSS JOIN range(2) q),
    ts AS (SELECT branch, point, i, CASE WHEN count(x_all) = count(*) THEN sum(w * x_all) / sum(w) END AS gx, CASE WHEN count(y_all) = count(*) THEN sum(w * y_all) / sum(w) END AS gy, CASE WHEN max(CASE WHEN cj < 0 OR cj > 35 THEN 1 ELSE 0 END) = 1 THEN 'domain_boundary' WHEN count(x_all) < count(*) THEN 'missing_support' ELSE 'ok' END AS status FROM tc LEFT JOIN vf ON vf.lon_bin = (ci + 36) % 36 AND vf.lat_bin = cj WHERE w > 1e-9 GROUP BY ALL),
    se AS MATERIALIZED (SELECT tq.*, status, round(gx * sin(a) + gy * cos(a), 12) AS up FROM tq JOIN ts USING (branch, point, i)),
    sf AS (SELECT *, up IS NOT NULL AS valid, CASE WHEN i < 0 THEN ms NOT IN ('left', 'left_and_right') WHEN i > 0 THEN ms NOT IN ('right', 'left_and_right') ELSE TRUE END AS observable FROM se),
    sc AS (SELECT branch, point, arg_max(struct_pack(i := i, u := up, x := u, y := v), struct_pack(u := up, i := -i)) AS core FROM sf WHERE valid AND observable AND abs(i) <= 2 GROUP BY branch, point),
    sg AS MATERIALIZED (SELECT sf.*, core, i - core.i AS place, CASE WHEN valid THEN list_aggregate(list_filter([lag(up) OVER w, up, lead(up) OVER w], lambda z: z IS NOT NULL), 'median') END AS smoothed, up / CASE WHEN core.u > 0 THEN core.u END AS relative,
      CASE WHEN status = 'domain_boundary' THEN 'missing_because_of_boundary' WHEN status = 'missing_support' THEN 'missing_because_of_support' WHEN NOT valid THEN 'missing_invalid' WHEN i = 0 THEN 'direct_grid_information' ELSE 'interpolated' END AS sample_class,
      CASE WHEN place < 0 THEN 'left' WHEN place > 0 THEN 'right' WHEN place = 0 THEN 'core' END AS side, place * 0.5 * sc AS d_km, coalesce(abs(core.i) = 2, TRUE) AS core_uncertain
      FROM sf LEFT JOIN sc USING (branch, point) WINDOW w AS (PARTITION BY branch, point ORDER BY i))"""


@query("cross_sections", f"{SECTIONS} SELECT branch, point, i * 0.5e0 AS \"offset\", CAST(place AS INTEGER) AS place, round(d_km, 6) AS d_km, side, round(up, 9) AS u_parallel, round(smoothed, 9) AS smoothed, round(relative, 6) AS relative, valid, observable, valid AND observable AS eligible, sample_class, CAST(core.i AS INTEGER) AS core_place, round(core.u, 9) AS core_u, core_uncertain FROM sg")
def _(t):
    m = written(t)
    rows = sections(m, cores(m)).drop("bearing", "scale_km", "missing_side", "lon", "lat", "core_lon", "core_lat")
    return rounded(rows, 9, "u_parallel", "smoothed", "core_u").withColumns({"d_km": F.round("d_km", 6), "relative": F.round("relative", 6), "offset": F.col("offset").cast("double")})


@query(
    "section_summary",
    f"""{SECTIONS}, sv AS (SELECT *, abs(up - lag(up) OVER w) AS du, abs(smoothed - lag(smoothed) OVER w) AS ds FROM sg WINDOW w AS (PARTITION BY branch, point ORDER BY i)),
    sw AS (SELECT branch, point, CAST(max(core.i) AS INTEGER) AS core_place, max(core.u) AS core_u, count(CASE WHEN valid THEN 1 END) AS n_valid, count(CASE WHEN sample_class = 'missing_because_of_support' THEN 1 END) AS n_missing_support, count(CASE WHEN sample_class = 'missing_because_of_boundary' THEN 1 END) AS n_missing_boundary, coalesce(sum(du), 0) AS variation, coalesce(sum(ds), 0) AS variation_smoothed, coalesce(bool_or(abs(d_km) >= 2 * sc AND up < 0), FALSE) AS opposing_outer_transport, bool_or(core_uncertain) AS unsure, max(ms) AS ms FROM sv GROUP BY branch, point)
    SELECT branch, point, core_place, round(core_u, 9) AS core_u, n_valid, n_missing_support, n_missing_boundary, round(variation, 9) AS variation, round(variation_smoothed, 9) AS variation_smoothed, opposing_outer_transport,
      concat_ws(',', CASE WHEN n_missing_support > 0 THEN 'unsupported_transverse_sample' END, CASE WHEN n_missing_boundary > 0 THEN 'domain_boundary' END, CASE WHEN ms IN ('left', 'left_and_right') THEN 'left_flank_not_observable' END, CASE WHEN ms IN ('right', 'left_and_right') THEN 'right_flank_not_observable' END, CASE WHEN unsure THEN 'core_location_uncertain' END, CASE WHEN n_valid < 5 THEN 'short_available_cross_section' END) AS flags FROM sw""",
)
def _(t):
    m = written(t)
    return rounded(X.section_summary(sections(m, cores(m))), 9, "core_u", "variation", "variation_smoothed")


#: Profiles with their neighbours' (fragment {near} gives pairs of sections).
COMPOSITES = """, si AS (SELECT branch, point, place, up, CASE WHEN place > 0 THEN lag(up) OVER w WHEN place < 0 THEN lead(up) OVER w END AS inward FROM sg WINDOW w AS (PARTITION BY branch, point ORDER BY i)),
    cm AS (SELECT n.branch, n.point, place, round(quantile_cont(up, 0.25), 12) AS q25, round(quantile_cont(up, 0.5), 12) AS q50, round(quantile_cont(up, 0.75), 12) AS q75, count(up) AS n_composite, count(CASE WHEN inward IS NOT NULL AND up IS NOT NULL THEN 1 END) AS pairs, sum(CASE WHEN inward IS NOT NULL AND up IS NOT NULL THEN CAST(inward > up AS BIGINT) END)::BIGINT AS n_decline FROM ({near}) n JOIN si ON si.branch = n.nb AND si.point = n.np WHERE place IS NOT NULL GROUP BY ALL),
    cp AS MATERIALIZED (SELECT sg.*, q25, q50, q75, n_composite, n_decline, n_decline / nullif(pairs, 0) AS share_decline FROM sg LEFT JOIN cm ON cm.branch = sg.branch AND cm.point = sg.point AND cm.place = sg.place)"""
ALONG = "SELECT a.branch, a.point, b.branch AS nb, b.point AS np FROM co a JOIN co b ON a.branch = b.branch AND abs(a.seq - b.seq) <= 2"
HOPS = "SELECT DISTINCT a.branch, a.point, b.branch AS nb, b.point AS np FROM co a JOIN co b ON a.point = b.point OR EXISTS (FROM eh WHERE eh.a = a.point AND eh.b = b.point)"
SHOW_COMPOSITES = 'SELECT branch, point, i * 0.5e0 AS "offset", round(q25, 9) AS composite_q25, round(q50, 9) AS composite_median, round(q75, 9) AS composite_q75, n_composite, n_decline, round(share_decline, 9) AS share_decline FROM cp'
#: Steps between cells that follow each other in any transition that moves, at most two.
TWO_HOPS = """, eo AS (SELECT DISTINCT start_lat_bin * 36 + start_lon_bin AS a, end_lat_bin * 36 + end_lon_bin AS b FROM ({m}) WHERE abs(start_lat_bin - end_lat_bin) <= 1 AND abs(start_lon_bin - end_lon_bin) <= 1),
    eb AS (SELECT a, b FROM eo WHERE a != b UNION SELECT b, a FROM eo WHERE a != b), eh AS MATERIALIZED (SELECT a, b FROM eb UNION SELECT p.a, q.b FROM eb p JOIN eb q ON p.b = q.a WHERE p.a != q.b)"""


def composites(m: DataFrame, c: DataFrame) -> DataFrame:
    return X.composite_profiles(sections(m, c), X.along_segment(c, 2))


def shown_composites(rows: DataFrame) -> DataFrame:
    rows = rows.select("branch", "point", F.col("offset").cast("double").alias("offset"), "composite_q25", "composite_median", "composite_q75", "n_composite", "n_decline", "share_decline")
    return rounded(rows, 9, "composite_q25", "composite_median", "composite_q75", "share_decline")


@query("composite_profiles", SECTIONS + COMPOSITES.format(near=ALONG) + SHOW_COMPOSITES.join(["\n    ", ""]))
def _(t):
    m = written(t)
    return shown_composites(composites(m, cores(m)))


@query("composite_profiles_by_hops", SECTIONS + TWO_HOPS.format(m=f"SELECT * FROM ({POLAR})") + COMPOSITES.format(near=HOPS) + SHOW_COMPOSITES.join(["\n    ", ""]))
def _(t):
    m = written(t)
    c = cores(m)
    steps = m.where("abs(start_lat_bin - end_lat_bin) <= 1 and abs(start_lon_bin - end_lon_bin) <= 1")
    edges = steps.select(R.cell_id(GRID, "start_lon_bin", "start_lat_bin").alias("src"), R.cell_id(GRID, "end_lon_bin", "end_lat_bin").alias("dst")).distinct()
    return shown_composites(X.composite_profiles(sections(m, c), X.within_hops(c, R.n_hop(edges, 2))))


ZONES = f"""{SECTIONS}{COMPOSITES.format(near=ALONG)},
    dp AS (SELECT * FROM (SELECT cp.* EXCLUDE (side), unnest(CASE WHEN side = 'core' THEN ['left', 'right'] ELSE [side] END) AS side FROM cp WHERE valid AND place IS NOT NULL) WHERE ms != 'left_and_right' AND ms != side),
    dl AS (SELECT *, lead(d_km) OVER w AS d1, lead(n_composite) OVER w AS n1, lead(n_decline) OVER w AS k1, lead(share_decline) OVER w AS h1, [q50, lead(q50) OVER w, lead(q50, 2) OVER w, lead(q50, 3) OVER w] AS m, [smoothed, lead(smoothed) OVER w, lead(smoothed, 2) OVER w, lead(smoothed, 3) OVER w] AS s, lead(i) OVER w IS NOT NULL AS more FROM dp WINDOW w AS (PARTITION BY branch, point, side ORDER BY abs(place))),
    dv AS (SELECT *, CASE WHEN n_composite >= 2 AND n1 >= 2 THEN m ELSE s END AS z, CASE WHEN n_composite >= 2 AND n1 >= 2 THEN 'composite' ELSE 'smoothed' END AS profile, coalesce(k1 >= 2 AND h1 >= 0.5, FALSE) AS persists FROM dl WHERE more),
    dw AS (SELECT *, z[1] AS vi, z[2] AS vo, CASE WHEN z[3] IS NOT NULL AND z[4] IS NOT NULL THEN (z[3] + z[4]) / 2 ELSE coalesce(z[3], z[4]) END AS later, abs(d1) - abs(d_km) AS width FROM dv WHERE z[1] IS NOT NULL AND z[2] IS NOT NULL),
    dz AS (SELECT *, vi > vo AND coalesce(later <= (vi + vo) / 2, FALSE) AND (coalesce(n1 < 2, TRUE) OR persists) AS eligible FROM dw),
    dr AS MATERIALIZED (SELECT *, CASE WHEN later IS NOT NULL THEN greatest(0, greatest(z[3], z[4]) - vo) END AS recovery, CASE WHEN eligible THEN row_number() OVER (PARTITION BY branch, point, side, eligible ORDER BY persists DESC, vi - vo DESC, -(vi - vo) / width, abs(d1)) END AS rank FROM dz)"""


@query("drop_zones", f"{ZONES} SELECT branch, point, side, round(abs(d1), 6) AS distance_km, round(vi, 9) AS u_inner, round(vo, 9) AS u_outer, round(vi - vo, 9) + 0.0 AS \"drop\", round((vi - vo) / CASE WHEN core.u > 0 THEN core.u END, 6) + 0.0 AS relative_drop, round(-(vi - vo) / width, 9) + 0.0 AS slope, round(width, 6) AS width_km, CAST(2 + CAST(z[3] IS NOT NULL AS INTEGER) + CAST(z[4] IS NOT NULL AS INTEGER) AS INTEGER) AS samples, round(recovery, 9) + 0.0 AS recovery, profile, persists, eligible, CAST(rank AS INTEGER) AS rank FROM dr")
def _(t):
    m = written(t)
    rows = X.drop_zones(composites(m, cores(m))).drop("lon", "lat")
    rows = rounded(rows, 9, "u_inner", "u_outer", "drop", "slope", "recovery").withColumns({"distance_km": F.round("distance_km", 6), "width_km": F.round("width_km", 6), "relative_drop": F.round("relative_drop", 6)})
    # 0 and -0 are one number.
    return rows.withColumns({c: F.col(c) + 0.0 for c in ("drop", "relative_drop", "slope", "recovery")})


@query(
    "side_drops",
    f"""{ZONES}, dn AS (SELECT branch, point, side, count(CASE WHEN eligible THEN 1 END) AS n, arg_min(struct_pack(d := abs(d1), v := vi - vo, p := persists, r := recovery), rank) FILTER (rank = 1) AS best FROM dr GROUP BY ALL),
    df AS (SELECT branch, point, side, min(CASE WHEN relative <= 0.5 THEN abs(d_km) END) AS half, min(CASE WHEN relative <= 0.36787944117144233 THEN abs(d_km) END) AS e, min(CASE WHEN relative <= 0 THEN abs(d_km) END) AS zero FROM dp GROUP BY ALL)
    SELECT co.branch, co.point, x.side, CASE WHEN ms IN ('left_and_right', x.side) THEN 'flank_not_observable' WHEN best IS NOT NULL THEN 'candidate_drop' ELSE 'observable_no_candidate_drop' END AS status, coalesce(n, 0) AS candidates, round(best.d, 6) AS distance_km, round(best.v, 9) AS "drop", coalesce(best.p, FALSE) AS persists, coalesce(best.r > 0.5 * best.v, FALSE) AS strong_recovery, round(half, 6) AS half_km, round(e, 6) AS e_km, round(zero, 6) AS zero_km
    FROM co CROSS JOIN (SELECT unnest(['left', 'right']) AS side) x LEFT JOIN dn ON dn.branch = co.branch AND dn.point = co.point AND dn.side = x.side LEFT JOIN df ON df.branch = co.branch AND df.point = co.point AND df.side = x.side""",
)
def _(t):
    m = written(t)
    rows = materialize(composites(m, cores(m)), "profiles")
    out = X.side_drops(rows, X.drop_zones(rows))
    return rounded(rounded(out, 9, "drop"), 6, "distance_km", "half_km", "e_km", "zero_km")


# Barriers

OFFSETS = [150.0 * k for k in range(-6, 7)]
RULES = {"sigma": 1.0, "min_prominence": 0.002, "min_width_km": 120.0, "min_separation_km": 400.0}
KERNEL = ", ".join(f"({k}, {w!r})" for k, w in zip(range(-4, 5), B.gaussian_weights(1.0), strict=True))
RUN = "branch, point, run"
#: Minima of smoothed runs (bm), and going down by prominence, which of them an accepted one is too close to (bn).
MINIMA = f"""{crossing_sql(", ".join(map(str, OFFSETS))).replace(crossing_sql("").partition(", " + POINTS)[0], CORRIDORS, 1)},
    bi AS (SELECT *, round(greatest(0.0, {WILSON.replace('{s}', '-')}), 15) AS low, round(least(1.0, {WILSON.replace('{s}', '+')}), 15) AS high, sum(CASE WHEN supported THEN 0 ELSE 1 END) OVER (PARTITION BY branch, point ORDER BY "offset") AS run FROM f),
    bh AS (SELECT {RUN}, count(*) AS nn FROM bi WHERE supported GROUP BY {RUN} HAVING count(*) >= 3),
    bj AS (SELECT bi.*, nn, row_number() OVER (PARTITION BY {RUN} ORDER BY "offset") - 1 AS i FROM bi JOIN bh USING ({RUN}) WHERE supported),
    bs AS MATERIALIZED (SELECT a.branch, a.point, a.run, a.i, a.nn, a."offset", a.p_cross, a.low, a.high, round(sum(k.w * b.p_cross), 12) AS s FROM bj a CROSS JOIN (VALUES {KERNEL}) k(k, w) JOIN bj b ON a.branch = b.branch AND a.point = b.point AND a.run = b.run AND b.i = least(greatest(a.i + k.k, 0), a.nn - 1) GROUP BY ALL),
    bt AS (SELECT a.branch, a.point, a.run, a.i, a.nn, a.s, max(b.i) FILTER (b.i < a.i AND b.s != a.s) AS lo, min(b.i) FILTER (b.i > a.i AND b.s != a.s) AS hi, coalesce(max(b.i) FILTER (b.i < a.i AND b.s < a.s) + 1, 0) AS l, coalesce(min(b.i) FILTER (b.i > a.i AND b.s < a.s) - 1, a.nn - 1) AS r, max(b.s) FILTER (b.i = 1) AS second, max(b.s) FILTER (b.i = a.nn - 2) AS almost FROM bs a JOIN bs b USING ({RUN}) GROUP BY a.branch, a.point, a.run, a.i, a.nn, a.s),
    bu AS (SELECT bt.*, coalesce(x.s > bt.s AND y.s > bt.s AND bt.i = (lo + hi) // 2, FALSE) AS inside FROM bt LEFT JOIN bs x ON x.branch = bt.branch AND x.point = bt.point AND x.run = bt.run AND x.i = lo LEFT JOIN bs y ON y.branch = bt.branch AND y.point = bt.point AND y.run = bt.run AND y.i = hi),
    bv AS (SELECT * FROM bu WHERE inside OR (i = 0 AND s < second) OR (i = nn - 1 AND s < almost)),
    bw AS (SELECT bv.branch, bv.point, bv.run, bv.i, bv.s, bv.inside, max(b.s) FILTER (b.i BETWEEN l AND bv.i) AS ml, max(b.s) FILTER (b.i BETWEEN bv.i AND r) AS mr, arg_max(b.i, struct_pack(s := b.s, i := b.i)) FILTER (b.i BETWEEN l AND bv.i) AS a, arg_max(b.i, struct_pack(s := b.s, i := -b.i)) FILTER (b.i BETWEEN bv.i AND r) AS b FROM bv JOIN bs b USING ({RUN}) GROUP BY ALL),
    bx AS (SELECT branch, point, run, i, s, inside, CASE WHEN inside THEN least(ml, mr) - s ELSE 0 END AS prominence, CASE WHEN inside THEN a ELSE i END AS a, CASE WHEN inside THEN b ELSE i END AS b FROM bw),
    bq AS (SELECT bx.*, bx.s + prominence / 2 AS half, max(z.i) FILTER (z.i BETWEEN bx.a AND bx.i AND z.s >= bx.s + prominence / 2) AS ja, min(z.i) FILTER (z.i BETWEEN bx.i AND bx.b AND z.s >= bx.s + prominence / 2) AS jb, max(z.s) FILTER (z.i = bx.a) AS sa, max(z.s) FILTER (z.i = bx.b) AS sb FROM bx JOIN (SELECT branch, point, run, i, s FROM bs) z USING ({RUN}) GROUP BY bx.branch, bx.point, bx.run, bx.i, bx.s, bx.inside, bx.prominence, bx.a, bx.b),
    bz AS (SELECT bq.*, p.s AS p0, q.s AS p1, u.s AS q0, v.s AS q1 FROM bq LEFT JOIN bs p ON p.branch = bq.branch AND p.point = bq.point AND p.run = bq.run AND p.i = ja LEFT JOIN bs q ON q.branch = bq.branch AND q.point = bq.point AND q.run = bq.run AND q.i = ja + 1 LEFT JOIN bs u ON u.branch = bq.branch AND u.point = bq.point AND u.run = bq.run AND u.i = jb LEFT JOIN bs v ON v.branch = bq.branch AND v.point = bq.point AND v.run = bq.run AND v.i = jb - 1),
    bm AS MATERIALIZED (SELECT *, CASE WHEN inside THEN 150 * (jb - CASE WHEN q0 > half THEN (q0 - half) / (q0 - q1) ELSE 0 END - ja - CASE WHEN p0 > half THEN (p0 - half) / (p0 - p1) ELSE 0 END) ELSE 0 END AS width, CASE WHEN sa >= sb THEN a ELSE b END AS ref, row_number() OVER (PARTITION BY {RUN} ORDER BY -prominence, i) AS k, inside AND prominence >= 0.002 AND width >= 120 AS good FROM bz),
    bn(branch, point, run, k, i, near, taken) AS (SELECT branch, point, run, k, i, FALSE, CASE WHEN good THEN [i] ELSE [] END FROM bm WHERE k = 1 UNION ALL
      SELECT bm.branch, bm.point, bm.run, bm.k, bm.i, len(list_filter(taken, lambda z: abs(z - bm.i) < 3)) > 0, CASE WHEN good AND len(list_filter(taken, lambda z: abs(z - bm.i) < 3)) = 0 THEN list_append(taken, bm.i) ELSE taken END FROM bn JOIN bm ON bm.branch = bn.branch AND bm.point = bn.point AND bm.run = bn.run AND bm.k = bn.k + 1)"""
SAID = "concat_ws(';', CASE WHEN NOT inside THEN 'edge_minimum' END, CASE WHEN prominence < 0.002 THEN 'low_prominence' END, CASE WHEN width < 120 THEN 'narrow_minimum' END, CASE WHEN near THEN 'too_close_to_stronger_minimum' END)"


def candidates(m: DataFrame, c: DataFrame) -> DataFrame:
    return B.barrier_candidates(permeability(c, m, 1500.0, OFFSETS), 150.0, **RULES)


@query("barrier_candidates", f"""{MINIMA} SELECT bm.branch, bm.point, o."offset", round(o.p_cross, 9) AS p_cross, round(bm.s, 9) AS smoothed, round(prominence, 9) + 0.0 AS prominence, round(width, 6) + 0.0 AS width_km, x."offset" AS reference_offset, round(x.p_cross, 9) AS reference_p_cross, o.high >= x.low AS ci_overlaps_reference, {SAID} = '' AS accepted, {SAID} AS reasons
    FROM bm JOIN bn USING ({RUN}, k) JOIN bs o ON o.branch = bm.branch AND o.point = bm.point AND o.run = bm.run AND o.i = bm.i JOIN bs x ON x.branch = bm.branch AND x.point = bm.point AND x.run = bm.run AND x.i = bm.ref""")
def _(t):
    m = written(t)
    return rounded(rounded(candidates(m, cores(m)), 9, "p_cross", "smoothed", "prominence", "reference_p_cross"), 6, "width_km")


def barrier_minima(t: DataFrame) -> DataFrame:
    """Accepted minima of the corridors' profiles at their places beside the cores, with the core's sequence in its branch."""
    m = written(t)
    c = cores(m)
    found = candidates(m, c).where("accepted").join(c.select("branch", "point", "sequence", "lon", "lat", "bearing"), ["branch", "point"])
    lon, lat = X.destination(F.col("lon"), F.col("lat"), F.pmod(F.col("bearing") + F.when(F.col("offset") < 0, -90.0).otherwise(90.0), F.lit(360.0)), F.abs("offset"))
    return found.select("branch", "point", "sequence", "offset", "p_cross", lon.alias("lon"), lat.alias("lat"))


#: What may go on as one track in the queries: cells are up to 1,100 km wide.
LINKS = {"max_offset_km": 500.0, "max_gap_km": 2500.0, "max_missing": 1, "sign_band_km": 100.0}


@query("barrier_tracks", None)
def _(t):
    tracks = B.track_geometry(B.link_tracks(barrier_minima(t), **LINKS))
    return rounded(tracks, 6, "lon", "lat", "step_km", "along_km")


@query("barrier_track_summary", None)
def _(t):
    tracks = B.track_geometry(B.link_tracks(barrier_minima(t), **LINKS))
    return rounded(B.track_summary(tracks), 6, "length_km", "coverage", "gap_km", "mean", "median")


# Lines


@query("resample_polyline", None)
def _(t):
    return rounded(L.resample_polyline(t, 200.0, ["z"], ["trajectory"], "obs"), 6, "s_km", "lon", "lat", "z")


@query("line_geometry", None)
def _(t):
    return L.line_geometry(L.resample_polyline(t, 200.0, ["z"], ["trajectory"], "obs"), keys=["trajectory"])


# Nearest rows


@query(
    "nearest_field_values",
    f"""WITH f AS MATERIALIZED (SELECT time, lon, lat, CASE WHEN event_id % 3 > 0 THEN z END AS z FROM {{t}} WHERE event_type = 'view'), d AS (SELECT DISTINCT time FROM f),
    w AS (SELECT p.time, arg_min(d.time, struct_pack(a := abs(epoch_us(d.time) - epoch_us(p.time)), t := d.time)) AS field_time FROM (SELECT DISTINCT time FROM {{t}}) p CROSS JOIN d GROUP BY p.time),
    p AS (SELECT trajectory, obs, time, lon, lat, field_time FROM {{t}} JOIN w USING (time)),
    k AS (SELECT trajectory, obs, f.z, f.lon AS x, f.lat AS y, {haversine_sql('p.lon', 'p.lat', 'f.lon', 'f.lat')} AS km FROM p JOIN f ON f.time = p.field_time AND f.z IS NOT NULL),
    m AS (SELECT trajectory, obs, arg_min(z, struct_pack(k := km, x := x, y := y, z := z)) AS z, min(km) AS km FROM k GROUP BY trajectory, obs)
    SELECT p.*, z, round(km, 6) AS km FROM p LEFT JOIN m USING (trajectory, obs)""",
)
def _(t):
    field = t.where("event_type = 'view'").select("time", "lon", "lat", F.expr("CASE WHEN event_id % 3 > 0 THEN z END AS z"))
    return rounded(N.nearest_field_values(t.select("trajectory", "obs", "time", "lon", "lat"), field, ["z"], ["trajectory", "obs"]), 6, "km").select("trajectory", "obs", "time", "lon", "lat", "field_time", "z", "km")


@query("nearest_other_lines", f"WITH d AS (SELECT a.trajectory, a.obs, b.trajectory AS other, b.obs AS place, {haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS km FROM {{t}} a JOIN {{t}} b ON a.trajectory != b.trajectory OR abs(a.obs - b.obs) > 3), n AS (SELECT trajectory, obs, min(CASE WHEN other != trajectory THEN km END) AS other_km, min(CASE WHEN other = trajectory THEN km END) AS self_km FROM d GROUP BY trajectory, obs) SELECT trajectory, obs, lon, lat, round(other_km, 6) AS other_km, round(self_km, 6) AS self_km FROM {{t}} LEFT JOIN n USING (trajectory, obs)")
def _(t):
    return rounded(N.nearest_other_lines(t, 3, "trajectory", "obs"), 6, "other_km", "self_km")


# Networks of modes

#: Cells are far larger than those the default limits are for.
EDGES = {"max_km": 2000.0}


def mode_tables(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = written(t)
    members = materialize(mode_members(m), "mode-members")
    return members, materialize(W.mode_moments(members, m, 1, 1, 1, 0.02), "mode-moments")


def network(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    members, modes = mode_tables(t)
    return modes, W.network_edges(W.clustered(materialize(W.continuations(members, modes, GRID), "continuations"), GRID), **EDGES)


@query("mode_moments", None)
def _(t):
    return rounded(mode_tables(t)[1], 6, "p_all", "dx", "dy", "mean_km", "bearing", "sd_km", "angular_sd", "p_moving")


@query("branch_network", None)
def _(t):
    return network(t)[1]


@query("branch_network_components", None)
def _(t):
    modes, edges = network(t)
    return W.network_components(modes, edges, GRID)


#: Metres a second: the given tracks step by a quarter of a degree or more in hours.
SPEED = 5.0


@query("speed_repair", None)
def _(t):
    return Q.speed_repair(t, SPEED, 5.0)


# Fronts

#: Size of the mean displacement of cells, and their direction.
STRENGTH = f"""WITH sv AS (SELECT f.start_lon_bin AS lon_bin, f.start_lat_bin AS lat_bin, round(pm * coalesce(r1, 0), 12) AS v, CASE WHEN r1 >= 0.05 THEN theta1 END AS th FROM (SELECT start_lon_bin, start_lat_bin, sum(CASE WHEN stay THEN 0 ELSE transition_count END) / sum(transition_count) AS pm FROM ({POLAR}) GROUP BY 1, 2) f LEFT JOIN ({OUTGOING}) h ON h.start_lon_bin = f.start_lon_bin AND h.start_lat_bin = f.start_lat_bin),
    sn AS (SELECT c.*, e.v AS e, w.v AS w, n.v AS n, s.v AS s FROM sv c LEFT JOIN sv e ON e.lat_bin = c.lat_bin AND e.lon_bin = (c.lon_bin + 1) % 36 LEFT JOIN sv w ON w.lat_bin = c.lat_bin AND w.lon_bin = (c.lon_bin + 35) % 36 LEFT JOIN sv n ON n.lon_bin = c.lon_bin AND n.lat_bin = c.lat_bin + 1 LEFT JOIN sv s ON s.lon_bin = c.lon_bin AND s.lat_bin = c.lat_bin - 1),
    sr AS (SELECT *, {slope_sql('e', 'w', '(radians(10) * 6371.0 * cos(radians(-87.5 + lat_bin * 5)))')} AS gx, {slope_sql('n', 's', '(radians(5) * 6371.0)')} AS gy, radians(th) AS a FROM sn),
    sx AS (SELECT *, gy * sin(a) - gx * cos(a) AS g_perp, gx * sin(a) + gy * cos(a) AS g_parallel FROM sr)"""
METHOD = "CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN '{d}_centered' WHEN {a} IS NOT NULL OR {b} IS NOT NULL THEN '{d}_one_sided' ELSE '{d}_undefined' END AS {d}_method"


def strength(m: DataFrame) -> DataFrame:
    h = R.harmonics(m).select("lon_bin", "lat_bin", "r1", F.when(F.col("r1") >= 0.05, F.col("theta1")).alias("theta"))
    v = F.sqrt(F.col("x_all") ** 2 + F.col("y_all") ** 2)
    return R.directional_vectors(m).select("lon_bin", "lat_bin", F.round(v, 12).alias("strength")).join(h.drop("r1"), ["lon_bin", "lat_bin"], "left")


def gradients(m: DataFrame) -> DataFrame:
    return materialize(T.rotated_gradients(strength(m), GRID, "strength", "theta"), "gradients")


@query(
    "rotated_gradients",
    f"""{STRENGTH} SELECT lon_bin, lat_bin, round(v, 9) AS strength, round(gx, 9) + 0.0 AS gx, round(gy, 9) + 0.0 AS gy, {METHOD.format(a='e', b='w', d='dx')}, {METHOD.format(a='n', b='s', d='dy')}, round(g_perp, 9) + 0.0 AS g_perp, round(abs(g_perp), 9) AS abs_g_perp, round(g_parallel, 9) + 0.0 AS g_parallel, round(abs(g_parallel), 9) AS abs_g_parallel, round(sqrt(g_perp * g_perp + g_parallel * g_parallel), 9) AS magnitude,
    CASE WHEN sqrt(g_perp * g_perp + g_parallel * g_parallel) > 1e-12 THEN round(abs(g_perp) / sqrt(g_perp * g_perp + g_parallel * g_parallel), 6) END AS share_perp FROM sx""",
)
def _(t):
    rows = gradients(written(t)).drop("theta")
    nine = [c for c in rows.columns if c in ("strength", "gx", "gy", "g_perp", "abs_g_perp", "g_parallel", "abs_g_parallel", "magnitude")]
    return rows.withColumns({c: F.round(c, 9) + 0.0 for c in nine} | {"share_perp": F.round("share_perp", 6)})


@query("nearby_contamination", f"{SECTIONS}, nd AS (SELECT p.branch, p.point, p.a, p.sc, {haversine_sql('p.x', 'p.y', 'q.x', 'q.y')} AS d, radians({bearing_sql('p.x', 'p.y', 'q.x', 'q.y')}) - p.a AS turn FROM co p JOIN co q ON p.branch != q.branch), nf AS (SELECT branch, point, max(CASE WHEN d = 0 OR (abs(round(d * cos(turn), 6)) <= 2 * sc AND abs(round(d * sin(turn), 6)) <= 3 * sc) THEN 1 ELSE 0 END) = 1 AS hit FROM nd GROUP BY branch, point) SELECT co.branch, co.point, coalesce(hit, FALSE) AS contaminated FROM co LEFT JOIN nf USING (branch, point)")
def _(t):
    return T.nearby_contamination(cores(written(t))).select("branch", "point", "contaminated")


#: The same steps once more with sections up to one place apart, for a second result of each core and side.
AGAIN = re.sub(r"\b(si|cm|cp|dp|dl|dv|dw|dz|dr)\b", r"\1b", ZONES[len(SECTIONS) :].replace("<= 2", "<= 1", 1))


def side_results(m: DataFrame, c: DataFrame) -> DataFrame:
    """Best drops of each core and side by the sections up to two places apart, and by those next to it: segment 2 and 1."""
    s = materialize(sections(m, c), "sections")
    out = None
    for reach in (2, 1):
        zones = X.drop_zones(X.composite_profiles(s, X.along_segment(c, reach))).where("rank = 1").withColumn("segment", F.lit(reach))
        out = zones if out is None else out.unionByName(zones)
    axes = s.select("branch", "point", "core_lon", "core_lat").distinct()
    return materialize(out.join(axes, ["branch", "point"]), "side-results")


@query(
    "canonical_fronts",
    f"""{ZONES}{AGAIN},
    fr AS (SELECT branch, point, side, abs(d1) AS km, vi - vo AS v, (vi - vo) / CASE WHEN core.u > 0 THEN core.u END AS rel FROM dr WHERE rank = 1 UNION ALL SELECT branch, point, side, abs(d1), vi - vo, (vi - vo) / CASE WHEN core.u > 0 THEN core.u END FROM drb WHERE rank = 1),
    fm AS (SELECT branch, point, side, median(km) AS km, median(v) AS v, median(rel) AS rel FROM fr GROUP BY ALL)
    SELECT co.branch, co.point, z.side, co.x AS core_lon, co.y AS core_lat, CASE WHEN ms IN ('left_and_right', z.side) THEN 'side_not_observable' WHEN km IS NOT NULL THEN 'probable_transport_front' ELSE 'observable_no_retained_front' END AS status, round(km, 6) AS distance_km, round(v, 9) AS "drop", round(rel, 6) AS relative_drop FROM co CROSS JOIN (SELECT unnest(['left', 'right']) AS side) z LEFT JOIN fm ON fm.branch = co.branch AND fm.point = co.point AND fm.side = z.side""",
)
def _(t):
    m = written(t)
    c = cores(m)
    rows = T.canonical_fronts(c, side_results(m, c)).drop("lon", "lat")
    return rows.withColumns({"distance_km": F.round("distance_km", 6), "drop": F.round("drop", 9), "relative_drop": F.round("relative_drop", 6)})


MEDIANS = ["lon", "lat", "distance_km", "drop", "relative_drop", "g_perp", "abs_g_perp", "abs_g_parallel", "share_perp", "core_abs_g_perp", "local_max", "local_max_km", "percentile"]


def front_records(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gradients of cells, and all results for cores and sides with the gradients there, at the axis and around."""
    m = written(t)
    c = cores(m)
    g = gradients(m)
    clean = T.nearby_contamination(c).select("branch", "point", "scale_km", "contaminated")
    found = side_results(m, c).join(clean, ["branch", "point"]).select("branch", "point", "side", "segment", "lon", "lat", "core_lon", "core_lat", "scale_km", "distance_km", "drop", "relative_drop", "persists", "contaminated")
    sampled = T.gradients_at(found, g, GRID)
    at_core = T.gradients_at(found.select("branch", "point", "core_lon", "core_lat").distinct(), g, GRID, "core_lon", "core_lat", "core_").select("branch", "point", "core_abs_g_perp")
    return g, T.gradient_context(materialize(sampled.join(at_core, ["branch", "point"]), "front-samples"), g, GRID, ["branch", "point", "side", "segment"])


@query("front_records", None)
def _(t):
    return front_records(t)[1]


@query("unique_fronts", None)
def _(t):
    return T.unique_fronts(front_records(t)[1], MEDIANS, 0.2)


# Ridges


def ridges(m: DataFrame, smooth: bool) -> DataFrame:
    scale = M.cell_scales(m.sparkSession, GRID).select("lat_bin", F.sqrt(F.col("width_km") * F.col("height_km")).alias("scale_km"))
    cells = strength(m).join(R.harmonics(m).select("lon_bin", "lat_bin", "n_move"), ["lon_bin", "lat_bin"]).join(scale, "lat_bin")
    return X.ridge_diagnostics(cells, GRID, "strength", smooth=smooth, ellipsoid=False)


def ridges_sql(smooth: bool) -> str:
    """ra: cells and their value s, rz: what ridges shows."""
    box = "CROSS JOIN (SELECT x.range AS dx, y.range AS dy FROM range(-1, 2) x CROSS JOIN range(-1, 2) y) o JOIN rk b ON b.lon_bin = (a.lon_bin + o.dx + 36) % 36 AND b.lat_bin = a.lat_bin + o.dy"
    field = f"SELECT a.lon_bin, a.lat_bin, a.n_move, a.th, round(sum(b.v) / count(*), 12) AS s FROM rk a {box} GROUP BY ALL" if smooth else "SELECT lon_bin, lat_bin, n_move, th, v AS s FROM rk"
    part = lambda c, lo, step: f"(CASE WHEN {lo}.range = 1 THEN {c} - floor({c}) ELSE 1 - ({c} - floor({c})) END)"
    u, v = "((lo + 180) / 10 - 0.5)", "((la + 90) / 5 - 0.5)"
    return f"""{STRENGTH}, rh AS (SELECT start_lon_bin AS lon_bin, start_lat_bin AS lat_bin, n_move FROM ({OUTGOING})),
    rk AS MATERIALIZED (SELECT sv.*, n_move FROM sv JOIN rh USING (lon_bin, lat_bin)), ra AS MATERIALIZED ({field}),
    rb AS (SELECT *, -87.5e0 + lat_bin * 5 AS y, -175e0 + lon_bin * 10 AS x FROM ra WHERE th IS NOT NULL),
    rc AS (SELECT lon_bin, lat_bin, k, x, y, radians(th) + k * pi() / 2 AS b, sqrt({haversine_sql('0', 'y', '10', 'y')} * {haversine_sql('0', '(y - 2.5)', '0', '(y + 2.5)')}) / 6371.0 AS d FROM rb CROSS JOIN (SELECT unnest([-1, 1]) AS k)),
    rd AS (SELECT *, asin(greatest(-1.0, least(1.0, sin(radians(y)) * cos(d) + cos(radians(y)) * sin(d) * cos(b)))) AS up FROM rc),
    re AS (SELECT lon_bin, lat_bin, k, degrees(up) AS la, x + degrees(atan2(sin(b) * sin(d) * cos(radians(y)), cos(d) - sin(radians(y)) * sin(up))) AS far FROM rd),
    rf AS (SELECT lon_bin, lat_bin, k, la, far + 180 - 360 * floor((far + 180) / 360) - 180 AS lo FROM re),
    rg AS (SELECT lon_bin, lat_bin, k, CAST(floor({u}) AS BIGINT) + p.range AS ci, CAST(floor({v}) AS BIGINT) + q.range AS cj, {part(u, 'p', 10)} * {part(v, 'q', 5)} AS w FROM rf CROSS JOIN range(2) p CROSS JOIN range(2) q),
    rm AS (SELECT rg.lon_bin, rg.lat_bin, k, round(CASE WHEN count(s) = count(*) THEN sum(w * s) / sum(w) END, 12) AS z, CASE WHEN max(CASE WHEN cj < 0 OR cj > 35 THEN 1 ELSE 0 END) = 1 THEN 'domain_boundary' WHEN count(s) < count(*) THEN 'missing_support' ELSE 'ok' END AS status FROM rg LEFT JOIN ra ON ra.lon_bin = (ci + 36) % 36 AND ra.lat_bin = cj WHERE w > 1e-9 GROUP BY rg.lon_bin, rg.lat_bin, k),
    rn AS (SELECT lon_bin, lat_bin, max(CASE WHEN k = -1 THEN z END) AS l, max(CASE WHEN k = 1 THEN z END) AS r, max(CASE WHEN k = -1 THEN status END) AS ls, max(CASE WHEN k = 1 THEN status END) AS rs FROM rm GROUP BY 1, 2),
    ro AS (SELECT ra.*, l, r, coalesce(ls, 'not_sampled') AS left_status, coalesce(rs, 'not_sampled') AS right_status, s - l AS dl, s - r AS dr FROM ra LEFT JOIN rn USING (lon_bin, lat_bin)),
    rp AS (SELECT *, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN CASE WHEN dl >= -1e-12 AND dr >= -1e-12 THEN 'two_sided' ELSE 'not_ridge' END WHEN coalesce(dl, dr) >= -1e-12 THEN 'one_sided' ELSE 'not_ridge' END AS ridge_type, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 'none' WHEN l IS NOT NULL THEN 'right' WHEN r IS NOT NULL THEN 'left' ELSE 'left_and_right' END AS missing_side, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN s - (l + r) / 2 ELSE coalesce(dl, dr) END AS c_perp FROM ro),
    rq AS MATERIALIZED (SELECT quantile_cont(s, 0.5) AS q50, quantile_cont(s, 0.75) AS q75 FROM ra)"""


SHOWN_RIDGES = "SELECT lon_bin, lat_bin, n_move, round(s, 9) AS s, round(l, 9) AS \"left\", round(r, 9) AS \"right\", left_status, right_status, round(dl, 9) + 0.0 AS d_left, round(dr, 9) + 0.0 AS d_right, round(c_perp, 9) + 0.0 AS c_perp, ridge_type, missing_side, ridge_type != 'not_ridge' AS ridge, ridge_type != 'not_ridge' AND s >= q50 AS above_50, ridge_type != 'not_ridge' AND s >= q75 AS above_75 FROM rp CROSS JOIN rq"


def shown_ridges(rows: DataFrame) -> DataFrame:
    return rounded(rows, 9, "s", "left", "right").withColumns({c: F.round(c, 9) + 0.0 for c in ("d_left", "d_right", "c_perp")})


@query("ridge_diagnostics", f"{ridges_sql(False)} {SHOWN_RIDGES}")
def _(t):
    return shown_ridges(ridges(written(t), False))


@query("ridge_diagnostics_smoothed", f"{ridges_sql(True)} {SHOWN_RIDGES}")
def _(t):
    return shown_ridges(ridges(written(t), True))


@query(
    "ridge_paths",
    f"""{ridges_sql(True).replace('WITH sv', 'WITH RECURSIVE sv', 1)}, c AS MATERIALIZED (SELECT lon_bin, lat_bin, lat_bin * 36 + lon_bin AS node FROM rp WHERE ridge_type != 'not_ridge'),
    ob AS (SELECT x.range AS dx, y.range AS dy FROM range(-1, 2) x CROSS JOIN range(-1, 2) y WHERE x.range != 0 OR y.range != 0),
    ne AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM c a CROSS JOIN ob JOIN c b ON b.lon_bin = (a.lon_bin + dx + 36) % 36 AND b.lat_bin = a.lat_bin + dy),
    z(node, other) AS (SELECT node, node FROM c UNION SELECT z.node, ne.b FROM z JOIN ne ON ne.a = z.other), p AS MATERIALIZED (SELECT node, min(other) AS component FROM z GROUP BY node),
    dg AS MATERIALIZED (SELECT p.node, component, count(ne.b) AS degree FROM p LEFT JOIN ne ON ne.a = p.node GROUP BY ALL),
    st AS (SELECT component, count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, count(CASE WHEN degree = 1 THEN 1 END) AS ends, count(CASE WHEN degree > 2 THEN 1 END) AS junctions FROM dg GROUP BY component),
    fo AS (SELECT DISTINCT (dg.node // 36 + dy) * 36 + (dg.node % 36 + dx + 36) % 36 AS gap, component FROM dg CROSS JOIN ob WHERE degree <= 1 AND dg.node // 36 + dy BETWEEN 0 AND 35),
    fg AS (SELECT gap, list(DISTINCT component) AS who FROM fo WHERE gap NOT IN (SELECT node FROM c) GROUP BY gap HAVING count(DISTINCT component) > 1),
    fh AS (SELECT component, gap, unnest(who) AS other FROM (SELECT gap, who, unnest(who) AS component FROM fg)),
    fi AS (SELECT component, count(DISTINCT gap) AS interruptions, string_agg(DISTINCT other::VARCHAR, ',' ORDER BY other::VARCHAR) FILTER (other != component) AS joins FROM fh GROUP BY component)
    SELECT st.*, CASE WHEN nodes = 1 THEN 'isolated_cell' WHEN junctions > 0 THEN 'junction_network' WHEN ends = 0 THEN 'loop' ELSE 'simple_path' END AS kind, coalesce(interruptions, 0) AS interruptions, coalesce(joins, '') AS joins FROM st LEFT JOIN fi USING (component)""",
)
def _(t):
    rows = X.ridge_paths(ridges(written(t), True), GRID)
    # In the order of text, as the twin has it.
    return rows.withColumn("joins", F.array_join(F.array_sort(F.split("joins", ",")), ","))

"""Queries on voxels, planes and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import cells, clusters as cl, loops, planes as pl, points as pt, voxels, windows as wn
from scanloom.operators.components import connected_components
from scanloom.params import PlaneParams
from scanloom.plans.catalog_points import P, WORLD, POSE_ROT, key_sql, snapped
from scanloom.plans.catalog_windows import RANKED, point_block
from scanloom.plans.registry import query, s, snap

SCAN = ["session", "scan_id"]
PLANE = PlaneParams(voxel_size=10.0, min_points=4, max_min_eigen=1.0, normal_threshold=0.3, distance_threshold=0.5)
KEY5 = ", ".join(f"{key_sql(a, 5.0)} v{a}" for a in "xyz")
KEY10 = ", ".join(f"{key_sql(a, 10.0)} v{a}" for a in "xyz")


@query("ag_voxel_mean", f"""SELECT session, scan_id, vx, vy, vz, {s('avg(x)')} x, {s('avg(y)')} y, {s('avg(z)')} z, {s('avg(intensity)')} intensity, count(*)::BIGINT n
  FROM (SELECT *, {KEY5} FROM v_points) GROUP BY 1, 2, 3, 4, 5""")
def _(v):
    return voxels.voxel_mean(v.points, 5.0).withColumns({c: snap(F.col(c)) for c in ("x", "y", "z", "intensity")})


MERGED = f"""WITH {POSE_ROT}, {WORLD}, k AS (SELECT *, {', '.join(f"{key_sql('w' + a, 5.0)} v{a}" for a in 'xyz')} FROM wp)
  SELECT vx, vy, vz, {s('avg(wx)')} x, {s('avg(wy)')} y, {s('avg(wz)')} z, {s('avg(intensity)')} intensity, count(*)::BIGINT n FROM k GROUP BY 1, 2, 3"""


def merged_map(v, size=5.0):
    return voxels.voxel_mean(pt.to_world(v.points, v.poses), size, ())


@query("merged_map", MERGED)
def _(v):
    return merged_map(v).withColumns({c: snap(F.col(c)) for c in ("x", "y", "z", "intensity")})


@query("wn_sliding_clouds", f"""WITH {RANKED}, w AS (SELECT a.session, b.rn AS "window", a.scan_id FROM rk a JOIN rk b ON a.session = b.session AND b.rn BETWEEN a.rn AND a.rn + 4),
  k AS (SELECT *, {KEY10} FROM v_points) SELECT session, "window", vx, vy, vz, count(*)::BIGINT n, {s('sum(x) / count(*)')} x, {s('sum(y) / count(*)')} y, {s('sum(z) / count(*)')} z
  FROM k JOIN w USING (session, scan_id) GROUP BY 1, 2, 3, 4, 5""")
def _(v):
    df = voxels.window_voxel_mean(v.points, wn.sliding_windows(v.poses, 5), 10.0)
    return df.withColumns({c: snap(F.col(c)) for c in "xyz"})


@query("ag_voxel_nearest", f"""WITH k AS (SELECT *, floor(x / 10.0)::BIGINT vx, floor(y / 10.0)::BIGINT vy, floor(z / 10.0)::BIGINT vz FROM v_points),
  d AS (SELECT *, (x - (vx + 0.5) * 10.0) * (x - (vx + 0.5) * 10.0) + (y - (vy + 0.5) * 10.0) * (y - (vy + 0.5) * 10.0) + (z - (vz + 0.5) * 10.0) * (z - (vz + 0.5) * 10.0) d2 FROM k)
  SELECT session, scan_id, vx, vy, vz, {s('d2', 4)} d2, point_idx FROM d QUALIFY row_number() OVER (PARTITION BY session, scan_id, vx, vy, vz ORDER BY d2, point_idx) = 1""")
def _(v):
    return voxels.voxel_nearest(v.points, 10.0, SCAN).select(*SCAN, "vx", "vy", "vz", snap(F.col("d2"), 4).alias("d2"), "point_idx")


MOMENT_SQL = "count(*) n, sum(x) sx, sum(y) sy, sum(z) sz, sum(x * x) sxx, sum(x * y) sxy, sum(x * z) sxz, sum(y * y) syy, sum(y * z) syz, sum(z * z) szz"


def fit_sql(source: str, keys: str) -> str:
    """CTEs that turn moments into centre, covariance and ascending eigenvalues."""
    return f"""cv AS (SELECT {keys}, n, sx / n cx, sy / n cy, sz / n cz, sxx / n - (sx / n) * (sx / n) cxx, sxy / n - (sx / n) * (sy / n) cxy, sxz / n - (sx / n) * (sz / n) cxz,
    syy / n - (sy / n) * (sy / n) cyy, syz / n - (sy / n) * (sz / n) cyz, szz / n - (sz / n) * (sz / n) czz FROM {source}),
  e1 AS (SELECT *, (cxx + cyy + czz) / 3 q FROM cv),
  e2 AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) p FROM e1),
  e3 AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN p > 0 THEN ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p) ELSE 0 END))) / 3 phi FROM e2),
  ft AS (SELECT *, q + 2 * p * cos(phi + 2.0943951023931953) l1, q + 2 * p * cos(phi) l3 FROM e3)"""


@query("ag_voxel_moments", f"""WITH m AS (SELECT session, scan_id, vx, vy, vz, {MOMENT_SQL} FROM (SELECT *, {KEY10} FROM v_points) GROUP BY 1, 2, 3, 4, 5), {fit_sql('m', 'session, scan_id, vx, vy, vz')}
  SELECT session, scan_id, vx, vy, vz, n::BIGINT n, {s('cx', 4)} cx, {s('cy', 4)} cy, {s('cz', 4)} cz, {s('cxx', 4)} cxx, {s('cyz', 4)} cyz, {s('l1', 3)} l1, {s('l3', 3)} l3 FROM ft WHERE n > 4""")
def _(v):
    df = voxels.with_plane(voxels.voxel_moments(v.points, 10.0).filter(F.col("n") > 4))
    return df.select(*SCAN, "vx", "vy", "vz", "n", *snapped(["cx", "cy", "cz", "cxx", "cyz"], 4), *snapped(["l1", "l3"], 3))


@query("ag_planes", f"""WITH m AS (SELECT session, scan_id, vx, vy, vz, {MOMENT_SQL} FROM (SELECT *, {KEY10} FROM v_points) GROUP BY 1, 2, 3, 4, 5), {fit_sql('m', 'session, scan_id, vx, vy, vz')}
  SELECT session, scan_id, {s('cx', 4)} cx, {s('cy', 4)} cy, {s('cz', 4)} cz, {s('1.0', 4)} unit FROM ft WHERE n > 4 AND l1 < 1.0""")
def _(v):
    df = pl.plane_points(voxels.voxel_planes(v.points, PLANE), SCAN)
    unit = g.norm(g.cols(["nx", "ny", "nz"]))
    return df.select(*SCAN, *snapped(["cx", "cy", "cz"], 4), snap(unit, 4).alias("unit"))


@query("ag_plane_tree", f"""WITH r AS (SELECT *, {', '.join(f"{key_sql(a, 20.0)} v{a}" for a in 'xyz')} FROM v_points),
  f AS (SELECT *, {', '.join(f"greatest(0, ceil((({a}) / 20.0 - v{a}) * 2) - 1)::BIGINT f{a}" for a in 'xyz')} FROM r),
  m0 AS (SELECT session, scan_id, vx, vy, vz, 0 fx, 0 fy, 0 fz, 0 layer, {MOMENT_SQL} FROM f GROUP BY 1, 2, 3, 4, 5),
  m1 AS (SELECT session, scan_id, vx, vy, vz, fx, fy, fz, 1 layer, {MOMENT_SQL} FROM f GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
  m AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1), {fit_sql('m', 'session, scan_id, vx, vy, vz, fx, fy, fz, layer')},
  g AS (SELECT *, 3 * q - l1 - l3 l2 FROM ft), pn AS (SELECT * FROM g WHERE n > 5 AND l1 < 0.5 AND l2 > 0.01)
  SELECT session, scan_id, layer::INT layer, vx, vy, vz, fx::BIGINT fx, fy::BIGINT fy, fz::BIGINT fz, n::BIGINT n, {s('cx', 4)} cx FROM pn a WHERE layer = 0 OR NOT EXISTS (
    SELECT 1 FROM pn b WHERE b.layer = 0 AND b.session = a.session AND b.scan_id = a.scan_id AND b.vx = a.vx AND b.vy = a.vy AND b.vz = a.vz)""")
def _(v):
    df = voxels.plane_tree(v.points, 20.0, 1, 5, 0.5, keys=SCAN)
    return df.select(*SCAN, "layer", "vx", "vy", "vz", "fx", "fy", "fz", "n", *snapped(["cx"], 4))


@query("ag_plane_covariance")
def _(v):
    pts = v.points.filter(pt.sq_range() > 1)
    df = voxels.plane_covariance(pts, PLANE, 0.02, 0.1)
    return df.select(*SCAN, "vx", "vy", "vz", "n", *snapped([f"p{i}{j}" for i in range(6) for j in range(i, 6)]))


@query("ag_plane_update", f"""WITH k AS (SELECT *, {KEY10} FROM v_points), o AS (SELECT session, vx, vy, vz, {MOMENT_SQL} FROM k WHERE scan_id % 2 = 0 GROUP BY 1, 2, 3, 4),
  w AS (SELECT session, vx, vy, vz, {MOMENT_SQL} FROM k WHERE scan_id % 2 = 1 GROUP BY 1, 2, 3, 4)
  SELECT session, vx, vy, vz, (coalesce(o.n, 0) + CASE WHEN coalesce(w.n, 0) >= 50 THEN w.n ELSE 0 END)::BIGINT n,
  {s('coalesce(o.sx, 0) + CASE WHEN coalesce(w.n, 0) >= 50 THEN w.sx ELSE 0 END', 3)} sx, (CASE WHEN coalesce(w.n, 0) >= 50 THEN 0 ELSE coalesce(w.n, 0) END)::BIGINT pending
  FROM o FULL JOIN w USING (session, vx, vy, vz) WHERE coalesce(o.n, 0) + CASE WHEN coalesce(w.n, 0) >= 50 THEN w.n ELSE 0 END > 0""")
def _(v):
    known = voxels.voxel_moments(v.points.filter(F.col("scan_id") % 2 == 0), 10.0, ["session"])
    df = voxels.update_moments(known, v.points.filter(F.col("scan_id") % 2 == 1), 10.0, 50)
    return df.select("session", "vx", "vy", "vz", "n", snap(F.col("sx"), 3).alias("sx"), "pending")


LSQ_SUMS = "sum(x * x) hxx, sum(x * y) hxy, sum(x * z) hxz, sum(y * y) hyy, sum(y * z) hyz, sum(z * z) hzz, -sum(x) bx, -sum(y) b_y, -sum(z) bz"


def lsq_sql(source: str, keys: str) -> str:
    det = "(hxx * (hyy * hzz - hyz * hyz) - hxy * (hxy * hzz - hyz * hxz) + hxz * (hxy * hyz - hyy * hxz))"
    return f"""ls AS (SELECT {keys}, count(*) n, {LSQ_SUMS} FROM {source} GROUP BY {keys}),
  sl AS (SELECT {keys}, n, (bx * (hyy * hzz - hyz * hyz) - hxy * (b_y * hzz - hyz * bz) + hxz * (b_y * hyz - hyy * bz)) / {det} a0,
    (hxx * (b_y * hzz - hyz * bz) - bx * (hxy * hzz - hyz * hxz) + hxz * (hxy * bz - b_y * hxz)) / {det} a1,
    (hxx * (hyy * bz - b_y * hyz) - hxy * (hxy * bz - b_y * hxz) + bx * (hxy * hyz - hyy * hxz)) / {det} a2 FROM ls WHERE abs({det}) > 1e-12)"""


@query("ag_plane_lsq", f"""WITH k AS (SELECT session, scan_id, vx, vy, vz, x, y, z + 20 z FROM (SELECT *, {KEY10} FROM v_points)), {lsq_sql('k', 'session, scan_id, vx, vy, vz')}
  SELECT session, scan_id, vx, vy, vz, sl.n::BIGINT n, {s('a0')} a0, {s('a1')} a1, {s('a2')} a2, {s('greatest(0.01, avg(abs(a0 * x + a1 * y + a2 * z + 1) / sqrt(a0 * a0 + a1 * a1 + a2 * a2)))', 4)} mean_dist
  FROM k JOIN sl USING (session, scan_id, vx, vy, vz) WHERE sl.n > 3 GROUP BY session, scan_id, vx, vy, vz, sl.n, a0, a1, a2 HAVING max(abs(a0 * x + a1 * y + a2 * z + 1)) <= 0.2""")
def _(v):
    from scanloom.functions.voxel import voxel_keys

    df = v.points.withColumns(voxel_keys(10.0)).withColumn("z", F.col("z") + 20)
    df = pl.plane_lsq(df, [*SCAN, "vx", "vy", "vz"]).filter(F.col("n") > 3)
    return df.select(*SCAN, "vx", "vy", "vz", "n", *snapped(["a0", "a1", "a2"]), *snapped(["mean_dist"], 4))


@query("ag_plane_ransac")
def _(v):
    return pl.plane_ransac(v.points, SCAN, "point_idx", point_block(), distance=0.5).select(*P, "inlier")


@query("ag_ground_estimate")
def _(v):
    df = v.points.withColumn("z", F.col("z") + 20)
    return pl.ground_plane(df, SCAN, "point_idx", point_block(), distance=2.0).select(*SCAN, *snapped(["a0", "a1", "a2"]))


def keyframe_planes(v):
    """Planar voxels of a coarse grid, one key frame per scan."""
    return voxels.voxel_planes(v.points, PLANE)


@query("gr_plane_groups")
def _(v):
    return pl.plane_groups(keyframe_planes(v), SCAN, PLANE).select(*SCAN, "vx", "vy", "vz", "n", "grp")


@query("ag_plane_merge")
def _(v):
    df = pl.merge_planes(keyframe_planes(v), SCAN, PLANE, keep_single=False)
    return df.select(*SCAN, "grp", "n", "parts", *snapped(["cx", "cy", "cz"], 3))


@query("tk_planes")
def _(v):
    df = pl.top_planes(pl.project_planes(keyframe_planes(v), SCAN, PLANE), SCAN, 3)
    return df.select(*SCAN, "plane", "n", *snapped(["cx", "cy", "cz"], 3))


@query("jn_plane_adjacency")
def _(v):
    return pl.plane_adjacency(keyframe_planes(v), SCAN, 0.3)


@query("jn_point_voxel_plane")
def _(v):
    pts = v.points.filter(pt.sq_range() > 1).withColumn("body_range", F.sqrt(pt.sq_range()))
    unc = voxels.plane_covariance(pts, PLANE, 0.02, 0.1).drop("n")
    planes = voxels.voxel_planes(pts, PLANE).join(unc, [*SCAN, "vx", "vy", "vz"])
    df = pl.point_voxel_plane(pts, planes, 10.0, SCAN)
    return df.select(*P, *snapped(["prob", "away"], 4))


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query("jn_radius", f"""SELECT a.session, a.scan_id, a.point_idx a_id, b.point_idx b_id, {s(D2, 5)} d2 FROM v_points a JOIN v_points b USING (session, scan_id) WHERE a.point_idx < b.point_idx AND {D2} < 2.25""")
def _(v):
    return cells.radius_pairs(v.points, SCAN, "point_idx", 1.5).withColumn("d2", snap(F.col("d2"), 5))


@query("jn_knn", f"""SELECT a.session, a.keyframe, a.kp, b.kp near_kp, (row_number() OVER (PARTITION BY a.kp ORDER BY {D2}, b.kp) - 1)::INT AS rank, {s(D2, 5)} d2
  FROM v_keypoints a JOIN v_keypoints b USING (session, keyframe) QUALIFY rank < 5""")
def _(v):
    k = cells.knn(v.keypoints, v.keypoints, ["session", "keyframe"], "kp", "kp", 5, 4.0)
    return k.select("session", "keyframe", "kp", F.col("near.kp").alias("near_kp"), "rank", snap(F.col("d2"), 5).alias("d2"))


@query("jn_nn1", f"""SELECT a.kp, b.kp near_kp, {s(D2, 5)} d2 FROM v_keypoints a JOIN v_keypoints b ON b.session = (a.session + 1) % 3 QUALIFY row_number() OVER (PARTITION BY a.kp ORDER BY {D2}, b.kp) = 1""")
def _(v):
    ref = v.keypoints.withColumn("session", (F.col("session") + 2) % 3)
    k = cells.knn(v.keypoints, ref, ["session"], "kp", "kp", 1, 4.0)
    return k.select("kp", F.col("near.kp").alias("near_kp"), snap(F.col("d2"), 5).alias("d2"))


OTHER = "b.scan_id = a.scan_id AND b.session = (a.session + 1) % 3"


@query("jn_nn_overlap", f"SELECT a.session, a.scan_id, a.point_idx FROM v_points a WHERE EXISTS (SELECT 1 FROM v_points b WHERE {OTHER} AND {D2} < 4)")
def _(v):
    ref = v.points.withColumn("session", (F.col("session") + 2) % 3)
    return cells.within(v.points.select(*P, "x", "y", "z"), ref, SCAN, 2.0).select(*P)


@query("jn_icp_degree", f"""WITH h AS (SELECT a.session, a.scan_id, EXISTS (SELECT 1 FROM v_points b WHERE {OTHER} AND {D2} < 4) hit FROM v_points a)
  SELECT session, scan_id, count(*)::BIGINT n, count(*) FILTER (hit)::BIGINT hits, {s('count(*) FILTER (hit) / count(*)')} degree FROM h GROUP BY 1, 2""")
def _(v):
    ref = v.points.withColumn("session", (F.col("session") + 2) % 3)
    return loops.icp_degree(v.points.select(*P, "x", "y", "z"), ref, SCAN, 2.0).withColumn("degree", snap(F.col("degree")))


@query("ag_rmse", f"""WITH h AS (SELECT a.session, a.scan_id, min({D2}) d2 FROM v_points a JOIN v_points b ON {OTHER} WHERE {D2} < 4 GROUP BY a.session, a.scan_id, a.point_idx)
  SELECT session, scan_id, count(*)::BIGINT n, {s('sqrt(avg(d2))', 5)} rmse FROM h GROUP BY 1, 2""")
def _(v):
    ref = v.points.withColumn("session", (F.col("session") + 2) % 3).withColumnRenamed("point_idx", "rid")
    return loops.nearest_rmse(v.points, ref, SCAN, "point_idx", "rid", 2.0).withColumn("rmse", snap(F.col("rmse"), 5))


@query("jn_nn5_plane")
def _(v):
    near = cells.knn(v.points, v.points, SCAN, "point_idx", "point_idx", 5, 4.0, coarse=True)
    return pl.nn5_plane(near, SCAN, "point_idx", 25.0, 0.5).select(*P, *snapped(["worst"], 4))


@query("ag_mean_residual", f"SELECT session, scan_id, count(*)::BIGINT n, {s('avg(abs(z - 1.8))')} residual FROM v_points WHERE x * x + y * y + z * z > 0 AND 1 - 0.9 * abs(z - 1.8) / sqrt(sqrt(x * x + y * y + z * z)) > 0.9 GROUP BY 1, 2")
def _(v):
    df = v.points.filter(pt.sq_range() > 0).withColumn("r", F.col("z") - 1.8)
    df = df.filter(g.match_confidence(F.col("r"), g.cols("xyz")) > 0.9)
    return df.groupBy(*SCAN).agg(F.count("*").alias("n"), snap(F.avg(F.abs("r"))).alias("residual"))


@query("jn_box_filter", """WITH b AS (SELECT session, min(tx) - 5 x0, min(tx) + 25 x1, min(ty) - 10 y0, min(ty) + 5 y1 FROM v_poses GROUP BY session)
  SELECT p.session, p.scan_id, p.point_idx FROM v_points p JOIN b USING (session) WHERE NOT (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN -1 AND 2)""")
def _(v):
    boxes = v.poses.groupBy("session").agg(F.min("tx").alias("tx"), F.min("ty").alias("ty")).select(
        "session", (F.col("tx") - 5).alias("min_x"), (F.col("tx") + 25).alias("max_x"), (F.col("ty") - 10).alias("min_y"),
        (F.col("ty") + 5).alias("max_y"), F.lit(-1.0).alias("min_z"), F.lit(2.0).alias("max_z"),
    )
    return pt.drop_in_boxes(v.points, boxes, ["session"], 5.0).select(*P)


@query("jn_voxel_neighbour", f"""WITH k AS (SELECT DISTINCT session, scan_id, {KEY5} FROM v_points), o AS (SELECT unnest(range(-1, 2))::BIGINT d)
  SELECT k.session, k.scan_id, k.vx, k.vy, k.vz, count(*)::BIGINT n FROM k CROSS JOIN o a CROSS JOIN o b CROSS JOIN o c JOIN k m ON m.session = k.session AND m.scan_id = k.scan_id AND m.vx = k.vx + a.d AND m.vy = k.vy + b.d AND m.vz = k.vz + c.d
  WHERE abs(a.d) + abs(b.d) + abs(c.d) = 1 GROUP BY 1, 2, 3, 4, 5""")
def _(v):
    from scanloom.functions.voxel import voxel_keys

    vox = v.points.select(*SCAN, *[c.alias(n) for n, c in voxel_keys(5.0).items()]).distinct()
    pairs = cl.voxel_neighbours(vox, SCAN, 1)
    return pairs.filter((F.col("ox") != F.col("vx")) | (F.col("oy") != F.col("vy")) | (F.col("oz") != F.col("vz"))).groupBy(*SCAN, "vx", "vy", "vz").agg(F.count("*").alias("n"))


@query("gr_graph_split", """WITH RECURSIVE e AS (SELECT o_custkey a, o_custkey + 1 + o_orderkey % 3 b FROM orders),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS comp FROM u UNION SELECT u.b, r.comp FROM r JOIN u ON u.a = r.node AND r.comp < u.b)
  SELECT node, min(comp) comp FROM r GROUP BY node""")
def _(v):
    edges = v.table("orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("b"))
    return connected_components(edges).select("node", "comp")

MOVING = "v_points JOIN v_eval USING (session, scan_id, point_idx) WHERE pred >= 251"
VOX4 = "SELECT session, scan_id, vx, vy, vz, count(*) n, ((vx + 1048576) << 42) | ((vy + 1048576) << 21) | (vz + 1048576) node FROM (SELECT session, scan_id, floor(x / 4.0)::BIGINT vx, floor(y / 4.0)::BIGINT vy, floor(z / 4.0)::BIGINT vz FROM {0}) GROUP BY 1, 2, 3, 4, 5"
COMP = """vo AS ({0}), u AS (SELECT a.session, a.scan_id, a.node a, b.node b FROM vo a JOIN vo b ON a.session = b.session AND a.scan_id = b.scan_id AND abs(a.vx - b.vx) <= {1} AND abs(a.vy - b.vy) <= {1} AND abs(a.vz - b.vz) <= {1}
    AND (a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy) + (a.vz - b.vz) * (a.vz - b.vz) <= {1} * {1}),
  r AS (SELECT session, scan_id, node, node AS comp FROM vo UNION SELECT u.session, u.scan_id, u.b, r.comp FROM r JOIN u ON u.session = r.session AND u.scan_id = r.scan_id AND u.a = r.node AND u.b > r.comp),
  lb AS (SELECT session, scan_id, node, min(comp) AS cluster FROM r GROUP BY 1, 2, 3),
  nm AS (SELECT vo.*, lb.cluster, count(*) OVER (PARTITION BY session, scan_id, lb.cluster) voxels FROM vo JOIN lb USING (session, scan_id, node))"""


def moving(v):
    return v.points.join(v.evaluation.filter(F.col("pred") >= 251).select(*P), P)


@query("gr_voxel_cluster", f"WITH RECURSIVE {COMP.format(VOX4.format(MOVING), 1)} SELECT session, scan_id, cluster, vx, vy, vz, n::BIGINT n FROM nm WHERE voxels >= 3")
def _(v):
    return cl.cluster_voxels(moving(v), SCAN, 4.0, 1, 3).select(*SCAN, "cluster", "vx", "vy", "vz", "n")


@query("ag_cluster_box", f"""WITH RECURSIVE {COMP.format(VOX4.format(MOVING), 1)}, b AS (SELECT session, scan_id, cluster, sum(n)::BIGINT n, count(*)::BIGINT voxels, {', '.join(f'min(v{a}) * 4.0 min_{a}, (max(v{a}) + 1) * 4.0 max_{a}' for a in 'xyz')} FROM nm WHERE voxels >= 3 GROUP BY 1, 2, 3)
  SELECT session, scan_id, cluster, n, voxels, {', '.join(s(f'{m}_{a}') + f' {m}_{a}' for m in ('min', 'max') for a in 'xyz')} FROM b WHERE (max_x - min_x > 4.001)::INT + (max_y - min_y > 4.001)::INT + (max_z - min_z > 4.001)::INT >= 2""")
def _(v):
    df = cl.cluster_boxes(cl.cluster_voxels(moving(v), SCAN, 4.0, 1, 3), SCAN, 4.0, 3)
    return df.select(*SCAN, "cluster", "n", "voxels", *snapped([f"{m}_{a}" for m in ("min", "max") for a in "xyz"]))


@query("tk_largest_component", f"""WITH RECURSIVE {COMP.format(VOX4.format(MOVING), 1)}, t AS (SELECT session, scan_id, cluster FROM (SELECT DISTINCT session, scan_id, cluster, voxels FROM nm WHERE voxels >= 3) QUALIFY row_number() OVER (PARTITION BY session, scan_id ORDER BY voxels DESC, cluster) = 1),
  p AS (SELECT session, scan_id, point_idx, floor(x / 4.0)::BIGINT vx, floor(y / 4.0)::BIGINT vy, floor(z / 4.0)::BIGINT vz FROM {MOVING})
  SELECT session, scan_id, point_idx FROM p JOIN nm USING (session, scan_id, vx, vy, vz) JOIN t USING (session, scan_id, cluster)""")
def _(v):
    return cl.largest_component(moving(v), SCAN, 4.0, 1, 3).select(*P)


@query("gr_dbscan", f"""WITH RECURSIVE pr AS (SELECT a.session, a.scan_id, a.point_idx a, b.point_idx b FROM v_points a JOIN v_points b USING (session, scan_id) WHERE {D2} < 9),
  co AS (SELECT session, scan_id, a node FROM pr GROUP BY 1, 2, 3 HAVING count(*) >= 4), ce AS (SELECT pr.* FROM pr JOIN co x ON x.session = pr.session AND x.scan_id = pr.scan_id AND x.node = a JOIN co y ON y.session = pr.session AND y.scan_id = pr.scan_id AND y.node = b),
  r AS (SELECT session, scan_id, node, node AS comp FROM co UNION SELECT ce.session, ce.scan_id, ce.b, r.comp FROM r JOIN ce ON ce.session = r.session AND ce.scan_id = r.scan_id AND ce.a = r.node AND ce.b > r.comp),
  lb AS (SELECT session, scan_id, node, min(comp) AS comp FROM r GROUP BY 1, 2, 3),
  bd AS (SELECT pr.session, pr.scan_id, pr.a node, min(lb.comp) AS comp FROM pr JOIN lb ON lb.session = pr.session AND lb.scan_id = pr.scan_id AND lb.node = pr.b WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.session = pr.session AND co.scan_id = pr.scan_id AND co.node = pr.a) GROUP BY 1, 2, 3)
  SELECT session, scan_id, node point_idx, comp AS cluster, true AS core FROM lb UNION ALL SELECT session, scan_id, node, comp, false FROM bd""")
def _(v):
    return cl.dbscan(v.points, SCAN, "point_idx", 3.0, 4)


@query("ag_cluster_obb")
def _(v):
    vox = cl.cluster_voxels(moving(v), SCAN, 4.0, 1, 3)
    pts = moving(v).withColumns({f"v{a}": F.floor(F.col(a) / 4.0).cast("bigint") for a in "xyz"}).join(vox.drop("n"), [*SCAN, "vx", "vy", "vz"])
    planes = voxels.with_plane(pts.groupBy(*SCAN, "cluster", "vx", "vy", "vz").agg(*voxels.moment_aggs()).filter(F.col("n") > 2))
    normals = planes.select(*SCAN, "cluster", "nx", "ny", "nz", F.col("n").alias("weight"))
    return cl.cluster_obb(pts, normals, [*SCAN, "cluster"]).select(*SCAN, "cluster", *snapped(["min_u", "max_u", "min_s", "max_s"], 3))


@query("gr_cluster_refine")
def _(v):
    pts = v.points.join(v.evaluation.select(*P, (F.col("pred") >= 251).alias("moving")), P)
    return cl.refine_clusters(pts.withColumn("z", F.col("z") + 20), SCAN, "point_idx", point_block(), 4.0, 1, 3, 0.3, ground_distance=0.5)

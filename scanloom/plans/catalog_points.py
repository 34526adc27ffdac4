"""Queries over single points: projections, filters, sources of columns, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.functions import sensor, voxel
from scanloom.operators import evaluate, points as pt, windows as wn
from scanloom.params import DynamicParams
from scanloom.plans.registry import query, s, snap

P = ["session", "scan_id", "point_idx"]
DYN = DynamicParams(hor_res=0.05, ver_res=0.05, rows=63, blind=2.0, ego_y=(-1.6, 1.6), fov_up=30.0)


def snapped(names, digits=6):
    return [snap(F.col(n), digits).alias(n) for n in names]


def sql_snapped(names, digits=6):
    return ", ".join(f"{s(n, digits)} AS {n}" for n in names)


XYZ_SQL = sql_snapped("xyz")

# Rotation of a unit quaternion and its use on a point, as SQL text.
ROT_SQL = {
    "r00": "1 - 2 * (qy * qy + qz * qz)", "r01": "2 * (qx * qy - qz * qw)", "r02": "2 * (qx * qz + qy * qw)",
    "r10": "2 * (qx * qy + qz * qw)", "r11": "1 - 2 * (qx * qx + qz * qz)", "r12": "2 * (qy * qz - qx * qw)",
    "r20": "2 * (qx * qz - qy * qw)", "r21": "2 * (qy * qz + qx * qw)", "r22": "1 - 2 * (qx * qx + qy * qy)",
}
POSE_ROT = "pr AS (SELECT session, scan_id, t, tx, ty, tz, " + ", ".join(f"{v} AS {k}" for k, v in ROT_SQL.items()) + " FROM v_poses)"
WORLD = "wp AS (SELECT p.*, " + ", ".join(
    f"r{i}0 * x + r{i}1 * y + r{i}2 * z + t{a} AS w{a}" for i, a in enumerate("xyz")
) + " FROM v_points p JOIN pr USING (session, scan_id))"
BODY = "bp AS (SELECT p.*, " + ", ".join(
    f"r0{i} * (x - tx) + r1{i} * (y - ty) + r2{i} * (z - tz) AS c{a}" for i, a in enumerate("xyz")
) + " FROM v_points p JOIN pr USING (session, scan_id))"


@query("jn_scan_pose", f"SELECT session, scan_id, point_idx, {sql_snapped(['x', 'tx', 'ty', 'qw'])} FROM v_points JOIN v_poses USING (session, scan_id)")
def _(v):
    return pt.scan_pose(v.points, v.poses).select(*P, *snapped(["x", "tx", "ty", "qw"]))


@query("fn_rigid_transform", f"WITH {POSE_ROT}, {WORLD} SELECT session, scan_id, point_idx, {s('wx')} x, {s('wy')} y, {s('wz')} z FROM wp")
def _(v):
    return pt.to_world(v.points, v.poses).select(*P, *snapped("xyz"))


@query("fn_inverse_transform", f"WITH {POSE_ROT}, {BODY} SELECT session, scan_id, point_idx, {s('cx')} x, {s('cy')} y, {s('cz')} z FROM bp")
def _(v):
    return pt.to_body(v.points, v.poses).select(*P, *snapped("xyz"))


@query("fn_to_key_frame", f"""WITH {POSE_ROT}, {BODY},
  kf AS (SELECT session, scan_id, (rn - 1) // 5 k FROM (SELECT session, scan_id, row_number() OVER (PARTITION BY session ORDER BY scan_id) rn FROM v_poses)),
  fk AS (SELECT session, k, min(scan_id) anchor FROM kf GROUP BY 1, 2 HAVING count(*) = 5),
  kn AS (SELECT *, (row_number() OVER (ORDER BY session, k) - 1)::INT keyframe FROM fk),
  w2 AS (SELECT p.session, p.scan_id, p.point_idx, kn.keyframe, kn.anchor,
    r.r00 * cx + r.r01 * cy + r.r02 * cz + r.tx ux, r.r10 * cx + r.r11 * cy + r.r12 * cz + r.ty uy, r.r20 * cx + r.r21 * cy + r.r22 * cz + r.tz uz
    FROM bp p JOIN kf USING (session, scan_id) JOIN kn USING (session, k) JOIN pr r ON r.session = p.session AND r.scan_id = p.scan_id)
  SELECT w2.session, w2.scan_id, point_idx, keyframe,
    {s('a.r00 * (ux - a.tx) + a.r10 * (uy - a.ty) + a.r20 * (uz - a.tz)', 4)} x,
    {s('a.r01 * (ux - a.tx) + a.r11 * (uy - a.ty) + a.r21 * (uz - a.tz)', 4)} y,
    {s('a.r02 * (ux - a.tx) + a.r12 * (uy - a.ty) + a.r22 * (uz - a.tz)', 4)} z
  FROM w2 JOIN pr a ON a.session = w2.session AND a.scan_id = w2.anchor""")
def _(v):
    frames = wn.key_frames(v.poses, 5)
    return pt.to_key_frame(v.points, v.poses, frames).select(*P, "keyframe", *snapped("xyz", 4))


@query("fn_extrinsic", f"SELECT session, scan_id, point_idx, {s('0.0 - y + 0.5')} x, {s('x - 0.25')} y, {s('z + 1.5')} z FROM v_points")
def _(v):
    return pt.apply_extrinsic(v.points, (0, -1, 0, 1, 0, 0, 0, 0, 1), (0.5, -0.25, 1.5)).select(*P, *snapped("xyz"))


@query("fn_pose_compose", f"""WITH {POSE_ROT} SELECT a.session, a.scan_id,
  {', '.join(s(f'a.r{i}0 * b.r0{j} + a.r{i}1 * b.r1{j} + a.r{i}2 * b.r2{j}') + f' r{i}{j}' for i in range(3) for j in range(3))},
  {', '.join(s(f'a.r{i}0 * b.tx + a.r{i}1 * b.ty + a.r{i}2 * b.tz + a.t{x}') + f' t{x}' for i, x in enumerate('xyz'))}
  FROM pr a JOIN pr b ON a.scan_id = b.scan_id AND b.session = (a.session + 1) % 3""")
def _(v):
    pose = g.with_rotation(v.poses)
    other = pose.select("scan_id", ((F.col("session") + 2) % 3).alias("session"), *[F.col(c).alias("b" + c) for c in (*g.ROT, *g.TRANS)])
    df = pose.join(other, ["session", "scan_id"])
    r, t = g.compose(g.cols(g.ROT), g.cols(g.TRANS), g.cols(g.ROT, "b"), g.cols(g.TRANS, "b"))
    return df.select("session", "scan_id", *[snap(c).alias(n) for c, n in zip((*r, *t), (*g.ROT, *g.TRANS))])


@query("fn_quat_matrix", f"WITH {POSE_ROT} SELECT session, scan_id, {sql_snapped(g.ROT)}, {s('abs(qz)')} qz, {s('abs(qw)')} qw FROM pr JOIN v_poses USING (session, scan_id)")
def _(v):
    df = g.with_rotation(v.poses).drop("qx", "qy", "qz", "qw")
    q = g.quat_from_rotation(g.cols(g.ROT))
    return df.select("session", "scan_id", *snapped(g.ROT), snap(F.abs(q[2])).alias("qz"), snap(F.abs(q[3])).alias("qw"))


EULER = "(SELECT *, yaw * 0.5 roll, yaw * 0.3 pitch FROM v_track)"
EULER_ROT = {
    "r00": "cos(pitch) * cos(yaw)", "r10": "cos(pitch) * sin(yaw)", "r20": "-sin(pitch)",
    "r11": "sin(roll) * sin(pitch) * sin(yaw) + cos(roll) * cos(yaw)", "r12": "cos(roll) * sin(pitch) * sin(yaw) - sin(roll) * cos(yaw)",
    "r21": "sin(roll) * cos(pitch)", "r22": "cos(roll) * cos(pitch)",
}


@query("fn_euler", f"SELECT session, seq, {', '.join(s(e) + ' ' + n for n, e in EULER_ROT.items())}, {s('roll')} roll, {s('pitch')} pitch, {s('yaw')} yaw FROM {EULER}")
def _(v):
    df = v.track.withColumns({"roll": F.col("yaw") * 0.5, "pitch": F.col("yaw") * 0.3})
    r = dict(zip(g.ROT, g.rotation_from_euler(F.col("roll"), F.col("pitch"), F.col("yaw"))))
    back = g.euler_from_rotation(list(r.values()))
    return df.select("session", "seq", *[snap(r[n]).alias(n) for n in EULER_ROT], *[snap(c).alias(n) for c, n in zip(back, ("roll", "pitch", "yaw"))])


@query("fn_so3_exp_log", f"""SELECT session, seq, {s('CASE WHEN yaw <= 1e-7 THEN 1.0 ELSE cos(yaw) END')} r00, {s('CASE WHEN yaw <= 1e-7 THEN 0.0 ELSE sin(yaw) END')} r10,
  {s('0.0')} wx, {s('CASE WHEN yaw <= 1e-7 THEN 0.0 ELSE yaw END')} wz FROM v_track""")
def _(v):
    r = g.so3_exp([F.lit(0.0), F.lit(0.0), F.col("yaw")])
    df = v.track.withColumns(dict(zip(g.ROT, r)))
    w = g.so3_log(g.cols(g.ROT))
    return df.select("session", "seq", *snapped(["r00", "r10"]), snap(w[0]).alias("wx"), snap(w[2]).alias("wz"))


@query("fn_angular_distance", f"""SELECT a.session, a.scan_id, {s('2 * acos(least(1.0::DOUBLE, abs(a.qx * b.qx + a.qy * b.qy + a.qz * b.qz + a.qw * b.qw)))', 4)} angle
  FROM v_poses a JOIN v_poses b ON a.scan_id = b.scan_id AND b.session = (a.session + 1) % 3""")
def _(v):
    other = v.poses.select("scan_id", ((F.col("session") + 2) % 3).alias("session"), *[F.col(c).alias("b" + c) for c in g.QUAT])
    return v.poses.join(other, ["session", "scan_id"]).select(
        "session", "scan_id", snap(g.quat_angle(g.cols(g.QUAT), g.cols(g.QUAT, "b")), 4).alias("angle")
    )


RNG2 = "(x * x + y * y + z * z)"


@query("fn_point_covariance", f"""SELECT session, scan_id, point_idx,
  {', '.join(s(f"{a} * {b} / {RNG2} * 0.0004 + pow(sin(radians(0.1)), 2) * {RNG2} * ({1.0 if a == b else 0.0} - {a} * {b} / {RNG2})", 9) + f' v{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))}
  FROM v_points WHERE {RNG2} > 1""")
def _(v):
    df = v.points.filter(pt.sq_range() > 1)
    cov = g.point_covariance(g.cols("xyz"), 0.02, 0.1)
    return df.select(*P, *[snap(c, 9).alias("v" + n) for c, n in zip(cov, ("xx", "xy", "xz", "yy", "yz", "zz"))])


@query("fn_spherical_project", f"""SELECT *, hor * 63 + ver position FROM (SELECT session, scan_id, point_idx, {s('atan2(y, x)')} azimuth, {s('atan2(z, sqrt(x * x + y * y))')} elevation,
  {s(f'sqrt({RNG2})')} depth, floor((atan2(y, x) + 3.141593::DOUBLE) / 0.05::DOUBLE)::BIGINT hor,
  floor((atan2(z, sqrt(x * x + y * y)) + 0.5 * 3.141593::DOUBLE) / 0.05::DOUBLE)::BIGINT ver FROM v_points)""")
def _(v):
    sph = g.spherical(g.cols("xyz"), 0.05, 0.05, 63)
    return v.points.select(*P, *[snap(sph[n]).alias(n) for n in ("azimuth", "elevation", "depth")], *[sph[n].alias(n) for n in ("hor", "ver", "position")])


def key_sql(c: str, size: float) -> str:
    d = f"({c}) / {size}::DOUBLE"
    return f"trunc(CASE WHEN {d} < 0 THEN {d} - 1 ELSE {d} END)::BIGINT"


@query("fn_voxel_key", f"""SELECT session, scan_id, point_idx, {', '.join(f"{key_sql(a, 5.0)} v{a}" for a in 'xyz')},
  {', '.join(f"floor(({a} + 60) / 5.0)::BIGINT g{a}" for a in 'xyz')} FROM v_points""")
def _(v):
    return v.points.select(*P, *[c.alias(n) for n, c in voxel.voxel_keys(5.0).items()],
                           *[c.alias(n) for n, c in voxel.floor_keys(5.0, (-60.0,) * 3, names=("gx", "gy", "gz")).items()])


@query("fn_voxel_decode", f"""SELECT session, scan_id, point_idx, ix * 640 + iy * 16 + iz cell, {s('-60 + ix * 5.0')} x, {s('-60 + iy * 5.0')} y, {s('-10 + iz * 5.0')} z FROM (
  SELECT *, floor((x + 60) / 5.0)::BIGINT ix, floor((y + 60) / 5.0)::BIGINT iy, floor((z + 10) / 5.0)::BIGINT iz FROM v_points)""")
def _(v):
    keys = voxel.floor_keys(5.0, (-60.0, -60.0, -10.0))
    df = v.points.select(*P, voxel.grid_index(list(keys.values()), 40, 16).alias("cell"))
    corner = voxel.grid_decode(F.col("cell"), 5.0, 40, 16, (-60.0, -60.0, -10.0))
    return df.select(*P, "cell", *[snap(c).alias(n) for c, n in zip(corner, "xyz")])


@query("fn_label_bits", """SELECT session, scan_id, point_idx, (label & 65535)::INT id, ((label & 65535) // 1000)::INT cls,
  ((label & 65535) >= 251 AND (label & 65535) < 65535) AS is_dyn FROM v_eval""")
def _(v):
    ident = sensor.semantic_id(F.col("label"))
    return v.evaluation.select(*P, ident.alias("id"), sensor.object_class(ident).alias("cls"), sensor.is_dynamic(ident).alias("is_dyn"))


MAP_SQL = ", ".join(f"({a}, {b})" for a, b in evaluate.CLASS_MAP.items())


@query("fn_class_remap", f"""WITH m(src, dst) AS (VALUES {MAP_SQL}), e AS (SELECT session, scan_id, point_idx, ((label // 1000) % 33)::INT cls FROM v_eval)
  SELECT session, scan_id, point_idx, cls, dst::INT mapped FROM e JOIN m ON e.cls = m.src""")
def _(v):
    df = v.evaluation.select(*P, (F.floor(F.col("label") / 1000) % 33).cast("int").alias("cls"))
    return evaluate.class_remap(df)


@query("fn_sensor_time", """WITH p AS (SELECT event_id, (event_id % 5)::INT stamp_type, epoch_us(ts) * 1000 rcv,
    CASE WHEN event_id % 5 = 3 THEN (((event_id * 7919) % 3600000000) * 4294967296)::BIGINT + 24 + 256 * (1 + event_id % 12) + 65536 * (1 + event_id % 28) + 16777216 * (event_id % 24)
    ELSE event_id * 1000 END stamp FROM events)
  SELECT event_id, CASE WHEN stamp_type = 4 THEN stamp + rcv WHEN stamp_type IN (0, 1) THEN stamp
    WHEN stamp_type = 3 THEN (epoch_us(make_timestamp(2024, 1 + event_id % 12, 1 + event_id % 28, event_id % 24, 0, 0.0)) + (event_id * 7919) % 3600000000) * 1000
    ELSE 0 END::BIGINT AS ns FROM p""")
def _(v):
    e = F.col("event_id")
    gps = F.shiftleft((e * 7919) % 3600000000, 32) + 24 + 256 * (1 + e % 12) + 65536 * (1 + e % 28) + 16777216 * (e % 24)
    df = v.table("events").select(
        "event_id", (e % 5).cast("int").alias("stamp_type"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("rcv"),
        F.when(e % 5 == 3, gps).otherwise(e * 1000).alias("stamp"),
    )
    return df.select("event_id", sensor.sensor_time_ns(F.col("stamp"), F.col("stamp_type"), F.col("rcv")).alias("ns"))


@query("fn_point_time", f"SELECT session, scan_id, point_idx, {s('t + offset_ns / 1e9', 4)} pt FROM v_points JOIN v_poses USING (session, scan_id)")
def _(v):
    df = v.points.join(v.poses, ["session", "scan_id"])
    return df.select(*P, snap(F.col("t") + F.col("offset_ns") / 1e9, 4).alias("pt"))


@query("fn_match_confidence", f"SELECT session, scan_id, point_idx, {s(f'1 - 0.9 * abs(z - 1.5) / sqrt(sqrt({RNG2}))')} c FROM v_points WHERE 1 - 0.9 * abs(z - 1.5) / sqrt(sqrt({RNG2})) > 0.9 AND {RNG2} > 0")
def _(v):
    df = v.points.filter(pt.sq_range() > 0).withColumn("c", g.match_confidence(F.col("z") - 1.5, g.cols("xyz")))
    return df.filter(F.col("c") > 0.9).select(*P, snap(F.col("c")).alias("c"))


@query("flt_blind_range", f"SELECT session, scan_id, point_idx FROM v_points WHERE {RNG2} >= 400")
def _(v):
    return pt.drop_blind(v.points, 400.0).select(*P)


@query("flt_blind_sphere", f"SELECT session, scan_id, point_idx FROM v_points WHERE {RNG2} < 4.0 OR (abs(x) < 0.1 AND abs(y) < 1.0 AND abs(z) < 0.1)")
def _(v):
    return v.points.filter(pt.is_invalid(DynamicParams(blind=2.0, near_axis_box=True))).select(*P)


BOX_SQL = " OR ".join(
    "(" + " AND ".join(f"{a} / 20 > {lo} AND {a} / 20 < {hi}" for a, (lo, hi) in zip("xyz", box)) + ")" for box in pt.EGO_BOXES
).replace("z / 20", "z / 4 - 1.1")


@query("flt_ego_boxes", f"SELECT session, scan_id, point_idx FROM v_points WHERE {BOX_SQL}")
def _(v):
    df = v.points.withColumns({"x": F.col("x") / 20, "y": F.col("y") / 20, "z": F.col("z") / 4 - 1.1})
    return df.filter(pt.in_ego_boxes()).select(*P)


@query("flt_ego_rect", "SELECT session, scan_id, point_idx FROM v_points WHERE NOT (x > -1.5 AND x < 2.5 AND y > -1.6 AND y < 1.6)")
def _(v):
    return v.points.filter(~pt.in_ego_rect(DYN)).select(*P)


PIXEL = "floor((atan2(y, x) + 3.141593::DOUBLE) / 0.05::DOUBLE)::BIGINT hor, floor((atan2(z, sqrt(x * x + y * y)) + 0.5 * 3.141593::DOUBLE) / 0.05::DOUBLE)::BIGINT ver"


@query("flt_fov_pixels", f"""SELECT session, scan_id, point_idx FROM (SELECT *, {PIXEL} FROM v_points)
  WHERE ver <= {DYN.ver_pixel(30.0)} AND ver > {DYN.ver_pixel(-23.0)} AND hor <= {DYN.hor_pixel(180.0)} AND hor >= {DYN.hor_pixel(-180.0)}""")
def _(v):
    sph = g.spherical(g.cols("xyz"), 0.05, 0.05, 63)
    return v.points.withColumns({"hor": sph["hor"], "ver": sph["ver"]}).filter(pt.in_fov(DYN)).select(*P)


@query("flt_fov_cone", f"SELECT session, scan_id, point_idx FROM v_points WHERE {RNG2} < 0.4 * 4 OR (x <= 30 AND (sqrt({RNG2}) <= 1e-4 OR acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x / greatest(sqrt({RNG2}), 1e-12)))) <= 0.8 + 0.0175))")
def _(v):
    return v.points.filter(pt.in_fov_cone((0, 0, 0), (1, 0, 0), 0.8, 30.0, 2.0)).select(*P)


_CORNERS = [(0, 0, 0)] + [(i, j, k) for i in (-0.5, 0.5) for j in (-0.5, 0.5) for k in (-0.5, 0.5)]


def _corner_sql(dx, dy, dz):
    v = [f"((\"b{a}\" + {o}) * 8.0 - t{a})" for a, o in zip("xyz", (dx, dy, dz))]
    l2 = f"({v[0]} * {v[0]} + {v[1]} * {v[1]} + {v[2]} * {v[2]})"
    along = f"({v[0]} * ax + {v[1]} * ay)"
    return f"({l2} < 0.4 * 64 OR ({along} <= 20 AND acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {along} / greatest(sqrt({l2}), 1e-12)))) <= 0.6 + 0.0175))"


@query("flt_fov_boxes", f"""WITH q AS (SELECT session, scan_id, tx, ty, tz, 1 - 2 * qz * qz ax, 2 * qz * qw ay, floor(tx / 8.0 + 0.5)::BIGINT hx, floor(ty / 8.0 + 0.5)::BIGINT hy, floor(tz / 8.0 + 0.5)::BIGINT hz FROM v_poses),
  o AS (SELECT unnest(range(-3, 4))::BIGINT d),
  b AS (SELECT q.*, hx + a.d AS bx, hy + c.d AS "by", hz + e.d AS bz FROM q CROSS JOIN o a CROSS JOIN o c CROSS JOIN o e)
  SELECT session, scan_id, bx, "by", bz FROM b WHERE {' OR '.join(_corner_sql(*c) for c in _CORNERS)}""")
def _(v):
    sensors = v.poses.select(
        "session", "scan_id", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"),
        (1 - 2 * F.col("qz") * F.col("qz")).alias("ax"), (2 * F.col("qz") * F.col("qw")).alias("ay"), F.lit(0.0).alias("az"),
    )
    return pt.cubes_in_cone(sensors, 0.6, 20.0, 8.0).select("session", "scan_id", "bx", "by", "bz")


@query("flt_sensor_tag", "SELECT session, scan_id, point_idx FROM v_points WHERE line < 6 AND (tag & 48) = 16")
def _(v):
    return v.points.filter(pt.good_return(6)).select(*P)


@query("flt_colour", "SELECT session, scan_id, point_idx, coalesce(r, 255)::INT r, g, b FROM v_points WHERE coalesce(r, 255) <> 0 AND g <> 0 AND b <> 0")
def _(v):
    return pt.keep_coloured(v.points).select(*P, F.col("r").cast("int").alias("r"), F.col("g").cast("int").alias("g"), F.col("b").cast("int").alias("b"))


@query("prj_session_colour", "SELECT session, scan_id, point_idx, (CASE session WHEN 0 THEN 255 ELSE 0 END)::INT r, (CASE session WHEN 1 THEN 255 ELSE 0 END)::INT g, (CASE session WHEN 2 THEN 255 ELSE 0 END)::INT b FROM v_points")
def _(v):
    return pt.session_colour(v.points).select(*P, "r", "g", "b")


LIFT = f"(atan2(z, sqrt({RNG2})) + radians(0.15))"


@query("prj_calibrate_elevation", f"""SELECT session, scan_id, point_idx, {s(f'sqrt({RNG2}) * cos({LIFT}) * cos(atan2(y, x))')} x,
  {s(f'sqrt({RNG2}) * cos({LIFT}) * sin(atan2(y, x))')} y, {s(f'sqrt({RNG2}) * tan({LIFT})')} z FROM v_points""")
def _(v):
    return v.points.select(*P, *[snap(c).alias(n) for c, n in zip(g.calibrate_elevation(g.cols("xyz")), "xyz")])


@query("prj_unroll_azimuth", f"""SELECT session, scan_id, point_idx, sector,
  {s('sqrt(x * x + y * y) * cos(atan2(y, x) + (sector + 1) * 0.01)')} x, {s('sqrt(x * x + y * y) * sin(atan2(y, x) + (sector + 1) * 0.01)')} y
  FROM (SELECT *, floor((atan2(y, x) + 3.2) / 0.1)::BIGINT sector FROM v_points)""")
def _(v):
    return pt.unroll_azimuth(v.points, -3.2, 0.1, 0.01).select(*P, "sector", *snapped("xy"))


@query("prj_match_class", """SELECT session, scan_id, point_idx, (CASE WHEN id >= 251 AND id < 65535 AND pred >= 251 THEN 10 WHEN id >= 251 AND id < 65535 THEN 20 WHEN pred >= 251 THEN 30 ELSE 0 END)::INT code
  FROM (SELECT *, label & 65535 id FROM v_eval)""")
def _(v):
    return v.evaluation.select(*P, pt.match_class(sensor.semantic_id(F.col("label")), F.col("pred")).alias("code"))


@query("so_union_map", f"SELECT session, count(*)::BIGINT n, {s('sum(x)', 3)} sx FROM v_points GROUP BY session")
def _(v):
    parts = [v.points.filter(F.col("session") == k) for k in range(3)]
    return pt.union_map(parts).groupBy("session").agg(F.count("*").alias("n"), snap(F.sum("x"), 3).alias("sx"))


@query("so_except_dynamic", """SELECT p.session, p.scan_id, p.point_idx FROM v_points p WHERE NOT EXISTS (
  SELECT 1 FROM v_points d JOIN v_eval e USING (session, scan_id, point_idx) WHERE e.pred >= 251 AND d.session = p.session AND d.x = p.x AND d.y = p.y AND d.z = p.z)""")
def _(v):
    moving = v.points.join(v.evaluation.filter(F.col("pred") >= 251).select(*P), P, "left_semi")
    return pt.except_points(v.points, moving, ["session"]).select(*P)


@query("jn_exact_anti", """SELECT p.session, p.scan_id, p.point_idx FROM v_points p WHERE NOT EXISTS (
  SELECT 1 FROM v_points d WHERE d.line = 7 AND d.x = p.x AND d.y = p.y AND d.z = p.z)""")
def _(v):
    return pt.except_points(v.points, v.points.filter(F.col("line") == 7)).select(*P)


@query("so_split_labels", "SELECT (pred >= 251) AS moving, count(*)::BIGINT n FROM v_eval GROUP BY 1")
def _(v):
    still, moving = pt.split_labels(v.evaluation.withColumn("dyn", F.col("pred") >= 251), "dyn")
    return still.unionByName(moving).groupBy(F.col("dyn").alias("moving")).agg(F.count("*").alias("n"))


@query("jn_label_pred", "SELECT session, scan_id, point_idx, label, CASE WHEN pred <> 30 THEN pred END::INT pred FROM v_eval")
def _(v):
    # Ids repeat in large tables, so label and prediction of a row share its number among them as well.
    e = evaluate.numbered_copies(v.evaluation)
    return evaluate.label_pred(e.select(*P, "copy", "label"), e.filter(F.col("pred") != 30).select(*P, "copy", "pred"), [*P, "copy"]).drop("copy")


OUT_SQL = """o AS (SELECT *, CASE WHEN id >= 251 AND id < 65535 AND pred >= 251 THEN 'tp' WHEN id >= 251 AND id < 65535 AND pred = 9 THEN 'fn'
  WHEN id < 251 AND pred >= 251 THEN 'fp' WHEN id < 251 AND pred = 9 THEN 'tn' WHEN id >= 65535 AND pred >= 251 THEN 'op' END oc FROM (SELECT *, label & 65535 id FROM v_eval))"""


@query("ag_confusion", f"""WITH {OUT_SQL}, c AS (SELECT session, scan_id, {', '.join(f"count(*) FILTER (oc = '{k}')::BIGINT {k}" for k in ('tp', 'fn', 'fp', 'op', 'tn'))} FROM o GROUP BY ROLLUP (session, scan_id))
  SELECT session, scan_id, tp, fn, fp, op, tn, {s('tp / (tp + fn + fp)')} iou, {s('(fn + tn) / (tp + fn + fp + tn)')} suppress FROM c""")
def _(v):
    return evaluate.confusion(v.evaluation).withColumns({"iou": snap(F.col("iou")), "suppress": snap(F.col("suppress"))})


@query("ag_suppress_rate", f"WITH {OUT_SQL} SELECT session, {s('''count(*) FILTER (oc IN ('fn', 'tn')) / count(*) FILTER (oc IN ('tp', 'fn', 'fp', 'tn'))''')} suppress FROM o GROUP BY session")
def _(v):
    counts = evaluate.with_outcome(v.evaluation).groupBy("session").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fn", "fp", "tn")])
    return evaluate.with_rates(counts).select("session", snap(F.col("suppress")).alias("suppress"))


@query("ag_confusion_matrix", """SELECT pred, count(*) FILTER (lab = 0)::BIGINT "0", count(*) FILTER (lab = 1)::BIGINT "1", count(*) FILTER (lab = 2)::BIGINT "2"
  FROM (SELECT CASE pred WHEN 251 THEN 2 WHEN 9 THEN 1 ELSE 0 END pred, CASE WHEN (label & 65535) >= 251 THEN 2 WHEN (label & 65535) = 9 THEN 1 ELSE 0 END lab FROM v_eval) GROUP BY pred""")
def _(v):
    return evaluate.confusion_matrix(_three_class(v), [0, 1, 2])


def _three_class(v):
    ident = sensor.semantic_id(F.col("label"))
    return v.evaluation.select(
        F.when(F.col("pred") == 251, 2).when(F.col("pred") == 9, 1).otherwise(0).alias("pred"),
        F.when(ident >= 251, 2).when(ident == 9, 1).otherwise(0).alias("label"),
    )


@query("ag_class_iou", f"""WITH e AS (SELECT CASE pred WHEN 251 THEN 2 WHEN 9 THEN 1 ELSE 0 END pred, CASE WHEN (label & 65535) >= 251 THEN 2 WHEN (label & 65535) = 9 THEN 1 ELSE 0 END lab FROM v_eval)
  SELECT c::INT cls, count(*) FILTER (pred = c AND lab = c)::BIGINT tp, count(*) FILTER (pred = c AND lab <> c)::BIGINT fp, count(*) FILTER (pred <> c AND lab = c)::BIGINT fn,
  {s('count(*) FILTER (pred = c AND lab = c) / (count(*) FILTER (pred = c OR lab = c) + 1e-15)')} iou FROM e CROSS JOIN (VALUES (0), (1), (2)) t(c) WHERE lab <> 0 GROUP BY c""")
def _(v):
    return evaluate.class_iou(_three_class(v), [0]).withColumn("iou", snap(F.col("iou")))


RECALL_SQL = """r AS (SELECT session, scan_id, id AS object, count(*) n, count(*) FILTER (pred >= 251) hits, (id // 1000)::INT cls, count(*) FILTER (pred >= 251) / count(*) recall
  FROM (SELECT *, (label & 65535)::INT id FROM v_eval) WHERE id >= 251 AND id < 65535 GROUP BY session, scan_id, id)"""


@query("ag_object_recall", f"WITH {RECALL_SQL} SELECT session, scan_id, object, n::BIGINT n, hits::BIGINT hits, cls, {s('recall')} recall FROM r")
def _(v):
    return evaluate.object_recall(v.evaluation).withColumn("recall", snap(F.col("recall")))


@query("ag_class_recall", f"WITH {RECALL_SQL} SELECT cls, count(*)::BIGINT objects, {s('avg(recall)')} mean_recall, {s('avg(recall * recall) - avg(recall) * avg(recall)')} var_recall FROM r GROUP BY cls")
def _(v):
    df = evaluate.class_recall(evaluate.object_recall(v.evaluation))
    return df.withColumns({c: snap(F.col(c)) for c in ("mean_recall", "var_recall")})


@query("ag_recall_octiles", f"""WITH {RECALL_SQL}, gr(grp, cls) AS (VALUES ('vehicle', 1), ('vehicle', 2), ('vehicle', 3), ('vehicle', 6), ('pedestrian', 4), ('cyclist', 6)),
  o AS (SELECT grp, recall, row_number() OVER (PARTITION BY grp ORDER BY recall) - 1 i, count(*) OVER (PARTITION BY grp) n FROM r JOIN gr USING (cls))
  SELECT grp, max(n)::BIGINT n, {s('max(recall) FILTER (i = n // 8)')} q1, {s('max(recall) FILTER (i = n // 2)')} q2, {s('max(recall) FILTER (i = n * 7 // 8)')} q3 FROM o GROUP BY grp""")
def _(v):
    df = evaluate.recall_octiles(evaluate.object_recall(v.evaluation))
    return df.withColumns({c: snap(F.col(c)) for c in ("q1", "q2", "q3")})


@query("ag_dynamic_count", "SELECT session, scan_id, count(*) FILTER (id > 251 AND id < 260)::BIGINT AS dynamic FROM (SELECT session, scan_id, 248 + (label & 65535) % 14 id FROM v_eval) GROUP BY 1, 2")
def _(v):
    return evaluate.dynamic_count(v.evaluation.withColumn("label", 248 + sensor.semantic_id(F.col("label")) % 14))


@query("jn_semantic_gate", "SELECT session, scan_id, point_idx, (CASE WHEN pred >= 251 AND (label & 65535) < 40 THEN 251 ELSE 9 END)::INT gated FROM v_eval")
def _(v):
    return evaluate.semantic_gate(v.evaluation, "label").select(*P, "gated")

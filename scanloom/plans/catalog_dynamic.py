"""Queries on range images, moving points, streams, tracks, poses and sinks."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import clusters as cl, dynamic as dy, posegraph as pg, windows as wn
from scanloom.operators.ordered import block_of
from scanloom.params import CaseParams, DynamicParams, PoseGraphParams, TrackParams
from scanloom.plans.catalog_cells import COMP, MOVING, SCAN, VOX4, moving
from scanloom.plans.catalog_points import P, POSE_ROT, snapped
from scanloom.plans.catalog_windows import point_block
from scanloom.plans import scene_sql as sq
from scanloom.plans.registry import query, s, snap
from scanloom.session import cut
from scanloom.sources import packets as pk, sinks
from scanloom.streaming import sensor as st, tracks as tk

WIDE = CaseParams(v_min=0.5, acc=200.0, map_depth=0.2, map_hor=0.05, map_ver=0.05, occ_depth=0.15, occ_hor=0.1, occ_ver=0.1,
                  cons_depth=3.0, cons_depth_max=5.0, cons_hor=0.1, cons_ver=0.1, min_times=2)
DYN = DynamicParams(hor_res=0.1, ver_res=0.05, rows=64, max_maps=3, ego_boxes=False, fov_up=60.0, near_hor=0.1, near_ver=0.1, interp_hor=0.2,
                    interp_ver=0.1, case2=WIDE, case3=WIDE)


def local_points(v):
    """Sensor-frame points of a level field of view and poses that stay in place."""
    scans = v.poses.select(*SCAN, "t", *[F.lit(0.0).alias(c) for c in g.TRANS], *[F.lit(0.0).alias(c) for c in ("qx", "qy", "qz")], F.lit(1.0).alias("qw"))
    return v.points.select(*P, "x", "y", "z"), scans


def prepared(v):
    """Images and probes of the moving sensor."""
    return dy.Prepared(v.points.select(*P, "x", (F.col("y") + sq.SHIFT).alias("y"), "z"), v.poses, DYN, keep=False)


IMAGE = """im AS (SELECT session, scan_id, point_idx, sqrt(x * x + y * y + z * z) depth, floor((atan2(y, x) + 3.141593::DOUBLE) / 0.1::DOUBLE)::BIGINT hor, floor((atan2(z, sqrt(x * x + y * y)) + 0.5 * 3.141593::DOUBLE) / 0.05::DOUBLE)::BIGINT ver
  FROM v_points WHERE NOT (x * x + y * y + z * z < 0.3 * 0.3)),
  cp AS (SELECT *, row_number() OVER (PARTITION BY session, scan_id, hor, ver ORDER BY point_idx) rn FROM im), px AS (SELECT session, scan_id, hor, ver, count(*) n, min(depth) lo, max(depth) hi FROM cp WHERE rn <= 50 GROUP BY 1, 2, 3, 4)"""


def scan_image(v):
    """One image per scan, all points static."""
    d = dy.project(dy.to_global(*local_points(v), DYN).withColumns({"m_" + c: F.lit(1.0 if c in ("r00", "r11", "r22") else 0.0) for c in (*g.ROT, *g.TRANS)}), DYN)
    d = wn.arrival_cap(d, [*SCAN, "hor", "ver"], ["point_idx"], 50)
    return d.withColumn("static", F.lit(True))


@query("ag_range_image", f"WITH {IMAGE} SELECT session, scan_id, hor, ver, n::BIGINT n, {s('lo')} min_all, {s('hi')} max_all, {s('lo')} min_static FROM px")
def _(v):
    px = dy.range_image(scan_image(v), SCAN)
    return px.select(*SCAN, "hor", "ver", "n", *snapped(["min_all", "max_all", "min_static"]))


@query("ag_vertical_support", f"WITH {IMAGE} SELECT session, scan_id, hor, min(ver) low, max(ver) high FROM px WHERE ver BETWEEN {DYN.ver_pixel(-23.0)} AND {DYN.ver_pixel(60.0)} GROUP BY 1, 2, 3")
def _(v):
    return dy.vertical_support(dy.range_image(scan_image(v), SCAN), DYN, SCAN)


@query("ag_neighbour_depth", f"""WITH {IMAGE}, o AS (SELECT unnest([-1, 0, 1]) v) SELECT p.session, p.scan_id, p.hor, p.ver, {s('min(q.lo)')} near_lo, {s('max(q.hi)')} near_hi FROM px p CROSS JOIN o a CROSS JOIN o b
  JOIN px q ON q.session = p.session AND q.scan_id = p.scan_id AND q.hor = p.hor + a.v AND q.ver = p.ver + b.v GROUP BY 1, 2, 3, 4""")
def _(v):
    px = dy.range_image(scan_image(v), SCAN).withColumns({"map_id": F.col("scan_id"), "upto": F.col("scan_id")})
    return _neighbours(px).select("session", "scan_id", "hor", "ver", *snapped(["near_lo", "near_hi"]))


def _neighbours(px):
    probe = px.select(*dy.MAP, "scan_id", F.col("hor").alias("point_hor"), F.col("ver").alias("point_ver"), "hor", "ver")
    out = dy.neighbour_depth(probe, px, 1, [*dy.MAP, "scan_id", "point_hor", "point_ver"])
    return out.withColumnRenamed("point_hor", "hor").withColumnRenamed("point_ver", "ver")


@query("jn_pixel_window", f"""WITH {IMAGE}, o AS (SELECT unnest([-1, 0, 1]) v), k AS (SELECT * FROM cp WHERE rn <= 50)
  SELECT p.session, p.scan_id, p.point_idx, count(*)::BIGINT n FROM k p CROSS JOIN o a CROSS JOIN o b JOIN k q ON q.session = p.session AND q.scan_id = p.scan_id AND q.hor = p.hor + a.v AND q.ver = p.ver + b.v
  WHERE abs(p.depth - q.depth) < 2 GROUP BY 1, 2, 3""")
def _(v):
    from scanloom.operators.cells import window_join

    im = scan_image(v)
    right = im.select(*SCAN, F.col("hor").alias("r_hor"), F.col("ver").alias("r_ver"), F.col("depth").alias("o_d"))
    hits = window_join(im.select(*P, "hor", "ver", "depth"), right, SCAN, 1, 1).filter(F.abs(F.col("depth") - F.col("o_d")) < 2)
    return hits.groupBy(*P).agg(F.count("*").alias("n"))


@query("dl_case1_enter", f"WITH {sq.scene(DYN)}, {sq.entered(DYN)} SELECT {sq.POINT}, map_id FROM e1")
def _(v):
    d = prepared(v)
    _, pixels = d.image(None)
    return dy.case1_enter(d.probe, pixels, DYN).select(*P, "map_id")


@query("dl_case1_reject", f"WITH {sq.scene(DYN)}, {sq.entered(DYN)}, {sq.rejected(DYN)} SELECT {sq.POINT}, map_id FROM r1")
def _(v):
    d = prepared(v)
    image, pixels = d.image(None)
    return dy.case1_near(dy.case1_enter(d.probe, pixels, DYN), image, DYN).select(*P, "map_id")


@query("ag_depth_interp")
def _(v):
    d = prepared(v)
    image, pixels = d.image(None)
    return dy.interpolated_depth(cut(dy.case1_enter(d.probe, pixels, DYN)), image, DYN).select(*P, "map_id", snap(F.col("interp"), 4).alias("interp"))


@query("dl_case1")
def _(v):
    d = prepared(v)
    image, pixels = d.image(None)
    return dy.case1(d.probe, image, pixels, DYN)


def _case(name, approach):
    case = "case3" if approach else "case2"

    @query(f"dl_{name}_enter", f"WITH {sq.scene(DYN)}, {sq.case_entered(WIDE, approach)} SELECT {sq.POINT}, map_id FROM ce")
    def _(v):
        d = prepared(v)
        _, pixels = d.image(None)
        return dy.case_enter(d.probe.filter(F.col("age") == 0), pixels, getattr(DYN, case), approach).select(*P, "map_id")

    newest = "nw AS MATERIALIZED (SELECT * FROM pb WHERE age = 0)"

    @query(f"dl_{name}_consistent", f"WITH {sq.scene(DYN)}, {newest}, {sq.case_consistent(WIDE, DYN, approach, 'nw', 'cc')} SELECT {sq.POINT}, map_id FROM cc")
    def _(v):
        d = prepared(v)
        image, pixels = d.image(None)
        return dy.case_consistent(d.probe.filter(F.col("age") == 0), image, pixels, DYN, getattr(DYN, case), approach).select(*P, "map_id")

    @query(f"dl_{name}_search", f"WITH {sq.scene(DYN)}, {newest}, {sq.occluding(WIDE, approach, True, 'nw', 'oc', 'p.session, p.scan_id, p.point_idx, p.map_id')} SELECT {sq.POINT}, map_id, o_scan, o_pid FROM oc")
    def _(v):
        d = prepared(v)
        image, pixels = d.image(None)
        return dy.occluders(d.probe.filter(F.col("age") == 0), image, pixels, DYN, getattr(DYN, case), approach, True).select(*P, "map_id", "o_scan", "o_pid")

    @query(f"dl_{name}", f"WITH {sq.chain(WIDE, DYN, approach)}")
    def _(v):
        d = prepared(v)
        image, pixels = d.image(None)
        return dy.case_chain(d.probe, d.glob, d.maps, image, pixels, DYN, getattr(DYN, case), approach)


_case("case2", False)
_case("case3", True)


@query("ag_depth_consistency", f"WITH {sq.scene(DYN)}, {sq.consistent_depth(WIDE, DYN)} SELECT session, map_id, o_scan, o_pid FROM dc")
def _(v):
    d = prepared(v)
    image, _ = d.image(None)
    return dy.depth_consistent(image, image.select(*dy.MAP, "scan_id", "point_idx"), DYN, WIDE).select("session", "map_id", "o_scan", "o_pid")


_DIR = "atan2(y, x) az, atan2(z, sqrt(x * x + y * y)) el, sqrt(x * x + y * y + z * z) d"


@query("dl_case2_clean", f"""WITH lb AS (SELECT session, scan_id, point_idx, (1 + point_idx % 3)::INT kind FROM v_eval WHERE pred >= 251),
  pt AS MATERIALIZED (SELECT session, scan_id, point_idx, {_DIR} FROM v_points), st AS (SELECT * FROM pt ANTI JOIN lb USING (session, scan_id, point_idx)), mv AS (SELECT pt.* FROM pt JOIN lb USING (session, scan_id, point_idx) WHERE kind = 2)
  SELECT {sq.POINT}, kind FROM lb WHERE NOT EXISTS (SELECT 1 FROM mv JOIN st ON st.session = mv.session AND st.scan_id = mv.scan_id WHERE mv.session = lb.session AND mv.scan_id = lb.scan_id AND mv.point_idx = lb.point_idx
    AND mv.d > st.d + {2 * WIDE.occ_depth} AND abs(mv.az - st.az) < {WIDE.occ_hor} AND abs(mv.el - st.el) < {WIDE.occ_ver})""")
def _(v):
    labels = v.evaluation.filter("pred >= 251").select(*P, (1 + F.col("point_idx") % 3).cast("int").alias("kind"))
    return dy.case2_clean(v.points, labels, DYN, WIDE)


@query("gr_dynamic_label")
def _(v):
    # Images three seconds old keep the chain of labels that depend on labels short.
    return dy.label_points(v.points.select(*P, "x", (F.col("y") + sq.SHIFT).alias("y"), "z"), v.poses, replace(DYN, max_maps=2, min_maps=1, case1_interp=False, buffer_delay=3.0))


@query("dl_from_labels", "SELECT session, scan_id, point_idx FROM v_points JOIN v_eval USING (session, scan_id, point_idx) WHERE pred >= 251")
def _(v):
    return moving(v).select(*P)


@query("dl_velocity", f"SELECT session, seq, abs(ty - tx) < t * 0.0002 AS steady FROM v_track")
def _(v):
    return v.track.select("session", "seq", (F.abs(F.col("ty") - F.col("tx")) < F.col("t") * 0.0002).alias("steady"))


BOX_T = f"{COMP.format(VOX4.format(MOVING), 1)}, b AS (SELECT session, scan_id, cluster, {', '.join(f'min(v{a}) * 4.0 min_{a}, (max(v{a}) + 1) * 4.0 max_{a}' for a in 'xyz')} FROM nm WHERE voxels >= 3 GROUP BY 1, 2, 3)"
_IOU = " * ".join(f"(least(a.max_{x}, b.max_{x}) - greatest(a.min_{x}, b.min_{x}))" for x in "xyz")
_OV = " AND ".join(f"least(a.max_{x}, b.max_{x}) > greatest(a.min_{x}, b.min_{x})" for x in "xyz")


def _vol(k):
    return " * ".join(f"({k}.max_{x} - {k}.min_{x})" for x in "xyz")


def boxes(v):
    vox = cl.cluster_voxels(moving(v), SCAN, 4.0, 1, 3)
    return cl.cluster_boxes(vox, SCAN, 4.0, 1)


@query("jn_track_iou", f"""WITH RECURSIVE {BOX_T} SELECT a.session, a.scan_id, a.cluster, b.cluster o_cluster, {s(f'{_IOU} / ({_vol("a")} + {_vol("b")} - {_IOU})')} iou FROM b a JOIN b ON b.session = a.session AND b.scan_id = a.scan_id - 1 WHERE {_OV}""")
def _(v):
    b = cut(boxes(v))
    before = b.withColumn("scan_id", F.col("scan_id") + 1)
    return tk.iou_pairs(b, before, SCAN, 16.0).withColumn("iou", snap(F.col("iou")))


EDGES = """ed AS (SELECT scan_id * 3 + session src, scan_id * 3 + session + 3 dst FROM v_poses WHERE (scan_id, session) IN (SELECT scan_id - 1, session FROM v_poses))"""


def graph(v):
    """Odometry edges of all sessions and a loop edge from each scan to its neighbour session."""
    odo = wn.odometry_edges(v.poses)
    odo = odo.select((F.col("src") * 3 + F.col("session")).cast("bigint").alias("src"), (F.col("dst") * 3 + F.col("session")).cast("bigint").alias("dst"), *pg.POSE)
    pose = g.with_rotation(v.poses)
    other = pose.filter(F.col("session") == 0).select("scan_id", *[F.col(c).alias("b" + c) for c in pg.POSE])
    loop = pose.filter(F.col("session") > 0).join(other, "scan_id")
    r, t = g.between(g.cols(g.ROT, "b"), g.cols(g.TRANS, "b"), g.cols(g.ROT), g.cols(g.TRANS))
    # one sub-frame a key frame: frame k is node k + 1
    loop = loop.select((F.col("scan_id") * 3 - 1).cast("bigint").alias("db_keyframe"), (F.col("scan_id") * 3 + F.col("session") - 1).cast("bigint").alias("keyframe"), *[c.alias(n) for n, c in zip(pg.POSE, (*r, *t))])
    return pg.pose_edges(odo, loop, 1, PoseGraphParams(odometry_variance=0.01)), pose


@query("gr_pose_edges", f"""WITH {POSE_ROT}, pp AS (SELECT *, scan_id * 3 + session node, lag(scan_id) OVER (PARTITION BY session ORDER BY scan_id) * 3 + session pn FROM pr),
  ee AS (SELECT pn src, node dst, false robust FROM pp WHERE pn IS NOT NULL UNION ALL SELECT scan_id * 3, node, true FROM pp WHERE session > 0 AND scan_id IN (SELECT scan_id FROM pr WHERE session = 0))
  SELECT src::BIGINT src, dst::BIGINT dst, robust, {', '.join(s(f'a.r0{i} * (b.tx - a.tx) + a.r1{i} * (b.ty - a.ty) + a.r2{i} * (b.tz - a.tz)', 4) + f' t{c}' for i, c in enumerate('xyz'))} FROM ee JOIN pp a ON a.node = src JOIN pp b ON b.node = dst""")
def _(v):
    edges, _pose = graph(v)
    return edges.select("src", "dst", "robust", *snapped(g.TRANS, 4))


@query("gr_pose_refine")
def _(v):
    edges, pose = graph(v)
    nodes = pose.select((F.col("scan_id") * 3 + F.col("session")).cast("bigint").alias("node"), *g.ROT, (F.col("tx") + F.col("session") * 0.05).alias("tx"), "ty", "tz", (F.col("scan_id") == 0).alias("anchor"))
    out, left = pg.pose_refine(nodes, edges, PoseGraphParams(), 1, 4)
    return out.select("node", *snapped(g.TRANS, 3), F.lit(float(left)).alias("residual"))


@query("gr_session_align")
def _(v):
    a = g.with_rotation(v.poses)
    b = a.select("scan_id", F.col("session").alias("map_session"), *[F.col(c).alias("b" + c) for c in pg.POSE])
    df = a.join(b, "scan_id").filter(F.col("map_session") < F.col("session"))
    r, t = g.between(g.cols(g.ROT, "b"), g.cols(g.TRANS, "b"), g.cols(g.ROT), g.cols(g.TRANS))
    return pg.session_align(df.select("session", "map_session", *[c.alias(n) for n, c in zip(pg.POSE, (*r, *t))])).select("session", *snapped(g.TRANS, 3))


@query("st_delay", "SELECT session, seq FROM v_stream WHERE 1704100000 - t >= 10 - 0.1 / 2.0")
def _(v):
    return st.visible(v.stream.withColumn("now", F.lit(1704100000.0)), "now", "t", 10.0, 0.1).select("session", "seq")


@query("st_align", "SELECT session, to_timestamp((t_us // 60000000) * 60)::TIMESTAMP AS start, count(*)::BIGINT packets FROM v_stream GROUP BY 1, 2")
def _(v):
    return st.align(v.stream, "ts", "60 seconds", ["session"])


@query("st_late", """WITH q AS (SELECT session, seq, CASE WHEN value < lag(value) OVER (PARTITION BY session ORDER BY seq) - 300 THEN 1 ELSE 0 END b FROM v_stream) SELECT session, seq, sum(b) OVER (PARTITION BY session ORDER BY seq)::INT run FROM q""")
def _(v):
    return st.restart_sessions(v.stream, ["session"], "seq", "value", block_of(F.col("seq")), 300.0).select("session", "seq", "run")


@query("st_gap_fill", """WITH q AS (SELECT session, t_us, lag(t_us) OVER (PARTITION BY session ORDER BY t_us) p FROM v_stream), f AS (SELECT session, unnest(range(p + 20000000, t_us, 20000000)) t_us FROM q WHERE t_us - p > 60000000)
  SELECT session, t_us, false AS zero FROM v_stream UNION ALL SELECT session, t_us, true FROM f""")
def _(v):
    return st.gap_fill(v.stream, ["session"], "t_us", 20000000, 60000000, 6e9)


@query("st_clock_offset", f"""WITH s AS (SELECT session, min(t) m FROM v_stream WHERE event_type = 'view' GROUP BY session), i AS (SELECT session, min(t) m FROM v_stream WHERE event_type = 'error' GROUP BY session)
  SELECT x.session, x.seq, {s('x.t + (s.m - i.m)', 3)} t FROM v_stream x JOIN s USING (session) JOIN i USING (session) WHERE x.event_type = 'error'""")
def _(v):
    scans, imu = v.stream.filter(F.col("event_type") == "view"), v.stream.filter(F.col("event_type") == "error")
    return st.clock_offset(scans, imu, ["session"]).select("session", "seq", snap(F.col("t"), 3).alias("t"))


def run_stream(v, build, source: str):
    """Run a stream over one driver table to its end and read the table it wrote."""
    spark = v.spark
    from scanloom.session import _checkpoint_dir

    _checkpoint_dir(spark)
    base = os.path.join(spark.sparkContext.getCheckpointDir(), f"stream-{uuid.uuid4().hex}")
    stream = spark.readStream.schema(v.table(source).schema).option("pathGlobFilter", f"{source}.parquet").parquet(v.folder)
    out = build(stream)
    q = out.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(base + "/out")


EPOCHS = """RECURSIVE q AS (SELECT (user_id % 8)::INT session, epoch_us(ts) / 1000000.0::DOUBLE t FROM events),
  e AS (SELECT session, min(t) st, 0::BIGINT epoch FROM q GROUP BY session UNION ALL SELECT e.session, min(q.t), e.epoch + 1 FROM e JOIN q ON q.session = e.session AND q.t - e.st >= 120 GROUP BY e.session, e.epoch)"""


@query("st_epochs", f"WITH {EPOCHS} SELECT q.session, {s('q.t', 3)} t, e.epoch, greatest(e.epoch - 4, 0)::BIGINT oldest FROM q ASOF JOIN e ON q.session = e.session AND q.t >= e.st")
def _(v):
    def build(stream):
        pts = stream.select((F.col("user_id") % 8).cast("int").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"))
        return st.epoch_stream(pts, 120.0, 5)

    return run_stream(v, build, "events").select("session", snap(F.col("t"), 3).alias("t"), "epoch", "oldest")


def landed(v, df, name: str, files: int = 1) -> str:
    """Folder with the rows of ``df`` for a stream to read: one file, or as many as a shuffle has tasks."""
    from scanloom.session import _checkpoint_dir, dealt

    _checkpoint_dir(v.spark)
    path = os.path.join(v.spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")
    (dealt(df) if files > 1 else df.repartition(1)).write.parquet(path)
    return path


def drained(v, stream):
    """Run a stream to its end and read the table it wrote."""
    base = landed(v, v.spark.range(0), "drain")
    q = stream.writeStream.format("parquet").option("path", base + "-out").option("checkpointLocation", base + "-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(base + "-out")


@query("st_sync", """SELECT a.session, a.seq, b.seq sample FROM v_stream a JOIN v_stream b ON a.session = b.session WHERE a.event_type = 'view' AND b.event_type = 'error' AND b.ts > a.ts - INTERVAL 60 SECOND AND b.ts <= a.ts""")
def _(v):
    c = F.col
    scans = v.stream.filter(c("event_type") == "view").select("session", "seq", (c("ts").cast("timestamp") - F.expr("INTERVAL 60 SECONDS")).alias("start_ts"), c("ts").cast("timestamp").alias("end_ts"))
    imu = v.stream.filter(c("event_type") == "error").select("session", c("seq").alias("sample"), c("ts").cast("timestamp").alias("imu_ts"))
    left, right = ((landed(v, df, "sync", 3), df.schema) for df in (scans, imu))
    streams = [v.spark.readStream.schema(schema).parquet(path) for path, schema in (left, right)]
    return drained(v, st.sync(*streams, "session", "400 days")).select("session", "seq", "sample")


@query("src_stream_scans", f"SELECT session::SMALLINT lidar_id, scan_id::BIGINT * 100000000 + offset_ns t_ns, {', '.join(s(f'{c}::FLOAT::DOUBLE', 3) + ' ' + c for c in 'xyz')}, (point_idx % 200)::SMALLINT reflectivity, tag::SMALLINT tag, line::SMALLINT line FROM v_points")
def _(v):
    c = F.col
    point = F.struct(
        c("offset_ns").cast("bigint").alias("offset_time"), *[c(a).cast("float").alias(a) for a in "xyz"],
        (c("point_idx") % 200).cast("smallint").alias("reflectivity"), c("tag").cast("smallint").alias("tag"), c("line").cast("smallint").alias("line"),
    )
    messages = v.points.groupBy(*SCAN).agg(F.collect_list(point).alias("points")).select(
        F.timestamp_seconds(c("scan_id") * 0.1).alias("ts"), (c("scan_id").cast("bigint") * 100000000).alias("timebase"), F.size("points").cast("bigint").alias("point_num"),
        c("session").cast("smallint").alias("lidar_id"), "points",
    )
    df = drained(v, st.scan_stream(v.spark, landed(v, messages, "messages", 3)))
    return df.select("lidar_id", "t_ns", *[snap(c(a).cast("double"), 3).alias(a) for a in "xyz"], "reflectivity", "tag", "line")


def box_stream(v):
    def build(stream):
        c = F.col
        x, y = c("user_id") % 5 * 4.0 + F.unix_micros(c("ts").cast("timestamp")) / 6e7 % 10, c("user_id") % 3 * 4.0
        b = stream.select((c("user_id") % 8).cast("int").alias("session"), (F.floor(F.unix_micros(c("ts").cast("timestamp")) / 6e7) * 0.02).alias("t"), c("event_id").alias("cluster"),
                          x.alias("min_x"), (x + 2).alias("max_x"), y.alias("min_y"), (y + 2).alias("max_y"), F.lit(0.0).alias("min_z"), F.lit(2.0).alias("max_z"))
        return st.track_stream(b, TrackParams())

    return run_stream(v, build, "events")


@query("st_tracks")
def _(v):
    return box_stream(v).select("session", "track", "status", *snapped(["t", "x", "y"], 3))


@query("st_track_predict")
def _(v):
    p = TrackParams(steps=5)
    last = box_stream(v).groupBy("session", "track").agg(F.max(F.struct("t", "x", "y", "z", "vx", "vy", "vz")).alias("l")).select("session", "track", "l.*")
    return tk.predicted_positions(last, p).select("session", "track", *snapped(["t", "x"], 3))


PK = "pq AS (SELECT l_orderkey seq, l_linenumber i, round(l_extendedprice * 100)::BIGINT % 20000 px, l_quantity::INT * 100 py FROM lineitem)"


@query("src_packets", f"""SELECT seq, point_idx, seq * 100000 t_ns, (point_idx // 2) * 10000 offset_ns, {s('0.5 - px / 1000')} x, {s('py / 1000 + 0.25')} y, 0.0::DOUBLE z, 1::SMALLINT reflectivity
  FROM (SELECT l_orderkey seq, l_suppkey % 100 px, l_quantity::INT * 100 + 1 py, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT point_idx FROM lineitem)""")
def _(v):
    c = F.col
    point = F.struct((c("l_quantity").cast("int") * 100 + 1).alias("x"), (c("l_suppkey") % 100).cast("int").alias("y"), F.lit(0).alias("z"), F.lit(1).cast("smallint").alias("reflectivity"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", point.alias("p"))
    packets = v.table("lineitem").groupBy(c("l_orderkey").alias("seq")).agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r.p).alias("payload"))
    packets = packets.withColumns({"lidar_id": F.lit(0), "stamp": c("seq") * 100000, "stamp_type": F.lit(0), "time_rcv": F.lit(0).cast("bigint")})
    df = pk.packet_points(packets, 10000, 2, (0, -1, 0, 1, 0, 0, 0, 0, 1), (0.5, 0.25, 0.0))
    return df.select("seq", "point_idx", "t_ns", "offset_ns", *snapped(["x", "y"]), "z", "reflectivity")

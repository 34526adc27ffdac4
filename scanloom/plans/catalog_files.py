"""Queries that write a file format and read it back with the library's reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.plans.catalog_points import P, POSE_ROT, snapped
from scanloom.plans.catalog_sinks import scratch
from scanloom.plans.registry import query, s
from scanloom.sources import poses, scans, sinks

ORDER = "row_number() OVER (PARTITION BY session ORDER BY scan_id)"
QUAT = ["t", *g.TRANS, *g.QUAT]
MATRIX = [*g.ROT, *g.TRANS]


def lines_of(v, columns, separator: str = " "):
    """One text line per pose."""
    df = g.with_rotation(v.poses)
    return df.select("session", "scan_id", F.concat_ws(separator, *[F.col(c).cast("string") for c in columns]).alias("value"))


def read_back(v, name: str, columns, reader, separator: str = " "):
    path = scratch(v, name)
    sinks.write_session_files(lines_of(v, columns, separator), path)
    return reader(v.spark, path)


def columns_sql(names, source: str) -> str:
    return ", ".join(s(c) + " " + c for c in names) + f" FROM {source}"


@query("src_pose_evo", f"SELECT session, {ORDER}::INT scan_id, {columns_sql(QUAT, 'v_poses')}")
def _(v):
    return read_back(v, "evo", QUAT, poses.read_evo).select("session", "scan_id", *snapped(QUAT))


@query("src_pose_csv", f"SELECT session, {ORDER}::INT scan_id, {columns_sql(QUAT, 'v_poses')}")
def _(v):
    df = read_back(v, "csv", ["t", *g.TRANS, "qw", "qx", "qy", "qz"], poses.read_csv_quat, ",")
    return df.select("session", "scan_id", *snapped(QUAT))


@query("src_pose_mat_time", f"WITH {POSE_ROT} SELECT session, {ORDER}::INT scan_id, {columns_sql(['t', *MATRIX], 'pr')}")
def _(v):
    return read_back(v, "times", ["t", *poses.MATRIX], poses.read_csv_matrix, ",").select("session", "scan_id", *snapped(["t", *MATRIX]))


@query("src_pose_mat_frame", f"WITH {POSE_ROT} SELECT session, scan_id, {columns_sql(MATRIX, 'pr')}")
def _(v):
    return read_back(v, "frames", ["scan_id", *poses.MATRIX], poses.read_frame_matrix).select("session", "scan_id", *snapped(MATRIX))


@query("src_pose_kitti", f"WITH {POSE_ROT} SELECT session, {ORDER}::INT - 1 scan_id, {columns_sql(MATRIX, 'pr')}")
def _(v):
    return read_back(v, "lines", poses.MATRIX, poses.read_kitti).select("session", "scan_id", *snapped(MATRIX))


@query("src_pose_per_file", f"""WITH {POSE_ROT}, f AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY session ORDER BY scan_id) = 1)
  SELECT o.session, o.scan_id, {', '.join(s(f'f.r0{i} * (o.tx - f.tx) + f.r1{i} * (o.ty - f.ty) + f.r2{i} * (o.tz - f.tz)', 5) + f' t{a}' for i, a in enumerate('xyz'))},
  {', '.join(s(f'f.r0{i} * o.r0{j} + f.r1{i} * o.r1{j} + f.r2{i} * o.r2{j}', 5) + f' r{i}{j}' for i in range(3) for j in range(3))} FROM pr o JOIN f USING (session)""")
def _(v):
    path = scratch(v, "single")
    one = lines_of(v, [*poses.MATRIX]).withColumn("value", F.concat("value", F.lit(" 0 0 0 1")))
    sinks.write_pose_files(one, path)
    return poses.read_pose_per_file(v.spark, path).select("session", "scan_id", *snapped(MATRIX, 5))


LOOP = "frame_id, x, y, z, is_loop, match_id, overlap"


@query("src_loop_gt", f"""SELECT o_orderkey::INT frame_id, {s('o_totalprice / 100', 4)} x, {s('o_custkey / 10', 4)} y, 0.5::DOUBLE z, (o_custkey % 2)::INT is_loop, (o_orderkey - o_custkey % 50)::INT match_id, {s('(o_custkey % 100) / 100', 4)} overlap FROM orders""")
def _(v):
    c = F.col
    path = scratch(v, "truth")
    rows = v.table("orders").select(
        c("o_orderkey").cast("int").alias("frame_id"), (c("o_totalprice") / 100).alias("x"), (c("o_custkey") / 10).alias("y"), F.lit(0.5).alias("z"),
        (c("o_custkey") % 2).cast("int").alias("is_loop"), (c("o_orderkey") - c("o_custkey") % 50).cast("int").alias("match_id"), (c("o_custkey") % 100 / 100).alias("overlap"),
    )
    rows.write.csv(path)
    return poses.read_loop_truth(v.spark, path).select("frame_id", *snapped(["x", "y"], 4), "z", "is_loop", "match_id", *snapped(["overlap"], 4))


@query("src_scans", f"""SELECT session, scan_id, row_number() OVER (PARTITION BY session, scan_id ORDER BY point_idx) - 1 point_idx,
  {', '.join(s(f'{c}::FLOAT::DOUBLE', 3) + ' ' + c for c in ('x', 'y', 'z', 'intensity'))} FROM v_points""")
def _(v):
    path = scratch(v, "scans")
    sinks.write_scan_files(v.points, path)
    df = scans.read_scans(v.spark, path, "part-*.txt")
    return df.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "z", "intensity")}).select(*P, *snapped(["x", "y", "z", "intensity"], 3))


@query("snk_labels", "SELECT session, scan_id, point_idx, (CASE WHEN pred >= 251 THEN 251 ELSE 9 END)::INT label FROM v_eval")
def _(v):
    path = scratch(v, "labels")
    sinks.write_labels(sinks.label_codes(v.evaluation.withColumn("dyn", F.col("pred") >= 251), "dyn").select(*P, "label"), path)
    return v.spark.read.schema("scan_id INT, point_idx BIGINT, label INT, session INT").parquet(path).select(*P, "label")


@query("snk_pose_matrix", f"WITH {POSE_ROT} SELECT session, {', '.join(s(c, 4) + ' ' + c for c in MATRIX)} FROM pr")
def _(v):
    path = scratch(v, "matrix")
    sinks.write_pose_matrix(v.poses, path)
    cells = F.split("value", " ")
    lines = v.spark.read.schema("value STRING, session INT").text(path)
    return lines.select("session", *[cells[poses.MATRIX.index(n)].cast("double").alias(n) for n in MATRIX]).select("session", *snapped(MATRIX, 4))


@query("snk_odom", "SELECT session, scan_id, tx::FLOAT tx, ty::FLOAT ty, tz::FLOAT tz FROM v_poses")
def _(v):
    path = scratch(v, "odometry")
    sinks.write_odometry(v.poses, path)
    return v.spark.read.parquet(path)

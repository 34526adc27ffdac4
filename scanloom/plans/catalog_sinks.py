"""Queries that write a table, read it back and compare, and the remaining stream queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import dynamic as dy, posegraph as pg, windows as wn
from scanloom.operators.cells import nearest_capped
from scanloom.plans.catalog_cells import MERGED, SCAN, merged_map
from scanloom.plans.catalog_dynamic import box_stream, drained, landed, prepared
from scanloom.plans.catalog_points import P, snapped
from scanloom.plans.registry import query, s, snap
from scanloom.params import TrackParams
from scanloom.session import _checkpoint_dir
from scanloom.sources import sinks
from scanloom.streaming import sensor


def scratch(v, name: str) -> str:
    """A fresh folder next to the checkpoints, shared by all executors."""
    _checkpoint_dir(v.spark)
    return os.path.join(v.spark.sparkContext.getCheckpointDir(), f"{name}-{uuid.uuid4().hex}")


@query("snk_scan_points", f"SELECT session, scan_id, point_idx, {s('x')} x FROM v_points")
def _(v):
    path = scratch(v, "points")
    sinks.write_scan_points(v.points.select(*P, "x", "y", "z"), path)
    return v.spark.read.schema("scan_id INT, point_idx BIGINT, x DOUBLE, session INT").parquet(path).select(*P, *snapped("x"))


@query("snk_merged_map", MERGED)
def _(v):
    path = scratch(v, "map")
    sinks.write_merged_map(merged_map(v).select("*"), path)
    df = v.spark.read.parquet(path)
    return df.withColumns({c: snap(F.col(c)) for c in ("x", "y", "z", "intensity")})


@query("snk_trajectory", f"SELECT {s('t', 3)} t, {s('tx', 3)} tx, {s('ty', 3)} ty, {s('qw', 3)} qw FROM v_poses")
def _(v):
    path = scratch(v, "trajectory")
    sinks.write_trajectory(v.poses, path)
    cells = F.split("value", " ")
    names = ["t", *g.TRANS, *g.QUAT]
    return v.spark.read.text(f"{path}/truth").select(*[snap(cells[names.index(n)].cast("double"), 3).alias(n) for n in ("t", "tx", "ty", "qw")])


@query("snk_point_log", f"SELECT {s('offset_ns / 1e9', 4)} t, {s('x', 4)} x, 9::INT label FROM v_points")
def _(v):
    path = scratch(v, "log")
    sinks.write_point_log(v.points.select((F.col("offset_ns") / 1e9).alias("t"), "x", "y", "z", F.lit(9).alias("label")), path)
    df = v.spark.read.schema("t DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE, label INT").csv(path, sep=" ")
    return df.select(*snapped("tx", 4), "label")


@query("snk_imu_log", f"SELECT {s('t', 3)} t, {s('value', 3)} ax FROM v_stream")
def _(v):
    path = scratch(v, "imu")
    sinks.write_imu_log(v.stream.select("t", *[F.col("value").alias(a) for a in ("ax", "ay", "az", "gx", "gy", "gz")]), path)
    df = v.spark.read.schema("t DOUBLE, ax DOUBLE, ay DOUBLE, az DOUBLE, gx DOUBLE, gy DOUBLE, gz DOUBLE").csv(path, sep=" ")
    return df.select(snap(F.col("t"), 3).alias("t"), snap(F.col("ax"), 3).alias("ax"))


@query("snk_map_chunks", "SELECT event_type, count(*)::BIGINT n FROM events GROUP BY 1")
def _(v):
    path = scratch(v, "chunks")
    stream = v.spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    q = stream.writeStream.foreachBatch(sinks.map_chunk_writer(path)).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("src_stream_imu", f"SELECT session, seq, {s('t + 0.25', 3)} t FROM v_stream")
def _(v):
    rows = v.stream.select("session", "seq", "t")
    stream = sensor.imu_stream(v.spark, landed(v, rows, "imu", 3), "session INT, seq BIGINT, t DOUBLE", 0.25)
    return drained(v, sensor.drop_late(stream.withColumn("ts", F.timestamp_seconds("t")), "ts", "400 days")).select("session", "seq", snap(F.col("t"), 3).alias("t"))


@query("st_sliding", """WITH rk AS (SELECT session, scan_id, row_number() OVER (PARTITION BY session ORDER BY scan_id) rn FROM v_poses)
  SELECT a.session, b.rn AS "window", a.scan_id FROM rk a JOIN rk b ON a.session = b.session AND b.rn BETWEEN a.rn AND a.rn + 4""")
def _(v):
    return wn.sliding_windows(v.poses, 5)


@query("st_local_map")
def _(v):
    return wn.local_map(v.track, "seq", 60.0, 15.0, 1.2).select("session", "seq", "moved")


@query("jn_track_assign")
def _(v):
    return box_stream(v).filter(F.col("status").startswith("MATCHED")).groupBy("session", "track").agg(F.count("*").alias("matches"))


@query("st_track_expiry")
def _(v):
    p = TrackParams()
    rows = box_stream(v)
    end = rows.groupBy("session").agg(F.max("t").alias("now"))
    last = rows.groupBy("session", "track").agg(F.max("t").alias("seen")).join(end, "session")
    return last.select("session", "track", (F.col("now") - F.col("seen") <= p.step * p.steps).alias("alive"))


@query("ag_depth_interp4")
def _(v):
    d = prepared(v)
    image, _ = d.image(None)
    return dy.four_neighbour_depth(d.probe.filter(F.col("age") == 0), image, 2, 2).select(*P, snap(F.col("interp4"), 4).alias("interp4"))


@query("gr_plane_adjust")
def _(v):
    ref = v.points.withColumn("session", (F.col("session") + 2) % 3).withColumnRenamed("point_idx", "rid")
    pairs = nearest_capped(v.points, ref, SCAN, "point_idx", "rid", 3.0, carry=True)
    away = F.greatest(F.sqrt(F.col("near.x") ** 2 + F.col("near.y") ** 2 + F.col("near.z") ** 2), F.lit(1e-9))
    eye = {f"{k}{c}": F.lit(1.0 if c in ("r00", "r11", "r22") else 0.0) for k in "ab" for c in pg.POSE}
    pairs = pairs.select(*SCAN, *[F.col(a).alias("p" + a) for a in "xyz"], *[F.col(f"near.{a}").alias("q" + a) for a in "xyz"], *[(F.col(f"near.{a}") / away).alias("n" + a) for a in "xyz"]).withColumns(eye)
    out = pg.plane_adjust(pairs, SCAN)
    return out.select(*SCAN, "n", snap(F.col("cost"), 3).alias("cost"), *[snap(F.col("step")[i], 3).alias(f"step{i}") for i in range(3)])

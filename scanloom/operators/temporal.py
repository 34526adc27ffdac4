"""Joins on time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators.ordered import asof, block_of, neighbour, row_number


def nearest_time(
    probe: DataFrame, ref: DataFrame, keys: Sequence[str], probe_t: str, ref_t: str, ref_seq: str,
    take: Sequence[str] = (), limit: float = 1e10, width: float = 60.0,
) -> DataFrame:
    """Nearest ref by absolute time difference below ``limit``; the earlier row wins ties."""
    once = ref.groupBy(*keys, ref_t).agg(F.min(F.struct(ref_seq, *take)).alias("_r")).select(*keys, ref_t, "_r.*")
    df = asof(probe, once, keys, probe_t, ref_t, [ref_seq, *take], width)
    before, after = F.abs(F.col(probe_t) - F.col("prev.t")), F.abs(F.col("next.t") - F.col(probe_t))
    use_prev = F.col("next").isNull() | (before < after) | ((before == after) & (F.col(f"prev.{ref_seq}") <= F.col(f"next.{ref_seq}")))
    df = df.withColumn("near", F.when(F.col("prev").isNotNull() & use_prev, F.col("prev")).otherwise(F.col("next"))).drop("prev", "next")
    df = df.withColumn("dt", F.abs(F.col(probe_t) - F.col("near.t")))
    return df.filter(F.col("dt") < limit)


def fifo_pair(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str,
    left_block: Column | None = None, right_block: Column | None = None,
) -> DataFrame:
    """n-th left row with n-th right row."""
    a = row_number(left, keys, [left_order], block_of(F.col(left_order)) if left_block is None else left_block)
    b = row_number(right, keys, [right_order], block_of(F.col(right_order)) if right_block is None else right_block)
    return a.join(b, [*keys, "rn"])


def imu_interval(imu: DataFrame, scans: DataFrame, keys: Sequence[str], imu_t: str, end_t: str, scan: str, width: float = 60.0) -> DataFrame:
    """Each IMU sample goes to the first scan that ends at or after it.

    A scan is released only when a sample at or after its end exists.
    """
    last = imu.groupBy(*keys).agg(F.max(imu_t).alias("_last"))
    ready = scans.join(last, list(keys)).filter(F.col("_last") >= F.col(end_t)).drop("_last")
    df = asof(imu, ready, keys, imu_t, end_t, [scan], width)
    return df.filter(F.col("next").isNotNull()).withColumn(scan, F.col(f"next.{scan}")).drop("prev", "next")


IMU_POSE = [*g.ROT, *g.TRANS, "velx", "vely", "velz"]


def point_imu_pose(points: DataFrame, imu_poses: DataFrame, width: float = 0.01) -> DataFrame:
    """Give each point the last IMU pose strictly before its time, with the next pose's rates.

    ``points`` has (session, scan_id, offset_s), ``imu_poses`` has (session, scan_id, offset_s,
    rotation, position, velocity, acc*, gyr*). The last pose of a scan only closes an interval.
    """
    keys = ["session", "scan_id"]
    rates = ["accx", "accy", "accz", "gyrx", "gyry", "gyrz"]
    poses = neighbour(imu_poses, keys, "offset_s", block_of(F.col("offset_s"), 1.0), rates, 1, "tail")
    heads = poses.filter(F.col("tail").isNotNull())
    heads = heads.select(*keys, "offset_s", *IMU_POSE, *[F.col("tail." + r).alias(r) for r in rates])
    return asof(points, heads, keys, "offset_s", "offset_s", [*IMU_POSE, *rates], width, strict=True).drop("next")


def undistort(
    points: DataFrame, imu_poses: DataFrame, ends: DataFrame,
    lidar_rotation: Sequence[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1), lidar_translation: Sequence[float] = (0, 0, 0),
) -> DataFrame:
    """Move every point into the frame at the end of its scan.

    ``ends`` holds the end pose per scan (rotation and position). A point without an
    earlier pose stays as it is.
    """
    df = point_imu_pose(points, imu_poses)
    end_cols = [*g.ROT, *g.TRANS]
    df = df.join(ends.select("session", "scan_id", *[F.col(c).alias("e_" + c) for c in end_cols]), ["session", "scan_id"])
    keep = df.columns
    df = df.withColumn("_dt", F.col("offset_s") - F.col("prev.t"))
    dt = F.col("_dt")
    df = df.withColumns({"_w" + x: F.col("prev.gyr" + x) * dt for x in "xyz"})
    turn = [f"_m{i}" for i in range(9)]
    df = df.withColumns(dict(zip(turn, g.so3_exp(g.cols(["_wx", "_wy", "_wz"])))))
    lr, lt = [F.lit(float(v)) for v in lidar_rotation], [F.lit(float(v)) for v in lidar_translation]
    p = [F.col(c).cast("double") for c in "xyz"]
    df = df.withColumns(dict(zip(("_lx", "_ly", "_lz"), g.rigid(lr, lt, p))))
    df = df.withColumns(dict(zip(("_tx", "_ty", "_tz"), g.mat_vec(g.cols(turn), g.cols(["_lx", "_ly", "_lz"])))))
    shift = [
        F.col("prev." + a) + F.col("prev.vel" + x) * dt + 0.5 * F.col("prev.acc" + x) * dt * dt - F.col("e_" + a)
        for a, x in zip(g.TRANS, "xyz")
    ]
    world = g.add(g.mat_vec(g.cols(g.ROT, "prev."), g.cols(["_tx", "_ty", "_tz"])), shift)
    df = df.withColumns(dict(zip(("_ux", "_uy", "_uz"), world)))
    body = g.mat_vec(g.transpose(g.cols(g.ROT, "e_")), g.cols(["_ux", "_uy", "_uz"]))
    out = g.mat_vec(g.transpose(lr), g.sub(body, lt))
    keep = [c for c in keep if c not in ("prev", *["e_" + c for c in end_cols])]
    moved = {n: F.when(F.col("prev").isNull(), v).otherwise(o) for n, v, o in zip("xyz", p, out)}
    return df.withColumns(moved).select(*keep)

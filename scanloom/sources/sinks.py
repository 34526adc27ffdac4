"""Sinks: every writer is distributed; text formats are built from Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.functions.voxel import voxel_keys
from scanloom.operators.evaluate import DYNAMIC_LABEL, STATIC_LABEL
from scanloom.session import dealt, shuffle_tasks

SCAN = ["session", "scan_id"]
#: Tasks move their own files into place; else the driver moves them all, one by one, after the last task.
BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def label_codes(df: DataFrame, dynamic: str = "dynamic") -> DataFrame:
    return df.withColumn("label", F.when(F.col(dynamic), F.lit(DYNAMIC_LABEL)).otherwise(F.lit(STATIC_LABEL)))


def text_lines(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value"))


def pose_matrix_lines(poses: DataFrame) -> DataFrame:
    """Row-major 3x4 matrix of each pose as one text line."""
    cells = [c for i, t in enumerate(g.TRANS) for c in (*g.ROT[3 * i : 3 * i + 3], t)]
    return text_lines(g.with_rotation(poses), cells, SCAN)


def write_lines(lines: DataFrame, path: str, order: Sequence[str] = ("session", "scan_id")) -> None:
    """Text per session, ordered by a range partitioning instead of one sorted task."""
    df = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    df.select("session", "value").write.mode("overwrite").partitionBy("session").text(path)


def write_session_files(lines: DataFrame, path: str, order: str = "scan_id") -> None:
    """One text file per session, as trajectory readers want it: ``session=<n>/``; lines by ``order``."""
    df = lines.repartition("session").sortWithinPartitions("session", order)
    df.select("session", "value").write.mode("overwrite").partitionBy("session").text(path)


def write_scan_files(points: DataFrame, path: str, fields: Sequence[str] = ("x", "y", "z", "intensity")) -> None:
    """One ascii point file per scan: ``session=<n>/scan_id=<n>/``; points by ``point_idx``."""
    line = F.concat_ws(" ", *[F.col(c).cast("float").cast("string") for c in fields])
    scans = points.select(*SCAN, "point_idx", *fields).repartition(shuffle_tasks(points), *SCAN).groupBy(*SCAN).agg(F.sort_array(F.collect_list(F.struct("point_idx", line.alias("line")))).alias("rows"))
    count = F.size("rows").cast("string")
    n = len(fields)
    head = [
        F.lit("VERSION .7"), F.lit("FIELDS " + " ".join(fields)), F.lit("SIZE" + " 4" * n), F.lit("TYPE" + " F" * n), F.lit("COUNT" + " 1" * n),
        F.concat(F.lit("WIDTH "), count), F.lit("HEIGHT 1"), F.lit("VIEWPOINT 0 0 0 1 0 0 0"), F.concat(F.lit("POINTS "), count), F.lit("DATA ascii"),
    ]
    value = F.concat_ws("\n", *head, F.array_join(F.transform("rows", lambda r: r.line), "\n"))
    scans.select(*SCAN, value.alias("value")).write.mode("overwrite").options(**BY_TASKS).partitionBy(*SCAN).text(path)


def write_pose_files(lines: DataFrame, path: str) -> None:
    """One text file per pose: ``session=<n>/scan_id=<n>/``. Files cost more than bytes, so rows are dealt over all tasks."""
    dealt(lines.select(*SCAN, "value")).write.mode("overwrite").options(**BY_TASKS).partitionBy(*SCAN).text(path)


def write_pose_matrix(poses: DataFrame, path: str) -> None:
    write_lines(pose_matrix_lines(poses), path)


def write_trajectory(poses: DataFrame, path: str) -> None:
    """Corrected poses per session and, next to them, one combined file set."""
    columns = ["t", *g.TRANS, *g.QUAT]
    write_lines(text_lines(poses, columns, SCAN), f"{path}/sessions")
    both = text_lines(poses, columns, SCAN).repartitionByRange(*SCAN).sortWithinPartitions(*SCAN)
    both.select("value").write.mode("overwrite").text(f"{path}/truth")


def write_scan_points(points: DataFrame, path: str) -> None:
    """Cleaned points by session; scans stay together and ordered inside the files."""
    df = points.repartitionByRange(*SCAN).sortWithinPartitions(*SCAN)
    df.write.mode("overwrite").partitionBy("session").parquet(path)


def write_merged_map(points: DataFrame, path: str, cell: float = 50.0) -> None:
    """Merged cloud, range-partitioned by voxel so that a region touches few files."""
    keys = {"_" + k: c for k, c in voxel_keys(cell).items()}
    df = points.withColumns(keys).repartitionByRange(*keys)
    df.drop(*keys).write.mode("overwrite").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").partitionBy("session").parquet(path)


def write_point_log(points: DataFrame, path: str) -> None:
    points.select("t", "x", "y", "z", "label").write.mode("overwrite").csv(path, sep=" ")


def write_imu_log(imu: DataFrame, path: str) -> None:
    imu.select("t", "ax", "ay", "az", "gx", "gy", "gz").write.mode("overwrite").csv(path, sep=" ")


def odometry_positions(poses: DataFrame) -> DataFrame:
    return poses.select(*SCAN, *[F.col(c).cast("float").alias(c) for c in g.TRANS])


def write_odometry(poses: DataFrame, path: str) -> None:
    odometry_positions(poses).write.mode("overwrite").parquet(path)


def map_chunk_writer(path: str):
    """Sink of a stream: each micro-batch of world points becomes one chunk folder, rewritten on retry."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/chunk={batch_id}")

    return write

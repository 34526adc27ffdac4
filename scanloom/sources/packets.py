"""Sensor packets to points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.functions.sensor import point_offset_ns, sensor_time_ns


def packet_points(
    packets: DataFrame, interval_ns: int, echoes: int = 1,
    rotation: Sequence[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1), translation: Sequence[float] = (0, 0, 0),
) -> DataFrame:
    """One row per point: millimetres to metres, extrinsic, time and offset within the packet.

    A point with x = y = z = 0 is an empty return and is not moved.
    """
    df = packets.select("lidar_id", "seq", sensor_time_ns(F.col("stamp"), F.col("stamp_type"), F.col("time_rcv")).alias("t_ns"), F.posexplode("payload").alias("i", "p"))
    raw = [F.col(f"p.{a}") / 1000.0 for a in "xyz"]
    moved = g.rigid([F.lit(float(v)) for v in rotation], [F.lit(float(v)) for v in translation], raw)
    empty = (F.col("p.x") == 0) & (F.col("p.y") == 0) & (F.col("p.z") == 0)
    return df.select(
        "lidar_id", "seq", "t_ns", F.col("i").alias("point_idx"), point_offset_ns(F.lit(0), F.col("i"), interval_ns, echoes).alias("offset_ns"),
        *[F.when(empty, F.lit(0.0)).otherwise(m).alias(a) for m, a in zip(moved, "xyz")], F.col("p.reflectivity").alias("reflectivity"),
    )


def message_points(messages: DataFrame) -> DataFrame:
    """Points of nested scan messages; works on batch and streaming frames alike."""
    df = messages.select("ts", "timebase", "lidar_id", F.explode("points").alias("p"))
    return df.select("ts", "lidar_id", (F.col("timebase") + F.col("p.offset_time")).alias("t_ns"), "p.x", "p.y", "p.z", "p.reflectivity", "p.tag", "p.line")

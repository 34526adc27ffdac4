"""Stream operators. Column-only ones accept batch and streaming frames alike."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanloom.operators.ordered import block_of, neighbour, running_sum
from scanloom.schemas import SCAN_MESSAGES
from scanloom.sources.packets import message_points


def scan_stream(spark: SparkSession, path: str) -> DataFrame:
    """Points of a folder of scan messages, as a stream."""
    return message_points(spark.readStream.schema(SCAN_MESSAGES).parquet(path))


def imu_stream(spark: SparkSession, path: str, schema: str, offset_s: float = 0.0) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path).withColumn("t", F.col("t") + F.lit(offset_s))


def visible(points: DataFrame, now: str, t: str, delay: float, frame: float) -> DataFrame:
    """Points old enough to enter a range image."""
    return points.filter(F.col(now) - F.col(t) >= delay - frame / 2.0)


def drop_late(df: DataFrame, ts: str, bound: str) -> DataFrame:
    return df.withWatermark(ts, bound)


def restart_sessions(df: DataFrame, keys: list[str], order: str, t: str, block, drop: float = 0.0) -> DataFrame:
    """Number of clock resets up to each row: time going back by more than ``drop`` starts a new run.

    Resets are flagged block by block and summed up with the blocks' offsets, so neither a long
    session nor many resets meet in one row or task.
    """
    marked = neighbour(df, keys, order, block, [t])
    flag = F.coalesce((F.col(t) < F.col(f"prev.{t}") - drop).cast("int"), F.lit(0))
    return running_sum(marked.withColumn("_reset", flag).drop("prev"), keys, order, block, "_reset", "run").withColumn("run", F.col("run").cast("int")).drop("_reset")


def align(df: DataFrame, ts: str, period: str, keys: list[str]) -> DataFrame:
    """Packets per publish period, on period boundaries."""
    return df.groupBy(*keys, F.window(ts, period).alias("w")).agg(F.count("*").alias("packets")).select(*keys, F.col("w.start").alias("start"), "packets")


def gap_fill(packets: DataFrame, keys: list[str], t_ns: str, interval: int, max_gap: int, block_ns: float = 6e10) -> DataFrame:
    """Add zero packets at the expected stamps of gaps longer than ``max_gap``."""
    df = neighbour(packets, keys, t_ns, block_of(F.col(t_ns), block_ns), [], -1, "prev")
    gap = F.col(t_ns) - F.col("prev._o")
    missing = df.filter(gap > max_gap).select(*keys, F.explode(F.sequence(F.col("prev._o") + interval, F.col(t_ns) - 1, F.lit(interval))).alias(t_ns))
    return packets.select(*keys, t_ns).withColumn("zero", F.lit(False)).unionByName(missing.withColumn("zero", F.lit(True)))


def sync(scans: DataFrame, imu: DataFrame, key: str, bound: str = "1 second", width: int = 60) -> DataFrame:
    """Stream-stream interval join: a scan with the samples between its start and end.

    Time is cut into buckets of ``width`` seconds. A scan goes to each bucket it meets and a sample to
    its own, so a row meets the rows near it in time and not all of its key.
    """
    bucket = lambda ts: F.floor(F.unix_micros(ts) / (width * 1_000_000))
    s = scans.withWatermark("end_ts", bound).filter(F.col("start_ts") < F.col("end_ts"))
    s = s.withColumn("_bucket", F.explode(F.sequence(bucket("start_ts"), bucket("end_ts")))).alias("s")
    i = imu.withWatermark("imu_ts", bound).withColumn("_bucket", bucket("imu_ts")).alias("i")
    on = (F.col(f"s.{key}") == F.col(f"i.{key}")) & (F.col("s._bucket") == F.col("i._bucket")) & (F.col("i.imu_ts") > F.col("s.start_ts")) & (F.col("i.imu_ts") <= F.col("s.end_ts"))
    return s.join(i, on).drop(F.col(f"i.{key}"), F.col("s._bucket"), F.col("i._bucket"))


def clock_offset(scans: DataFrame, imu: DataFrame, keys: list[str]) -> DataFrame:
    """First scan time minus first sample time per key, added to all samples."""
    a = scans.groupBy(*keys).agg(F.min("t").alias("_s"))
    b = imu.groupBy(*keys).agg(F.min("t").alias("_i"))
    return imu.join(a.join(b, keys), keys).withColumn("t", F.col("t") + (F.col("_s") - F.col("_i"))).drop("_s", "_i")


_CHUNK = 100_000  # rows of a session that are handed on at once


def epoch_stream(points: DataFrame, threshold: float, history: int) -> DataFrame:
    """Range-image number of each scan message: keyed state holds the open epoch only.

    Input (session, t); output (session, t, epoch, oldest).
    """
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, epoch = state.get if state.exists else (-np.inf, -1)
        times = np.sort(np.concatenate([pdf["t"].to_numpy(dtype=float) for pdf in batches]))
        epochs, at = np.empty(len(times), np.int64), 0
        while at < len(times):
            end = int(np.searchsorted(times, start + threshold))  # the sum may be rounded, the difference decides
            while end > at and times[end - 1] - start >= threshold:
                end -= 1
            while end < len(times) and times[end] - start < threshold:
                end += 1
            epochs[at:end], at = epoch, max(at, end)
            if at < len(times):
                start, epoch = float(times[at]), epoch + 1
        state.update((start, epoch))
        for i in range(0, len(times), _CHUNK):
            part = epochs[i : i + _CHUNK]
            yield pd.DataFrame({"session": key[0], "t": times[i : i + _CHUNK], "epoch": part, "oldest": np.maximum(part - history + 1, 0)})

    return points.select("session", "t").groupBy("session").applyInPandasWithState(
        run, "session INT, t DOUBLE, epoch BIGINT, oldest BIGINT", "start DOUBLE, epoch BIGINT", "append", GroupStateTimeout.NoTimeout
    )


def track_stream(boxes: DataFrame, params) -> DataFrame:
    """Tracks of cluster boxes, one keyed state per session."""
    from scanloom.streaming.tracks import Tracker

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(params)
        # the rows of a trigger come in chunks that are cut anywhere: frames are stepped over all of them
        pdf = pd.concat(list(batches)).dropna(subset=["t"]).sort_values(["t", "cluster"])
        t = pdf["t"].to_numpy(dtype=float)
        low, high = (pdf[[f"{m}_{a}" for a in "xyz"]].to_numpy(dtype=float) for m in ("min", "max"))
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        ends = np.append(first, len(t))
        part = np.searchsorted(ends, np.arange(0, len(t), _CHUNK))  # whole frames, about so many rows at once
        for a, b in zip(part, np.append(part[1:], len(first))):
            if a < b:
                at = ends[a : b + 1]
                out = pd.DataFrame(tracker.table(t[ends[a:b]].tolist(), (at - at[0]).tolist(), low[at[0] : at[-1]], high[at[0] : at[-1]]))
                out.insert(0, "session", key[0])
                yield out
        state.update((pickle.dumps(tracker),))

    schema = "session INT, t DOUBLE, track BIGINT, status STRING, x DOUBLE, y DOUBLE, z DOUBLE, vx DOUBLE, vy DOUBLE, vz DOUBLE"
    return boxes.groupBy("session").applyInPandasWithState(run, schema, "blob BINARY", "append", GroupStateTimeout.NoTimeout)

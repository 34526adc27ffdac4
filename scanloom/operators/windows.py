"""Sequence operators: key frames, edges, epochs, sliding and batched clouds, scan lines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators.ordered import BLOCK, block_of, fold, neighbour, row_number, running_sum


def key_frames(scans: DataFrame, size: int) -> DataFrame:
    """(session, scan_id, keyframe, anchor_scan): runs of ``size`` scans, trailing rest dropped.

    ``keyframe`` counts on over the sessions, like the global key-frame number of a job
    that reads one session after the other.
    """
    ranked = row_number(scans.select("session", "scan_id"), ["session"], ["scan_id"], block_of(F.col("scan_id")))
    ranked = ranked.withColumn("_k", F.floor((F.col("rn") - 1) / size))
    groups = ranked.groupBy("session", "_k").agg(F.count("*").alias("_n"), F.min("scan_id").alias("anchor_scan"))
    full = groups.filter(F.col("_n") == size)
    per_session = full.groupBy("session").agg(F.count("*").alias("_c"))
    base = per_session.withColumn(
        "_base", F.coalesce(F.sum("_c").over(Window.orderBy("session").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_c")
    return (
        ranked.join(full.drop("_n"), ["session", "_k"]).join(base, "session")
        .select("session", "scan_id", (F.col("_base") + F.col("_k")).cast("int").alias("keyframe"), "anchor_scan")
    )


def odometry_edges(poses: DataFrame) -> DataFrame:
    """Relative pose from each scan's predecessor: (session, src, dst, tx.., r00..)."""
    df = g.with_rotation(poses).select("session", "scan_id", *g.TRANS, *g.ROT)
    df = neighbour(df, ["session"], "scan_id", block_of(F.col("scan_id")), ["scan_id", *g.TRANS, *g.ROT])
    df = df.filter(F.col("prev").isNotNull())
    r, t = g.between(g.cols(g.ROT, "prev."), g.cols(g.TRANS, "prev."), g.cols(g.ROT), g.cols(g.TRANS))
    return df.select(
        "session", F.col("prev.scan_id").alias("src"), F.col("scan_id").alias("dst"),
        *[c.alias(n) for c, n in zip((*t, *r), (*g.TRANS, *g.ROT))],
    )


def frame_consistency(loops: DataFrame, threshold: float) -> DataFrame:
    """Flag a loop when key and match moved apart by ``threshold`` or more since the previous loop."""
    keys = ["session", "map_session"]
    df = neighbour(loops, keys, "keyframe", block_of(F.col("keyframe")), ["keyframe", "db_keyframe"])
    step = (F.col("keyframe") - F.col("prev.keyframe")) - (F.col("db_keyframe") - F.col("prev.db_keyframe"))
    return df.withColumn("consistent", F.coalesce(F.abs(step) < threshold, F.lit(True))).drop("prev")


def arrival_cap(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """First ``limit`` rows per key in arrival order; the planner prunes groups before the shuffle."""
    return (
        df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("_rn") <= limit).drop("_rn")
    )


def map_epochs(scans: DataFrame, threshold: float, t: str = "t", block: Column | None = None) -> DataFrame:
    """Number of the range image each scan belongs to.

    A new image starts when the time since the current one started reaches ``threshold``. A
    block cannot know when the image it begins in was started, but only its scans before
    ``threshold`` can be its first start. For each of these one pass notes the last start and the
    number of starts; chaining the notes, a few rows per block, gives every block its true
    beginning, and a second pass numbers the scans. Two passes do, whatever the number of blocks.
    """
    block = block_of(F.col("scan_id")) if block is None else block
    df = scans.withColumn("_blk", block)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def followers(times: np.ndarray) -> np.ndarray:
        """Index of the start after each scan, if that scan is one."""
        after = np.searchsorted(times, times + threshold, "left")
        after -= (after > 0) & (times[np.maximum(after - 1, 0)] - times >= threshold)  # the sum may have been rounded up
        return after + ((after < len(times)) & (times[np.minimum(after, len(times) - 1)] - times < threshold))

    def note(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scan_id", kind="stable")
        times = pdf[t].to_numpy(dtype=float)
        after = followers(times)
        last, n = np.arange(len(times)), np.ones(len(times), np.int64)
        for i in range(len(times) - 1, -1, -1):
            if after[i] < len(times):
                last[i], n[i] = last[after[i]], n[after[i]] + 1
        heads = slice(0, min(len(times), int(after[0]) + 1))
        return pd.DataFrame({"session": pdf["session"].iloc[0], "_blk": pdf["_blk"].iloc[0], "first": times[heads], "last": times[last[heads]], "n": n[heads]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, start, epoch = [], -np.inf, -1
        for b, part in pdf.sort_values(["_blk", "first"]).groupby("_blk", sort=True):
            rows.append((part["session"].iloc[0], b, start, epoch))
            hit = np.flatnonzero(part["first"].to_numpy() - start >= threshold)
            if len(hit):
                start, epoch = part["last"].iloc[hit[0]], epoch + int(part["n"].iloc[hit[0]])
        return pd.DataFrame(rows, columns=["session", "_blk", "_start", "_epoch"])

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scan_id", kind="stable")
        times = pdf[t].to_numpy(dtype=float)
        after, flags = followers(times), np.zeros(len(times), np.int64)
        hit = np.flatnonzero(times - pdf["_start"].iloc[0] >= threshold)
        at = int(hit[0]) if len(hit) else len(times)
        while at < len(times):
            flags[at], at = 1, int(after[at])
        return pdf.assign(epoch=int(pdf["_epoch"].iloc[0]) + np.cumsum(flags)).drop(columns=["_blk", "_start", "_epoch"])

    ids = f"session {kinds['session']}, _blk bigint"
    notes = df.groupBy("session", "_blk").applyInPandas(note, f"{ids}, first double, last double, n bigint")
    heads = notes.groupBy("session").applyInPandas(chain, f"{ids}, _start double, _epoch bigint")
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in scans.columns)
    return df.join(heads, ["session", "_blk"]).groupBy("session", "_blk").applyInPandas(number, f"{fields}, epoch bigint")


def motion_skip(
    track: DataFrame, order: str = "seq", min_move: float = 0.2, min_turn: float = 5.0 / 57.3
) -> DataFrame:
    """Flag ``kept``: moved or turned enough since the last kept pose; the first pose is kept."""
    def step(state: np.ndarray | None, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        p = rows[["tx", "ty", "tz"]].to_numpy(dtype=float)
        q = rows[["qx", "qy", "qz", "qw"]].to_numpy(dtype=float)
        last = state
        out = np.zeros(len(p), dtype=np.int64)
        for i in range(len(p)):
            if last is not None:
                angle = 2 * np.arccos(min(1.0, abs(float(q[i] @ last[3:]))))
                if np.sqrt(((p[i] - last[:3]) ** 2).sum()) < min_move and angle < min_turn:
                    continue
            last = np.concatenate([p[i], q[i]])
            out[i] = 1
        return out, last

    return fold(track, ["session"], order, block_of(F.col(order)), step, "kept")


def sliding_windows(scans: DataFrame, size: int) -> DataFrame:
    """(session, window, scan_id): window w holds scan number w and the size - 1 before it."""
    ranked = row_number(scans.select("session", "scan_id"), ["session"], ["scan_id"], block_of(F.col("scan_id")))
    last = ranked.groupBy("session").agg(F.max("rn").alias("_last"))
    return (
        ranked.join(last, "session")
        .withColumn("window", F.explode(F.sequence("rn", F.least(F.col("rn") + size - 1, F.col("_last")))))
        .select("session", "window", "scan_id")
    )


def batch_windows(scans: DataFrame, size: int) -> DataFrame:
    """(session, batch, scan_id) for each complete run of ``size`` scans."""
    ranked = row_number(scans.select("session", "scan_id"), ["session"], ["scan_id"], block_of(F.col("scan_id")))
    ranked = ranked.withColumn("batch", F.floor((F.col("rn") - 1) / size))
    full = ranked.groupBy("session", "batch").agg(F.count("*").alias("_n")).filter(F.col("_n") == size)
    return ranked.join(full.drop("_n"), ["session", "batch"]).select("session", "batch", "scan_id")


LINE = ["session", "scan_id", "line"]
_LINE_BLOCK = float(BLOCK) * 16777216 * 8


def ring_time(points: DataFrame, degrees_per_ms: float = 3.61, block: Column | None = None) -> DataFrame:
    """Point time in ms from azimuth when the sensor gives none.

    Time is the angle turned since the ring's first point. Once it has gone back, one
    turn is added to all later points of the ring. The first point of a ring is dropped.
    """
    block = block_of(F.col("point_idx"), _LINE_BLOCK) if block is None else block
    df = points.withColumn("yaw", F.atan2("y", "x") * 57.2957)
    first = df.groupBy(*LINE).agg(F.min(F.struct("point_idx", "yaw")).alias("_f"))
    df = df.join(first, LINE).filter(F.col("point_idx") > F.col("_f.point_idx"))
    turned = F.col("_f.yaw") - F.col("yaw")
    df = df.withColumn("raw", F.when(turned >= 0, turned).otherwise(turned + 360.0) / degrees_per_ms).drop("_f")
    df = neighbour(df, LINE, "point_idx", block, ["raw"])
    back = df.filter(F.col("raw") < F.col("prev.raw")).groupBy(*LINE).agg(F.min("point_idx").alias("_wrap"))
    return (
        df.drop("prev").join(back, LINE, "left")
        .withColumn("time_ms", F.col("raw") + F.when(F.col("point_idx") >= F.col("_wrap"), 360.0 / degrees_per_ms).otherwise(0.0))
        .drop("_wrap", "raw")
    )


def ring_index(points: DataFrame, gap: int = 100, order: str = "point_idx", block: Column | None = None) -> DataFrame:
    """Line number from azimuth zero crossings that are more than ``gap`` points apart.

    The state of the pass is the last azimuth and the distance from the last start, which counts
    no further than ``gap``; the line number is the running sum of the starts.
    """
    block = block_of(F.col(order), _LINE_BLOCK) if block is None else block

    def step(state: np.ndarray | None, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        since, last = (0.0, 1.0) if state is None else state
        now = rows["azimuth"].to_numpy(dtype=float)
        before = np.concatenate([[last], now[:-1]])
        starts = np.zeros(len(now), np.int64)
        at = -1 - int(since)
        for i in np.flatnonzero((now >= 0) & (now < 1) & (before > -1) & (before <= 0)):
            if i - at - 1 > gap:
                starts[i], at = 1, i
        return starts, np.array([min(len(now) - 1 - at, gap + 1), now[-1]], dtype=float)

    keys = ["session", "scan_id"]
    found = fold(points.withColumn("azimuth", F.atan2("y", "x")), keys, order, block, step, "_starts")
    return running_sum(found, keys, order, block, "_starts", "ring").withColumn("ring", (F.col("ring") + 1).cast("bigint")).drop("_starts")


def line_geometry(points: DataFrame, block: Column | None = None) -> DataFrame:
    """Squared step to the next point, planar range, and cosines to and between neighbours."""
    block = block_of(F.col("point_idx"), _LINE_BLOCK) if block is None else block
    df = neighbour(points, LINE, "point_idx", block, ["x", "y", "z"], -1, "prev")
    df = neighbour(df, LINE, "point_idx", block, ["x", "y", "z"], 1, "next")
    p, a, b = g.cols("xyz"), g.cols(["prev.x", "prev.y", "prev.z"]), g.cols(["next.x", "next.y", "next.z"])
    va, vb = g.sub(a, p), g.sub(b, p)
    return df.select(
        *LINE, "point_idx",
        F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("range"),
        g.dot(vb, vb).alias("step2"),
        (g.dot(p, va) / g.norm(p) / g.norm(va)).alias("cos_prev"),
        (g.dot(p, vb) / g.norm(p) / g.norm(vb)).alias("cos_next"),
        (g.dot(va, vb) / g.norm(va) / g.norm(vb)).alias("cos_between"),
    )


def local_map(track: DataFrame, order: str, side: float, reach: float, threshold: float = 1.5) -> DataFrame:
    """Moves of the cube that bounds the local map: ``moved`` has bits 1-6 for -x, +x, -y, +y, -z, +z.

    The cube of edge ``side`` starts around the first pose and shifts along an axis when the
    pose comes within ``threshold`` · ``reach`` of a face.
    """
    margin = threshold * reach
    shift = max((side - 2.0 * margin) * 0.5 * 0.9, reach * (threshold - 1))

    def step(state: np.ndarray | None, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        p = rows[["tx", "ty", "tz"]].to_numpy(dtype=float)
        low = state
        out = np.zeros(len(p), dtype=np.int64)
        for i, pos in enumerate(p):
            if low is None:
                low = pos - side / 2
                continue
            down, up = np.abs(pos - low) <= margin, np.abs(pos - low - side) <= margin
            up &= ~down
            low = low + np.where(up, shift, 0.0) - np.where(down, shift, 0.0)
            out[i] = sum((1 << (2 * k)) * int(down[k]) + (2 << (2 * k)) * int(up[k]) for k in range(3))
        return out, low

    # the cube never forgets where it began: without a guess a round would settle one block only
    return fold(track, ["session"], order, block_of(F.col(order)), step, "moved", sample=64)

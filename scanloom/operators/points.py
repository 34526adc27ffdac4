"""Per-point projections and filters: all narrow, no shuffle except the pose joins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import geometry as g
from scanloom.params import DynamicParams
from scanloom.session import dealt

XYZ = ("x", "y", "z")
SCAN = ["session", "scan_id"]

# The five boxes on the recording vehicle, as (x, y, z) bounds in metres.
EGO_BOXES = (
    ((-1.2, -0.4), (-1.7, -1.0), (-0.65, -0.4)),
    ((-1.75, -0.85), (1.0, 1.6), (-0.75, -0.40)),
    ((1.4, 1.7), (-1.3, -0.9), (-0.8, -0.6)),
    ((2.45, 2.6), (-0.6, -0.45), (-1.0, -0.9)),
    ((2.45, 2.6), (0.45, 0.6), (-1.0, -0.9)),
)
# Colour of a session's points in the merged map.
SESSION_COLOURS = ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255))


def scan_pose(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Attach each scan's pose to its points.

    The pose table has one row per scan; the planner broadcasts it only while it is
    under the broadcast threshold, otherwise both sides meet on (session, scan_id), and
    bucketed tables meet without a shuffle.
    """
    return points.join(poses, SCAN)


def _posed(points: DataFrame, poses: DataFrame) -> tuple[DataFrame, list[Column], list[Column], list[Column]]:
    """Points with their scan's rotation, which is worked out once per pose."""
    return scan_pose(points, g.with_rotation(poses)), g.cols(g.ROT), g.cols(g.TRANS), g.cols(XYZ)


def replace_xyz(df: DataFrame, p: Sequence[Column], drop: Sequence[str] = ()) -> DataFrame:
    return df.withColumns(dict(zip(XYZ, p))).drop(*drop)


def to_world(points: DataFrame, poses: DataFrame) -> DataFrame:
    df, r, t, p = _posed(points, poses)
    return replace_xyz(df, g.rigid(r, t, p), [*g.ROT, *g.TRANS, *g.QUAT])


def to_body(points: DataFrame, poses: DataFrame) -> DataFrame:
    df, r, t, p = _posed(points, poses)
    return replace_xyz(df, g.rigid_inverse(r, t, p), [*g.ROT, *g.TRANS, *g.QUAT])


def apply_extrinsic(points: DataFrame, rotation: Sequence[float], translation: Sequence[float]) -> DataFrame:
    r, t = [F.lit(float(v)) for v in rotation], [F.lit(float(v)) for v in translation]
    return replace_xyz(points, g.rigid(r, t, [F.col(c).cast("double") for c in XYZ]))


def to_key_frame(
    points: DataFrame, poses: DataFrame, anchors: DataFrame, world_input: bool = True,
    rotation: Sequence[float] = (1, 0, 0, 0, 1, 0, 0, 0, 1), translation: Sequence[float] = (0, 0, 0),
) -> DataFrame:
    """Express points in the frame of their key frame's anchor scan.

    ``anchors`` maps (session, scan_id) to (keyframe, anchor_scan). Extrinsic first, then
    body frame when the input is in world coordinates, then anchor⁻¹ · pose.
    """
    pose = g.with_rotation(poses.select(*SCAN, *g.TRANS, *g.QUAT)).select(*SCAN, *g.TRANS, *g.ROT)
    anchor = pose.select(
        "session", F.col("scan_id").alias("anchor_scan"), *[F.col(c).alias("a" + c) for c in (*g.TRANS, *g.ROT)]
    )
    per_scan = pose.join(anchors, SCAN).join(anchor, ["session", "anchor_scan"])
    rel_r, rel_t = g.between(g.cols(g.ROT, "a"), g.cols(g.TRANS, "a"), g.cols(g.ROT), g.cols(g.TRANS))
    per_scan = per_scan.select(
        *SCAN, "keyframe", *g.TRANS, *g.ROT,
        *[c.alias("k" + n) for c, n in zip((*rel_t, *rel_r), (*g.TRANS, *g.ROT))],
    )
    df = apply_extrinsic(points, rotation, translation).join(per_scan, SCAN)
    if world_input:
        df = replace_xyz(df, g.rigid_inverse(g.cols(g.ROT), g.cols(g.TRANS), g.cols(XYZ)))
    df = replace_xyz(df, g.rigid(g.cols(g.ROT, "k"), g.cols(g.TRANS, "k"), g.cols(XYZ)))
    return df.drop(*g.TRANS, *g.ROT, *["k" + n for n in (*g.TRANS, *g.ROT)])


def sq_range() -> Column:
    return F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")


def drop_blind(points: DataFrame, blind: float) -> DataFrame:
    """Squared range against ``blind`` itself, not its square."""
    return points.filter(sq_range() >= blind)


def is_invalid(p: DynamicParams) -> Column:
    near = sq_range() < p.blind * p.blind
    if p.near_axis_box:
        near = near | ((F.abs("x") < 0.1) & (F.abs("y") < 1.0) & (F.abs("z") < 0.1))
    return near


def in_ego_boxes() -> Column:
    hit = F.lit(False)
    for box in EGO_BOXES:
        inside = F.lit(True)
        for axis, (low, high) in zip(XYZ, box):
            inside = inside & (F.col(axis) > low) & (F.col(axis) < high)
        hit = hit | inside
    return hit


def in_ego_rect(p: DynamicParams, x: str = "x", y: str = "y") -> Column:
    return (
        (F.col(x) > p.ego_x[0]) & (F.col(x) < p.ego_x[1]) & (F.col(y) > p.ego_y[0]) & (F.col(y) < p.ego_y[1])
    )


def in_fov(p: DynamicParams, hor: str = "hor", ver: str = "ver") -> Column:
    """Pixel inside the field of view; the lower edge is open, the others closed."""
    return (
        (F.col(ver) <= p.ver_pixel(p.fov_up)) & (F.col(ver) > p.ver_pixel(p.fov_down))
        & (F.col(hor) <= p.hor_pixel(p.fov_left)) & (F.col(hor) >= p.hor_pixel(p.fov_right))
    )


def in_fov_cone(centre: Sequence[float], axis: Sequence[float], theta: float, depth: float, box: float) -> Column:
    """Closer than sqrt(0.4) box lengths, or within the cone widened by 0.0175 rad."""
    v = [F.col(c) - o for c, o in zip(XYZ, centre)]
    length2 = g.dot(v, v)
    along = sum((c * a for c, a in zip(v, axis)), F.lit(0.0))
    length = F.sqrt(length2)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), along / F.greatest(length, F.lit(1e-12))))
    return (length2 < 0.4 * box * box) | (
        (along <= depth) & ((length <= 1e-4) | (F.acos(cosine) <= theta + 0.0175))
    )


def cubes_in_cone(
    sensors: DataFrame, theta: float, depth: float, box: float
) -> DataFrame:
    """Grid cubes whose centre or a corner lies in a sensor's viewing cone.

    ``sensors`` holds (.., x, y, z, ax, ay, az). Cube centres are multiples of ``box``; the
    candidate cubes within ``depth`` are tested in stacked arrays, so their number depends on
    depth/box only, and rows are made for the cubes that are seen.
    """
    n = int(depth / box) + 1
    steps = np.stack(np.meshgrid(*[np.arange(-n, n + 1)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    corners = [(0, 0, 0)] + [(i, j, k) for i in (-0.5, 0.5) for j in (-0.5, 0.5) for k in (-0.5, 0.5)]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def seen(x: pd.Series, y: pd.Series, z: pd.Series, ax: pd.Series, ay: pd.Series, az: pd.Series) -> pd.Series:
        """Numbers of the candidate cubes that a sensor sees; some hundred sensors at a time."""
        out = []
        for part in np.array_split(np.arange(len(x)), len(x) // 256 + 1):
            at, axis = [np.stack([np.asarray(c.iloc[part], float) for c in cs], axis=1) for cs in ((x, y, z), (ax, ay, az))]
            length = np.sqrt(axis[:, :1] ** 2 + axis[:, 1:2] ** 2 + axis[:, 2:] ** 2)
            cube = np.floor(at / box + 0.5)[:, None, :] + steps
            hit = np.zeros(cube.shape[:2], bool)
            for corner in corners:
                v = (cube + corner) * box - at[:, None, :]
                length2 = v[..., 0] * v[..., 0] + v[..., 1] * v[..., 1] + v[..., 2] * v[..., 2]
                along = (v[..., 0] * axis[:, :1] + v[..., 1] * axis[:, 1:2] + v[..., 2] * axis[:, 2:]) / length
                cosine = np.clip(along / np.maximum(np.sqrt(length2), 1e-12), -1.0, 1.0)
                hit |= (length2 < 0.4 * box * box) | ((along <= depth) & (np.arccos(cosine) <= theta + 0.0175))
            out += [np.flatnonzero(row) for row in hit]
        return pd.Series(out, index=x.index)

    # Few rows make many cubes: they are dealt over all tasks, as their bytes would fill one.
    df = dealt(sensors).withColumn("_k", F.explode(seen(*[F.col(c).cast("double") for c in ("x", "y", "z", "ax", "ay", "az")])))
    side = 2 * n + 1
    for name, axis, down in (("bx", "x", side * side), ("by", "y", side), ("bz", "z", 1)):
        here = F.floor(F.col(axis) / box + 0.5).cast("bigint")
        df = df.withColumn(name, here + F.floor(F.col("_k") / down).cast("bigint") % side - n)
    return df.drop("_k")


def good_return(lines: int = 6) -> Column:
    """Line number in range and return tag of the single-return class."""
    return (F.col("line") < lines) & (F.col("tag").bitwiseAND(F.lit(0x30)) == 0x10)


def keep_coloured(df: DataFrame) -> DataFrame:
    """Missing colour becomes white; a zero channel drops the point."""
    white = {c: F.coalesce(F.col(c), F.lit(255).cast("smallint")) for c in "rgb"}
    return df.withColumns(white).filter((F.col("r") != 0) & (F.col("g") != 0) & (F.col("b") != 0))


def session_colour(df: DataFrame) -> DataFrame:
    palette = F.array(*[F.array(*[F.lit(v) for v in c]) for c in SESSION_COLOURS])
    pick = F.element_at(palette, F.pmod(F.col("session"), F.lit(len(SESSION_COLOURS))).cast("int") + 1)
    return df.withColumns({c: pick[i] for i, c in enumerate("rgb")})


def unroll_azimuth(df: DataFrame, left: float, resolution: float, step: float) -> DataFrame:
    """Shift each azimuth sector by a growing angle: sector k (from ``left``) moves by (k + 1)·step."""
    azimuth = F.atan2("y", "x")
    rng = F.sqrt(sq_range())
    elevation = F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    sector = F.floor((azimuth - left) / resolution)
    moved = azimuth + (sector + 1) * step
    flat = rng * F.cos(elevation)
    return df.withColumn("sector", sector).withColumns(
        {"x": flat * F.cos(moved), "y": flat * F.sin(moved), "z": rng * F.sin(elevation), "intensity": rng}
    )


def match_class(label: Column, pred: Column) -> Column:
    """10 true positive, 20 false negative, 30 false positive, 0 otherwise."""
    moving, hit = (label >= 251) & (label < 65535), pred >= 251
    return (
        F.when(moving & hit, 10).when(moving, 20).when(hit, 30).otherwise(0)
    )


def split_labels(labelled: DataFrame, column: str = "label") -> tuple[DataFrame, DataFrame]:
    """Static and dynamic outputs of one labelled table."""
    return labelled.filter(~F.col(column)), labelled.filter(F.col(column))


def except_points(points: DataFrame, removed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bag difference on exact coordinates after dropping NaN rows."""
    clean = points.filter(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    return clean.join(removed.select(*keys, *XYZ).distinct(), [*keys, *XYZ], "left_anti")


def union_map(scans: Sequence[DataFrame]) -> DataFrame:
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out


def drop_in_boxes(points: DataFrame, boxes: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Remove points inside any box of their key; boxes are cut into grid cells, then tested exactly."""
    b = boxes.select(*keys, *[F.col(f"{m}_{a}").alias(f"b_{m}_{a}") for m in ("min", "max") for a in XYZ])
    for a in XYZ:
        b = b.withColumn("c" + a, F.explode(F.sequence(
            F.floor(F.col("b_min_" + a) / cell).cast("bigint"), F.floor(F.col("b_max_" + a) / cell).cast("bigint")
        )))
    p = points.withColumns({"_c" + a: F.floor(F.col(a) / cell).cast("bigint") for a in XYZ})
    b = b.select(*[F.col(k).alias("_k" + k) for k in keys], *[F.col("c" + a) for a in XYZ], *[c for c in b.columns if c.startswith("b_")])
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col("_k" + k))
    for a in XYZ:
        cond = cond & (F.col("_c" + a) == F.col("c" + a)) & (F.col(a) >= F.col("b_min_" + a)) & (F.col(a) <= F.col("b_max_" + a))
    return p.join(b, cond, "left_anti").drop("_cx", "_cy", "_cz")

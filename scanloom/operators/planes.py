"""Plane grouping, merging and fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import geometry as g
from scanloom.functions.linalg import with_solution
from scanloom.functions.voxel import KEYS, pack, voxel_key
from scanloom.operators.cells import dist2, spread, with_cell
from scanloom.operators.components import connected_components
from scanloom.operators.ordered import row_number
from scanloom.operators.voxels import MOMENTS, merge_aggs, moment_aggs, with_plane
from scanloom.params import PlaneParams
from scanloom.session import cut

NORMAL = ("nx", "ny", "nz")
CENTRE = ("cx", "cy", "cz")
NORMAL_SUMS = ("hxx", "hxy", "hxz", "hyy", "hyz", "hzz")


def plane_points(planes: DataFrame, keys: Sequence[str] = ("session", "scan_id")) -> DataFrame:
    """Planar voxels as (centre, normal)."""
    return planes.select(*keys, *CENTRE, *NORMAL)


def _normals_close(a: Sequence[Column], b: Sequence[Column], limit: float) -> Column:
    minus, plus = g.sub(a, b), g.add(a, b)
    return (g.dot(minus, minus) < limit * limit) | (g.dot(plus, plus) < limit * limit)


def first_links(planes: DataFrame, keys: Sequence[str], p: PlaneParams) -> DataFrame:
    """(keys, a, b): the plane each plane was first grouped with, if any.

    The greedy pass compares planes i from last to first with j = 0..i-1 and acts only when
    at least one of the two has no group yet. So a plane's group is fixed by the first
    matching pair it takes part in: its match with the largest later plane, or else with the
    smallest earlier one. Two aggregates find that partner; nothing runs in sequence.
    """
    side = planes.select(*keys, "ord", *CENTRE, *NORMAL, "d")
    cell = ("_cx", "_cy", "_cz")
    # Cells use the upward normal; its opposite is needed too where it is nearly level.
    up = F.when(F.col("nz") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    side = side.withColumns({"_u" + n: F.col(n) * up for n in NORMAL})
    upward = ["_u" + n for n in NORMAL]
    flips = F.when(F.col("_unz") < p.normal_threshold, F.array(F.lit(1.0), F.lit(-1.0))).otherwise(F.array(F.lit(1.0)))
    a = side.withColumn("_f", F.explode(flips))
    a = a.withColumns({u: F.col(u) * F.col("_f") for u in upward})
    a = spread(with_cell(a, p.normal_threshold, upward, cell), names=cell).drop(*upward)
    b = with_cell(side, p.normal_threshold, upward, cell)
    b = b.select(*keys, *cell, *[F.col(c).alias("o_" + c) for c in ("ord", *CENTRE, *NORMAL, "d")])
    n1, n2 = g.cols(NORMAL), g.cols(NORMAL, "o_")
    d1 = F.abs(g.dot(n1, g.cols(CENTRE, "o_")) + F.col("d"))
    d2 = F.abs(g.dot(n2, g.cols(CENTRE)) + F.col("o_d"))
    match = (
        a.join(b, [*keys, *cell])
        .filter((F.col("ord") != F.col("o_ord")) & (d1 < p.distance_threshold) & (d2 < p.distance_threshold))
        .filter(_normals_close(n1, n2, p.normal_threshold))
    )
    later = F.max(F.when(F.col("o_ord") > F.col("ord"), F.col("o_ord")))
    earlier = F.min(F.when(F.col("o_ord") < F.col("ord"), F.col("o_ord")))
    return match.groupBy(*keys, F.col("ord").alias("a")).agg(F.coalesce(later, earlier).alias("b"))


def plane_groups(planes: DataFrame, keys: Sequence[str], p: PlaneParams, order: Column | None = None) -> DataFrame:
    """Add ``grp`` (smallest member in list order; NULL when nothing matched) to each plane.

    ``order`` is the list order; the voxel key by default.
    """
    planes = cut(planes.withColumn("ord", pack(g.cols(KEYS)) if order is None else order))
    groups = connected_components(first_links(planes, keys, p), keys)
    return planes.join(groups.select(*keys, F.col("node").alias("ord"), F.col("comp").alias("grp")), [*keys, "ord"], "left")


def merge_planes(planes: DataFrame, keys: Sequence[str], p: PlaneParams, keep_single: bool, order: Column | None = None) -> DataFrame:
    """Merge grouped planes by adding their moments; an unmatched plane survives only if asked."""
    grouped = plane_groups(planes, keys, p, order)
    if keep_single:
        grouped = grouped.withColumn("grp", F.coalesce("grp", "ord"))
    else:
        grouped = grouped.filter(F.col("grp").isNotNull())
    merged = grouped.groupBy(*keys, "grp").agg(*merge_aggs(), F.count("*").alias("parts"))
    return with_plane(merged)


def top_planes(planes: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """The ``count`` planes with most points per key, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("grp"))
    return planes.withColumn("plane", F.row_number().over(order)).filter(F.col("plane") <= count)


def project_planes(voxel_planes: DataFrame, keys: Sequence[str], p: PlaneParams) -> DataFrame:
    """Planes a key frame is projected on: merged groups, merged once more in size order."""
    first = merge_planes(voxel_planes, keys, p, keep_single=False)
    ranked = first.select(*keys, "grp", *MOMENTS, *CENTRE, *NORMAL, "d")
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "grp")).cast("bigint"))
    return merge_planes(ranked.drop("grp"), keys, p, keep_single=True, order=F.col("_r"))


def plane_lsq(points: DataFrame, keys: Sequence[str], max_residual: float = 0.2) -> DataFrame:
    """Least-squares plane a·p = -1 per group: (a0, a1, a2, mean_dist, n); none where a residual is too big."""
    x, y, z = [F.col(c).cast("double") for c in "xyz"]
    sums = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(x * x).alias("hxx"), F.sum(x * y).alias("hxy"), F.sum(x * z).alias("hxz"),
        F.sum(y * y).alias("hyy"), F.sum(y * z).alias("hyz"), F.sum(z * z).alias("hzz"),
        F.sum(-x).alias("bx"), F.sum(-y).alias("by"), F.sum(-z).alias("bz"),
    )
    fit = with_solution(sums, NORMAL_SUMS, ("bx", "by", "bz"), ("a0", "a1", "a2")).select(*keys, "n", "a0", "a1", "a2")
    residual = F.abs(F.col("a0") * x + F.col("a1") * y + F.col("a2") * z + 1.0)
    length = F.sqrt(F.col("a0") ** 2 + F.col("a1") ** 2 + F.col("a2") ** 2)
    checked = points.join(fit, list(keys)).groupBy(*keys, "n", "a0", "a1", "a2").agg(
        F.max(residual).alias("worst"), F.greatest(F.lit(0.01), F.avg(residual / length)).alias("mean_dist")
    )
    return checked.filter(F.col("worst") <= max_residual).drop("worst")


_BLOCK = 4096  # points of a group whose votes are counted at once


def _tested(points: Sequence[np.ndarray], corners: Sequence[np.ndarray], limit: float) -> np.ndarray:
    """Points within the limit of each plane, -1 where the three corners of a plane make none."""
    x, y, z = [np.asarray(c, float).reshape(-1, 3).T for c in corners]
    ux, uy, uz, vx, vy, vz = x[1] - x[0], y[1] - y[0], z[1] - z[0], x[2] - x[0], y[2] - y[0], z[2] - z[0]
    normal = np.stack([uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx], axis=1)
    length = np.sqrt(normal[:, 0] * normal[:, 0] + normal[:, 1] * normal[:, 1] + normal[:, 2] * normal[:, 2])
    sound = length > 1e-9
    normal = normal / np.where(sound, length, 1.0)[:, None]
    d = -(normal[:, 0] * x[0] + normal[:, 1] * y[0] + normal[:, 2] * z[0])
    gap = np.stack([np.asarray(c, float) for c in points], axis=1) @ normal.T + d
    return np.where(sound, (np.abs(gap) < limit).sum(axis=0), -1)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _votes(x: pd.Series, y: pd.Series, z: pd.Series, cx: pd.Series, cy: pd.Series, cz: pd.Series, distance: pd.Series) -> pd.Series:
    """Votes of the points of a block for each plane: one stacked product per block."""
    return pd.Series([_tested(r[:3], r[3:6], r[6]) for r in zip(x, y, z, cx, cy, cz, distance, strict=True)])


@F.pandas_udf(T.IntegerType())
def _winner(x: pd.Series, y: pd.Series, z: pd.Series, picks: pd.Series, distance: pd.Series) -> pd.Series:
    """First of the planes with most votes, where a block holds its whole group; -1 where no plane is sound."""
    out = []
    for *axes, at, limit in zip(x, y, z, picks, distance, strict=True):
        votes = _tested(axes, [c[at - 1] for c in axes], limit)
        out.append(int(votes.argmax()) if votes.max() >= 0 else -1)
    return pd.Series(out)


def _point_blocks(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _b, arrays _x, _y, _z): the points of a group in blocks of ``_BLOCK`` by their position ``_i``."""
    held = F.sort_array(F.collect_list(F.struct("_i", *[F.col(a).cast("double").alias(a) for a in "xyz"])))
    blocks = ranked.groupBy(*keys, F.floor((F.col("_i") - 1) / _BLOCK).alias("_b")).agg(held.alias("_q"))
    return blocks.select(*keys, "_b", *[F.col("_q." + a).alias("_" + a) for a in "xyz"])


def _picked(blocks: DataFrame, keys: Sequence[str], iterations: int, seed: int) -> DataFrame:
    """Blocks of groups of three points or more with ``_m``, the blocks of the group, and ``_pick``, the
    seeded positions of the three corners of each plane, one after the other."""
    size = blocks.groupBy(*keys).agg(F.sum(F.size("_x")).alias("_n"), F.count("*").alias("_m")).filter(F.col("_n") >= 3)
    hashed = lambda s: F.xxhash64(F.lit(seed), *keys, F.floor(s / 3).cast("int"), s % 3)
    pick = F.transform(F.sequence(F.lit(0), F.lit(3 * iterations - 1)), lambda s: (F.pmod(hashed(s), F.col("_n")) + 1).cast("int"))
    return blocks.join(size, list(keys)).withColumn("_pick", pick).drop("_n")


def _corners(picked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _c): the corners (s, x, y, z) of all planes of a group, taken from the blocks that hold them."""
    own = F.filter(F.transform("_pick", lambda p, s: F.struct(s.alias("s"), (p - F.col("_b") * _BLOCK).cast("int").alias("at"))), lambda e: e["at"].between(1, F.size("_x")))
    point = lambda e: F.struct(e["s"].alias("s"), *[F.element_at("_" + a, e["at"]).alias(a) for a in "xyz"])
    return picked.select(*keys, F.transform(own, point).alias("_c")).groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("_c"))).alias("_c"))


def _through(df: DataFrame, corners: Sequence[Sequence[Column]]) -> DataFrame:
    """Adds normal and d of the plane through three points; rows whose points make none are left out."""
    p0, p1, p2 = corners
    df = df.withColumns(dict(zip(NORMAL, g.cross(g.sub(p1, p0), g.sub(p2, p0)))))
    df = df.withColumn("_len", g.norm(g.cols(NORMAL))).filter(F.col("_len") > 1e-9)
    df = df.withColumns({n: F.col(n) / F.col("_len") for n in NORMAL})
    return df.withColumn("d", -g.dot(g.cols(NORMAL), p0)).drop("_len")


def plane_hypotheses(ranked: DataFrame, keys: Sequence[str], iterations: int, seed: int) -> DataFrame:
    """(keys, h, normal, d): planes through three points at seeded positions ``_i`` of the group, as rows."""
    corners = _corners(_picked(_point_blocks(ranked, keys), keys, iterations, seed), keys)
    rows = corners.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    rows = rows.select(*keys, "h", *[F.element_at("_c", 3 * F.col("h") + k + 1).alias(f"_p{k}") for k in range(3)])
    return _through(rows, [g.cols([f"_p{k}.{a}" for a in "xyz"]) for k in range(3)]).select(*keys, "h", *NORMAL, "d")


def plane_ransac(
    points: DataFrame, keys: Sequence[str], ident: str, block: Column, iterations: int = 1000,
    distance: float = 0.1, seed: int = 1,
) -> DataFrame:
    """Points with flag ``inlier`` of the dominant plane of each group.

    Points are held in blocks of ``_BLOCK``, a row each, and a block tests all planes of its group at once.
    A group of one block chooses its plane there; only votes of larger groups are summed by plane, so there
    are no rows of groups times planes beyond the number of points. The plane with most votes, of equal ones the
    first, is fitted again to its inliers, and the flag tells who lies within the distance of that one.
    """
    keys, limit = list(keys), F.lit(float(distance))
    ranked = row_number(points.select(*keys, ident, "x", "y", "z"), keys, [ident], block, "_i")
    picked = _picked(cut(_point_blocks(ranked, keys)), keys, iterations, seed)

    whole = picked.filter(F.col("_m") == 1).withColumn("h", _winner("_x", "_y", "_z", "_pick", limit)).filter(F.col("h") >= 0)
    corner = [[F.element_at("_" + a, F.element_at("_pick", 3 * F.col("h") + k + 1)).alias(f"{a}{k}") for a in "xyz"] for k in range(3)]
    chosen = whole.select(*keys, *[c for point in corner for c in point])

    parts = picked.filter(F.col("_m") > 1)
    corners = _corners(parts, keys)
    counted = parts.drop("_pick").join(corners, keys).withColumn("_v", _votes("_x", "_y", "_z", "_c.x", "_c.y", "_c.z", limit))
    votes = counted.select(*keys, F.posexplode("_v").alias("h", "v")).groupBy(*keys, "h").agg(F.sum("v").alias("votes")).filter(F.col("votes") >= 0)
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), "h")).alias("b")).select(*keys, "b.h")
    corner = [F.element_at("_c", 3 * F.col("h") + k + 1) for k in range(3)]
    chosen = chosen.unionByName(corners.join(best, keys).select(*keys, *[corner[k][a].alias(f"{a}{k}") for k in range(3) for a in "xyz"]))

    best = cut(_through(chosen, [g.cols([f"{a}{k}" for a in "xyz"]) for k in range(3)]).select(*keys, *NORMAL, "d"))
    hit = F.abs(g.dot(g.cols(NORMAL), g.cols("xyz")) + F.col("d")) < distance
    first = points.select(*keys, "x", "y", "z").join(best, keys).filter(hit)
    fitted = with_plane(first.groupBy(*keys).agg(*moment_aggs())).select(*keys, *NORMAL, "d")
    return points.join(fitted, keys, "left").withColumn("inlier", F.coalesce(hit, F.lit(False))).drop(*NORMAL, "d")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _covered(x: pd.Series, y: pd.Series, z: pd.Series, a0: pd.Series, a1: pd.Series, a2: pd.Series, distance: pd.Series) -> pd.Series:
    """Points of a block within the distance of each plane a·p = -1."""
    out = []
    for *columns, limit in zip(x, y, z, a0, a1, a2, distance, strict=True):
        px, py, pz, p0, p1, p2 = [np.asarray(c, float) for c in columns]
        gap = np.abs(p0 * px[:, None] + p1 * py[:, None] + p2 * pz[:, None] + 1.0) / np.sqrt(p0 * p0 + p1 * p1 + p2 * p2)
        out.append((gap < limit).sum(axis=0))
    return pd.Series(out)


def ground_plane(
    points: DataFrame, keys: Sequence[str], ident: str, block: Column, distance: float = 0.1,
    max_angle: float = 30.0 / 57.3, up: Sequence[float] = (0.0, 0.0, 1.0),
) -> DataFrame:
    """Ground plane per group: (keys, a0, a1, a2) where one is found.

    The points are cut into consecutive chunks of max(4, n/100). Each chunk whose plane is
    tight and level enough is a hypothesis. The first that covers more than 60 % of the
    points wins, else the first with most points. With more than 20 % or 500 inliers it is
    refitted on them. Points are stored once, in blocks of ``_BLOCK``; a block counts its points for
    all hypotheses of its group at once, so there are no rows of points times hypotheses.
    """
    keys = list(keys)
    blocks = cut(_point_blocks(row_number(points.select(*keys, ident, "x", "y", "z"), keys, [ident], block, "_i"), keys))
    size = blocks.groupBy(*keys).agg(F.sum(F.size("_x")).alias("_n"))
    sized = blocks.join(size, keys).withColumn("_w", F.greatest(F.lit(4), F.floor(F.col("_n") / 100)))

    def opened(df: DataFrame, *take: str) -> DataFrame:
        at = df.select(*keys, "_b", *take, F.posexplode(F.arrays_zip(*[F.col("_" + a).alias(a) for a in "xyz"])).alias("_i", "_q"))
        return at.select(*keys, *take, (F.col("_b") * _BLOCK + F.col("_i")).alias("_i"), "_q.x", "_q.y", "_q.z")

    chunked = opened(sized, "_n", "_w").withColumn("chunk", F.floor(F.col("_i") / F.col("_w"))).filter((F.col("chunk") + 1) * F.col("_w") <= F.col("_n"))

    def level(df: DataFrame) -> DataFrame:
        a = g.cols(["a0", "a1", "a2"])
        unit = [c / g.norm(a) for c in a]
        tilt = g.norm(g.cross(unit, [F.lit(float(v)) for v in up]))
        return df.filter((F.col("mean_dist") < distance) & (tilt < F.sin(F.lit(max_angle))))

    hypotheses = level(plane_lsq(chunked, [*keys, "chunk"])).select(*keys, "chunk", "a0", "a1", "a2")
    a = g.cols(["a0", "a1", "a2"])
    near = F.abs(g.dot(a, g.cols("xyz")) + 1.0) / g.norm(a) < distance
    stacked = hypotheses.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk", "a0", "a1", "a2"))).alias("_p"))
    counted = sized.drop("_b", "_w").join(stacked, keys).withColumn("_v", _covered("_x", "_y", "_z", "_p.a0", "_p.a1", "_p.a2", F.lit(float(distance))))
    counted = counted.select(*keys, "_n", F.explode(F.arrays_zip("_p", "_v")).alias("_r")).select(*keys, "_n", "_r._p.*", "_r._v")
    counts = counted.groupBy(*keys, "_n", "chunk").agg(*[F.first(c).alias(c) for c in ("a0", "a1", "a2")], F.sum("_v").alias("hits"))
    over = F.col("hits") > 0.6 * F.col("_n")
    rank = F.struct(F.when(over, F.lit(0)).otherwise(1).alias("o"), F.when(over, F.lit(0)).otherwise(-F.col("hits")).alias("h"), F.col("chunk"))
    best = counts.groupBy(*keys, "_n").agg(F.min_by(F.struct("a0", "a1", "a2", "hits"), rank).alias("b")).select(*keys, "_n", "b.*")
    best = best.filter((F.col("hits") > 0.2 * F.col("_n")) | (F.col("hits") > 500))
    best = cut(best)
    inliers = opened(blocks.join(best.select(*keys, "a0", "a1", "a2"), keys), "a0", "a1", "a2").filter(near).select(*keys, "x", "y", "z")
    refit = level(plane_lsq(inliers, keys)).select(*keys, *[F.col(f"a{i}").alias(f"r{i}") for i in range(3)])
    return best.join(refit, keys, "left").select(*keys, *[F.coalesce(f"r{i}", f"a{i}").alias(f"a{i}") for i in range(3)])


def plane_adjacency(planes: DataFrame, keys: Sequence[str], max_normal: float) -> DataFrame:
    """Pairs of planes in face-adjacent voxels with similar normals: (keys, a voxel, b voxel)."""
    steps = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for v, n in zip(s, ("sx", "sy", "sz"))]) for s in ((1, 0, 0), (0, 1, 0), (0, 0, 1))])
    a = planes.select(*keys, *KEYS, *NORMAL).withColumn("_s", F.explode(steps))
    a = a.withColumns({"o" + k: F.col(k) + F.col("_s." + c) for k, c in zip(KEYS, ("sx", "sy", "sz"))})
    b = planes.select(*keys, *[F.col(k).alias("o" + k) for k in KEYS], *[F.col(n).alias("o" + n) for n in NORMAL])
    both = a.join(b, [*keys, *["o" + k for k in KEYS]])
    return both.filter(_normals_close(g.cols(NORMAL), g.cols(NORMAL, "o"), max_normal)).select(*keys, *KEYS, *["o" + k for k in KEYS])


def point_voxel_plane(
    points: DataFrame, planes: DataFrame, size: float, keys: Sequence[str] = ("session",), ident: str = "point_idx",
    body_range: str = "body_range", sigma_num: float = 81.0, radius_factor: float = 3.0,
    range_noise: float = 0.02, degree_noise: float = 0.1,
) -> DataFrame:
    """Match each point with the plane of its voxel, else of the one neighbour voxel it leans to.

    ``planes`` carries the 21 uncertainty terms. A match lies within ``radius_factor`` radii
    of the centre along the plane and satisfies range > sigma_num · distance²; the most
    probable plane wins.
    """
    p = points.select(*keys, ident, "x", "y", "z", body_range).withColumns({k: voxel_key(F.col(a), size) for k, a in zip(KEYS, "xyz")})
    terms = [f"p{i}{j}" for i in range(6) for j in range(i, 6)]
    pl = planes.select(*keys, *KEYS, *CENTRE, *NORMAL, "d", "radius", *terms)

    def matched(df: DataFrame) -> DataFrame:
        away = g.dot(g.cols(NORMAL), g.cols("xyz")) + F.col("d")
        df = df.withColumn("away", F.abs(away))
        along2 = dist2(g.cols("xyz"), g.cols(CENTRE)) - F.col("away") * F.col("away")
        df = df.filter(
            (F.sqrt(F.greatest(along2, F.lit(0.0))) <= radius_factor * F.col("radius"))
            & (F.col(body_range) > sigma_num * F.col("away") * F.col("away"))
        )
        jac = [*g.sub(g.cols("xyz"), g.cols(CENTRE)), *[-c for c in g.cols(NORMAL)]]
        var = F.lit(0.0)
        for i in range(6):
            for j in range(i, 6):
                var = var + (1.0 if i == j else 2.0) * jac[i] * jac[j] * F.col(f"p{i}{j}")
        df = df.withColumn("_var", var)
        noise = g.point_covariance(g.cols("xyz"), range_noise, degree_noise)
        n = g.cols(NORMAL)
        across = F.lit(0.0)
        for k, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
            across = across + (1.0 if i == j else 2.0) * n[i] * n[j] * noise[k]
        df = df.withColumn("_var", F.col("_var") + across)
        df = df.withColumn("prob", F.exp(-0.5 * F.col("away") * F.col("away") / F.col("_var")) / F.sqrt(6.283185307179586 * F.col("_var")))
        best = F.max(F.struct("prob", "away", *CENTRE, *NORMAL, "d"))
        return df.filter(F.col("prob") > 0).groupBy(*keys, ident).agg(best.alias("m")).select(*keys, ident, "m.*")

    own = matched(p.join(pl, [*keys, *KEYS]))
    rest = p.join(own.select(*keys, ident), [*keys, ident], "left_anti")
    lean = {}
    for a, k in zip("xyz", KEYS):
        inside = F.col(a) / size - F.col(k)
        lean[k] = F.col(k) + F.when(inside > 0.75, 1).when(inside < 0.25, -1).otherwise(0)
    return own.unionByName(matched(rest.withColumns(lean).join(pl, [*keys, *KEYS])))


def nn5_plane(neighbours: DataFrame, keys: Sequence[str], ident: str, max_d2: float = 5.0, max_residual: float = 0.1) -> DataFrame:
    """Plane through each point's five nearest map points: (keys, ident, a0..a2, mean_dist).

    ``neighbours`` is the result of a 5-nearest join. The fifth must be within ``max_d2``.
    """
    ok = neighbours.groupBy(*keys, ident).agg(F.count("*").alias("c"), F.max("d2").alias("far")).filter((F.col("c") >= 5) & (F.col("far") <= max_d2))
    near = neighbours.join(ok.select(*keys, ident), [*keys, ident], "left_semi").select(*keys, ident, "near.x", "near.y", "near.z")
    fit = near.groupBy(*keys, ident).agg(
        F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias("h" + a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")],
        *[F.sum(-F.col(a)).alias("b" + a) for a in "xyz"], F.collect_list(F.struct("x", "y", "z")).alias("pts"),
    )
    fit = with_solution(fit, NORMAL_SUMS, ("bx", "by", "bz"), ("a0", "a1", "a2")).select(*keys, ident, "pts", "a0", "a1", "a2")
    length = F.sqrt(F.col("a0") ** 2 + F.col("a1") ** 2 + F.col("a2") ** 2)
    fit = fit.withColumns({"nx": F.col("a0") / length, "ny": F.col("a1") / length, "nz": F.col("a2") / length, "d": 1.0 / length})
    worst = F.array_max(F.transform("pts", lambda q: F.abs(F.col("nx") * q.x + F.col("ny") * q.y + F.col("nz") * q.z + F.col("d"))))
    return fit.withColumn("worst", worst).filter(F.col("worst") <= max_residual).select(*keys, ident, *NORMAL, "d", "worst")

"""Voxel aggregations: one hash aggregate each, combined map-side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.functions.linalg import COV, with_eigen
from scanloom.functions.voxel import KEYS, voxel_key, voxel_keys
from scanloom.operators.cells import dist2
from scanloom.params import PlaneParams
from scanloom.session import cut

SCAN = ("session", "scan_id")
MOMENTS = ("n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz")


def voxel_mean(points: DataFrame, size: float, keys: Sequence[str] = SCAN) -> DataFrame:
    """Mean position and intensity per voxel; below 0.01 the cloud is returned as it is."""
    if size < 0.01:
        return points.select(*keys, "x", "y", "z", "intensity")
    return (
        points.withColumns(voxel_keys(size)).groupBy(*keys, *KEYS)
        .agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "intensity")], F.count("*").alias("n"))
    )


def window_voxel_mean(points: DataFrame, windows: DataFrame, size: float) -> DataFrame:
    """Voxel mean of each sliding window of scans.

    Scans are reduced to voxel sums first; only those sums are copied into the windows a
    scan belongs to, never the points.
    """
    sums = points.withColumns(voxel_keys(size)).groupBy(*SCAN, *KEYS).agg(
        F.count("*").alias("n"), *[F.sum(c).alias("s" + c) for c in ("x", "y", "z")]
    )
    return (
        sums.join(windows, list(SCAN)).groupBy("session", "window", *KEYS)
        .agg(F.sum("n").alias("n"), *[F.sum("s" + c).alias("s" + c) for c in ("x", "y", "z")])
        .select("session", "window", *KEYS, "n", *[(F.col("s" + c) / F.col("n")).alias(c) for c in ("x", "y", "z")])
    )


def voxel_nearest(points: DataFrame, size: float, keys: Sequence[str] = (), ident: str = "point_idx") -> DataFrame:
    """Keep the point nearest the cell centre; the smaller id wins ties."""
    cell = {k: F.floor(F.col(a) / size).cast("bigint") for k, a in zip(KEYS, "xyz")}
    df = points.withColumns(cell)
    d2 = dist2(g.cols("xyz"), [(F.col(k) + 0.5) * size for k in KEYS])
    row = F.struct(d2.alias("d2"), F.col(ident), "x", "y", "z")
    return df.groupBy(*keys, *KEYS).agg(F.min(row).alias("r")).select(*keys, *KEYS, "r.*")


def grow_map(new_points: DataFrame, map_points: DataFrame, size: float, keys: Sequence[str] = (), ident: str = "point_idx") -> DataFrame:
    """New points that enter the map: the nearest to the centre of its cell, old points included.

    A cell already holding a map point closer to its centre takes nothing.
    """
    fresh = voxel_nearest(new_points, size, keys, ident)
    known = voxel_nearest(map_points, size, keys, ident).select(*keys, *KEYS, F.col("d2").alias("_old"))
    joined = fresh.join(known, [*keys, *KEYS], "left")
    return joined.filter(F.col("_old").isNull() | (F.col("d2") <= F.col("_old"))).drop("_old")


def moment_aggs() -> list:
    x, y, z = [F.col(c).cast("double") for c in "xyz"]
    return [
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(z).alias("sz"),
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(x * z).alias("sxz"),
        F.sum(y * y).alias("syy"), F.sum(y * z).alias("syz"), F.sum(z * z).alias("szz"),
    ]


def merge_aggs() -> list:
    return [F.sum(m).alias(m) for m in MOMENTS]


def with_covariance(df: DataFrame) -> DataFrame:
    """Centre and population covariance from moments."""
    n = F.col("n")
    df = df.withColumns({"c" + a: F.col("s" + a) / n for a in "xyz"})
    return df.withColumns({
        "c" + a + b: F.col("s" + a + b) / n - F.col("c" + a) * F.col("c" + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")
    })


def with_plane(df: DataFrame) -> DataFrame:
    """Eigenvalues, normal, radius and offset d from moments."""
    df = with_eigen(with_covariance(df))
    d = -(F.col("nx") * F.col("cx") + F.col("ny") * F.col("cy") + F.col("nz") * F.col("cz"))
    return df.withColumns({"d": d, "radius": F.sqrt(F.greatest(F.col("l3"), F.lit(0.0)))})


def voxel_moments(points: DataFrame, size: float, keys: Sequence[str] = SCAN) -> DataFrame:
    return points.withColumns(voxel_keys(size)).groupBy(*keys, *KEYS).agg(*moment_aggs())


def voxel_planes(points: DataFrame, p: PlaneParams, keys: Sequence[str] = SCAN) -> DataFrame:
    """Planar voxels: strictly more than ``min_points`` points and a small enough smallest eigenvalue."""
    fitted = with_plane(voxel_moments(points, p.voxel_size, keys).filter(F.col("n") > p.min_points))
    return fitted.filter(F.col("l1") < p.max_min_eigen)


def plane_tree(
    points: DataFrame, size: float, layers: int, min_points: int, max_min_eigen: float,
    min_mid_eigen: float = 0.01, keys: Sequence[str] = ("session",),
) -> DataFrame:
    """Coarsest planar cells of an octree with ``layers`` splits below the root voxel.

    Moments are summed once at the finest level; every fine cell then counts for its ancestor of
    each layer in one more sum. Planar cells are cut once, and those with a planar ancestor are
    taken out by one join, so the source is read once for any number of layers. A point on a
    split plane belongs to the lower half.
    """
    scale = 1 << layers
    roots = {k: voxel_key(F.col(a), size) for k, a in zip(KEYS, "xyz")}
    fine = {
        "f" + a: F.greatest(F.lit(0), F.ceil((F.col(a) / size - F.col(k)) * scale) - 1).cast("bigint")
        for k, a in zip(KEYS, "xyz")
    }
    leaf = ["fx", "fy", "fz"]

    def lifted(df: DataFrame, upper: str, levels: str) -> DataFrame:
        """Each cell once per layer in ``upper`` above it, with the ancestor's cell numbers."""
        df = df.withColumn("layer", F.explode(upper))
        return df.withColumns({f: F.expr(f"shiftright({f}, {levels} - layer)") for f in leaf})

    finest = points.withColumns(roots).withColumns(fine).groupBy(*keys, *KEYS, *leaf).agg(*moment_aggs())
    layer = F.sequence(F.lit(0), F.lit(layers))
    cells = lifted(finest.withColumn("_up", layer), "_up", str(layers)).groupBy(*keys, *KEYS, "layer", *leaf).agg(*merge_aggs())
    fitted = with_plane(cells.filter(F.col("n") > min_points)).filter((F.col("l1") < max_min_eigen) & (F.col("l2") > min_mid_eigen))
    planes = cut(fitted)
    ident = [*keys, *KEYS, "layer", *leaf]
    below = planes.filter(F.col("layer") > 0).select(*ident).withColumns({"_own": F.struct("layer", *leaf), "_layer": F.col("layer"), "_up": F.sequence(F.lit(0), F.col("layer") - 1)})
    covered = lifted(below, "_up", "_layer").join(planes.select(*ident), ident, "left_semi").select(*keys, *KEYS, "_own.*").distinct()
    return planes.join(covered, ident, "left_anti")


def plane_covariance(points: DataFrame, p: PlaneParams, range_noise: float, degree_noise: float, keys: Sequence[str] = SCAN) -> DataFrame:
    """6x6 uncertainty (normal, centre) of each planar voxel as its 21 upper terms.

    Second pass over the points: each contributes J V J' with its own noise covariance V.
    """
    fitted = with_covariance(voxel_moments(points, p.voxel_size, keys).filter(F.col("n") > p.min_points))
    fitted = with_eigen(fitted, longest=("mx", "my", "mz")).filter((F.col("l1") < p.max_min_eigen) & (F.col("l2") > 0.01))
    u, m = g.cols(["nx", "ny", "nz"]), g.cols(["mx", "my", "mz"])
    fitted = fitted.withColumns(dict(zip(("ox", "oy", "oz"), g.cross(u, m))))
    planes = fitted.select(*keys, *KEYS, "n", "l1", "l2", "l3", "nx", "ny", "nz", "mx", "my", "mz", "ox", "oy", "oz", *["c" + a for a in "xyz"])
    df = points.withColumns(voxel_keys(p.voxel_size)).join(planes, [*keys, *KEYS])
    df = df.withColumns({f"_v{i}": c for i, c in enumerate(g.point_covariance(g.cols("xyz"), range_noise, degree_noise))})
    w = g.sub(g.cols("xyz"), g.cols(["cx", "cy", "cz"]))
    df = df.withColumns({"_wu": g.dot(w, u)})
    o = g.cols(["ox", "oy", "oz"])
    df = df.withColumns({
        "_gm": 1.0 / (F.col("n") * (F.col("l1") - F.col("l3"))), "_go": 1.0 / (F.col("n") * (F.col("l1") - F.col("l2"))),
        "_wm": g.dot(w, m), "_wo": g.dot(w, o),
    })
    a = {}
    for i in range(3):
        for j in range(3):
            fm = (F.col("_wm") * u[j] + F.col("_wu") * m[j]) * F.col("_gm")
            fo = (F.col("_wo") * u[j] + F.col("_wu") * o[j]) * F.col("_go")
            a[f"_a{i}{j}"] = m[i] * fm + o[i] * fo
    df = df.withColumns(a)
    sym = {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 4, (2, 2): 5}

    def v(i, j):
        return F.col(f"_v{sym[(min(i, j), max(i, j))]}")

    def am(i, j):
        return F.col(f"_a{i}{j}")

    df = df.withColumns({f"_b{i}{j}": am(i, 0) * v(0, j) + am(i, 1) * v(1, j) + am(i, 2) * v(2, j) for i in range(3) for j in range(3)})
    aggs = []
    for i in range(3):
        for j in range(i, 3):
            top = F.col(f"_b{i}0") * am(j, 0) + F.col(f"_b{i}1") * am(j, 1) + F.col(f"_b{i}2") * am(j, 2)
            aggs.append(F.sum(top).alias(f"p{i}{j}"))
            aggs.append(F.sum(v(i, j) / (F.col("n") * F.col("n"))).alias(f"p{i + 3}{j + 3}"))
        for j in range(3):
            aggs.append(F.sum(F.col(f"_b{i}{j}") / F.col("n")).alias(f"p{i}{j + 3}"))
    return df.groupBy(*keys, *KEYS).agg(F.first("n").alias("n"), *aggs)


def update_moments(known: DataFrame, new_points: DataFrame, size: float, threshold: int, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Refit a voxel's plane once ``threshold`` new points have come in; keep it as it is before."""
    fresh = voxel_moments(new_points, size, keys)
    fresh = fresh.select(*keys, *KEYS, *[F.col(m).alias("_" + m) for m in MOMENTS])
    joined = known.select(*keys, *KEYS, *MOMENTS).join(fresh, [*keys, *KEYS], "full_outer")
    enough = F.coalesce(F.col("_n"), F.lit(0)) >= threshold
    cols = [
        (F.coalesce(F.col(m), F.lit(0)) + F.when(enough, F.coalesce(F.col("_" + m), F.lit(0))).otherwise(F.lit(0))).alias(m)
        for m in MOMENTS
    ]
    return joined.select(*keys, *KEYS, *cols, F.when(enough, F.lit(0)).otherwise(F.coalesce("_n", F.lit(0))).alias("pending")).filter(F.col("n") > 0)

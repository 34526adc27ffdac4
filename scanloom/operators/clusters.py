"""Clusters of moving points: voxel components, density clusters, boxes and label refinement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.functions.voxel import KEYS, floor_keys, pack
from scanloom.operators.cells import dist2, wide_cell, wide_touched, with_cell
from scanloom.operators.components import connected_components
from scanloom.operators.planes import plane_lsq
from scanloom.operators.planes import ground_plane
from scanloom.session import cut

SCAN = ("session", "scan_id")
OTHER = ("ox", "oy", "oz")


def _sphere(reach: int, half: bool) -> Column:
    steps = [
        (i, j, k) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) for k in range(-reach, reach + 1)
        if (i * i + j * j + k * k) ** 0.5 - reach < 0.001 and (not half or (i, j, k) >= (0, 0, 0))
    ]
    return F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(f"s{a}") for v, a in zip(s, "xyz")]) for s in steps])


def voxel_neighbours(voxels: DataFrame, keys: Sequence[str], reach: int, half: bool = False) -> DataFrame:
    """Pairs (voxel, other) of occupied voxels within a sphere of ``reach`` cells; each with itself too."""
    a = voxels.select(*keys, *KEYS).withColumn("_s", F.explode(_sphere(reach, half)))
    a = a.withColumns({o: F.col(k) + F.col(f"_s.s{x}") for o, k, x in zip(OTHER, KEYS, "xyz")}).drop("_s")
    b = voxels.select(*keys, *[F.col(k).alias(o) for k, o in zip(KEYS, OTHER)])
    return a.join(b, [*keys, *OTHER], "left_semi")


def cluster_voxels(points: DataFrame, keys: Sequence[str], size: float, reach: int, min_voxels: int, origin: Sequence[float] = (0.0, 0.0, 0.0), name: str = "cluster") -> DataFrame:
    """Occupied voxels with their cluster: (keys, voxel, n, cluster); small clusters are left out.

    The cluster is named by its smallest packed voxel.
    """
    vox = points.withColumns(floor_keys(size, origin)).groupBy(*keys, *KEYS).agg(F.count("*").alias("n"))
    vox = cut(vox)
    pairs = voxel_neighbours(vox, keys, reach, half=True)
    edges = pairs.select(*keys, pack(g.cols(KEYS)).alias("a"), pack(g.cols(OTHER)).alias("b"))
    comp = connected_components(edges, keys)
    named = vox.withColumn("node", pack(g.cols(KEYS))).join(comp, [*keys, "node"]).withColumnRenamed("comp", name).drop("node")
    big = named.groupBy(*keys, name).agg(F.count("*").alias("_v")).filter(F.col("_v") >= min_voxels)
    return named.join(big.drop("_v"), [*keys, name])


def cluster_boxes(vox: DataFrame, keys: Sequence[str], size: float, min_voxels: int, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Box, size and point count per cluster; kept when at least two axes exceed one voxel."""
    aggs = [F.sum("n").alias("n"), F.count("*").alias("voxels")]
    for a, k, o in zip("xyz", KEYS, origin):
        aggs += [(o + F.min(k) * size).alias("min_" + a), (o + (F.max(k) + 1) * size).alias("max_" + a)]
    boxes = vox.groupBy(*keys, "cluster").agg(*aggs)
    if min_voxels == 1:
        return boxes
    wide = [F.col("max_" + a) - F.col("min_" + a) > size + 0.001 for a in "xyz"]
    return boxes.filter((wide[0] & wide[1]) | (wide[0] & wide[2]) | (wide[1] & wide[2]))


def largest_component(points: DataFrame, keys: Sequence[str], size: float, reach: int, min_voxels: int, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Points in the largest voxel cluster of their key; the smallest cluster name wins ties."""
    vox = cluster_voxels(points, keys, size, reach, min_voxels, origin, "_part")
    count = vox.groupBy(*keys, "_part").agg(F.count("*").alias("c"))
    best = count.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("m"), "_part")).alias("b")).select(*keys, "b._part")
    keep = vox.join(best, [*keys, "_part"]).select(*keys, *KEYS)
    return points.withColumns(floor_keys(size, origin)).join(keep, [*keys, *KEYS], "left_semi").drop(*KEYS)


def dbscan(points: DataFrame, keys: Sequence[str], ident: str, eps: float, min_points: int, min_size: int = 1, max_size: int = 1 << 60) -> DataFrame:
    """Density clusters as (keys, ident, cluster, core); noise has no row.

    In a cell whose diagonal is ``eps`` all points are neighbours of each other: a full cell
    is all core without any comparison, the cores of one cell share a cluster, and clusters
    are components of cells, not of points. A border point goes to its lowest cluster.
    """
    fine, cell, xyz = ["_fx", "_fy", "_fz"], ["_cx", "_cy", "_cz"], ["x", "y", "z"]

    def in_fine(t: DataFrame) -> DataFrame:
        return with_cell(t, eps / 3 ** 0.5, names=fine)

    def left(t: DataFrame, *take: str) -> DataFrame:
        return wide_touched(t.select(*keys, *take, *xyz), eps, xyz, cell)

    def right(t: DataFrame, *take: str) -> DataFrame:
        return wide_cell(t, eps, xyz, cell).select(*keys, *cell, *[F.col(c).alias("_p" + c) for c in (*xyz, *take)])

    # Cells are worked out where they are needed; what is stored and shuffled is the points.
    base = in_fine(points.select(*keys, ident, *xyz))
    crowd = base.groupBy(*keys, *fine).agg(F.count("*").alias("_c")).filter(F.col("_c") > 1)
    df = cut(base.join(crowd, [*keys, *fine], "left").select(*keys, ident, *xyz, F.coalesce("_c", F.lit(1)).alias("_c")))
    full = F.col("_c") >= min_points

    close = dist2(g.cols("xyz"), g.cols(["_px", "_py", "_pz"])) < eps * eps
    near = left(df.filter(~full), ident).join(right(df), [*keys, *cell]).filter(close)
    grown = near.groupBy(*keys, ident).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_points)
    core = df.filter(full).select(*keys, ident).unionByName(grown.select(*keys, ident)).distinct().withColumn("_core", F.lit(True))
    df = cut(df.join(core, [*keys, ident], "left"))
    cores, outside = df.filter("_core"), df.filter(F.col("_core").isNull())
    shared = in_fine(cores.filter(F.col("_c") > 1))
    reps = shared.groupBy(*keys, *fine).agg(F.min(ident).alias("rep"))
    cores = shared.join(reps, [*keys, *fine]).select(*keys, ident, *xyz, "rep").unionByName(
        cores.filter(F.col("_c") == 1).select(*keys, ident, *xyz, F.col(ident).alias("rep")))
    cores = cut(cores)
    links = left(cores, "rep").join(right(cores, "rep"), [*keys, *cell]).filter((F.col("rep") < F.col("_prep")) & close)
    edges = links.select(*keys, F.col("rep").alias("a"), F.col("_prep").alias("b")).unionByName(cores.select(*keys, F.col("rep").alias("a"), F.col("rep").alias("b")))
    comp = connected_components(edges, keys)
    named = cut(cores.join(comp.select(*keys, F.col("node").alias("rep"), F.col("comp").alias("cluster")), [*keys, "rep"]).select(*keys, ident, "cluster", *xyz))
    border = (
        left(outside, ident).join(right(named, "cluster"), [*keys, *cell]).filter(close)
        .groupBy(*keys, ident).agg(F.min("_pcluster").alias("cluster")).withColumn("core", F.lit(False))
    )
    out = named.select(*keys, ident, "cluster", F.lit(True).alias("core")).unionByName(border.select(*keys, ident, "cluster", "core"))
    if min_size <= 1 and max_size >= 1 << 60:
        return out
    sizes = out.groupBy(*keys, "cluster").agg(F.count("*").alias("_n")).filter(F.col("_n").between(min_size, max_size))
    return out.join(sizes.drop("_n"), [*keys, "cluster"]).select(*keys, ident, "cluster", "core")


def normal_bin(n: Sequence[Column], rings: int = 3) -> Column:
    """Bin of a unit normal on the equal-area disk: ring by radius, then sector in the ring."""
    theta = F.atan2(n[1], n[0])
    theta = F.when(theta < 0, theta + 2 * 3.14159265358979).otherwise(theta)
    radius = 2.0 * F.sin(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n[2]))) / 2.0)
    bins = F.when(radius <= 2 ** 0.5 / (2 * rings + 1), F.lit(0))
    for i in range(rings):
        outer = 2 ** 0.5 * (2 * (i + 1) + 1) / (2 * rings + 1)
        sectors = 8 * (i + 1)
        sector = F.least(F.floor(theta / (2 * 3.14159265358979) * sectors), F.lit(sectors - 1))
        inside = radius <= outer if i < rings - 1 else F.lit(True)
        bins = bins.when(inside, (2 * i + 1) ** 2 - 1 + sector)
    return bins.cast("int")


def cluster_obb(points: DataFrame, normals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Oriented box per cluster: first axis from the heaviest normal bin, second from the
    heaviest bin not parallel to it, third across; extents of the points in that frame.

    ``normals`` has (keys, nx, ny, nz, weight), one row per local plane of the cluster.
    """
    up = F.when(F.col("nz") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    n = normals.withColumns({c: F.col(c) * up for c in ("nx", "ny", "nz")})
    n = n.withColumn("bin", normal_bin(g.cols(["nx", "ny", "nz"])))
    bins = n.groupBy(*keys, "bin").agg(F.sum("weight").alias("w"), *[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("nx", "ny", "nz")])
    length = g.norm(g.cols(["nx", "ny", "nz"]))
    bins = bins.withColumn("_l", length).filter(F.col("_l") > 0).withColumns({c: F.col(c) / F.col("_l") for c in ("nx", "ny", "nz")}).drop("_l")
    heavy = F.struct((-F.col("w")).alias("m"), "bin", "nx", "ny", "nz")
    first = bins.groupBy(*keys).agg(F.min(heavy).alias("f")).select(*keys, *[F.col(f"f.n{a}").alias("u" + a) for a in "xyz"])
    rest = bins.join(first, list(keys)).filter(F.abs(g.dot(g.cols(["nx", "ny", "nz"]), g.cols(["ux", "uy", "uz"]))) < 0.5)
    second = rest.groupBy(*keys).agg(F.min(heavy).alias("s")).select(*keys, *[F.col(f"s.n{a}").alias("w" + a) for a in "xyz"])
    axes = first.join(second, list(keys), "left")
    u = g.cols(["ux", "uy", "uz"])
    spare = [F.when(F.abs(u[0]) < 0.9, 1.0).otherwise(0.0), F.when(F.abs(u[0]) < 0.9, 0.0).otherwise(1.0), F.lit(0.0)]
    w = [F.coalesce(F.col("w" + a), c) for a, c in zip("xyz", spare)]
    flat = g.sub(w, [g.dot(w, u) * c for c in u])
    axes = axes.withColumns(dict(zip(("_fx", "_fy", "_fz"), flat))).withColumn("_fl", g.norm(g.cols(["_fx", "_fy", "_fz"])))
    axes = axes.withColumns({"s" + a: F.col("_f" + a) / F.col("_fl") for a in "xyz"})
    axes = axes.withColumns(dict(zip(("tx", "ty", "tz"), g.cross(u, g.cols(["sx", "sy", "sz"])))))
    axes = axes.select(*keys, *[p + a for p in "ust" for a in "xyz"])
    df = points.join(axes, list(keys))
    along = {p: g.dot(g.cols("xyz"), g.cols([p + a for a in "xyz"])) for p in "ust"}
    return df.groupBy(*keys, *[p + a for p in "ust" for a in "xyz"]).agg(
        *[F.min(c).alias("min_" + p) for p, c in along.items()], *[F.max(c).alias("max_" + p) for p, c in along.items()]
    )


def _box_regions(boxes: DataFrame, keys: Sequence[str], size: float, origin: Sequence[float], coarse: int) -> DataFrame:
    """Voxel ranges around each box: max(1 m, extent) to each side, cut into coarse cells."""
    df = boxes
    for a, k, o in zip("xyz", KEYS, origin):
        centre = F.floor(((F.col("min_" + a) + F.col("max_" + a)) / 2 - o) / size).cast("bigint")
        reach = F.floor(F.greatest(F.lit(1.0), F.col("max_" + a) - F.col("min_" + a)) / size + 1e-6).cast("bigint")
        df = df.withColumns({"_lo" + k: centre - reach, "_hi" + k: centre + reach + 1})
        df = df.withColumn("_g" + k, F.explode(F.sequence(F.floor(F.col("_lo" + k) / coarse), F.floor(F.col("_hi" + k) / coarse))))
    return df


def refine_clusters(
    points: DataFrame, keys: Sequence[str], ident: str, block: Column, size: float, reach: int, min_voxels: int,
    trust: float, origin: Sequence[float] = (0.0, 0.0, 0.0), ground_distance: float = 0.1,
) -> DataFrame:
    """Rebuild moving labels from clusters: (keys, ident, tag).

    ``points`` has (keys, ident, x, y, z, moving), without invalid points. Empty voxels around
    a cluster box are its ground candidates, points in empty voxels inside the box join it,
    upright patches next to it join it, ground points leave it, and so does everything
    outside its largest component. A cluster that grew too much over its moving points is
    dropped whole. Where boxes overlap, the later box owns the voxel.
    """
    keys = list(keys)
    pts = cut(points.select(*keys, ident, "x", "y", "z", "moving").withColumns(floor_keys(size, origin)))
    moving = pts.filter("moving")
    vox = cut(cluster_voxels(moving.drop(*KEYS), keys, size, reach, min_voxels, origin))
    boxes = cut(cluster_boxes(vox, keys, size, min_voxels, origin))
    boxed = vox.join(boxes.select(*keys, "cluster"), [*keys, "cluster"], "left_semi")
    # A voxel with moving points counts as occupied unless its cluster's box was too thin.
    thin = vox.join(boxes.select(*keys, "cluster"), [*keys, "cluster"], "left_anti").select(*keys, *KEYS)
    occupied = moving.select(*keys, *KEYS).distinct().join(thin, [*keys, *KEYS], "left_anti")
    coarse = 16
    free = pts.select(*keys, *KEYS).distinct().join(occupied, [*keys, *KEYS], "left_anti")
    free = free.withColumns({"_g" + k: F.floor(F.col(k) / coarse) for k in KEYS})
    around = free.join(_box_regions(boxes, keys, size, origin, coarse), [*keys, *["_g" + k for k in KEYS]])
    inside = F.lit(True)
    for a, k, o in zip("xyz", KEYS, origin):
        around = around.filter(F.col(k).between(F.col("_lo" + k), F.col("_hi" + k)))
        middle = o + (F.col(k) + 0.5) * size
        inside = inside & (middle > F.col("min_" + a)) & (middle < F.col("max_" + a))
    around = cut(around.withColumn("inside", inside).select(*keys, *KEYS, "cluster", "inside"))
    owner = around.groupBy(*keys, *KEYS).agg(
        F.max(F.when(~F.col("inside"), F.col("cluster"))).alias("ground_of"), F.max(F.when(F.col("inside"), F.col("cluster"))).alias("inside_of")
    )
    own = owner.unionByName(boxed.select(*keys, *KEYS, F.col("cluster").alias("cluster_of")), allowMissingColumns=True)
    placed = cut(pts.drop("moving").join(own, [*keys, *KEYS]))
    group = [*keys, "cluster"]
    ground = placed.filter(F.col("ground_of").isNotNull()).withColumn("cluster", F.col("ground_of"))
    members = placed.filter(F.col("ground_of").isNull()).withColumn("cluster", F.coalesce("cluster_of", "inside_of"))
    members = members.filter(F.col("cluster").isNotNull()).select(*group, ident, "x", "y", "z", *KEYS)
    planes = cut(ground_plane(ground.select(*group, ident, "x", "y", "z"), group, ident, block, distance=ground_distance))
    a = g.cols(["a0", "a1", "a2"])
    off = F.abs(g.dot(a, g.cols("xyz")) + 1.0) / g.norm(a)

    # Upright patches: ring voxels without ground points, next to the cluster.
    on_ground = ground.join(planes, group).filter(off < ground_distance).select(*group, *KEYS).distinct()
    ring = around.filter(~F.col("inside")).select(*group, *KEYS).join(on_ground, [*group, *KEYS], "left_anti").join(planes, group)
    crowd = ground.groupBy(*keys, *KEYS).agg(F.count("*").alias("_n")).filter(F.col("_n") > 2).drop("_n")
    ring = ring.join(crowd, [*keys, *KEYS], "left_semi")
    faces = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(f"s{x}") for v, x in zip(st, "xyz")]) for st in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    touch = ring.select(*group, *KEYS, "a0", "a1", "a2", F.explode(faces).alias("_s"))
    touch = touch.withColumns({o: F.col(k) + F.col(f"_s.s{x}") for o, k, x in zip(OTHER, KEYS, "xyz")})
    solid = members.select(*group, *[F.col(k).alias(o) for k, o in zip(KEYS, OTHER)]).distinct()
    touch = touch.join(solid, [*group, *OTHER], "left_semi").select(*group, *KEYS, "a0", "a1", "a2").distinct()
    patch_points = ground.select(*keys, *KEYS, ident, "x", "y", "z").join(touch, [*keys, *KEYS])
    patch = plane_lsq(patch_points.drop("a0", "a1", "a2"), [*group, *KEYS]).select(*group, *KEYS, *[F.col(f"a{i}").alias(f"b{i}") for i in range(3)])
    b = g.cols(["b0", "b1", "b2"])
    upright = F.abs(g.dot(a, b)) / (g.norm(a) * g.norm(b)) < 0.8
    extra = patch_points.join(patch, [*group, *KEYS]).filter(upright).select(*group, ident, "x", "y", "z")

    body = members.select(*group, ident, "x", "y", "z").unionByName(extra)
    body = body.join(planes, group, "left").filter(F.col("a0").isNull() | (off > ground_distance)).drop("a0", "a1", "a2")
    body = cut(body)
    few = body.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") < 2).drop("_n")
    kept = largest_component(body, group, size, reach, min_voxels, origin).unionByName(body.join(few, group, "left_semi"))
    sizes = kept.groupBy(*group).agg(F.count("*").alias("_size"))
    good = boxes.select(*group, F.col("n").alias("_moving")).join(sizes, group).filter(F.col("_moving") / F.col("_size") >= trust)
    final = kept.join(good, group, "left_semi").select(*keys, ident).distinct().withColumn("tag", F.lit(1))
    return pts.select(*keys, ident).join(final, [*keys, ident], "left").withColumn("tag", F.coalesce("tag", F.lit(0)))

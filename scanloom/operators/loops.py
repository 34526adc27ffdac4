"""Loop verification: pose hypotheses, consensus, plane overlap, refinement and filtering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import geometry as g
from scanloom.functions.linalg import rigid_fit
from scanloom.operators.cells import dist2, knn, nearest_capped, within
from scanloom.operators.planes import CENTRE, NORMAL
from scanloom.operators.triangles import CORNERS, PAIR
from scanloom.params import LoopParams

POSE = [*g.ROT, *g.TRANS]


def _corner_array(side: str) -> Column:
    return F.array(*[F.col(f"{side}.{c}.{x}") for c in CORNERS for x in "xyz"])


def _pose_columns(array: str) -> list[Column]:
    return [F.col(array)[i].alias(n) for i, n in enumerate(POSE)]


def number_matches(matches: DataFrame) -> DataFrame:
    """Number the matches of each candidate from 0 in (query id, database id) order."""
    order = Window.partitionBy(*PAIR).orderBy("q.sid", "d.kx", "d.ky", "d.kz", "d.sid") if "kx" in matches.select("d.*").columns else Window.partitionBy(*PAIR).orderBy("q.sid", "d.sid")
    sized = F.count("*").over(Window.partitionBy(*PAIR))
    known = F.lit(True)
    for c in PAIR:
        known = known & F.col(c).isNotNull()
    return matches.filter(known).withColumn("i", F.row_number().over(order) - 1).withColumn("total", sized)


def hypotheses(numbered: DataFrame, p: LoopParams) -> DataFrame:
    """Rigid motion of every sampled match: at most ``max_hypotheses`` per candidate."""
    skip = F.floor(F.col("total") / p.max_hypotheses) + 1
    use = F.floor(F.col("total") / skip)
    picked = numbered.filter((F.col("i") % skip == 0) & (F.floor(F.col("i") / skip) < use))
    fitted = picked.select(*PAIR, F.col("i").alias("h"), rigid_fit(_corner_array("q"), _corner_array("d")).alias("_m"))
    return fitted.select(*PAIR, "h", *_pose_columns("_m"))


def _all_corners_close(limit: float) -> Column:
    ok = F.lit(True)
    for c in CORNERS:
        moved = g.rigid(g.cols(g.ROT), g.cols(g.TRANS), g.cols([f"q.{c}.{x}" for x in "xyz"]))
        ok = ok & (dist2(moved, g.cols([f"d.{c}.{x}" for x in "xyz"])) < limit * limit)
    return ok


def consensus(matches: DataFrame, p: LoopParams) -> DataFrame:
    """Best motion per candidate: (PAIR, votes, rotation, translation); at least ``min_votes`` votes.

    All matches of a candidate are tested against its sampled hypotheses, at most
    ``max_hypotheses`` of them. Votes are combined map-side; the first hypothesis wins ties.
    """
    numbered = number_matches(matches)
    hyps = hypotheses(numbered, p)
    tested = numbered.join(hyps, list(PAIR)).groupBy(*PAIR, "h", *POSE).agg(F.count_if(_all_corners_close(p.vertex_distance)).alias("votes"))
    best = F.min_by(F.struct("votes", *POSE), F.struct(-F.col("votes"), F.col("h")))
    return tested.groupBy(*PAIR).agg(best.alias("b")).select(*PAIR, "b.*").filter(F.col("votes") >= p.min_votes)


def split_matches(matches: DataFrame, best: DataFrame, p: LoopParams) -> DataFrame:
    """Matches of accepted candidates with flag ``inlier``."""
    return matches.join(best.drop("votes"), list(PAIR)).withColumn("inlier", _all_corners_close(p.vertex_distance)).drop(*POSE)


def rotation_consensus(matches: DataFrame, p: LoopParams, max_angle: float = 10.0 / 57.3, min_members: int = 5, limit: float = 5.0) -> DataFrame:
    """Older variant: hypotheses with many others within ``max_angle`` compete, corners within ``limit``."""
    numbered = number_matches(matches)
    hyps = hypotheses(numbered, p)
    other = hyps.select(*PAIR, F.col("h").alias("h2"), *[F.col(c).alias("o" + c) for c in g.ROT])
    trace = sum((F.col(c) * F.col("o" + c) for c in g.ROT), F.lit(0.0))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))
    members = hyps.join(other, list(PAIR)).groupBy(*PAIR, "h").agg(F.count_if(angle < max_angle).alias("members")).filter(F.col("members") >= min_members)
    tested = numbered.join(hyps.join(members, [*PAIR, "h"]), list(PAIR)).groupBy(*PAIR, "h", "members", *POSE).agg(F.count_if(_all_corners_close(limit)).alias("votes"))
    best = F.min_by(F.struct("votes", "members", *POSE), F.struct(-F.col("votes"), F.col("h")))
    return tested.groupBy(*PAIR).agg(best.alias("b")).select(*PAIR, "b.*")


def match_quality(matches: DataFrame) -> DataFrame:
    """Mean relative side error and mean similarity per candidate."""
    return matches.groupBy(*PAIR).agg(
        F.avg(F.col("side_dist") / F.col("_len")).alias("side_error"), F.avg("similarity").alias("mean_similarity"), F.count("*").alias("n")
    )


def nearest_planes(loops: DataFrame, planes: DataFrame, size: float = 4.0) -> DataFrame:
    """Each source plane moved by the candidate's motion, with the nearest target plane's centre.

    ``planes`` has (session, keyframe, pid, centre, normal). The nearest centre has no
    distance cap; the search doubles its cell size until every plane has found one.
    """
    cols = ["pid", *CENTRE, *NORMAL]
    src = loops.select(*PAIR, *POSE).join(planes.select("session", "keyframe", *cols), ["session", "keyframe"])
    moved = dict(zip("xyz", g.rigid(g.cols(g.ROT), g.cols(g.TRANS), g.cols(CENTRE))))
    turned = dict(zip(("mx", "my", "mz"), g.mat_vec(g.cols(g.ROT), g.cols(NORMAL))))
    src = src.withColumns({**moved, **turned}).drop(*POSE)
    dst = loops.select(*PAIR).join(
        planes.select(F.col("session").alias("map_session"), F.col("keyframe").alias("db_keyframe"), F.col("pid").alias("tid"),
                      *[F.col(c).alias(a) for c, a in zip(CENTRE, "xyz")], *NORMAL),
        ["map_session", "db_keyframe"],
    )
    near = knn(src, dst, PAIR, "pid", "tid", 1, size, take=NORMAL)
    flat = near.select(*PAIR, "pid", *[F.col(f"near.{a}").alias("t" + a + "0") for a in "xyz"], *[F.col(f"near.{n}").alias("t" + n) for n in NORMAL])
    return src.join(flat, [*PAIR, "pid"])


def plane_pairs(near: DataFrame, normal_limit: float, plane_limit: float, point_limit: float | None = None) -> DataFrame:
    """Flag ``ok``: normals agree up to sign and the point-to-plane (and point) distance is small."""
    m, t = g.cols(["mx", "my", "mz"]), g.cols(["tnx", "tny", "tnz"])
    off = g.sub(g.cols("xyz"), g.cols(["tx0", "ty0", "tz0"]))
    minus, plus = g.sub(m, t), g.add(m, t)
    ok = ((g.norm(minus) < normal_limit) | (g.norm(plus) < normal_limit)) & (F.abs(g.dot(t, off)) < plane_limit)
    if point_limit is not None:
        ok = ok & (g.norm(off) < point_limit)
    return near.withColumn("ok", ok)


def plane_overlap(loops: DataFrame, planes: DataFrame, p: LoopParams, size: float = 4.0) -> DataFrame:
    """Share of source planes whose nearest target plane is compatible, per candidate."""
    flagged = plane_pairs(nearest_planes(loops, planes, size), p.normal_threshold, p.plane_distance)
    scores = flagged.groupBy(*PAIR).agg(F.avg(F.col("ok").cast("double")).alias("score"))
    return loops.join(scores, list(PAIR))


def best_loops(scored: DataFrame, p: LoopParams) -> DataFrame:
    """Best candidate per (key frame, map): highest score, then more votes, then the lower frame.

    Accepted above ``accept_score``; inside one session only with ``frame_gap`` frames between.
    """
    rest = [c for c in scored.columns if c not in ("session", "keyframe", "map_session")]
    order = F.struct(-F.col("score"), -F.col("votes"), F.col("db_keyframe"))
    best = scored.groupBy("session", "keyframe", "map_session").agg(F.min_by(F.struct(*rest), order).alias("b"))
    best = best.select("session", "keyframe", "map_session", "b.*")
    far = (F.col("map_session") != F.col("session")) | (F.col("keyframe") - F.col("db_keyframe") >= p.frame_gap)
    return best.filter((F.col("score") > p.accept_score) & far)


def _icp_terms() -> list[Column]:
    """Entries of a with residual = a · (R row-major, t, 1)."""
    n = g.cols(["tnx", "tny", "tnz"])
    q = g.cols(["tx0", "ty0", "tz0"])
    return [*[n[i] * F.col(CENTRE[j]) for i in range(3) for j in range(3)], *n, -g.dot(n, q)]


def _refine_batch(m: pd.Series, start: pd.Series) -> pd.Series:
    out = []
    upper = np.triu_indices(13)
    for mv, sv in zip(m, start):
        big = np.zeros((13, 13))
        big[upper] = np.asarray(mv, dtype=float)
        big = big + np.triu(big, 1).T
        theta = np.append(np.asarray(sv, dtype=float), 1.0)
        damp = 1e-9
        for _ in range(50):
            r = theta[:9].reshape(3, 3)
            jac = np.zeros((13, 6))
            for k in range(3):
                axis = np.zeros((3, 3))
                a, b = [(1, 2), (2, 0), (0, 1)][k]
                axis[b, a], axis[a, b] = 1.0, -1.0
                jac[:9, k] = (axis @ r).ravel()
                jac[9:12, k] = axis @ theta[9:12]
                jac[9 + k, 3 + k] = 1.0
            h, b = jac.T @ big @ jac, jac.T @ big @ theta
            step = -np.linalg.lstsq(h + damp * np.eye(6) * max(np.trace(h), 1e-12), b, rcond=None)[0]
            w, angle = step[:3], np.linalg.norm(step[:3])
            turn = np.eye(3)
            if angle > 1e-12:
                k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / angle
                turn = np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k
            new = np.concatenate([(turn @ r).ravel(), turn @ theta[9:12] + step[3:], [1.0]])
            if new @ big @ new > theta @ big @ theta + 1e-15:
                damp *= 10
                if damp > 1:
                    break
                continue
            done = np.abs(step).max() < 1e-12
            theta = new
            if done:
                break
        out.append(theta[:12])
    return pd.Series(out)


def plane_icp(loops: DataFrame, planes: DataFrame, p: LoopParams, size: float = 4.0) -> DataFrame:
    """Point-to-plane refinement of each loop's motion with fixed correspondences.

    The residual is linear in the entries of (R, t), so all that the minimiser needs of the
    correspondences is one 13x13 matrix per loop: a single aggregation of 91 sums replaces a
    pass over the data per iteration. The iterations run on loop rows.
    """
    pairs = plane_pairs(nearest_planes(loops, planes, size), p.normal_threshold, p.plane_distance, p.icp_point_distance).filter("ok")
    terms = pairs.select(*PAIR, *[c.alias(f"_a{i}") for i, c in enumerate(_icp_terms())])
    products = [F.sum(F.col(f"_a{i}") * F.col(f"_a{j}")).alias(f"_m{i}_{j}") for i in range(13) for j in range(i, 13)]
    sums = terms.groupBy(*PAIR).agg(F.count("*").alias("pairs"), *products)
    packed = sums.select(*PAIR, "pairs", F.array(*[F.col(f"_m{i}_{j}") for i in range(13) for j in range(i, 13)]).alias("_m"))
    refine = F.pandas_udf(_refine_batch, T.ArrayType(T.DoubleType()))
    df = loops.join(packed, list(PAIR)).withColumn("_r", refine("_m", F.array(*g.cols(POSE))))
    keep = [c for c in loops.columns if c not in POSE]
    return df.select(*keep, "pairs", *_pose_columns("_r"))


def point_icp_sums(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closed-form point-to-point motion per key from (x, y, z) and (qx, qy, qz): covariance sums only."""
    p, q = g.cols("xyz"), g.cols(["qx", "qy", "qz"])
    aggs = [F.count("*").alias("n"), *[F.avg(c).alias(f"p{i}") for i, c in enumerate(p)], *[F.avg(c).alias(f"q{i}") for i, c in enumerate(q)]]
    aggs += [F.avg(p[i] * q[j]).alias(f"w{i}{j}") for i in range(3) for j in range(3)]
    sums = pairs.groupBy(*keys).agg(*aggs)
    cov = [F.col(f"w{i}{j}") - F.col(f"p{i}") * F.col(f"q{j}") for i in range(3) for j in range(3)]

    def solve(h: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        u, _, vt = np.linalg.svd(np.stack([np.asarray(v, dtype=float).reshape(3, 3) for v in h]))
        v, ut = np.swapaxes(vt, 1, 2), np.swapaxes(u, 1, 2)
        v[:, :, 2] *= np.where(np.linalg.det(v @ ut) < 0, -1.0, 1.0)[:, None]
        r = v @ ut
        t = np.stack([np.asarray(x, dtype=float) for x in b]) - np.einsum("nij,nj->ni", r, np.stack([np.asarray(x, dtype=float) for x in a]))
        return pd.Series([np.concatenate([ri.ravel(), ti]) for ri, ti in zip(r, t)])

    udf = F.pandas_udf(solve, T.ArrayType(T.DoubleType()))
    df = sums.withColumn("_m", udf(F.array(*cov), F.array(*[F.col(f"p{i}") for i in range(3)]), F.array(*[F.col(f"q{i}") for i in range(3)])))
    return df.select(*keys, "n", *_pose_columns("_m"))


def cloud_overlap(pairs: DataFrame, clouds: DataFrame, radius: float, stride: int = 2) -> DataFrame:
    """2 · hits · stride / (n1 + n2) for each pair (a_frame, b_frame) of key-frame clouds.

    ``clouds`` has (frame, i, x, y, z) with i from 0; every ``stride``-th point is probed.
    """
    sizes = clouds.groupBy("frame").agg(F.count("*").alias("n"))
    probe = pairs.join(clouds.filter(F.col("i") % stride == 0).withColumnRenamed("frame", "a_frame"), "a_frame")
    ref = pairs.join(clouds.withColumnRenamed("frame", "b_frame"), "b_frame")
    hits = within(probe, ref, ["a_frame", "b_frame"], radius).groupBy("a_frame", "b_frame").agg(F.count("*").alias("hits"))
    n1 = sizes.select(F.col("frame").alias("a_frame"), F.col("n").alias("n1"))
    n2 = sizes.select(F.col("frame").alias("b_frame"), F.col("n").alias("n2"))
    df = pairs.join(n1, "a_frame").join(n2, "b_frame").join(hits, ["a_frame", "b_frame"], "left").na.fill(0, ["hits"])
    return df.withColumn("overlap", 2.0 * F.col("hits") * stride / (F.col("n1") + F.col("n2")))


def icp_degree(probe: DataFrame, ref: DataFrame, keys: Sequence[str], radius: float = 0.5) -> DataFrame:
    """Share of points with a neighbour closer than ``radius``."""
    total = probe.groupBy(*keys).agg(F.count("*").alias("n"))
    hits = within(probe, ref, keys, radius).groupBy(*keys).agg(F.count("*").alias("hits"))
    return total.join(hits, list(keys), "left").na.fill(0, ["hits"]).withColumn("degree", F.col("hits") / F.col("n"))


def nearest_rmse(probe: DataFrame, ref: DataFrame, keys: Sequence[str], ident: str, ref_ident: str, cap: float) -> DataFrame:
    """RMSE of nearest-point distances below ``cap``."""
    near = nearest_capped(probe, ref, keys, ident, ref_ident, cap)
    return near.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg("d2")).alias("rmse"))


def keypoint_repeat(moved: DataFrame, target: DataFrame, keys: Sequence[str], radius: float = 1.0) -> DataFrame:
    """Share of key points with a counterpart in the matched frame."""
    return icp_degree(moved, target, keys, radius).withColumnRenamed("degree", "repeat")


def truth_pairs(poses: DataFrame, clouds: DataFrame, radius: float = 30.0, gap: int = 51, overlap_radius: float = 0.5, min_overlap: float = 0.5) -> DataFrame:
    """Loop ground truth: the best earlier frame within ``radius`` whose clouds overlap enough.

    ``poses`` has (frame, x, y, z), ``clouds`` (frame, i, x, y, z) in a common frame.
    """
    from scanloom.operators.cells import radius_pairs

    near = radius_pairs(poses.withColumn("_g", F.lit(0)), ["_g"], "frame", radius)
    near = near.filter(F.col("b_id") - F.col("a_id") >= gap).select(F.col("b_id").alias("a_frame"), F.col("a_id").alias("b_frame"))
    scored = cloud_overlap(near, clouds, overlap_radius)
    best = scored.groupBy("a_frame").agg(F.max(F.struct("overlap", (-F.col("b_frame")).alias("m"))).alias("b"))
    best = best.select(F.col("a_frame").alias("frame"), (-F.col("b.m")).alias("match_id"), "b.overlap")
    out = poses.join(best, "frame", "left")
    hit = F.coalesce(F.col("overlap") > min_overlap, F.lit(False))
    return out.select("frame", "x", "y", "z", hit.cast("int").alias("is_loop"), F.when(hit, F.col("match_id")).alias("match_id"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def robust_mean(values: DataFrame, keys: Sequence[str], trials: int = 64, share: float = 0.5, enough: float = 1.0, seed: int = 7) -> DataFrame:
    """Centre, radius and rms of the tightest sampled half of each key's vectors (x, y, z).

    Every trial keeps the ``floor(n · share)`` rows with the smallest seeded hash. The first
    trial with a mean spread below ``enough`` wins, else the tightest. With four values or
    fewer all are averaged and radius and rms stay 0.
    """
    rows = values.select(*keys, "rid", "x", "y", "z")
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    few = rows.join(size.filter(F.col("n") <= 4), list(keys)).groupBy(*keys, "n").agg(*[F.avg(c).alias("m" + c) for c in "xyz"])
    few = few.withColumns({"radius": F.lit(0.0), "rms": F.lit(0.0)})
    many = rows.join(size.filter(F.col("n") > 4), list(keys)).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    order = Window.partitionBy(*keys, "trial").orderBy(F.xxhash64(F.lit(seed), "trial", "rid"), "rid")
    kept = many.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= F.floor(F.col("n") * share))
    centre = kept.groupBy(*keys, "trial").agg(*[F.avg(c).alias("m" + c) for c in "xyz"])
    spread = kept.join(centre, [*keys, "trial"]).withColumn("_d", F.sqrt(dist2(g.cols("xyz"), g.cols(["mx", "my", "mz"]))))
    stats = spread.groupBy(*keys, "n", "trial", "mx", "my", "mz").agg(
        F.avg("_d").alias("mean_d"), F.max("_d").alias("radius"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms")
    )
    tight = F.col("mean_d") < enough
    order_by = F.struct(F.when(tight, 0).otherwise(1), F.when(tight, F.col("trial").cast("double")).otherwise(F.col("mean_d")), F.col("trial"))
    best = stats.groupBy(*keys, "n").agg(F.min_by(F.struct("mx", "my", "mz", "radius", "rms"), order_by).alias("b")).select(*keys, "n", "b.*")
    return few.select(*best.columns).unionByName(best)


def filter_loops(loops: DataFrame, keys: Sequence[str] = ("session", "map_session"), **options) -> DataFrame:
    """Flag ``enabled``: the loop's external point lies within the robust radius of its pair's centre.

    The radius is that of the sampled half, so with two to four loops it is 0 and they pass
    only when they agree exactly; a single loop passes.
    """
    centre = robust_mean(loops.select(*keys, F.col("lid").alias("rid"), F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z")), keys, **options)
    df = loops.join(centre, list(keys))
    d = F.sqrt(dist2(g.cols(["ex", "ey", "ez"]), g.cols(["mx", "my", "mz"])))
    return df.withColumn("distance", d).withColumn("enabled", F.col("distance") <= F.col("radius"))


def histogram_mode(values: DataFrame, keys: Sequence[str], column: str, bins: int = 100) -> DataFrame:
    """Count of the fullest of ``bins`` equal bins between minimum and maximum (top edge excluded)."""
    span = values.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    df = values.join(span, list(keys)).filter(F.col(column) < F.col("_hi"))
    bin_no = F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    counts = df.groupBy(*keys, bin_no.alias("bin")).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.max(F.struct("c", (-F.col("bin")).alias("b"))).alias("m")).select(
        *keys, F.col("m.c").alias("mode_count"), (-F.col("m.b")).alias("bin")
    )

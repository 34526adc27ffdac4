"""Pose graph: edges, components, session alignment and least-squares refinement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators.components import connected_components
from scanloom.params import PoseGraphParams
from scanloom.session import cut, rounds

POSE = [*g.ROT, *g.TRANS]
DOF = range(6)


def loop_edges(loops: DataFrame, sub: int, p: PoseGraphParams) -> DataFrame:
    """``sub`` edges per accepted loop: scans key·sub + j and match·sub + j, j = 1..sub, same motion."""
    df = loops.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(sub))))
    return df.select(
        (F.col("db_keyframe") * sub + F.col("j")).alias("src"), (F.col("keyframe") * sub + F.col("j")).alias("dst"),
        *POSE, F.lit(p.loop_variance).alias("variance"), F.lit(True).alias("robust"),
    )


def pose_edges(odometry: DataFrame, loops: DataFrame, sub: int, p: PoseGraphParams) -> DataFrame:
    """Odometry and loop edges in one table; ``odometry`` has (src, dst, pose)."""
    odo = odometry.select("src", "dst", *POSE, F.lit(p.odometry_variance).alias("variance"), F.lit(False).alias("robust"))
    return odo.unionByName(loop_edges(loops, sub, p))


def graph_split(edges: DataFrame) -> DataFrame:
    """Component of each node; the smallest node of a component is its anchor and carries the prior."""
    comp = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return comp.withColumn("anchor", F.col("node") == F.col("comp"))


def _mean_motion(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean translation and normalised mean quaternion per key, signs aligned to w >= 0."""
    q = g.quat_from_rotation(g.cols(g.ROT))
    df = df.withColumns({n: c for n, c in zip(g.QUAT, q)})
    sign = F.when(F.col("qw") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    mean = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in g.TRANS], *[F.avg(F.col(c) * sign).alias(c) for c in g.QUAT])
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in g.QUAT), F.lit(0.0)))
    mean = mean.withColumn("_l", length).withColumns({c: F.col(c) / F.col("_l") for c in g.QUAT}).drop("_l")
    return g.with_rotation(mean).select(*keys, "n", *POSE)


def session_align(loops: DataFrame, max_rounds: int = 1_000_000) -> DataFrame:
    """Motion of every session into the frame of the lowest one it is linked to.

    ``loops`` has (session, map_session, pose): the motion from session coordinates into map
    coordinates that a loop implies. Pairs are averaged, then the transforms spread breadth
    first; a session takes the neighbour with most loops, then the lowest number.
    """
    pair = _mean_motion(loops.filter(F.col("session") != F.col("map_session")), ["session", "map_session"])
    r, t = g.invert(g.cols(g.ROT), g.cols(g.TRANS))
    back = pair.select(F.col("map_session").alias("session"), F.col("session").alias("map_session"), "n", *[c.alias(n) for c, n in zip((*r, *t), POSE)])
    pair = cut(pair.unionByName(back))
    comp = connected_components(pair.select(F.col("session").alias("a"), F.col("map_session").alias("b")))
    eye = [F.lit(1.0 if i in (0, 4, 8) else 0.0).alias(n) for i, n in enumerate(POSE)]
    known = cut(comp.filter(F.col("node") == F.col("comp")).select(F.col("node").alias("session"), *eye))
    for _ in rounds(max_rounds, "session alignment"):
        base = known.select(F.col("session").alias("map_session"), *[F.col(c).alias("k" + c) for c in POSE])
        step = pair.join(base, "map_session").join(known.select("session"), "session", "left_anti")
        r, t = g.compose(g.cols(g.ROT, "k"), g.cols(g.TRANS, "k"), g.cols(g.ROT), g.cols(g.TRANS))
        step = step.select("session", "map_session", "n", *[c.alias(n) for c, n in zip((*r, *t), POSE)])
        best = F.min_by(F.struct(*POSE), F.struct(-F.col("n"), F.col("map_session")))
        fresh = cut(step.groupBy("session").agg(best.alias("b")).select(F.col("session").cast("bigint").alias("session"), "b.*"))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh))
    return known


def _hat(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 0] = -v[:, 2], v[:, 1], v[:, 2]
    out[:, 1, 2], out[:, 2, 0], out[:, 2, 1] = -v[:, 0], -v[:, 1], v[:, 0]
    return out


def _log(r: np.ndarray) -> np.ndarray:
    cos = np.clip((np.trace(r, axis1=1, axis2=2) - 1) / 2, -1, 1)
    angle = np.arccos(cos)
    v = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], axis=1)
    scale = np.where(angle < 1e-6, 0.5, angle / (2 * np.sin(np.where(angle < 1e-6, 1.0, angle))))
    return v * scale[:, None]


def _exp(w: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(w, axis=1)
    safe = np.where(angle < 1e-12, 1.0, angle)
    k = _hat(w / safe[:, None])
    return np.eye(3) + np.sin(angle)[:, None, None] * k + (1 - np.cos(angle))[:, None, None] * (k @ k)


def _linearise(p: PoseGraphParams):
    """Per edge: gradient and Hessian blocks for the local steps (translation, rotation) of both ends."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for e in batches:
            def pose(prefix):
                return e[[prefix + c for c in g.ROT]].to_numpy(float).reshape(-1, 3, 3), e[[prefix + c for c in g.TRANS]].to_numpy(float)

            (ra, ta), (rb, tb), (rz, tz) = pose("a"), pose("b"), pose("")
            n = len(e)
            local = np.einsum("nji,nj->ni", ra, tb - ta)
            rel = np.swapaxes(ra, 1, 2) @ rb
            res = np.concatenate([local - tz, _log(np.swapaxes(rz, 1, 2) @ rel)], axis=1)
            ja, jb = np.zeros((n, 6, 6)), np.zeros((n, 6, 6))
            ja[:, :3, :3], ja[:, :3, 3:], ja[:, 3:, 3:] = -np.eye(3), _hat(local), -np.swapaxes(rel, 1, 2)
            jb[:, :3, :3], jb[:, 3:, 3:] = rel, np.eye(3)
            w = 1.0 / e["variance"].to_numpy(float)
            cost = w * (res**2).sum(axis=1)
            w = w * np.where(e["robust"].to_numpy(bool), 1.0 / (1.0 + cost / p.cauchy**2), 1.0)
            jat, jbt = np.swapaxes(ja, 1, 2) * w[:, None, None], np.swapaxes(jb, 1, 2) * w[:, None, None]
            yield pd.DataFrame({
                "src": e["src"], "dst": e["dst"],
                "haa": list((jat @ ja).reshape(n, 36)), "hab": list((jat @ jb).reshape(n, 36)), "hbb": list((jbt @ jb).reshape(n, 36)),
                "ga": list(np.einsum("nij,nj->ni", jat, res)), "gb": list(np.einsum("nij,nj->ni", jbt, res)),
            })

    return run


_BLOCKS = "src BIGINT, dst BIGINT, haa ARRAY<DOUBLE>, hab ARRAY<DOUBLE>, hbb ARRAY<DOUBLE>, ga ARRAY<DOUBLE>, gb ARRAY<DOUBLE>"


def _sum_arrays(column: str, size: int):
    return F.array(*[F.sum(F.col(column)[i]) for i in range(size)])


def _precondition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for e in batches:
        h = np.stack([np.asarray(v) for v in e["h"]]).reshape(-1, 6, 6)
        r = np.stack([np.asarray(v) for v in e["r"]])
        inv = np.linalg.inv(h + 1e-9 * np.eye(6) * np.trace(h, axis1=1, axis2=2)[:, None, None])
        yield pd.DataFrame({"node": e["node"], "inv": list(inv.reshape(-1, 36)), "x": list(np.zeros_like(r)), "r": list(r), "p": list(np.einsum("nij,nj->ni", inv, r))})


def _apply_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for e in batches:
        def mat(c):
            return np.stack([np.asarray(v) for v in e[c]]).reshape(-1, 6, 6)

        def vec(c):
            return np.stack([np.zeros(6) if v is None else np.asarray(v) for v in e[c]])

        a, b, hab = vec("pa"), vec("pb"), mat("hab")
        top = np.einsum("nij,nj->ni", mat("haa"), a) + np.einsum("nij,nj->ni", hab, b)
        low = np.einsum("nji,nj->ni", hab, a) + np.einsum("nij,nj->ni", mat("hbb"), b)
        both = np.concatenate([top, low])
        out = pd.DataFrame({"node": np.concatenate([e["src"], e["dst"]])})
        for k in DOF:
            out[f"q{k}"] = both[:, k]
        yield out


def _dot(a: str, b: str):
    return F.sum(sum((F.col(a)[i] * F.col(b)[i] for i in DOF), F.lit(0.0)))


def pose_refine(
    nodes: DataFrame, edges: DataFrame, p: PoseGraphParams, rounds: int = 5, cg_steps: int = 60, tolerance: float = 1e-8,
) -> tuple[DataFrame, float]:
    """Refined poses (node, pose) and the last relative residual.

    ``nodes`` has (node, pose, anchor); anchors stay fixed, as their prior is stiffer than
    any edge. Gauss-Newton with block-preconditioned conjugate gradient: every product with
    the Hessian is one join of edge blocks with node vectors and one sum per node, so no
    matrix is ever assembled. Only three scalars per step reach the driver.
    """
    nodes, edges = cut(nodes.select("node", *POSE, "anchor")), cut(edges)
    left = 1.0
    for _ in range(rounds):
        ends = [nodes.select(F.col("node").alias(end), *[F.col(c).alias(x + c) for c in POSE]) for end, x in (("src", "a"), ("dst", "b"))]
        blocks = cut(edges.join(ends[0], "src").join(ends[1], "dst").mapInPandas(_linearise(p), _BLOCKS))
        parts = blocks.select(F.col("src").alias("node"), F.col("haa").alias("h"), F.col("ga").alias("g")).unionByName(
            blocks.select(F.col("dst").alias("node"), F.col("hbb").alias("h"), F.col("gb").alias("g")))
        summed = parts.groupBy("node").agg(_sum_arrays("h", 36).alias("h"), _sum_arrays("g", 6).alias("g"))
        free = nodes.filter(~F.col("anchor")).select("node")
        start = summed.join(free, "node").select("node", "h", F.transform("g", lambda v: -v).alias("r"))
        state = cut(start.mapInPandas(_precondition, "node BIGINT, inv ARRAY<DOUBLE>, x ARRAY<DOUBLE>, r ARRAY<DOUBLE>, p ARRAY<DOUBLE>"))
        rz, rr = state.agg(_dot("r", "p"), _dot("r", "r")).first()
        if not rr:
            break
        first, left = rr, 1.0
        for _ in range(cg_steps):
            pa, pb = state.select(F.col("node").alias("src"), F.col("p").alias("pa")), state.select(F.col("node").alias("dst"), F.col("p").alias("pb"))
            hp = blocks.select("src", "dst", "haa", "hab", "hbb").join(pa, "src", "left").join(pb, "dst", "left").mapInPandas(
                _apply_blocks, "node BIGINT, " + ", ".join(f"q{k} DOUBLE" for k in DOF))
            hp = hp.groupBy("node").agg(F.array(*[F.sum(f"q{k}") for k in DOF]).alias("q"))
            moved = cut(state.join(hp, "node"))
            alpha = rz / moved.agg(_dot("p", "q")).first()[0]
            x = F.zip_with("x", "p", lambda a, b: a + alpha * b)
            r = F.zip_with("r", "q", lambda a, b: a - alpha * b)
            z = F.array(*[sum((F.col("inv")[6 * i + j] * F.col("r")[j] for j in DOF), F.lit(0.0)) for i in DOF])
            moved = cut(moved.select("node", "inv", x.alias("x"), r.alias("r"), "p").withColumn("z", z))
            new, rr = moved.agg(_dot("r", "z"), _dot("r", "r")).first()
            left = (rr / first) ** 0.5
            beta, rz = new / rz, new
            state = moved.select("node", "inv", "x", "r", F.zip_with("z", "p", lambda a, b: a + beta * b).alias("p"))
            if left < tolerance:
                break
        nodes = cut(_move(nodes, state))
        size = state.agg(F.max(F.sqrt(sum((F.col("x")[i] * F.col("x")[i] for i in DOF), F.lit(0.0))))).first()[0]
        if size < 1e-9:
            break
    return nodes, left


def _move(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """Apply local steps: t + R·dt, R·Exp(dw)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for e in batches:
            r, t = e[list(g.ROT)].to_numpy(float).reshape(-1, 3, 3), e[list(g.TRANS)].to_numpy(float)
            x = np.stack([np.zeros(6) if v is None else np.asarray(v) for v in e["x"]])
            out = pd.DataFrame({"node": e["node"]})
            out[list(g.ROT)] = (r @ _exp(x[:, 3:])).reshape(-1, 9)
            out[list(g.TRANS)] = t + np.einsum("nij,nj->ni", r, x[:, :3])
            out["anchor"] = e["anchor"]
            yield out

    df = nodes.join(state.select("node", "x"), "node", "left")
    return df.mapInPandas(run, "node BIGINT, " + ", ".join(f"{c} DOUBLE" for c in POSE) + ", anchor BOOLEAN")


def correct_scans(poses: DataFrame, key_frames: DataFrame, refined: DataFrame) -> DataFrame:
    """Give every scan the correction of its key frame: refined · anchor⁻¹ · pose.

    ``key_frames`` maps scans to (keyframe, anchor_scan); ``refined`` has (keyframe, pose).
    """
    pose = g.with_rotation(poses).select("session", "scan_id", "t", *POSE)
    anchor = pose.select("session", F.col("scan_id").alias("anchor_scan"), *[F.col(c).alias("a" + c) for c in POSE])
    df = pose.join(key_frames, ["session", "scan_id"]).join(anchor, ["session", "anchor_scan"])
    df = df.join(refined.select("keyframe", *[F.col(c).alias("k" + c) for c in POSE]), "keyframe")
    rel_r, rel_t = g.between(g.cols(g.ROT, "a"), g.cols(g.TRANS, "a"), g.cols(g.ROT), g.cols(g.TRANS))
    df = df.withColumns({"_" + n: c for n, c in zip(POSE, (*rel_r, *rel_t))})
    r, t = g.compose(g.cols(g.ROT, "k"), g.cols(g.TRANS, "k"), g.cols(g.ROT, "_"), g.cols(g.TRANS, "_"))
    return df.select("session", "scan_id", "t", *[c.alias(n) for n, c in zip(POSE, (*r, *t))])


def plane_adjust_sums(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normal equations of a joint step of two poses from plane pairs: 78 + 12 sums per key.

    ``pairs`` has the source point (px..), its rotation and translation (a*), the target
    point (qx..), normal (nx..) and pose (b*). The residual is n_w · (a(p) - b(q)).
    """
    pa = g.rigid(g.cols(g.ROT, "a"), g.cols(g.TRANS, "a"), g.cols(["px", "py", "pz"]))
    qb = g.rigid(g.cols(g.ROT, "b"), g.cols(g.TRANS, "b"), g.cols(["qx", "qy", "qz"]))
    nw = g.mat_vec(g.cols(g.ROT, "b"), g.cols(["nx", "ny", "nz"]))
    df = pairs.select(*keys, *[c.alias(f"_p{i}") for i, c in enumerate(pa)], *[c.alias(f"_q{i}") for i, c in enumerate(qb)], *[c.alias(f"_n{i}") for i, c in enumerate(nw)])
    p, q, n = [[F.col(f"_{x}{i}") for i in range(3)] for x in "pqn"]
    res = g.dot(n, g.sub(p, q))
    jac = [*n, *g.cross(p, n), *[-c for c in n], *[-c for c in g.cross(p, n)]]
    df = df.select(*keys, res.alias("_r"), *[c.alias(f"_j{i}") for i, c in enumerate(jac)])
    sums = [F.sum(F.col(f"_j{i}") * F.col(f"_j{j}")).alias(f"h{i}_{j}") for i in range(12) for j in range(i, 12)]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_r") * F.col("_r")).alias("cost"), *sums, *[F.sum(F.col(f"_j{i}") * F.col("_r")).alias(f"g{i}") for i in range(12)])


def plane_adjust(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Damped step of both poses, (keys, n, cost, step of 12); the minimum-norm one shares the motion."""
    from scanloom.functions.linalg import solve_normal

    sums = plane_adjust_sums(pairs, keys)
    h = F.array(*[F.col(f"h{min(i, j)}_{max(i, j)}") for i in range(12) for j in range(12)])
    return sums.select(*keys, "n", "cost", solve_normal(h, F.array(*[F.col(f"g{i}") for i in range(12)])).alias("step"))

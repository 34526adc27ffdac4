"""Rotations, planes, grouping and loops."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.operators import loops, planes, posegraph, voxels
from scanloom.operators.ordered import block_of, row_number
from scanloom.params import LoopParams, PlaneParams, PoseGraphParams


def rot(axis, angle):
    axis = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def test_exp_log_and_quaternion_round_trip(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(size=(20, 3))
    w[0], w[1] = 0, [3.0, 0.1, 0]
    df = spark.createDataFrame(pd.DataFrame(w, columns=list("abc")))
    df = df.withColumns(dict(zip(g.ROT, g.so3_exp(g.cols("abc")))))
    back = df.withColumns({f"l{i}": c for i, c in enumerate(g.so3_log(g.cols(g.ROT)))})
    back = back.withColumns(dict(zip(g.QUAT, g.quat_from_rotation(g.cols(g.ROT)))))
    back = g.with_rotation(back, out=["m" + c for c in g.ROT]).toPandas()
    for i, v in enumerate(w):
        angle = np.linalg.norm(v)
        want = rot(v, angle) if angle > 0 else np.eye(3)
        np.testing.assert_allclose(back.loc[i, g.ROT].to_numpy(float).reshape(3, 3), want, atol=1e-9)
        np.testing.assert_allclose(back.loc[i, ["m" + c for c in g.ROT]].to_numpy(float), want.ravel(), atol=1e-9)
        if 0 < angle < 3:
            np.testing.assert_allclose(back.loc[i, ["l0", "l1", "l2"]].to_numpy(float), v, atol=1e-6)


def test_planes_of_a_room(spark):
    rng = np.random.default_rng(1)
    n = 3000
    floor = np.c_[rng.uniform(0, 4, n), rng.uniform(0, 4, n), rng.normal(0.5, 0.01, n)]
    wall = np.c_[rng.normal(0.5, 0.01, n), rng.uniform(0, 4, n), rng.uniform(1.2, 4, n)]
    pdf = pd.DataFrame(np.vstack([floor, wall]), columns=list("xyz")).assign(session=0, scan_id=1)
    p = PlaneParams()
    found = voxels.voxel_planes(spark.createDataFrame(pdf), p)
    merged = planes.merge_planes(found, ["session", "scan_id"], p, keep_single=False).toPandas().sort_values("n")
    assert len(merged) == 2
    normals = np.abs(merged[["nx", "ny", "nz"]].to_numpy())
    assert normals[:, 2].max() > 0.99 and normals[:, 0].max() > 0.99


def greedy(pl, p):
    """The pairwise pass in its original order."""
    ids, current = [0] * len(pl), 1
    n, c, d = pl[["nx", "ny", "nz"]].to_numpy(), pl[["cx", "cy", "cz"]].to_numpy(), pl["d"].to_numpy()
    for i in range(len(pl) - 1, 0, -1):
        for j in range(i):
            close = min(np.linalg.norm(n[i] - n[j]), np.linalg.norm(n[i] + n[j])) < p.normal_threshold
            if close and abs(n[i] @ c[j] + d[i]) < p.distance_threshold and abs(n[j] @ c[i] + d[j]) < p.distance_threshold:
                if ids[i] == 0 and ids[j] == 0:
                    ids[i] = ids[j] = current
                    current += 1
                elif ids[i] == 0:
                    ids[i] = ids[j]
                elif ids[j] == 0:
                    ids[j] = ids[i]
    return ids


def test_grouping_equals_the_greedy_pass(spark):
    rng = np.random.default_rng(4)
    k = 80
    n = rng.normal(size=(k, 3)) * [0.3, 0.3, 1]
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    c = rng.uniform(-2, 2, (k, 3))
    pdf = pd.DataFrame(np.c_[n, c], columns=["nx", "ny", "nz", "cx", "cy", "cz"])
    pdf["d"] = -(n * c).sum(axis=1)
    pdf = pdf.assign(session=0, scan_id=0, vx=np.arange(k), vy=0, vz=0)
    p = PlaneParams(normal_threshold=0.3, distance_threshold=0.6)
    want = greedy(pdf, p)
    got = planes.plane_groups(spark.createDataFrame(pdf), ["session", "scan_id"], p).toPandas().sort_values("vx")["grp"].tolist()
    assert [g is None or np.isnan(g) for g in got] == [w == 0 for w in want]
    pairs = {(a, b) for a, b in zip(got, want) if b}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 2


def test_plane_icp_recovers_a_motion(spark):
    rng = np.random.default_rng(6)
    c = rng.uniform(-10, 10, (60, 3))
    n = rng.normal(size=(60, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    r, t = rot([0.2, 0.1, 1], 0.03), np.array([0.1, -0.05, 0.08])
    cols = ["cx", "cy", "cz", "nx", "ny", "nz"]
    src = pd.DataFrame(np.c_[c, n], columns=cols).assign(session=1, keyframe=9, pid=range(60))
    dst = pd.DataFrame(np.c_[c @ r.T + t, n @ r.T], columns=cols).assign(session=0, keyframe=2, pid=range(60))
    eye = {c: float(c in ("r00", "r11", "r22")) for c in g.ROT}
    loop = pd.DataFrame([{"session": 1, "keyframe": 9, "map_session": 0, "db_keyframe": 2, "votes": 5, **eye, "tx": 0.0, "ty": 0.0, "tz": 0.0}])
    out = loops.plane_icp(spark.createDataFrame(loop), spark.createDataFrame(pd.concat([src, dst])), LoopParams()).toPandas().iloc[0]
    np.testing.assert_allclose(out[g.ROT].to_numpy(float).reshape(3, 3), r, atol=1e-6)
    np.testing.assert_allclose(out[g.TRANS].to_numpy(float), t, atol=1e-6)


def test_loop_filter_small_samples(spark):
    rows = [(1, 0, 1, 0.0), (2, 0, 2, 0.0), (2, 0, 3, 1.0), (3, 0, 4, 2.0), (3, 0, 5, 2.0)] + [(4, 0, 10 + i, 0.1 * (i % 3)) for i in range(8)] + [(4, 0, 30, 50.0)]
    df = spark.createDataFrame(rows, "session INT, map_session INT, lid BIGINT, ex DOUBLE").withColumns({"ey": F.lit(0.0), "ez": F.lit(0.0)})
    got = {r.lid: r.enabled for r in loops.filter_loops(df, trials=64).collect()}
    assert got[1] and not got[2] and not got[3] and got[4] and got[5]
    assert not got[30] and sum(got[10 + i] for i in range(8)) >= 4


def test_pose_refine_closes_a_loop(spark):
    step = np.array([1.0, 0.0, 0.0])
    turn = rot([0, 0, 1], np.pi / 2)
    poses, r, t = [], np.eye(3), np.zeros(3)
    for _ in range(4):
        poses.append((r, t))
        r, t = r @ turn, t + r @ step
    rng = np.random.default_rng(0)
    nodes, edges = [], []
    for i, (r, t) in enumerate(poses):
        noise = 0 if i == 0 else 1
        rn, tn = r @ rot([0, 0, 1], 0.05 * noise * rng.normal()), t + 0.05 * noise * rng.normal(size=3)
        nodes.append((i, *rn.ravel(), *tn, i == 0))
    for i in range(4):
        j = (i + 1) % 4
        (ra, ta), (rb, tb) = poses[i], poses[j]
        edges.append((i, j, *(ra.T @ rb).ravel(), *(ra.T @ (tb - ta)), 0.01, i == 3))
    pose = ", ".join(f"{c} DOUBLE" for c in posegraph.POSE)
    out, left = posegraph.pose_refine(
        spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in n) for n in nodes], f"node BIGINT, {pose}, anchor BOOLEAN"),
        spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in e) for e in edges], f"src BIGINT, dst BIGINT, {pose}, variance DOUBLE, robust BOOLEAN"),
        PoseGraphParams(), rounds=2, cg_steps=7, tolerance=1e-4,
    )
    for row in out.collect():
        np.testing.assert_allclose([row.tx, row.ty, row.tz], poses[row.node][1], atol=1e-2)


def test_ransac_equals_a_loop_over_the_hypotheses(spark, monkeypatch):
    monkeypatch.setattr(planes, "_BLOCK", 64)
    rng = np.random.default_rng(3)
    rows = []
    for scan in range(3):
        flat = np.column_stack([rng.uniform(-5, 5, (300, 2)), rng.normal(0, 0.03, 300)])
        noise = rng.uniform(-5, 5, (150, 3))
        rows += [(scan, i, *map(float, p)) for i, p in enumerate(np.concatenate([flat, noise]) + [0, 0, scan])]
    rows += [(7, 0, 0.0, 0.0, 0.0), (7, 1, 1.0, 0.0, 0.0)]  # too few points for a plane
    df = spark.createDataFrame(rows, "scan_id int, point_idx int, x double, y double, z double").repartition(3)
    block = block_of(F.col("point_idx"), 100)
    got = {(r.scan_id, r.point_idx) for r in planes.plane_ransac(df, ["scan_id"], "point_idx", block, 1000, 0.1).collect() if r.inlier}
    ranked = row_number(df, ["scan_id"], ["point_idx"], block, "_i")
    tried = planes.plane_hypotheses(ranked, ["scan_id"], 1000, 1).toPandas().sort_values(["scan_id", "h"])
    want = set()
    for scan in range(3):
        at = np.array([r[2:] for r in rows if r[0] == scan])
        best, most = None, -1
        for h in tried[tried.scan_id == scan].itertuples():
            inside = np.abs(at @ [h.nx, h.ny, h.nz] + h.d) < 0.1
            if inside.sum() > most:
                best, most = inside, inside.sum()
        centre = at[best].mean(axis=0)
        normal = np.linalg.svd(at[best] - centre)[2][2]
        want |= {(scan, int(i)) for i in np.flatnonzero(np.abs((at - centre) @ normal) < 0.1)}
    assert got == want and len(want) > 850


def test_ransac_stores_no_more_rows_than_points(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(scan, i, *map(float, p)) for scan in range(4) for i, p in enumerate(rng.uniform(-5, 5, (90, 3)))]
    df = spark.createDataFrame(rows, "scan_id int, point_idx int, x double, y double, z double")
    stored, cut = [], planes.cut

    def counted(frame):
        stored.append((out := cut(frame)).count())
        return out

    monkeypatch.setattr(planes, "cut", counted)
    flags = []
    for size in (4096, 32):  # a group as one block and as several
        monkeypatch.setattr(planes, "_BLOCK", size)
        out = planes.plane_ransac(df, ["scan_id"], "point_idx", block_of(F.col("point_idx"), 50), 200, 0.3)
        flags.append(sorted(map(tuple, out.select("scan_id", "point_idx", "inlier").collect())))
    assert flags[0] == flags[1] and sum(f[2] for f in flags[0]) > 20
    assert max(stored) <= len(rows)  # planes as rows would be 200 a scan


def test_ground_plane_equals_a_loop_and_stores_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    scans = {}
    for scan in range(3):
        flat = np.column_stack([rng.uniform(-5, 5, (330, 2)), 10 + rng.normal(0, 0.02, 330)])
        scans[scan] = np.concatenate([flat, rng.uniform(0, 5, (60, 3)) + [0, 0, 12]])
    scans[3] = rng.uniform(-9, 9, (40, 3))  # no ground
    df = spark.createDataFrame([(s, i, *map(float, p)) for s, at in scans.items() for i, p in enumerate(at)], "scan_id int, point_idx int, x double, y double, z double")

    def fitted(at):
        a = np.linalg.solve(at.T @ at, -at.sum(axis=0))
        size = np.linalg.norm(a)
        off = np.abs(at @ a + 1)
        level = max(0.01, (off / size).mean()) < 0.1 and np.linalg.norm(np.cross(a / size, [0, 0, 1])) < np.sin(30 / 57.3)
        return a if off.max() <= 0.2 and level else None

    def near(at, a):
        return np.abs(at @ a + 1) / np.linalg.norm(a) < 0.1

    want = {}
    for scan, at in scans.items():
        width = max(4, len(at) // 100)
        tried = [a for k in range(len(at) // width) if (a := fitted(at[k * width:(k + 1) * width])) is not None]
        hits = [int(near(at, a).sum()) for a in tried]
        if hits:
            best = next((i for i, n in enumerate(hits) if n > 0.6 * len(at)), int(np.argmax(hits)))
            if hits[best] > 0.2 * len(at):
                refit = fitted(at[near(at, tried[best])])
                want[scan] = tried[best] if refit is None else refit
    stored, cut = [], planes.cut

    def counted(frame):
        stored.append((out := cut(frame)).count())
        return out

    monkeypatch.setattr(planes, "cut", counted)
    for size in (4096, 64):  # a group as one block and as several
        monkeypatch.setattr(planes, "_BLOCK", size)
        stored.clear()
        got = {r.scan_id: (r.a0, r.a1, r.a2) for r in planes.ground_plane(df, ["scan_id"], "point_idx", block_of(F.col("point_idx"), 50)).collect()}
        assert set(got) == set(want) and len(want) >= 3
        for scan, a in want.items():
            np.testing.assert_allclose(got[scan], a, rtol=1e-6, atol=1e-9)
        assert stored[0] == sum(-(-len(at) // size) for at in scans.values())  # blocks, not points times planes

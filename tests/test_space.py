"""Spatial joins, clusters and components against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanloom.functions.voxel import pack, voxel_key
from scanloom.operators import cells, clusters, components, keypoints, triangles
from scanloom.params import TriangleParams


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"s": 0, "id": range(400), "x": rng.uniform(-4, 4, 400), "y": rng.uniform(-4, 4, 400), "z": rng.uniform(-1, 1, 400)})
    # A third of the rows are copies of one point.
    pdf.loc[:132, ["x", "y", "z"]] = [0.5, 0.5, 0.5]
    return pdf, spark.createDataFrame(pdf).cache()


def distances(pdf):
    x = pdf[["x", "y", "z"]].to_numpy()
    return ((x[:, None] - x[None]) ** 2).sum(-1)


def test_radius_pairs(cloud):
    pdf, df = cloud
    got = {(r.a_id, r.b_id) for r in cells.radius_pairs(df, ["s"], "id", 0.7).collect()}
    want = {tuple(p) for p in np.argwhere(np.triu(distances(pdf) < 0.49, 1))}
    assert got == want


def test_knn_without_cap(cloud):
    pdf, df = cloud
    got = cells.knn(df.filter("id % 9 = 0"), df, ["s"], "id", "id", 4, 0.3).toPandas().sort_values(["id", "rank"])
    d = distances(pdf)
    for i, rows in got.groupby("id"):
        np.testing.assert_allclose(rows["d2"].to_numpy(), np.sort(d[i])[:4], atol=1e-12)


@pytest.mark.parametrize("anti", [False, True])
def test_within(cloud, anti):
    pdf, df = cloud
    got = {r.id for r in cells.within(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ["s"], 0.4, anti=anti).collect()}
    d = distances(pdf)[::2][:, 1::2]
    hit = (d < 0.16).any(axis=1)
    assert got == set(pdf["id"].to_numpy()[::2][~hit if anti else hit])


def test_suppression_kills_equal_neighbours(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 5), (0, 2, 0.5, 5), (0, 3, 10.0, 4), (0, 4, 10.4, 3), (0, 5, 20.0, 1)], "s INT, kp BIGINT, x DOUBLE, summary INT")
    df = df.withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    assert {r.kp for r in keypoints.suppress(df, ["s"], 1.0, "kp").collect()} == {3, 5}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = rng.integers(0, 120, (70, 2))
    parent = list(range(120))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in components.connected_components(spark.createDataFrame(edges.tolist(), "a BIGINT, b BIGINT")).collect()}
    assert got == {int(n): find(int(n)) for n in np.unique(edges)}


def test_dbscan(cloud):
    pdf, df = cloud
    d = distances(pdf) < 0.36
    core = d.sum(axis=1) >= 6
    label = np.where(core, np.arange(len(pdf)), 10**6)
    for _ in range(len(pdf)):
        new = np.where(core, np.where(d & core[None], label[None], 10**6).min(axis=1), 10**6)
        if (new == label).all():
            break
        label = new
    border = np.where(d & core[None], label[None], 10**6).min(axis=1)
    want = {i: border[i] for i in range(len(pdf)) if border[i] < 10**6}
    got = {r.id: r.cluster for r in clusters.dbscan(df, ["s"], "id", 0.6, 6).collect()}
    # Names may differ, the partition may not.
    assert set(got) == set(want)
    assert len(set(zip(got.values(), (want[k] for k in got)))) == len(set(want.values())) == len(set(got.values()))


def test_voxel_key_edges(spark):
    df = spark.createDataFrame([(-1.0,), (-0.5,), (0.0,), (1.0,), (1.5,)], "c DOUBLE")
    assert [r[0] for r in df.select(voxel_key(F.col("c"), 1.0)).collect()] == [-2, -1, 0, 1, 1]
    packed = [r[0] for r in spark.range(1).select(F.explode(F.array(*[pack([F.lit(a), F.lit(b), F.lit(0)]) for a, b in ((-1, 5), (0, -3), (0, 2))]))).collect()]
    assert packed == sorted(packed)


def test_radius_pairs_of_repeated_ids(spark):
    """Rows of one id are one point: no pair, also when they lie in different cells."""
    df = spark.createDataFrame([(0, 1, 0.1, 0.0, 0.0), (0, 1, 0.9, 0.0, 0.0), (0, 1, 1.1, 0.0, 0.0), (0, 2, 1.2, 0.0, 0.0)], "s INT, id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE")
    got = sorted((r.a_id, r.b_id, round(r.d2, 6)) for r in cells.radius_pairs(df, ["s"], "id", 1.0).collect())
    assert got == [(1, 2, 0.01), (1, 2, 0.09)]


def test_triangles_of_small_frames(spark):
    """Frames with fewer key points than neighbours asked for, beside a full one."""
    rng = np.random.default_rng(4)
    rows = [(0, f, f * 100 + k, *map(float, rng.uniform(0, 9, 3)), 7, 3) for f, n in enumerate((1, 2, 3, 5, 9)) for k in range(n)]
    df = spark.createDataFrame(rows, "session INT, keyframe INT, kp BIGINT, x DOUBLE, y DOUBLE, z DOUBLE, bits BIGINT, summary INT")
    p = TriangleParams(neighbours=8, min_side=1.0, max_side=30.0, resolution=2.0)
    found = triangles.triangles(df, p, size=6.0).select("keyframe", "pa.kp", F.col("pb.kp").alias("b"), F.col("pc.kp").alias("c")).collect()
    at = {r[2]: np.array(r[3:6]) for r in rows}
    for f, n in enumerate((1, 2, 3, 5)):
        got = {frozenset(r[1:]) for r in found if r.keyframe == f}
        want = set()
        for t in itertools.combinations([r[2] for r in rows if r[1] == f], 3):
            s = sorted(np.linalg.norm(at[a] - at[b]) for a, b in itertools.combinations(t, 2))
            if s[0] >= p.min_side and s[2] <= p.max_side and abs(s[2] - s[0] - s[1]) >= p.flat_margin:
                want.add(frozenset(t))
        assert got == want


def test_knn_in_coarse_cells(cloud):
    """Cells of twice the side find the same neighbours."""
    pdf, df = cloud
    fine, coarse = [sorted(map(tuple, cells.knn(df.filter("id % 9 = 0"), df, ["s"], "id", "id", 4, 0.3, coarse=c).select("id", "rank", "near.id", "d2").collect())) for c in (False, True)]
    assert fine == coarse


def test_knn_of_copies_and_crowded_cells(spark, monkeypatch):
    rng = np.random.default_rng(12)
    at = np.concatenate([np.repeat(rng.uniform(-1, 1, (20, 3)), 30, axis=0), rng.uniform(-1, 1, (500, 3))])
    rows = [(0, i, *map(float, p)) for i, p in enumerate(at)]
    df = spark.createDataFrame(rows, "s int, id int, x double, y double, z double")
    stored, cut = [], cells.cut

    def counted(frame):
        stored.append((out := cut(frame)).count())
        return out

    monkeypatch.setattr(cells, "cut", counted)
    got = {(r.id, r["rank"]): r.near.id for r in cells.knn(df.filter("id % 11 = 0"), df, ["s"], "id", "id", 3, 4.0).collect()}
    for i in range(0, len(at), 11):
        d2 = ((at[i, 0] - at[:, 0]) ** 2 + (at[i, 1] - at[:, 1]) ** 2 + (at[i, 2] - at[:, 2]) ** 2)
        assert [got[i, k] for k in range(3)] == list(np.lexsort((np.arange(len(at)), d2))[:3])
    assert len(got) == 3 * 100
    assert 20 * 3 + 500 in stored  # of the copies at one place, three are kept
    refs = df.select("s", *[F.col(a).alias("r_" + a) for a in "xyz"])
    crowds = cells._crowds(refs, ["s"], 1.0, "xyz", 4)
    assert crowds[0] > crowds[1] > crowds[2] > crowds[3] and crowds[3] < 100

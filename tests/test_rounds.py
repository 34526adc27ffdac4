"""Loops settle or fail; sequential passes need few rounds; voxel keys never wrap."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanloom.functions.voxel import pack
from scanloom.operators import components, ordered, windows
from scanloom.operators.cells import knn
from scanloom.operators.posegraph import session_align
from scanloom.session import NotSettled


def test_components_of_a_path_settle_or_fail(spark):
    path = spark.range(0, 63).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.comp for r in components.connected_components(path).collect()} == {0}
    with pytest.raises(NotSettled):
        components.connected_components(path, max_rounds=2, batch_merge=False)


@pytest.mark.parametrize("merge", [True, False])
def test_components_equal_union_find(spark, merge):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"s": rng.integers(0, 3, 900), "name": rng.choice(["x", "y"], 900), "a": rng.integers(0, 400, 900), "b": rng.integers(0, 400, 900)})
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for s, k, a, b in pdf.itertuples(index=False):
        x, y = find((s, k, a)), find((s, k, b))
        root[max(x, y)] = min(x, y)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = components.connected_components(spark.createDataFrame(pdf).repartition(4), ["s", "name"], batch_merge=merge).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {((r.s, r.name, r.node), r.comp) for r in got} == {(n, find(n)[2]) for n in root}


def test_nearest_neighbours_fail_on_a_small_bound(spark):
    far = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0)], "k int, p int, x double, y double, z double")
    ref = spark.createDataFrame([(0, 1, 900.0, 0.0, 0.0)], "k int, r int, x double, y double, z double")
    assert knn(far, ref, ["k"], "p", "r", 1, 1.0).count() == 1
    with pytest.raises(NotSettled):
        knn(far, ref, ["k"], "p", "r", 1, 1.0, max_rounds=3)


def test_session_alignment_fails_on_a_small_bound(spark):
    eye = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]
    rows = [(k + 1, k, *map(float, eye), 1.0, 0.0, 0.0) for k in range(4)]
    loops = spark.createDataFrame(rows, ["session", "map_session", *names])
    assert session_align(loops).count() == 5
    with pytest.raises(NotSettled):
        session_align(loops, max_rounds=2)


@pytest.mark.parametrize("regular", [True, False])
def test_epochs_over_many_blocks(spark, regular):
    steps = np.full(1000, 0.1) if regular else np.random.default_rng(2).choice([0.05, 0.1, 0.9, 4.0], 1000)
    times = np.cumsum(steps)
    df = spark.createDataFrame(pd.DataFrame({"session": 0, "scan_id": range(1000), "t": times}))
    got = windows.map_epochs(df, 0.55, block=ordered.block_of(F.col("scan_id"), 16)).toPandas().sort_values("scan_id")["epoch"]
    want, start, epoch = [], -np.inf, -1
    for t in times:
        if t - start >= 0.55:
            start, epoch = t, epoch + 1
        want.append(epoch)
    assert got.tolist() == want


def test_ring_index_settles_in_three_rounds(spark, monkeypatch):
    n = 64 * 50
    angle = np.arange(n) * 2 * np.pi / 37 + 0.01
    pdf = pd.DataFrame({"session": 0, "scan_id": 0, "point_idx": range(n), "x": np.cos(angle), "y": np.sin(angle)})
    seen = []
    count = ordered.rounds
    monkeypatch.setattr(ordered, "rounds", lambda limit, what: (seen.append(k) or k for k in count(limit, what)))
    got = windows.ring_index(spark.createDataFrame(pdf), 20, block=ordered.block_of(F.col("point_idx"), 50)).toPandas().sort_values("point_idx")["ring"].tolist()
    want, ring, since, last = [], 1, 0, 1.0
    for a in np.arctan2(pdf["y"], pdf["x"]):
        if 0 <= a < 1 and -1 < last <= 0 and since > 20:
            ring, since = ring + 1, 0
        else:
            since += 1
        last = a
        want.append(ring)
    assert got == want and len(seen) <= 3


def test_voxel_keys_keep_apart_or_fail(spark):
    edge = 1 << 20
    keys = [F.col(c) for c in "xyz"]
    inside = spark.createDataFrame([(0, edge - 1, 0), (1, -edge, 0)], "x long, y long, z long")
    assert inside.select(pack(keys).alias("k")).distinct().count() == 2
    for far in ((0, edge, 0), (0, 0, -edge - 1)):
        with pytest.raises(Exception, match="outside"):
            spark.createDataFrame([far], "x long, y long, z long").select(pack(keys).alias("k")).collect()

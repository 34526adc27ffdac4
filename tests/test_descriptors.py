"""Descriptor lookup and insertion against plain loops."""

from itertools import product

import numpy as np
import pytest

from scanloom.operators import loops, triangles as tr
from scanloom.params import LoopParams

SCHEMA = "session int, keyframe int, sid long, a double, b double, c double, {0}, kx int, ky int, kz int".format(
    ", ".join(f"{c} struct<x:double,y:double,z:double,bits:long,summary:int>" for c in tr.CORNERS)
)


def descriptors(spark, count=220, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        sides = np.sort(rng.uniform(0.5, 6.0, 3) if i % 3 else rng.uniform(0.5, 1.2, 3)).tolist()
        if i % 7 == 0 and rows:
            sides = list(rows[-1][3:6])  # a descriptor with the sides of another
        corners = [(0.0, 0.0, 0.0, bits := int(rng.integers(1, 64)), bits.bit_count()) for _ in range(3)]
        rows.append((int(rng.integers(0, 3)), i // 9, 1000 + i, *sides, *corners, *[int(np.floor(x + 0.5)) for x in sides]))
    return rows, spark.createDataFrame(rows, SCHEMA)


def alike(q, d):
    return sum(2.0 * (p[3] & r[3]).bit_count() / (p[4] + r[4]) for p, r in zip(q[6:9], d[6:9])) / 3


def plain_hits(rows, p):
    out = set()
    for q, d in product(rows, rows):
        if not (q[1] - d[1] > p.skip_near and d[0] <= q[0]):
            continue
        seen = {tuple(int(np.floor(x + i)) for x, i in zip(q[3:6], step)) for step in product((-1, 0, 1), repeat=3)}
        seen = {k for k in seen if sum((x - (m + 0.5)) ** 2 for x, m in zip(q[3:6], k)) < 2.25}
        dist, size = (sum((x - y) ** 2 for x, y in zip(q[3:6], d[3:6])) ** 0.5, sum(x * x for x in q[3:6]) ** 0.5)
        if tuple(d[9:]) in seen and dist < size * p.side_ratio and alike(q, d) > p.similarity:
            out.add((q[2], d[2]))
    return out


@pytest.mark.parametrize("ratio", [0.03, 0.3, 0.7])
def test_hits_equal_all_pairs_and_carry_no_corners(spark, ratio):
    rows, df = descriptors(spark)
    p = LoopParams(skip_near=1, similarity=0.5, side_ratio=ratio)
    found = tr.hits(df, df, p)
    assert not {"q", "d"} & set(found.columns)  # votes need no corners
    assert sorted((r.q_sid, r.d_sid) for r in found.collect()) == sorted(plain_hits(rows, p))
    wide = tr.lookup(df, df, p)
    assert {(r.q.sid, r.d.sid) for r in wide.collect()} == plain_hits(rows, p)
    best = tr.candidates(tr.votes(found), 1)
    some = tr.lookup(df, df, p, pairs=best)
    frames = {(r.session, r.keyframe, r.map_session, r.db_keyframe) for r in best.collect()}
    of = {r[2]: r[:2] for r in rows}
    assert {(r.q.sid, r.d.sid) for r in some.collect()} == {(q, d) for q, d in plain_hits(rows, p) if (*of[q], *of[d]) in frames}


def test_matches_are_numbered_without_a_second_lookup(spark):
    _, df = descriptors(spark)
    p = LoopParams(skip_near=1, similarity=0.5, side_ratio=0.3)
    wide = tr.lookup(df, df, p)
    plain, numbered = (x._jdf.queryExecution().optimizedPlan().toString().count("Join ") for x in (wide, loops.number_matches(wide)))
    assert numbered == plain
    got = {(r.session, r.keyframe, r.map_session, r.db_keyframe): [] for r in wide.collect()}
    for r in loops.number_matches(wide).collect():
        got[r.session, r.keyframe, r.map_session, r.db_keyframe].append((r.i, r.q.sid, r.d.sid, r.total))
    for found in got.values():
        found.sort()
        assert [x[0] for x in found] == list(range(len(found))) and {x[3] for x in found} == {len(found)}
        assert [x[1:3] for x in found] == sorted(x[1:3] for x in found)

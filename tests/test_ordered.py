"""Blocked sequence operators give the same answer for any block width."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanloom.operators import ordered, windows
from scanloom.operators.temporal import nearest_time


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"session": rng.integers(0, 2, 200), "seq": rng.permutation(400)[:200], "v": rng.normal(size=200)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("width", [7.0, 10_000.0])
def test_row_number_and_neighbour(frame, width):
    pdf, df = frame
    block = ordered.block_of(F.col("seq"), width)
    got = ordered.row_number(df, ["session"], ["seq"], block).toPandas().set_index("seq")["rn"]
    want = pdf.groupby("session")["seq"].rank().astype(int)
    assert (got.loc[pdf["seq"]].to_numpy() == want.to_numpy()).all()
    for step, name in ((-1, "prev"), (1, "next")):
        got = ordered.neighbour(df, ["session"], "seq", block, ["v"], step, name).select("seq", f"{name}.v").toPandas().set_index("seq")["v"]
        want = pdf.sort_values("seq").groupby("session")["v"].shift(-step)
        want.index = pdf.loc[want.index, "seq"]
        np.testing.assert_allclose(got.loc[want.index].to_numpy(float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("width", [3.0, 1e6])
def test_nearest_time(spark, width):
    rng = np.random.default_rng(5)
    a = pd.DataFrame({"k": 0, "p": range(60), "t": rng.uniform(0, 50, 60).round(1)})
    b = pd.DataFrame({"k": 0, "r": range(40), "u": np.sort(rng.uniform(0, 50, 40).round(1))})
    got = nearest_time(spark.createDataFrame(a), spark.createDataFrame(b), ["k"], "t", "u", "r", width=width).select("p", "near.r").toPandas().sort_values("p")["r"].to_numpy()
    # The first row with the smallest difference wins.
    want = [int(np.argmin(np.abs(b["u"].to_numpy() - t).round(6))) for t in a["t"]]
    same = np.abs(b["u"].to_numpy()[got] - a["t"]).round(6) == np.abs(b["u"].to_numpy()[want] - a["t"]).round(6)
    assert same.all()


def test_fold_equals_sequential_pass_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    times = np.cumsum(rng.uniform(0.05, 0.4, 300))
    df = spark.createDataFrame(pd.DataFrame({"session": 0, "scan_id": range(300), "t": times}))
    monkeypatch.setattr(windows, "block_of", lambda c, w=None: ordered.block_of(c, 40))
    got = windows.map_epochs(df, 1.0).toPandas().sort_values("scan_id")["epoch"].to_numpy()
    want, start, epoch = [], None, -1
    for t in times:
        if start is None or t - start >= 1.0:
            start, epoch = t, epoch + 1
        want.append(epoch)
    assert (got == want).all()


def test_key_frames_drop_the_rest(spark):
    df = spark.createDataFrame([(0, i) for i in range(7)] + [(1, i) for i in range(1, 5)], "session INT, scan_id INT")
    got = {(r.session, r.scan_id): (r.keyframe, r.anchor_scan) for r in windows.key_frames(df, 3).collect()}
    assert got == {(0, 0): (0, 0), (0, 1): (0, 0), (0, 2): (0, 0), (0, 3): (1, 3), (0, 4): (1, 3), (0, 5): (1, 3), (1, 1): (2, 1), (1, 2): (2, 1), (1, 3): (2, 1)}


def test_local_map_settles_in_few_rounds(spark, monkeypatch):
    """Forty blocks of a drive out and back: a round for each block was one job after the other on the driver."""
    n = 400
    x = np.concatenate([np.arange(n // 2), np.arange(n // 2)[::-1]]) * 0.7
    pdf = pd.DataFrame({"session": 1, "seq": range(n), "tx": x, "ty": -x / 3, "tz": 0.0})
    monkeypatch.setattr(windows, "block_of", lambda c: F.floor(c / 10).cast("bigint"))
    seen = []
    plain = ordered.rounds
    monkeypatch.setattr(ordered, "rounds", lambda *a: (seen.append(i) or i for i in plain(*a)))
    got = windows.local_map(spark.createDataFrame(pdf), "seq", 60.0, 15.0, 1.2).toPandas().sort_values("seq")["moved"].tolist()
    low, want = None, []
    for p in pdf[["tx", "ty", "tz"]].to_numpy():
        if low is None:
            low, down, up = p - 30.0, np.zeros(3, bool), np.zeros(3, bool)
        else:
            down, up = np.abs(p - low) <= 18.0, np.abs(p - low - 60.0) <= 18.0
            up &= ~down
            low = low + np.where(up, 10.8, 0.0) - np.where(down, 10.8, 0.0)
        want.append(sum((1 << (2 * k)) * int(down[k]) + (2 << (2 * k)) * int(up[k]) for k in range(3)))
    assert got == want and sum(m > 0 for m in want) > 20
    assert len(seen) <= 3

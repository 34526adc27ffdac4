"""File readers, writers and streams."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scanloom.operators import evaluate, scanlines, windows
from scanloom.params import LineFeatureParams, TrackParams
from scanloom.sources import poses, scans, sinks
from scanloom.streaming import sensor, tracks


def test_read_scans(spark, tmp_path):
    (tmp_path / "pcd" / "0").mkdir(parents=True)
    head = "# .PCD\nVERSION .7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 2\nDATA "
    (tmp_path / "pcd" / "0" / "1.pcd").write_text(head + "ascii\n1 2 3 4\n5 6 7 8\n")
    (tmp_path / "pcd" / "0" / "3.pcd").write_bytes((head + "binary\n").encode() + np.arange(8, dtype="<f4").tobytes())
    got = scans.read_scans(spark, str(tmp_path / "pcd")).orderBy("scan_id", "point_idx").toPandas()
    assert got["scan_id"].tolist() == [1, 1, 3, 3] and got["x"].tolist() == [1, 5, 0, 4] and got["intensity"].tolist() == [4, 8, 3, 7]


def test_read_bin_and_labels(spark, tmp_path):
    for folder, name, data in (("bin", "000002.bin", np.arange(8, dtype="<f4")), ("lab", "000002.label", np.array([9, 251 + 65536], "<i4"))):
        (tmp_path / folder / "4").mkdir(parents=True)
        (tmp_path / folder / "4" / name).write_bytes(data.tobytes())
    pts = scans.read_kitti_bin(spark, str(tmp_path / "bin")).toPandas()
    lab = scans.read_labels(spark, str(tmp_path / "lab")).toPandas()
    assert pts[["session", "scan_id"]].drop_duplicates().values.tolist() == [[4, 2]] and pts["y"].tolist() == [1, 5]
    assert lab["label"].tolist() == [9, 251 + 65536]


def test_pose_texts(spark, tmp_path):
    (tmp_path / "evo0.txt").write_text("0.5 1 2 3 0 0 0 1\n0.6 4 5 6 0 0 1 0\n")
    evo = poses.read_evo(spark, str(tmp_path / "evo0.txt")).orderBy("scan_id").toPandas()
    assert evo["scan_id"].tolist() == [1, 2] and evo["tx"].tolist() == [1, 4] and evo["qz"].tolist() == [0, 1]
    lines = [r.value for r in sinks.pose_matrix_lines(spark.createDataFrame(evo)).orderBy("scan_id").collect()]
    (tmp_path / "k0.txt").write_text("\n".join(lines))
    kitti = poses.read_kitti(spark, str(tmp_path / "k0.txt")).orderBy("scan_id").toPandas()
    assert kitti["ty"].tolist() == [2, 5] and kitti["r00"].tolist() == [1, -1]
    (tmp_path / "per").mkdir()
    (tmp_path / "per" / "0.txt").write_text("1 0 0 5\n0 1 0 0\n0 0 1 0\n0 0 0 1")
    (tmp_path / "per" / "1.txt").write_text("1 0 0 7\n0 1 0 1\n0 0 1 0\n0 0 0 1")
    per = poses.read_pose_per_file(spark, str(tmp_path / "per")).orderBy("scan_id").toPandas()
    assert per["tx"].tolist() == [0, 2] and per["ty"].tolist() == [0, 1]
    sinks.write_trajectory(spark.createDataFrame(evo), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "truth")).count() == 2


def test_epoch_stream_matches_batch(spark, tmp_path):
    t = np.cumsum(np.random.default_rng(0).uniform(0.05, 0.3, 50))
    pdf = pd.DataFrame({"session": np.zeros(50, "int32"), "t": t})
    for i in range(0, 50, 10):
        spark.createDataFrame(pdf[i : i + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("session INT, t DOUBLE").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sensor.epoch_stream(src, 1.0, 3).writeStream.format("memory").queryName("ep").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("ep").toPandas().sort_values("t")
    batch = windows.map_epochs(spark.createDataFrame(pdf.assign(scan_id=range(50))), 1.0).toPandas().sort_values("t")
    assert got["epoch"].tolist() == batch["epoch"].tolist() and (got["oldest"] == (got["epoch"] - 2).clip(lower=0)).all()


def test_assignment_is_optimal_and_tracks_follow():
    gain = np.array([[0.9, 0.8], [0.85, 0.0], [0.0, 0.0]])
    assert tracks.assign(gain).tolist() == [1, 0, -1]
    tracker = tracks.Tracker(TrackParams())
    seen = []
    for k in range(10):
        x = 0.05 * k
        frame = pd.DataFrame([{"min_x": x, "max_x": x + 2, "min_y": 0, "max_y": 2, "min_z": 0, "max_z": 2}, {"min_x": 20.0, "max_x": 22, "min_y": 0, "max_y": 2, "min_z": 0, "max_z": 2}])
        seen.append([(r[1], r[2]) for r in tracker.step(0.02 * k, frame)])
    assert [n for n, _ in seen[-1]] == [1, 2] and seen[0][0][1] == "NEW" and seen[1][0][1] == "MATCHED_ONCE" and seen[-1][0][1] == "MATCHED_MORE"
    tracker.step(5.0, frame.iloc[:1])
    assert len(tracker.tracks) == 1


def test_assignment_by_parts_is_optimal():
    rng = np.random.default_rng(2)
    for n in range(200):
        gain = np.where(rng.random((n % 9 + 1, n % 7 + 1)) < 0.3, rng.random((n % 9 + 1, n % 7 + 1)), 0.0)
        whole, parts = tracks.assign(gain), tracks.matched(gain)
        total = lambda m: sum(np.floor(gain[i, j] * 10000) for i, j in enumerate(m) if j >= 0)  # noqa: B023, E731
        assert total(whole) == total(parts) and len(set(parts[parts >= 0])) == (parts >= 0).sum() and all(gain[i, j] > 0 for i, j in enumerate(parts) if j >= 0)
    assert tracks.matched(np.array([[6e-5, 0.0], [np.nan, 0.2]])).tolist() == [-1, 1]


def test_tracker_assigns_overlapping_boxes_only(monkeypatch):
    """90 boxes a frame, two of which compete: the assignment grows with the cube of the boxes it is given."""
    shapes = []
    plain = tracks.assign
    monkeypatch.setattr(tracks, "assign", lambda gain: shapes.append(gain.shape) or plain(gain))
    tracker = tracks.Tracker(TrackParams())
    place = np.stack([np.arange(90) * 5.0, np.zeros(90), np.zeros(90)], axis=1)
    place[89] = place[88] + 0.5
    columns = [f"{m}_{a}" for m in ("min", "max") for a in "xyz"]
    frame = pd.DataFrame(np.concatenate([place, place + 2.0], axis=1), columns=columns)
    rows = [tracker.step(0.02 * k, frame) for k in range(6)]
    assert [r[1] for r in rows[-1]] == list(range(1, 91)) and {r[2] for r in rows[-1]} == {"MATCHED_MORE"}
    assert shapes == [(2, 2)] * 5


def test_gap_fill(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (0, 50)], "s INT, t BIGINT")
    got = sorted((r.t, r.zero) for r in sensor.gap_fill(df, ["s"], "t", 10, 15, 1000).collect())
    assert got == [(0, False), (10, False), (20, True), (30, True), (40, True), (50, False)]


def test_confusion_and_octiles(spark):
    df = spark.createDataFrame([(0, 0, 1001, 251), (0, 0, 1001, 9), (0, 0, 9, 251), (0, 1, 9, 9), (0, 1, 65535, 300), (0, 1, 4002, 251)], "session INT, scan_id INT, label INT, pred INT")
    total = evaluate.confusion(df).filter("session IS NULL").first()
    assert (total.tp, total.fn, total.fp, total.op, total.tn) == (2, 1, 1, 1, 1) and abs(total.iou - 0.5) < 1e-12
    per = evaluate.object_recall(df)
    assert {(r.object, r.recall) for r in per.collect()} == {(1001, 0.5), (4002, 1.0)}
    assert {r.grp: (r.n, r.q2) for r in evaluate.recall_octiles(per).collect()} == {"vehicle": (1, 0.5), "pedestrian": (1, 1.0)}


def test_line_features_flat_wall_is_planar(spark):
    y = np.arange(-1, 1, 0.01)
    pdf = pd.DataFrame({"session": 0, "scan_id": 0, "line": 0, "point_idx": range(len(y)), "x": 5.0, "y": y, "z": 0.0})
    out = scanlines.line_features(spark.createDataFrame(pdf), LineFeatureParams()).toPandas()
    inner = out[(out["point_idx"] > 5) & (out["point_idx"] < 150)]
    assert inner["code"].isin([scanlines.CODES["flat_end"], scanlines.CODES["flat"]]).mean() > 0.9


def test_sync_meets_rows_near_in_time_only(spark):
    spans = [(1, 0, 60), (2, 59.5, 120), (3, 60, 60), (4, 10, 400), (5, 400, 10), (6, -30, 0), (7, None, 5)]
    times = [-31, -30, -29.5, 0, 0.5, 59.5, 60, 60.5, 120, 180, 399, 400, 401, None]
    scans = spark.createDataFrame([(k % 2, k, *(None if x is None else float(x) for x in (a, b))) for k, a, b in spans], "session int, seq int, a double, b double")
    scans = scans.selectExpr("session", "seq", "timestamp_micros(cast(a * 1000000 as bigint)) start_ts", "timestamp_micros(cast(b * 1000000 as bigint)) end_ts")
    imu = spark.createDataFrame([(s, k, None if t is None else float(t)) for s in range(2) for k, t in enumerate(times)], "session int, sample int, t double")
    imu = imu.selectExpr("session", "sample", "timestamp_micros(cast(t * 1000000 as bigint)) imu_ts")
    out = sensor.sync(scans, imu, "session")
    assert out.columns == ["session", "seq", "start_ts", "end_ts", "sample", "imu_ts"]
    want = sorted((k, i) for k, a, b in spans for i, t in enumerate(times) if None not in (a, t) and a < t <= b)
    assert sorted((r.seq, r.sample) for r in out.collect()) == want

    # 60,000 rows a side in one session, a second apart: all pairs would be 3.6 billion
    many = spark.range(60_000).selectExpr("0 session", "id", "timestamp_seconds(id) ts")
    joined = sensor.sync(many.selectExpr("session", "id seq", "ts - interval 2 seconds start_ts", "ts end_ts"), many.selectExpr("session", "id sample", "ts imu_ts"), "session")
    assert joined.count() == 2 * 60_000 - 1
    assert "_bucket" in joined._jdf.queryExecution().optimizedPlan().toString()

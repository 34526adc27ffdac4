"""Readers of scan and label files: one binaryFile row per scan, decoded inside the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.schemas import LABELS, POINTS
from scanloom.sources.poses import number_in

_PCD_TYPES = {("F", 4): "f4", ("F", 8): "f8", ("U", 1): "u1", ("U", 2): "u2", ("U", 4): "u4", ("I", 1): "i1", ("I", 2): "i2", ("I", 4): "i4"}
_COLUMNS = [c.strip().split(" ")[0] for c in POINTS.split(",")]


def decode_pcd(blob: bytes) -> dict[str, np.ndarray]:
    """Fields of an ascii or binary point file by name."""
    head, pos = {}, 0
    while True:
        end = blob.index(b"\n", pos)
        words = blob[pos:end].decode("ascii", "replace").split()
        pos = end + 1
        if words and not words[0].startswith("#"):
            head[words[0]] = words[1:]
            if words[0] == "DATA":
                break
    names, sizes, kinds = head["FIELDS"], [int(s) for s in head["SIZE"]], head["TYPE"]
    count = int(head["POINTS"][0])
    if head["DATA"][0] == "ascii":
        table = np.array(blob[pos:].split(), dtype=float).reshape(count, len(names))
        out = {n: table[:, i] for i, n in enumerate(names)}
    elif head["DATA"][0] == "binary":
        dtype = np.dtype([(f"{n}{i}" if n == "_" else n, _PCD_TYPES[(k, s)], (int(c),) if int(c) > 1 else ()) for i, (n, s, k, c) in enumerate(zip(names, sizes, kinds, head.get("COUNT", ["1"] * len(names))))])
        table = np.frombuffer(blob, dtype=dtype, count=count, offset=pos)
        out = {n: table[n] for n in dtype.names}
    else:
        raise ValueError(f"unsupported point encoding {head['DATA'][0]}")
    if "rgb" in out:
        packed = np.asarray(out["rgb"]).astype("f4").view("u4") if np.asarray(out["rgb"]).dtype.kind == "f" else np.asarray(out["rgb"]).astype("u4")
        out.update(r=(packed >> 16) & 255, g=(packed >> 8) & 255, b=packed & 255)
    return out


def _rows(fields: dict[str, np.ndarray], session: int, scan: int) -> pd.DataFrame:
    n = len(fields["x"])
    out = pd.DataFrame({"session": np.full(n, session, "int32"), "scan_id": np.full(n, scan, "int32"), "point_idx": np.arange(n, dtype="int64")})
    for c in _COLUMNS[3:]:
        if c in fields:
            out[c] = np.asarray(fields[c]).astype("float32" if c in ("x", "y", "z", "intensity") else "int64")
        else:
            out[c] = None
    return out


def _files(spark: SparkSession, root: str, pattern: str, name: str) -> DataFrame:
    """Files ``<root>/<session>/<scan>.<ext>`` or ``<root>/session=<n>/scan_id=<n>/<any>``; a missing file is no row."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    if pattern.startswith("part-"):
        return df.select(number_in(F.col("path"), "session").alias("session"), number_in(F.col("path"), "scan_id").alias("scan_id"), "content")
    return df.select(
        F.regexp_extract("path", rf"/(\d+)/[^/]*?(\d+)\.{name}$", 1).cast("int").alias("session"),
        F.regexp_extract("path", rf"/(\d+)/[^/]*?(\d+)\.{name}$", 2).cast("int").alias("scan_id"), "content",
    )


def read_scans(spark: SparkSession, root: str, pattern: str = "*.pcd") -> DataFrame:
    """Numbered point files of all sessions; ``part-*`` reads what :func:`sinks.write_scan_files` wrote."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield _rows(decode_pcd(row.content), row.session, row.scan_id)

    return _files(spark, root, pattern, "pcd").mapInPandas(run, POINTS)


def read_kitti_bin(spark: SparkSession, root: str) -> DataFrame:
    """x, y, z, intensity float32 quads."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q = np.frombuffer(row.content, "<f4").reshape(-1, 4)
                yield _rows({c: q[:, i] for i, c in enumerate(("x", "y", "z", "intensity"))}, row.session, row.scan_id)

    return _files(spark, root, "*.bin", "bin").mapInPandas(run, POINTS)


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """One int32 per point, aligned by position."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                v = np.frombuffer(row.content, "<i4")
                yield pd.DataFrame({"session": np.int32(row.session), "scan_id": np.int32(row.scan_id), "point_idx": np.arange(len(v), dtype="int64"), "label": v.astype("int32")})

    return _files(spark, root, "*.label", "label").mapInPandas(run, LABELS)


def land_points(points: DataFrame, table: str, buckets: int) -> None:
    """Store points bucketed and sorted by scan: joins on (session, scan_id) then need no shuffle of points."""
    points.write.mode("overwrite").bucketBy(buckets, "session", "scan_id").sortBy("session", "scan_id").saveAsTable(table)

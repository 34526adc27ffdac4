"""Readers of pose texts. The line number is the scan order, so files are read whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import geometry as g
from scanloom.schemas import LOOP_TRUTH
from scanloom.session import cut

MATRIX = [f"{c}" for i, t in enumerate(g.TRANS) for c in (*g.ROT[3 * i : 3 * i + 3], t)]


def number_in(path: Column, name: str) -> Column:
    """The number of a folder ``name=<n>`` in the path, else the last number of the path."""
    def find(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast("int")

    return F.coalesce(find(rf"/{name}=(\d+)/"), find(r"(\d+)[^/\d]*$"))


def _lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(session, line_no, v) of every non-empty line; one file holds one session."""
    df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    df = df.select(F.coalesce(number_in(F.col("path"), "session"), F.lit(0)).alias("session"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    df = df.filter(F.trim("line") != "")
    return df.select("session", "line_no", F.split(F.trim("line"), separator).alias("v"))


def _cols(names: Sequence[str], start: int = 0) -> list[Column]:
    return [F.col("v")[start + i].cast("double").alias(n) for i, n in enumerate(names)]


def read_evo(spark: SparkSession, path: str) -> DataFrame:
    """t x y z qx qy qz qw, spaces; scan number counts lines from 1."""
    df = _lines(spark, path, r"\s+")
    return df.select("session", (F.col("line_no") + 1).alias("scan_id"), *_cols(["t", *g.TRANS, *g.QUAT]))


def read_csv_quat(spark: SparkSession, path: str) -> DataFrame:
    """t,x,y,z,qw,qx,qy,qz."""
    df = _lines(spark, path, r"\s*,\s*").select("session", (F.col("line_no") + 1).alias("scan_id"), *_cols(["t", *g.TRANS, "qw", "qx", "qy", "qz"]))
    return df.select("session", "scan_id", "t", *g.TRANS, *g.QUAT)


def read_csv_matrix(spark: SparkSession, path: str) -> DataFrame:
    """t and twelve row-major entries, commas."""
    df = _lines(spark, path, r"\s*,\s*")
    return df.select("session", (F.col("line_no") + 1).alias("scan_id"), *_cols(["t", *MATRIX]))


def read_frame_matrix(spark: SparkSession, path: str) -> DataFrame:
    """frame number and twelve entries, spaces."""
    df = _lines(spark, path, r"\s+")
    return df.select("session", F.col("v")[0].cast("double").cast("int").alias("scan_id"), *_cols(MATRIX, 1))


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """Twelve entries; the line number is the frame."""
    df = _lines(spark, path, r"\s+")
    return df.select("session", F.col("line_no").alias("scan_id"), *_cols(MATRIX))


def read_pose_per_file(spark: SparkSession, path: str, extrinsic: Sequence[float] | None = None) -> DataFrame:
    """One 4x4 per file, made relative to the first file of its session and post-multiplied by the lidar extrinsic (3x4).

    The session is the number of a folder ``session=<n>``; files outside such folders are session 0.
    """
    df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("v"))
    session = F.coalesce(F.nullif(F.regexp_extract("path", r"/session=(\d+)/", 1), F.lit("")).cast("int"), F.lit(0))
    df = cut(df.select(session.alias("session"), number_in(F.col("path"), "scan_id").alias("scan_id"), *_cols(MATRIX)))  # each file is opened once
    first = df.groupBy("session").agg(F.min_by(F.struct(*MATRIX), "scan_id").alias("f"))
    df = df.join(first, "session")
    r, t = g.between(g.cols(g.ROT, "f."), g.cols(g.TRANS, "f."), g.cols(g.ROT), g.cols(g.TRANS))
    if extrinsic is not None:
        e = dict(zip(MATRIX, [F.lit(float(x)) for x in extrinsic]))
        r, t = g.compose(r, t, [e[c] for c in g.ROT], [e[c] for c in g.TRANS])
    return df.select("session", "scan_id", *[c.alias(n) for c, n in zip((*r, *t), (*g.ROT, *g.TRANS))])


def read_loop_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOOP_TRUTH).csv(path)

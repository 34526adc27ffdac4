"""Point-cloud views over the driver tables, in Spark and in SQL.

Every view has one definition per engine and they are kept side by side. Scans are runs
of 256 order keys, so their number grows with the data and their size does not.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 48


class Views:
    """Lazy DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def points(self) -> DataFrame:
        c = F.col
        return self.table("lineitem").select(
            (c("l_suppkey") % 3).cast("int").alias("session"),
            F.floor(c("l_orderkey") / 256).cast("int").alias("scan_id"),
            (((c("l_orderkey") % 256) * 8 + c("l_linenumber")) * 16777216 + F.round(c("l_extendedprice") * 100).cast("bigint")).alias("point_idx"),
            (c("l_extendedprice") / 1000 - 50).alias("x"),
            (c("l_quantity") - 25).alias("y"),
            ((c("l_discount") + c("l_tax")) * 20).alias("z"),
            c("l_linenumber").cast("double").alias("intensity"),
            c("l_linenumber").cast("int").alias("line"),
            (c("l_partkey") % 64).cast("int").alias("tag"),
            ((c("l_partkey") % 1000) * 100000).alias("offset_ns"),
            F.when(c("l_tax") > 0.07, F.lit(None)).otherwise(c("l_partkey") % 16 * 17).cast("int").alias("r"),
            (c("l_suppkey") % 256).cast("int").alias("g"),
            (c("l_partkey") % 256).cast("int").alias("b"),
        )

    @cached_property
    def poses(self) -> DataFrame:
        return (
            self.table("orders")
            .groupBy((F.col("o_custkey") % 3).cast("int").alias("session"), F.floor(F.col("o_orderkey") / 256).cast("int").alias("scan_id"))
            .agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
            .select(
                "session", "scan_id",
                (F.col("scan_id") * 0.1).alias("t"),
                (F.col("scan_id") * 0.5).alias("tx"),
                (F.col("lo") / 10000).alias("ty"),
                (F.col("session") * 0.1).alias("tz"),
                F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"),
                F.sin(F.col("hi") / 200000).alias("qz"), F.cos(F.col("hi") / 200000).alias("qw"),
            )
        )

    @cached_property
    def track(self) -> DataFrame:
        c = F.col
        return self.table("orders").select(
            (c("o_custkey") % 3).cast("int").alias("session"),
            c("o_orderkey").alias("seq"),
            (c("o_orderkey") * 0.1 + (c("o_totalprice") - F.floor("o_totalprice")) * 0.09).alias("t"),
            (F.floor(c("o_orderkey") / 7) * 0.1).alias("tx"),
            ((c("o_custkey") % 10) * 0.01).alias("ty"),
            F.lit(0.0).alias("tz"),
            (c("o_orderkey") % 50 * 0.01).alias("yaw"),
        )

    @cached_property
    def keypoints(self) -> DataFrame:
        e = F.col("embedding")
        bits = None
        for i in range(BITS):
            bit = F.when(e[3 + i] > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
            bits = bit if bits is None else bits.bitwiseOR(bit)
        return self.table("embeddings").select(
            (F.floor(F.col("vec_id") / 25) % 3).cast("int").alias("session"),
            F.floor(F.col("vec_id") / 25).cast("int").alias("keyframe"),
            F.col("vec_id").alias("kp"),
            (e[0].cast("double") * 50).alias("x"), (e[1].cast("double") * 50).alias("y"), (e[2].cast("double") * 50).alias("z"),
            bits.alias("bits"),
        ).withColumn("summary", F.bit_count("bits").cast("int"))

    @cached_property
    def stream(self) -> DataFrame:
        c = F.col
        return self.table("events").select(
            (c("user_id") % 8).cast("int").alias("session"), c("event_id").alias("seq"), c("ts"),
            F.unix_micros(c("ts").cast("timestamp")).alias("t_us"),
            (F.unix_micros(c("ts").cast("timestamp")) / 1000000.0).alias("t"), c("event_type"), c("value"),
        )

    @cached_property
    def evaluation(self) -> DataFrame:
        c = F.col
        label = (
            F.when(c("l_returnflag") == "R", (1 + c("l_partkey") % 6) * 1000 + c("l_suppkey") % 5)
            .when(c("l_returnflag") == "A", F.lit(9).cast("bigint"))
            .when(c("l_tax") > 0.06, F.lit(65535).cast("bigint")).otherwise(F.lit(40).cast("bigint"))
        )
        pred = F.when(c("l_discount") > 0.05, 251).when(c("l_discount") > 0.01, 9).otherwise(30)
        return self.table("lineitem").select(
            (c("l_suppkey") % 3).cast("int").alias("session"),
            F.floor(c("l_orderkey") / 256).cast("int").alias("scan_id"),
            (((c("l_orderkey") % 256) * 8 + c("l_linenumber")) * 16777216 + F.round(c("l_extendedprice") * 100).cast("bigint")).alias("point_idx"),
            (label + 65536 * c("l_linenumber")).cast("int").alias("label"),
            pred.cast("int").alias("pred"),
        )


_BIT_SQL = " | ".join(f"(CASE WHEN embedding[{4 + i}] > 0 THEN {1 << i}::BIGINT ELSE 0::BIGINT END)" for i in range(BITS))
_IDX = "((l_orderkey % 256) * 8 + l_linenumber) * 16777216 + round(l_extendedprice * 100)::BIGINT"

SQL = {
    "v_points": f"""SELECT (l_suppkey % 3)::INT session, (l_orderkey // 256)::INT scan_id, {_IDX} point_idx,
        l_extendedprice / 1000 - 50 x, l_quantity - 25 y, (l_discount + l_tax) * 20 z,
        l_linenumber::DOUBLE intensity, l_linenumber::INT line, (l_partkey % 64)::INT tag,
        (l_partkey % 1000) * 100000 offset_ns,
        CASE WHEN l_tax > 0.07 THEN NULL ELSE (l_partkey % 16 * 17)::INT END r, (l_suppkey % 256)::INT g, (l_partkey % 256)::INT b
        FROM lineitem""",
    "v_poses": """SELECT session, scan_id, scan_id * 0.1::DOUBLE t, scan_id * 0.5::DOUBLE tx, lo / 10000 ty, session * 0.1::DOUBLE tz,
        0.0::DOUBLE qx, 0.0::DOUBLE qy, sin(hi / 200000) qz, cos(hi / 200000) qw FROM (
        SELECT (o_custkey % 3)::INT session, (o_orderkey // 256)::INT scan_id, min(o_totalprice) lo, max(o_totalprice) hi
        FROM orders GROUP BY 1, 2)""",
    "v_track": """SELECT (o_custkey % 3)::INT session, o_orderkey seq,
        o_orderkey * 0.1::DOUBLE + (o_totalprice - floor(o_totalprice)) * 0.09::DOUBLE t,
        (o_orderkey // 7) * 0.1::DOUBLE tx, (o_custkey % 10) * 0.01::DOUBLE ty, 0.0::DOUBLE tz,
        (o_orderkey % 50) * 0.01::DOUBLE yaw FROM orders""",
    "v_keypoints": f"""SELECT *, bit_count(bits)::INT summary FROM (SELECT ((vec_id // 25) % 3)::INT session, (vec_id // 25)::INT keyframe, vec_id kp,
        embedding[1]::DOUBLE * 50 x, embedding[2]::DOUBLE * 50 y, embedding[3]::DOUBLE * 50 z, {_BIT_SQL} bits FROM embeddings)""",
    "v_stream": """SELECT (user_id % 8)::INT session, event_id seq, ts, epoch_us(ts) t_us, epoch_us(ts) / 1000000.0::DOUBLE t, event_type, value FROM events""",
    "v_eval": f"""SELECT (l_suppkey % 3)::INT session, (l_orderkey // 256)::INT scan_id, {_IDX} point_idx,
        ((CASE WHEN l_returnflag = 'R' THEN (1 + l_partkey % 6) * 1000 + l_suppkey % 5 WHEN l_returnflag = 'A' THEN 9
          WHEN l_tax > 0.06 THEN 65535 ELSE 40 END) + 65536 * l_linenumber)::INT AS label,
        (CASE WHEN l_discount > 0.05 THEN 251 WHEN l_discount > 0.01 THEN 9 ELSE 30 END)::INT pred FROM lineitem""",
}


def sql(body: str) -> str:
    """Prefix a query with the definitions of the views it names."""
    text = body.strip()
    used = [f"{name} AS ({definition})" for name, definition in SQL.items() if name in text]
    head = "WITH "
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(start):
            head, text = start, text[len(start):]
            return head + ",\n".join([*used, text])
    return (head + ",\n".join(used) + "\n" + text) if used else text

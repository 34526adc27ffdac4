"""Inertial start-up statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("ax", "ay", "az", "gx", "gy", "gz")


def imu_start(imu: DataFrame, count: int = 10, t: str = "t") -> DataFrame:
    """Mean and spread of acceleration and rate over the first ``count`` samples of a session.

    The spread is the recursive one: each sample adds its squared distance to the mean
    that already includes it, weighted (k - 1)/k, and the sum is divided by the count.
    """
    first = (
        imu.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy(t)))
        .filter(F.col("k") <= count)
    )
    w = Window.partitionBy("session").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = first.withColumns({"m_" + a: F.avg(a).over(w) for a in AXES})
    aggs = [F.count("*").alias("n")]
    for a in AXES:
        off = F.col(a) - F.col("m_" + a)
        aggs.append(F.avg(a).alias("mean_" + a))
        aggs.append((F.sum(off * off * (F.col("k") - 1) / F.col("k")) / F.count("*")).alias("cov_" + a))
    return first.groupBy("session").agg(*aggs)

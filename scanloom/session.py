"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "scanloom", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use.

    On a cluster the session comes from spark-submit; nothing in the library
    depends on the settings below except the UTC time zone.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class NotSettled(RuntimeError):
    """A job that runs until nothing changes met the bound of its rounds; it has no result."""


def rounds(limit: int, what: str) -> Iterator[int]:
    """Count rounds for a loop that breaks when it has settled; running out of them is an error."""
    yield from range(limit)
    raise NotSettled(f"{what}: not settled after {limit} rounds")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the tasks of a shuffle, for few rows that make much work each.

    Adaptive execution joins small partitions by their bytes, not by the work that follows.
    """
    return df.repartition(shuffle_tasks(df))


def shuffle_tasks(df: DataFrame) -> int:
    """Tasks of a shuffle, at least two for each core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="scanloom-checkpoint-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    Iterative jobs call this once per round, so a lost executor replays at most
    one round and the plan does not grow with the number of rounds.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

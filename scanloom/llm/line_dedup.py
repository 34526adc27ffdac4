"""Line dedup across documents with levelled sorted runs of line hashes.

The memory of the operator is a set of runs: bucketed and sorted tables of
(hash of a line, smallest document that holds it). Documents arrive in batches of ascending
ids. A batch is merge-anti-joined with the runs, what is new becomes a run of level 0, and as
soon as a level holds ``fan`` runs they are merged into one run of the next level. Keys of
different runs never overlap, so a merge is a union and a sort, and a lookup reads each run once.

Defined results: a null text counts as one empty line; rows without ``doc_id`` pass unchanged and
own no line; repeated rows with one ``doc_id`` are one holder; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.session import cut

#: Characters stripped at both ends of a line: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class LineDedupParams:
    min_chars: int = 10  # code points a key needs to be compared
    batches: int = 4  # batches of ascending doc_id that one table is fed in
    fan: int = 2  # runs of one level that are merged into the next


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased.

    ``lower`` equals the ASCII rule on pure ASCII lines and is much faster than ``translate``.
    """
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def lines_of(docs: DataFrame, params: LineDedupParams) -> DataFrame:
    """One slim row per comparable line: doc_id, hash of the text, position, 128 bits of the key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line")
    )
    keyed = split.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.length("key") >= params.min_chars).select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")
    )


@dataclass
class LineRuns:
    """Levelled sorted runs of (h1, h2, doc_id), kept as bucketed tables of the warehouse."""

    spark: SparkSession
    fan: int = 2
    buckets: int = 0
    name: str = field(default_factory=lambda: f"line_run_{uuid.uuid4().hex[:12]}")
    levels: list[list[str]] = field(default_factory=list)
    _made: int = 0

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def table(self) -> DataFrame:
        """All runs together: each key once, with its owner."""
        return reduce(DataFrame.unionByName, [self.spark.table(t) for t in self.tables()])

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self._made}"
        self._made += 1
        (rows.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").format("parquet").saveAsTable(name))
        return name

    def add(self, keys: DataFrame) -> None:
        """Anti-join the batch ``keys(h1, h2, doc_id)`` with every run and add what is new."""
        new = keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
        for t in self.tables():
            new = new.hint("merge").join(self.spark.table(t).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._push(0, self._write(new))

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan:
            old = self.levels[level]
            merged = self._write(reduce(DataFrame.unionByName, [self.spark.table(t) for t in old]))
            self.levels[level] = []
            for t in old:
                self.spark.sql(f"DROP TABLE {t}")
            self._push(level + 1, merged)

    def drop(self) -> None:
        for t in self.tables():
            self.spark.sql(f"DROP TABLE {t}")
        self.levels = []


def dropped_lines(docs: DataFrame, params: LineDedupParams = LineDedupParams()) -> DataFrame:
    """(doc_id, text_hash, positions): the sorted positions of the lines a document loses."""
    spark = docs.sparkSession
    ends = docs.agg(F.percentile_approx("doc_id", [i / params.batches for i in range(1, params.batches)], 1000).alias("q")).first()["q"] or []
    batch = reduce(lambda c, q: c + (F.col("doc_id") > q).cast("int"), sorted(set(ends)), F.lit(0))
    lines = cut(lines_of(docs, params))
    runs = LineRuns(spark, params.fan)
    for b in range(len(set(ends)) + 1):
        runs.add(lines.filter(batch == b).select("h1", "h2", "doc_id"))
    owners = runs.table().withColumnRenamed("doc_id", "owner")
    lost = (
        lines.join(owners, ["h1", "h2"])
        .filter(F.col("owner") < F.col("doc_id"))
        .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    )
    lost = cut(lost)
    runs.drop()
    return lost


def dedup_lines(docs: DataFrame, params: LineDedupParams = LineDedupParams()) -> DataFrame:
    """``docs`` with the remaining lines as ``text``, plus ``n_lines`` and ``n_dropped``.

    A key of at least ``min_chars`` code points that two documents hold loses all its lines
    outside the smallest ``doc_id``. All other columns stay as they are.
    """
    lost = dropped_lines(docs, params).withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash", "positions": "__lost"})
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.withColumn("__key", F.xxhash64(text)).join(lost, (F.col("doc_id") == F.col("__doc")) & (F.col("__key") == F.col("__hash")), "left")
    parts = joined.withColumn("__lines", F.split(text, "\n")).withColumn("__lost", F.coalesce("__lost", F.array().cast("array<int>")))
    # the kept lines are the slices between the dropped positions, so a long document stays linear
    low = lambda i: F.when(i == 0, 0).otherwise(F.get("__lost", i - 1) + 1)
    high = lambda i: F.coalesce(F.get("__lost", i), F.size("__lines"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__lost")), lambda i: F.slice("__lines", low(i) + 1, high(i) - low(i))))
    return (
        parts.withColumn("n_lines", F.size("__lines").cast("bigint"))
        .withColumn("n_dropped", F.size("__lost").cast("bigint"))
        .withColumn("text", F.when(F.col("n_dropped") == 0, text).otherwise(F.array_join(kept, "\n")))
        .select(*docs.columns, "n_lines", "n_dropped")
    )

"""Audit of filters that run one after the other: what each one removes in every order.

Each filter stores the rows that fail it as a table of row ids. The audit never looks at a text
again: left-semi and left-anti joins with these tables split the rows of a part, level by level,
into those that fail and those that pass each filter. Rows of one part that fail the same filters
and carry the same labels behave alike under every order, so the last level is counted into
classes. The survivors, removals and redundancies of every prefix are then left-anti and left-semi
joins of the classes with the relations "fails a filter of the prefix" and "fails the filter".
A prefix removes the same rows in whatever order its filters ran: 80 pairs of prefix and filter
serve the 600 steps of five filters.

Only ids, parts and labels are shuffled, and counts are combined before they are. Equal texts are
found by their SHA-256; the smallest id of a text is a partial minimum, and the rows of a text meet
it under ``_SALTS`` keys, so a text that a third of all rows hold is many tasks.

Defined results: a null text is empty, a null part is the empty string, so both may merge with
real ones. A null ``doc_id`` is smaller than none and larger than none: it neither is a copy nor
makes one. Rows that repeat a ``doc_id`` are counted each and are no copies of one another. A
document with several label rows counts as good or toxic if one of them says so. Columns beyond
those named are ignored. Without documents there is no part, hence no row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.session import cut


_SALTS = 32  # shares of the rows of one text


@dataclass(frozen=True)
class FilterParams:
    min_words: int = 50
    distinct_percent: int = 65
    capital_percent: int = 5
    symbols: str = "[#$%&*|]"


def judged(docs: DataFrame, params: FilterParams = FilterParams(), part: str = "source") -> DataFrame:
    """(row, doc_id, part, a, b, c, d, key): one row per document, true where filter A to D fails, and the text's digest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    first = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        words.alias("words"), text.alias("body"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
    )
    n = F.size("words")
    capitals = F.length(F.regexp_replace("body", "[^A-Z]+", ""))
    rows = first.select(
        "doc_id", "part",
        (n < params.min_words).alias("a"),
        (100 * F.size(F.array_distinct("words")).cast("bigint") < params.distinct_percent * n).alias("b"),
        (100 * capitals.cast("bigint") > params.capital_percent * F.length("body")).alias("c"),
        F.col("body").rlike(params.symbols).alias("d"),
        "key",
    )
    return cut(rows).withColumn("row", F.monotonically_increasing_id())


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """One stored table of row ids for each of the filters A to E; ``rows`` as ``judged`` gives them."""
    first = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("key", "least")
    tables = {name.upper(): rows.filter(name).select("row") for name in "abcd"}
    first = first.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(_SALTS)])))
    tables["E"] = rows.select("row", "doc_id", "key", F.pmod("row", F.lit(_SALTS)).cast("int").alias("salt")).join(first, ["key", "salt"]).filter(F.col("doc_id") > F.col("least")).select("row")
    return {name: cut(ids) for name, ids in tables.items()}


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, part, good, toxic) of every row."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").filter(F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    out = rows.select("row", "part", "doc_id").join(known, "doc_id", "left")
    return out.select("row", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def classes(members: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """(part, failed, n, good, toxic): counts of the rows that fail the same filters; bit k of ``failed`` is the k-th filter."""
    level = cut(members.withColumn("failed", F.lit(0)))
    for k, ids in enumerate(failing.values()):
        fails = level.join(ids, "row", "left_semi").withColumn("failed", F.col("failed") + F.lit(1 << k))
        level = cut(fails.unionByName(level.join(ids, "row", "left_anti")))
    count = lambda c: F.sum(F.col(c).cast("bigint"))
    return cut(level.groupBy("part", "failed").agg(F.count("*").alias("n"), count("good").alias("good"), count("toxic").alias("toxic")))


def _steps(k: int) -> list[tuple[int, int]]:
    """(prefix, filter) for every set of filters that may run before a filter; sets are bit masks."""
    return [(sum(1 << i for i in before), f) for f in range(k) for size in range(k) for before in combinations([i for i in range(k) if i != f], size)]


def audit(members: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step.

    ``members`` holds (row, part, good, toxic) and ``failing`` a table of row ids per filter, named by
    one letter. With k filters a part has k * k! result rows, so this is for a handful of filters.
    """
    names, k = list(failing), len(failing)
    spark = members.sparkSession
    steps, every = _steps(k), range(1 << k)
    # relations between sets of filters: at most 4^k rows whatever the data, hence broadcast
    fails = F.broadcast(spark.createDataFrame([(f, c) for f in range(k) for c in every if c >> f & 1], "filter int, failed int"))
    gone = F.broadcast(spark.createDataFrame([(p, c) for p in sorted({p for p, _ in steps}) for c in every if c & p], "prefix int, failed int"))
    step = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(f).alias("filter")) for p, f in steps]))
    cells = classes(members, failing).withColumn("step", step).select("part", "failed", "n", "good", "toxic", "step.prefix", "step.filter")

    survivors = cells.join(gone, ["prefix", "failed"], "left_anti")
    removed = survivors.join(fails, ["filter", "failed"], "left_semi")
    redundant = cells.join(gone, ["prefix", "failed"], "left_semi").join(fails, ["filter", "failed"], "left_semi")
    key = ("part", "prefix", "filter")
    zero = F.lit(0).cast("bigint")
    none = {c: zero for c in ("before", "removed", "redundant", "good_lost", "toxic_lost")}

    def counted(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select(*key, *[(none | columns)[c].alias(c) for c in none])

    parts = [
        counted(cells), counted(survivors, before=F.col("n")), counted(redundant, redundant=F.col("n")),
        counted(removed, removed=F.col("n"), good_lost=F.col("good"), toxic_lost=F.col("toxic")),
    ]
    sums = cut(reduce(DataFrame.unionByName, parts).groupBy(*key).agg(*[F.sum(c).alias(c) for c in none]))

    others = [(1 << k) - 1 - (1 << f) for f in range(k)]
    alone = F.get(F.array(*[F.lit(p) for p in others]), F.col("filter")) == F.col("prefix")
    weight = F.get(F.array(*[F.lit(math.factorial(s) * math.factorial(k - 1 - s)) for s in range(k)]), F.bit_count("prefix"))  # orders that run just these filters before
    total = sums.groupBy("part", "filter").agg(F.sum(F.when(alone, F.col("removed")).otherwise(zero)).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"))
    orders = spark.createDataFrame(
        [("".join(names[i] for i in order), s + 1, sum(1 << i for i in order[:s]), f) for order in permutations(range(k)) for s, f in enumerate(order)],
        "filter_order string, step int, prefix int, filter int",
    )
    out = sums.join(total, ["part", "filter"]).join(F.broadcast(orders), ["prefix", "filter"])
    return out.select("part", "filter_order", "step", (F.col("before") - F.col("removed")).alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, params: FilterParams = FilterParams(), part: str = "source") -> DataFrame:
    """The audit of the five filters of ``FilterParams`` and of copies (E) over all documents."""
    rows = judged(docs, params, part)
    return audit(labelled(rows, labels), failing_ids(rows))

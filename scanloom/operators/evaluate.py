"""Scores of predicted labels against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.sensor import is_dynamic, object_class, semantic_id

POINT = ["session", "scan_id", "point_idx"]
# Object classes scored as vehicles, pedestrians and cyclists.
CLASS_GROUPS = {"vehicle": (1, 2, 3, 6), "pedestrian": (4,), "cyclist": (6,)}
STATIC_LABEL, DYNAMIC_LABEL = 9, 251
# Dataset class to evaluation class.
CLASS_MAP = {
    1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 2, 10: 2, 11: 2, 12: 2, 14: 3, 15: 4, 16: 4,
    17: 5, 18: 6, 19: 6, 20: 6, 21: 7, 22: 8, 23: 9, 31: 10,
}


def label_pred(labels: DataFrame, preds: DataFrame, keys: Sequence[str] = POINT) -> DataFrame:
    """Pair label and prediction of the same point; a point without prediction keeps NULL.

    ``keys`` must tell all points apart; :func:`numbered_copies` makes a key of ids that repeat.
    """
    return labels.join(preds, list(keys), "left")


def numbered_copies(df: DataFrame, keys: Sequence[str] = POINT, name: str = "copy") -> DataFrame:
    """Add ``name``, the number from 1 of a row among those with its id; equal rows are interchangeable."""
    rest = [c for c in df.columns if c not in keys]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*rest)))


def with_outcome(df: DataFrame) -> DataFrame:
    label, pred = semantic_id(F.col("label")), semantic_id(F.col("pred"))
    moving, hit, still = is_dynamic(label), is_dynamic(pred), pred == STATIC_LABEL
    outcome = (
        F.when(moving & hit, "tp").when(moving & still, "fn")
        .when((label < 251) & hit, "fp").when((label < 251) & still, "tn")
        .when((label >= 65535) & hit, "op")
    )
    return df.withColumn("outcome", outcome)


def confusion(df: DataFrame, totals: bool = True) -> DataFrame:
    """tp, fn, fp, op, tn, IoU and suppression rate per scan, per session and over all."""
    scored = with_outcome(df).select("session", "scan_id", "outcome")
    grouped = scored.rollup("session", "scan_id") if totals else scored.groupBy("session", "scan_id")
    counts = grouped.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fn", "fp", "op", "tn")])
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    seen = F.col("tp") + F.col("fn") + F.col("fp")
    everything = seen + F.col("tn")
    return counts.withColumns({
        "iou": F.when(seen > 0, F.col("tp") / seen),
        "suppress": F.when(everything > 0, (F.col("fn") + F.col("tn")) / everything),
    })


def confusion_matrix(df: DataFrame, classes: Sequence[int], ignore: Sequence[int] = ()) -> DataFrame:
    """Counts by (pred, label) as one row per prediction and one column per label."""
    return df.groupBy("pred").pivot("label", list(classes)).count().na.fill(0)


def class_iou(df: DataFrame, ignore: Sequence[int] = ()) -> DataFrame:
    """IoU per class; points whose label is ignored count neither way."""
    cells = df.filter(~F.col("label").isin(*ignore)) if ignore else df
    cells = cells.groupBy("pred", "label").agg(F.count("*").alias("n"))
    by_pred = cells.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("p"), F.sum(F.when(F.col("pred") == F.col("label"), F.col("n"))).alias("tp1"))
    by_label = cells.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("l"))
    joined = by_pred.join(by_label, "cls", "full_outer").na.fill(0, ["p", "l", "tp1"])
    return joined.select(
        "cls", F.col("tp1").alias("tp"), (F.col("p") - F.col("tp1")).alias("fp"), (F.col("l") - F.col("tp1")).alias("fn"),
        (F.col("tp1") / (F.col("p") + F.col("l") - F.col("tp1") + 1e-15)).alias("iou"),
    )


def accuracy(per_class: DataFrame, ignore: Sequence[int] = ()) -> DataFrame:
    included = ~F.col("cls").isin(*ignore) if ignore else F.lit(True)
    return per_class.agg(
        (F.sum("tp") / (F.sum(F.when(included, F.col("tp") + F.col("fp")).otherwise(0)) + 1e-15)).alias("acc"),
        F.avg(F.when(included, F.col("iou"))).alias("mean_iou"),
    )


def object_recall(df: DataFrame) -> DataFrame:
    """Recall per labelled object per scan."""
    scored = df.select(
        "session", "scan_id", semantic_id(F.col("label")).alias("object"), semantic_id(F.col("pred")).alias("_pred")
    ).filter(is_dynamic(F.col("object")))
    return (
        scored.groupBy("session", "scan_id", "object")
        .agg(F.count("*").alias("n"), F.count_if(is_dynamic(F.col("_pred"))).alias("hits"))
        .withColumns({"cls": object_class(F.col("object")), "recall": F.col("hits") / F.col("n")})
    )


def class_recall(per_object: DataFrame) -> DataFrame:
    """Objects, mean recall and population variance per class."""
    return per_object.groupBy("cls").agg(
        F.count("*").alias("objects"), F.avg("recall").alias("mean_recall"),
        (F.avg(F.col("recall") * F.col("recall")) - F.avg("recall") * F.avg("recall")).alias("var_recall"),
    )


def recall_octiles(per_object: DataFrame) -> DataFrame:
    """Order statistics at ⌊n/8⌋, ⌊n/2⌋ and ⌊7n/8⌋ (from 0) per class group.

    Equal recalls are merged with their count first, so the window that accumulates the
    counts sees distinct recall values only, not objects.
    """
    groups = F.array(*[
        F.when(F.col("cls").isin(*classes), F.lit(name)) for name, classes in CLASS_GROUPS.items()
    ])
    valued = (
        per_object.select("recall", F.explode(F.array_compact(groups)).alias("grp"))
        .groupBy("grp", "recall").agg(F.count("*").alias("c"))
    )
    w = Window.partitionBy("grp").orderBy("recall")
    total = valued.groupBy("grp").agg(F.sum("c").alias("n"))
    ranked = valued.withColumn("hi", F.sum("c").over(w)).withColumn("lo", F.col("hi") - F.col("c")).join(total, "grp")

    def at(position):
        return F.max(F.when((F.col("lo") <= position) & (position < F.col("hi")), F.col("recall")))

    n = F.col("n")
    return ranked.groupBy("grp").agg(
        F.max("n").alias("n"), at(F.floor(n / 8)).alias("q1"), at(F.floor(n / 2)).alias("q2"), at(F.floor(n * 7 / 8)).alias("q3")
    )


def dynamic_count(labels: DataFrame) -> DataFrame:
    """Dynamic points per scan; here the class must exceed 251 and stay below 260."""
    cls = semantic_id(F.col("label"))
    return labels.groupBy("session", "scan_id").agg(F.count_if((cls > 251) & (cls < 260)).alias("dynamic"))


def semantic_gate(df: DataFrame, semantic: str, limit: int = 40) -> DataFrame:
    """Keep a dynamic prediction only when the semantic class allows motion."""
    keep = is_dynamic(F.col("pred")) & (semantic_id(F.col(semantic)) < limit)
    return df.withColumn("gated", F.when(keep, F.lit(DYNAMIC_LABEL)).otherwise(F.lit(STATIC_LABEL)))


def class_remap(df: DataFrame, column: str = "cls") -> DataFrame:
    """Dataset class to evaluation class; a class without a counterpart is dropped."""
    pairs = [F.lit(v) for pair in CLASS_MAP.items() for v in pair]
    return df.withColumn("mapped", F.element_at(F.create_map(*pairs), F.col(column).cast("int"))).filter(F.col("mapped").isNotNull())

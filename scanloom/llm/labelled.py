"""Held-out rows and bounded samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_class(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: str, modulus: int, rest: int) -> Column:
    """True for the rows that training never sees; a null id is neither held out nor trained on."""
    return F.coalesce(crc_class(doc_id, modulus) == rest, F.lit(False))


def training_docs(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int = 5, rest: int = 0) -> DataFrame:
    """(doc_id, text, label, weight): at most ``per_class`` labelled documents of each class.

    The sample is that of the smallest hashes of the id, so it is the same in every run. It is
    small by its parameter, which is why it may be broadcast to the scan of the documents.
    ``weight`` restores the classes' shares among all labelled rows.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (crc_class(F.col("id"), modulus) != rest))
        .groupBy("id").agg(F.min("label").alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    parts = [
        known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        .withColumn("weight", F.lit(sizes.get(y, 0) / total / max(1, min(per_class, sizes.get(y, 0))) if total else 0.0))
        for y in (0, 1)
    ]
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.join(sample, texts.doc_id == sample.id).select("doc_id", "text", "label", "weight")

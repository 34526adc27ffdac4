"""Quality rules: base counts per document and the frequency of lines across the documents of a host.

One pass over the texts (NumPy over Arrow batches) gives the counts and, per document, the hashes
of its normalised lines. Lines held by more than ``max_docs`` different documents of a host are
boilerplate; a document whose other lines hold less than ``min_left`` percent of its words is
depleted and rejected. In the report texts never pass a shuffle: only (host, hash, document) rows
do, and the counts are combined before they are shuffled. ``clean_documents`` measures once and
joins its verdicts to the texts.

Defined results: a null text has no words and fails the base rule; a null host is a host of its
own; rows that repeat a ``doc_id`` are one document of the host and keep one result row each, as do
rows without ``doc_id``, which all are one document of their host. Verdicts are per row: of rows
with the same id, only those that pass are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textblock as tb
from scanloom.session import cut


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50  # words in repeated 3-word windows
    max_docs: int = 10  # documents of a host that may share a line
    min_left: int = 30  # percent of the words outside shared lines


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_START = np.ones(256, bool)  # bytes that begin a code point
_START[128:192] = False
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _own(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return tb.mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _repeated(h: np.ndarray) -> np.ndarray:
    """True where the value occurs more than once."""
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def line_spans(texts: tb.Texts, words: tb.Words) -> tuple[tb.Words, np.ndarray, np.ndarray]:
    """Lines with a word, and the index range of their words."""
    lines = tb.words_of(texts, _NEWLINE)
    a, b = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
    full = b > a
    text = lines.text[full]
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    return tb.Words(lines.start[full], lines.end[full], text, first), a[full], b[full]


def measure(texts: tb.Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text, then per distinct normalised line: text, hash, words in all its copies."""
    words = tb.words_of(texts)
    h = tb.hash_spans(texts.data, words.start, words.end)
    grams, at = tb.ngrams(h, words.text, 3)
    at = at[_repeated(_own(grams, words.text[at]))]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at + k] = True
    lines, a, b = line_spans(texts, words)
    raw = _own(tb.hash_spans(texts.data, lines.start, lines.end), lines.text)
    _, first = np.unique(raw, return_index=True)
    again = np.ones(len(raw), bool)
    again[first] = False
    counts = {
        "n_words": np.diff(words.first),
        "word_chars": _per_text(_START[texts.data] & ~tb.BLANK[texts.data], texts.offsets),
        "n_symbols": _per_text(_SYMBOL[texts.data], texts.offsets),
        "n_dup_lines": _per_text(again, lines.first),
        "n_repeat_words": _per_text(covered, words.first),
    }
    key = tb.hash_spans(tb.lower_ascii()[texts.data], words.start[a], words.end[b - 1]) if len(a) else np.zeros(0, np.uint64)
    _, first, which = np.unique(_own(key, lines.text), return_index=True, return_inverse=True)
    held = np.bincount(which, weights=b - a, minlength=len(first)).astype(np.int64)
    order = np.argsort(first)
    return counts, lines.text[first[order]], key[first[order]], held[order]


def _measured(batches: Iterator[pa.RecordBatch], carry: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, texts in tb.slices(tb.texts_of(batch.column("text"))):
            counts, text, key, held = measure(texts)
            bounds = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).slice(i, len(texts)) for c in ("doc_id", "host", *carry)],
                    *[pa.array(counts[c].astype(np.int64)) for c in _COUNTS],
                    pa.ListArray.from_arrays(bounds, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(held)),
                ],
                ["doc_id", "host", *carry, *_COUNTS, "line_hash", "line_words"],
            )


def measured(docs: DataFrame, host: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and line hashes of every document, with the text columns ``carry``."""
    slim = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), *carry, "text")
    more, kinds = "".join(f", {c} string" for c in carry), ", ".join(f"{c} bigint" for c in _COUNTS)
    return slim.mapInArrow(lambda batches: _measured(batches, carry), f"doc_id bigint, host string{more}, {kinds}, line_hash array<bigint>, line_words array<bigint>")


def frequent_lines(lines: DataFrame, params: QualityParams) -> DataFrame:
    """(host, line_hash) of lines that more than ``max_docs`` documents of the host hold."""
    held = lines.select("host", "line_hash", "doc_id").distinct()
    return held.groupBy("host", "line_hash").count().filter(F.col("count") > params.max_docs).select("host", "line_hash")


def _judged(rows: DataFrame, params: QualityParams) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``base_failed``, ``shared_words`` and ``kept``; and the (row, line_hash) of shared lines."""
    lines = rows.select("row", "doc_id", "host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).select("row", "doc_id", "host", "l.line_hash", "l.line_words")
    held = lines.select("row", "host", "line_hash", "line_words").join(frequent_lines(lines, params), ["host", "line_hash"])
    shared = held.groupBy("row").agg(F.sum("line_words").alias("shared_words"))
    out = rows.drop("line_hash", "line_words").join(shared, "row", "left").withColumn("shared_words", F.coalesce("shared_words", F.lit(0)))
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("shared_words")) >= params.min_left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left), held.select("row", "line_hash")


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams(), host: str = "source") -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``shared_words`` and ``kept`` of every row."""
    rows = cut(measured(docs, host)).withColumn("row", F.monotonically_increasing_id())
    return _judged(rows, params)[0].select("doc_id", *_COUNTS, "base_failed", "shared_words", "kept")


def clean_documents(docs: DataFrame, params: QualityParams = QualityParams(), host: str = "source") -> DataFrame:
    """Kept documents without the lines that their host repeats; all columns of ``docs``.

    Rows are told apart by id, host and digest of the text; rows equal in these have one verdict.
    """
    named = lambda df: df.withColumn("digest", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = cut(measured(named(docs.select("doc_id", host, "text")), host, ("digest",))).withColumn("row", F.monotonically_increasing_id())
    judged, shared = _judged(rows, params)
    gone = shared.groupBy("row").agg(F.collect_set("line_hash").alias("__shared"))  # lines of one document
    key = {"doc_id": "__doc", "host": "__host", "digest": "__digest"}
    kept = judged.filter("kept").join(gone, "row", "left").select(*[F.col(a).alias(b) for a, b in key.items()], "__shared").dropDuplicates(list(key.values()))
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__doc")) & (F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col("__host")) & (text == F.col("__digest"))
    joined = docs.join(kept, same)
    fields = docs.schema

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drop = tb.texts_of(batch.column("text")), batch.column("__shared").to_pylist()
            out = []
            for i, old in enumerate(batch.column("text").to_pylist()):
                if drop[i]:
                    one = tb.Texts(texts.data[texts.offsets[i] : texts.offsets[i + 1]], np.array([0, texts.offsets[i + 1] - texts.offsets[i]]))
                    words = tb.words_of(one)
                    lines, a, b = line_spans(one, words)
                    key = tb.hash_spans(tb.lower_ascii()[one.data], words.start[a], words.end[b - 1]).view(np.int64)
                    gone = {int(s) for s in lines.start[np.isin(key, np.array(drop[i], np.int64))]}
                    at, left = 0, []
                    for line in one.data.tobytes().split(b"\n"):
                        if at not in gone:
                            left.append(line)
                        at += len(line) + 1
                    old = b"\n".join(left).decode()
                out.append(old)
            columns = [pa.array(out, pa.string()) if f.name == "text" else batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return joined.mapInArrow(strip, fields)

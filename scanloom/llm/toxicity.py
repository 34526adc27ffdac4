"""Toxic passages by maximum-scoring segment search.

Training counts units (words and their prefixes) per class over the different lines of a bounded
sample of labelled documents; copies of a line count once. A unit's score is its log-odds under an
informative Dirichlet prior; units that are not significantly toxic have the same small negative
score. A linear scan over a document finds all disjoint maximal segments. Scores of segments
follow an extreme-value law: with the decay ``rate``, the root of E[exp(rate * score)] = 1 over
clean text, a segment of score s among n words is expected n * exp(-rate * s) times by chance. The
evidence of all significant segments is summed up and mapped to a probability, which is fitted on
the half of the sample that the units were not learnt from.

Defined results: null and empty texts have no segment and the lowest score; without labels of both
classes every score is 0; repeated rows are scored each; an empty table gives no rows. Of segments
with the same score the first is the strongest; a segment that could be extended without gain is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textblock as tb
from scanloom.llm.labelled import held_out, training_docs
from scanloom.session import cut


@dataclass(frozen=True)
class ToxicityParams:
    per_class: int = 8000  # labelled documents of a class that are learnt from
    prefixes: tuple[int, ...] = (4, 5, 6)  # bytes
    prior: float = 0.03  # mass of the Dirichlet prior, as a share of all counts
    min_z: float = 2.5  # significance of a toxic unit
    min_odds: float = 1.5  # its least log-odds
    other: float = -0.4  # score of a word that is no toxic unit
    top: float = 8.0  # largest score of a word
    max_expected: float = 1.0  # chance segments per document below which a segment is significant


_BREAKS = np.ones(256, bool)
_BREAKS[128:] = False
_BREAKS[ord("0") : ord("9") + 1] = False
_BREAKS[ord("a") : ord("z") + 1] = False


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, tb.Texts]]:
    yield from tb.lowered(batch.column("text"))


def _units(texts: tb.Texts, words: tb.Words, prefixes: tuple[int, ...]) -> np.ndarray:
    """(1 + prefixes, words) hashes: the word, and its prefix of each length where it is longer."""
    whole = tb.hash_spans(texts.data, words.start, words.end)
    out = [whole]
    for k in prefixes:
        cut_at = np.minimum(words.end, words.start + k)
        part = tb.hash_spans(texts.data, words.start, cut_at) + np.uint64(k)
        out.append(np.where(words.end > cut_at, part, whole))
    return np.stack(out)


@dataclass(frozen=True)
class ToxicityModel:
    units: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0
    weight: float = 0.0  # of the evidence
    bias: float = -30.0

    def word_scores(self, hashes: np.ndarray, params: ToxicityParams) -> np.ndarray:
        out = np.full(hashes.shape[1], params.other)
        if len(self.units):
            for row in hashes:
                place = np.minimum(np.searchsorted(self.units, row), len(self.units) - 1)
                hit = self.units[place] == row
                out[hit] = np.maximum(out[hit], self.scores[place[hit]])
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, in linear time.

    The stack holds disjoint candidates with the totals before and after them. A new positive item
    joins every candidate from the last one with a smaller total before, if the total has risen
    since the end of that candidate.
    """
    stack: list[tuple[int, int, float, float]] = []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    for i in np.flatnonzero(scores > 0).tolist():
        first, end, low, high = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, end, low, high))
    return [(a, b, float(high - low)) for a, b, low, high in stack]


def _scan(texts: tb.Texts, model: ToxicityModel, params: ToxicityParams) -> Iterator[tuple[int, int, list[tuple[int, int, float, float]]]]:
    """(text, words, significant segments with their evidence) of the texts with a toxic word."""
    words = tb.words_of(texts, _BREAKS)
    scores = model.word_scores(_units(texts, words, params.prefixes), params)
    for d in np.unique(words.text[scores > 0]):
        own = scores[words.first[d] : words.first[d + 1]]
        found = []
        for a, b, s in segments(own):
            evidence = model.rate * s - np.log(len(own))  # minus the log of the expected number
            if evidence >= -np.log(params.max_expected):
                found.append((a, b, s, float(evidence)))
        yield int(d), len(own), found


def evidence_of(found: list[tuple[int, int, float, float]]) -> float:
    """Evidence of a document: that of its segments together."""
    return float(sum(e for *_, e in found))


def _unit_counts(sample: DataFrame, params: ToxicityParams) -> DataFrame:
    """(unit, toxic, clean): different lines of each class that hold a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newline = np.zeros(256, bool)
        newline[10] = True
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for i, texts in _texts(batch):
                words, lines = tb.words_of(texts, _BREAKS), tb.words_of(texts, newline)
                if not len(words.start):
                    continue
                hashes = _units(texts, words, params.prefixes)
                line = np.searchsorted(lines.start, words.start, "right") - 1
                first = np.searchsorted(line, np.arange(len(lines.start) + 1)).astype(np.int32)
                flat = pa.array(hashes.T.reshape(-1).view(np.int64))
                bounds = pa.array((first * len(hashes)).astype(np.int32))
                name = tb.hash_spans(texts.data, lines.start, lines.end).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(label[lines.text + i].astype(np.int32)), pa.ListArray.from_arrays(bounds, flat)], ["line", "label", "units"])

    lines = sample.select("text", "label").mapInArrow(run, "line bigint, label int, units array<bigint>").dropDuplicates(["line", "label"])
    held = lines.select("label", F.explode(F.array_distinct("units")).alias("unit"))
    return held.groupBy("unit").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def log_odds(counts: DataFrame, params: ToxicityParams) -> DataFrame:
    """(unit, score, z): log-odds under the Dirichlet prior, and its z value."""
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    t, c = total["t"] or 0, total["c"] or 0
    mass = params.prior * (t + c)
    prior = params.prior * (F.col("toxic") + F.col("clean"))
    rows = counts.withColumn("a", F.col("toxic") + prior).withColumn("b", F.col("clean") + prior)
    score = F.log(F.col("a") / (t + mass - F.col("a"))) - F.log(F.col("b") / (c + mass - F.col("b")))
    return rows.withColumn("score", score).withColumn("z", F.col("score") / F.sqrt(1 / F.col("a") + 1 / F.col("b"))).select("unit", "score", "z")


def decay_rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(rate * values)) = 1; the mean must be negative."""
    low, high = 1e-6, 1.0
    while (shares * np.exp(high * values)).sum() < 1 and high < 100:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (shares * np.exp(mid * values)).sum() < 1 else (low, mid)
    return (low + high) / 2


def _clean_scores(sample: DataFrame, model: ToxicityModel, params: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Scores of words in clean documents and their shares, with one word more for each toxic score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _texts(batch):
                words = tb.words_of(texts, _BREAKS)
                value, n = np.unique(np.round(model.word_scores(_units(texts, words, params.prefixes), params), 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], ["value", "n"])

    rows = sample.filter("label = 0").select("text").mapInArrow(run, "value double, n bigint").groupBy("value").agg(F.sum("n").alias("n")).collect()
    seen = {r.value: r.n for r in rows}
    for s in np.unique(np.round(model.scores, 1)):
        seen[float(s)] = seen.get(float(s), 0) + 1
    value, n = np.array(list(seen)), np.array(list(seen.values()), float)
    return value, n / n.sum()


def learn(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), label: str = "toxic") -> ToxicityModel:
    """Units and law from one half of the sample, the final probability from the other half."""
    sample = cut(training_docs(docs, labels, label, params.per_class))
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0
    counts = cut(_unit_counts(sample.filter(half), params))
    # every significant unit of the bounded sample
    best = log_odds(counts, params).filter((F.col("z") >= params.min_z) & (F.col("score") >= params.min_odds)).select("unit", "score").toArrow()
    if not best.num_rows:
        return ToxicityModel()
    units = np.asarray(best.column("unit")).astype(np.int64).view(np.uint64)
    order = np.argsort(units)
    model = ToxicityModel(units[order], np.minimum(np.asarray(best.column("score"))[order], params.top))
    model = ToxicityModel(model.units, model.scores, decay_rate(*_clean_scores(sample.filter(half), model, params)))
    rows = sample.filter(~half).select("doc_id", "text", "label", "weight")
    seen = evidence(rows, model, params, ("label", "weight")).select("evidence", "label", "weight").toPandas()
    weight, bias = _logistic(seen["evidence"].to_numpy(), seen["label"].to_numpy(), seen["weight"].to_numpy())
    return ToxicityModel(model.units, model.scores, model.rate, weight, bias)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Weighted logistic regression on log(1 + evidence), by Newton steps with a ridge."""
    if not len(x) or y.min() == y.max():
        return 1.0, -3.0
    z = np.stack([np.log1p(x), np.ones(len(x))], axis=1)
    w = w / w.sum()
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (p - y)) + ridge * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def evidence(docs: DataFrame, model: ToxicityModel, params: ToxicityParams, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, evidence, n_segments and the strongest segment (start_word, end_word) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col("doc_id").cast("bigint"), *carry, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _texts(batch):
                n = len(texts)
                out = {"evidence": np.zeros(n), "n_segments": np.zeros(n, np.int64), "start_word": np.full(n, -1), "end_word": np.full(n, -1)}
                for d, _, found in _scan(texts, shared.value, params):
                    out["evidence"][d], out["n_segments"][d] = evidence_of(found), len(found)
                    if found:
                        a, b, *_ = max(found, key=lambda f: (f[2], -f[0]))
                        out["start_word"][d], out["end_word"][d] = a, b
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, n) for c in ("doc_id", *carry)] + [pa.array(v) for v in out.values()], ["doc_id", *carry, *out])

    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in carry)
    return kept.mapInArrow(run, f"doc_id bigint{extra}, evidence double, n_segments bigint, start_word bigint, end_word bigint")


def passages(docs: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Every significant toxic passage: doc_id, start_word, end_word, segment_score, evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _texts(batch):
                rows = [(d, *f) for d, _, found in _scan(texts, shared.value, params) for f in found]
                if rows:
                    d, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.array(d) + i)), *map(pa.array, rest)], ["doc_id", "start_word", "end_word", "segment_score", "evidence"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, start_word bigint, end_word bigint, segment_score double, evidence double")


def score(docs: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted and the segments' figures of every row."""
    p = 1 / (1 + F.exp(-(F.lit(model.weight) * F.log1p("evidence") + F.lit(model.bias))))
    out = evidence(docs, model, params).withColumn("score", p)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", "start_word", "end_word")

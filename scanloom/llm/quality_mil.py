"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded as a vector: figures of its characters,
words and repetitions, and a hashed bag of its words. Gated attention weighs the passages, the
document is the weighted sum of its vectors, and a logistic layer scores it. Encoder statistics,
attention and score are learnt from document labels alone, on all passages of a bounded sample of
documents, by full-batch Adam on the driver; all documents are scored on the executors.

Defined results: null and empty texts are one passage without words; without labels of both
classes the score is the share of label 1 (0.5 without any label); repeated rows are scored each;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textblock as tb
from scanloom.llm.labelled import held_out, training_docs


@dataclass(frozen=True)
class MilParams:
    per_class: int = 2500  # labelled documents of a class that are learnt from
    passage_words: int = 64
    word_dims: int = 16  # of the hashed bag of words
    hidden: int = 12  # of the attention
    steps: int = 400
    rate: float = 0.03
    decay: float = 1e-4
    seed: int = 11
    threshold: float = 0.3


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_CLASSES = (_UPPER, _DIGIT, _table("#*$%&<>"), _table("|"), _table("!?"), _table(".,;:"), _table("\n"), _table("@/\\_=+~^{}[]\"'`()-"), np.arange(256) >= 128)
_END = _table(".!?")


def encode(texts: tb.Texts, params: MilParams) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors (float32) and the text of each passage; every text has a passage."""
    words = tb.words_of(texts)
    size = np.diff(words.first)
    n_pass = np.maximum(1, size // params.passage_words)  # the last passage takes the rest
    owner = np.repeat(np.arange(len(texts)), n_pass)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)
    first = words.first[owner] + place * params.passage_words
    last = np.append(first[1:], len(words.start))
    last = np.minimum(last, words.first[owner + 1])
    n = (last - first).astype(np.float64)
    out = np.zeros((len(owner), 12 + len(_CLASSES) + params.word_dims))
    full = np.flatnonzero(n)
    if len(full):
        h = tb.hash_spans(texts.data, words.start, words.end)
        start, width, w = first[full], (words.end - words.start).astype(np.float64), n[full]
        passage = np.repeat(np.arange(len(full)), (last - first)[full])  # of each word: they are consecutive
        low = words.start[start]
        high = np.append(low[1:], len(texts.data))
        high = np.minimum(high, texts.offsets[owner[full] + 1])
        chars = np.maximum(1, high - low).astype(np.float64)
        mean = np.add.reduceat(width, start) / w
        features = [np.log1p(w), mean, np.sqrt(np.maximum(0, np.add.reduceat(width**2, start) / w - mean**2)), np.log1p(np.maximum.reduceat(width, start))]
        total = np.zeros(len(texts.data) + 1, np.int64)
        for members in _CLASSES:
            np.cumsum(members[texts.data], out=total[1:])
            features.append((total[high] - total[low]) / chars)
        head, tail = texts.data[words.start], texts.data[words.end - 1]
        features.append(np.add.reduceat(_UPPER[head].astype(float), start) / w)
        features.append(np.add.reduceat(_END[tail].astype(float), start) / w)
        features.append(np.add.reduceat((width <= 2).astype(float), start) / w)
        own = tb.mix(h + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own)
        again = np.zeros(len(own))
        again[order[1:]] = own[order[1:]] == own[order[:-1]]
        features.append(np.add.reduceat(again, start) / w)  # words seen before in the passage
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
        features.append(np.add.reduceat(same, start) / w)
        grams, at = tb.ngrams(h, words.text, 3)
        gram_own = tb.mix(grams + words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(gram_own)
        twice = np.zeros(len(h))
        twice[at[order[1:]]] = gram_own[order[1:]] == gram_own[order[:-1]]
        features.append(np.add.reduceat(twice, start) / w)  # triples seen before in the text
        symbol = np.concatenate([[0], np.cumsum(_CLASSES[2][texts.data] | _CLASSES[3][texts.data])])
        features.append(np.add.reduceat((symbol[words.end] - symbol[words.start] == words.end - words.start).astype(float), start) / w)
        features.append(np.add.reduceat((tail == ord("!")).astype(float), start) / w)
        for k, f in enumerate(features):
            out[full, k] = f
        base = out.shape[1] - params.word_dims
        for k in range(params.word_dims):
            sign = ((h >> np.uint64(k)) & np.uint64(1)).astype(float) * 2 - 1
            out[full, base + k] = np.add.reduceat(sign, start) / w
    return out.astype(np.float32), owner


@dataclass
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float

    def score(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each bag; ``owner`` counts up from 0 without gaps."""
        if not self.weights:
            return np.full(int(owner[-1]) + 1 if len(owner) else 0, self.prior)
        return _forward(np.clip((x - self.mean) / self.scale, -8, 8), np.flatnonzero(np.diff(owner, prepend=-1)), owner, self.weights)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, first: np.ndarray, owner: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    t, g = np.tanh(x @ w["v"] + w["vb"]), _sigmoid(x @ w["u"] + w["ub"])
    e = (t * g) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[owner])
    a = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(x * a[:, None], first, axis=0)
    return {"t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["b"][0])}


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray, params: MilParams) -> MilModel:
    """Train on bags: ``owner`` is the bag of each passage, ``y`` and ``weight`` are per bag."""
    prior = float((y * weight).sum() / weight.sum()) if len(y) else 0.5
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    if not len(y) or y.min() == y.max():
        return MilModel(mean, scale, {}, prior)
    x = np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    rng, d, m = np.random.default_rng(params.seed), x.shape[1], params.hidden
    w = {
        "v": rng.normal(0, d**-0.5, (d, m)), "vb": np.zeros(m), "u": rng.normal(0, d**-0.5, (d, m)), "ub": np.zeros(m),
        "a": rng.normal(0, m**-0.5, m), "c": np.zeros(d), "b": np.array([np.log(prior / (1 - prior))]),
    }
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    weight = weight / weight.sum()
    for step in range(1, params.steps + 1):
        f = _forward(x, first, owner, w)
        dl = weight * (f["p"] - y)
        grad = {"c": f["z"].T @ dl, "b": np.array([dl.sum()])}
        da = (x @ w["c"]) * dl[owner]
        de = f["a"] * (da - np.add.reduceat(da * f["a"], first)[owner])
        grad["a"] = (f["t"] * f["g"]).T @ de
        inner = de[:, None] * w["a"]
        dt, dg = inner * f["g"] * (1 - f["t"] ** 2), inner * f["t"] * f["g"] * (1 - f["g"])
        grad |= {"v": x.T @ dt, "vb": dt.sum(axis=0), "u": x.T @ dg, "ub": dg.sum(axis=0)}
        for k, g in grad.items():
            g = g + params.decay * w[k]
            one, two = moment[k]
            one += 0.1 * (g - one)
            two += 0.001 * (g * g - two)
            w[k] -= params.rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return MilModel(mean, scale, w, prior)


def learn(docs: DataFrame, labels: DataFrame, params: MilParams = MilParams(), label: str = "quality") -> MilModel:
    """Encode the sample's passages on the executors and train on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in tb.slices(tb.texts_of(batch.column("text"))):
                x, owner = encode(texts, params)
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                for d in range(len(texts)):
                    own = x[bounds[d] : bounds[d + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(i + d, 1), batch.column("label").slice(i + d, 1), batch.column("weight").slice(i + d, 1), pa.array([own.reshape(-1)])],
                        ["doc_id", "label", "weight", "x"],
                    )

    sample = training_docs(docs, labels, label, params.per_class)
    rows = sample.mapInArrow(run, "doc_id bigint, label int, weight double, x array<float>").toArrow().sort_by("doc_id")
    dims = encode(tb.texts_of(pa.array([""])), params)[0].shape[1]
    x = rows.column("x").combine_chunks()
    flat = (x.flatten().to_numpy() if len(x) else np.zeros(0, np.float32)).reshape(-1, dims)
    owner = np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()) // dims) if len(x) else np.zeros(0, np.int64)
    return fit(flat, owner, rows.column("label").to_numpy(), rows.column("weight").to_numpy(), params)


def score(docs: DataFrame, model: MilModel, params: MilParams = MilParams()) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of passages of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in tb.slices(tb.texts_of(batch.column("text"))):
                x, owner = encode(texts, params)
                p = shared.value.score(x, owner)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(texts)), pa.array(p.astype(np.float64)), pa.array(np.bincount(owner, minlength=len(texts)))], ["doc_id", "score", "n_passages"])

    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double, n_passages bigint")
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"), "n_passages")

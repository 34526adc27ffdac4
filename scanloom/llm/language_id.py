"""Language identification as mixture inference.

Every language has a distribution over hashed letter trigrams, counted over all training
documents. A word's likelihood under a language is that of its trigrams. A document is a mixture
of languages whose shares are found by expectation-maximisation over its words; which languages
take part is decided by penalised likelihood: a language more has to pay
``penalty * log(words)``. The answer is the language with the largest share.

Any number of languages is possible; the model holds 2^``bucket_bits`` floats for each. The
likelihoods of a slice's words are a matrix of at most ``cells`` numbers: slices are smaller where
there are many languages, and the words of a longer text are read in blocks, whose part of the
matrix is computed anew in every round.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and when there is
nothing to learn from; a null ``doc_id`` is never trained on; ties go to the first name; repeated
rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textblock as tb
from scanloom.llm.labelled import crc_class, held_out


@dataclass(frozen=True)
class LanguageParams:
    bucket_bits: int = 16
    smoothing: float = 0.5
    rounds: int = 25  # of expectation-maximisation
    penalty: float = 3.0
    least_share: float = 0.02  # a language below this share is no candidate for the set
    cells: int = 1 << 22  # of a matrix of words and languages
    modulus: int = 4
    rest: int = 2
    keep_share: float = 0.5  # of its main language, below which a document is rejected


_BREAKS = np.ones(256, bool)
_BREAKS[128:] = False
_BREAKS[ord("a") : ord("z") + 1] = False


def _letters(texts: tb.Texts, bits: int) -> tuple[tb.Words, np.ndarray, np.ndarray]:
    """Words, the trigram bucket of each of their bytes, and where each word's buckets begin."""
    words = tb.words_of(texts, _BREAKS)
    if not len(words.start):
        return words, np.zeros(0, np.int64), words.start
    plain = np.where(_BREAKS[texts.data], np.uint8(32), texts.data).astype(np.uint32)
    size = words.end - words.start
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(words.start - begin, size)
    before, after = plain[np.maximum(at - 1, 0)], plain[np.minimum(at + 1, len(plain) - 1)]
    before[begin] = 32
    after[begin + size - 1] = 32
    code = (before << np.uint32(16)) | (plain[at] << np.uint32(8)) | after
    return words, ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64), begin


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, tb.Texts]]:
    yield from tb.lowered(batch.column("text"))


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    logp: np.ndarray  # (languages, buckets), float32


def learn(docs: DataFrame, params: LanguageParams = LanguageParams(), lang: str = "lang") -> LanguageModel:
    """Trigram counts of all training documents: text and non-null language outside the held-out class."""
    slots = 1 << params.bucket_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            tags = np.array(batch.column("lang").to_pylist(), object)
            for i, texts in _texts(batch):
                words, bucket, begin = _letters(texts, params.bucket_bits)
                own = np.repeat(words.text, words.end - words.start)
                for tag in set(tags[i : i + len(texts)]):
                    of = (tags[i : i + len(texts)] == tag)[own]
                    total[tag] = total.get(tag, 0) + np.bincount(bucket[of], minlength=slots)
                if len(total) > 64:  # what was counted goes out, so that memory does not grow with the languages
                    yield from flush(total)
                    total = {}
        yield from flush(total)

    def flush(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for tag, counts in total.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(full), pa.string()), pa.array(full), pa.array(counts[full].astype(np.int64))], ["lang", "bucket", "n"])

    train = docs.filter((crc_class("doc_id", params.modulus) != params.rest) & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), "text")
    counts = train.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((len(names), slots), params.smoothing)
    place = {name: k for k, name in enumerate(names)}
    np.add.at(table, (np.array([place[x] for x in counts.column("lang").to_pylist()], np.int64), counts.column("bucket").to_numpy()), counts.column("n").to_numpy())
    for row in table:  # in place: the table may be large
        row[:] = np.log(row / row.sum())
    return LanguageModel(tuple(names), table.astype(np.float32))


def mixture(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x languages) and log likelihoods by expectation-maximisation.

    ``like`` holds the likelihoods of the words, those of document d from ``first[d]`` on; every
    document has a word.
    """
    size = np.diff(np.append(first, len(like)))
    own = np.repeat(np.arange(len(first)), size)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    docs, rows, at, words = np.arange(len(first)), like, own, first
    for _ in range(rounds):
        now = share[docs]
        part = rows * now[at]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        new = np.add.reduceat(part, words, axis=0) / size[docs, None]
        share[docs] = new
        moving = np.abs(new - now).max(axis=1) >= 1e-4
        if not moving.any():
            break
        if moving.mean() < 0.7:  # settled documents leave the loop
            rows, docs = rows[moving[at]], docs[moving]
            at, words = np.repeat(np.arange(len(docs)), size[docs]), np.cumsum(size[docs]) - size[docs]
    total = np.log(np.maximum((like * share[own]).sum(axis=1), 1e-300))
    return share, np.add.reduceat(total, first)


def infer(like: np.ndarray, first: np.ndarray, params: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the selected language set of each document, and the number of its languages."""
    n, kinds = len(first), like.shape[1]
    shares, _ = mixture(like, first, np.ones((n, kinds)), params.rounds)
    rank = np.argsort(-shares, axis=1, kind="stable")
    ordered = np.take_along_axis(shares, rank, axis=1)
    wide = np.maximum(1, (ordered >= params.least_share).sum(axis=1))
    size = np.diff(np.append(first, len(like)))
    own = np.repeat(np.arange(n), size)
    best = np.zeros((n, kinds))
    np.put_along_axis(best, rank[:, :1], 1.0, axis=1)
    score = np.add.reduceat(np.log(np.maximum(like[np.arange(len(like)), rank[own, 0]], 1e-300)), first)
    count = np.ones(n, np.int64)
    for k in range(2, kinds + 1):
        docs = np.flatnonzero(wide >= k)
        if not len(docs):
            break
        rows = np.flatnonzero(np.isin(own, docs))
        start = np.cumsum(size[docs]) - size[docs]
        allowed = np.zeros((len(docs), kinds))
        np.put_along_axis(allowed, rank[docs, :k], 1.0, axis=1)
        share, like_k = mixture(like[rows], start, allowed, params.rounds)
        like_k -= params.penalty * (k - 1) * np.log(size[docs] + 1)
        better = like_k > score[docs]
        hit = docs[better]
        best[hit], score[hit], count[hit] = share[better], like_k[better], k
    return best, count


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _likelihoods(model: LanguageModel, bucket: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Words x languages, relative to the best language of each word."""
    like = np.stack([np.add.reduceat(row[bucket], begin) for row in model.logp], axis=1).astype(np.float64)
    return np.exp(like - like.max(axis=1, keepdims=True))


def infer_long(model: LanguageModel, bucket: np.ndarray, begin: np.ndarray, params: LanguageParams) -> tuple[np.ndarray, int]:
    """``infer`` for one document whose matrix would have more than ``cells`` numbers: its words in blocks."""
    kinds, n = len(model.names), len(begin)
    step = max(1, params.cells // kinds)

    def blocks() -> Iterator[np.ndarray]:
        for i in range(0, n, step):
            first, last = begin[i], begin[i + step] if i + step < n else len(bucket)
            yield _likelihoods(model, bucket[first:last], begin[i : i + step] - first)

    def settle(share: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(params.rounds):
            new = np.zeros(kinds)
            for like in blocks():
                part = like * share
                new += (part / np.maximum(part.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
            new /= n
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-4:
                break
        return share, sum(float(np.log(np.maximum(like @ share, 1e-300)).sum()) for like in blocks())

    full, _ = settle(np.full(kinds, 1 / kinds))
    rank = np.argsort(-full, kind="stable")
    best, score, count = None, -np.inf, 0
    for k in range(1, max(1, int((full >= params.least_share).sum())) + 1):
        allowed = np.zeros(kinds)
        allowed[rank[:k]] = 1 / k
        share, total = settle(allowed)
        total -= params.penalty * (k - 1) * np.log(n + 1)
        if total > score:
            best, score, count = share, total, k
    return best, count


def predict_texts(texts: tb.Texts, model: LanguageModel, params: LanguageParams) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, share and number of languages of lower-cased texts."""
    names, score, kinds = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    words, bucket, begin = _letters(texts, params.bucket_bits)
    if not len(begin) or not model.names:
        return names, score, kinds
    full = np.flatnonzero(np.diff(words.first))
    shares, count = np.zeros((len(full), len(model.names))), np.zeros(len(full), np.int64)
    limit, i = max(1, params.cells // len(model.names)), 0
    while i < len(full):  # documents together while their words fit
        first = words.first[full[i]]
        j = max(i + 1, int(np.searchsorted(words.first[full + 1], first + limit, "right")))
        last = words.first[full[j - 1] + 1]
        letters = bucket[begin[first] : begin[last] if last < len(begin) else len(bucket)]
        own = begin[first:last] - begin[first]
        if last - first > limit:
            shares[i], count[i] = infer_long(model, letters, own, params)
        else:
            shares[i:j], count[i:j] = infer(_likelihoods(model, letters, own), words.first[full[i:j]] - first, params)
        i = j
    ascii_letters = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(~_BREAKS[texts.data] & (texts.data < 128), out=ascii_letters[1:])
    plain = np.diff(ascii_letters[texts.offsets]) > 0
    for row, d in enumerate(full):
        if plain[d] or _has_letter(texts.data[texts.offsets[d] : texts.offsets[d + 1]].tobytes()):
            top = int(shares[row].argmax())
            names[d], score[d], kinds[d] = model.names[top], min(1.0, shares[row, top]), count[row]
    return names, score, kinds


def predict(docs: DataFrame, model: LanguageModel, params: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of that language) and n_languages of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _texts(batch):
                names, score, kinds = predict_texts(texts, shared.value, params)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(texts)), pa.array(names, pa.string()), pa.array(score), pa.array(kinds)], ["doc_id", "lang_pred", "score", "n_languages"])

    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, n_languages bigint")
    return out.select("doc_id", held_out("doc_id", params.modulus, params.rest).alias("held_out"), "lang_pred", "score", "n_languages")


def keep_identified(docs: DataFrame, model: LanguageModel, params: LanguageParams = LanguageParams()) -> DataFrame:
    """``docs`` whose main language holds at least ``keep_share`` of the words; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, texts in _texts(batch):
                names, score, _ = predict_texts(texts, shared.value, params)
                keep[i : i + len(texts)] = (np.array(names, object) != "und") & (score >= params.keep_share)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

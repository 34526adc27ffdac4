"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman scores them.

Seeds are three words in a row and two spaced patterns, (0, 1, 3) and (0, 2, 3), so that a copy with
every third word replaced still has some. The test items are read in blocks of a bounded size. A
first pass over the documents counts in how many of them each seed of the block occurs. An item
then uses its rare seeds: those that few items share and that are not much more frequent in the
documents than the item's others. Seeds that no document holds stay in this comparison, so an item
that nobody copied does not fall back on phrases that everybody writes. Only an item with fewer
than ``least_seeds`` rare ones, dead or alive, also uses its rarest common ones. A second pass cuts
the passages around the hits of an item, of twice its length at most between two hits, and aligns
them word by word unless too few of the item's words are there for the least score.

Seeds, items and their words are broadcast, ``block_bytes`` of text at a time; documents are not
shuffled, and a document meets an item only over a rare seed. Identical items are aligned once.

Defined results: null and empty texts match nothing; items with fewer words than a seed cannot
be told from chance and match nothing; repeated rows of a document, and rows without ``doc_id``,
are one document in ``contaminated`` (with a null id) and rows of their own in ``clean``, which
looks at texts alone; items without ``item_id`` are reported with a null id; an empty table on
either side gives no pairs; ties of the score go to the earliest, then longest span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textblock as tb
from scanloom.session import cut


@dataclass(frozen=True)
class DecontaminationParams:
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    min_score: float = 0.4  # of the score of an unchanged copy
    rare_docs: int = 64  # documents that may hold a rare seed in any case
    spread: int = 16  # times the lower quartile of the item's seeds, which a rare seed may reach
    rare_items: int = 8  # items that may share a rare seed
    least_seeds: int = 4
    block_bytes: int = 8 << 20  # text of the items that are broadcast at once


#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
_BREAKS = np.ones(256, bool)
_BREAKS[128:] = False
_BREAKS[ord("0") : ord("9") + 1] = False
_BREAKS[ord("a") : ord("z") + 1] = False
_FILTER_BITS = 22
#: Places of a seed's words, from its first one on.
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def seeds_of(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of the first word) of all seeds that stay inside a text, by that index."""
    grams, places = [], []
    for k, offsets in enumerate(PATTERNS):
        n = len(h) - offsets[-1]
        if n <= 0:
            continue
        at = np.flatnonzero(text[:n] == text[offsets[-1] :])
        total = np.full(len(at), k + 1, np.uint64)
        for o in offsets:
            total = total * _MULT + h[at + o]
        grams.append(tb.mix(total))
        places.append(at)
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram, place = np.concatenate(grams), np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return gram[order], place[order]


def _hashed(texts: tb.Texts) -> tuple[tb.Words, np.ndarray, np.ndarray, np.ndarray]:
    words = tb.words_of(texts, _BREAKS)
    h = tb.hash_spans(texts.data, words.start, words.end)
    return words, h, *seeds_of(h, words.text)


class GramSet:
    """Sorted hashes behind a bit table, so that most look-ups end after one read."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = np.unique(grams)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``grams`` that are members, and their numbers."""
        maybe = np.flatnonzero(self.table[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(self.grams):
            return maybe[:0], maybe[:0]
        place = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
        hit = self.grams[place] == grams[maybe]
        return maybe[hit], place[hit]


@dataclass
class Items:
    """A block of different items: their words, and which seeds each of them has."""

    words: list[np.ndarray]
    members: GramSet
    gram: np.ndarray  # of each (seed, item), by seed
    item: np.ndarray

    def chosen(self, docs: np.ndarray, params: DecontaminationParams) -> "Items":
        """The items with the seeds they use; ``docs`` counts the documents of each seed."""
        n_items = np.bincount(self.gram, minlength=len(self.members.grams))
        order = np.lexsort((self.gram, docs[self.gram], n_items[self.gram], self.item))
        gram, item = self.gram[order], self.item[order]
        first = np.searchsorted(item, np.arange(len(self.words) + 1))
        keep = np.zeros(len(gram), bool)
        for k in range(len(self.words)):
            own = gram[first[k] : first[k + 1]]
            often = np.sort(docs[own])
            limit = max(params.rare_docs, params.spread * int(often[len(own) // 4]))
            rare = (n_items[own] <= params.rare_items) & (docs[own] <= limit)
            if rare.sum() < params.least_seeds:
                rare[np.flatnonzero(~rare)[: params.least_seeds - int(rare.sum())]] = True
            keep[first[k] : first[k + 1]] = rare & (docs[own] > 0)
        gram, item = gram[keep], item[keep]
        order = np.argsort(gram, kind="stable")
        used, gram = np.unique(gram[order], return_inverse=True)
        return Items(self.words, GramSet(self.members.grams[used]), gram, item[order])


def items_of(texts: pa.ChunkedArray) -> tuple[Items, np.ndarray]:
    """The different items of a block, and the number of each text's item; -1 without a seed."""
    which, words, grams, owners = np.full(len(texts), -1), [], [], []
    seen: dict[bytes, int] = {}
    for i, some in tb.lowered(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts):
        found, h, gram, at = _hashed(some)
        bounds = np.searchsorted(found.text[at], np.arange(len(some) + 1))
        for d in range(len(some)):
            if bounds[d + 1] == bounds[d]:
                continue
            own = h[found.first[d] : found.first[d + 1]]
            number = seen.setdefault(own.tobytes(), len(words))
            if number == len(words):
                words.append(own)
                grams.append(np.unique(gram[bounds[d] : bounds[d + 1]]))
                owners.append(np.full(len(grams[-1]), number))
            which[i + d] = number
    flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    members = GramSet(flat)
    gram = np.searchsorted(members.grams, flat)
    order = np.argsort(gram, kind="stable")
    return Items(words, members, gram[order], (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]), which


def _frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """Documents that hold each seed of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(items.members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in tb.lowered(batch.column("text")):
                words, _, grams, at = _hashed(texts)
                hit, number = shared.value.find(grams)
                pair = np.unique(number * np.int64(len(texts)) + words.text[at[hit]])
                value, n = np.unique(pair // max(1, len(texts)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], ["seed", "n"])

    counts = docs.select("text").mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.members.grams), np.int64)
    out[np.asarray(counts.column("seed"))] = np.asarray(counts.column("n"))
    return out


def _passages(items: Items, text: np.ndarray, at: np.ndarray, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, low, high) of the passages around the hits of each item; words low to high."""
    start = np.searchsorted(items.gram, number)
    size = np.searchsorted(items.gram, number, "right") - start
    item = items.item[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]
    text, at = np.repeat(text, size), np.repeat(at, size)
    order = np.lexsort((at, item, text))
    text, item, at = text[order], item[order], at[order]
    reach = np.array([len(w) for w in items.words], np.int64)[item] if len(item) else at
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(at) > 2 * reach[1:])])) if len(at) else at
    last = np.append(new[1:], len(at)) - 1 if len(at) else at
    span = PATTERNS[-1][-1] + 1
    return text[new], item[new], np.maximum(at[new] - reach[new], first[text[new]]), np.minimum(at[last] + span + reach[new], first[text[new] + 1])


def align(passages: list[np.ndarray], items: list[np.ndarray], params: DecontaminationParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each pair: score, first and end word in the passage.

    A cell holds score and start in one number, so that the earliest start of the best score
    comes along. Gaps along the passage are a running maximum, so a row is a few array steps.
    """
    width, depth, n = max(map(len, passages)), max(map(len, items)), len(passages)
    unit = np.int64(width + 2)
    p, q = np.zeros((n, width), np.int64), np.zeros((n, depth), np.int64)
    p_on, q_on = np.zeros((n, width), bool), np.zeros((n, depth), bool)
    for r, (x, y) in enumerate(zip(passages, items, strict=True)):
        p[r, : len(x)], p_on[r, : len(x)] = x, True
        q[r, : len(y)], q_on[r, : len(y)] = y, True
    at = np.arange(width + 1, dtype=np.int64)
    fresh = unit - 1 - at
    slope = at * (-params.gap) * unit
    cells = np.broadcast_to(fresh, (n, width + 1)).copy()
    best, end = cells[:, 0].copy(), np.zeros(n, np.int64)
    rows = np.arange(n)
    for i in range(depth):
        same = (p == q[:, i : i + 1]) & p_on & q_on[:, i : i + 1]
        step = np.maximum(cells + params.gap * unit, fresh)
        np.maximum(step[:, 1:], cells[:, :-1] + np.where(same, params.match, params.mismatch) * unit, out=step[:, 1:])
        cells = np.maximum.accumulate(step + slope, axis=1) - slope
        top = cells.argmax(axis=1)
        better = cells[rows, top] // unit > best // unit
        best, end = np.where(better, cells[rows, top], best), np.where(better, top, end)
    return best // unit, unit - 1 - best % unit, end


def matches(texts: tb.Texts, items: Items, params: DecontaminationParams) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, score, first, end word) of the alignments that reach the least score."""
    words, h, grams, at = _hashed(texts)
    hit, number = items.members.find(grams)
    text, item, low, high = _passages(items, words.text[at[hit]], at[hit], number, words.first)
    # an alignment scores at most ``match`` for each word of the item that the passage holds
    able = [k for k in range(len(text)) if np.isin(items.words[item[k]], h[low[k] : high[k]]).sum() >= params.min_score * len(items.words[item[k]])]
    able.sort(key=lambda k: high[k] - low[k])
    first = 0
    while first < len(able):
        last = first + 1
        while last < len(able) and (last + 1 - first) * (high[able[last]] - low[able[last]]) <= 1 << 18:
            last += 1
        take = np.array(able[first:last])
        own = [items.words[i] for i in item[take]]
        score, start, end = align([h[a:b] for a, b in zip(low[take], high[take], strict=True)], own, params)
        share = score / np.array([params.match * len(w) for w in own], float)
        good = share >= params.min_score
        place = low[take] - words.first[text[take]]
        yield text[take][good], item[take][good], share[good], (place + start)[good], (place + end)[good]
        first = last


def _blocks(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams) -> Iterator[tuple[Items, pa.Table, np.ndarray]]:
    """(items with their seeds, rows (item_id, text), number of each row's item) of every block."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // params.block_bytes))
    rows = cut(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    for b in range(blocks):
        block = rows.filter(F.col("block") == b).select("item_id", "text").toArrow()  # about ``block_bytes``
        items, which = items_of(block.column("text"))
        if len(items.words):
            yield items.chosen(_frequencies(docs, items), params), block.column("item_id"), which


def contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): documents that hold a copy of a test item.

    The span counts the document's words; the best alignment of each pair is given.
    """
    spark = docs.sparkSession
    slim, found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), []
    for items, ids, which in _blocks(slim, benchmark, params):
        known = which >= 0
        order = np.argsort(which[known], kind="stable")
        held = spark.sparkContext.broadcast((items, which[known][order], ids.combine_chunks().filter(pa.array(known)).take(pa.array(order))))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items, numbers, ids = held.value
            for batch in batches:
                for i, texts in tb.lowered(batch.column("text")):
                    for text, item, score, start, end in matches(texts, items, params):
                        first = np.searchsorted(numbers, item)
                        size = np.searchsorted(numbers, item, "right") - first
                        copy = np.repeat(np.arange(len(item)), size)  # once for each id of the item
                        row = np.arange(len(copy)) - np.repeat(np.cumsum(size) - size, size) + first[copy]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(text[copy] + i)), ids.take(pa.array(row)), pa.array(score[copy]), pa.array(start[copy]), pa.array(end[copy])],
                            ["doc_id", "item_id", "score", "start_word", "end_word"],
                        )

        found.append(slim.mapInArrow(run, "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint"))
    if not found:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint")
    best = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start_word")).alias("before"), "end_word")).alias("m"))
    return best.select("doc_id", "item_id", "m.score", (-F.col("m.before")).alias("start_word"), "m.end_word")


def clean(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """``docs`` without the contaminated documents."""
    out = docs
    for items, *_ in _blocks(docs, benchmark, params):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, texts in tb.lowered(batch.column("text")):
                    for text, *_ in matches(texts, held.value, params):
                        keep[text + i] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out

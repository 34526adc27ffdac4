"""Collocations: word sequences that stay together more often than their parts would by chance.

Frequent phrases are mined by Toivonen's method. All words belong to the border of the shortest
phrases, so words are counted first, in full. A sample of the documents, with a lowered threshold,
proposes longer phrases of frequent words; it is mined in two steps, pairs, then sequences of
frequent pairs. One pass over all documents counts the proposed phrases and their negative border: what is
not proposed though its first and its last words, one fewer, both are. (The border is counted where
it occurs; a border phrase that never occurs cannot be frequent.) If a phrase of the border proves
frequent, its extensions were not counted yet: the next pass counts these, and the extensions of
what it counts itself, which closes the set. The result does not depend on the sample, which only
decides how much is counted.

That pass shuffles 40-bit hashes with their counts. Phrases that share a hash can only seem more
frequent than they are, so the last pass, which counts by text what seemed frequent, is exact. Proposals and frequent hashes go to the tasks as tables of 2^``filter_bits`` bits, a size
that no corpus changes. Phrases that share a bit make a pass dearer and change no count. Slices of
text end at piece boundaries, which bounds the memory of a long text.

Defined results: a null text is empty, a null language is ``und``. Every row counts, repeated ones
too. Ties of score and frequency go by the phrase in byte order. An empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm import textblock as tb
from scanloom.session import cut


@dataclass(frozen=True)
class PhraseParams:
    max_words: int = 5
    min_count: int = 100
    absorb_percent: int = 100  # a longer candidate this frequent, in percent, replaces a phrase
    top: int = 2000  # per language
    sample_share: int = 16  # the sample is one document of so many, by a hash of its id
    slack: float = 0.5  # of the sample's proportional threshold
    filter_bits: int = 26
    slice_bytes: int = 2 << 20


_CUTS = np.zeros(256, bool)
_CUTS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BREAKS = _CUTS.copy()
_BREAKS[[32, 9]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64((1 << 40) - 1)  # bits of a hash that are shuffled


def _has(table: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set; no table stands for all bits."""
    if table is None:
        return np.ones(len(h), bool)
    place = h & np.uint64(len(table) * 64 - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _seed(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return tb.hash_spans(raw, np.array([0]), np.array([len(raw)]))[0]


def _extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tb.mix(h * _MULT + word)


def _cut_long(texts: tb.Texts, limit: int) -> tb.Texts:
    """Texts longer than ``limit`` end at a piece boundary about every ``limit`` bytes."""
    if len(texts) == 0 or np.diff(texts.offsets).max() <= limit:
        return texts
    bounds = np.flatnonzero(_CUTS[texts.data])
    near = np.searchsorted(bounds, np.arange(limit, len(texts.data), limit))
    return tb.Texts(texts.data, np.unique(np.concatenate([texts.offsets, bounds[near[near < len(bounds)]]])))


@dataclass(frozen=True)
class Pass:
    """What a pass over texts counts.

    A phrase is counted if the phrase without its last word and the one without its first are both
    admitted and held; single words are admitted. ``table`` holds what has its bit set. ``old`` is
    the table of the pass before, if there was one: of what that pass counted only phrases in
    ``wanted`` are counted again, and what it did not count is held wherever it is admitted. Phrases
    of more than ``checked`` words are held as well.
    """

    table: np.ndarray | None = None
    old: np.ndarray | None = None
    wanted: np.ndarray | None = None
    shortest: int = 2
    longest: int = 5
    checked: int = 5


def count_slice(texts: tb.Texts, seed: np.uint64, what: Pass, named: bool) -> Iterator[tuple[np.ndarray | pa.Array, np.ndarray]]:
    """Hashes, or texts if ``named``, and counts of the phrases of a slice; by text, an empty one counts all words."""
    data = tb.lower_ascii()[texts.data]
    words = tb.words_of(tb.Texts(data, texts.offsets), _BREAKS)
    total = len(words.start)
    if total == 0:
        return
    cuts = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_CUTS[data], out=cuts[1:])
    joined = (words.text[1:] == words.text[:-1]) & (cuts[words.start[1:]] == cuts[words.end[:-1]])
    offsets = np.zeros(total + 1, np.int64)
    np.cumsum(words.end - words.start, out=offsets[1:])
    coded = pa.LargeStringArray.from_buffers(total, pa.py_buffer(offsets), pa.py_buffer(data[~_BREAKS[data]])).dictionary_encode()
    word, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    del data, words, cuts, offsets, coded
    place = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1]
    word_hash = tb.mix(tb.hash_spans(np.frombuffer(names.buffers()[2], np.uint8), place[:-1], place[1:]))

    second = what.wanted is not None
    here = np.ones(total, bool)  # where a phrase that starts at a word is admitted
    before = np.full(total, second)  # where the pass before counted it
    ids, h = word, _extend(np.full(len(names), seed), word_hash)
    first, n, size = np.zeros(len(names), np.int64), np.bincount(word, minlength=len(names)), 1
    first[word[::-1]] = np.arange(total)[::-1]
    if what.shortest == 1:
        yield pa.array([""], pa.large_string()), np.array([total])
    while True:
        fresh = ~before[first]
        out = np.flatnonzero(fresh | _has(what.wanted, h)) if second else np.arange(len(first))
        out = out if size >= what.shortest else out[:0]
        if len(out) and named:
            parts = [names.take(pa.array(word[first[out] + k])) for k in range(size)]
            yield pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), n[out]
        elif len(out):
            yield h[out], n[out]
        if size == what.longest:
            return
        held = _has(what.table, h)[ids] if size <= what.checked else np.ones(total, bool)
        if second:
            held |= ~before
        good = here & held
        at = np.flatnonzero(good[:-1] & good[1:] & (joined if size == 1 else True))
        if not len(at):
            return
        known = before & _has(what.old, h)[ids] if second else before
        _, lead, which = np.unique(ids[at] * np.int64(len(h)) + ids[at + 1], return_index=True, return_inverse=True)
        first, n, size = at[lead], np.bincount(which, minlength=len(lead)), size + 1
        h = _extend(h[ids[first]], word_hash[word[first + size - 1]])
        counted = known[first] & known[first + 1]
        here, before, ids = np.zeros(total, bool), np.zeros(total, bool), np.zeros(total, np.int64)
        here[at] = True
        before[at], ids[at] = counted[which], which


def _merged(rows: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same counts by phrase in fewer rows; about ``limit`` rows are held at once."""
    held, n = [], 0
    for batch in rows:
        held.append(batch)
        n += batch.num_rows
        if n >= limit:
            held = _summed(held)
            n = sum(b.num_rows for b in held)
            if n > limit // 2:
                yield from held
                held, n = [], 0
    if held:
        yield from _summed(held)


def _summed(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    table = pa.Table.from_batches(rows).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
    return table.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"]).to_batches(max_chunksize=100_000)


def _counted(docs: DataFrame, what: Pass, named: bool, params: PhraseParams, schema: str, row, merge=iter) -> DataFrame:
    """One row per counted phrase and slice, made by ``row(language, phrases, counts)`` and merged by ``merge``."""
    shared = docs.sparkSession.sparkContext.broadcast(what)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                texts = tb.texts_of(batch.column("text").filter(pc.equal(langs, lang)))
                for _, some in tb.slices(_cut_long(texts, params.slice_bytes), params.slice_bytes):
                    for phrases, n in count_slice(some, _seed(lang), shared.value, named):
                        for i in range(0, len(n), 100_000):
                            yield row(lang, phrases[i : i + 100_000], n[i : i + 100_000])

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(lambda batches: merge(rows(batches)), schema)


def hash_counts(docs: DataFrame, what: Pass, params: PhraseParams) -> DataFrame:
    """(h, n): counts by the phrase's hash, in which the language is."""
    row = lambda lang, h, n: pa.RecordBatch.from_arrays([pa.array((h & _SHORT).view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
    return _counted(docs, what, False, params, "h bigint, n bigint", row).groupBy("h").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, what: Pass, params: PhraseParams) -> DataFrame:
    """(lang, phrase, n): exact counts; the empty phrase counts all words of the language."""

    def row(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        tag = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang], pa.string())).dictionary_decode()
        return pa.RecordBatch.from_arrays([tag, phrases.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])

    return _counted(docs, what, True, params, "lang string, phrase string, n bigint", row, _merged).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _word_hashes(words: DataFrame) -> DataFrame:
    """The hash ``h`` that ``count_slice`` gives to each (lang, phrase) of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            seeds = np.array([_seed(lang) for lang in langs.dictionary.to_pylist()], np.uint64)
            texts = tb.texts_of(batch.column("phrase"))
            h = tb.mix(tb.hash_spans(texts.data, texts.offsets[:-1], texts.offsets[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(_extend(seeds[np.asarray(langs.indices)], h).view(np.int64))], ["h"])

    return words.select("lang", "phrase").mapInArrow(run, "h bigint")


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits of all hashes ``h``; at most 2^(bits - 6) rows come to the driver."""
    cell = F.shiftright(F.col("h").bitwiseAND((1 << bits) - 1), 6)
    rows = hashes.groupBy(cell.alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("mask")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[np.asarray(rows.column("cell"))] = np.asarray(rows.column("mask"))
    return table.view(np.uint64)


def frequent_phrases(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, size, phrase, n): every phrase that occurs ``min_count`` times, and all words at size 0."""
    least = max(1, int(params.min_count * params.slack / params.sample_share))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(params.sample_share)) == 0)

    enough = (F.col("n") >= params.min_count) | (F.col("phrase") == "")
    known = cut(phrase_counts(docs, Pass(shortest=1, longest=1), params).filter(enough))
    words = bit_table(_word_hashes(known.filter(F.col("phrase") != "")), params.filter_bits)

    def frequent(of: DataFrame, what: Pass, least: int) -> np.ndarray:
        return bit_table(hash_counts(of, what, params).filter(F.col("n") >= least), params.filter_bits)

    pairs = frequent(sample, Pass(words, longest=2), least)
    proposed = words | frequent(sample, Pass(words | pairs, longest=params.max_words, checked=2), least)
    found = frequent(docs, Pass(proposed, longest=params.max_words, checked=params.max_words), params.min_count)
    # both parts of a frequent phrase are frequent: held in the table below, or counted only now, hence held
    last = Pass(proposed | found, proposed, found, 2, params.max_words, params.max_words)
    longer = cut(phrase_counts(docs, last, params).filter(enough))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return known.unionByName(longer).withColumn("size", size)


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of every language.

    A phrase is cut in two where the score, 1000 * a * n / (l * r) rounded down, is least.
    """
    counts = frequent_phrases(docs, params)
    total = counts.filter("size = 0").select("lang", F.col("n").alias("total"))
    known = counts.filter((F.col("size") >= 1) & (F.col("n") >= params.min_count)).select("lang", F.col("phrase").alias("known"), F.col("n").alias("f"))
    candidates = counts.filter((F.col("size") >= 2) & (F.col("n") >= params.min_count)).select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    inner = candidates.filter("size > 2").select(
        "lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(w, i, k), ' '))))")).alias("phrase")
    )
    absorbed = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(absorbed, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < params.absorb_percent * F.col("a"))).drop("longer")

    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size - 1), k -> struct(k AS k, array_join(slice(w, 1, k), ' ') AS head, array_join(slice(w, k + 1, size), ' ') AS tail))")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut.*")
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("known").alias(side), F.col("f").alias(name)), ["lang", side])
    # decimals of up to 38 digits: exact for counts below 10^15
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(total as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.join(total, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    rows = best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # first the best of each share of a language, so that no task ranks a whole language
    near = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
    last = near.filter(F.col("rank") <= params.top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return last.filter(F.col("rank") <= params.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

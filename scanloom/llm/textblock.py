"""Arrow string batches as NumPy arrays of words and word hashes.

The helpers work on slices of a bounded number of bytes; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: Word breaks `[\x20\x09-\x0D]`.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

_MULT = np.uint64(0x9E3779B97F4A7C15)
_PRIME = (1 << 31) - 1
_BASES = (1_414_213_562, 1_732_050_807)  # below the prime
_powers: dict[int, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1."""
    p = np.uint64(_PRIME)
    for _ in range(2):
        x = (x & p) + (x >> np.uint64(31))
    return np.where(x >= p, x - p, x)


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo the prime, by doubling."""
    table = _powers.get(base, np.ones(1, np.uint64))
    while len(table) < n:
        table = np.concatenate([table, _reduced(table * np.uint64(pow(base, len(table), _PRIME)))])
    _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Texts:
    """The bytes of some texts one after the other; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def slices(texts: Texts, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first index, texts) of at most ``limit`` bytes; a longer text comes alone."""
    first = 0
    while first < len(texts):
        base = texts.offsets[first]
        last = max(first + 1, int(np.searchsorted(texts.offsets, base + limit, "right")) - 1)
        yield first, Texts(texts.data[base : texts.offsets[last]], texts.offsets[first : last + 1] - base)
        first = last


def lowered(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, Texts]]:
    """(first index, texts) of bounded slices in lower case; only ``rows`` texts are copied at once."""
    for first in range(0, len(column), rows):
        for i, texts in slices(texts_of(pc.utf8_lower(column.slice(first, rows)))):
            yield first + i, texts


@dataclass
class Words:
    start: np.ndarray  # byte offsets
    end: np.ndarray
    text: np.ndarray  # index of the text of each word
    first: np.ndarray  # words first[i]:first[i + 1] are those of text i


def words_of(texts: Texts, breaks: np.ndarray = BLANK) -> Words:
    """Maximal runs of bytes that are not ``breaks``; a run ends where its text ends."""
    n = len(texts.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(texts) + 1, np.int64))
    gap = breaks[texts.data]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_or(gap[:-1], edge[1:n], out=before[1:])
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_or(gap[1:], edge[1:n], out=after[:-1])
    word = ~gap
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    first = np.searchsorted(start, texts.offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(start, end, text, first)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of data[start:end] for spans in ascending order.

    Two polynomials modulo the prime 2^31 - 1 from prefix sums, and the length. (A polynomial modulo
    2^64 is the same for certain texts of two letters, whatever its base.)
    """
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + block, "right")))
        span = int(end[j - 1] - base)
        low, high = start[i:j] - base, end[i:j] - base
        letters = data[base : base + span].astype(np.uint64) + np.uint64(1)
        total = np.zeros(span + 1, np.uint64)
        halves = []
        for b in _BASES:
            terms = letters * _power_table(b, span + 1)[:span]  # below 2^40
            np.cumsum(terms if span <= 1 << 22 else _reduced(terms), out=total[1:])
            sums = _reduced(total[high] - total[low])
            halves.append(_reduced(sums * _power_table(pow(b, -1, _PRIME), span + 1)[low]))
        out[i:j] = mix((halves[0] << np.uint64(32)) | halves[1]) + (high - low).astype(np.uint64) * _MULT
        i = j
    return mix(out)


def ngrams(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of the first word) of all n-word windows that stay inside a text."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = total * _MULT + h[k : len(h) - n + 1 + k]
    at = np.flatnonzero(text[: len(h) - n + 1] == text[n - 1 :])
    return mix(total[at]), at


def lower_ascii() -> np.ndarray:
    """Table that lower-cases A-Z in bytes."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table

"""Hierarchical multi-length packing of documents into training sequences.

Every task tokenises its documents and packs them in shards of a bounded number of tokens; only
the pieces leave the task. Documents are routed to context tiers (the smallest power of two that
holds them; the longest are cut at the window). The windows of a tier are opened by its own
pieces, longest first, and their gaps are filled from shorter tiers: best fit first, and a piece
is cut where only longer ones remain. The windows of a shard are then dealt to step groups of
nearly equal token counts.

A shard ends in less than one open window; that is cut into windows at powers of two, so no
sequence needs padding. Sequence ids count up inside a partition, so the input must be a stable
table (files, a checkpoint): a task that is run again then gives the same pieces.

Defined results: a null or empty text is the end id alone; repeated rows are packed each.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackingParams:
    window: int = 2048
    tiers: tuple[int, ...] = (256, 512, 1024, 2048)
    end_id: int = 1
    shard_tokens: int = 1 << 22
    step_tokens: int = 1 << 17  # tokens of a step group
    cache: int = 400_000  # words whose ids a worker remembers


#: Texts of these characters are split by ``_PIECES`` exactly as the tokenizer splits them.
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]|<\\|")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|(?:[^\s\w]|_)+")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class _Numbers(dict):
    """Word to running number; words that are new wait in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Token ids of texts, with the ids of words remembered between texts.

    A text that ``_PIECES`` splits like the tokenizer is looked up word by word; a new word goes
    straight to the vocabulary's merges. Any other text takes the whole tokenizer.
    """

    def __init__(self, blob: str, limit: int) -> None:
        from tokenizers import Tokenizer

        model = json.loads(blob)
        steps = (model.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [s.get("type") for s in (model.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == _SPLIT
            and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and kinds == ["NFC", "Replace", "Lowercase"] and model.get("post_processor") is None
        )
        self.tokenizer, self.limit, self.letters = Tokenizer.from_str(blob), limit, _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.size = np.zeros(1 << 10, np.int64)
        self.start = np.zeros(1 << 10, np.int64)
        self.flat = np.zeros(1 << 12, np.uint32)
        self.words = self.used = 0

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        letters, tokenize = self.letters, self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize("".join([letters[b] for b in w.encode()]))] for w in new]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.uint32, int(size.sum()))
        while len(self.size) < self.words + len(new):
            self.size, self.start = np.append(self.size, np.zeros_like(self.size)), np.append(self.start, np.zeros_like(self.start))
        while len(self.flat) < self.used + len(flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.size[self.words : self.words + len(new)] = size
        self.start[self.words : self.words + len(new)] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(flat)] = flat
        self.words, self.used = self.words + len(new), self.used + len(flat)

    def ids(self, text: str) -> np.ndarray:
        if not self.by_word or _OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.words > self.limit:
            self._forget()
        words = list(map(self.numbers.__getitem__, _PIECES.findall(text.lower())))
        if self.numbers.new:
            self._learn()
        number = np.array(words, np.int64)
        size = self.size[number]
        before = np.cumsum(size) - size
        return self.flat[np.arange(size.sum()) + np.repeat(self.start[number] - before, size)]


_loaded: dict[int, WordIds] = {}


def _word_ids(blob: str, limit: int) -> WordIds:
    name = zlib.crc32(blob.encode())
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = WordIds(blob, limit)
    return _loaded[name]


Piece = tuple[int, int, int]  # length, document, start


def pack_shard(lengths: list[int], params: PackingParams) -> list[list[Piece]]:
    """Windows of (length, document, start); every window's length is a power of two."""
    windows: list[list[Piece]] = []
    pool: list[Piece] = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - params.window + 1, params.window):
            windows.append([(params.window, doc, start)])
        if rest := n % params.window:
            pool.append((rest, doc, n - rest))
    pool.sort()
    while pool:
        piece = pool.pop()
        tier = next(t for t in params.tiers if t >= piece[0])
        window, gap = [piece], tier - piece[0]
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 0))
            if at:
                piece = pool.pop(at - 1)
            else:
                n, doc, start = pool.pop(0)
                piece = (gap, doc, start)
                insort(pool, (n - gap, doc, start + gap))
            window.append(piece)
            gap -= piece[0]
        windows += [window] if not gap else _powers(window)
    return windows


def _powers(window: list[Piece]) -> list[list[Piece]]:
    """The last window of a shard, cut at powers of two."""
    left, out = sum(p[0] for p in window), []
    todo = window[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out.append([])
        while size:
            n, doc, start = todo.pop()
            take = min(n, size)
            out[-1].append((take, doc, start))
            if n > take:
                todo.append((n - take, doc, start + take))
            size -= take
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """Group of each window: longest first into the emptiest group."""
    groups = max(1, round(sum(sizes) / step_tokens))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        full, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (full + sizes[i], g))
    return out


_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, context bigint, step_group bigint"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def pack(docs: DataFrame, tokenizer_path: str, params: PackingParams = PackingParams()) -> DataFrame:
    """Pieces of all documents: where each one is in its document and in its sequence.

    ``context`` is the length of the sequence, ``step_group`` the group it is trained in.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        words = _word_ids(blob.value, params.cache)
        end = np.array([params.end_id], np.uint32)
        docs_of, ids, total = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                one = np.concatenate([words.ids(text.as_py() or ""), end])
                docs_of.append(doc.as_py())
                ids.append(one)
                total += len(one)
                if total >= params.shard_tokens:
                    yield docs_of, ids
                    docs_of, ids, total = [], [], 0
        if ids:
            yield docs_of, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        made = groups_made = 0
        for docs_of, ids in shards(batches):
            windows = pack_shard([len(x) for x in ids], params)
            sizes = [sum(p[0] for p in w) for w in windows]
            groups = step_groups(sizes, params.step_tokens)
            rows = []
            for w, window in enumerate(windows):
                offset = 0
                for n, doc, start in window:
                    crc = zlib.crc32(ids[doc][start : start + n].astype("<u4").tobytes())
                    rows.append((docs_of[doc], start, n, crc, len(ids[doc]), base + made + w, offset, sizes[w], base + groups_made + groups[w]))
                    offset += n
            made += len(windows)
            groups_made += max(groups) + 1
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _SCHEMA)

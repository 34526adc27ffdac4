"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are computed in one pass (NumPy over Arrow batches); only 16-byte rows move on.
The upper nodes of the index are masked bit patterns. For two differing bits, 64 bits are cut
into three blocks, of which one agrees, and the other two blocks into three parts, of which one
agrees again: nine masks, and every linked pair shares the pattern under one of them. A pattern
with its fingerprints is one subtree; the subtrees are dealt over the cluster by pattern. Inside
a subtree fingerprints are sorted by Gray rank, runs of eight become nodes that hold the bits on
which all of them agree, and so on upwards. Pairs of nodes are followed down; the differences in
the shared bits accumulate and whole groups are pruned as soon as they pass the limit. A pair is
reported under its first mask only.

Defined results: null and empty texts have fingerprint 0 and are linked like any other; repeated
rows are copies; rows without ``doc_id`` get the component of their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import textblock as tb
from scanloom.operators.components import connected_components
from scanloom.session import cut


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 3  # words
    seed: int = 42
    fanout: int = 8  # children of an index node
    frontier: int = 1 << 17  # node pairs followed at once


LIMIT = 2  # differing bits of a link; the masks below are built for it


def _masks() -> list[int]:
    blocks = [(0, 22), (22, 43), (43, 64)]
    out = []
    for low, high in blocks:
        rest = [b for b in range(64) if not low <= b < high]
        third = -(-len(rest) // 3)
        for k in range(0, len(rest), third):
            out.append(sum(1 << b for b in [*range(low, high), *rest[k : k + third]]))
    return out


MASKS = _masks()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_texts(texts: list[bytes], params: SimHashParams) -> np.ndarray:
    """Fingerprints (uint64) of UTF-8 texts: majority bits of the XXH64 of word shingles."""
    n, seed, digest = params.shingle, params.seed, xxhash.xxh64_intdigest
    lower = tb.lower_ascii().tobytes()
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.translate(lower).split()  # splits at 0x20 and 0x09-0x0D
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= n:
            hashes.append(digest(line, seed))
            sizes[i] = 1
            continue
        width = np.fromiter(map(len, words), np.int64, len(words)) + 1
        stop = np.cumsum(width) - 1
        start = (stop + 1 - width)[: len(words) - n + 1].tolist()
        hashes.extend([digest(line[a:b], seed) for a, b in zip(start, stop[n - 1 :].tolist(), strict=True)])
        sizes[i] = len(start)
    h = np.array(hashes, np.uint64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        ones = np.empty((len(full), 64), np.int64)
        for k in range(64):
            ones[:, k] = np.add.reduceat(((h >> np.uint64(k)) & np.uint64(1)).astype(np.int64), first)
        bits = (2 * ones > sizes[full, None]).astype(np.uint64)
        out[full] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed BIGINT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in tb.slices(tb.texts_of(batch.column("text"))):
                raw = texts.data.tobytes()
                fp = fingerprint_texts([raw[a:b] for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)], params)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(texts)), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected binary sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(shift))
    return fp


class GrayIndex:
    """Levels of nodes over the fingerprints of several subtrees; level 0 holds the fingerprints."""

    def __init__(self, fp: np.ndarray, tree: np.ndarray, fanout: int = 8) -> None:
        order = np.lexsort((gray_rank(fp), tree))
        self.fp = fp[order]
        tree = tree[order]
        every, some = self.fp, self.fp
        self.levels = [{"mask": np.full(len(fp), ~np.uint64(0)), "bits": self.fp}]
        while len(tree) and (tree[1:] == tree[:-1]).any():
            head = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
            place = np.arange(len(tree)) - np.repeat(head, np.diff(np.append(head, len(tree))))
            first = np.flatnonzero(place % fanout == 0)
            every, some = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first)
            mask = ~(every ^ some)
            self.levels.append({"mask": mask, "bits": every & mask, "first": first, "count": np.diff(np.append(first, len(tree)))})
            tree = tree[first]
        self.roots = len(tree)

    def pairs(self, limit: int, frontier: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i < j) of fingerprints of one subtree that differ in at most ``limit`` bits."""
        roots = np.arange(self.roots)
        stack = [(len(self.levels) - 1, roots, roots, np.zeros(self.roots, np.int64))]
        while stack:
            k, a, b, seen = stack.pop()
            if k == 0:
                yield a, b
                continue
            if len(a) > frontier:
                half = len(a) // 2
                stack += [(k, a[:half], b[:half], seen[:half]), (k, a[half:], b[half:], seen[half:])]
                continue
            up, low = self.levels[k], self.levels[k - 1]
            wide = up["count"][b]
            n = up["count"][a] * wide
            pair = np.repeat(np.arange(len(a)), n)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            i, j = up["first"][a][pair] + place // wide[pair], up["first"][b][pair] + place % wide[pair]
            known = (up["mask"][a] & up["mask"][b])[pair]
            fresh = (low["bits"][i] ^ low["bits"][j]) & low["mask"][i] & low["mask"][j] & ~known
            total = seen[pair] + np.bitwise_count(fresh)
            keep = (total <= limit) & ((i < j) if k == 1 else (i <= j))
            if keep.any():
                stack.append((k - 1, i[keep], j[keep], total[keep]))


def _links(batches: Iterator[pa.RecordBatch], params: SimHashParams) -> Iterator[pa.RecordBatch]:
    """Linked pairs of rows (slot, pattern, fp, rep) that arrive sorted by slot and pattern."""
    kept: list[np.ndarray] = []

    def search(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        tree = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        rows, tree = rows[~alone], tree[~alone]
        if not len(rows):
            return
        fp = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        order = np.lexsort((gray_rank(fp), tree))
        index = GrayIndex(fp[order], tree[order], params.fanout)
        slot, rep = rows[order, 0], rows[order, 3]
        for i, j in index.pairs(LIMIT, params.frontier):
            differ, at = index.fp[i] ^ index.fp[j], slot[i]
            first = np.ones(len(i), bool)
            for s, mask in enumerate(MASKS):
                first &= ~((at > s) & ((differ & np.uint64(mask)) == 0))
            yield pa.RecordBatch.from_arrays([pa.array(rep[i[first]]), pa.array(rep[j[first]])], ["a", "b"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "pattern", "fp", "rep")], axis=1).astype(np.int64)
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        cut_at = last[-1] + 1 if len(last) else 0
        if kept and (cut_at or (kept[-1][-1, :2] != rows[0, :2]).any()):
            yield from search(np.concatenate([*kept, rows[:cut_at]]))
            kept = []
        elif cut_at:
            yield from search(rows[:cut_at])
        kept.append(rows[cut_at:])
    if kept:
        yield from search(np.concatenate(kept))


def linked_pairs(nodes: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(a, b): the ``rep`` values of different fingerprints that differ in at most two bits."""
    slots = F.array(*[F.struct(F.lit(s).cast("bigint").alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern")) for s, m in enumerate(MASKS)])
    keyed = nodes.select("fp", "rep", F.explode(slots).alias("s")).select("s.slot", "s.pattern", "fp", "rep")
    dealt = keyed.repartition("slot", "pattern").sortWithinPartitions("slot", "pattern")
    return dealt.mapInArrow(lambda batches: _links(batches, params), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) per row."""
    prints = cut(fingerprints(docs, params))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(linked_pairs(nodes.filter(F.col("rep").isNotNull()), params))
    named = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("comp", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """``docs`` without the documents that are linked to a smaller ``doc_id``."""
    gone = near_duplicates(docs, params).filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")

"""Packing as an exact round trip."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scanloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul ΣΑΣ", "a<|endoftext|>b", "x\x1cy\x85z\xa0w", "½ ² ª º µ", "it's WE'LL_don't", "naïve É ÀÇ", "日本語 text", "é combined", "", None, "\n\n \t", "a" * 5000, "1234567890 -- __ !!"]


def test_ids_by_word_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    words = packing.WordIds(open(PATH, encoding="utf-8").read(), 50)
    assert words.by_word
    rng = random.Random(4)
    alphabet = "abcDEF éÉßÀ ñ÷× 019 .,;'!_-|<>\n\t\x0b~" + "'s'll"
    for text in [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]:
        assert words.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(5))
def test_shards_are_full_windows(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 3, 255, 256, 257, 1025, 2047, 2048, 2049, 9000, rng.randint(1, 3000)]) for _ in range(rng.randint(1, 80))]
    got = defaultdict(list)
    for window in packing.pack_shard(lengths, packing.PackingParams()):
        size = sum(p[0] for p in window)
        assert size <= 2048 and size & (size - 1) == 0
        for n, doc, start in window:
            got[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(got[doc]):
            assert start == at and size > 0
            at += size
        assert at == n


def test_pieces_rebuild_every_document(spark):
    rng = random.Random(8)
    texts = ODD + [" ".join(rng.choice(["alpha", "Beta", "gämma", "x1"]) for _ in range(rng.choice([1, 50, 700, 6000]))) for _ in range(60)]
    rows = [(i, t, "s", 5) for i, t in enumerate(texts)] + [(3, "twice", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, length int").repartition(3).cache()
    out = packing.pack(df, PATH, packing.PackingParams(shard_tokens=9000)).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t, _, _ in rows if d != 3)
    by_doc = {d: g.sort_values("start") for d, g in out[out.doc_id != 3].groupby("doc_id")}
    assert len(by_doc) == len(want)
    for d, ids in want:
        g = by_doc[d]
        assert (g.doc_tokens == len(ids)).all() and g.length.sum() == len(ids)
        at = 0
        for start, n, crc in zip(g.start, g.length, g.ids_crc32):
            assert start == at and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all()
        total = g.length.sum()
        assert total <= 2048 and total & (total - 1) == 0 and (g.context == total).all() and g.step_group.nunique() == 1
    assert packing.pack(df.filter("false"), PATH).count() == 0


def test_step_groups_are_even():
    rng = random.Random(1)
    sizes = [rng.choice([256, 512, 1024, 2048]) for _ in range(900)]
    groups = packing.step_groups(sizes, 1 << 14)
    load = defaultdict(int)
    for s, g in zip(sizes, groups):
        load[g] += s
    assert max(load.values()) - min(load.values()) <= 2048

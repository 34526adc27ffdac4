"""Near-duplicates and benchmark copies against brute force."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from scanloom.llm import decontaminate, simhash
from scanloom.llm import textblock as tb

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text: str) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    comp = list(range(len(prints)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                comp[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        low[root(i)] = min(d, low.get(root(i), d))
    return sorted((d, f"{f:016x}", low[root(i)]) for i, (d, f) in enumerate(prints))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "One", "one", "a b", " a\tB \n", "ß É x y z"] + [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(250)]
    base = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(300)) for _ in range(6)]
    for b in base:
        for _ in range(25):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))
    assert got == plain_components(rows)
    left = simhash.keep_one(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int"))
    assert sorted({r.doc_id for r in left.collect()}) == sorted({c for _, _, c in got})


def test_index_finds_every_pair_and_prunes():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre, *[centre ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(20)]]))
    index = simhash.GrayIndex(fp, np.zeros(len(fp), np.int64))
    got = {(int(index.fp[i]), int(index.fp[j])) for a, b in index.pairs(2, 64) for i, j in zip(a, b, strict=True)}
    near = np.bitwise_count(index.fp[:, None] ^ index.fp[None, :]) <= 2
    want = {(int(index.fp[i]), int(index.fp[j])) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    assert got == want and len(want) > 1000


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_alignment(p, q, match=2, mismatch=-1, gap=-1):
    best = 0
    h = [[0] * (len(p) + 1) for _ in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        for j in range(1, len(p) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if p[j - 1] == q[i - 1] else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(1, 20))) for _ in range(60)]
    score, start, end = decontaminate.align([p for p, _ in pairs], [q for _, q in pairs], decontaminate.DecontaminationParams())
    for (p, q), s, a, b in zip(pairs, score, start, end, strict=True):
        assert s == plain_alignment(list(p), list(q))
        assert s == 0 or (s == plain_alignment(list(p[a:b]), list(q)) and p[a] in q and p[b - 1] in q)


def test_copies_of_items_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(20)] + [(98, None), (99, "too short")]
    docs, want = [], set()
    for d in range(120):
        body = [word() for _ in range(rng.randint(0, 200))]
        if d % 3 == 0:
            k = rng.randrange(20)
            copy = items[k][1].split()
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            if d % 2:
                copy = [w.upper() + "," for w in copy]
            body[len(body) // 2 : len(body) // 2] = copy
            want.add((d, k))
        docs.append((d, " ".join(body), d))
    docs += [(500, None, 1), (501, "", 2), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, gram long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = decontaminate.DecontaminationParams(block_bytes=1500)
    for params in (decontaminate.DecontaminationParams(), small):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench, params).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {d for d, _, _ in docs} - {d for d, _ in want}
    assert decontaminate.contaminated(df, bench.filter("false")).count() == 0
    assert decontaminate.contaminated(df.filter("false"), bench).count() == 0


def test_only_copy_with_every_fourth_word_replaced(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(38))) for k in range(12)]
    edit = lambda text: " ".join(word() if i % 4 == 3 else w for i, w in enumerate(text.split()))
    docs = [(k, " ".join([*(word() for _ in range(60)), edit(text), *(word() for _ in range(60))])) for k, text in items]
    docs += [(50, " ".join(word() for _ in range(80)) + " " + items[3][1])]  # an unedited copy changes nothing for the edited one
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k) for k, _ in items} | {(50, 3)}


def plain_best(text, item):
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    p, q = words(text), words(item)
    return plain_alignment(p, q) / (2 * len(q))


def test_recall_against_the_alignment_of_all_pairs(spark):
    """Copies with a tenth, a fifth, a third of their words replaced, at random or every third."""
    rng = random.Random(21)
    common = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 40)))) for k in range(40)]
    docs = []
    for d in range(160):
        body = [word() for _ in range(rng.randint(20, 90))]
        copy = items[d % 40][1].split()
        share = (0.1, 0.2, 0.33, 0)[d // 40]
        copy = [word() if (rng.random() < share if share else i % 3 == 2) else w for i, w in enumerate(copy)]
        if rng.random() < 0.3:
            del copy[rng.randrange(len(copy))]
        body[20:20] = copy
        docs.append((d, " ".join(body)))
    want = {(d, k) for d, t in docs for k, q in items if plain_best(t, q) >= 0.4}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    for part in range(4):  # each kind of edit on its own
        own = {(d, k) for d, k in want if d // 40 == part}
        assert len(own) > 25 and len(own & got) >= 0.9 * len(own)


def test_a_stem_that_all_items_share_joins_nothing(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    stem = "which of the following is the best answer to this question"
    for n in (100, 200):
        items = [(k, f"{stem} " + " ".join(word() for _ in range(20))) for k in range(n)]
        docs = [(d, " ".join([*(word() for _ in range(30)), stem, *(word() for _ in range(30))])) for d in range(n)] + [(n, " ".join(word() for _ in range(9)) + " " + items[3][1])]
        block, _ = decontaminate.items_of(pa.chunked_array([pa.array([t for _, t in items])]))
        df = spark.createDataFrame(docs, "doc_id long, text string")
        chosen = block.chosen(decontaminate._frequencies(df, block), decontaminate.DecontaminationParams())
        texts = next(tb.lowered(pa.array([t for _, t in docs])))[1]
        words, _, grams, at = decontaminate._hashed(texts)
        hit, number = chosen.members.find(grams)
        assert len(decontaminate._passages(chosen, words.text[at[hit]], at[hit], number, words.first)[0]) == 1
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(n, 3)}


def test_null_ids_same_items_and_long_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = " ".join(word() for _ in range(25))
    long = " ".join(word() for _ in range(60_000)) + " " + item + " " + "x " * 50_000
    docs = [(1, item, 0), (None, item, 0), (None, "nothing here", 0), (2, long, 0), (3, item + " " + item, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, item.upper()), (None, item), (9, " ".join(word() for _ in range(25)))], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, None, 2, 3) for i in (7, 8, None)}
    assert {(r.start_word, r.end_word) for r in got if r.doc_id == 2} == {(60_000, 60_025)} and {r.score for r in got} == {1.0}
    assert {(r.start_word, r.end_word) for r in got if r.doc_id == 3} == {(0, 25)}
    left = decontaminate.clean(df, bench).collect()
    assert [(r.doc_id, r.text, r.item_id) for r in left] == [(None, "nothing here", 0)]

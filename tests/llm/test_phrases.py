"""Phrases against counting every sequence of words."""

import random
import re
from collections import Counter

import pytest

from scanloom.llm import phrases as ph

DOC = "doc_id long, text string, lang string, phrase string, n int, size int, rank int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_counts(docs):
    out, total = {}, Counter()
    for _, text, lang, *_ in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    out.setdefault(lang, Counter())[" ".join(words[i : i + k])] += 1
    return out, total


def plain(docs, least, top):
    counts, total = plain_counts(docs)
    rows = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if " " in p and a >= least}
        kept = []
        for p, a in cand.items():
            if any(f" {p} " in f" {q} " and q != p and b >= a for q, b in cand.items()):
                continue
            w = p.split(" ")
            cuts = [(1000 * a * total[lang] // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((-score, -a, p.encode(), p, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        rows += [(lang, i + 1, p, -a, left, right, total[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(rows)


def sample(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "B", "cc", "é", "日本", "dd", "x-y", "Zz", "\U0001f600", "ß", "É", "ab", "a|b"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!", "\xa0"]
    text = lambda k: "".join(rng.choice(words[: rng.choice([3, 6, 13])]) + rng.choice(gaps) for _ in range(k))
    docs = [(i, text(rng.randint(0, 40)), rng.choice(["en", "de", None]), "p", 1, 2, 3) for i in range(n)]
    docs += [(900, None, "en", "p", 1, 2, 3), (901, "", None, "p", 1, 2, 3), (None, "a b a b", "en", "p", 1, 2, 3), (None, "a b a b", "en", "p", 1, 2, 3)]
    docs += [(902, "hot cold hot cold. " * 3000, "de", "p", 1, 2, 3), (903, "only here in one text, " * 40, "en", "p", 1, 2, 3)]
    return docs


@pytest.mark.parametrize(("share", "bits", "slice_bytes"), [(1, 16, 1 << 22), (7, 6, 3000), (1000, 20, 500)])
def test_every_sample_and_table_gives_the_exact_phrases(spark, share, bits, slice_bytes):
    docs = sample(5)
    params = ph.PhraseParams(min_count=12, sample_share=share, filter_bits=bits, slice_bytes=slice_bytes, top=40)
    got = sorted(tuple(r) for r in ph.collocations(spark.createDataFrame(docs, DOC).repartition(3), params).collect())
    assert got == plain(docs, 12, 40)


def test_counts_of_all_frequent_phrases(spark):
    docs = sample(8, 120)
    got = {(r.lang, r.phrase): r.n for r in ph.frequent_phrases(spark.createDataFrame(docs, DOC), ph.PhraseParams(min_count=9)).filter("size > 0").collect() if r.n >= 9}
    assert got == {(lang, p): n for lang, f in plain_counts(docs)[0].items() for p, n in f.items() if n >= 9}


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, left, right = 9_000_000_123_457, 900_000_000_000_001, 9_100_000_000_003, 9_300_000_000_007
    row = spark.range(1).selectExpr(f"{a}L AS a", f"{n}L AS total", f"{left}L AS l", f"{right}L AS r")
    score = "(cast(1000 * a as decimal(19,0)) * cast(total as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    assert row.selectExpr(score).first()[0] == 1000 * a * n // (left * right)


def test_empty_tables(spark):
    assert ph.collocations(spark.createDataFrame([], DOC)).count() == 0
    assert ph.collocations(spark.createDataFrame([(1, None, None, "", 1, 1, 1)], DOC)).count() == 0

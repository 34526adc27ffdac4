"""Line rules against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scanloom.llm import line_dedup, quality_rules

BLANKS = " \t\n\x0b\x0c\r"


def plain_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain_dedup(rows, least=10):
    owner = {}
    for d, t, *_ in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                k = plain_key(line)
                if len(k) >= least:
                    owner[k] = min(d, owner.get(k, d))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(plain_key(x)) < least or owner[plain_key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sample(seed, n=160):
    rng = random.Random(seed)
    pool = ["Common line of the site", "  common LINE of the site\t", "ÄRGER über Zeilen", "ärger über Zeilen", "short", "", " ", "\x0b", "a line with words in it", "x" * 9, "x" * 10, "日本語の行です、十文字以上"]
    rows = []
    for d in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own {rng.randint(0, 80)} words {rng.randint(0, 9)} more" for _ in range(rng.randint(0, 7))]
        rows.append((d * 3, "\n".join(lines)))
    rows += [(9001, None), (9002, ""), (None, "Common line of the site\nshort"), (9003, "\n".join(["Common line of the site"] * 4000)), (0, rows[0][1]), (0, "Common line of the site")]
    return rows


@pytest.mark.parametrize("batches,fan", [(1, 2), (5, 2), (7, 3)])
def test_line_dedup_equals_brute_force(spark, batches, fan):
    rows = sample(batches)
    df = spark.createDataFrame([(*r, "c", 5) for r in rows], "doc_id long, text string, pos string, owner int").repartition(3)
    out = line_dedup.dedup_lines(df, line_dedup.LineDedupParams(batches=batches, fan=fan))
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == Counter(plain_dedup(rows))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup_of_nothing(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, fan=2, buckets=2)
    seen = {}
    rng = random.Random(1)
    for batch in range(6):
        keys = [(rng.randint(0, 40), 0, batch * 10 + rng.randint(0, 9)) for _ in range(25)]
        runs.add(spark.createDataFrame(keys, "h1 long, h2 long, doc_id long"))
        for h, _, d in sorted(keys, key=lambda k: k[2]):
            seen.setdefault(h, d)
        assert sum(map(len, runs.levels)) == bin(batch + 1).count("1")
        assert {r.h1: r.doc_id for r in runs.table().collect()} == seen
    runs.drop()


def plain_quality(rows, max_docs=10, left=30):
    import re

    words = lambda t: [w for w in re.split("[ \t-\r]+", t or "") if w]
    holders = defaultdict(set)
    for d, t, host in rows:
        for line in (t or "").split("\n"):
            if words(line):
                holders[host or "", plain_key(line)].add(d)
    out = []
    for d, t, host in rows:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        shared = sum(len(words(x)) for x in lines if len(holders[host or "", plain_key(x)] - {None}) + (None in holders[host or "", plain_key(x)]) > max_docs)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed, shared, not failed and 100 * (len(w) - shared) >= left * len(w)))
    return out


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(9)
    boiler = ["Home | About | Contact", "all RIGHTS reserved by the site owner", "one two three four five six seven eight nine ten eleven twelve"]
    rows = []
    for d in range(120):
        lines = [rng.choice(boiler) for _ in range(rng.randint(0, 6))] + [" ".join(rng.choice(["aé", "b#", "c", "d*e", "日本", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 4))]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines), rng.choice(["h1", "h2", None])))
    legal = " ".join(f"clause{i}" for i in range(70))
    rows += [(d, f"{legal}\nand ten words of its own {d} that are not shared", "h1") for d in range(200, 214)]
    rows += [(9001, None, "h1"), (9002, "", None), (9003, " \x0b\n", "h1"), (9004, "a" * 100_000, "h2"), (9005, "one two three " * 40, "h2"), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 4) for r in rows], "doc_id long, text string, source string, line_hash int").repartition(4)
    got = Counter(tuple(r) for r in quality_rules.quality_rules(df).select("doc_id", *quality_rules._COUNTS, "base_failed", "shared_words", "kept").collect())
    assert got == Counter(plain_quality(rows))
    assert any(not failed and not kept for *_, failed, _, kept in plain_quality(rows))
    clean = {r.doc_id: r.text for r in quality_rules.clean_documents(df).collect()}
    assert set(clean) == {r[0] for r, q in zip(rows, plain_quality(rows)) if q[-1]}
    for d, t in clean.items():
        assert not any(plain_key(x) == plain_key(b) for x in t.split("\n") for b in boiler[:2])
    assert quality_rules.quality_rules(df.filter("false")).count() == 0


def test_cleaning_judges_rows_not_ids(spark):
    good = " ".join(f"word{i}" for i in range(80))
    boiler = "the same line of this host"
    rows = [(d, f"{boiler}\n{good} {d}", "h") for d in range(12)] + [(None, good, "h"), (None, "bad", "h"), (3, "bad", "h"), (3, good, None), (3, good, None)]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, source string, row int, digest string").repartition(3)
    got = Counter((r.doc_id, r.text, r.source) for r in quality_rules.clean_documents(df).collect())
    assert got == Counter([(d, f"{good} {d}", "h") for d in range(12)] + [(None, good, "h"), (3, good, None), (3, good, None)])
    assert quality_rules.clean_documents(df.filter("false")).count() == 0

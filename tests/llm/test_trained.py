"""Trained operators: held-out accuracy, brute force of their parts, odd inputs."""

import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanloom.llm import language_id, licences, quality_mil, toxicity
from scanloom.llm import textblock as tb

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
ODD = [(9001, None), (9002, ""), (9003, "\n \t"), (9004, "123 !!"), (9005, "x" * 200_000), (9006, "日本語"), (None, "the and of"), (9007, "the and"), (9007, "the and")]


def docs_and_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in ODD], docs.schema)
    return docs.unionByName(odd).withColumn("label", F.lit("clash")).withColumn("evidence", F.lit(1)), labels.unionByName(spark.createDataFrame([(None, 1, 1), (9005, None, None)], labels.schema))


def check_rows(rows, docs):
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    assert all(0 <= r.score <= 1 for r in rows)


@needs_tables
def test_language(spark):
    docs, _ = docs_and_labels(spark)
    rows = language_id.predict(docs, language_id.learn(docs)).collect()
    check_rows(rows, docs)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out and r.doc_id < 9000]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    by_id = {r.doc_id: r.lang_pred for r in rows}
    assert [by_id[d] for d in (9001, 9002, 9003, 9004)] == ["und"] * 4 and by_id[9006] != "und"
    none = language_id.predict(docs, language_id.learn(docs.filter("false"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    kept = language_id.keep_identified(docs, language_id.learn(docs))
    assert kept.columns == docs.columns and kept.filter("doc_id = 9001").count() == 0 and kept.count() > 950


def test_mixture_shares():
    rng = np.random.default_rng(0)
    like = np.where(rng.random(900) < 0.7, 0, 1)
    p = np.full((900, 3), 1e-6)
    p[np.arange(900), like] = 1.0
    shares, count = language_id.infer(p, np.array([0]), language_id.LanguageParams())
    assert count.tolist() == [2] and abs(shares[0, 0] - np.mean(like == 0)) < 1e-6 and shares[0, 2] == 0
    shares, count = language_id.infer(p[like == 0], np.array([0, 100]), language_id.LanguageParams())
    assert count.tolist() == [1, 1] and (shares[:, 0] == 1).all()


def plain_language(text, model, params):
    """EM for one document over every set of the most likely languages, word by word."""
    words = ["".join(w) for w in "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text).split()]
    if not words or not any(c.isalpha() for c in text):
        return "und", 0.0
    like = []
    for w in words:
        raw = b" " + w.encode() + b" "
        code = [(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1) % (1 << 32)) >> (32 - params.bucket_bits) for i in range(len(raw) - 2)]
        z = np.array([sum(float(row[c]) for c in code) for row in model.logp])
        like.append(np.exp(z - z.max()))

    def settle(share):
        for _ in range(params.rounds):
            new = np.zeros(len(share))
            for x in like:
                new += x * share / max(1e-300, (x * share).sum())
            new /= len(like)
            moved, share = np.abs(new - share).max(), new
            if moved < 1e-4:
                break
        return share, sum(np.log(max(1e-300, x @ share)) for x in like)

    full, _ = settle(np.full(len(model.names), 1 / len(model.names)))
    rank = sorted(range(len(full)), key=lambda k: -full[k])
    best = (-np.inf, None)
    for k in range(1, max(1, sum(full >= params.least_share)) + 1):
        allowed = np.zeros(len(full))
        allowed[rank[:k]] = 1 / k
        share, total = settle(allowed)
        best = max(best, (total - params.penalty * (k - 1) * np.log(len(words) + 1), k, share), key=lambda b: b[0])
    return model.names[int(best[2].argmax())], min(1.0, best[2].max())


@pytest.mark.parametrize("cells", [1 << 22, 60])
def test_language_equals_plain_expectation_maximisation(spark, cells):
    rng = random.Random(3)
    parts = {"en": "th er on an re ing ou", "fr": "é eau eux oi qu ç ai", "de": "sch ung ö ü keit ei tz"}
    prose = lambda tag, n: " ".join("".join(rng.choice(parts[tag].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    train = [(d, prose(t, 60), t) for d in range(90) for t in parts]
    params = language_id.LanguageParams(bucket_bits=10, cells=cells)
    model = language_id.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"), params)
    texts = [None, "", "12", "日本", prose("en", 1), *[f"{prose(a, rng.randint(1, 25))} {prose(b, rng.randint(0, 25))}" for a in parts for b in parts for _ in range(3)], prose("fr", 40) + "\n" + prose("de", 30) + prose("en", 20)]
    out = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, params).collect()
    for r in out:
        name, share = plain_language((texts[r.doc_id] or "").lower(), model, params)
        assert r.lang_pred == name and abs(r.score - share) < 2e-3


def test_many_languages(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tags = {f"l{k:03d}": rng.sample(letters, 6) for k in range(230)}
    prose = lambda tag, n: " ".join("".join(rng.choice(tags[tag]) for _ in range(6)) for _ in range(n))
    rows = [(d * 1000 + k, prose(t, 50), t) for d in range(3) for k, t in enumerate(tags)] + [(900_000, prose("l007", 3000), "l007")]
    params = language_id.LanguageParams(bucket_bits=10, cells=1 << 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.predict(docs, language_id.learn(docs, params), params).collect()
    truth = {d: t for d, _, t in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.95
    assert language_id.predict(docs.filter("false"), language_id.learn(docs, params), params).count() == 0


@needs_tables
def test_quality(spark):
    docs, labels = docs_and_labels(spark)
    rows = quality_mil.score(docs, quality_mil.learn(docs, labels)).collect()
    check_rows(rows, docs)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert {r.score for r in quality_mil.score(docs, quality_mil.learn(docs, labels.filter("quality = 1"))).collect()} == {1.0}


def test_attention_gradient():
    rng = np.random.default_rng(3)
    owner = np.repeat(np.arange(60), 5)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    y = rng.integers(0, 2, 60)
    x[np.arange(60) * 5 + rng.integers(0, 5, 60), 0] += 8 * y  # one passage decides
    model = quality_mil.fit(x, owner, y, np.ones(60), quality_mil.MilParams(steps=300))
    assert np.mean((model.score(x, owner) > 0.5) == y) > 0.95


def test_scores_equal_a_walk_over_the_bags():
    rng = np.random.default_rng(5)
    texts = tb.texts_of(pa.array(["", None, "one two three", "word " * 1000, "A b! 12 " * 300, "é日 x"]))
    params = quality_mil.MilParams(passage_words=20)
    x, owner = quality_mil.encode(texts, params)
    model = quality_mil.fit(x, owner, np.array([0, 1, 1, 0, 1, 0]), np.ones(6), quality_mil.MilParams(steps=20))
    w = model.weights
    sig = lambda z: 1 / (1 + np.exp(-z))
    for d, got in enumerate(model.score(x, owner)):
        bag = [np.clip((row - model.mean) / model.scale, -8, 8) for row in x[owner == d]]
        gate = [float((np.tanh(v @ w["v"] + w["vb"]) * sig(v @ w["u"] + w["ub"])) @ w["a"]) for v in bag]
        share = np.exp(np.array(gate) - max(gate))
        share /= share.sum()
        assert abs(sig(sum(a * v for a, v in zip(share, bag)) @ w["c"] + w["b"][0]) - got) < 1e-9
    assert len(x) > rng.integers(1, 60) and np.bincount(owner).tolist()[3] == 50  # every passage, however many


def test_scores_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, label int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_mil.score(docs, quality_mil.learn(docs, labels)).count() == 0
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000, 0)], docs.schema)
    assert toxicity.score(long, toxicity.learn(docs, labels)).collect()[0].predicted == 0


def plain_segments(scores):
    """All maximal segments by repeatedly taking the best one and splitting around it."""
    out = []

    def cut_out(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = round(sum(scores[i:j]), 9)
                if s > 0 and (best is None or (s, i - j, -i) > (best[0], best[1] - best[2], -best[1])):
                    best = (s, i, j)
        if best:
            cut_out(a, best[1])
            out.append((best[1], best[2], best[0]))
            cut_out(best[2], b)

    cut_out(0, len(scores))
    return out


def test_segments_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, -1, 1, 2, 5]) + rng.random() * 0.001 for _ in range(rng.randint(0, 14))]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(np.array(scores))]
        assert got == [(a, b, round(s, 6)) for a, b, s in plain_segments(scores)]


def test_decay_rate():
    value, share = np.array([1.0, -1.0]), np.array([0.25, 0.75])
    assert abs(toxicity.decay_rate(value, share) - np.log(3)) < 1e-6


def test_toxicity(spark):
    rng = random.Random(7)
    bad = ["idiot", "scum", "loser", "lowei"]
    rows, labels = [], []
    for d in range(900):
        words = ["".join(rng.choice(["an", "er", "th", "on", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 200))]
        toxic = d % 4 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) + (rng.choice(["", "isch", "ent"]) if rng.random() < 0.4 else "") for _ in range(rng.randint(3, 6))]
        rows.append((d, " ".join(words)))
        labels.append((d, 1, int(toxic)))
    odd = [o for o in ODD if o[0] != 9005]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + odd], "doc_id long, text string, weight string").repartition(3)
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, truth)
    out = toxicity.score(docs, model).collect()
    check_rows(out, docs)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    spans = toxicity.passages(docs, model).collect()
    assert {r.doc_id for r in spans} >= {r.doc_id for r in held if r.predicted}
    assert {r.predicted for r in toxicity.score(docs, toxicity.learn(docs, truth.filter("toxic = 0"))).collect()} == {0}


def test_licences(spark):
    rng = random.Random(2)
    prose = ["".join(rng.choice("abcdefghij") for _ in range(5)) + " the and of is to this with for" for _ in range(400)]
    texts = [f"{p}\n{q}" for p, q in zip(prose[::2], prose[1::2])]
    want = {0: "gpl:1", 1: "apache:0", 2: "mit:2", 3: "cc-by-nc:1", 4: "bsd:1"}
    notices = ["Licensed under the GNU General Public License, version 3, by the authors.", "Licensed under the Apache License Version 2.0", "released under the MIT license", "Licensed under CC BY-NC 4.0.", "Redistribution and use in source and binary forms with or without modification are permitted"]
    for d, notice in enumerate(notices):
        lines = texts[d].split("\n")
        lines.insert(int(want[d].split(":")[1]), notice)
        texts[d] = "\n".join(lines)
    texts[5] += "\nA driving licence was shown to the general public."
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(7000, None, "x", 1), (7001, "", "x", 1), (None, notices[0], "x", 1), (7002, notices[3], "x", 1), (7002, notices[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string, pos int")
    out = licences.scan(docs).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    got = {r.doc_id: r.licences for r in out if r.n_licences}
    assert got == want | {None: "gpl:0", 7002: "cc-by-nc:0"}


# Published licence texts in their usual line breaks.
WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "bsd": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met:
 *
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.""",
    "lgpl": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "apache": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
}


def test_wrapped_licences(spark):
    rng = random.Random(3)
    prose = lambda n: "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(9)) for _ in range(n))
    names = list(WRAPPED)
    rows = [(d, f"{prose(3)}\n\n{WRAPPED[names[d]]}\n\n{prose(20)}") for d in range(len(names))] + [(100 + d, prose(25)) for d in range(60)]
    rows += [(200, "\n".join(prose(1) for _ in range(8000)) + "\n" + WRAPPED["bsd"] + "\n" + "x" * 100_000)]
    out = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, name in enumerate(names):
        families = {x.split(":")[0] for x in out[d].licences.split(",")}
        assert name in families and families <= {name, "unknown"}, out[d].licences
    assert out[200].n_licences >= 1 and {x.split(":")[0] for x in out[200].licences.split(",")} <= {"bsd", "unknown"}
    assert not any(out[100 + d].licences for d in range(60))


def test_corpus_of_licence_lines(spark):
    """Words that every line of the corpus holds stay informative."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6)).title()
    rows = [(d, f"Copyright {1990 + d % 30} {name()} {name()}, all rights reserved, licensed under the MIT license.") for d in range(1500)]
    out = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_licences >= 1 for r in out) == 1500
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licence_scores_equal_a_plain_scorer(spark):
    rng = random.Random(6)
    notices = [t for texts in licences.NOTICES.values() for t in texts]
    prose = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet work file version copy public".split()) for _ in range(9))
    thinned = lambda: " ".join(w for w in rng.choice(notices).split() if rng.random() < rng.choice([0.6, 1]))
    texts = ["\n".join(rng.choice([prose, prose, thinned])() for _ in range(4)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licences.learn(docs)
    weights = {r.feature: np.array(r.w) for r in model.weights.collect()}
    templates = {}
    for r in model.templates.collect():
        templates.setdefault((r.template, r.family), set()).add(r.feature)
    got = {(r.doc_id, r.pos): (r.family, r.probability) for r in licences.judged(licences.units_of(docs, licences.LicenceParams()), model).collect() if not r.wide}
    for d, text in enumerate(texts):
        for pos, line in enumerate(text.split("\n")):
            w = [x for x in re.split("[^a-z0-9]+", line.lower()) if x]
            grams = set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}
            hit = [g for g in grams if g in weights]
            if not set(w) & set(licences.INFORMATIVE) or not hit:
                assert (d, pos) not in got
                continue
            z = np.array(model.bias) + sum(weights[g] for g in hit)
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            sure = {f: p[model.classes.index(f)] for (t, f), features in templates.items() if len(features & grams) >= 0.6 * len(features)}
            if 1 - p[0] > model.threshold + 1e-9:
                family, probability = got[d, pos]
                assert abs(probability - (1 - p[0])) < 1e-9
                assert family == "unknown" if not sure else abs(sure[family] - max(sure.values())) < 1e-9
    assert len({f for f, _ in got.values()}) > 2


def test_licences_are_calibrated_on_all_lines(spark):
    rng = random.Random(7)
    words = "general public license software work copyright terms version rights permission copy lorem ipsum dolor sit amet".split()
    lines = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(2, 5))) + f" {k}" for k in range(9000)})
    docs = spark.createDataFrame([(d, "\n".join(lines[d::300])) for d in range(300)], "doc_id long, text string")
    params = licences.LicenceParams(false_alarms=0.02, least_probability=0.0)
    model = licences.learn(docs, params)
    weights = {r.feature: np.array(r.w) for r in model.weights.collect()}
    notes = {r.feature for r in model.templates.collect() if " " in r.feature}
    grams = lambda line: set(line.split()) | {f"{a} {b}" for a, b in zip(line.split(), line.split()[1:])}
    half = spark.createDataFrame([(x,) for x in lines], "line string").selectExpr("line", "pmod(xxhash64(xxhash64(line), 3), 2) AS half").collect()
    plain = [grams(r.line) for r in half if r.half == 1 and len(grams(r.line) & notes) <= 1]
    tops = []
    for g in plain:
        if hit := sorted(g & weights.keys()):
            z = np.array(model.bias) + sum(weights[f] for f in hit)
            tops.append(1 - (np.exp(z - z.max()) / np.exp(z - z.max()).sum())[0])
    assert len(plain) > 2500
    assert abs(model.threshold - sorted(tops, reverse=True)[int(0.02 * len(plain))]) < 1e-9


def test_repeated_rows_of_a_licence_are_judged_alone(spark):
    text = "The work is public.\nLicensed under the GNU General Public License."
    docs = spark.createDataFrame([(1, text)] + [(2, text)] * 40 + [(None, text)] * 300 + [(3, "prose of no licence")], "doc_id long, text string")
    model = licences.learn(docs)
    out = licences.find_licences(docs, model).collect()
    units = licences.judged(licences.units_of(docs, licences.LicenceParams()), model).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "None"]
    assert len({str(r.found) for r in out}) == 1 and max(r.probability for r in out) - min(r.probability for r in out) < 1e-9
    assert all(r.coverage <= 1 for r in units)


def test_nth_largest(spark):
    rng = random.Random(8)
    values = [rng.choice([0.25, 1.0, 1 - 1e-15, rng.random(), rng.random() * 1e-12]) for _ in range(400)]
    rows = spark.createDataFrame([(v, 3) for v in values], "value double, count long")
    ranked = sorted(values, reverse=True)
    for n in (0, 2, 3, 500, 1199):
        assert licences._nth_largest(rows, n) == ranked[n // 3]
    assert licences._nth_largest(rows, 1200) == 0.0


def test_words_and_hashes():
    texts = tb.texts_of(pa.array(["a b", None, "", " x\ty ", "a b"]).slice(0, 5))
    words = tb.words_of(texts)
    assert words.first.tolist() == [0, 2, 2, 2, 4, 6]
    h = tb.hash_spans(texts.data, words.start, words.end, block=3)
    assert (h == tb.hash_spans(texts.data, words.start, words.end)).all() and h[0] == h[4] != h[1]
    grams, at = tb.ngrams(h, words.text, 2)
    assert at.tolist() == [0, 2, 4] and grams[0] == grams[2] != grams[1]
